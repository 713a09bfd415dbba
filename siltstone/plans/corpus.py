"""Queries on the corpus tables: analytics, lifecycle, ingest plans, text functions, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import injection, text
from siltstone.model import Corpus
from siltstone.operators import analytics, ingest, lifecycle, navigate, search
from siltstone.plans.retrieval import AS_OF, CHUNK, DOC
from siltstone.queries import query
from siltstone.sources import files, manifest, packages

LIVE_DOC = f"""ld AS (SELECT n.*, v.source_id, v.ingested_at, s.slug AS source_slug, s.kind AS source_kind FROM {DOC} n JOIN source_version v ON v.id = n.source_version_id AND v.is_active JOIN corpus_source s ON s.id = v.source_id AND s.retired_at IS NULL)"""
_RANK = "CASE coalesce(provenance.attribution, 'unknown') WHEN 'foundation' THEN 0 WHEN 'partner' THEN 1 WHEN 'third_party' THEN 2 WHEN 'community' THEN 3 ELSE 4 END"
PATH = r"regexp_replace(regexp_replace(trim({}), '\\+', '/', 'g'), '^(\./+|/+)+', '')"


def _c(spark: SparkSession, sf: str) -> Corpus:
    return Corpus(spark, sf)


# --- facet values and overviews --------------------------------------------------------------------

_FACETS = {
    "language": "SELECT language AS value, id FROM ld",
    "source_slug": "SELECT source_slug AS value, id FROM ld",
    "attribution": "SELECT coalesce(provenance.attribution, 'unknown') AS value, id FROM ld",
    "content_type": "SELECT coalesce(provenance.content_type, 'other') AS value, id FROM ld",
    "tags": "SELECT unnest(provenance.tags) AS value, id FROM ld",
    "language_target": "SELECT t.name AS value, id FROM (SELECT unnest(provenance.language_targets) AS t, id FROM ld)",
    "sdk_dependency": "SELECT t.name AS value, id FROM (SELECT unnest(provenance.sdk_dependencies) AS t, id FROM ld)",
    "package": "SELECT p.name AS value, ld.id FROM ld JOIN source_package p ON p.id = ld.package_id",
}


def _facet(name: str):
    return lambda spark, sf: analytics.facet_values(_c(spark, sf), name)


for _name, _sql in _FACETS.items():
    query(f"facet_values_{_name}", f"WITH {LIVE_DOC} SELECT value, count(DISTINCT id) AS n FROM ({_sql}) WHERE value IS NOT NULL GROUP BY 1")(_facet(_name))


@query("facet_total_tags", f"WITH {LIVE_DOC} SELECT count(DISTINCT value) AS n_values FROM ({_FACETS['tags']}) WHERE value IS NOT NULL")
def facet_total_tags(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.facet_total(_c(spark, sf), "tags")


@query("facet_total_packages", f"WITH {LIVE_DOC} SELECT count(DISTINCT value) AS n_values FROM ({_FACETS['package']})")
def facet_total_packages(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.facet_total(_c(spark, sf), "package")


@query(
    "facet_samples",
    f"""WITH {LIVE_DOC}, a AS ({' UNION ALL '.join(f"SELECT '{k}' AS facet, value, count(DISTINCT id) AS n FROM ({_FACETS[k]}) WHERE value IS NOT NULL GROUP BY 2" for k in ('language', 'source_slug', 'tags', 'package'))})
    SELECT facet, value, n FROM a QUALIFY facet IN ('language', 'source_slug') OR row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 10""",
)
def facet_samples(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.facet_samples(_c(spark, sf))


@query("sources_by_kind", "SELECT kind, count(*) AS n_sources FROM corpus_source WHERE retired_at IS NULL GROUP BY 1")
def sources_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.sources_by_kind(_c(spark, sf))


@query(
    "sources_by_attribution",
    f"""WITH {LIVE_DOC}, r AS (SELECT source_id, min({_RANK}) AS r FROM ld GROUP BY 1), s AS (SELECT coalesce(r.r, 4) AS r FROM corpus_source c LEFT JOIN r ON r.source_id = c.id WHERE c.retired_at IS NULL)
    SELECT ['foundation', 'partner', 'third_party', 'community', 'unknown'][r + 1] AS attribution, count(*) AS n_sources FROM s GROUP BY 1""",
)
def sources_by_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.sources_by_attribution(_c(spark, sf))


@query(
    "version_coverage",
    f"""WITH {LIVE_DOC}, t AS (SELECT id, unnest(provenance.language_targets) AS t FROM ld), n AS (SELECT t.name AS target, t.version_constraint, count(*) AS n FROM t WHERE t.name IS NOT NULL AND t.version_constraint IS NOT NULL GROUP BY 1, 2),
    top AS (SELECT target FROM n GROUP BY 1 ORDER BY sum(n) DESC, target LIMIT 6)
    SELECT target, CAST(row_number() OVER (PARTITION BY target ORDER BY n DESC, version_constraint) AS INT) AS place, version_constraint, n FROM n WHERE target IN (SELECT target FROM top) QUALIFY place <= 5""",
)
def version_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.version_coverage(_c(spark, sf))


@query("freshness", f"WITH {LIVE_DOC} SELECT epoch_us(min(coalesce(source_modified_at, ingested_at))) AS oldest_us, epoch_us(max(coalesce(source_modified_at, ingested_at))) AS newest_us, count(*) AS n_documents FROM ld")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    f = analytics.freshness(_c(spark, sf))
    return f.select(F.unix_micros("oldest").alias("oldest_us"), F.unix_micros("newest").alias("newest_us"), "n_documents")


@query(
    "ingest_status",
    f"""WITH n AS (SELECT v.source_id, count(*) AS total, count(*) FILTER (c.status = 'ready') AS ready, count(*) FILTER (c.status = 'embed_failed') AS embed_failed FROM {CHUNK} c JOIN source_version v ON v.id = c.source_version_id AND v.is_active GROUP BY 1)
    SELECT s.slug, coalesce(total, 0) AS total, coalesce(ready, 0) AS ready, coalesce(embed_failed, 0) AS embed_failed FROM corpus_source s LEFT JOIN n ON n.source_id = s.id""",
)
def ingest_status(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.ingest_status(_c(spark, sf))


@query(
    "inventory_complete",
    f"""WITH n AS (SELECT document_id, count(*) AS n, count(*) FILTER (status = 'embed_failed') AS f FROM {CHUNK} GROUP BY 1)
    SELECT d.id AS document_id, d.source_path, coalesce(n, 0) AS n_chunks, coalesce(f, 0) AS n_failed, coalesce(n, 0) > 0 AND coalesce(f, 0) = 0 AS complete FROM {DOC} d JOIN source_version v ON v.id = d.source_version_id AND v.is_active LEFT JOIN n ON n.document_id = d.id""",
)
def inventory_complete(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.inventory(_c(spark, sf))


@query("document_tokens_by_kind", f"SELECT lower(kind) AS kind, count(*) AS n, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS tokens, max(char_count) AS longest FROM {DOC} GROUP BY 1")
def document_tokens_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return _c(spark, sf).documents.groupBy(F.lower("kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"), F.max("char_count").alias("longest"))


# --- lifecycle -------------------------------------------------------------------------------------


@query(
    "retention_sweep",
    f"""SELECT v.id, v.source_id, v.revision FROM (SELECT v.*, coalesce(s.retention_count, 5) AS keep, row_number() OVER (PARTITION BY v.source_id ORDER BY v.revision DESC, v.id) AS place FROM source_version v JOIN corpus_source s ON s.id = v.source_id WHERE v.status IN ('active', 'inactive', 'retired')) v
    WHERE place > 1 AND status IN ('inactive', 'retired') AND ingested_at < TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 30 DAY""",
)
def retention_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """With one version kept, so that the small corpora have something to sweep."""
    c = _c(spark, sf)
    return lifecycle.swept_versions(c.versions, c.sources, AS_OF, 30, keep=1).select("id", "source_id", "revision")


@query(
    "sweep_once",
    f"""SELECT 'source' AS kind, id FROM corpus_source WHERE retired_at < TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 30 DAY
    UNION ALL SELECT 'aborted', id FROM source_version WHERE status = 'aborted' AND ingested_at < TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 30 DAY
    UNION ALL SELECT 'version', id FROM (SELECT v.*, coalesce(s.retention_count, 5) AS keep, row_number() OVER (PARTITION BY v.source_id ORDER BY v.revision DESC, v.id) AS place FROM source_version v JOIN corpus_source s ON s.id = v.source_id WHERE v.status IN ('active', 'inactive', 'retired')) WHERE place > keep AND status IN ('inactive', 'retired') AND ingested_at < TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 30 DAY""",
)
def sweep_once(spark: SparkSession, sf: str) -> DataFrame:
    c = _c(spark, sf)
    return lifecycle.sweep_once(c.versions, c.sources, AS_OF, 30)


@query("next_revision", "SELECT s.id AS source_id, CAST(coalesce(max(v.revision), 0) + 1 AS INT) AS revision FROM corpus_source s LEFT JOIN source_version v ON v.source_id = s.id GROUP BY 1")
def next_revision(spark: SparkSession, sf: str) -> DataFrame:
    c = _c(spark, sf)
    return lifecycle.next_revision(c.versions, c.sources)


@query("corpus_model", "SELECT embedding_model_id AS model_id FROM source_version WHERE is_active ORDER BY ingested_at DESC, id DESC LIMIT 1")
def corpus_model(spark: SparkSession, sf: str) -> DataFrame:
    return _c(spark, sf).corpus_model


@query("may_start", "SELECT count(*) = 0 OR bool_or(m.name = 'velum-context') AS allowed FROM source_version v JOIN embedding_model m ON m.id = v.embedding_model_id WHERE v.is_active")
def may_start(spark: SparkSession, sf: str) -> DataFrame:
    c = _c(spark, sf)
    return lifecycle.may_start(c.versions, c.models, "velum-context")


@query("versions_newest_first", "SELECT source_id, id, revision, CAST(row_number() OVER (PARTITION BY source_id ORDER BY revision DESC, id) AS INT) AS place FROM source_version")
def versions_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    return navigate.newest_first(_c(spark, sf).versions)


@query("retired_sources", f"SELECT slug, epoch_us(CASE WHEN slug = (SELECT min(slug) FROM corpus_source WHERE retired_at IS NULL) OR slug = (SELECT min(slug) FROM corpus_source WHERE retired_at IS NOT NULL) THEN coalesce(retired_at, TIMESTAMPTZ '{AS_OF}+00') ELSE retired_at END) AS retired_us FROM corpus_source")
def retired_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A source retired, and one retired again: the first time stays."""
    s = _c(spark, sf).sources
    for r in s.groupBy(F.col("retired_at").isNull()).agg(F.min("slug").alias("slug")).collect():  # two rows at most
        s = lifecycle.source_retired(s, r.slug, AS_OF)
    return s.select("slug", F.unix_micros("retired_at").alias("retired_us"))


@query("package_upsert", "WITH n AS (SELECT source_version_id, kind, name, 'x' || coalesce(version, '0') AS version FROM source_package WHERE kind = 'npm') SELECT source_version_id, kind, name, version FROM n UNION ALL SELECT source_version_id, kind, name, version FROM source_package WHERE kind <> 'npm'")
def package_upsert(spark: SparkSession, sf: str) -> DataFrame:
    p = _c(spark, sf).packages.select("source_version_id", "kind", "name", "version")
    new = p.where("kind = 'npm'").withColumn("version", F.concat(F.lit("x"), F.coalesce("version", F.lit("0"))))
    return lifecycle.upserted(p, new, ["source_version_id", "kind", "name"])


@query("embed_failed_work", f"SELECT id, epoch_us(created_at) AS created_us FROM {CHUNK} WHERE status = 'embed_failed'")
def embed_failed_work(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.embed_failed(_c(spark, sf).chunks).select("id", F.unix_micros("created_at").alias("created_us"))


@query("active_sources", "SELECT id, slug FROM corpus_source WHERE retired_at IS NULL")
def active_sources(spark: SparkSession, sf: str) -> DataFrame:
    return navigate.list_sources(_c(spark, sf).sources, retired=False).select("id", "slug")


@query("sources_not_on_model", f"""WITH m AS (SELECT max(id) AS m FROM embedding_model), a AS (SELECT n.source_version_id, min({_RANK}) AS r FROM {DOC} n GROUP BY 1)
    SELECT s.slug, CAST(a.r AS INT) AS best_rank FROM corpus_source s JOIN source_version v ON v.source_id = s.id AND v.is_active LEFT JOIN a ON a.source_version_id = v.id WHERE v.embedding_model_id <> (SELECT m FROM m)""")
def sources_not_on_model(spark: SparkSession, sf: str) -> DataFrame:
    """Against another model than the corpus uses, so that there are some."""
    c = _c(spark, sf)
    return analytics.sources_off_model(c, F.lit(c.models.agg(F.max("id").alias("m")).first().m))


# --- ingest plans ----------------------------------------------------------------------------------

_OLD = "(SELECT source_path AS path, content_hash FROM {d} WHERE kind <> 'plaintext')".format(d=DOC)


@query(
    "ingest_plan",
    f"""WITH d AS (SELECT v.source_id || '/' || {PATH.format('n.source_path')} AS path, n.* FROM {DOC} n JOIN source_version v ON v.id = n.source_version_id WHERE v.is_active), o AS (SELECT path, max(content_hash) AS h FROM d GROUP BY 1),
    w AS (SELECT v.source_id || '/' || {PATH.format('f.path')} AS path, sha256(f.content) AS h FROM source_file f JOIN source_version v ON v.id = f.source_version_id), n AS (SELECT path, max(h) AS h FROM w GROUP BY 1)
    SELECT CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL OR o.h IS NULL THEN 'new' WHEN lower(o.h) = n.h THEN 'carried' ELSE 'changed' END AS decision, count(*) AS n FROM n FULL JOIN o ON n.path = o.path GROUP BY 1""",
)
def ingest_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Files of all snapshots against the recorded documents, by source and path."""
    c = _c(spark, sf)
    v = c.versions.select(F.col("id").alias("source_version_id"), "source_id", "is_active")
    full = F.concat("source_id", F.lit("/"), text.clean_path(F.col("p")))
    old = c.documents.withColumnRenamed("source_path", "p").join(v, "source_version_id").where("is_active").groupBy(full.alias("path")).agg(F.lower(F.max("content_hash")).alias("content_hash")).where("content_hash IS NOT NULL")
    known = c.documents.withColumnRenamed("source_path", "p").join(v, "source_version_id").where("is_active").select(full.alias("path"))
    new = c.raw("source_file").select("source_version_id", F.col("path").alias("p"), F.sha2("content", 256).alias("h")).join(v, "source_version_id").groupBy(full.alias("path")).agg(F.max("h").alias("content_hash"))
    planned = ingest.plan(new, old)
    gone = known.distinct().join(new, "path", "left_anti").join(old, "path", "left_anti").select("path", F.lit("deleted").alias("decision"))
    return planned.unionByName(gone).groupBy("decision").agg(F.count("*").alias("n"))


@query("duplicate_paths", f"SELECT path, id FROM (SELECT id, {PATH.format('source_path')} AS path, row_number() OVER (PARTITION BY {PATH.format('source_path')} ORDER BY id) AS nth FROM (SELECT * FROM {DOC} UNION ALL SELECT * REPLACE ('z' || id AS id) FROM {DOC} WHERE kind = 'code')) WHERE nth > 1")
def duplicate_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A batch that holds all documents, and those of code once more."""
    d = _c(spark, sf).documents.select("id", "kind", text.clean_path(F.col("source_path")).alias("path"))
    twice = d.unionByName(d.where("kind = 'code'").withColumn("id", F.concat(F.lit("z"), "id")))
    return ingest.duplicate_paths(twice, "id").select("path", "id")


@query("duplicate_queries", "SELECT pair_id FROM (SELECT pair_id, row_number() OVER (PARTITION BY request_id, coalesce(text, ''), CAST(coalesce(vector, []) AS VARCHAR), CAST(coalesce(code_vector, []) AS VARCHAR) ORDER BY query_index, pair_id) AS nth FROM query_pair) WHERE nth > 1")
def duplicate_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries of a request asked again, repeated rows of the log among them."""
    return search.repeated_queries(_c(spark, sf).raw("query_pair")).select("pair_id")


@query("upload_decisions", """SELECT *, CASE WHEN carried AND prior_match AND can_carry THEN 'carry' WHEN carried AND NOT prior_match THEN 'carry requested but no matching prior document; re-embed required' WHEN carried THEN 'carry requested but embedding model changed; re-embed required' WHEN has_chunks THEN 'insert' ELSE 'document has no chunks; refusing to insert an unsearchable document' END AS decision
    FROM (SELECT a.b AS carried, b.b AS has_chunks, c.b AS prior_match, d.b AS can_carry FROM (VALUES (true), (false)) a(b), (VALUES (true), (false)) b(b), (VALUES (true), (false)) c(b), (VALUES (true), (false)) d(b))""")
def upload_decisions(spark: SparkSession, sf: str) -> DataFrame:
    import itertools

    t = spark.createDataFrame(list(itertools.product([True, False], repeat=4)), "carried boolean, has_chunks boolean, prior_match boolean, can_carry boolean")
    return t.withColumn("decision", ingest.upload_decision(F.col("carried"), F.col("has_chunks"), F.col("prior_match"), F.col("can_carry")))


@query("chunk_files")
def chunk_files(spark: SparkSession, sf: str) -> DataFrame:
    """All files scanned, cleaned and cut."""
    s = files.bodies(files.scan(_c(spark, sf).raw("source_file").withColumn("path", F.concat("source_version_id", F.lit("/"), "path"))))
    clean = ingest.cleaned(s).where("NOT generated")
    return ingest.chunked(clean).groupBy("path").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("tokens"))


@query("stripped_bytes")
def stripped_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.stripped_bytes(ingest.cleaned(files.bodies(files.scan(_c(spark, sf).raw("source_file")))))


# --- text functions --------------------------------------------------------------------------------


@query("chunk_hashes", f"SELECT id, sha256(content) AS h, sha256(content) = regexp_replace(lower(trim(content_hash)), '^sha-?256[:=]', '') AS fresh FROM {CHUNK}")
def chunk_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """The hash of every chunk, and whether the stored one agrees."""
    h = text.chunk_hash(F.col("content"))
    stored = F.regexp_replace(F.lower(F.trim("content_hash")), r"^sha-?256[:=]", "")
    return _c(spark, sf).wide_chunks.select("id", h.alias("h"), (h == stored).alias("fresh"))


@query(
    "document_hashes",
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[^\S\n]+(\n|$)', '\1', 'g'), '\n+$', '') || chr(10)) AS h FROM documents WHERE text IS NOT NULL""",
)
def document_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _c(spark, sf).raw("documents").where("text IS NOT NULL").select("doc_id", text.document_hash(F.col("text")).alias("h"))


@query("line_stats", r"SELECT doc_id, CAST(list_max(list_transform(string_split(text, chr(10)), lambda x: strlen(x))) AS INT) AS longest, CAST(len(string_split(text, chr(10))) AS INT) AS n_lines FROM documents WHERE text IS NOT NULL")
def line_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = _c(spark, sf).raw("documents").where("text IS NOT NULL")
    return d.select("doc_id", text.longest_line(F.col("text")).alias("longest"), F.size(F.split("text", "\n")).alias("n_lines"))


@query(
    "path_language",
    r"""WITH e AS (SELECT DISTINCT id, lower(regexp_extract(""" + PATH.format("source_path") + r""", '[^/]\.([^./]+)$', 1)) AS e FROM new_document)
    SELECT id, CASE WHEN e IN ('md', 'mdx') THEN 'markdown' WHEN e = 'rs' THEN 'rust' WHEN e IN ('ts', 'tsx') THEN 'typescript' WHEN e IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' WHEN e = 'compact' THEN 'compact' WHEN e = 'txt' THEN 'plaintext' WHEN e = 'json' THEN 'json' WHEN e = 'toml' THEN 'toml' WHEN e = 'py' THEN 'python' WHEN e = 'go' THEN 'go' END AS language,
    CASE WHEN e IN ('md', 'mdx') THEN 'markdown' WHEN e IN ('rs', 'ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'compact', 'json', 'toml', 'py', 'go') THEN 'code' ELSE 'plaintext' END AS kind FROM e""",
)
def path_language(spark: SparkSession, sf: str) -> DataFrame:
    p = text.clean_path(F.col("source_path"))
    return _c(spark, sf).documents.select("id", text.language_of(p).alias("language"), text.kind_of(p).alias("kind"))


@query("license_files", r"SELECT path, count(*) AS n FROM (SELECT " + PATH.format("path") + r" AS path FROM source_file) WHERE regexp_full_match(upper(regexp_extract(path, '([^/]*)$', 1)), '(LICENSE|LICENCE|COPYING|NOTICE|PATENTS)([-.].*)?') GROUP BY 1")
def license_files(spark: SparkSession, sf: str) -> DataFrame:
    f = _c(spark, sf).raw("source_file").select(text.clean_path(F.col("path")).alias("path"))
    return f.where(text.is_license_file(F.col("path"))).groupBy("path").agg(F.count("*").alias("n"))


@query("terms", r"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "))) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def terms(spark: SparkSession, sf: str) -> DataFrame:
    d = _c(spark, sf).raw("documents").select("doc_id", F.explode(text.terms(F.col("text"))).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


_INJ = "regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}" + injection.ZERO_WIDTH + "]', '', 'g')"


@query(
    "injection_rules",
    f"WITH t AS (SELECT doc_id, lower(translate({_INJ}, '{injection.LOOK_ALIKE_FROM}', '{injection.LOOK_ALIKE_TO}')) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, greatest("
    + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN CAST({w} AS DOUBLE) ELSE 0 END" for _, w, p in injection.RULES)
    + ") AS score FROM t",
)
def injection_rules(spark: SparkSession, sf: str) -> DataFrame:
    d = _c(spark, sf).raw("documents").where("text IS NOT NULL").select("doc_id", injection.levelled_plain(F.col("text")).alias("t"))
    return d.select("doc_id", injection.pattern_score(F.col("t")).alias("score"))


@query("injection_levelled")
def injection_levelled(spark: SparkSession, sf: str) -> DataFrame:
    """Scores on text levelled with NFKC and decoded runs, blended and judged."""
    d = _c(spark, sf).raw("documents").where("text IS NOT NULL").select("doc_id", injection.level_udf("text").alias("t"))
    s = injection.pattern_score(F.col("t"))
    return d.select("doc_id", s.alias("score"), injection.verdict(injection.blend(s, F.lit(None).cast("double"))).alias("verdict"))


@query("redacted", r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9.\-_=+/]{32,}', '[redacted]', 'g') AS t FROM documents WHERE text IS NOT NULL")
def redacted(spark: SparkSession, sf: str) -> DataFrame:
    return _c(spark, sf).raw("documents").where("text IS NOT NULL").select("doc_id", text.redacted(F.col("text")).alias("t"))


@query("snippets", "SELECT doc_id, CASE WHEN length(text) > 150 THEN left(text, 150) || '…' ELSE text END AS s FROM documents WHERE text IS NOT NULL")
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    return _c(spark, sf).raw("documents").where("text IS NOT NULL").select("doc_id", text.snippet(F.col("text")).alias("s"))


@query("char_windows", "SELECT doc_id, CAST(greatest(ceil(length(text) / 2000.0), 1) AS INT) AS n FROM documents WHERE text IS NOT NULL")
def char_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _c(spark, sf).raw("documents").where("text IS NOT NULL").select("doc_id", F.size(text.char_windows(F.col("text"))).alias("n"))


@query("cursors", "SELECT slug, rtrim(translate(base64(encode(slug)), '+/', '-_'), '=') AS cursor, slug AS back FROM corpus_source")
def cursors(spark: SparkSession, sf: str) -> DataFrame:
    s = _c(spark, sf).sources.select("slug", text.encoded_cursor(F.col("slug")).alias("cursor"))
    return s.withColumn("back", text.decoded_cursor(F.col("cursor")))


@query("char_tokens", "SELECT doc_id, CAST(greatest(ceil(strlen(coalesce(text, '')) / 4.0), 1) AS BIGINT) AS n FROM documents")
def char_tokens(spark: SparkSession, sf: str) -> DataFrame:
    from siltstone.functions.scoring import char_tokens as estimate

    return _c(spark, sf).raw("documents").select("doc_id", estimate(F.col("text")).cast("bigint").alias("n"))


# --- packages and manifests ------------------------------------------------------------------------


@query(
    "nearest_package",
    f"""WITH p AS (SELECT source_version_id, name, regexp_replace(manifest_path, '/?[^/]*$', '') AS dir FROM source_package), d AS (SELECT id, source_version_id, {PATH.format('source_path')} AS path FROM {DOC}),
    m AS (SELECT d.id, p.name, row_number() OVER (PARTITION BY d.id ORDER BY length(p.dir) DESC, p.name) AS place FROM d JOIN p ON p.source_version_id = d.source_version_id AND (p.dir = '' OR starts_with(d.path, p.dir || '/'))) SELECT id, name FROM m WHERE place = 1""",
)
def nearest_package(spark: SparkSession, sf: str) -> DataFrame:
    """The package of the nearest directory above each document."""
    c = _c(spark, sf)
    marked = c.packages.select(F.col("source_version_id").alias("scope"), text.dirname(F.col("manifest_path")).alias("dir"), "name").groupBy("scope", "dir").agg(F.min("name").alias("name"))
    d = c.documents.select("id", F.col("source_version_id").alias("scope"), text.clean_path(F.col("source_path")).alias("path"))
    near = ingest.nearest_above(d.select("scope", "path").distinct(), marked, ["name"])
    return d.join(near, ["scope", "path"]).where("name IS NOT NULL").select("id", "name")


@query("package_manifests")
def package_manifests(spark: SparkSession, sf: str) -> DataFrame:
    f = _c(spark, sf).raw("source_file").withColumnRenamed("source_version_id", "scope")
    return packages.manifests(f).select("scope", "path", "kind", "name", "version", F.array_join("licenses", " OR ").alias("licenses"))


@query(
    "url_match",
    f"""WITH f AS (SELECT DISTINCT {PATH.format('source_path')} AS path FROM new_document), u AS (SELECT DISTINCT published_url AS url FROM new_document WHERE published_url IS NOT NULL)
    SELECT count(*) AS n_files, (SELECT count(*) FROM u) AS n_urls FROM f""",
)
def url_match_sizes(spark: SparkSession, sf: str) -> DataFrame:
    d = _c(spark, sf).raw("new_document")
    return d.agg(F.count_distinct(text.clean_path(F.col("source_path"))).alias("n_files"), F.count_distinct("published_url").alias("n_urls"))


@query("url_pages")
def url_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages matched to files by their last part and longest common tail."""
    d = _c(spark, sf).raw("new_document")
    return manifest.match_pages(d.select(text.clean_path(F.col("source_path")).alias("path")), d.select(F.col("published_url").alias("url")).where("url IS NOT NULL"))


@query("manifest_generation")
def manifest_generation(spark: SparkSession, sf: str) -> DataFrame:
    d = _c(spark, sf).documents.select(text.clean_path(F.col("source_path")).alias("path"), F.col("published_url").alias("url")).groupBy("path").agg(F.min("url").alias("url"))
    return manifest.generate(d)


@query("robots_sitemaps", "SELECT * FROM (VALUES (0, 'https://a.example/s.xml'), (1, 'https://a.example/t.xml')) t(pos, url)")
def robots_sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    body = "User-agent: *\nSitemap: https://a.example/s.xml\nsitemap : https://a.example/t.xml # x\nSitemap: https://a.example/s.xml\n#Sitemap: https://b.example/x.xml\n"
    return spark.createDataFrame([(body,)], "body string").select(F.posexplode(text.robots_sitemaps(F.col("body"))).alias("pos", "url"))
