"""Queries on contracts: lookups, lifecycle guards, ingest decisions, batches, limits, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.model import Corpus
from siltstone.operators import batching, ingest, lifecycle, navigate, quota, rerank, search
from siltstone.plans.corpus import PATH
from siltstone.plans.retrieval import AS_OF, CHUNK, DOC
from siltstone.queries import query
from siltstone.session import table
from siltstone.sources import packages
from siltstone.streaming import limits, usage

FIRST_INACTIVE = "(SELECT min(id) AS v FROM source_version WHERE NOT is_active)"


def _c(spark: SparkSession, sf: str) -> Corpus:
    return Corpus(spark, sf)


def _first_inactive(c: Corpus) -> str:
    return c.versions.where("NOT is_active").agg(F.min("id").alias("v")).first().v


# --- lookups ---------------------------------------------------------------------------------------


@query("source_at_revision", "SELECT id, source_id, revision, status FROM source_version WHERE source_id = (SELECT min(source_id) FROM source_version) AND revision = 1")
def source_at_revision(spark: SparkSession, sf: str) -> DataFrame:
    v = _c(spark, sf).versions
    return navigate.version_at(v, v.agg(F.min("source_id").alias("s")).first().s, 1).select("id", "source_id", "revision", "status")


@query("document_of_hash", f"WITH d AS {DOC}, w AS (SELECT source_version_id AS v, content_hash AS h FROM d WHERE content_hash IS NOT NULL ORDER BY id LIMIT 1) SELECT id FROM d, w WHERE source_version_id = v AND lower(content_hash) = lower(h)")
def document_of_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the first document's version with its hash, in any case."""
    d = _c(spark, sf).documents
    w = d.where("content_hash IS NOT NULL").orderBy("id").limit(1).select("source_version_id", "content_hash").first()
    return navigate.documents_by_hash(d, w.source_version_id, w.content_hash.upper()).select("id")


@query("chunk_symbols", f"WITH c AS {CHUNK}, w AS (SELECT min(id) AS i FROM c WHERE len(symbol_path) > 0), s AS (SELECT symbol_path AS p FROM c, w WHERE id = i) SELECT CAST(k AS INT) AS position, p[k + 1].kind AS kind, p[k + 1].name AS name FROM s, range(0, 100) r(k) WHERE k < len(p)")
def chunk_symbols(spark: SparkSession, sf: str) -> DataFrame:
    c = _c(spark, sf).chunks
    i = c.where("size(symbol_path) > 0").agg(F.min("id").alias("i")).first().i
    return navigate.symbols_of_chunk(c, i).select("position", "kind", "name")


@query("packages_of_version", "SELECT id, kind, name FROM source_package WHERE source_version_id = (SELECT min(source_version_id) FROM source_package)")
def packages_of_version(spark: SparkSession, sf: str) -> DataFrame:
    p = _c(spark, sf).packages
    return navigate.packages_of(p, p.agg(F.min("source_version_id").alias("v")).first().v).select("id", "kind", "name")


@query("chunks_of_document", f"SELECT id, chunk_index FROM {CHUNK} WHERE document_id = (SELECT min(document_id) FROM chunk)")
def chunks_of_document(spark: SparkSession, sf: str) -> DataFrame:
    c = _c(spark, sf).chunks
    return navigate.chunks_in_order(c, c.agg(F.min("document_id").alias("d")).first().d).select("id", "chunk_index")


@query(
    "chunks_with_context",
    f"""WITH c AS (SELECT * FROM {CHUNK} WHERE status <> 'embed_failed' ORDER BY id LIMIT 20) SELECT c.id, c.chunk_index, sha256(c.content) AS h, d.source_path, d.kind, d.language, v.revision, s.slug AS source_slug
    FROM c JOIN {DOC} d ON d.id = c.document_id JOIN source_version v ON v.id = c.source_version_id JOIN corpus_source s ON s.id = v.source_id""",
)
def chunks_with_context(spark: SparkSession, sf: str) -> DataFrame:
    """The batch look-up of twenty chunks: the most ids a request may name."""
    c = _c(spark, sf)
    ids = navigate.parse_ids(",".join(r.id for r in navigate.visible(c.chunks).select("id").orderBy("id").limit(navigate.MAX_IDS).collect()))
    got = navigate.with_context(c, ids)
    return got.select("id", "chunk_index", F.sha2("content", 256).alias("h"), "source_path", "kind", "language", "revision", "source_slug")


@query("sources_page", "SELECT slug, (SELECT count(*) FROM corpus_source WHERE slug > 'd') > 5 AS more FROM (SELECT slug FROM corpus_source WHERE slug > 'd' ORDER BY slug LIMIT 5)")
def sources_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of five after a cursor: keyset pagination is the feature."""
    return navigate.keyset_page(navigate.list_sources(_c(spark, sf).sources).select("slug"), "slug", "d", 5)


@query("code_sources", "SELECT slug FROM corpus_source WHERE kind = 'code_repo' AND retired_at IS NULL AND slug > 'a'")
def code_sources(spark: SparkSession, sf: str) -> DataFrame:
    return navigate.list_sources(_c(spark, sf).sources, kind="code_repo", retired=False, after="a").select("slug")


# --- lifecycle -------------------------------------------------------------------------------------

_PROMOTED = "CASE WHEN id = v THEN 'active' WHEN is_active AND source_id = s THEN 'inactive' ELSE status END AS status, CASE WHEN id = v THEN true WHEN source_id = s THEN false ELSE is_active END AS is_active"
_TARGET = f"t AS (SELECT v, (SELECT source_id FROM source_version WHERE id = v) AS s FROM {FIRST_INACTIVE})"


@query("promoted_version", f"WITH {_TARGET} SELECT id, {_PROMOTED} FROM source_version, t")
def promoted_version(spark: SparkSession, sf: str) -> DataFrame:
    c = _c(spark, sf)
    return lifecycle.promoted(c.versions, _first_inactive(c), AS_OF).select("id", "status", "is_active")


@query("finalised_versions", f"WITH {_TARGET} SELECT 'building' AS was, id, {_PROMOTED} FROM source_version, t UNION ALL SELECT 'other', id, status, is_active FROM source_version")
def finalised_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A building version is finalised; one of another status changes nothing."""
    c = _c(spark, sf)
    v, i = c.versions, _first_inactive(c)
    building = v.withColumn("status", F.when(F.col("id") == i, "building").otherwise(F.col("status")))
    parts = [lifecycle.finalised(x, i, AS_OF).select(F.lit(w).alias("was"), "id", "status", "is_active") for w, x in (("building", building), ("other", v))]
    return parts[0].unionByName(parts[1])


@query("rolled_back_versions", """WITH t AS (SELECT source_id AS s, revision AS r FROM source_version WHERE status = 'inactive' ORDER BY id LIMIT 1), u AS (SELECT s, r FROM t UNION ALL SELECT '', 0 WHERE NOT EXISTS (SELECT 1 FROM t))
    SELECT id, CASE WHEN source_id = s AND revision = r AND status IN ('inactive', 'active') THEN 'active' WHEN source_id = s AND is_active THEN 'inactive' ELSE status END AS status, CASE WHEN source_id = s THEN revision = r ELSE is_active END AS is_active FROM source_version, u""")
def rolled_back_versions(spark: SparkSession, sf: str) -> DataFrame:
    v = _c(spark, sf).versions
    t = v.where("status = 'inactive'").orderBy("id").limit(1).select("source_id", "revision").first()
    return lifecycle.rolled_back(v, t.source_id if t else "", t.revision if t else 0, AS_OF).select("id", "status", "is_active")


@query("status_changes", f"""WITH {_TARGET} SELECT 'abort' AS what, id, CASE WHEN id = v THEN 'aborted' ELSE status END AS status, is_active AND id <> v AS is_active, epoch_us(retired_at) AS retired_us FROM source_version, t
    UNION ALL SELECT 'retire', id, CASE WHEN id = v THEN 'retired' ELSE status END, is_active AND id <> v, CASE WHEN id = v THEN epoch_us(coalesce(retired_at, TIMESTAMPTZ '{AS_OF}+00')) ELSE epoch_us(retired_at) END FROM source_version, t
    UNION ALL SELECT 'refused', id, status, is_active, epoch_us(retired_at) FROM source_version, t""")
def status_changes(spark: SparkSession, sf: str) -> DataFrame:
    """building -> aborted and inactive -> retired, and a change from a status that isn't there."""
    c = _c(spark, sf)
    i, v = _first_inactive(c), c.versions

    def at(status: str) -> DataFrame:
        return v.withColumn("status", F.when(F.col("id") == i, status).otherwise(F.col("status")))

    parts = [("abort", lifecycle.with_status(at("building"), i, "building", "aborted")), ("retire", lifecycle.with_status(at("inactive"), i, "inactive", "retired", AS_OF)), ("refused", lifecycle.with_status(v, i, "building", "aborted"))]
    out = [x.select(F.lit(w).alias("what"), "id", "status", "is_active", F.unix_micros("retired_at").alias("retired_us")) for w, x in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("patched_sources", "SELECT id, CASE WHEN kind = 'code_repo' THEN upper(display_name) ELSE display_name END AS display_name, origin_url FROM corpus_source WHERE retired_at IS NULL")
def patched_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A patch of one column that leaves the other, and removed rows."""
    s = _c(spark, sf).sources
    patch = s.where("kind = 'code_repo'").select("id", F.upper("display_name").alias("display_name"), F.lit(None).cast("string").alias("origin_url"))
    live = lifecycle.removed(s, s.where("retired_at IS NOT NULL"))
    return lifecycle.patched(live, patch, "id", ["display_name", "origin_url"]).select("id", "display_name", "origin_url")


@query("licensed_source", "SELECT id, CASE WHEN id = (SELECT min(id) FROM corpus_source) THEN ['MIT', 'ISC'] ELSE license END AS license FROM corpus_source")
def licensed_source(spark: SparkSession, sf: str) -> DataFrame:
    s = _c(spark, sf).sources
    return lifecycle.with_license(s, s.agg(F.min("id").alias("i")).first().i, ["MIT", "ISC"]).select("id", "license")


@query("embedded_chunks", f"SELECT status, n, count(*) AS n_chunks FROM (SELECT CASE WHEN status = 'embed_failed' THEN 'ready' ELSE status END AS status, CASE WHEN status = 'embed_failed' THEN 3 ELSE coalesce(len(embedding), -1) END AS n FROM {CHUNK}) GROUP BY ALL")
def embedded_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors for all chunks change the failed ones only."""
    c = _c(spark, sf).wide_chunks
    got = lifecycle.embedded(c, c.select("id", F.array(*[F.lit(0.5).cast("float")] * 3).alias("vector")))
    return got.select("status", F.coalesce(F.size("embedding"), F.lit(-1)).cast("bigint").alias("n")).groupBy("status", "n").agg(F.count("*").alias("n_chunks"))


@query("created_roots", "SELECT 'root-' || id AS id, id AS source_version_id FROM source_version WHERE id NOT IN (SELECT source_version_id FROM node WHERE kind = 'root')")
def created_roots(spark: SparkSession, sf: str) -> DataFrame:
    c = _c(spark, sf)
    return lifecycle.roots_created(c.nodes, c.versions).select("id", "source_version_id")


@query("version_completeness", f"WITH v AS (SELECT min(source_version_id) AS v FROM new_document), n AS (SELECT count(*) AS n FROM {DOC}, v WHERE source_version_id = v) SELECT n AS n_documents, k = n AS complete FROM n, (SELECT unnest([n, n + 1]) AS k FROM n)")
def version_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """The guard with the right number and with one too many."""
    d = _c(spark, sf).documents.select("id", "source_version_id")
    v = d.agg(F.min("source_version_id").alias("v")).first().v
    n = d.where(F.col("source_version_id") == v).count()
    return lifecycle.completeness(d, v, n).unionByName(lifecycle.completeness(d, v, n + 1))


@query("package_conflicts", "SELECT source_version_id, kind, name FROM source_package WHERE kind = 'npm' OR version IS NULL")
def package_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """New rows that would change a version."""
    p = _c(spark, sf).packages.select("source_version_id", "kind", "name", "version")
    new = p.withColumn("version", F.when(F.col("kind") == "npm", F.concat(F.lit("x"), F.coalesce("version", F.lit("")))).otherwise(F.coalesce("version", F.lit("0"))))
    return lifecycle.upsert_conflicts(p, new, ["source_version_id", "kind", "name"], ["version"]).select("source_version_id", "kind", "name")


@query("corrupt_versions", "SELECT source_id, 'several active' AS why FROM source_version WHERE status <> 'aborted' GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT source_id, 'flag and status differ' FROM source_version WHERE status <> 'aborted' AND status <> 'active'")
def corrupt_versions(spark: SparkSession, sf: str) -> DataFrame:
    """What the check finds where all versions that aren't aborted claim to be active."""
    v = _c(spark, sf).versions.where("status <> 'aborted'").withColumn("is_active", F.lit(True))
    return lifecycle.active_violations(v)


@query("corrupt_embeddings", f"""WITH c AS (SELECT id, embedding, CASE WHEN chunk_index = 0 THEN 'other' ELSE embedding_model_id END AS m, source_version_id FROM {CHUNK})
    SELECT c.id, 'model' AS what FROM c JOIN source_version v ON v.id = c.source_version_id WHERE c.embedding IS NOT NULL AND c.m IS DISTINCT FROM v.embedding_model_id UNION ALL SELECT id, 'dimension' FROM c WHERE len(embedding) <> 63""")
def corrupt_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """What the checks find where first chunks are of another model and all vectors one too long."""
    c = _c(spark, sf)
    bad = c.chunks.withColumn("embedding_model_id", F.when(F.col("chunk_index") == 0, "other").otherwise(F.col("embedding_model_id")))
    return lifecycle.model_violations(bad, c.versions).select("id", F.lit("model").alias("what")).unionByName(lifecycle.dimension_violations(bad, "embedding", 63).select("id", F.lit("dimension").alias("what")))


# --- ingest ----------------------------------------------------------------------------------------


@query("carried_chunks", f"SELECT sha256(c.id || 'next') AS id, 'n-' || c.document_id AS document_id, 'next' AS source_version_id FROM {CHUNK} c JOIN {DOC} d ON d.id = c.document_id WHERE d.kind = 'code'")
def carried_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = _c(spark, sf)
    docs = c.documents.where("kind = 'code'").select(F.col("id").alias("document_id"), F.concat(F.lit("n-"), "id").alias("new_document_id"))
    return ingest.carried_chunks(c.chunks.select("id", "document_id", "source_version_id"), docs, "next").select("id", "document_id", "source_version_id")


@query(
    "attached_vectors",
    f"""WITH c AS {CHUNK}, d AS {DOC}, j AS (SELECT d.kind, c.embedding IS NOT NULL AS has, d.kind = 'code' AND c.embedding IS NOT NULL AS has_code FROM c JOIN d ON d.id = c.document_id)
    SELECT kind, count(*) AS n, count(*) FILTER (has) AS n_general, count(*) FILTER (has_code) AS n_code FROM j GROUP BY 1""",
)
def attached_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors joined to chunks by document and place, code vectors on code only."""
    c = _c(spark, sf)
    rows = c.wide_chunks.select("document_id", "chunk_index", "embedding")
    vectors = rows.where("embedding IS NOT NULL").select("document_id", "chunk_index", F.col("embedding").alias("vector"))
    chunks = rows.drop("embedding").join(c.documents.select(F.col("id").alias("document_id"), "kind"), "document_id")
    both = ingest.attached(ingest.attached(chunks, vectors, "general"), vectors, "code", only_code=True)
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count("general").alias("n_general"), F.count("code").alias("n_code"))


@query("vector_mismatches", f"SELECT document_id, n_chunks, n_vectors FROM (SELECT document_id, count(*) AS n_chunks, nullif(count(*) FILTER (embedding IS NOT NULL AND chunk_index > 0), 0) AS n_vectors FROM {CHUNK} GROUP BY 1) WHERE n_chunks IS DISTINCT FROM n_vectors")
def vector_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """With the vectors of first chunks left out."""
    c = _c(spark, sf).chunks
    return ingest.vector_mismatches(c, c.where("embedding IS NOT NULL AND chunk_index > 0")).select("document_id", "n_chunks", "n_vectors")


@query("upload_sizes", f"SELECT d.id, strlen(any_value(d.source_path)) + 512 + CAST(sum(strlen(c.content)) AS BIGINT) + count(*) * ((CASE WHEN any_value(d.kind) = 'code' THEN 2 ELSE 1 END) * 1024 * 12 + 256) AS n_bytes FROM {DOC} d JOIN {CHUNK} c ON c.document_id = d.id WHERE c.content IS NOT NULL GROUP BY 1 HAVING n_bytes > 40000")
def upload_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents above a limit of the upload estimate."""
    c = _c(spark, sf)
    contents = c.wide_chunks.where("content IS NOT NULL").groupBy("document_id").agg(F.collect_list("content").alias("contents"))
    d = c.documents.select(F.col("id").alias("document_id"), "source_path", "kind").join(contents, "document_id")
    sized = d.select(F.col("document_id").alias("id"), ingest.body_bytes(F.col("source_path"), F.col("kind") == "code", F.col("contents")).cast("bigint").alias("n_bytes"))
    return ingest.oversize(sized, limit=40_000)


_UTF8 = "try(decode(content)) IS NOT NULL"
_LICENSE_NAME = "regexp_full_match(upper(regexp_extract(p, '([^/]*)$', 1)), '(LICENSE|LICENCE|COPYING|NOTICE|PATENTS)([-.].*)?')"
_TITLES = f"""tf AS (SELECT source_version_id AS scope, {PATH.format('path')} AS p, trim(regexp_extract(regexp_replace(decode(content), '^[\\s#]+', ''), '^([^\\n]*)', 1), ' ') AS title FROM source_file WHERE {_UTF8}),
    tt AS (SELECT scope, regexp_replace(p, '/?[^/]*$', '') AS dir, list_sort(list(DISTINCT title)) AS titles FROM tf WHERE title <> '' AND {_LICENSE_NAME} GROUP BY 1, 2)"""


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    f = _c(spark, sf).raw("source_file").where(F.is_valid_utf8(F.col("content").cast("string"))).withColumnRenamed("source_version_id", "scope")
    return packages.license_titles(f)


@query("license_titles", f"WITH {_TITLES} SELECT scope, dir, array_to_string(titles, ' | ') AS titles FROM tt")
def license_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _titles(spark, sf).select("scope", "dir", F.array_join("titles", " | ").alias("titles"))


@query(
    "nearest_license",
    f"""WITH {_TITLES}, d AS (SELECT id, source_version_id AS scope, {PATH.format('source_path')} AS path, license FROM {DOC}),
    m AS (SELECT d.id, t.titles, row_number() OVER (PARTITION BY d.id ORDER BY length(t.dir) DESC) AS place FROM d JOIN tt t ON t.scope = d.scope AND (t.dir = '' OR starts_with(d.path, t.dir || '/')))
    SELECT d.id, array_to_string(CASE WHEN len(d.license) > 0 THEN d.license ELSE m.titles END, ' | ') AS licenses FROM d LEFT JOIN m ON m.id = d.id AND m.place = 1""",
)
def nearest_license(spark: SparkSession, sf: str) -> DataFrame:
    """Licenses by path: the document's own, else the titles of the nearest directory above."""
    d = _c(spark, sf).documents.select("id", F.col("source_version_id").alias("scope"), F.regexp_replace(F.regexp_replace(F.trim("source_path"), r"\\+", "/"), r"^(\./+|/+)+", "").alias("path"), "license")
    above = ingest.nearest_above(d.select("scope", "path").distinct(), _titles(spark, sf), ["titles"]).withColumnRenamed("titles", "licenses")
    own = d.select("scope", F.concat("path", F.lit("\0"), "id").alias("key"), "path", "id", F.col("license").alias("licenses"))
    named = ingest.licenses_by_path(own.select("scope", F.col("key").alias("path"), "licenses"), own.select("scope", "path", "key").join(above.select("scope", "path", "licenses"), ["scope", "path"], "left").select("scope", F.col("key").alias("path"), "licenses"))
    return named.select(F.split_part("path", F.lit("\0"), F.lit(2)).alias("id"), F.array_join("licenses", " | ").alias("licenses"))


@query("overlaid_provenance", f"""SELECT id, coalesce(nullif(provenance.attribution, 'unknown'), 'community') AS attribution, coalesce(nullif(provenance.verified, false), true) AS verified, coalesce(nullif(provenance.content_type, 'other'), 'guide') AS content_type,
    array_to_string(CASE WHEN len(provenance.tags) > 0 THEN provenance.tags ELSE ['above'] END, ',') AS tags FROM {DOC}""")
def overlaid_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """The front matter's fields over those of the directory, defaults not counted."""
    d = _c(spark, sf).documents
    kind = d.schema["provenance"].dataType.simpleString()
    none = F.from_json(F.lit("{}"), kind)
    above = F.from_json(F.lit('{"attribution": "community", "verified": true, "tags": ["above"], "content_type": "guide"}'), kind)
    got = d.select("id", ingest.overlaid(F.coalesce("provenance", none), none, above).alias("p"))
    return got.select("id", "p.attribution", "p.verified", "p.content_type", F.array_join("p.tags", ",").alias("tags"))


# --- batches ---------------------------------------------------------------------------------------

_SIZES = f"c AS (SELECT document_id, chunk_index, greatest(coalesce(token_count, 0), 0) AS t, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, greatest(coalesce(token_count, 0), 0)) AS k FROM {CHUNK})"


def _sizes(c: Corpus) -> DataFrame:
    return c.chunks.select("document_id", "chunk_index", F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0)).alias("token_count"), F.lit(1).alias("one"))


@query(
    "max_fill_groups",
    f"""WITH RECURSIVE {_SIZES}, f AS (SELECT document_id, k, CAST(t AS BIGINT) AS total, 0 AS g FROM c WHERE k = 1
    UNION ALL SELECT c.document_id, c.k, CASE WHEN f.total > 0 AND f.total + c.t > 1000 THEN c.t ELSE f.total + c.t END, CASE WHEN f.total > 0 AND f.total + c.t > 1000 THEN g + 1 ELSE g END FROM f JOIN c ON c.document_id = f.document_id AND c.k = f.k + 1)
    SELECT document_id, CAST(max(g) + 1 AS INT) AS n_groups, count(*) AS n_chunks FROM f GROUP BY 1""",
)
def max_fill_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of at most 1,000 tokens, every document's chunks in order, by a fold in the JVM."""
    g = batching.filled_groups(_c(spark, sf).chunks, 1000)
    return g.groupBy("document_id").agg((F.max("group_no") + 1).alias("n_groups"), F.count("*").alias("n_chunks"))


_CUT = "f.total > 0 AND (f.total + x.t > 700 OR (f.g < f.n - 1 AND f.total >= f.share))"


@query(
    "context_groups",
    f"""WITH RECURSIVE {_SIZES}, x AS (SELECT document_id, chunk_index, k, least(t, 700) AS t FROM c),
    m AS (SELECT document_id, k, CAST(t AS BIGINT) AS total, 0 AS g FROM x WHERE k = 1 UNION ALL
        SELECT x.document_id, x.k, CASE WHEN m.total > 0 AND m.total + x.t > 700 THEN x.t ELSE m.total + x.t END, CASE WHEN m.total > 0 AND m.total + x.t > 700 THEN g + 1 ELSE g END FROM m JOIN x ON x.document_id = m.document_id AND x.k = m.k + 1),
    n AS (SELECT document_id, max(g) + 1 AS n FROM m GROUP BY 1), s AS (SELECT document_id, CAST(sum(t) AS BIGINT) AS whole FROM x GROUP BY 1),
    f AS (SELECT x.document_id, x.k, CAST(x.t AS BIGINT) AS total, 0 AS g, n.n, s.whole AS remaining, CAST(ceil(s.whole / n.n) AS BIGINT) AS share FROM x JOIN n USING (document_id) JOIN s USING (document_id) WHERE x.k = 1 UNION ALL
        SELECT x.document_id, x.k, CASE WHEN {_CUT} THEN x.t ELSE f.total + x.t END, CASE WHEN {_CUT} THEN g + 1 ELSE g END, f.n, CASE WHEN {_CUT} THEN remaining - f.total ELSE remaining END,
        CASE WHEN {_CUT} AND f.g + 1 < f.n THEN CAST(ceil((remaining - f.total) / (f.n - f.g - 1)) AS BIGINT) ELSE share END FROM f JOIN x ON x.document_id = f.document_id AND x.k = f.k + 1),
    e AS (SELECT document_id, max(g) + 1 = max(n) AS even FROM f GROUP BY 1)
    SELECT x.document_id, x.chunk_index, CAST(CASE WHEN e.even THEN f.g ELSE m.g END AS INT) AS group_no FROM x JOIN f USING (document_id, k) JOIN m USING (document_id, k) JOIN e USING (document_id)""",
)
def context_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced groups of at most 700 tokens of every document's chunks."""
    return batching.context_groups(_c(spark, sf).chunks, 700)


@query(
    "embedding_batches",
    f"""WITH RECURSIVE {_SIZES}, f AS (SELECT document_id, chunk_index, k, 1 AS texts, CAST(t AS BIGINT) AS total, 0 AS g FROM c WHERE k = 1
    UNION ALL SELECT c.document_id, c.chunk_index, c.k, CASE WHEN texts + 1 > 3 OR total + c.t > 900 THEN 1 ELSE texts + 1 END, CASE WHEN texts + 1 > 3 OR total + c.t > 900 THEN c.t ELSE total + c.t END, CASE WHEN texts + 1 > 3 OR total + c.t > 900 THEN g + 1 ELSE g END FROM f JOIN c ON c.document_id = f.document_id AND c.k = f.k + 1)
    SELECT document_id, chunk_index, CAST(g AS INT) AS batch FROM f""",
)
def embedding_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of at most three texts and 900 tokens."""
    return batching.capped_batches(_sizes(_c(spark, sf)), "document_id", "chunk_index", ["one", "token_count"], (3, 900))


@query(
    "halved_batches",
    f"""WITH RECURSIVE {_SIZES}, p AS (SELECT document_id, list_prepend(0, list(s ORDER BY k)) AS p, count(*) AS n FROM (SELECT document_id, k, CAST(sum(t) OVER (PARTITION BY document_id ORDER BY k) AS BIGINT) AS s FROM c) GROUP BY 1),
    h AS (SELECT document_id, p, CAST(0 AS BIGINT) AS a, n AS b FROM p UNION ALL SELECT document_id, p, CASE side WHEN 0 THEN a ELSE (a + b) // 2 END, CASE side WHEN 0 THEN (a + b) // 2 ELSE b END FROM h, (VALUES (0), (1)) v(side) WHERE b - a > 1 AND p[b + 1] - p[a + 1] > 600),
    l AS (SELECT document_id, a, b, row_number() OVER (PARTITION BY document_id ORDER BY a) - 1 AS g FROM h WHERE b - a <= 1 OR p[b + 1] - p[a + 1] <= 600)
    SELECT c.document_id, c.chunk_index, CAST(l.g AS INT) AS batch FROM c JOIN l ON l.document_id = c.document_id AND c.k > l.a AND c.k <= l.b""",
)
def halved_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A document's chunks halved until each part is within 600 tokens."""
    return batching.halved_batches(_sizes(_c(spark, sf)), "document_id", "chunk_index", "token_count", 600)


@query("regrouped_vectors", f"WITH d AS (SELECT document_id, list(chunk_index ORDER BY chunk_index, id) AS a, count(*) AS n FROM {CHUNK} GROUP BY 1) SELECT document_id, CAST(k AS INT) AS group_no, CASE k WHEN 0 THEN a[1:1] ELSE a[2:] END AS members FROM d, (VALUES (0), (1)) v(k)")
def regrouped_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Flat values cut by sizes: the first, and the rest."""
    d = _c(spark, sf).chunks.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id"))), lambda x: x["chunk_index"]).alias("a"))
    g = d.select("document_id", F.posexplode(batching.regrouped(F.array(F.lit(1), F.size("a") - 1), F.col("a"))).alias("group_no", "members"))
    return g.select("document_id", "group_no", "members")


# --- limits ----------------------------------------------------------------------------------------

_EV = "ev AS (SELECT CAST(user_id AS VARCHAR) AS subject, event_id, ts, CAST(round(value * 100) AS BIGINT) AS tokens, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"


@query(
    "usage_replay",
    f"""WITH {_EV}, u AS (SELECT e.subject, e.event_id, CAST(sum(p.tokens) FILTER (p.s // 60 > e.s // 60 - 60) AS BIGINT) AS h, CAST(sum(p.tokens) FILTER (p.s // 3600 > e.s // 3600 - 24) AS BIGINT) AS d
        FROM ev e JOIN ev p ON p.subject = e.subject AND (p.ts < e.ts OR (p.ts = e.ts AND p.event_id <= e.event_id)) GROUP BY 1, 2)
    SELECT subject, event_id, greatest(2000 - h, 0) AS hour_left, greatest(5000 - d, 0) AS day_left FROM u""",
)
def usage_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Every event charged in turn: what each subject may still take."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("subject"), "event_id", "ts", F.lit("charge").alias("op"), F.lit(0).alias("number"), F.round(F.col("value") * 100).cast("bigint").alias("tokens"))
    return usage.replayed(e, 2000, 5000).select("subject", "event_id", "hour_left", "day_left")


@query(
    "bucket_replay",
    """WITH RECURSIVE ev AS (SELECT CAST(user_id AS VARCHAR) AS subject, event_id, epoch(ts) AS s, CAST(1 + event_id % 3 AS DOUBLE) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    b AS (SELECT subject, k, event_id, cost <= 2.0 AS allowed, CASE WHEN cost <= 2.0 THEN 2.0 - cost ELSE CAST(2.0 AS DOUBLE) END AS tokens, s FROM ev WHERE k = 1
    UNION ALL SELECT e.subject, e.k, e.event_id, least(b.tokens + greatest(0.0, e.s - b.s) * 2.0, 2.0) >= e.cost, CASE WHEN least(b.tokens + greatest(0.0, e.s - b.s) * 2.0, 2.0) >= e.cost THEN least(b.tokens + greatest(0.0, e.s - b.s) * 2.0, 2.0) - e.cost ELSE least(b.tokens + greatest(0.0, e.s - b.s) * 2.0, 2.0) END, e.s
        FROM b JOIN ev e ON e.subject = b.subject AND e.k = b.k + 1)
    SELECT subject, event_id, allowed, CAST(floor(tokens) AS INT) AS remaining FROM b""",
)
def bucket_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Every event past a bucket of two tokens a second."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("subject"), "event_id", "ts", (1 + F.col("event_id") % 3).cast("double").alias("cost"))
    return limits.replayed_buckets(e, 2.0).select("subject", "event_id", "allowed", "remaining")


@query("live_overrides", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 3 = 0 OR CAST(o_orderdate AS TIMESTAMP) + INTERVAL 400 DAY > TIMESTAMP '1997-01-01'")
def live_overrides(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 400 DAYS")).alias("expires_at"))
    return quota.live(o, "1997-01-01 00:00:00").select("id")


@query("user_overrides", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'o' || o_custkey END AS override_id FROM orders")
def user_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth customer has an override by user; others have one that names another kind."""
    c = table(spark, sf, "customer").where("c_custkey % 5 = 0")
    o = c.select(F.concat(F.lit("o"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 0, "user").otherwise("ip").alias("subject_kind"), F.col("c_custkey").cast("string").alias("subject"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    r = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return quota.by_user(r, o).select("o_orderkey", "override_id")


@query("tiers", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 7 = 0 THEN 5 WHEN c_custkey % 5 = 0 THEN 1000 WHEN c_custkey % 3 = 0 THEN 60 ELSE 10 END AS INT) AS rate FROM customer")
def tiers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k, quota.tier(F.when(k % 7 == 0, 5), k % 5 == 0, k % 3 == 0).alias("rate"))


@query("kept_snapshots", "WITH m AS (SELECT CAST(user_id AS VARCHAR) AS subject, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour_epoch, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS tokens FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2) SELECT * FROM m WHERE hour_epoch > (SELECT max(hour_epoch) FROM m) - 25")
def kept_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly snapshots of the last 25 hours of the stream."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("subject"), "ts", F.round(F.col("value") * 100).cast("bigint").alias("tokens"))
    s = quota.snapshots(e)
    return quota.pruned(s, s.agg(F.max("hour_epoch").alias("h")).first().h)


# --- results ---------------------------------------------------------------------------------------

_RESULTS = f"SELECT c.id, c.content, c.symbol_path, c.token_count, d.source_path, d.provenance FROM {CHUNK} c JOIN {DOC} d ON d.id = c.document_id"


def _results(c: Corpus) -> DataFrame:
    d = c.documents.select(F.col("id").alias("document_id"), "source_path", "provenance")
    return c.wide_chunks.select("id", "document_id", "content", "symbol_path", "token_count").join(d, "document_id")


@query("brief_results", f"WITH r AS ({_RESULTS}) SELECT id, concat_ws(' > ', source_path, array_to_string(list_transform(symbol_path, lambda s: s.name), ' > ')) AS breadcrumb, CASE WHEN length(content) > 150 THEN left(content, 150) || '…' ELSE content END AS snippet FROM r")
def brief_results(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.brief(_results(_c(spark, sf)))


@query(
    "guarded_results",
    f"""WITH r AS ({_RESULTS}), g AS (SELECT id, coalesce(provenance.attribution, 'unknown') AS a, coalesce(provenance.verified, false) AS v, token_count % 10 = 0 AS flagged, content, '<untrusted-n1>' || chr(10) || regexp_replace(content, '(?i)<(/?)untrusted', '&lt;\\1untrusted', 'g') || chr(10) || '</untrusted-n1>' AS w FROM r)
    SELECT 'low' AS level, id, sha256(CASE WHEN NOT v AND a IN ('third_party', 'community', 'unknown') THEN w ELSE content END) AS h FROM g UNION ALL SELECT 'moderate', id, sha256(CASE WHEN NOT v THEN w ELSE content END) FROM g
    UNION ALL SELECT 'high', id, sha256(CASE WHEN v AND a = 'foundation' THEN content ELSE w END) FROM g UNION ALL SELECT 'strict', id, sha256(w) FROM g WHERE NOT coalesce(flagged, false) UNION ALL SELECT 'disabled', id, sha256(content) FROM g""",
)
def guarded_results(spark: SparkSession, sf: str) -> DataFrame:
    """Content marked by its origin under every level; flagged rows leave under the strict one."""
    r = _results(_c(spark, sf)).select("id", "content", F.col("provenance.attribution").alias("attribution"), F.col("provenance.verified").alias("verified"), F.coalesce(F.col("token_count") % 10 == 0, F.lit(False)).alias("flagged"))
    out = None
    for level in ("disabled", "low", "moderate", "high", "strict"):
        part = rerank.guarded(r, level, "n1").select(F.lit(level).alias("level"), "id", F.sha2("content", 256).alias("h"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "reranked_results",
    f"""WITH d AS (SELECT id, char_count, token_count, CAST(row_number() OVER (ORDER BY id) AS INT) AS rank FROM {DOC} QUALIFY rank <= 100),
    r AS (SELECT id, rank, (rank % 7) / 10.0 AS trust, CASE WHEN token_count IS NULL THEN 0.5 ELSE least((char_count % 120) / 100.0, 1) END AS relevance FROM d),
    c AS (SELECT id, rank, round(pow(CAST(trust AS DOUBLE), 0.55) * pow(CAST(relevance AS DOUBLE), 0.45), 9) AS confidence FROM r)
    SELECT id, confidence, CAST(row_number() OVER (ORDER BY confidence DESC, rank, id) AS INT) AS place FROM c QUALIFY place <= 20""",
)
def reranked_results(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a hundred results with rerank scores: twenty by the confidence that follows."""
    top = _c(spark, sf).documents.select("id", "char_count", "token_count").orderBy("id").limit(100)
    w = F.row_number().over(search.Window.orderBy("id"))
    r = top.withColumn("rank", w).withColumn("trust", ((F.col("rank") % 7) / 10.0)).withColumn("relevance", F.lit(0.5)).withColumn("confidence", F.lit(0.0))
    scores = top.where("token_count IS NOT NULL").select("id", ((F.col("char_count") % 120) / 100.0).alias("rerank_score"))
    return rerank.with_scores(r, scores).select("id", "confidence", "place")
