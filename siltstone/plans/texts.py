"""Queries on text, path, score, version and filter functions, and on a whole search request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import injection, scoring, text
from siltstone.functions.versions import best_outcomes, classify_udf, keeps
from siltstone.model import Corpus
from siltstone.operators import analytics, facets, overlap, rerank, search
from siltstone.plans.contracts import _UTF8
from siltstone.plans.corpus import LIVE_DOC, PATH
from siltstone.plans.retrieval import _SCORE, AS_OF, CHUNK, DIM, DOC, JOINED, _any_word, _terms_sql
from siltstone.queries import query
from siltstone.session import table
from siltstone.sources import files, packages


def _c(spark: SparkSession, sf: str) -> Corpus:
    return Corpus(spark, sf)


def _files(spark: SparkSession, sf: str, utf8: bool = False) -> DataFrame:
    f = table(spark, sf, "source_file")
    return f.where(text.is_utf8(F.col("content"))) if utf8 else f


# --- files and paths -------------------------------------------------------------------------------


@query("binary_files", "SELECT source_version_id, path, regexp_matches(hex(content[1:8192]), '^(..)*?00') AS is_binary FROM source_file WHERE content IS NOT NULL")
def binary_files(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).where("content IS NOT NULL").select("source_version_id", "path", text.looks_binary(F.col("content")).alias("is_binary"))


_LADDER = r"""NOT regexp_matches(p, '(^|/)(\.git|node_modules|target|vendor|dist|build|out|coverage|managed|__snapshots__)(/|$)')
    AND NOT regexp_full_match(b, '.*\.min\.js|.*\.bundle\.js|.*_pb\.ts|.*_pb\.js|.*\.pb\.go|package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml|CODE_OF_CONDUCT\.md|CONTRIBUTING\.md|SECURITY\.md') AND NOT regexp_full_match(b, '(?i)(LICEN[SC]E|COPYING|NOTICE|PATENTS)([-.].*)?')"""
_PB = f"SELECT *, {PATH.format('path')} AS p, regexp_extract({PATH.format('path')}, '([^/]*)$', 1) AS b FROM source_file"


@query("allowed_paths", rf"SELECT DISTINCT p AS path FROM ({_PB}) WHERE {_LADDER} AND NOT regexp_matches(p, '^(.*/)?tests/.*$') AND (p LIKE '%.rs' OR p LIKE '%.md')")
def allowed_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The filter ladder with an include of two globs and an exclude."""
    p = _files(spark, sf).select(text.clean_path(F.col("path")).alias("path")).distinct()
    return p.where(text.path_allowed(F.col("path"), ["**/*.rs", "*.md"], ["**/tests/**"]))


_KNOWN = "(md|mdx|rs|ts|tsx|js|jsx|mjs|cjs|compact|txt|json|yaml|yml|toml|py|pyi|go|sol|sh|bash|scm|ss|sld|java|swift|rb|kt|kts|cs|hs|html|htm|xml|csproj|nuspec|plist)"
_CODE = "(rs|ts|tsx|js|jsx|mjs|cjs|compact|json|yaml|yml|toml|py|pyi|go|sol|sh|bash|scm|ss|sld|java|swift|rb|kt|kts|cs|hs|html|htm|xml|csproj|nuspec|plist)"


@query(
    "scan_skips",
    rf"""WITH s AS (SELECT *, lower(regexp_extract(b, '^.+\.([^.]+)$', 1)) AS e, try(decode(content)) AS t FROM ({_PB}) WHERE {_LADDER}), k AS (SELECT * FROM s WHERE regexp_full_match(e, '{_KNOWN}')),
    r AS (SELECT CASE WHEN content IS NULL THEN 'not_regular_file' WHEN length > 1048576 THEN 'too_large' WHEN regexp_matches(hex(content[1:8192]), '^(..)*?00') THEN 'binary' WHEN t IS NULL THEN 'not_utf8'
        WHEN list_max(list_transform(string_split(t, chr(10)), lambda x: strlen(x))) > 2000 THEN 'long_line'
        WHEN regexp_full_match(e, '{_CODE}') AND NOT b LIKE '%.d.ts' AND regexp_matches(array_to_string(string_split(t, chr(10))[1:10], chr(10)), '(?i)(@generated|DO NOT EDIT|Code generated by|Auto-?generated( by)?)') THEN 'generated_file'
        WHEN trim(regexp_replace(t, '\s+', ' ', 'g')) = '' THEN 'empty_no_chunks' END AS skip_reason FROM k)
    SELECT skip_reason, count(*) AS n_files FROM r WHERE skip_reason IS NOT NULL GROUP BY 1""",
)
def scan_skips(spark: SparkSession, sf: str) -> DataFrame:
    return files.skipped(files.scan(_files(spark, sf), max_line_bytes=2000))


@query("generated_files", rf"SELECT source_version_id, path FROM source_file WHERE {_UTF8} AND regexp_matches(array_to_string(string_split(decode(content), chr(10))[1:10], chr(10)), '(?i)(@generated|DO NOT EDIT|Code generated by|Auto-?generated( by)?)')")
def generated_files(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf, True).where(text.looks_generated(F.col("content").cast("string"))).select("source_version_id", "path")


@query("spdx_tags", rf"SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(decode(content), '(?im)^[ \t\r\f\v]*(?:(?://|#|\*|/\*|--|;)[ \t\r\f\v]*)?SPDX-License-Identifier:[ \t\r\f\v]*(\S[^\r\n]*?)[ \t\r\f\v]*(?:\*/)?[ \t\r\f\v]*$', 1))) AS tag FROM source_file WHERE {_UTF8}) GROUP BY 1")
def spdx_tags(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf, True).select("path", F.explode(text.spdx_tags(F.col("content").cast("string"))).alias("tag"))
    return f.groupBy("tag").agg(F.count("*").alias("n"))


_UNIX = "replace(regexp_replace(decode(content), '^\\x{FEFF}', ''), chr(13) || chr(10), chr(10))"


@query("front_matter_files", rf"SELECT source_version_id, path, regexp_extract(u, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)', 1) AS fm, strlen(regexp_replace(u, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)', '')) AS n_body FROM (SELECT *, {_UNIX} AS u FROM source_file WHERE {_UTF8} AND regexp_matches(path, '\.mdx?$')) WHERE regexp_matches(u, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)')")
def front_matter_files(spark: SparkSession, sf: str) -> DataFrame:
    body = F.col("content").cast("string")
    f = _files(spark, sf, True).where(F.col("path").rlike(r"\.mdx?$")).select("source_version_id", "path", text.front_matter(body).alias("fm"), F.octet_length(text.body_after_front_matter(body)).cast("bigint").alias("n_body"))
    return f.where("fm IS NOT NULL")


@query("hash_inputs", rf"SELECT source_version_id, path, sha256(CASE WHEN regexp_matches(u, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)') THEN regexp_extract(u, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)', 1) ELSE '' END || chr(0) || regexp_replace(u, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)', '')) AS h FROM (SELECT *, {_UNIX} AS u FROM source_file WHERE {_UTF8} AND regexp_matches(path, '\.mdx?$'))")
def hash_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Verbatim front matter, NUL, body: what a document hash covers."""
    body = F.col("content").cast("string")
    return _files(spark, sf, True).where(F.col("path").rlike(r"\.mdx?$")).select("source_version_id", "path", F.sha2(text.hash_input(text.front_matter(body), text.body_after_front_matter(body)), 256).alias("h"))


@query("page_urls", "SELECT DISTINCT published_url AS url, regexp_extract(published_url, '^([a-z]+://[^/]+)', 1) || '/robots.txt' AS robots, regexp_matches(lower(regexp_replace(published_url, '[?#].*$', '')), '(\\.xml|\\.xml\\.gz)$|sitemap') AS is_sitemap, regexp_replace(published_url, '[^/]*$', '') || regexp_replace(regexp_extract(source_path, '([^/]*)$', 1), '\\.[^.]*$', '') || '/' AS composed FROM new_document WHERE regexp_matches(published_url, '^[a-z]+://[^/]+/') AND NOT contains(source_path, '\\')")
def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "new_document").where(F.col("published_url").rlike("^[a-z]+://[^/]+/") & ~F.contains("source_path", F.lit("\\")))
    u = F.col("published_url")
    return d.select(u.alias("url"), text.robots_url(u).alias("robots"), text.looks_like_sitemap(u).alias("is_sitemap"), text.composed_url(F.regexp_replace(u, "[^/]*$", ""), F.col("source_path")).alias("composed")).distinct()


_EXTENSIONS = [("md", "markdown"), ("mdx", "markdown"), ("rs", "rust"), ("ts", "typescript"), ("tsx", "typescript"), ("js", "javascript"), ("jsx", "javascript"), ("mjs", "javascript"), ("cjs", "javascript"), ("compact", "compact"), ("txt", "plaintext"), ("json", "json"), ("yaml", "yaml"), ("yml", "yaml"), ("toml", "toml"), ("py", "python"), ("pyi", "python"), ("go", "go"), ("sol", "solidity"), ("sh", "bash"), ("bash", "bash"), ("scm", "scheme"), ("ss", "scheme"), ("sld", "scheme"), ("java", "java"), ("swift", "swift"), ("rb", "ruby"), ("kt", "kotlin"), ("kts", "kotlin"), ("cs", "csharp"), ("hs", "haskell"), ("html", "html"), ("htm", "html"), ("xml", "xml"), ("csproj", "xml"), ("nuspec", "xml"), ("plist", "xml")]


@query("extension_languages", "WITH e(e, l) AS (VALUES " + ", ".join(map(str, _EXTENSIONS)) + ") SELECT DISTINCT c_custkey, l AS language, CASE WHEN l IN ('markdown', 'plaintext', 'json') THEN 'other' ELSE l END AS chunker, CASE WHEN l = 'markdown' THEN 'markdown' WHEN l = 'plaintext' THEN 'plaintext' ELSE 'code' END AS kind FROM customer, e WHERE e.e = list_extract((SELECT list(e) FROM e), 1 + CAST(c_custkey % 37 AS INT))")
def extension_languages(spark: SparkSession, sf: str) -> DataFrame:
    """A path of every known extension, by turns, in either case."""
    e = F.element_at(F.array(*[F.lit(x) for x, _ in _EXTENSIONS]), (F.col("c_custkey") % 37 + 1).cast("int"))
    p = F.concat(F.lit("a.b/Name"), F.col("c_custkey"), F.lit("."), F.when(F.col("c_custkey") % 2 == 0, F.upper(e)).otherwise(e))
    return table(spark, sf, "customer").select("c_custkey", text.language_of(p).alias("language"), text.chunker_language(p).alias("chunker"), text.kind_of(p).alias("kind"))


@query("shebangs", "SELECT p_partkey, [NULL, 'bash', 'bash', 'python', 'javascript', NULL][1 + CAST(p_partkey % 6 AS INT)] AS language FROM part")
def shebangs(spark: SparkSession, sf: str) -> DataFrame:
    """First lines by turns before the part's name."""
    heads = F.array(*map(F.lit, ["plain\n", "#!/bin/bash\n", "#!/bin/sh\n", "#!/usr/bin/env python3\n", "#!/usr/bin/env node\n", "#!/usr/bin/perl\n"]))
    return table(spark, sf, "part").select("p_partkey", text.shebang_language(F.concat(F.element_at(heads, (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_name"))).alias("language"))


@query("line_marks", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, count(*) FILTER (regexp_matches(rtrim(x, ' '), '(;|["''])\s*;?$')) AS n_ends, count(*) FILTER (length(x) > 9 AND length(regexp_replace(left(x, 9), '[^`]', '', 'g')) % 2 = 1) AS n_ticks, CAST(sum(length(trim(regexp_replace(trim(x, ' '), '^\*', ''), ' '))) AS BIGINT) AS n_clean, CAST(sum(length(regexp_replace(x, '(\*{5,}|-{5,}|={5,}|#{5,}|_{5,}|~{5,}|/{5,})', '', 'g'))) AS BIGINT) AS n_plain
    FROM l WHERE regexp_full_match(x, '[\x20-\x7e]*') AND NOT regexp_matches(x, '[!-"$-)+,.:-<>-@\[-^`{-}]{5,}') GROUP BY 1""")
def line_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of ASCII text: statement ends, positions in inline code, comment stars, decorative runs."""
    x = F.col("x")
    lines = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("x")).where(x.rlike(r"\A[\x20-\x7e]*\z") & ~x.rlike(r'[!-"$-)+,.:-<>-@\[-^`{-}]{5,}'))
    return lines.groupBy("doc_id").agg(F.count_if(text.esm_ends(x)).alias("n_ends"), F.count_if((F.length(x) > 9) & text.in_inline_code(x, F.lit(9))).alias("n_ticks"), F.sum(F.length(text.cleaned_block_line(x))).alias("n_clean"), F.sum(F.length(text.without_runs(x))).alias("n_plain"))


@query("model_ids", "SELECT name || '@' || revision AS wire, name, CAST(revision AS INT) AS revision FROM embedding_model UNION ALL SELECT name || '@0', NULL, NULL FROM embedding_model UNION ALL SELECT name, NULL, NULL FROM embedding_model")
def model_ids(spark: SparkSession, sf: str) -> DataFrame:
    m = _c(spark, sf).models
    wires = m.select(F.concat_ws("@", "name", "revision").alias("wire")).unionByName(m.select(F.concat("name", F.lit("@0")).alias("wire"))).unionByName(m.select(F.col("name").alias("wire")))
    w = F.col("wire")
    return wires.select("wire", text.model_name(w).alias("name"), text.model_revision(w).alias("revision"))


@query("license_expressions", r"SELECT id, l AS entry, regexp_full_match(l, '\s*\(*[A-Za-z0-9.+-]+\)*(\s+(AND|OR|WITH)\s+\(*[A-Za-z0-9.+-]+\)*)*\s*') AND length(regexp_replace(l, '[^(]', '', 'g')) = length(regexp_replace(l, '[^)]', '', 'g')) AS valid FROM (SELECT id, unnest(license) AS l FROM " + DOC + ") WHERE l IS NOT NULL")
def license_expressions(spark: SparkSession, sf: str) -> DataFrame:
    d = _c(spark, sf).documents.select("id", F.explode("license").alias("entry")).where("entry IS NOT NULL")
    return d.select("id", "entry", text.valid_license_expression(F.col("entry")).alias("valid"))


@query("compact_modules", rf"""WITH f AS (SELECT source_version_id, path, decode(content) AS t FROM source_file WHERE {_UTF8} AND path LIKE '%.compact'), m AS (SELECT *, regexp_extract_all(t, '(?m)^(?:export\s+)?module\s+([A-Za-z_]\w*)', 1) AS ms, trim(regexp_extract(t, '(?m)^\s*pragma\s+language_version\s+([^;]+);', 1), ' ') AS v FROM f)
    SELECT source_version_id, path, CASE WHEN len(ms) = 1 THEN ms[1] END AS module, nullif(regexp_replace(regexp_replace(v, '\s*&&\s*', ', ', 'g'), '([<>=])\s+(\d)', '\1\2', 'g'), '') AS version FROM m""")
def compact_modules(spark: SparkSession, sf: str) -> DataFrame:
    body = F.col("content").cast("string")
    return _files(spark, sf, True).where(F.col("path").endswith(".compact")).select("source_version_id", "path", packages.module_package(body).alias("module"), packages.language_version(body).alias("version"))


# --- scores and estimates --------------------------------------------------------------------------


@query("score_functions", """SELECT event_id, CASE WHEN isnan(x) OR isinf(x) THEN 0.0 ELSE least(greatest(x, 0.0), 1.0) END AS unit, CAST(CASE m WHEN 'satisfies' THEN 1.15 WHEN 'near_miss_patch' THEN greatest(1 - 0.05 * d, 0.3) WHEN 'near_miss_minor' THEN greatest(1 - 0.15 * d, 0.3) WHEN 'breaking' THEN 0.3 ELSE 1.0 END AS DOUBLE) AS multiplier,
    CAST(CASE WHEN event_id % 2 = 0 THEN ceil(t / 2.0) ELSE t END AS BIGINT) AS billed, CASE WHEN m = 'satisfies' THEN 'satisfies go' WHEN m LIKE 'near_miss%' THEN 'near-miss (off by ' || d || ')' WHEN m = 'silent' THEN 'no version declared' ELSE 'version unknown' END AS fit
    FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 13 = 0 THEN CAST('inf' AS DOUBLE) ELSE value / 20 - 0.5 END AS x, ['satisfies', 'near_miss_patch', 'near_miss_minor', 'breaking', 'unknown', 'silent'][1 + CAST(event_id % 6 AS INT)] AS m, event_id % 9 AS d, CAST(round(value * 100) AS BIGINT) AS t FROM events WHERE value IS NOT NULL)""")
def score_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Clamping, version multipliers, billed tokens and fit labels over made-up arguments."""
    i = F.col("event_id")
    m = F.element_at(F.array(*map(F.lit, ["satisfies", "near_miss_patch", "near_miss_minor", "breaking", "unknown", "silent"])), (i % 6 + 1).cast("int"))
    x = F.when(i % 11 == 0, F.lit(float("nan"))).when(i % 13 == 0, F.lit(float("inf"))).otherwise(F.col("value") / 20 - 0.5)
    e = table(spark, sf, "events").where("value IS NOT NULL").select("event_id", m.alias("m"), x.alias("x"), (i % 9).alias("d"), F.round(F.col("value") * 100).cast("bigint").alias("t"))
    return e.select("event_id", scoring.clamp_unit(F.col("x")).alias("unit"), scoring.version_multiplier(F.col("m"), F.col("d")).alias("multiplier"), scoring.billed_tokens(F.col("t"), i % 2 == 0).alias("billed"), scoring.version_fit_label(F.col("m"), F.col("d"), F.lit("go")).alias("fit"))


@query("unit_vectors", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e) SELECT vec_id, round(CASE WHEN n > 0 THEN v[1] / n ELSE v[1] END, 9) AS first, round(CASE WHEN n > 0 THEN v[-1] / n ELSE v[-1] END, 9) AS last FROM n")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", scoring.l2_normalised(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.round(F.element_at("u", 1), 9).alias("first"), F.round(F.element_at("u", -1), 9).alias("last"))


@query("rerank_costs", f"SELECT document_id, CAST(greatest(ceil(11 / 4.0) * count(*) + sum(ceil(strlen(content) / 4.0)), 1) AS BIGINT) AS tokens FROM {CHUNK} WHERE content IS NOT NULL GROUP BY 1")
def rerank_costs(spark: SparkSession, sf: str) -> DataFrame:
    """What a rerank of each document's chunks costs for a query of eleven bytes."""
    d = _c(spark, sf).wide_chunks.where("content IS NOT NULL").groupBy("document_id").agg(F.collect_list("content").alias("texts"))
    return d.select("document_id", scoring.rerank_tokens(F.lit("some query!"), F.col("texts")).cast("bigint").alias("tokens"))


@query("rerank_queries", "SELECT pair_id, CASE WHEN trim(coalesce(client, '')) = '' THEN coalesce(text, '') ELSE concat_ws(chr(10) || 'Instructions: ', text, trim(client)) END AS q FROM (SELECT DISTINCT ON (pair_id) * FROM query_pair)")
def rerank_queries(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "query_pair").dropDuplicates(["pair_id"])
    return q.select("pair_id", text.rerank_query(F.col("text"), F.col("client")).alias("q"))


@query("injection_probabilities", f"""WITH w AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, CAST(least(n, 2000) AS DOUBLE) / 2000 AS p, doc_id % 5 = 0 AS bad FROM w)
    SELECT doc_id, round(CASE WHEN bad THEN p ELSE 1 - p END, 9) AS probability, CASE WHEN round(CASE WHEN bad THEN p ELSE 1 - p END, 9) / 2 + 0.35 >= 0.85 THEN 'reject' ELSE 'accept' END AS verdict FROM p WHERE NOT bad OR p > 0 UNION ALL SELECT doc_id, 0.0, 'accept' FROM p WHERE bad AND p = 0""")
def injection_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of a text with made-up classifier labels: the largest probability, blended and judged."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    w = d.select("doc_id", F.explode(text.char_windows(F.col("text"))).alias("w"))
    share = F.length("w") / F.lit(2000.0)
    bad, good = (F.array(F.struct(F.lit(x).alias("label"), share.alias("score"))) for x in ("INJECTION", "SAFE"))
    windows = w.select(F.col("doc_id").alias("id"), injection.malicious_probability(F.when(F.col("doc_id") % 5 == 0, bad).otherwise(good)).alias("probability"), (F.col("doc_id") % 5 == 0).alias("bad"), F.length("w").alias("n"))
    # of harmless windows the fullest counts here
    full = windows.where("bad OR n = 2000").unionByName(windows.join(windows.groupBy("id").agg(F.max("n").alias("m")).where("m < 2000").select("id"), "id", "left_semi").where("NOT bad"))
    top = injection.document_probability(full.distinct().select("id", "probability"))
    p = F.round("probability", 9)
    return top.select(F.col("id").alias("doc_id"), p.alias("probability"), injection.verdict(injection.blend(F.lit(0.7), p)).alias("verdict"))


@query("gated_documents", f"SELECT coalesce(provenance.attribution, 'unknown') AS attribution, count(*) AS n FROM {DOC} WHERE coalesce(provenance.attribution, 'unknown') IN ('third_party', 'community', 'unknown') GROUP BY 1")
def gated_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the costlier model pass reads."""
    a = F.col("provenance.attribution")
    return _c(spark, sf).documents.where(injection.model_gated(a)).groupBy(F.coalesce(a, F.lit("unknown")).alias("attribution")).agg(F.count("*").alias("n"))


# --- versions --------------------------------------------------------------------------------------

_FITS = """f(requested, declared, match, distance) AS (VALUES ('1.2.0', '^1.2', 'satisfies', 0), ('1.2.0', '>=0.20', 'satisfies', 0), ('1.2.0', '~3.1', 'breaking', 0), ('1.1.9', '^1.2', 'near_miss_minor', 1), ('1.1.9', '>=0.20', 'satisfies', 0), ('1.1.9', '~3.1', 'breaking', 0),
    ('0.19.4', '^1.2', 'breaking', 0), ('0.19.4', '>=0.20', 'breaking', 0), ('0.19.4', '~3.1', 'breaking', 0), ('3.0.2', '^1.2', 'breaking', 0), ('3.0.2', '>=0.20', 'satisfies', 0), ('3.0.2', '~3.1', 'near_miss_minor', 1), ('3.5', '^1.2', 'breaking', 0), ('3.5', '>=0.20', 'satisfies', 0), ('3.5', '~3.1', 'near_miss_minor', 4),
    ('>=2, <3', '^1.2', 'breaking', 0), ('>=2, <3', '>=0.20', 'satisfies', 0), ('>=2, <3', '~3.1', 'breaking', 0), ('<3.1', '^1.2', 'satisfies', 0), ('<3.1', '>=0.20', 'satisfies', 0), ('<3.1', '~3.1', 'near_miss_minor', 1), ('0.x', '^1.2', 'breaking', 0), ('0.x', '>=0.20', 'satisfies', 0), ('0.x', '~3.1', 'breaking', 0))"""
_REQUESTS = ("1.2.0", "1.1.9", "0.19.4", "3.0.2", "3.5", ">=2, <3", "<3.1", "0.x")
_DECLARED = f"d AS (SELECT t.version_constraint AS declared, count(*) AS n FROM (SELECT unnest(provenance.language_targets) AS t FROM {DOC}) GROUP BY 1)"


@query("semver_class", f"WITH {_FITS}, {_DECLARED} SELECT f.requested, d.declared, n, f.match, CAST(f.distance AS BIGINT) AS distance FROM d JOIN f ON f.declared = d.declared UNION ALL SELECT DISTINCT f.requested, NULL, n, 'satisfies', 0 FROM d, f WHERE d.declared IS NULL")
def semver_class(spark: SparkSession, sf: str) -> DataFrame:
    """How each declared constraint of the corpus fits eight requests; the SQL holds what the interval
    rules give by hand."""
    t = _c(spark, sf).documents.select(F.explode("provenance.language_targets").alias("t")).select(F.col("t.version_constraint").alias("declared"))
    n = t.groupBy("declared").agg(F.count("*").alias("n"))
    out = None
    for r in _REQUESTS:
        part = n.withColumn("c", classify_udf(r)("declared")).select(F.lit(r).alias("requested"), "declared", "n", "c.match", "c.distance")
        out = part if out is None else out.unionByName(part)
    return out


@query("version_outcomes", f"""WITH t AS (SELECT id, unnest(provenance.language_targets) AS t FROM {DOC}), m AS (SELECT id, min(CASE WHEN t.version_constraint = '~3.1' THEN 4 ELSE 0 END) AS r FROM t WHERE lower(t.name) = 'typescript' GROUP BY 1)
    SELECT CASE WHEN r IS NULL THEN 'silent' WHEN r = 0 THEN 'satisfies' ELSE 'breaking' END AS match, count(*) AS n, count(*) FILTER (r IS DISTINCT FROM 4) AS n_kept, count(*) FILTER (r = 0) AS n_strict FROM {DOC} d LEFT JOIN m USING (id) GROUP BY 1""")
def version_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by their best fit for a requested language version, and who stays in both modes."""
    d = _c(spark, sf).documents.select("id", "provenance")
    got = best_outcomes(d, F.col("provenance.language_targets"), [{"name": "TypeScript", "version_satisfies": "1.5.0"}])
    return got.groupBy("match").agg(F.count("*").alias("n"), F.count_if(keeps(F.col("match"), "permissive")).alias("n_kept"), F.count_if(keeps(F.col("match"), "strict")).alias("n_strict"))


# --- requests --------------------------------------------------------------------------------------


@query("effective_modes", """SELECT mode, code_mode, CASE WHEN mode NOT IN ('hybrid', 'vector', 'fts') OR code_mode NOT IN ('on', 'off', 'exclusive') THEN 'error' WHEN mode = 'fts' THEN CASE WHEN code_mode IN ('on', 'exclusive') THEN 'error' ELSE 'off' END ELSE coalesce(code_mode, 'on') END AS effective, count(*) AS n
    FROM (SELECT coalesce(mode, 'hybrid') AS mode, code_mode FROM (SELECT DISTINCT ON (pair_id) * FROM query_pair)) GROUP BY ALL""")
def effective_modes(spark: SparkSession, sf: str) -> DataFrame:
    """The mode matrix over all queries asked (a dozen combinations)."""
    q = table(spark, sf, "query_pair").dropDuplicates(["pair_id"]).groupBy(F.coalesce("mode", F.lit("hybrid")).alias("mode"), "code_mode").agg(F.count("*").alias("n"))

    @F.udf("string")
    def effective(mode: str, code_mode: str | None) -> str:
        try:
            if mode not in search.MODES:
                return "error"
            return search.effective_code_mode(mode, code_mode)
        except search.RequestError:
            return "error"

    return q.select("mode", "code_mode", effective("mode", "code_mode").alias("effective"), "n")


@query("facet_from_flags", f"WITH {JOINED} SELECT id FROM j WHERE kind = 'code' AND coalesce(language, '') <> 'go' AND token_count BETWEEN 20 AND 600 AND ingested_at >= TIMESTAMPTZ '2024-02-01 00:00:00+00'")
def facet_from_flags(spark: SparkSession, sf: str) -> DataFrame:
    """A filter from the flags of a command line."""
    f = facets.from_flags(kind=["code"], not_language=["go"], min_tokens=20, max_tokens=600, ingested_at_after="2024-02-01")
    return search.filtered(_c(spark, sf), f).select("id")


_CHECKS: list[tuple[str, dict]] = [
    ("unknown facet", {"nope": {"any_of": ["x"]}}), ("closed set", {"kind": {"any_of": ["film"]}}), ("no bool", {"verified": "yes"}), ("range order", {"token_count": {"min": 5, "max": 1}}), ("date order", {"ingested_at": {"after": "2024-02-01", "before": "2024-01-01"}}),
    ("not negatable", {"language_target": {"none_of": [{"name": "x"}]}}), ("bad version", {"language_target": {"any_of": [{"name": "x", "version_satisfies": "??"}]}}), ("package kind", {"package": {"any_of": [{"kind": "gem", "name": "x"}]}}), ("unknown field", {"tags": {"some_of": ["x"]}}),
    ("fine set", {"kind": {"any_of": ["code"], "none_of": ["markdown"]}}), ("fine range", {"token_count": {"min": 1, "max": 1}}), ("fine version", {"sdk_dependency": {"any_of": [{"kind": "npm", "name": "x", "version_satisfies": "^1.2"}]}}), ("empty", {}),
]


@query("filter_checks", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(n.startswith('fine') or n == 'empty').lower()}, {str(n == 'empty').lower()})" for n, _ in _CHECKS) + ") t(filter, valid, is_empty)")
def filter_checks(spark: SparkSession, sf: str) -> DataFrame:
    def valid(f: dict) -> bool:
        try:
            facets.validate(f)
        except facets.FilterError:
            return False
        return True

    return spark.createDataFrame([(n, valid(f), facets.is_empty(f)) for n, f in _CHECKS], "filter string, valid boolean, is_empty boolean")


@query("relaxed_filters", """SELECT * FROM (VALUES (0, 'source_modified_at', 'language_target,source_modified_at,verified'), (1, 'verified', 'language_target,verified'), (2, 'version_match', 'language_target'), (3, 'version', 'language_target'), (4, 'none', 'language_target')) t(step, loosened, facets)""")
def relaxed_filters(spark: SparkSession, sf: str) -> DataFrame:
    """The ladder of looser requests from one strict filter until nothing is left to loosen."""
    f: dict = {"source_modified_at": {"after": "2024-01-01"}, "verified": True, "language_target": {"any_of": [{"name": "go", "version_satisfies": "^1.2"}]}}
    match, rows = "strict", []
    while step := rerank.relaxed(f, match):
        rows.append((len(rows), step[0], ",".join(sorted(f))))
        f, match = step[1], step[2] or match
    rows.append((len(rows), "none", ",".join(sorted(f))))
    return spark.createDataFrame(rows, "step int, loosened string, facets string")


@query(
    "overview_block",
    f"""WITH {LIVE_DOC}, k AS (SELECT '{{"kind":"' || kind || '","n_sources":' || count(*) || '}}' AS j FROM corpus_source WHERE retired_at IS NULL GROUP BY kind),
    r AS (SELECT source_id, min(CASE coalesce(provenance.attribution, 'unknown') WHEN 'foundation' THEN 0 WHEN 'partner' THEN 1 WHEN 'third_party' THEN 2 WHEN 'community' THEN 3 ELSE 4 END) AS r FROM ld GROUP BY 1),
    a AS (SELECT '{{"attribution":"' || ['foundation', 'partner', 'third_party', 'community', 'unknown'][coalesce(r.r, 4) + 1] || '","n_sources":' || count(*) || '}}' AS j FROM corpus_source c LEFT JOIN r ON r.source_id = c.id WHERE c.retired_at IS NULL GROUP BY coalesce(r.r, 4))
    SELECT 'by_kind' AS section, '[' || string_agg(j, ',' ORDER BY j) || ']' AS payload FROM k UNION ALL SELECT 'by_attribution', '[' || string_agg(j, ',' ORDER BY j) || ']' FROM a""",
)
def overview_block(spark: SparkSession, sf: str) -> DataFrame:
    c = _c(spark, sf)
    return analytics.overview_block({"by_kind": analytics.sources_by_kind(c), "by_attribution": analytics.sources_by_attribution(c)})


@query("trim_overlaps", f"""WITH c AS (SELECT * FROM {CHUNK} WHERE start_byte < end_byte), p AS (SELECT document_id, id, chunk_index, unnest(range(start_byte, end_byte)) AS b FROM c), o AS (SELECT document_id, b, min(chunk_index) AS first FROM p GROUP BY 1, 2),
    k AS (SELECT p.id, count(*) AS kept FROM p JOIN o ON o.document_id = p.document_id AND o.b = p.b AND o.first = p.chunk_index GROUP BY 1)
    SELECT c.document_id, c.id, k.kept < end_byte - start_byte AND strlen(content) = end_byte - start_byte AS trimmed FROM c JOIN k USING (id)""")
def trim_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's chunks in index order as one result list, trimmed."""
    rows = _c(spark, sf).wide_chunks.select(F.lit(0).alias("list"), "document_id", "id", "start_byte", "end_byte", "content", F.col("chunk_index").alias("rank"))
    return overlap.trim_overlaps(rows, ["list"]).select("document_id", "id", "trimmed")


_FIRST = f"SELECT * FROM (SELECT DISTINCT ON (pair_id) * FROM query_pair WHERE pair_id % 20 = 0) WHERE len(vector) = {DIM} AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x))) AND list_bool_or(list_transform(vector, lambda x: x <> 0)) AND len({_terms_sql('text')}) > 0 ORDER BY pair_id LIMIT 1"


_INDEXES: dict[tuple[str, str], search.IndexedCorpus] = {}


def _indexed(spark: SparkSession, sf: str) -> search.IndexedCorpus:
    """The index of a data directory, built once in an application, as a service would after an ingest."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = search.build_index(_c(spark, sf))
    return _INDEXES[key]


def _request(c: Corpus) -> search.Request:
    """The request of the first usable query: any of its words, and its vector."""
    q = c.raw("query_pair").where("pair_id % 20 = 0").where(search.usable(F.col("vector"), DIM)).withColumn("q", _any_word(F.col("text"))).where("q <> ''")
    first = q.orderBy("pair_id").limit(1).select("q", "vector").first()
    return search.Request([search.Query(first.q, list(first.vector), None)], {"deprecated": False}, as_of=AS_OF, stemmed=False, limit=20)


_POOL = f"""WITH {JOINED}, q AS ({_FIRST}), f AS (SELECT * FROM j WHERE NOT coalesce(provenance.deprecation.is_deprecated, false)),
    v AS (SELECT id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.vector AS DOUBLE[])), 9) AS sim FROM f, q WHERE len(embedding) = {DIM}), vr AS (SELECT id, sim, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM v WHERE sim IS NOT NULL QUALIFY rank <= 100),
    w AS (SELECT list_distinct({_terms_sql('text')}) AS ws FROM q), t AS (SELECT id, {_terms_sql('content')} AS ts FROM f), l AS (SELECT id, len(list_filter(ts, lambda x: list_contains(ws, x))) AS tf, len(ts) AS n FROM t, w),
    lr AS (SELECT id, row_number() OVER (ORDER BY round(ln(1 + CAST(tf AS DOUBLE)) / ln(2 + CAST(n AS DOUBLE)), 9) DESC, id) AS rank FROM l WHERE tf > 0 QUALIFY rank <= 100),
    a AS (SELECT id, rank, 0 AS o FROM vr UNION ALL SELECT id, rank, 2 FROM lr), u AS (SELECT id, round(sum(1.0 / (60 + rank)), 12) AS rrf, min(struct_pack(o := o, rank := rank)) AS origin FROM a GROUP BY 1),
    r AS (SELECT u.id, u.rrf, u.origin, coalesce(vr.sim, 0.0) AS sim, c.document_id, c.start_byte, c.end_byte, c.chunk_index FROM u LEFT JOIN vr USING (id) JOIN {CHUNK} c USING (id)),
    s AS ({_SCORE.strip()} SELECT id AS document_id, round(trust, 9) AS trust, trust AS raw FROM t),
    z AS (SELECT r.*, s.trust, round(1 - 1 / (1 + rrf), 9) AS relevance, round(pow(raw, 0.55) * pow(1 - 1 / (1 + rrf), 0.45), 9) AS confidence FROM r JOIN s USING (document_id)),
    y AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, rrf DESC, origin, id) AS p FROM z)"""


@query(
    "search_request",
    f"""{_POOL}, k AS (SELECT y.* FROM y WHERE EXISTS (SELECT 1 FROM (SELECT y.start_byte AS b UNION ALL SELECT e.end_byte FROM y e WHERE e.document_id = y.document_id AND e.p < y.p AND e.end_byte > y.start_byte AND e.end_byte < y.end_byte) x WHERE x.b < y.end_byte AND NOT EXISTS (SELECT 1 FROM y o WHERE o.document_id = y.document_id AND o.p < y.p AND o.start_byte <= x.b AND o.end_byte > x.b)))
    SELECT CAST(row_number() OVER (ORDER BY p) AS INT) AS rank, id, document_id, chunk_index, sim AS best_similarity, rrf AS score, relevance, trust, confidence FROM k QUALIFY rank <= 20""",
)
def search_request(spark: SparkSession, sf: str) -> DataFrame:
    """One whole request: filter, lists by vector and words, fusion, trust, confidence, trim, page."""
    c = _indexed(spark, sf)
    return search.search(c, _request(c)).select("rank", "id", "document_id", "chunk_index", "best_similarity", "score", "relevance", "trust", "confidence")


@query("search_counters", f"{_POOL} SELECT count(*) AS total_candidates, CAST(0 AS BIGINT) AS dropped_by_version, count(*) FILTER (confidence >= 0.05) AS after_confidence FROM z")
def search_counters(spark: SparkSession, sf: str) -> DataFrame:
    c = _c(spark, sf)
    r = _request(c)
    return search.metadata(c, search.Request(r.queries, r.filters, as_of=AS_OF, stemmed=False, min_confidence=0.05))
