"""Queries on retrieval: ranked lists, fusion, scores, filters, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import scoring
from siltstone.functions.text import terms
from siltstone.functions.versions import best_outcomes, classify_udf, keeps, parse_version_column
from siltstone.model import Corpus
from siltstone.operators import analytics, facets, navigate, overlap, search
from siltstone.queries import query

DIM = 64
AS_OF = "2025-06-01 00:00:00"
CHUNK = "(SELECT DISTINCT ON (id) * FROM chunk)"
DOC = "(SELECT DISTINCT ON (id) * FROM new_document)"
QUERY = "(SELECT DISTINCT ON (pair_id) * FROM query_pair WHERE pair_id % 20 = 0)"
LIVE = f"""live AS (SELECT c.*, v.source_id, v.ingested_at FROM {CHUNK} c JOIN source_version v ON v.id = c.source_version_id
    WHERE v.is_active AND c.status = 'ready' AND v.embedding_model_id = (SELECT embedding_model_id FROM source_version WHERE is_active ORDER BY ingested_at DESC, id DESC LIMIT 1))"""
JOINED = f"""{LIVE}, d AS (SELECT l.*, n.kind, n.language, n.provenance, n.source_modified_at, n.package_id FROM live l JOIN {DOC} n ON n.id = l.document_id),
    j AS (SELECT d.*, s.slug AS source_slug, s.kind AS source_kind, p.kind AS package_kind, p.name AS package_name FROM d JOIN corpus_source s ON s.id = d.source_id LEFT JOIN source_package p ON p.id = d.package_id)"""


def _corpus(spark: SparkSession, sf: str) -> Corpus:
    return Corpus(spark, sf)


def _queries(c: Corpus) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return c.raw("query_pair").where("pair_id % 20 = 0").dropDuplicates(["pair_id"]).withColumnRenamed("pair_id", "query_id")


def _vec_sql(column: str, vector: str, out: str = "q") -> str:
    return f"""{out} AS (SELECT pair_id AS query_id, CAST({vector} AS DOUBLE[]) AS v FROM {QUERY} WHERE len({vector}) = {DIM} AND NOT list_bool_or(list_transform({vector}, lambda x: isnan(x))) AND list_bool_or(list_transform({vector}, lambda x: x <> 0))),
    {out}_s AS (SELECT query_id, id, round(list_cosine_similarity(CAST({column} AS DOUBLE[]), v), 9) AS similarity FROM live, {out} WHERE {column} IS NOT NULL AND len({column}) = {DIM} AND list_bool_or(list_transform({column}, lambda x: x <> 0))),
    {out}_r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INT) AS rank FROM {out}_s)"""


def _terms_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN ({stop}))"


# each query asks for any of its words: word or word or ...
LEX = f"""t AS (SELECT id, {_terms_sql('content')} AS ts FROM live), f AS (SELECT id, len(ts) AS n_terms, unnest(ts) AS term FROM t),
    tc AS (SELECT id, term, n_terms, count(*) AS tf FROM f GROUP BY ALL),
    qt AS (SELECT pair_id AS query_id, unnest(list_distinct({_terms_sql('text')})) AS term FROM {QUERY}),
    h AS (SELECT query_id, id, ln(1 + CAST(sum(tf) AS DOUBLE)) AS w, max(n_terms) AS n_terms FROM tc JOIN qt USING (term) GROUP BY 1, 2),
    lx AS (SELECT query_id, id, round(w / ln(2 + CAST(n_terms AS DOUBLE)), 9) AS lexical FROM h),
    lx_r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, id) AS INT) AS rank FROM lx)"""


def _any_word(text) -> Column:
    """The web-style query for any word of a text."""
    return F.array_join(terms(text), " or ")


@query("vector_topk", f"WITH {LIVE}, {_vec_sql('embedding', 'vector')} SELECT query_id, id, similarity, rank FROM q_r WHERE rank <= 100")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf)
    return search.nearest_chunks(search.searchable(c), _queries(c).select("query_id", "vector"), DIM)


@query("code_vector_topk", f"WITH {LIVE}, {_vec_sql('code_embedding', 'code_vector')} SELECT query_id, id, similarity, rank FROM q_r WHERE rank <= 100")
def code_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf)
    return search.nearest_chunks(search.searchable(c), _queries(c).select("query_id", F.col("code_vector").alias("vector")), DIM, "code_embedding")


@query("lexical_topk", f"WITH {LIVE}, {LEX} SELECT query_id, id, lexical, rank FROM lx_r WHERE rank <= 100")
def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf)
    return search.matching_chunks(search.searchable(c), _queries(c).select("query_id", _any_word(F.col("text")).alias("text")), stemmed=False)  # as the SQL


def _fused_sql(key: str, lists: str) -> str:
    return f"""fused AS (SELECT {key}, id, round(sum(1.0 / (60 + rank)), 12) AS rrf, min(struct_pack(list_no := list_no, rank := rank)) AS origin FROM ({lists}) GROUP BY 1, 2),
    placed AS (SELECT {key}, id, rrf, CAST(row_number() OVER (PARTITION BY {key} ORDER BY rrf DESC, origin, id) AS INT) AS place FROM fused)"""


_THREE = "SELECT query_id, id, rank, 0 AS list_no FROM q_r WHERE rank <= 100 UNION ALL SELECT query_id, id, rank, 1 FROM k_r WHERE rank <= 100 UNION ALL SELECT query_id, id, rank, 2 FROM lx_r WHERE rank <= 100"
_LISTS = f"WITH {LIVE}, {_vec_sql('embedding', 'vector')}, {_vec_sql('code_embedding', 'code_vector', 'k')}, {LEX}"


def _three(spark: SparkSession, sf: str) -> list[DataFrame]:
    c = _corpus(spark, sf)
    chunks, q = search.searchable(c), _queries(c)
    return [
        search.nearest_chunks(chunks, q.select("query_id", "vector"), DIM),
        search.nearest_chunks(chunks, q.select("query_id", F.col("code_vector").alias("vector")), DIM, "code_embedding"),
        search.matching_chunks(chunks, q.select("query_id", _any_word(F.col("text")).alias("text")), stemmed=False),  # as the SQL
    ]


@query("hybrid_rrf", f"{_LISTS}, {_fused_sql('query_id', _THREE)} SELECT query_id, id, rrf, place FROM placed WHERE place <= 20")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return search.fuse_each(_three(spark, sf)).drop("n_matched")


@query(
    "rrf_multi_query",
    f"""{_LISTS}, a AS ({_THREE}), r AS (SELECT p.request_id, a.* FROM a JOIN {QUERY} p ON p.pair_id = a.query_id),
    g AS (SELECT request_id, id, round(sum(1.0 / (60 + rank)), 12) AS rrf, count(DISTINCT query_id) AS n_matched, min(struct_pack(list_no := list_no, rank := rank)) AS origin FROM r GROUP BY 1, 2)
    SELECT request_id, id, rrf, n_matched, CAST(row_number() OVER (PARTITION BY request_id ORDER BY rrf DESC, origin, id) AS INT) AS place FROM g QUALIFY place <= 20""",
)
def rrf_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    """All queries of a request in one fused list, with the number of queries that found a chunk."""
    of = _queries(_corpus(spark, sf)).select("query_id", "request_id")
    return search.fuse_each([x.join(of, "query_id") for x in _three(spark, sf)], key="request_id")


@query(
    "best_similarity",
    f"""WITH {LIVE}, {_vec_sql('embedding', 'vector')}, {_vec_sql('code_embedding', 'code_vector', 'k')}
    SELECT id, max(similarity) AS best_similarity, count(DISTINCT query_id) AS n_queries FROM (SELECT query_id, id, similarity FROM q_r WHERE rank <= 100 UNION ALL SELECT query_id, id, similarity FROM k_r WHERE rank <= 100) GROUP BY 1""",
)
def best_similarity(spark: SparkSession, sf: str) -> DataFrame:
    both = vector_topk(spark, sf).unionByName(code_vector_topk(spark, sf))
    return both.groupBy("id").agg(F.max("similarity").alias("best_similarity"), F.count_distinct("query_id").alias("n_queries"))


# --- scores ----------------------------------------------------------------------------------------

_SCORE = f"""
    WITH d AS (SELECT n.id, n.provenance AS p, date_diff('second', coalesce(n.source_modified_at, v.ingested_at), TIMESTAMPTZ '{AS_OF}+00') AS sec FROM {DOC} n JOIN source_version v ON v.id = n.source_version_id),
    m AS (SELECT id, CASE coalesce(p.attribution, 'unknown') WHEN 'foundation' THEN 1.0 WHEN 'partner' THEN 0.85 WHEN 'third_party' THEN 0.6 WHEN 'community' THEN 0.4 ELSE 0.3 END AS a,
        CASE WHEN NOT coalesce(p.verified, false) THEN 0.7 WHEN contains(lower(coalesce(p.verified_by, '')), 'foundation') THEN 1.0 WHEN contains(lower(coalesce(p.verified_by, '')), 'partner') THEN 0.9 ELSE 0.8 END AS v,
        CASE WHEN coalesce(p.deprecation.is_deprecated, false) THEN 0.3 ELSE 1.0 END AS dep, CAST(trunc(sec / 86400.0) AS BIGINT) AS age FROM d),
    t AS (SELECT id, age, least(greatest(CAST(a AS DOUBLE) * CAST(v AS DOUBLE) * exp(-greatest(age, 0) / 180.0) * CAST(dep AS DOUBLE), 0), 1) AS trust FROM m)"""


@query("trust_confidence", f"{_SCORE} SELECT id, age AS age_days, round(trust, 9) AS trust, round(pow(trust, 0.55) * pow(0.5, 0.45), 9) AS confidence FROM t")
def trust_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's trust, and its confidence at a relevance of one half."""
    c = _corpus(spark, sf)
    v = c.versions.select(F.col("id").alias("source_version_id"), "ingested_at")
    d = c.documents.select("id", "source_version_id", "provenance", "source_modified_at").join(v, "source_version_id")
    d = d.withColumn("age_days", scoring.age_in_days(F.to_timestamp(F.lit(AS_OF)), F.col("source_modified_at"), F.col("ingested_at")))
    d = d.withColumn("s", scoring.score(F.col("provenance"), F.col("age_days"), F.lit(0.5)))
    return d.select("id", "age_days", F.round("s.trust", 9).alias("trust"), F.round("s.confidence", 9).alias("confidence"))


@query("confidence_buckets", f"{_SCORE}, c AS (SELECT pow(trust, 0.55) * pow(0.5, 0.45) AS c FROM t) SELECT CASE WHEN c >= 0.85 THEN 'high' WHEN c >= 0.7 THEN 'medium' WHEN c >= 0.5 THEN 'low' ELSE 'very_low' END AS bucket, count(*) AS n FROM c GROUP BY 1")
def confidence_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return trust_confidence(spark, sf).groupBy(scoring.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"))


@query("sort_trust", f"{_SCORE} SELECT id, round(trust, 9) AS trust, CAST(row_number() OVER (ORDER BY round(trust, 9) DESC, id) AS INT) AS place FROM t QUALIFY place <= 100")
def sort_trust(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred most trusted documents: a top-k report."""
    top = trust_confidence(spark, sf).select("id", "trust").orderBy(F.desc("trust"), "id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("trust"), "id")))


@query("min_confidence", f"{_SCORE} SELECT id, round(pow(trust, 0.55) * pow(0.5, 0.45), 9) AS confidence FROM t WHERE round(pow(trust, 0.55) * pow(0.5, 0.45), 9) >= 0.3")
def min_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return trust_confidence(spark, sf).where("confidence >= 0.3").select("id", "confidence")


@query("authority_levels", f"SELECT CASE CAST(coalesce(provenance.attribution IN ('foundation', 'partner'), false) AS INT) + CAST(coalesce(provenance.verified, false) AS INT) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM {DOC} GROUP BY 1")
def authority_levels(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("provenance")
    return _corpus(spark, sf).documents.groupBy(scoring.authority_level(p["attribution"], p["verified"]).alias("level")).agg(F.count("*").alias("n"))


@query("normalised_rrf", "SELECT CAST(range AS BIGINT) AS rank, round(1 - 1 / (1 + 1.0 / (60 + range)), 12) AS relevance FROM range(1, 101)")
def normalised_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1, 101).select(F.col("id").alias("rank"), F.round(scoring.normalised_rrf(1.0 / (60 + F.col("id"))), 12).alias("relevance"))


# --- filters ---------------------------------------------------------------------------------------

_NO_TS = "TIMESTAMPTZ '{} 00:00:00+00'"
FILTERS: dict[str, tuple[dict, str, bool]] = {
    "facet_any_of": ({"language": {"any_of": ["rust", "typescript"]}}, "language IN ('rust', 'typescript')", False),
    "facet_none_of_null": ({"language": {"none_of": ["typescript", "en"]}}, "coalesce(language, '') NOT IN ('typescript', 'en')", False),
    "facet_kind": ({"kind": {"any_of": ["markdown", "plaintext"]}}, "kind IN ('markdown', 'plaintext')", False),
    "facet_source_kind": ({"source_kind": {"none_of": ["code_repo"]}}, "coalesce(source_kind, '') <> 'code_repo'", False),
    "facet_attribution_default": ({"attribution": {"any_of": ["unknown", "community"]}}, "coalesce(provenance.attribution, 'unknown') IN ('unknown', 'community')", False),
    "facet_content_type": ({"content_type": {"none_of": ["other"]}}, "coalesce(provenance.content_type, 'other') <> 'other'", False),
    "facet_bool_default": ({"verified": False}, "NOT coalesce(provenance.verified, false)", False),
    "facet_deprecated": ({"deprecated": True}, "coalesce(provenance.deprecation.is_deprecated, false)", False),
    "facet_tags_none_of": ({"tags": {"none_of": ["api", "guide", "cli"]}}, "NOT coalesce(list_has_any(provenance.tags, ['api', 'guide', 'cli']), false)", False),
    "facet_symbol": ({"symbol": {"any_of": [{"kind": "function"}]}}, "coalesce(len(list_filter(symbol_path, lambda s: s.kind = 'function')) > 0, false)", False),
    "facet_symbol_any": ({"symbol": {"any_of": [{}]}}, "coalesce(len(symbol_path) > 0, false)", False),
    "facet_symbol_none_of": ({"symbol": {"none_of": [{"kind": "circuit"}]}}, "NOT coalesce(len(list_filter(symbol_path, lambda s: s.kind = 'circuit')) > 0, false)", False),
    "facet_heading_none_of": ({"heading_path": {"none_of": ["License"]}}, "NOT coalesce(list_contains(heading_path, 'License'), false)", False),
    "facet_ingested_range": ({"ingested_at": {"after": "2024-08-01", "before": "2024-12-01"}}, f"ingested_at >= {_NO_TS.format('2024-08-01')} AND ingested_at <= {_NO_TS.format('2024-12-01')}", False),
    "facet_modified_range": ({"source_modified_at": {"after": "2024-03-01"}}, f"source_modified_at >= {_NO_TS.format('2024-03-01')}", False),
    "facet_token_range": ({"token_count": {"min": 50, "max": 400}}, "token_count BETWEEN 50 AND 400", False),
    "facet_and": ({"kind": {"any_of": ["code"]}, "verified": False, "token_count": {"min": 100}, "language": {"none_of": ["go"]}}, "kind = 'code' AND NOT coalesce(provenance.verified, false) AND token_count >= 100 AND coalesce(language, '') <> 'go'", False),
    "facet_package_none_of": ({"package": {"none_of": [{"kind": "npm", "name": "hacinrorkuncra"}]}}, "package_kind IS NULL OR NOT (package_kind = 'npm' AND package_name = 'hacinrorkuncra')", False),
    "facet_strict_target": ({"language_target": {"any_of": [{"name": "compact", "version_satisfies": "1.0"}]}}, "coalesce(len(list_filter(provenance.language_targets, lambda t: t.name = 'compact')) > 0, false)", True),
    "facet_empty": ({"language": {"any_of": []}}, "true", False),
}


def _filter_query(filters: dict, strict: bool):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = _corpus(spark, sf)
        return search.filtered(c, filters, strict).select("id")

    return run


for _name, (_f, _where, _strict) in FILTERS.items():
    query(_name, f"WITH {JOINED} SELECT id FROM j WHERE {_where}")(_filter_query(_f, _strict))


def _first_sdk(c: Corpus) -> str:
    """The least dependency name of the corpus (one row)."""
    return c.documents.select(F.explode("provenance.sdk_dependencies.name").alias("n")).agg(F.min("n").alias("n")).first().n


@query("facet_strict_sdk", f"WITH {JOINED}, w AS (SELECT min(t.name) AS n FROM (SELECT unnest(provenance.sdk_dependencies) AS t FROM {DOC})) SELECT id FROM j, w WHERE coalesce(list_contains(list_transform(provenance.sdk_dependencies, lambda t: t.name), n), false)")
def facet_strict_sdk(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that declare a dependency that exists in the corpus."""
    c = _corpus(spark, sf)
    return search.filtered(c, {"sdk_dependency": {"any_of": [{"kind": "npm", "name": _first_sdk(c)}]}}, True).select("id")


# --- versions --------------------------------------------------------------------------------------


@query(
    "parse_version",
    r"""WITH v AS (SELECT DISTINCT version FROM source_package WHERE version IS NOT NULL)
    SELECT version, CAST(regexp_extract(version, '^v?(\d+)', 1) AS BIGINT) AS major, coalesce(TRY_CAST(nullif(regexp_extract(version, '^v?\d+\.(\d+)', 1), '') AS BIGINT), 0) AS minor, coalesce(TRY_CAST(nullif(regexp_extract(version, '^v?\d+\.\d+\.(\d+)', 1), '') AS BIGINT), 0) AS patch
    FROM v WHERE regexp_full_match(version, 'v?\d+(\.\d+)?(\.\d+)?([-+].*)?')""",
)
def parse_version(spark: SparkSession, sf: str) -> DataFrame:
    v = _corpus(spark, sf).packages.select("version").where("version IS NOT NULL").distinct().withColumn("p", parse_version_column(F.col("version")))
    return v.where("p IS NOT NULL").select("version", "p.major", "p.minor", "p.patch")


# --- navigation: every chunk is an anchor ----------------------------------------------------------

VIS = f"vis AS (SELECT * FROM {CHUNK} WHERE status <> 'embed_failed'), allc AS (SELECT * FROM {CHUNK})"


@query("chunk_next", f"WITH {VIS} SELECT a.id AS anchor_id, v.id, v.chunk_index, CAST(row_number() OVER (PARTITION BY a.id ORDER BY v.chunk_index, v.id) AS INT) AS step FROM allc a JOIN vis v ON v.document_id = a.document_id AND v.chunk_index > a.chunk_index QUALIFY step <= 3")
def chunk_next(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf).chunks
    return navigate.following(c, c, 3)


@query("chunk_prev", f"WITH {VIS} SELECT a.id AS anchor_id, v.id, v.chunk_index, CAST(row_number() OVER (PARTITION BY a.id ORDER BY v.chunk_index DESC, v.id) AS INT) AS step FROM allc a JOIN vis v ON v.document_id = a.document_id AND v.chunk_index < a.chunk_index QUALIFY step <= 3")
def chunk_prev(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf).chunks
    return navigate.following(c, c, 3, back=True)


@query(
    "chunk_neighbours",
    f"""WITH {VIS}, n AS (SELECT a.id AS anchor_id, v.id, v.chunk_index, CAST(row_number() OVER (PARTITION BY a.id ORDER BY v.chunk_index, v.id) AS INT) AS "offset" FROM allc a JOIN vis v ON v.document_id = a.document_id AND v.chunk_index > a.chunk_index),
    p AS (SELECT a.id AS anchor_id, v.id, v.chunk_index, -CAST(row_number() OVER (PARTITION BY a.id ORDER BY v.chunk_index DESC, v.id) AS INT) AS "offset" FROM allc a JOIN vis v ON v.document_id = a.document_id AND v.chunk_index < a.chunk_index)
    SELECT * FROM n WHERE "offset" <= 2 UNION ALL SELECT * FROM p WHERE "offset" >= -2 UNION ALL SELECT id, id, chunk_index, 0 FROM vis""",
)
def chunk_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf).chunks
    return navigate.neighbours(c, c, 2)


@query("doc_positions", f"WITH {VIS} SELECT document_id, id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS INT) - 1 AS position, count(*) OVER (PARTITION BY document_id) AS total FROM vis")
def doc_positions(spark: SparkSession, sf: str) -> DataFrame:
    p = navigate.positions(_corpus(spark, sf).chunks)
    return p.select("document_id", "id", "position", F.count("*").over(Window.partitionBy("document_id")).alias("total"))


@query("doc_skeleton", f"WITH {VIS} SELECT document_id, id, chunk_index, coalesce(array_to_string(heading_path, ' > '), '') AS headings, symbol_path[1].kind AS symbol_kind, symbol_path[1].name AS symbol_name, token_count FROM vis")
def doc_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    return navigate.skeleton(_corpus(spark, sf).chunks)


@query(
    "parent_chain",
    """WITH RECURSIVE e AS (SELECT DISTINCT id, parent_node_id FROM node), up(id, ancestor_id, depth) AS (SELECT id, parent_node_id, 1 FROM e WHERE parent_node_id IS NOT NULL
    UNION ALL SELECT u.id, e.parent_node_id, u.depth + 1 FROM up u JOIN e ON e.id = u.ancestor_id WHERE e.parent_node_id IS NOT NULL) SELECT id, ancestor_id, CAST(depth AS INT) AS depth FROM up""",
)
def parent_chain(spark: SparkSession, sf: str) -> DataFrame:
    n = _corpus(spark, sf).nodes
    return navigate.ancestors(spark, n, n)


@query(
    "parent_documents",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT id, parent_node_id FROM node), up(id, ancestor_id, depth) AS (SELECT id, parent_node_id, 1 FROM e WHERE parent_node_id IS NOT NULL
    UNION ALL SELECT u.id, e.parent_node_id, u.depth + 1 FROM up u JOIN e ON e.id = u.ancestor_id WHERE e.parent_node_id IS NOT NULL)
    SELECT u.id, u.ancestor_id, CAST(u.depth AS INT) AS depth, n.name, n.kind, d.id AS document_id FROM up u JOIN (SELECT DISTINCT id, name, kind FROM node) n ON n.id = u.ancestor_id LEFT JOIN {DOC} d ON d.node_id = u.ancestor_id""",
)
def parent_documents(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf)
    return navigate.ancestors_with_documents(c, c.nodes)


@query("batch_get", "SELECT * FROM (VALUES (0, '40', true), (1, '7', true), (2, '40', false), (3, '-5', false), (4, '12', true)) t(position, wanted, found)")
def batch_get(spark: SparkSession, sf: str) -> DataFrame:
    """Order of the request kept; repeats and unknown ids are missing."""
    docs = _corpus(spark, sf).raw("query_pair").select(F.col("pair_id").cast("string").alias("id"))
    return navigate.batch_get(spark, docs, ["40", "7", "40", "-5", "12"])


@query("drop_covered", f"WITH c AS {CHUNK} SELECT a.id FROM c a WHERE a.start_byte < a.end_byte AND NOT EXISTS (SELECT 1 FROM c b WHERE b.document_id = a.document_id AND b.source_version_id = a.source_version_id AND b.chunk_index < a.chunk_index AND b.start_byte <= a.start_byte AND b.end_byte >= a.end_byte)")
def drop_covered(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.drop_covered(_corpus(spark, sf).chunks, ["source_version_id"], "chunk_index").select("id")


@query(
    "covered_spans",
    f"""WITH s AS (SELECT document_id, start_byte, end_byte, max(end_byte) OVER (PARTITION BY document_id ORDER BY start_byte, end_byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {CHUNK} WHERE start_byte < end_byte),
    g AS (SELECT *, sum(CASE WHEN before IS NULL OR start_byte > before THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY start_byte, end_byte) AS island FROM s)
    SELECT document_id, min(start_byte) AS start_byte, max(end_byte) AS end_byte FROM g GROUP BY document_id, island""",
)
def covered_spans(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.covered_spans(_corpus(spark, sf).chunks)


@query("facet_registry", "SELECT * FROM (VALUES " + ", ".join(f"('{f.key}', '{f.shape}', {str(f.negatable).lower()})" for f in facets.REGISTRY.values()) + ") t(key, shape, negatable)")
def facet_registry(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(f.key, f.shape, f.negatable) for f in facets.REGISTRY.values()], "key string, shape string, negatable boolean")


# --- centroids and topics --------------------------------------------------------------------------


@query(
    "centroid_mean",
    f"""WITH {LIVE.replace("WHERE v.is_active AND c.status = 'ready' AND v.embedding_model_id = (SELECT embedding_model_id FROM source_version WHERE is_active ORDER BY ingested_at DESC, id DESC LIMIT 1)", "WHERE v.is_active AND c.status = 'ready' AND c.embedding IS NOT NULL")},
    f AS (SELECT s.kind AS label, unnest(range(1, {DIM} + 1)) AS pos, unnest(CAST(l.embedding AS DOUBLE[])) AS x FROM live l JOIN corpus_source s ON s.id = l.source_id)
    SELECT label, CAST(pos - 1 AS INT) AS pos, round(avg(x), 9) AS m, count(*) AS n FROM f GROUP BY 1, 2""",
)
def centroid_mean(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf)
    v = c.active_versions.select(F.col("id").alias("source_version_id"), "source_id")
    s = c.sources.select(F.col("id").alias("source_id"), F.col("kind").alias("label"))
    rows = c.wide_chunks.where("status = 'ready' AND embedding IS NOT NULL").select("source_version_id", "embedding").join(v, "source_version_id").join(s, "source_id")
    m = analytics.centroids(rows, normalise=False)
    return m.select("label", F.posexplode("centroid").alias("pos", "x"), "n").select("label", "pos", F.round("x", 9).alias("m"), "n")


@query(
    "topic_classify",
    """WITH f AS (SELECT CAST(label AS VARCHAR) AS label, unnest(range(1, 65)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT label, pos, avg(x) AS m FROM f GROUP BY 1, 2),
    c AS (SELECT label, list(m ORDER BY pos) AS v FROM m GROUP BY 1),
    s AS (SELECT e.vec_id, c.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.v), 12) AS s FROM embeddings e, c),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label DESC) = 1) SELECT vec_id, CASE WHEN s >= 0.1 THEN label ELSE 'other' END AS topic FROM b""",
)
def topic_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest label centroid of every vector."""
    e = _corpus(spark, sf).raw("embeddings")
    return analytics.topics(e, "embedding", analytics.centroids(e, normalise=False), 0.1).select("vec_id", "topic")
