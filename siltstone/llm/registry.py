"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import codefiles, confusable, encode, knn, license, near_dup, pack, split

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": near_dup.p1_found,
    "p1_groups": near_dup.p1_groups,
    "p2_found": split.p2_found,
    "p2_pieces": split.p2_pieces,
    "p3_found": license.p3_found,
    "p3_summary": license.p3_summary,
    "p4_found": knn.p4_found,
    "p4_neighbours": knn.p4_neighbours,
    "p4_recall": knn.p4_recall,
    "p5_found": codefiles.p5_found,
    "p5_verdicts": codefiles.p5_verdicts,
    "p6_ids": encode.p6_ids,
    "p6_counts": encode.p6_counts,
    "p7_containers": pack.p7_containers,
    "p7_fill": pack.p7_fill,
    "p8_found": confusable.p8_found,
    "p8_forms": confusable.p8_forms,
    "p8_groups": confusable.p8_groups,
}

_P4 = """
    {f}_v AS (SELECT pair_id, CAST(CAST({f} AS DOUBLE[]) AS DOUBLE[64]) AS v FROM (SELECT DISTINCT ON (pair_id) * FROM query_pair) WHERE len({f}) = 64
        AND NOT list_bool_or(list_transform({f}, lambda x: isnan(x))) AND list_bool_or(list_transform({f}, lambda x: x <> 0))),
    {f}_s AS (SELECT a.pair_id AS a, b.pair_id AS b, array_cosine_similarity(a.v, b.v) AS s FROM {f}_v a JOIN {f}_v b ON a.pair_id < b.pair_id WHERE s >= 0.9 - 1e-9),
    {f}_n AS MATERIALIZED (SELECT a, b, s FROM (SELECT a, b, s FROM {f}_s UNION ALL SELECT b, a, s FROM {f}_s)
        QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 12) DESC, b) <= 10)"""
_P4_PAIRS = "SELECT '{f}' AS field, x.a AS pair_id_a, x.b AS pair_id_b FROM {f}_n x JOIN {f}_n y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.s >= 0.9 - 1e-9"

#: By brute force: all shared shingles, all pairs of vectors; token counts and white-space stretches
#: as regular expressions.
ORACLES: dict[str, str] = {
    "p1_found": r"""
        WITH c AS (SELECT DISTINCT id, content FROM chunk WHERE content IS NOT NULL),
        w AS (SELECT id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM c),
        s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) > 2),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
        k AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
        SELECT id_a, id_b FROM k JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE k >= 0.7 * (a.n + b.n - k) - 1e-9
        UNION SELECT a.id, b.id FROM c a JOIN c b ON a.content = b.content AND a.id < b.id""",
    "p2_found": r"""
        WITH c AS (SELECT DISTINCT id, content FROM chunk WHERE content IS NOT NULL),
        t AS (SELECT id, content, len(regexp_extract_all(content, '[A-Za-z0-9_]+|\S')) AS n FROM c)
        SELECT id, CASE WHEN list_max(list_transform(string_split_regex(content, '\s+'),
                 lambda w: len(regexp_extract_all(w, '[A-Za-z0-9_]+|\S')))) > 1024
               THEN 'forced' ELSE 'boundary' END AS cut
        FROM t WHERE n > 1024""",
    "p4_found": "WITH" + ",".join(_P4.format(f=f) for f in ("vector", "code_vector")) + " " + " UNION ALL ".join(_P4_PAIRS.format(f=f) for f in ("vector", "code_vector")),
}
