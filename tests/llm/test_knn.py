import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import knn as K


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v], "x", 1) for i, v in zip(ids, vectors, strict=True)], "id bigint, vec array<float>, dir string, vid int")


def exact(ids, v, k):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(v @ v.T, 12)
    np.fill_diagonal(s, -9)
    o = np.argsort(ids, kind="stable")
    return {ids[i]: [ids[j] for j in o[np.argsort(-s[i][o], kind="stable")] if j != i][:k] for i in range(len(ids))}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    v = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    ids = rng.permutation(3000) + 1
    want = exact(ids, v.astype(float), 10)
    got = {}
    for r in K.nearest_neighbours(frame(spark, ids, v), "id", "vec", dim=16, list_rows=100, block=64).collect():
        got.setdefault(r.id, []).append(r.neighbour_id)
    hit = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hit / (10 * len(want)) >= 0.95
    assert all(len(g) == 10 for g in got.values())


def test_copies_ties_and_dirty_vectors(spark):
    e = np.eye(4)
    vectors = [e[0]] * 40 + [e[1], 2 * e[1], None, [0, 0, 0, 0], [1, 2], [float("nan"), 0, 0, 1], [float("inf"), 0, 0, 1], e[2] + e[0]]
    ids = list(range(1, len(vectors) + 1))
    df = frame(spark, ids, vectors)
    df = df.union(df.where("id = 3"))
    got = {}
    for r in K.nearest_neighbours(df, "id", "vec", dim=4, k=3).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour_id, round(r.cosine, 6)))
    assert sorted(got[40]) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]
    assert sorted(got[2]) == [(1, 1, 1.0), (2, 3, 1.0), (3, 4, 1.0)]
    assert sorted(got[41])[0] == (1, 42, 1.0)
    assert set(got) == {*range(1, 43), 48}
    assert K.nearest_neighbours(df.where("1 = 0"), "id", "vec", dim=4).count() == 0
    one = K.nearest_neighbours(df.where("id = 41"), "id", "vec", dim=4)
    assert one.count() == 0


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(1)
    c = rng.normal(size=(500, 16)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    q = rng.normal(size=(64, 16)).astype(np.float32)
    ids, _ = K.CentroidGraph(c).search(q, 4)
    want = np.argsort(-(q @ c.T), axis=1)[:, :4]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids, want, strict=True)]) >= 3.6


def test_leaves_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = K.fit_centroids(x, 50)
    sizes = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    assert 40 <= len(c) <= 400 and sizes.max() <= 200
    assert len(K.fit_centroids(np.repeat(x[:1], 300, 0), 50)) == 1


def test_exact_neighbours(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 8)).astype(np.float32)
    ids = np.arange(1, 201)
    want = exact(ids, v.astype(float), 5)
    got = {}
    for r in K.exact_neighbours(frame(spark, ids, v), "id", "vec", dim=8, k=5).collect():
        got.setdefault(r.id, set()).add(r.neighbour_id)
    assert got == {i: set(want[i]) for i in ids if i % 20 == 0}


def test_lists_keep_their_length_and_grow_in_number(spark):
    rng = np.random.default_rng(3)
    lists = {}
    for n in (400, 1600, 6400):
        v = rng.normal(size=(n, 8)).astype(np.float32)
        points = frame(spark, range(n), v).select(F.lit(0).alias("field"), F.col("id").alias("vid"), F.col("vec"))
        rows = points.rdd.map(lambda r: (0, r.vid, bytearray(np.asarray(r.vec, np.float32).tobytes()))).toDF("field int, vid bigint, vec binary")
        placed = K.place_in_lists(rows, 8, 16, 20, 8, 1024, 0.25, 16, 0.04, 4, 0.25, 4, 64)
        per = placed.where("side % 2 = 1").groupBy("list").count().agg(F.count("*").alias("n"), F.max("count").alias("longest")).first()
        lists[n] = per.n
        assert per.longest <= 200
        assert placed.where("side % 2 = 1").select("vid").distinct().count() == n
    assert lists[1600] >= 2.5 * lists[400] and lists[6400] >= 2.5 * lists[1600]


def test_fields_do_not_mix(spark):
    rng = np.random.default_rng(4)
    a, b = (rng.normal(size=(120, 8)).astype(np.float32) for _ in range(2))
    ids = np.arange(1, 121)
    fields = {name: frame(spark, ids, v).select("id", "vec") for name, v in (("a", a), ("b", b))}
    got = {}
    for r in K.nearest_in_fields(fields, dim=8, k=4).collect():
        got.setdefault(r.field, {}).setdefault(r.id, []).append((r.rank, r.neighbour_id))
    for name, v in (("a", a), ("b", b)):
        want = exact(ids, v.astype(float), 4)
        assert {i: [n for _, n in sorted(x)] for i, x in got[name].items()} == want
