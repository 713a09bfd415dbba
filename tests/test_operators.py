"""Operators on small hand-made rows."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.model import first_of_each_id
from siltstone.operators import analytics, batching, facets, ingest, lifecycle, navigate, overlap, quota, rerank, search
from siltstone.sources import files, manifest, packages, sinks
from siltstone.streaming import limits

# --- facets ---


@pytest.mark.parametrize("bad", [{"nope": {}}, {"kind": {"any_of": ["film"]}}, {"verified": "yes"}, {"token_count": {"min": 5, "max": 1}}, {"ingested_at": {"after": "2024-02-01", "before": "2024-01-01"}}, {"language_target": {"none_of": [{"name": "x"}]}}, {"language_target": {"any_of": [{"name": "x", "version_satisfies": "??"}]}}, {"package": {"any_of": [{"kind": "gem", "name": "x"}]}}])
def test_filters_are_checked(bad):
    with pytest.raises(facets.FilterError):
        facets.validate(bad)


def test_flags():
    assert facets.from_flags(kind=["code"], not_language=["go"], verified=True, min_tokens=5, ingested_at_after="2024-01-01") == {"kind": {"any_of": ["code"]}, "language": {"none_of": ["go"]}, "verified": True, "token_count": {"min": 5}, "ingested_at": {"after": "2024-01-01"}}
    assert facets.is_empty({"kind": {"any_of": []}}) and not facets.is_empty({"verified": False})
    assert facets.needs({"tags": {"any_of": ["x"]}}) == {"document"} and facets.needs({"package": {"any_of": []}, "token_count": {"min": 1}}) == {"document", "package"}


# --- requests ---


def test_requests():
    q = search.Query("a", [1.0])
    r = search.Request([q, q, search.Query("b")], limit=900).normalised()
    assert len(r.queries) == 2 and r.limit == 100 and r.code_mode == "on"
    for bad in (search.Request([]), search.Request([search.Query(" ")]), search.Request([q], mode="fts", code_mode="on"), search.Request([q], min_confidence=float("nan")), search.Request([q] * 11), search.Request([q], sort_by="x")):
        with pytest.raises(ValueError):
            bad.normalised()
    assert search.effective_code_mode("fts", None) == "off" and search.rerank_pool(20) == 50
    assert search.parse_words('fast "hash join" or merge -slow') == ([["fast"], ["hash"], ["join", "merge"]], ["hash join"], ["slow"])


def test_words_meet_by_their_stems(spark):
    chunks = spark.createDataFrame([("a", "All migrations were cached."), ("b", "One migration, one cache"), ("c", "Nothing of it")], "id string, content string")
    q = spark.createDataFrame([(1, "migration cache"), (2, "migrating caches"), (3, "things")], "query_id int, text string")
    assert {(r.query_id, r.id) for r in search.matching_chunks(chunks, q).collect()} == {(1, "a"), (1, "b"), (2, "a"), (2, "b")}
    assert {(r.query_id, r.id) for r in search.matching_chunks(chunks, q, stemmed=False).collect()} == {(1, "b")}
    asked = [search.Query("migration cache"), search.Query('"migration were caching"'), search.Query("migration -cached"), search.Query("one or migrate")]
    assert {(r.query_index, r.id) for r in search.lexical_list(chunks, asked).collect()} == {(0, "a"), (0, "b"), (1, "a"), (3, "a"), (3, "b")}


LISTS = st.lists(st.lists(st.integers(0, 30), unique=True, max_size=12), min_size=1, max_size=4)


@given(LISTS)
@settings(max_examples=10, deadline=None)
def test_fusion_is_the_sum_of_reciprocal_ranks(spark, lists):
    dfs = [spark.createDataFrame([(0, f"{i:02}", k + 1) for k, i in enumerate(x)], "query_index int, id string, rank int") for x in lists]
    got = {r.id: r.rrf for r in search.fuse(dfs).collect()}
    want = {}
    for x in lists:
        for k, i in enumerate(x):
            want[f"{i:02}"] = want.get(f"{i:02}", 0) + 1 / (61 + k)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-11 for i in want)


# --- overlap ---


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 12)), max_size=8))
def test_trim_keeps_every_byte_once(spans):
    body = "".join(chr(65 + k % 26) for k in range(50))
    rows = [(a, a + n, body[a : a + n]) for a, n in spans]
    got = overlap.trim(rows)
    kept = "".join(x for g in got if g for x in g.split(overlap.ELISION))
    covered = sorted({k for a, b, _ in rows for k in range(a, b)})
    assert sorted(kept) == sorted(body[k] for k in covered)


def test_trim_rules():
    assert overlap.trim([(0, 4, "abcd"), (2, 6, "cdef"), (0, 6, "abcdef"), (3, 3, ""), (4, 8, "crumb\nxxxx")]) == ["abcd", "ef", None, None, "crumb\nxxxx"]
    assert overlap.trim([(2, 4, "cd"), (0, 6, "abcdef")]) == ["cd", "ab\n…\nef"]


def test_trim_of_a_table_equals_that_of_a_list(spark):
    r = random.Random(5)
    body = "aé€😀b\n" * 20
    raw = body.encode()
    rows = []
    for doc in range(6):
        for rank in range(12):
            a = r.randrange(len(raw))
            b = min(len(raw), a + r.randrange(30))
            rows.append((f"d{doc}", rank, a, b, raw[a:b].decode("utf-8", "ignore") if r.random() < 0.8 else "other text"))
    df = spark.createDataFrame([(0, *x) for x in rows] + [(0, "d0", 99, None, None, "kept")], "l int, document_id string, rank int, start_byte int, end_byte int, content string")
    got = {(x.document_id, x.rank): x.content for x in overlap.trim_overlaps(df, ["l"]).collect()}
    want = {("d0", 99): "kept"}
    for doc in range(6):
        mine = [x for x in rows if x[0] == f"d{doc}"]
        want |= {(f"d{doc}", x[1]): c for x, c in zip(mine, overlap.trim([x[2:] for x in mine]), strict=True) if c is not None}
    assert got == want


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9), st.integers(1, 6)), max_size=14))
def test_uncovered_rows(rows):
    rows = sorted((r, a, a + n) for r, a, n in rows)
    brute = [i for i, (r, a, b) in enumerate(rows) if not any(q < r and x <= a and y >= b for q, x, y in rows)]
    assert overlap.uncovered(rows) == brute


def _lexical_by_hand(texts: dict, parsed: list, n: int) -> dict:
    out = {}
    for k, (groups, phrases, without) in enumerate(parsed):
        rows = []
        for i, ts in texts.items():
            tf = [sum(t in g for t in ts) for g in groups]
            if all(tf) and not set(ts) & set(without) and all(f" {p} " in f" {' '.join(ts)} " for p in phrases):
                rows.append((-round(sum(map(math.log1p, tf)) / math.log1p(len(ts) + 1), 9), i))
        out.update({(k, i): (r, -s) for r, (s, i) in enumerate(sorted(rows)[:n], 1)})
    return out


@pytest.mark.parametrize("small", [False, True])
def test_word_lists_equal_brute_force(spark, monkeypatch, small):
    words = [f"w{k}" for k in range(12)]
    dice = random.Random(7)
    texts = {f"i{k % 7}{k}": [dice.choice(words) for _ in range(dice.randint(1, 9))] for k in range(300)}
    queries = [" or ".join(words), "w1 or w2", "w1 w2", "w1 or w3 w2 -w4", '"w5 w6"', "w7 nothing", "w8 or nothing", "nowhere", "w1 -w1"]
    queries += [" or ".join(dice.sample(words, 4)) for _ in range(30)]
    parsed = [search.stemmed_parse(q, False) for q in queries]
    place = {w: k for k, w in enumerate(sorted({w for gs, _, o in parsed for ws in (*gs, o) for w in ws}))}
    if small:
        for name, value in (("TEXTS", 40), ("CELLS", 256), ("WORDS", 8)):
            monkeypatch.setattr(search, name, value)
    lists = search.WordLists(sorted(place), [([np.array([place[w] for w in g]) for g in gs], p, np.array([place[w] for w in o], int)) for gs, p, o in parsed], 5)
    for at in range(0, 300, 90):
        some = list(texts)[at : at + 90]
        lists.add(pa.array([*some, "none", "empty"]), pa.array([*(texts[i] for i in some), None, []], pa.list_(pa.string())))
    lists.merge()
    want = _lexical_by_hand(texts, parsed, 5)
    got: dict = {}
    for q, i, s in lists.kept():
        for a, b, c in zip(q.tolist(), i.tolist(), s.tolist(), strict=True):
            got[a, b.decode()] = (1 + sum(x[0] == a for x in got), c)
    assert got == want
    if not small:
        chunks = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id string, content string").repartition(9)
        table_ = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
        assert {(r.query_id, r.id): (r.rank, r.lexical) for r in search.matching_chunks(chunks, table_, n=5, stemmed=False).collect()} == want


def test_common_words_are_not_shuffled(spark):
    """Rows of a query and a chunk leave a task as the n best of the query only."""
    chunks = spark.range(4000).selectExpr("concat('i', id) AS id", "concat('common word ', id) AS content")
    q = spark.range(40).selectExpr("id AS query_id", "'common or word' AS text")
    found = search.matching_chunks(chunks, q, n=3, stemmed=False)
    assert found.count() == 120
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_vector_lists_have_as_many_tasks_as_cores(spark, monkeypatch):
    """Each task sends n rows a query, so tasks are bounded, not one a file split."""
    chunks = spark.range(400).selectExpr("concat('i', id) AS id", "array(double(id), 400.0) AS embedding").repartition(40)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, vector array<double>")
    tasks, nearest = [], search._nearest
    monkeypatch.setattr(search, "_nearest", lambda c, *x: tasks.append(c.rdd.getNumPartitions()) or nearest(c, *x))
    assert {(r.query_id, r.rank): r.id for r in search.nearest_chunks(chunks, q, 2, n=2).collect()} == {(1, 1): "i399", (1, 2): "i398", (2, 1): "i0", (2, 2): "i1"}
    assert tasks == [spark.sparkContext.defaultParallelism]


@pytest.mark.parametrize("small", [False, True])
def test_vector_lists_equal_brute_force(spark, monkeypatch, small):
    """Ties by id, within and across the matrices that vectors and queries meet in."""
    dice = np.random.default_rng(3)
    few = dice.normal(size=(40, 6))  # each several times, at ids that are far apart
    vectors = {f"i{k * 37 % 300}": few[k % 40] * (1 + k % 3) for k in range(300)}
    queries = np.concatenate([few[:5], dice.normal(size=(20, 6))])
    unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    if small:
        monkeypatch.setattr(search, "VALUES", 240)
        monkeypatch.setattr(search, "TILE", 16)
    lists = search.VectorLists(unit, 5)
    for at in range(0, 300, 90):
        some = list(vectors)[at : at + 90]
        lists.add(pa.array(some), pa.array([vectors[i].tolist() for i in some]))
    lists.add(pa.array(["endless"]), pa.array([[math.inf, *[1.0] * 5]]))
    lists.merge()
    want = {}
    for k, q in enumerate(unit):
        rows = sorted((-round(float(q @ v / np.linalg.norm(v)), 9), i) for i, v in vectors.items())
        want.update({(k, i): (r, -s) for r, (s, i) in enumerate(rows[:5], 1)})
    got: dict = {}
    for q, i, s in lists.kept():
        for a, b, c in zip(q.tolist(), i.tolist(), s.tolist(), strict=True):
            got[a, b.decode()] = (1 + sum(x[0] == a for x in got), c)
    assert got == want
    if not small:
        chunks = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id string, embedding array<double>").repartition(9)
        table_ = spark.createDataFrame([(k, q.tolist()) for k, q in enumerate(queries)], "query_id int, vector array<double>")
        assert {(r.query_id, r.id): (r.rank, r.similarity) for r in search.nearest_chunks(chunks, table_, 6, n=5).collect()} == want


def test_vector_lists_hold_little():
    """All queries times a batch of vectors is never in memory at once."""
    dice = np.random.default_rng(4)
    lists = search.VectorLists(dice.normal(size=(4000, 8)), 10)
    ids, vectors = pa.array([f"i{k}" for k in range(8000)]), pa.array(list(dice.normal(size=(8000, 8))))
    tracemalloc.start()
    lists.add(ids, vectors)
    lists.merge()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4000 * 8000 * 8 / 4
    assert sum(len(q) for q, _, _ in lists.kept()) == 40_000


# --- reading around a chunk ---


def test_following_counts_visible_chunks_only(spark):
    rows = [("a", "d", 0, "ready"), ("b", "d", 1, "embed_failed"), ("c", "d", 1, "ready"), ("e", "d", 2, "embed_failed"), ("f", "d", 3, "deprecated"), ("g", "x", 0, "ready")]
    c = spark.createDataFrame(rows, "id string, document_id string, chunk_index int, status string")
    got = {(x.anchor_id, x.step): x.id for x in navigate.following(c, c, 2).collect()}
    assert got == {("a", 1): "c", ("a", 2): "f", ("b", 1): "f", ("c", 1): "f", ("e", 1): "f"}
    one = c.where("id = 'e'")
    assert {(x.step, x.id) for x in navigate.following(c, one, 2, back=True).collect()} == {(1, "c"), (2, "a")}


def test_ancestors_are_never_cut(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k - 1}" if k else None) for k in range(90)], "id string, parent_node_id string")
    assert navigate.ancestors(spark, chain, chain.where("id = 'n89'")).count() == 89
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_node_id string")
    with pytest.raises(Exception, match="cycle"):
        navigate.ancestors(spark, ring, ring, max_depth=20).collect()


def test_ancestors_of_many_nodes_have_no_row_limit(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")  # Spark's own is a million
    try:
        tree = spark.createDataFrame([("r", None), ("n", "r")] + [(f"c{i}", "n") for i in range(100)], "id string, parent_node_id string")
        assert navigate.ancestors(spark, tree, tree).count() == 201
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_rows_of_repeated_ids_are_the_same_at_every_size(spark, tmp_path):
    spark.range(3000).selectExpr("concat('i', id % 2000) as id", "id as n", "repeat('x', 50) as wide").repartition(3).write.parquet(str(tmp_path / "t"))
    raw = spark.read.parquet(str(tmp_path / "t"))
    few, many = first_of_each_id(raw), first_of_each_id(raw, broadcast_ids=10)
    a, b = sorted(map(tuple, few.collect())), sorted(map(tuple, many.collect()))
    assert a == b and len(a) == 2000
    assert "wide" not in next(x for x in many._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[1:2])[:200]


def test_stages_can_be_dropped(spark):
    import os

    from siltstone.session import staged, unstage

    a, b = staged(spark.range(3).toDF("x"), "a"), staged(spark.range(2).toDF("x"), "b")
    unstage(a)
    assert not os.path.exists(a._staged_at) and b.count() == 2
    unstage(b)
    assert not os.path.exists(b._staged_at)


# --- batching ---


@given(st.lists(st.integers(0, 9), max_size=12), st.integers(1, 12), st.integers(1, 6))
def test_equal_shares(sizes, limit, n):
    """Each group but the last ends as soon as it has its share, or before it would pass the limit."""
    got = batching.cuts(sizes, limit, n)
    full = batching.max_fill(sizes, limit)
    assert [k for a, b in full for k in range(a, b)] == list(range(len(sizes)))
    for a, b in full:
        assert sum(sizes[a:b]) <= limit or sum(x > 0 for x in sizes[a:b]) == 1
    if got is not None:
        left = sum(sizes)
        assert len(got) == n and [k for a, b in got for k in range(a, b)] == list(range(len(sizes)))
        for g, (a, b) in enumerate(got):
            held = sum(sizes[a:b])
            assert held <= limit or sum(x > 0 for x in sizes[a:b]) == 1
            if g < n - 1 and left:
                assert sum(sizes[a : b - 1]) * (n - g) < left
            left -= held


@given(st.lists(st.integers(1, 100), max_size=60), st.integers(100, 200))
def test_groups(sizes, limit):
    full, even = batching.max_fill(sizes, limit), batching.balanced(sizes, limit)
    assert len(full) == len(even)
    for groups in (full, even):
        assert [k for a, b in groups for k in range(a, b)] == list(range(len(sizes)))
        assert all(sum(sizes[a:b]) <= limit for a, b in groups)
    assert all(batching.by_caps([(1, s) for s in sizes], (5, limit))[k][1] - batching.by_caps([(1, s) for s in sizes], (5, limit))[k][0] <= 5 for k in range(len(batching.by_caps([(1, s) for s in sizes], (5, limit)))))
    assert [k for a, b in batching.halves(0, len(sizes), lambda a, b: sum(sizes[a:b]) <= limit) for k in range(a, b)] == list(range(len(sizes)))


def test_fold_in_the_jvm_equals_the_plain_one(spark):
    r = random.Random(1)
    sizes = [r.randint(1, 60) for _ in range(50)]
    got = spark.createDataFrame([(sizes,)], "s array<int>").select(batching.fold_groups(F.col("s"), 100).alias("g")).first().g
    assert got == [k for k, (a, b) in enumerate(batching.max_fill(sizes, 100)) for _ in range(a, b)]
    assert spark.createDataFrame([([2, 0, 1], ["a", "b", "c"])], "n array<int>, f array<string>").select(batching.regrouped(F.col("n"), F.col("f")).alias("g")).first().g == [["a", "b"], [], ["c"]]


# --- lifecycle ---


def test_transitions(spark):
    v = spark.createDataFrame([("a", "s", 1, "active", True, None), ("b", "s", 2, "building", False, None), ("c", "t", 1, "active", True, None), ("d", "s", 0, "inactive", False, None)], "id string, source_id string, revision int, status string, is_active boolean, ingested_at timestamp")

    def status(df):
        return {r.id: (r.status, r.is_active) for r in df.collect()}

    new = status(lifecycle.finalised(v, "b", "2025-01-01"))
    assert new == {"a": ("inactive", False), "b": ("active", True), "c": ("active", True), "d": ("inactive", False)}
    assert status(lifecycle.finalised(v, "d", "2025-01-01")) == status(v)
    assert status(lifecycle.rolled_back(v, "s", 0, "2025-01-01"))["d"] == ("active", True)
    assert status(lifecycle.rolled_back(v, "s", 9, "2025-01-01")) == status(v)
    assert status(lifecycle.with_status(v, "b", "building", "aborted"))["b"] == ("aborted", False)
    assert status(lifecycle.with_status(v, "a", "building", "aborted")) == status(v)
    assert lifecycle.active_violations(v).count() == 0


def test_keyed_changes(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, t string")
    new = spark.createDataFrame([("b", 5, None), ("c", 6, "z")], "id string, n int, t string")
    assert {tuple(r) for r in lifecycle.upserted(old, new, ["id"]).collect()} == {("a", 1, "x"), ("b", 5, None), ("c", 6, "z")}
    assert {tuple(r) for r in lifecycle.patched(old, new, "id", ["n", "t"]).collect()} == {("a", 1, "x"), ("b", 5, "y")}
    assert [r.id for r in lifecycle.upsert_conflicts(old, new, ["id"], ["n"]).collect()] == ["b"]
    base = str(tmp_path / "t")
    lifecycle.publish(old, base)
    lifecycle.publish(new, base)
    assert {r.id for r in lifecycle.published(spark, base).collect()} == {"b", "c"}
    c = spark.createDataFrame([("a", None, "embed_failed"), ("b", [1.0], "ready")], "id string, embedding array<double>, status string")
    e = {r.id: (r.embedding, r.status) for r in lifecycle.embedded(c, spark.createDataFrame([("a", [2.0]), ("b", [3.0])], "id string, vector array<double>")).collect()}
    assert e == {"a": ([2.0], "ready"), "b": ([1.0], "ready")}


# --- quota ---


@pytest.mark.parametrize("ip,net,inside", [("10.1.2.3", "10.0.0.0/8", True), ("11.0.0.1", "10.0.0.0/8", False), ("1.2.3.4", "1.2.3.4", True), ("1.2.3.4", "0.0.0.0/0", True), ("300.1.1.1", "0.0.0.0/0", False), ("2001:db8::1", "2001:db8::/32", True), ("2001:db9::1", "2001:db8::/32", False), ("2001:db8:8000::1", "2001:db8:8000::/33", True), ("2001:db8::1", "2001:db8:8000::/33", False), ("::1", "::1", True), ("10.0.0.1", "2001:db8::/32", False)])
def test_networks(spark, ip, net, inside):
    assert spark.range(1).select(quota.ip_in(F.lit(ip), F.lit(net)).alias("x")).first().x is inside


def test_buckets():
    tokens, ok, wait = limits.charge(2.0, 0.0, 0.0, 2.0, 2.0)
    assert (tokens, ok) == (0.0, True)
    tokens, ok, wait = limits.charge(tokens, 0.0, 0.25, 2.0, 1.0)
    assert not ok and wait == 1 and tokens == 0.5
    assert limits.charge(tokens, 0.25, 9.0, 2.0, 1.0)[:2] == (1.0, True)
    assert limits.charge(0.5, 0.0, 0.0, 2.0, -5.0)[0] == 2.0
    assert limits.charge(0.0, 0.0, 5.0, 0.0, 1.0) == (0.0, False, 2**63 - 1)


# --- ingest ---


def test_plan(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, content_hash string")
    assert {r.path: r.decision for r in ingest.plan(new, old).collect()} == {"a": "carried", "b": "changed", "c": "new", "d": "deleted"}
    assert [r.path for r in ingest.deleted(new, old).collect()] == ["d"]


def test_vectors(spark):
    c = spark.createDataFrame([("d", 0, "code", "x"), ("d", 1, "markdown", "y")], "document_id string, chunk_index int, kind string, content string")
    v = spark.createDataFrame([("d", 0, [1.0]), ("d", 1, [2.0])], "document_id string, chunk_index int, vector array<double>")
    assert [r.e for r in ingest.attached(c, v, "e", only_code=True).orderBy("chunk_index").collect()] == [[1.0], None]
    assert ingest.vector_mismatches(c, v.where("chunk_index = 0")).count() == 1
    e = sinks.embed_texts(c, "content", "v", sinks.hashed_vectors(8)).first().v
    assert len(e) == 8 and abs(sum(x * x for x in e) - 1) < 1e-6


# --- sources ---


def test_scan(spark, tmp_path):
    for name, body in {"a.md": b"# T\nx\n", "b.ts": b"\0\1", "c.rs": b"\xff\xfe", "d.py": b"x" * 30, "e.go": b"// Code generated by y. DO NOT EDIT.\n", "f.txt": b" \n", "LICENSE": b"MIT", "g.png": b"p"}.items():
        (tmp_path / name).write_bytes(body)
    f = files.read_files(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    got = {r.path: r.skip_reason for r in files.scan(f, max_line_bytes=20).collect()}
    assert got == {"a.md": None, "b.ts": "binary", "c.rs": "not_utf8", "d.py": "long_line", "e.go": "long_line", "f.txt": "empty_no_chunks"}
    assert {r.path: r.skip_reason for r in files.scan(f).collect()}["e.go"] == "generated_file"


def test_ignore_rules(spark):
    rows = spark.createDataFrame([("a/b.log",), ("a/keep.log",), ("out/x.ts",), ("src/out/x.ts",), ("src/a.ts",), (".env",), ("docs/tmp/y",)], "p string")
    got = {r.p for r in rows.where(files.not_ignored(F.col("p"), ["# c", "*.log", "!keep.log", "/out/", "docs/**/y"]) & files.not_hidden(F.col("p"))).collect()}
    assert got == {"a/keep.log", "src/out/x.ts", "src/a.ts"}


def test_cached_rows(spark):
    at = [0.0]
    c = analytics.Cached(lambda: spark.range(1), 60, lambda: at[0])
    first = c.get()
    at[0] = 59
    assert c.get() is first
    at[0] = 60
    assert c.get() is not first


def test_manifest(spark):
    tree = manifest.parse('{"manifest_version": 1, "published_url": "https://d/", "provenance": {"attribution": "partner"}, "children": [{"path": "docs", "exclude": ["*.txt"]}, {"file": "docs/a.md", "provenance": {"attribution": "foundation"}}, {"path": "docs/deep", "no_extract": true}]}')
    listing = spark.createDataFrame([("docs/a.md",), ("docs/b.md",), ("docs/deep/c.md",), ("other/x.md",), ("docs/n.txt",)], "path string")
    got = {r.path: (r.published_url, r.provenance["attribution"], r.no_extract) for r in manifest.resolved(spark, tree, listing).collect()}
    assert got == {"docs/a.md": ("https://d/a/", "foundation", False), "docs/b.md": ("https://d/b/", "partner", False), "docs/deep/c.md": ("https://d/c/", "partner", True)}
    for bad in ('{"manifest_version": 2}', '{"manifest_version": 1, "children": [{"file": "../x"}]}', '{"manifest_version": 1, "children": [{"file": "x"}, {"file": "x"}]}'):
        with pytest.raises(manifest.ManifestError):
            manifest.parse(bad)


def test_pages(spark):
    f = spark.createDataFrame([("docs/guide/start.md",), ("docs/api/start.md",), ("docs/only.md",), ("x/none.md",)], "path string")
    u = spark.createDataFrame([("https://d/docs/guide/start",), ("https://d/docs/api/start/",), ("https://d/only.html",), ("https://e/q/only2",)], "url string")
    assert {r.path: r.url for r in manifest.match_pages(f, u).collect()} == {"docs/guide/start.md": "https://d/docs/guide/start", "docs/api/start.md": "https://d/docs/api/start/", "docs/only.md": "https://d/only.html"}
    g = f.withColumn("slug", F.when(F.col("path") == "x/none.md", "only2"))
    assert {r.path: r.url for r in manifest.match_pages(g, u).collect()}["x/none.md"] == "https://e/q/only2"
    s = spark.createDataFrame([("<urlset><url><loc> https://a/1 </loc></url></urlset>",), ("<sitemapindex xmlns='x'><sitemap><loc>https://a/2.xml</loc></sitemap></sitemapindex>",)], "body string")
    assert {tuple(r) for r in manifest.sitemap_urls(s).collect()} == {("https://a/1", False), ("https://a/2.xml", True)}


def test_packages():
    assert packages.cargo_license('[workspace.package]\nlicense = "MIT"') == ["MIT"] and packages.cargo_license("x = [") == []
    assert packages.npm_license('{"licenses": [{"type": "MIT"}, {"type": "ISC"}]}') == ["MIT", "ISC"]
    assert packages.python_license('[project]\nlicense = {file = "L"}') == []
    assert packages.cargo_dependencies('[dependencies]\nsdk-a = "1"\nsdk-b = {version = "2"}\nsdk-c = {workspace = true}\nother = "1"', '[workspace.dependencies]\nsdk-c = "3"', ("sdk-",)) == [("sdk-a", "1"), ("sdk-b", "2"), ("sdk-c", "3")]
    assert packages.cargo_package("[workspace]\n") is None and packages.npm_package('{"name": "n"}') == ("n", None)
    assert packages.expression("MIT OR (Apache-2.0 AND ISC)") and packages.expression("MIT or later terms") is None


# --- rerank and navigation ---


def test_rerank(spark):
    rows = spark.createDataFrame([("a", 0.5, 0.1, 0.2, 1), ("b", 0.5, 0.1, 0.2, 2), ("c", 0.9, 0.1, 0.3, 3)], "id string, trust double, relevance double, confidence double, rank int")
    s = spark.createDataFrame([("b", 0.9), ("b", 0.9), ("a", 0.8)], "id string, rerank_score double")
    assert [r.id for r in rerank.with_scores(rows, s).orderBy("place").collect()] == ["b", "a", "c"]
    assert [r.id for r in rerank.with_scores(rows, s, order="rerank").orderBy("place").collect()] == ["b", "a", "c"]
    f = {"verified": True, "ingested_at": {"after": "x"}, "language_target": {"any_of": [{"name": "n", "version_satisfies": "1"}]}}
    steps = []
    while (got := rerank.relaxed(f)) and len(steps) < 5:
        steps.append(got[0])
        f = got[1]
    assert steps == ["ingested_at", "verified", "version"]
    assert rerank.relaxed(f) is None and rerank.known_reason("x") == "unavailable"


def test_pages_by_key(spark):
    rows = spark.createDataFrame([(c,) for c in "abcde"], "k string")
    p = navigate.keyset_page(rows, "k", "b", 2).collect()
    assert sorted(r.k for r in p) == ["c", "d"] and all(r.more for r in p)
    with pytest.raises(ValueError):
        navigate.parse_ids(" , ")


def test_repeated_rows_are_filtered_in_place(spark, tmp_path):
    from siltstone import model

    rows = spark.createDataFrame([(f"i{k % 40}", "t" * (k % 40)) for k in range(60)], "id string, content string")
    rows.repartition(3).write.parquet(str(tmp_path / "t"))
    raw = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r.id for r in model.first_of_each_id(raw).collect()) == sorted(f"i{k}" for k in range(40))
    once = raw.where("id = 'i39'")
    assert model.first_of_each_id(once).columns == ["id", "content"]


def test_lookups_and_broken_json(spark):
    from siltstone import model

    src = spark.createDataFrame([("b", "mixed", None), ("a", "mixed", "2024-01-01"), ("c", "docs_site", None)], "slug string, kind string, retired_at string")
    assert [r.slug for r in navigate.list_sources(src, "mixed").collect()] == ["a", "b"]
    assert [r.slug for r in navigate.list_sources(src, retired=False, after="b").collect()] == ["c"]
    rows = spark.createDataFrame([("x",)], "id string")
    assert navigate.exists(rows, "x") and not navigate.exists(rows, "y")
    got = spark.createDataFrame([('{"attribution": "partner", "tags": ["t"], "new": 1}',), ("not json",), (None,)], "j string").select(model.provenance_of(F.col("j")).alias("p")).select("p.attribution", "p.tags").collect()
    assert [tuple(r) for r in got] == [("partner", ["t"]), (None, None), (None, None)]
