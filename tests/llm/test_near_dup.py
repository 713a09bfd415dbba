import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import near_dup as N


def brute(rows, width, threshold):
    sets = {}
    for i, t in rows:
        if i is not None and t is not None:
            w = N.WORD.findall(t.lower())
            sets[i] = (frozenset(zip(*(w[k:] for k in range(width)), strict=False)), t)
    out = set()
    for (a, (x, tx)), (b, (y, ty)) in itertools.combinations(sorted(sets.items()), 2):
        if tx == ty or (x and y and len(x & y) / len(x | y) >= threshold):
            out.add((a, b))
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(n):
        if rows and r.random() < 0.6:
            base = r.choice(rows)[1].split()
            for _ in range(r.randint(0, 3)):
                p = r.randrange(len(base) + 1)
                base[p : p + r.randint(0, 1)] = [r.choice(words)] * r.randint(0, 2)
            t = " ".join(base) or "w1"
        else:
            t = " ".join(r.choice(words) for _ in range(r.randint(1, 60)))
        rows.append((f"d{k:03}", t))
    return rows


@pytest.mark.parametrize("kw", [{}, {"hot": 3, "tile": 4}])
def test_pairs_equal_brute_force(spark, kw):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "id string, text string")
    got = {tuple(r) for r in N.near_duplicate_pairs(df, "id", "text", 3, 0.7, slots_log2=18, **kw).collect()}
    assert got == brute(rows, 3, 0.7)
    assert len(got) > 50


def test_hot_template_is_spread_without_loss(spark):
    base = [f"t{k}" for k in range(40)]
    rows = [(f"h{k:03}", " ".join([*base[: k % 7], f"x{k}", *base[k % 7 :]])) for k in range(90)]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {tuple(r) for r in N.near_duplicate_pairs(df, "id", "text", 3, 0.7, slots_log2=18, hot=16, tile=8).collect()}
    assert got == brute(rows, 3, 0.7)


def test_dirty_rows(spark):
    rows = [("a", None), ("b", ""), ("c", ""), ("d", "two words"), ("e", "Two Words"), ("f", "two words"), (None, "x y z w"), ("g", "x y z w"), ("g", "x y z w"), ("h", "X, y; Z_w"), ("i", "long " * 30_000)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "id string, text string, sid int, token string")
    got = {tuple(r) for r in N.near_duplicate_pairs(df, "id", "text", 3, 0.7, slots_log2=18).collect()}
    assert got == {("b", "c"), ("d", "f"), ("g", "h")}
    assert N.near_duplicate_pairs(df.where("1 = 0"), "id", "text", slots_log2=18).count() == 0


def test_groups_and_links(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "id string, text string")
    pairs = brute(rows, 3, 0.7)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    got = {r.id: r for r in N.near_duplicate_groups(df, "id", "text", 3, 0.7, slots_log2=18).collect()}
    assert len(got) == len(rows)
    for a, b in itertools.combinations(got, 2):
        assert (got[a].group_id == got[b].group_id) == (find(a) == find(b))
    for i in got:
        assert got[i].n_links == sum(i in p for p in pairs)


@given(st.sets(st.integers(0, 2**63), min_size=1, max_size=80), st.sets(st.integers(0, 2**63), min_size=1, max_size=80))
@settings(max_examples=200, deadline=None)
def test_bitmap_never_counts_more_than_the_sets_differ(a, b):
    x, y = (np.unique(np.array(sorted(s), np.uint64)) for s in (a, b))
    bits = np.bitwise_count(np.frombuffer(N.sketch(x), np.uint8) ^ np.frombuffer(N.sketch(y), np.uint8)).sum()
    assert bits <= len(a ^ b)


@given(st.integers(1, 300), st.floats(0.5, 0.95))
def test_prefixes_of_similar_sets_meet(n, t):
    p = N.prefix_length(n, t)
    assert 1 <= p <= n
    # a set of n elements that shares no prefix element shares at most n - p of them
    assert (n - p) < t * n


def test_components_that_do_not_settle_are_an_error(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a int, b int")
    with pytest.raises(RuntimeError):
        N.components(path, max_rounds=2)
    assert {(r.node, r.root) for r in N.components(path).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_hot_shingle_is_spread_before_the_shuffle(spark):
    """No bucket of a shingle in every row holds more than its two groups."""
    import pyarrow as pa

    texts = [" ".join([f"t{k}" for k in range(30)] + [f"x{k}y"]) for k in range(600)]
    counts = list(N._count_pass(3, 18)(iter([pa.RecordBatch.from_pydict({"id": [str(k) for k in range(600)], "text": texts})])))
    blocks = [(r["blk"], r["cnt"]) for b in counts for r in b.to_pylist() if r["blk"] is not None]

    class Held:
        value = blocks

    rows = [r for b in N._prefix_pass(3, 0.7, 18, 50, Held)(iter([pa.RecordBatch.from_pydict({"id": [str(k) for k in range(600)], "text": texts})])) for r in b.to_pylist()]
    sizes = {}
    for r in rows:
        sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + 1
    assert max(sizes.values()) <= 3 * 50 and len(sizes) > 60


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 9), st.integers(0, 2**64 - 1)), max_size=60), st.sampled_from([2, 4, 8]))
@settings(max_examples=60, deadline=None)
def test_tiles_compare_every_pair_of_a_bucket(rows, tile):
    rows.sort()
    bucket, n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32)
    sk = np.array([[r[2]] for r in rows], np.uint64).reshape(-1, 1)
    got = set(zip(*(x.tolist() for x in N.tile_pairs(bucket, n, sk, np.zeros(len(rows), np.int8), 0.5, tile)), strict=True))
    want = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if bucket[i] == bucket[j] and n[i] >= 0.5 * n[j] and (rows[i][2] ^ rows[j][2]).bit_count() <= N.radius(n[i], n[j], 0.5)}
    assert got == want


def test_counters_keep_small_counts_and_never_saturate():
    assert N.encoded(np.arange(16.0)).tolist() == list(range(16))
    big = N.encoded(np.array([1e3, 1e6, 1e9, 1e12]))
    assert (np.diff(big.astype(int)) > 20).all() and big.max() < 255


def test_copies_are_paired_in_blocks(spark):
    members = spark.createDataFrame([(f"i{k:02}", b"a" if k < 20 else b"b") for k in range(30)] + [("z", b"c")], "id string, sid binary")
    links = spark.createDataFrame([(b"a", b"b")], "a binary, b binary")
    got = {tuple(r) for r in N.expanded(members, links, block=3).collect()}
    assert got == {(f"i{x:02}", f"i{y:02}") for x, y in itertools.combinations(range(30), 2)}
