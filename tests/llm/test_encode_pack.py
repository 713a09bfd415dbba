import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import encode as E
from siltstone.llm import pack as P

RAW = open(E.RANK_FILE, "rb").read()


@pytest.fixture(scope="module")
def vocabulary():
    return E.Vocabulary(RAW)


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


PIECES = st.sampled_from(["'", "s", "t", "re", "'ll", " ", "  ", "\n", "\t", " ", "a", "Bc", "1", "２", "!", "é", "é", "漢字", "​", "\r\n", "🚀", "_", "<|endoftext|>", "\x1c", " "])


@given(st.lists(PIECES, max_size=30).map("".join))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_reference_and_decode_exactly(text):
    v = E.Vocabulary(RAW) if not hasattr(test_ids_equal_the_reference_and_decode_exactly, "v") else test_ids_equal_the_reference_and_decode_exactly.v
    test_ids_equal_the_reference_and_decode_exactly.v = v
    import tiktoken

    if not hasattr(v, "ref"):
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        v.ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=v.ranks, special_tokens={})
    ids = v.encode(text)
    assert ids == v.ref.encode_ordinary(text)
    assert v.decode_ids(ids) == text.encode()
    off = v.offsets(ids)
    assert len(off) == len(ids) and off == sorted(off)


def test_the_transition_functions_are_closed_and_compose():
    table, product, of_symbol, (nxt, _) = E._monoid()
    assert len(table) < 64 and (product < len(table)).all()
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 1000, 4097):
        sym = r.integers(0, 16, n).astype(np.uint8)
        state, want = 0, []
        for x in sym.tolist():
            want.append(state)
            state = int(nxt[state, x])
        assert E.states_before(sym).tolist() == want


def test_repeated_ids_count_alike_everywhere(spark):
    df = spark.createDataFrame([(1, "b b b"), (1, "a"), (1, None), (2, "c")], "doc_id bigint, text string")
    ids = {r.doc_id: len(r.ids) for r in E.encode_corpus(df, "doc_id", "text").collect()}
    assert ids == {r.doc_id: r.n_tokens for r in E.token_counts(df, "doc_id", "text").collect()} == {1: 1, 2: 1}


def test_long_slices(vocabulary, reference):
    for text in ("ab" * 5000, "x" * 20_000, "漢" * 3000, "=" * 9999, " " * 5000 + "a"):
        assert vocabulary.encode(text) == reference.encode_ordinary(text)


def test_texts_in_a_row_do_not_touch(vocabulary, reference):
    r = random.Random(4)
    texts = ["".join(r.choice(["a", " ", "'s", "\n", "1", "é", ""]) for _ in range(r.randint(0, 5))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    ids, per, _ = vocabulary.encode_buffer(b"".join(raw), np.array([len(x) for x in raw]))
    cut = np.r_[0, np.cumsum(per)]
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [reference.encode_ordinary(t) for t in texts]


def test_corpus_with_nulls_and_repeats(spark, reference):
    rows = [(1, "Hello world's"), (2, None), (3, ""), (4, "twice"), (4, "twice"), (None, "no id"), (5, "y" * 50_000)]
    df = spark.createDataFrame([(*r, [9]) for r in rows], "doc_id bigint, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in E.encode_corpus(df, "doc_id", "text").collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in rows if i is not None}
    assert E.encode_corpus(df, "doc_id", "text").count() == 5
    places = {r.doc_id: (r.ids, r.offsets) for r in E.encode_corpus(df, "doc_id", "text", with_offsets=True).collect()}
    v = E.Vocabulary(RAW)
    assert {i: o for i, (_, o) in places.items()} == {i: v.offsets(ids) for i, ids in got.items()}
    nulls = {r.doc_id: r.ids for r in E.encode_corpus(df, "doc_id", "text", null_as_empty=False).collect()}
    assert nulls[2] is None and nulls[3] == []
    assert E.encode_corpus(df.where("1 = 0"), "doc_id", "text").count() == 0


@given(st.lists(st.integers(1, 2048), max_size=120))
@settings(max_examples=100, deadline=None)
def test_packing_holds_all_and_never_does_worse_than_best_fit(sizes):
    bins = P.bin_completion(sizes, 2048, 300)
    assert sorted(x for b in bins for x in b) == sorted(sizes)
    assert all(sum(b) <= 2048 for b in bins)
    assert P.lower_bound(sizes, 2048) <= len(bins) <= len(P.best_fit_decreasing(sizes, 2048))


@given(st.lists(st.integers(1, 12), min_size=1, max_size=8), st.integers(12, 15))
@settings(max_examples=80, deadline=None)
def test_small_packings_are_optimal(sizes, capacity):
    """Against all ways to fill containers."""

    def best(left: tuple, rooms: tuple) -> int:
        if not left:
            return len(rooms)
        out = best(left[1:], (*rooms, capacity - left[0]))
        for r in set(rooms):
            if r >= left[0]:
                k = rooms.index(r)
                out = min(out, best(left[1:], (*rooms[:k], r - left[0], *rooms[k + 1 :])))
        return out

    least = best(tuple(sorted(sizes, reverse=True)), ())
    assert P.lower_bound(sizes, capacity) <= least == len(P.bin_completion(sizes, capacity))


def test_completion_beats_best_fit():
    sizes = [6, 5, 5, 4, 3, 3, 2, 2]  # 30 in containers of 10
    assert len(P.bin_completion(sizes, 10)) == 3


def test_completion_of_full_containers_of_three():
    r = random.Random(29)
    n, capacity, sizes = r.randint(10, 40), r.choice([200, 1000, 2048]), []
    for _ in range(n):
        a = r.randint(int(capacity * 0.38), int(capacity * 0.49))
        b = r.randint(int((capacity - a) * 0.42), int((capacity - a) * 0.49))
        sizes += [a, b, capacity - a - b]
    assert len(P.best_fit_decreasing(sizes, capacity)) > n
    assert len(P.bin_completion(sizes, capacity)) == n
    assert len(P.bin_completion(sizes, capacity, most=1, keep=1)) > n  # the bounds are parameters


def test_documents_come_out_in_full(spark):
    rows = [(k, "word " * (k * 7 % 900)) for k in range(300)] + [(1000, "tok " * 9000), (1001, None), (1002, ""), (5, "word " * 35)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, part int")
    sized = {r.doc_id: r.n_tokens for r in E.token_counts(df, "doc_id", "text").collect()}
    got = P.pack_documents(df, "doc_id", "text", shard_items=128).collect()
    used, parts = {}, {}
    for r in got:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append(r)
    assert max(used.values()) <= 2048
    for d, rs in parts.items():
        rs.sort(key=lambda r: r.part)
        assert sum(r.n_tokens for r in rs) == sized[d]
        assert len(rs) == 1 or sized[d] > 2048
        assert [r.first_token for r in rs] == [2048 * k for k in range(len(rs))]
    assert set(parts) == set(sized)
    assert P.pack_documents(df.where("1 = 0"), "doc_id", "text").count() == 0
