"""Encoding a corpus with a public byte-level BPE vocabulary.

Pre-tokenisation works on whole batches as arrays, without regular expressions:

1. The UTF-8 buffer of the batch is read as one array of code points; one table maps each to its
   class (letter, number, white space, other). With what a look at the next characters tells (the last
   of a run of white space, an apostrophe before s, t, re, ve, m, ll or d, the begin of a text) the
   class becomes one of 16 symbols.
2. A symbol is a function on the 8 states of the pre-tokeniser (which slice is open). All functions that
   symbols make by composition are a small finite set, so composing two is one look-up, and as it is
   associative the buffer is scanned in blocks at once: functions of blocks, states at their begins,
   states inside. A slice starts where state and symbol say so.
3. The begin of a text is a constant function, so texts are scanned together and don't touch.

The slices feed a cache from slice to ids; a slice not seen before is merged pair by pair, lowest
rank first. The slices' places are kept: `with_offsets` gives the byte where each id begins.
`decode_ids` gives back every byte.

Defined ids: a null text gives null ids or, with `null_as_empty` (the default), an empty list; an
empty text gives an empty list. Repeated ids of documents give one row (equal rows count once; of
different texts under one id the smallest is taken, by every operator here). Extra columns are
ignored; an empty table gives no rows. The strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import ship, staged, table

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_SLICES = 400_000
STEP_BYTES = 4 << 20  # slices of a batch that are worked on at once
SPACE, LETTER, NUMBER, REST = 0, 1, 2, 3
# Code points with the White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point; built once in a process."""
    if not _CLASSES:
        t = np.full(0x110000, REST, np.uint8)
        kind = {"L": LETTER, "N": NUMBER}
        for block in (range(0x40000), range(0xE0000, 0xE1000)):
            got = np.fromiter((kind.get(unicodedata.category(chr(c))[0], REST) for c in block), np.uint8, len(block))
            t[block.start : block.stop] = got
        t[WHITE_SPACE] = SPACE
        _CLASSES.append(t)
    return _CLASSES[0]


# States: no slice open; a run of letters, numbers, other marks or white space; a space that joins what
# follows; one or two letters of a contraction to come.
_END, _L, _N, _P, _W, _SP, _K1, _K2 = range(8)
# Symbols: letter, number, mark, apostrophe of a contraction of two or three characters, white space inside
# of its run, the last one of a run before other text: a space, and another. From 8 on: the same, first in a text.
_LETTER, _NUMBER, _MARK, _TWO, _THREE, _INNER, _JOINS, _ALONE = range(8)
_FIRST = 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a slice starts here)."""
    if symbol >= _FIRST:
        state, symbol = _END, symbol - _FIRST
    if symbol == _INNER:
        return _W, state != _W
    if symbol in (_JOINS, _ALONE):
        return (_SP if symbol == _JOINS else _END), True
    if symbol in (_TWO, _THREE) and state not in (_P, _SP):
        return (_K1 if symbol == _TWO else _K2), True
    if symbol == _LETTER and state in (_K1, _K2):
        return (_END if state == _K1 else _K1), False
    run = {_LETTER: _L, _NUMBER: _N}.get(symbol, _P)
    return run, state not in (run, _SP)


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(functions by number as tables, numbers of the products of two, numbers of the symbols, next states
    and starts): all compositions of the symbols' functions."""
    nxt, out = np.zeros((8, 16), np.uint8), np.zeros((8, 16), bool)
    for st in range(8):
        for x in range(16):
            nxt[st, x], out[st, x] = _step(st, x)
    known: dict[tuple, int] = {}
    of_symbol = np.zeros(16, np.int64)
    for x in range(16):
        of_symbol[x] = known.setdefault(tuple(nxt[:, x].tolist()), len(known))
    todo = list(known)
    while todo:  # closed under composition
        f = todo.pop()
        for g in list(known):
            for h in (tuple(g[i] for i in f), tuple(f[i] for i in g)):
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    table = np.array(list(known), np.uint8)
    product = np.array([[known[tuple(g[i] for i in f)] for g in known] for f in known], np.uint16)
    return table, product, of_symbol, np.stack([nxt, out.astype(np.uint8)])


_MONOID: list[tuple] = []


def states_before(sym: np.ndarray) -> np.ndarray:
    """State before each symbol, by a scan of composed transition functions: inside of blocks for all
    blocks at once, then over the blocks, then inside of them again with the state at their begin."""
    if not _MONOID:
        _MONOID.append(_monoid())
    table, product, of_symbol, (nxt, _) = _MONOID[0]
    n = len(sym)
    width = max(1, int(n**0.5))
    blocks = -(-n // width)
    grid = np.zeros(blocks * width, sym.dtype)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)  # a row holds one place of every block
    f = of_symbol[grid[0]]
    for row in grid[1:]:
        f = product[f, of_symbol[row]]
    begin, at = np.zeros(blocks, np.uint8), _END
    for k, g in enumerate(table[f].tolist()):
        begin[k] = at
        at = g[at]
    out = np.empty((width, blocks), np.uint8)
    for k, row in enumerate(grid):
        out[k] = begin
        begin = nxt[begin, row]
    return np.ascontiguousarray(out.T).ravel()[:n]


def symbols_of(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each code point."""
    n = len(cp)
    c = classes()[cp]
    white, more = c == SPACE, ~np.r_[first[1:], True]  # more: the text goes on
    last = white & more & np.r_[c[1:] != SPACE, False]
    sym = np.array([_INNER, _LETTER, _NUMBER, _MARK], np.uint8)[c]
    sym[last] = np.where(cp[last] == 32, _JOINS, _ALONE)
    q = np.flatnonzero((cp == 39) & more)
    if len(q):
        a = cp[q + 1]
        b = np.where(more[q + 1], cp[np.minimum(q + 2, n - 1)], 0)
        two = np.isin(a, [ord(x) for x in "stmd"])
        three = (np.isin(a, [ord("r"), ord("v")]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        sym[q[two]], sym[q[three]] = _TWO, _THREE
    sym[first] += _FIRST
    return sym


def slice_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Start flags of the slices. `cp`: code points of texts in a row; `first`: flags of the
    positions where a text begins."""
    if not len(cp):
        return np.zeros(0, bool)
    sym = symbols_of(cp, first)
    before = states_before(sym)
    return _MONOID[0][3][1][before, sym].astype(bool)


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary and the cache of merged slices."""

    def __init__(self, rank_lines: bytes):
        pairs = (line.split() for line in rank_lines.splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice: the adjacent pair of lowest rank is merged first, leftmost on ties."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        if n <= 48:
            parts = [piece[i : i + 1] for i in range(n)]
            scores = [ranks.get(piece[i : i + 2], 1 << 30) for i in range(n - 1)]
            while scores:
                low = min(scores)
                if low == 1 << 30:
                    break
                i = scores.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del scores[i]
                if i < len(scores):
                    scores[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
                if i:
                    scores[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
            return tuple(map(ranks.__getitem__, parts))
        # long slices: a heap over a linked list, near-linear in the length
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, m, e = heapq.heappop(heap)
            if not alive[i] or end[i] != m or m >= n or not alive[m] or end[m] != e:
                continue
            alive[m], end[i] = False, e
            if e < n:
                before[e] = i
                if (r := ranks.get(piece[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, e, end[e]))
            p = before[i]
            if p >= 0 and (r := ranks.get(piece[p:e])) is not None:
                heapq.heappush(heap, (r, p, i, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def slices(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        cache = self.cache
        for p in set(pieces).difference(cache):
            ids = self.merge(p)
            if len(p) <= 64:
                cache[p] = ids
            else:
                cache.setdefault(p, ids)
        got = [cache[p] for p in pieces]
        if len(cache) > CACHE_SLICES:
            cache.clear()
        return got

    def encode_buffer(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text, byte of the buffer where each slice
        begins and number of its ids). `data`: the UTF-8 texts in a row; `sizes`: their bytes."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64), np.zeros((2, 0), np.int64)
        cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(data, np.uint8)
        at_byte = np.flatnonzero((raw & 0xC0) != 0x80)  # byte where each code point begins
        begins = np.r_[0, np.cumsum(sizes)]
        first = np.zeros(len(cp) + 1, bool)
        first[np.searchsorted(at_byte, begins[:-1])] = True  # empty texts share a place
        at = at_byte[np.flatnonzero(slice_starts(cp, first[:-1]))]
        ends = np.r_[at[1:], len(data)].tolist()
        got = self.slices([data[a:b] for a, b in zip(at.tolist(), ends, strict=True)])
        counts = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(got), np.int32, int(counts.sum()))
        per = np.add.reduceat(np.r_[counts, 0], np.minimum(np.searchsorted(at, begins[:-1]), len(counts)))
        per[sizes == 0] = 0
        return ids, per, np.stack([at, counts])

    def id_bytes(self) -> np.ndarray:
        """Bytes of each id."""
        if not hasattr(self, "_lengths"):
            self._lengths = np.zeros(max(self.ranks.values()) + 1, np.int32)
            for k, v in self.ranks.items():
                self._lengths[v] = len(k)
        return self._lengths

    def id_offsets(self, ids: np.ndarray, per: np.ndarray, slices: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Byte of its text where each id begins: the begin of its slice, and the ids of the slice before it."""
        n = self.id_bytes()[ids].astype(np.int64)
        before = np.cumsum(n) - n
        at, counts = slices
        some = counts > 0
        inside = before - np.repeat(before[(np.cumsum(counts) - counts)[some]], counts[some])
        return np.repeat(at, counts) + inside - np.repeat(np.cumsum(sizes) - sizes, per)

    def encode(self, text: str) -> list[int]:
        data = text.encode("utf-8", "replace")
        return self.encode_buffer(data, np.array([len(data)]))[0].tolist()

    def decode_ids(self, ids: list[int]) -> bytes:
        by_id = self.__dict__.setdefault("_bytes", {v: k for k, v in self.ranks.items()})
        return b"".join(by_id[i] for i in ids)

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte of the text where each id begins."""
        n = self.id_bytes()[np.asarray(ids, np.int64)]
        return (np.cumsum(n) - n).tolist()


def column_bytes(col: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(UTF-8 of the texts in a row, bytes of each, null flags) of a string column."""
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = bytes(col.buffers()[2][int(off[0]) : int(off[-1])]) if col.buffers()[2] is not None else b""
    null = ~np.asarray(col.is_valid())
    sizes = np.diff(off)
    if (sizes[null] > 0).any():  # bytes under a null
        keep = np.repeat(~null, sizes)
        data, sizes = np.frombuffer(data, np.uint8)[keep].tobytes(), np.where(null, 0, sizes)
    return data, sizes, null


def steps(sizes: np.ndarray) -> Iterator[slice]:
    """Ranges of rows of about STEP_BYTES."""
    if len(sizes):
        group = (np.cumsum(sizes) - sizes) // STEP_BYTES
        cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(sizes)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield slice(int(a), int(b))


_VOCABULARIES: dict[int, Vocabulary] = {}


def vocabulary(lines_b) -> Vocabulary:
    """The vocabulary of a broadcast rank file; one a process, with its cache."""
    key = hash(lines_b.value[:4096]) ^ len(lines_b.value)
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(lines_b.value)
    return _VOCABULARIES[key]


def _encode_batches(lines_b, counts_only: bool, with_offsets: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(lines_b)
        for b in batches:
            data, sizes, _ = column_bytes(b.column(1))
            begins = np.r_[0, np.cumsum(sizes)]
            for s in steps(sizes):
                ids, per, slices = v.encode_buffer(data[begins[s.start] : begins[s.stop]], sizes[s])
                key = b.column(0).slice(s.start, s.stop - s.start)
                if counts_only:
                    out = pa.array(per.astype(np.int32))
                else:
                    cuts = pa.array(np.r_[0, np.cumsum(per)].astype(np.int32))
                    out = pa.ListArray.from_arrays(cuts, pa.array(ids))
                if with_offsets:
                    places = pa.array(v.id_offsets(ids, per, slices, sizes[s]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([key, out, pa.ListArray.from_arrays(cuts, places)], names=["doc_id", "ids", "offsets"])
                    continue
                yield pa.RecordBatch.from_arrays([key, out], names=["doc_id", "ids"])

    return run


def read_ranks(spark: SparkSession, rank_file: str):
    """The rank file (under 1 MB), sent once to every executor."""
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, id_col: str, text_col: str, rank_file: str = RANK_FILE, null_as_empty: bool = True, with_offsets: bool = False) -> DataFrame:
    """(doc_id, ids): the ids of every text, without special tokens; `with_offsets` adds offsets, the byte
    of the UTF-8 text where each id begins."""
    spark = ship(df.sparkSession)
    lines_b = read_ranks(spark, rank_file)
    schema = "doc_id bigint, ids array<int>" + (", offsets array<int>" if with_offsets else "")
    one = distinct_texts(df, id_col, text_col)
    if null_as_empty:
        return one.mapInArrow(_encode_batches(lines_b, False, with_offsets), schema)
    done = one.where("text is not null").mapInArrow(_encode_batches(lines_b, False, with_offsets), schema)
    return done.unionByName(one.where("text is null").select("doc_id", F.lit(None).cast("array<int>").alias("ids")), allowMissingColumns=True)


def distinct_texts(df: DataFrame, id_col: str, text_col: str, broadcast_ids: int = 100_000) -> DataFrame:
    """(doc_id, text), one row per non-null id. Only ids are shuffled to find the repeated ones;
    texts move only where their id repeats. Up to `broadcast_ids` repeated ids are broadcast
    (0.8 MB at the default), more are joined."""
    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    again = staged(src.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    n = again.count()
    if not n:
        return src
    again = F.broadcast(again) if n <= broadcast_ids else again
    once = src.join(again, "doc_id", "left_anti")
    return once.unionByName(src.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


def token_counts(df: DataFrame, id_col: str, text_col: str, rank_file: str = RANK_FILE) -> DataFrame:
    """(doc_id, n_tokens): 0 for null and empty texts."""
    lines_b = read_ranks(ship(df.sparkSession), rank_file)
    one = distinct_texts(df, id_col, text_col)
    return one.mapInArrow(_encode_batches(lines_b, True), "doc_id bigint, ids int").withColumnRenamed("ids", "n_tokens")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
