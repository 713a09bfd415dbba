"""Splitting oversized texts by content-defined chunking that snaps to natural boundaries.

A token is a run of ASCII letters, digits and underscores, or any other single character that is
not white space. A text above `max_tokens` is cut into pieces of at most `max_tokens` tokens;
each piece after the first begins with the last `overlap` tokens of the one before.

Where to cut: a rolling hash over the last tokens sets landmarks that depend on content only. From
one cut on, the first landmark beyond the minimum size is taken and moved to the nearest natural
boundary (heading or symbol of the row's paths, blank line, line, sentence, white space; stronger
kinds first) between minimum and maximum size. So an edit changes the pieces around it, and the
later ones fall on the same landmarks again. Where no boundary lies between minimum and maximum, the
last one below the minimum is taken; a stretch is cut inside only if it doesn't fit beside the overlap.

Columns out: id, piece, n_pieces, text, n_tokens, start_char, fresh_char, end_char (code points;
text[fresh_char:end_char] of all pieces in order is the text), boundary (what the piece ends at),
cut ('none' for texts within the limit, 'forced' if a cut lies in a stretch without white space that
alone exceeds the limit, else 'boundary').

Defined cases: null texts give no row; empty and small texts one piece with cut 'none'. Repeated
rows count once per id and text. Null or empty paths mean no such boundary. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import ship, table

TOKEN = re.compile(r"[A-Za-z0-9_]+|\S")
KINDS = ["forced", "space", "sentence", "line", "blank", "symbol", "heading", "end"]
FORCED, SPACE, SENTENCE, LINE, BLANK, SYMBOL, HEADING, END = range(8)
_HEADING = re.compile(r"(?m)^[ \t]{0,3}#{1,6}[ \t]+(.*?)[ \t#]*$")
_SENTENCE_ENDS = frozenset(".!?。！？;；")
_SPACES = re.compile(r"\s+")
WINDOW = 8
LANDMARK_MASK = 0xFF  # one landmark in 256 tokens on average


def token_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the tokens."""
    flat = np.fromiter((p for m in TOKEN.finditer(text) for p in m.span()), np.int64)
    return flat[0::2], flat[1::2]


def stretch_sizes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens of the stretch without white space that each token is in."""
    if not len(starts):
        return np.zeros(0, np.int64)
    of = np.r_[0, np.cumsum(starts[1:] != ends[:-1])]
    return np.bincount(of)[of]


def boundaries(text: str, starts: np.ndarray, ends: np.ndarray, headings: list[str], symbols: list[str]) -> np.ndarray:
    """Kind of boundary before each token."""
    n = len(starts)
    rank = np.zeros(n + 1, np.int8)
    gap = np.flatnonzero(starts[1:] != ends[:-1]) + 1
    rank[gap] = SPACE
    for i in gap.tolist():
        between = text[ends[i - 1] : starts[i]]
        lines = between.count("\n") or between.count("\r")
        if lines:
            rank[i] = BLANK if lines > 1 else LINE
        elif text[ends[i - 1] - 1] in _SENTENCE_ENDS:
            rank[i] = SENTENCE
    wide = np.flatnonzero(starts[1:] == ends[:-1]) + 1  # scripts without spaces end sentences by a mark
    for i in wide.tolist():
        if text[starts[i] - 1] in "。！？":
            rank[i] = SENTENCE
    marks = [(m.start(), HEADING) for m in _HEADING.finditer(text)]
    for names, kind in ((headings, HEADING), (symbols, SYMBOL)):
        for name in {x for x in names if x and x.strip()}:
            for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", text):
                line = max(text.rfind("\n", 0, m.start()), text.rfind("\r", 0, m.start())) + 1
                before = text[line : m.start()].strip()
                if kind == HEADING and not before.strip("#*-= \t"):
                    marks.append((line, kind))
                elif kind == SYMBOL and re.fullmatch(r"[A-Za-z_\s]*\b(?:fn|func|function|def|class|struct|enum|trait|impl|interface|type|circuit|const|let|var|static|export|pub|module|ledger|witness)\b[A-Za-z_\s]*", before):
                    marks.append((line, kind))
    if marks:
        pos = np.searchsorted(starts, np.array([p for p, _ in marks]))
        for i, (_, kind) in zip(pos.tolist(), marks, strict=True):
            if 0 < i < n and rank[i] > FORCED:
                rank[i] = max(rank[i], kind)
    rank[n] = END
    return rank


def landmarks(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Token positions where the rolling hash of the last WINDOW tokens has zero low bits."""
    h = np.fromiter((zlib.crc32(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    roll = np.zeros(len(h), np.uint64)
    for k in range(min(WINDOW, len(h))):
        roll[k:] = roll[k:] * np.uint64(0x9E3779B97F4A7C15) + h[: len(h) - k]
    roll ^= roll >> np.uint64(29)
    roll *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((roll >> np.uint64(40)) & np.uint64(LANDMARK_MASK) == 0)


def cut_points(rank: np.ndarray, marks: np.ndarray, n: int, max_tokens: int, overlap: int) -> list[tuple[int, int]]:
    """(token position, kind) of every cut; the last is (n, END)."""
    cuts: list[tuple[int, int]] = []
    at, room = 0, max_tokens
    while n - at > room:
        lo, hi = at + max(1, room // 4), at + room
        k = np.searchsorted(marks, lo)
        want = int(marks[k]) if k < len(marks) and marks[k] <= hi else hi
        near = np.arange(lo, hi + 1)
        kinds = rank[lo : hi + 1]
        dist = np.abs(near - want)
        best = None
        for ok in ((kinds >= BLANK) & (dist <= 128), (kinds >= LINE) & (dist <= 128), kinds >= BLANK, kinds >= LINE, kinds >= SENTENCE, kinds >= SPACE):
            if ok.any():
                best = int(near[ok][np.argmin(dist[ok])])
                break
        if best is None:  # a short piece rather than a cut inside of a stretch
            early = np.flatnonzero(rank[at + 1 : lo] >= SPACE)
            best = at + 1 + int(early[-1]) if len(early) else want
        cuts.append((best, int(rank[best])))
        at, room = best, max_tokens - overlap
    cuts.append((n, END))
    return cuts


def split_text(text: str, headings: list[str] | None = None, symbols: list[str] | None = None, max_tokens: int = 1024, overlap: int = 64) -> list[tuple]:
    """(piece, n_pieces, text, n_tokens, start_char, fresh_char, end_char, boundary, cut) of one text."""
    starts, ends = token_spans(text)
    n = len(starts)
    if n <= max_tokens:
        return [(0, 1, text, n, 0, 0, len(text), KINDS[END], "none")]
    cuts = cut_points(boundaries(text, starts, ends, headings or [], symbols or []), landmarks(text, starts, ends), n, max_tokens, overlap)
    # a stretch above the limit is in no piece as a whole, so some cut lies inside of it
    inside = [c for c, _ in cuts if c < n and starts[c] == ends[c - 1]]
    cut = "forced" if (stretch_sizes(starts, ends)[inside] > max_tokens).any() else "boundary"
    out, prev, fresh = [], 0, 0
    for k, (c, kind) in enumerate(cuts):
        first = max(0, prev - overlap) if k else 0
        a = int(starts[first]) if k else 0
        b = int(starts[c]) if c < n else len(text)
        out.append((k, len(cuts), text[a:b], c - first, a, fresh, b, KINDS[kind], cut))
        prev, fresh = c, b
    return out


_FIELDS = [("id", pa.string()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("text", pa.string()), ("n_tokens", pa.int32()), ("start_char", pa.int32()), ("fresh_char", pa.int32()), ("end_char", pa.int32()), ("boundary", pa.string()), ("cut", pa.string())]
SCHEMA = "id string, piece int, n_pieces int, text string, n_tokens int, start_char int, fresh_char int, end_char int, boundary string, cut string"


def _split_batches(max_tokens: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, t, h, s in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                rows += [(i, *p) for p in split_text(t, h, s, max_tokens, overlap)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _FIELDS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

    return run


def split_oversized(df: DataFrame, id_col: str, text_col: str, headings: Column | None = None, symbols: Column | None = None, max_tokens: int = 1024, overlap: int = 64, only_oversized: bool = False, distinct: bool = True) -> DataFrame:
    """The pieces of every text. `headings` and `symbols` are array<string> columns of `df`.
    With `only_oversized` texts within the limit are left out; those with at most `max_tokens`
    code points never reach Python. Without `distinct` repeated rows give their pieces again, for
    callers that reduce the columns first."""
    ship(df.sparkSession)
    if not 0 <= overlap < max_tokens // 2:
        raise ValueError("the overlap must be below half of max_tokens")
    empty = F.array().cast("array<string>")
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), (empty if headings is None else headings.cast("array<string>")).alias("h"), (empty if symbols is None else symbols.cast("array<string>")).alias("s")).where("text is not null")
    if only_oversized:
        src = src.where(F.length("text") > max_tokens)
    out = src.mapInArrow(_split_batches(max_tokens, overlap), SCHEMA)
    if only_oversized:
        out = out.where("n_pieces > 1")
    return out.dropDuplicates(["id", "piece", "start_char", "end_char", "text"]) if distinct else out


def _chunk_pieces(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    chunks = table(spark, sf_dir, "chunk")
    return split_oversized(chunks, "id", "content", F.col("heading_path"), F.transform("symbol_path", lambda s: s["name"]), only_oversized=True, distinct=distinct)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_pieces(spark, sf_dir, distinct=False).select("id", "cut").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_pieces(spark, sf_dir)
