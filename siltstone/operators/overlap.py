"""Overlap trimming: results of one document, best rank first, keep only text not yet covered.

The folds over a document depend on its order and run on arrays of numbers in Arrow batches; texts are
cut in the JVM. `covered_spans` is the part a window can do."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import ship

ELISION = "\n…\n"  # fixed value: marks left-out text


def free_parts(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of [start, end) outside of the taken spans, which are sorted and don't touch."""
    first = bisect_right(taken, (start, start)) - 1
    first += first < 0 or taken[first][1] <= start
    parts = []
    for a, b in taken[first : bisect_left(taken, (end, end))]:
        if start < a:
            parts.append((start, a))
        start = b
    return parts + [(start, end)] if start < end else parts


def with_span(taken: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """The sorted spans with one more, merged where they touch; the list is changed in place."""
    if start < end:
        i = bisect_left(taken, start, key=lambda s: s[1])
        j = bisect_right(taken, end, key=lambda s: s[0])
        near = taken[i:j]
        taken[i:j] = [(min(start, near[0][0]), max(end, near[-1][1]))] if near else [(start, end)]
    return taken


def new_parts(spans: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """For spans in rank order, the parts of each that no better-ranked one holds."""
    taken: list[tuple[int, int]] = []
    out = []
    for start, end in spans:
        out.append(free_parts(start, end, taken))
        with_span(taken, start, end)
    return out


def trim(rows: list[tuple[int, int, str]]) -> list[str | None]:
    """Contents of (start, end, content) rows in rank order after the trim; None is dropped: the same
    rule as `trim_overlaps`, for a list in memory."""
    out: list[str | None] = []
    for (start, end, content), parts in zip(rows, new_parts([(a, b) for a, b, _ in rows]), strict=True):
        raw = content.encode("utf-8")
        if parts and parts != [(start, end)] and len(raw) == end - start:
            content = ELISION.join(raw[a - start : b - start].decode("utf-8", "ignore") for a, b in parts)
        out.append(content if parts and (content.strip() or parts == [(start, end)] or len(raw) != end - start) else None)
    return out


def trim_overlaps(results: DataFrame, list_cols: list[str], rank_col: str = "rank") -> DataFrame:
    """`results` (document_id, start_byte, end_byte, content, rank, ...) per list with content
    trimmed, rows without new text dropped, and `trimmed` telling what was cut. Only content as long as
    its span (in bytes) is cut; another kind stays whole if any of it is new.

    Rows without a span stay as they are. The fold sees two numbers a row, as arrays of a document in
    Arrow batches; texts never leave the JVM."""
    ship(results.sparkSession)
    key = [*list_cols, "document_id"]
    place = F.struct(F.col(rank_col).alias("r"), F.col("start_byte").cast("bigint").alias("a"), F.col("end_byte").cast("bigint").alias("b"))
    each = results.select(*key, place.alias("p")).where("p.a IS NOT NULL AND p.b IS NOT NULL").groupBy(*key).agg(F.array_sort(F.collect_set("p")).alias("ps"))
    spans = each.select(F.struct(*key).alias("key"), "ps")
    types = dict(spans.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
        for b in batches:
            got = [[[{"a": x, "b": y} for x, y in parts] for parts in new_parts([(p["a"], p["b"]) for p in ps])] for ps in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, kind)], names=["key", "ps", "parts"])

    free = spans.mapInArrow(run, f"key {types['key']}, ps {types['ps']}, parts array<array<struct<a:bigint,b:bigint>>>")
    free = free.select("key.*", F.explode(F.arrays_zip("ps", "parts")).alias("z")).select(*key, F.col("z.ps.r").alias(rank_col), F.col("z.ps.a").alias("start_byte"), F.col("z.ps.b").alias("end_byte"), F.col("z.parts").alias("_parts"))
    out = results.join(free, [*key, rank_col, "start_byte", "end_byte"])
    whole = (F.size("_parts") == 1) & (F.col("_parts")[0]["a"] == F.col("start_byte")) & (F.col("_parts")[0]["b"] == F.col("end_byte"))
    cut = ~whole & (F.octet_length("content") == F.col("end_byte") - F.col("start_byte"))
    raw = F.encode("content", "UTF-8")
    text = F.array_join(F.transform("_parts", lambda p: whole_characters(F.substring(raw, (p["a"] - F.col("start_byte") + 1).cast("int"), (p["b"] - p["a"]).cast("int")))), ELISION)
    out = out.where(F.size("_parts") > 0).withColumn("_text", F.when(cut, text).otherwise(F.col("content"))).where(~cut | F.col("_text").rlike(r"\S"))
    out = out.select(*[F.col("_text").alias("content") if c == "content" else F.col(c) for c in results.columns], (F.col("_text") != F.col("content")).alias("trimmed"))
    return out.unionByName(results.where("start_byte IS NULL OR end_byte IS NULL").withColumn("trimmed", F.lit(False)))


def whole_characters(raw: Column) -> Column:
    """The text of a slice of UTF-8, without the parts of characters at its ends."""
    h = F.regexp_replace(F.hex(raw), "^(?:(?:[89AB]).)*", "")
    bare = F.regexp_replace(h, "(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$", "")
    return F.decode(F.unhex(bare), "UTF-8")


def covered_spans(chunks: DataFrame) -> DataFrame:
    """(document_id, start_byte, end_byte): the merged spans that the chunks of a document cover."""
    w = Window.partitionBy("document_id").orderBy("start_byte", "end_byte")
    before = F.max("end_byte").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = chunks.where("start_byte < end_byte").withColumn("opens", F.when(before.isNull() | (F.col("start_byte") > before), 1).otherwise(0))
    return spans.withColumn("island", F.sum("opens").over(w)).groupBy("document_id", "island").agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte")).drop("island")


def drop_covered(results: DataFrame, list_cols: list[str], rank_col: str = "rank") -> DataFrame:
    """Rows that no better-ranked row of the same document covers alone. The fold goes over the ranks of
    a document and keeps the spans that no other covers, sorted, so a row is one look-up: n log n."""
    ship(results.sparkSession)
    key = [*list_cols, "document_id"]
    some = results.where("start_byte < end_byte")
    each = some.select(*key, F.struct(F.col(rank_col).alias("r"), F.col("start_byte").cast("bigint").alias("a"), F.col("end_byte").cast("bigint").alias("b")).alias("p")).groupBy(*key).agg(F.array_sort(F.collect_set("p")).alias("ps"))
    spans = each.select(F.struct(*key).alias("key"), "ps")
    types = dict(spans.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [uncovered([(p["r"], p["a"], p["b"]) for p in ps]) for ps in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[ps[k] for k in ks] for ps, ks in zip(b.column(1).to_pylist(), kept, strict=True)], b.column(1).type)], names=["key", "ps"])

    left = spans.mapInArrow(run, f"key {types['key']}, ps {types['ps']}").select("key.*", F.explode("ps").alias("p")).select(*key, F.col("p.r").alias(rank_col), F.col("p.a").alias("start_byte"), F.col("p.b").alias("end_byte"))
    return some.join(left, [*key, rank_col, "start_byte", "end_byte"], "left_semi")


def uncovered(rows: list[tuple[int, int, int]]) -> list[int]:
    """Places of the (rank, start, end) rows, sorted by rank, that no row of a better rank covers."""
    starts: list[int] = []  # spans that no other covers: both ends ascend
    ends: list[int] = []
    out, k = [], 0
    while k < len(rows):
        same = k  # rows of one rank don't cover each other
        while same < len(rows) and rows[same][0] == rows[k][0]:
            same += 1
        fresh = []
        for i in range(k, same):
            _, a, b = rows[i]
            at = bisect_right(starts, a) - 1
            if at < 0 or ends[at] < b:
                fresh.append((a, b))
                out.append(i)
        for a, b in fresh:
            at = bisect_right(starts, a) - 1
            if at >= 0 and ends[at] >= b:
                continue
            lo, hi = bisect_left(starts, a), bisect_right(ends, b)
            starts[lo:hi], ends[lo:hi] = [a], [b]
        k = same
    return out
