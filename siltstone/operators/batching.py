"""Cutting ordered items into consecutive groups under limits.

The folds need the order and look at one running total, so they run on the array of one key
(`fold_groups`, a JVM aggregate) or, where balance needs a second pass, on arrays in Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import ship

CONTEXT_LIMIT = 25_600  # fixed value: tokens of a context group


def cuts(sizes: Sequence[int], limit: int, shares: int | None = None) -> list[tuple[int, int]] | None:
    """Consecutive groups under a limit, read off the running totals of the sizes: a group ends at the
    last place within the limit, and an item above the limit is a group of its own. With `shares` there
    are exactly so many groups, each ending as soon as it holds its equal share of what is left; None
    where that can't be done."""
    totals = list(accumulate(sizes, initial=0))
    n, at, out = len(sizes), 0, []
    while at < n and (shares is None or len(out) < shares):
        before = totals[at]
        end = bisect_right(totals, before + limit) - 1
        if totals[end] == before:  # nothing of weight fits: the next item goes alone
            end = min(end + 1, n)
        open_ = 1 if shares is None else shares - len(out)
        if open_ > 1 and totals[n] > before:
            share = -(-(totals[n] - before) // open_)
            end = min(end, bisect_left(totals, before + share, at + 1))
        out.append((at, end))
        at = end
    return out if at == n and (shares is None or len(out) == shares) else None


def max_fill(sizes: Sequence[int], limit: int) -> list[tuple[int, int]]:
    """Fewest groups: each takes what fits."""
    return cuts(sizes, limit) or []


def balanced(sizes: Sequence[int], limit: int = CONTEXT_LIMIT) -> list[tuple[int, int]]:
    """As few groups as possible, evenly filled where that can be done."""
    full = max_fill(sizes, limit)
    return (cuts(sizes, limit, len(full)) if len(full) > 1 else None) or full


def by_caps(items: Sequence[tuple[int, ...]], caps: tuple[int, ...]) -> list[tuple[int, int]]:
    """Greedy groups where every measure of the items stays under its cap."""
    groups: list[tuple[int, int]] = []
    start, totals = 0, [0] * len(caps)
    for i, item in enumerate(items):
        if i > start and any(t + x > c for t, x, c in zip(totals, item, caps, strict=True)):
            groups.append((start, i))
            start, totals = i, [0] * len(caps)
        totals = [t + x for t, x in zip(totals, item, strict=True)]
    return [*groups, (start, len(items))] if items else []


def halves(start: int, end: int, fits: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """A group cut in two until each part fits; one item always does."""
    if end - start <= 1 or fits(start, end):
        return [(start, end)]
    mid = (start + end) // 2
    return halves(start, mid, fits) + halves(mid, end, fits)


def _numbered(rows: DataFrame, key: str, order: str, measures: list[str], number: Callable[[list[tuple[int, ...]]], list[tuple[int, int]]]) -> DataFrame:
    """(key, order, batch): the groups that `number` cuts the ordered rows of each key into. The measures
    of a key are one array, so Arrow batches hold many keys."""
    ship(rows.sparkSession)
    each = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *measures))).alias("c"))
    each = each.select(key, F.transform("c", lambda x: x[order]).alias("at"), F.transform("c", lambda x: F.array(*[x[m].cast("bigint") for m in measures])).alias("m"))
    kinds = dict(each.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[g for g, (x, y) in enumerate(number([tuple(i) for i in items])) for _ in range(x, y)] for items in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=[key, "at", "g"])

    got = each.mapInArrow(run, f"{key} {kinds[key]}, at {kinds['at']}, g array<int>")
    return got.select(key, F.explode(F.arrays_zip("at", "g")).alias("z")).select(key, F.col("z.at").alias(order), F.col("z.g").alias("batch"))


def capped_batches(rows: DataFrame, key: str, order: str, measures: list[str], caps: tuple[int, ...]) -> DataFrame:
    """(key, order, batch): greedy batches where each measure stays under its cap (texts and tokens of an
    embedding call, documents and bytes of an upload)."""
    return _numbered(rows, key, order, measures, lambda items: by_caps(items, caps))


def halved_batches(rows: DataFrame, key: str, order: str, measure: str, limit: int) -> DataFrame:
    """(key, order, batch): the rows of a key cut in two until each part is within the limit, or one row."""

    def number(items: list[tuple[int, ...]]) -> list[tuple[int, int]]:
        totals = list(accumulate((x[0] for x in items), initial=0))
        return halves(0, len(items), lambda a, b: totals[b] - totals[a] <= limit) if items else []

    return _numbered(rows, key, order, [measure], number)


def fold_groups(sizes: Column, limit: int) -> Column:
    """Group number of each element of an ordered array, by max-fill. The fold keeps the first place of
    each group only, so it is linear in the elements; the numbers are laid out at the end."""
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("i"), F.array(F.lit(0)).alias("firsts"))

    def step(s: Column, x: Column) -> Column:
        new = (s["total"] > 0) & (s["total"] + x > limit)
        total = F.when(new, x.cast("bigint")).otherwise(s["total"] + x).cast("bigint")
        return F.struct(total.alias("total"), (s["i"] + 1).alias("i"), F.when(new, F.array_append(s["firsts"], s["i"])).otherwise(s["firsts"]).alias("firsts"))

    def laid_out(s: Column) -> Column:
        ends = F.array_append(F.slice(s["firsts"], 2, F.size(s["firsts"])), s["i"])
        runs = F.zip_with(s["firsts"], ends, lambda a, b: b - a)
        return F.flatten(F.transform(runs, lambda n, g: F.array_repeat(g, n)))

    return F.aggregate(sizes, zero, step, laid_out)


def context_groups(chunks: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """(document_id, chunk_index, group_no): balanced context groups of each document's chunks. A
    document's sizes are one array, so Arrow batches hold many documents."""
    ship(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[g for g, (x, y) in enumerate(balanced([min(t, limit) for t in sizes], limit)) for _ in range(x, y)] for sizes in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=["document_id", "at", "g"])

    sizes = F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0))
    each = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", sizes.alias("t")))).alias("c"))
    each = each.select("document_id", F.transform("c", lambda x: x["chunk_index"]).alias("at"), F.transform("c", lambda x: x["t"]).alias("t"))
    got = each.mapInArrow(run, "document_id string, at array<int>, g array<int>")
    return got.select("document_id", F.explode(F.arrays_zip("at", "g")).alias("z")).select("document_id", F.col("z.at").alias("chunk_index"), F.col("z.g").alias("group_no"))


def filled_groups(chunks: DataFrame, limit: int) -> DataFrame:
    """(document_id, chunk_index, group_no) by max-fill, in the JVM."""
    each = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0)).alias("t")))).alias("c"))
    numbered = each.select("document_id", "c", fold_groups(F.transform("c", lambda x: x["t"]), limit).alias("g"))
    return numbered.select("document_id", F.explode(F.arrays_zip("c", "g")).alias("z")).select("document_id", F.col("z.c.chunk_index").alias("chunk_index"), F.col("z.g").alias("group_no"))


def budget_prefix(items: DataFrame, partition: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Items that start while the running cost before them is under the budget."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("spent_before", F.coalesce(F.sum(cost).over(w), F.lit(0)).cast("bigint")).where(F.col("spent_before") < budget)


def regrouped(sizes: Column, flat: Column) -> Column:
    """A flat array cut into arrays of the given sizes."""
    starts = F.transform(sizes, lambda x, i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda s, y: s + y) + 1)
    return F.zip_with(starts, sizes, lambda a, n: F.slice(flat, a, n))
