"""Filling containers of fixed capacity with texts, sized in tokens.

A text above the capacity is split into parts of the capacity and a remainder; every other text
stays whole. Items go to shards by a hash of (id, part), about `shard_items` each, so no task holds
an unbounded group; a shard leaves at most about one container part-filled. Inside a shard:

* best-fit decreasing gives the first incumbent and stops if it meets the lower bound;
* bin completion then searches better packings depth first: take the largest item left, enumerate
  the fillings of its container that no other filling dominates, best first, and cut a branch once
  its waste exceeds what a packing with one container less could afford.

`search_nodes`, `most` and `keep` bound the search, not the items: whatever it finds, all items are
packed.

Columns out: container_id, doc_id, part, first_token, n_tokens. Defined cases: null and empty texts
have 0 tokens and one row in a container; repeated rows of an id count once; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.encode import RANK_FILE, token_counts
from siltstone.session import ship, staged, table

CAPACITY = 2048
# Bounds of the search, all parameters: nodes a shard, steps of a walk for fillings, fillings kept.
NODES, MOST, KEEP = 20_000, 400, 24


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of sizes."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    for s in sorted(sizes, reverse=True):
        k = bisect.bisect_left(room, (s, -1))
        if k == len(room):
            bins.append([s])
            bisect.insort(room, (capacity - s, len(bins) - 1))
        else:
            left, b = room.pop(k)
            bins[b].append(s)
            if left > s:
                bisect.insort(room, (left - s, b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """The larger of the volume bound and, for every size that a small item has, the bound that counts the
    rest beside large items which nothing of that size or more fits beside."""
    if not sizes:
        return 0
    n = np.bincount(np.asarray(sizes, np.int64), minlength=capacity + 1)
    items, volume = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * np.arange(capacity + 1))]  # below a size
    low = np.flatnonzero(n[1 : capacity // 2 + 1]) + 1
    alone = items[capacity + 1] - items[capacity - low + 1]
    rest = volume[capacity - low + 1] - volume[low]
    bounds = alone + -(-rest // capacity)
    big = int(items[capacity + 1] - items[capacity // 2 + 1])
    return int(max(-(-sum(sizes) // capacity), big, *bounds.tolist(), 0))


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of `b` fit into the places of the items of `a` (then `a` is as good)."""
    room = list(a)

    def place(i: int) -> bool:
        if i == len(b):
            return True
        tried = set()
        for k, r in enumerate(room):
            if r >= b[i] and r not in tried:
                tried.add(r)
                room[k] -= b[i]
                if place(i + 1):
                    return True
                room[k] += b[i]
        return False

    return sum(b) <= sum(a) and place(0)


class Stock:
    """Items left by size, with a bit for every size there is, so that the largest size up to some
    room is one mask and one bit length."""

    def __init__(self, sizes: list[int]):
        self.n = Counter(sizes)
        self.mask = 0
        for s in self.n:
            self.mask |= 1 << s

    def take(self, items: list[int] | tuple[int, ...]) -> None:
        for s in items:
            self.n[s] -= 1
            if not self.n[s]:
                self.mask &= ~(1 << s)

    def put(self, items: list[int] | tuple[int, ...]) -> None:
        for s in items:
            self.n[s] += 1
            self.mask |= 1 << s

    def below(self, most: int) -> int:
        """Bits of the sizes from 1 to `most`."""
        return self.mask & ((2 << most) - 1) & ~1 if most > 0 else 0


def fillings(stock: Stock, room: int, waste: int, most: int = MOST, keep: int = KEEP) -> list[tuple[int, ...]]:
    """Undominated sets of sizes that leave at most `waste` of `room`, least waste first. The walk
    takes large sizes first, `most` steps at most; `keep` sets at most are given."""
    found: list[tuple[int, ...]] = [()] if room <= waste else []
    budget = most

    def grow(top: int, left: int, chosen: tuple[int, ...]) -> None:
        nonlocal budget
        bits = stock.below(min(top, left))
        while bits and budget > 0:
            v = bits.bit_length() - 1
            bits &= (1 << v) - 1
            if chosen.count(v) >= stock.n[v]:
                continue
            now = (*chosen, v)
            budget -= 1
            if left - v <= waste:
                found.append(now)
            if left > v:
                grow(v, left - v, now)

    grow(room, room, ())
    found.sort(key=lambda f: (-sum(f), len(f)))
    out: list[tuple[int, ...]] = []
    for f in found:
        if len(out) >= keep:
            break
        if not any(_dominates(g, f) for g in out if len(g) <= 8 and len(f) <= 8):
            out.append(f)
    return out


def bin_completion(sizes: list[int], capacity: int, search_nodes: int = NODES, most: int = MOST, keep: int = KEEP) -> list[list[int]]:
    """A packing of positive sizes, never worse than best fit. It is known to be optimal where its
    number is that of `lower_bound`; else the search may have missed a better one, for it ends after
    `search_nodes` and looks at no more than `keep` fillings of a container, found in `most` steps."""
    incumbent = best_fit_decreasing(sizes, capacity)
    bound, total = lower_bound(sizes, capacity), sum(sizes)
    nodes = search_nodes
    while len(incumbent) > bound and nodes > 0:
        better, nodes = _search(sizes, capacity, (len(incumbent) - 1) * capacity - total, nodes, most, keep)
        if better is None:
            break
        incumbent = better
    return incumbent


def _search(sizes: list[int], capacity: int, allowed: int, nodes: int, most: int, keep: int) -> tuple[list[list[int]] | None, int]:
    """(a packing that wastes at most `allowed`, or None; nodes left), depth first."""
    stock, used = Stock(sizes), 0
    stack: list[list] = []  # [fillings left, container placed, waste before it]
    while stock.mask:
        largest = stock.mask.bit_length() - 1
        stock.take((largest,))
        options = fillings(stock, capacity - largest, allowed - used, most, keep)
        stock.put((largest,))
        stack.append([[(largest, *f) for f in reversed(options)], None, used])
        while True:  # the next branch here, or back
            if not stack:
                return None, nodes
            level = stack[-1]
            if level[1]:
                stock.put(level[1])
                level[1] = None
            if level[0]:
                if nodes <= 0:
                    return None, 0
                nodes -= 1
                level[1] = level[0].pop()
                stock.take(level[1])
                used = level[2] + capacity - sum(level[1])
                break
            stack.pop()
    return [list(placed) for _, placed, _ in stack], nodes


def pack_shard(ids: list[tuple], sizes: list[int], capacity: int, search_nodes: int = NODES, most: int = MOST, keep: int = KEEP) -> list[tuple[int, tuple]]:
    """(container, item) of all items of a shard; empty items go into the first container."""
    bins = bin_completion([s for s in sizes if s > 0], capacity, search_nodes, most, keep)
    by_size: dict[int, list[tuple]] = {}
    for i, s in sorted(zip(ids, sizes, strict=True), reverse=True):
        by_size.setdefault(s, []).append(i)
    out = [(k, by_size[s].pop()) for k, b in enumerate(bins) for s in b]
    return out + [(0, i) for i in by_size.get(0, [])]


def _pack_group(capacity: int, search_nodes: int, most: int, keep: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = [tuple(map(int, x)) for x in zip(pdf["doc_id"], pdf["part"], pdf["first_token"], pdf["n_tokens"], strict=True)]
        packed = pack_shard(items, [x[3] for x in items], capacity, search_nodes, most, keep)
        base = int(pdf["shard"].iloc[0]) << 32
        return pd.DataFrame([(base + k, *x) for k, x in packed], columns=["container_id", "doc_id", "part", "first_token", "n_tokens"])

    return run


def pack_documents(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, rank_file: str = RANK_FILE, shard_items: int = 4096, search_nodes: int = NODES, most: int = MOST, keep: int = KEEP) -> DataFrame:
    """(container_id, doc_id, part, first_token, n_tokens)."""
    ship(df.sparkSession)
    sized = token_counts(df, id_col, text_col, rank_file)
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int") - 1
    items = sized.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    first = F.col("part").cast("bigint") * capacity
    items = staged(items.select("doc_id", "part", first.alias("first_token"), F.least(F.col("n_tokens") - first, F.lit(capacity)).cast("int").alias("n_tokens")), "items")
    shards = max(1, -(-items.count() // shard_items))
    # by number: the work of a shard isn't in its bytes, so they mustn't be put together by size
    tasks = min(shards, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism))
    sharded = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards))).repartition(tasks, "shard")
    return sharded.groupBy("shard").applyInPandas(_pack_group(capacity, search_nodes, most, keep), "container_id bigint, doc_id bigint, part int, first_token bigint, n_tokens int")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, least possible number, and share of space used."""
    packed = p7_containers(spark, sf_dir)
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    total = F.sum("used")
    return per.agg(F.count("*").alias("n_containers"), F.ceil(total / CAPACITY).cast("bigint").alias("volume_bound"), F.round(total / (F.count("*") * CAPACITY), 6).alias("share_used"), F.max("used").cast("bigint").alias("fullest"))
