"""Near-duplicate texts: an exact similarity join on word shingles.

Two texts are linked when the Jaccard similarity of their sets of distinct word shingles is at
least `threshold`. The join loses no pair and stays away from comparing everything:

1. Each text becomes a set of 64-bit shingle hashes. Texts with equal sets share a set id, so
   copies cost one set however many there are.
2. A table of 2**slots_log2 counters of one byte (16 MB, whatever the input) estimates in how many
   sets a shingle occurs; it fixes one global order, rare shingles first. Counters are exact up to 15
   and then logarithmic up to 1e12, so they don't saturate.
3. Prefix filter: two sets that reach the threshold share a shingle among the first
   n - ceil(threshold * n) + 1 of that order. Only prefix shingles that occur in two sets or more
   are sent, each with the set's population (its size) and a parity bitmap of 256 bits.
4. Rows meet by shingle. A shingle with more than `hot` rows, by its counter, is spread before the
   shuffle: rows belong to groups by a hash of their set, and every pair of groups is a bucket of its
   own. No task gets more than about 2 * `hot` rows of one shingle.
5. Buckets, sorted by population, are compared in tiles of `TILE` rows with exclusive-or and bit
   counts. For sets A, B at the threshold |A xor B| <= (1-t)/(1+t) * (|A|+|B|), and folding into a
   parity bitmap never raises the count, so the radius discards no true pair. Tile pairs whose
   populations differ beyond the radius are skipped.
6. The surviving pairs are checked with the exact sets, which are built again for texts in such pairs
   alone; the scan tells them by marks of their ids (8 MB), so no text is shuffled.

Defined cases: null texts are in no pair. Texts with fewer words than a shingle have no shingles;
they pair only with equal texts. Repeated rows of one id count once (if an id comes with different
texts, any of them may link it). Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.model import marked
from siltstone.session import ship, staged, table, unstage

WORD = re.compile(r"[^\W_]+")
BLOCK = 1 << 18
SKETCH_BYTES = 32
TILE = 32  # rows of a tile
COPY_BLOCK = 4096  # copies of one text that a task pairs with as many others
#: Values of the counters' codes: exact, then in steps of an eighth.
CODES = np.r_[np.arange(16.0), 15.0 * 1.125 ** np.arange(1, 241)]


def encoded(counts: np.ndarray) -> np.ndarray:
    """Codes of counts; never below the count in what matters here (0, 1, or two and more)."""
    return np.searchsorted(CODES, np.minimum(counts, CODES[-1]) * (1 - 1e-12)).astype(np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray | None]:
    """Sorted distinct 64-bit hashes of the `width`-word shingles of each text; None for null."""
    words: list[list[str] | None] = [None if t is None else WORD.findall(t.lower()) for t in texts]
    known: dict[str, int] = {}
    codes = [known.setdefault(w, len(known)) for ws in words if ws for w in ws]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in known), np.uint64, len(known))
    flat = hashes[np.asarray(codes, np.int64)] if codes else np.empty(0, np.uint64)
    n = len(flat) - width + 1
    if n > 0:
        comb = np.zeros(n, np.uint64)
        for k in range(width):
            comb = _mix(comb * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + n])
    out: list[np.ndarray | None] = []
    at = 0
    for ws in words:
        if ws is None:
            out.append(None)
            continue
        m = len(ws)
        out.append(np.unique(comb[at : at + m - width + 1]) if m >= width else np.empty(0, np.uint64))
        at += m
    return out


def set_id(s: np.ndarray, text: str) -> bytes:
    """128-bit name of a shingle set; texts without shingles are named by the text itself."""
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else xxhash.xxh3_128_digest(b"text:" + text.encode("utf-8", "surrogatepass"))


def sketch(s: np.ndarray) -> bytes:
    """Parity bitmap of a set."""
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) % (8 * SKETCH_BYTES), minlength=8 * SKETCH_BYTES) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _slots(s: np.ndarray, slots_log2: int) -> np.ndarray:
    return (s >> np.uint64(64 - slots_log2)).astype(np.int64)


def _count_pass(width: int, slots_log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << slots_log2, np.uint32)
        seen: set[bytes] = set()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            o_id, o_sid, o_n = [], [], []
            for i, t, s in zip(ids, texts, shingle_sets(texts, width), strict=True):
                if s is None or i is None:
                    continue
                sid = set_id(s, t)
                o_id.append(i), o_sid.append(sid), o_n.append(len(s))
                if sid not in seen:
                    seen.add(sid)
                    counters[_slots(s, slots_log2)] += 1
            k = len(o_id)
            yield pa.RecordBatch.from_arrays([pa.array(o_id, pa.string()), pa.array(o_sid, pa.binary()), pa.array(o_n, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=["id", "sid", "n", "blk", "cnt"])
        if seen:
            pack = zstandard.ZstdCompressor(level=1).compress
            blocks = [(k, counters[k * BLOCK : (k + 1) * BLOCK]) for k in range(max(1, (1 << slots_log2) // BLOCK))]
            blocks = [(k, pack(encoded(c).tobytes())) for k, c in blocks if c.any()]
            m = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.array([k for k, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())], names=["id", "sid", "n", "blk", "cnt"])

    return run


def _merge_counters(pdf):
    import pandas as pd

    un, total = zstandard.ZstdDecompressor(), 0.0
    for c in pdf["cnt"]:
        total = total + CODES[np.frombuffer(un.decompress(c), np.uint8)]
    return pd.DataFrame({"blk": [pdf["blk"].iloc[0]], "cnt": [zstandard.ZstdCompressor(level=1).compress(encoded(total).tobytes())]})


def prefix_length(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - 1e-9) + 1


def _spread(token: np.ndarray, own: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, side) of rows of hot shingles: group g of G meets every group. In bucket (i, j) rows
    of group i are side 1 and those of group j side 2; the bucket (i, i) is of side 0."""
    row = np.repeat(np.arange(len(token)), groups)
    other = np.arange(len(row)) - np.repeat(np.cumsum(groups) - groups, groups)
    mine = own[row]
    i, j = np.minimum(mine, other), np.maximum(mine, other)
    side = np.where(i == j, 0, np.where(mine == i, 1, 2)).astype(np.int8)
    name = _mix(token[row] + (i.astype(np.uint64) << np.uint64(32)) + j.astype(np.uint64) + np.uint64(1))
    return row, np.where(groups[row] > 1, name, token[row]), side


_ROWS = "bucket long, n int, sid binary, sk binary, side byte"


def _prefix_pass(width: int, threshold: float, slots_log2: int, hot: int, counters_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        un, counters = zstandard.ZstdDecompressor(), np.zeros(1 << slots_log2, np.uint8)
        for k, c in counters_b.value:
            a = np.frombuffer(un.decompress(c), np.uint8)
            counters[k * BLOCK : k * BLOCK + len(a)] = a
        seen: set[bytes] = set()
        for b in batches:
            texts = b.column(1).to_pylist()
            tok, codes, sids, ns, sks, many = [], [], [], [], [], []
            for i, t, s in zip(b.column(0).to_pylist(), texts, shingle_sets(texts, width), strict=True):
                if s is None or i is None or not len(s):
                    continue
                sid = set_id(s, t)
                if sid in seen:
                    continue
                seen.add(sid)
                c = counters[_slots(s, slots_log2)]
                p = prefix_length(len(s), threshold)
                first = np.argsort(c, kind="stable")[:p]  # s is sorted, so ties are in hash order
                first = first[c[first] >= 2]
                if len(first):
                    tok.append(s[first]), codes.append(c[first])
                    sids.append(sid), ns.append(len(s)), sks.append(sketch(s)), many.append(len(first))
            if tok:
                token, of = np.concatenate(tok), np.repeat(np.arange(len(sids)), many)
                groups = np.ceil(CODES[np.concatenate(codes)] / hot).astype(np.int64)
                own = np.frombuffer(b"".join(x[:8] for x in sids), np.uint64)[of] % groups.astype(np.uint64)
                row, bucket, side = _spread(token, own.astype(np.int64), groups)
                at = pa.array(of[row])
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(ns, pa.int32()).take(at), pa.array(sids, pa.binary()).take(at), pa.array(sks, pa.binary()).take(at), pa.array(side)], names=["bucket", "n", "sid", "sk", "side"])

    return run


def _bytes_matrix(col: pa.Array, width: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, width)


def radius(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Largest symmetric difference of two sets of these sizes at the threshold."""
    return np.floor((1 - threshold) / (1 + threshold) * (na + nb) + 1e-9)


def tile_pairs(bucket: np.ndarray, n: np.ndarray, sk: np.ndarray, side: np.ndarray, threshold: float, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the rows of one bucket within the radius, rows sorted by (bucket, n). Tiles of
    `tile` rows are compared with themselves and with those after them, all tiles at once, as long as a
    bucket reaches from the one into the other and their populations can meet."""
    m = -(-len(bucket) // tile)
    if not m:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pad = m * tile - len(bucket)
    there = np.r_[np.ones(len(bucket), bool), np.zeros(pad, bool)].reshape(m, tile)
    bk, nf, sd = np.r_[bucket, np.full(pad, bucket[-1])].reshape(m, tile), np.r_[n, np.full(pad, n[-1])].astype(np.float64).reshape(m, tile), np.r_[side, np.zeros(pad, side.dtype)].reshape(m, tile)
    bits = np.concatenate([sk, np.zeros((pad, sk.shape[1]), sk.dtype)]).reshape(m, tile, -1)
    # the largest population that the last bucket of a tile has there, and the least that the first one has
    high, low = nf[:, -1], nf[:, 0]
    oi, oj, lag = [], [], 0
    act = np.arange(m)
    while len(act):
        for at in range(0, len(act), 128):
            x = act[at : at + 128]
            y = x + lag
            ok = (bk[x][:, :, None] == bk[y][:, None, :]) & there[x][:, :, None] & there[y][:, None, :]
            a, b = nf[x][:, :, None], nf[y][:, None, :]
            ok &= (a >= threshold * b - 1e-9) & (b >= threshold * a - 1e-9)
            sx, sy = sd[x][:, :, None], sd[y][:, None, :]
            ok &= (sx == 0) | (sx != sy)
            if not lag:
                ok &= np.triu(np.ones((tile, tile), bool), 1)
            h = np.bitwise_count(bits[x][:, :, None, :] ^ bits[y][:, None, :, :]).sum(axis=3, dtype=np.int16)
            t, i, j = np.nonzero(ok & (h <= radius(a, b, threshold)))
            oi.append(x[t] * tile + i), oj.append(y[t] * tile + j)
        lag += 1
        act = act[act + lag < m]
        # rows ascend by population: the tile is skipped once even its first row is too far from the last of this one
        meets = (bk[act, -1] == bk[act + lag, 0]) & (high[act] >= threshold * low[act + lag] - 1e-9)
        act = act[meets]
    return np.concatenate(oi), np.concatenate(oj)


def _bucket_pass(threshold: float, tile: int):
    def compare(t: pa.Table) -> pa.RecordBatch | None:
        bucket, n, side = (t[c].to_numpy() for c in ("bucket", "n", "side"))
        sid, sk = _bytes_matrix(t["sid"], 16), _bytes_matrix(t["sk"], SKETCH_BYTES).view(np.uint64)
        fresh = np.ones(len(bucket), bool)  # a set may come once from each input partition
        fresh[1:] = (bucket[1:] != bucket[:-1]) | (sid[1:] != sid[:-1]).any(axis=1)
        bucket, n, side, sid, sk = bucket[fresh], n[fresh], side[fresh], sid[fresh], sk[fresh]
        i, j = tile_pairs(bucket, n, sk, side, threshold, tile)
        pairs = {(x, y) if x < y else (y, x) for x, y in zip((x.tobytes() for x in sid[i]), (x.tobytes() for x in sid[j]), strict=True) if x != y}
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], names=["a", "b"]) if pairs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []  # the last bucket, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            bucket = t["bucket"].to_numpy()
            last = int(np.searchsorted(bucket != bucket[-1], False)) if bucket[0] == bucket[-1] else len(bucket) - int(np.argmax(bucket[::-1] != bucket[-1]))
            if last or (rest and rest[-1]["bucket"][0].as_py() != bucket[0]):
                whole = pa.concat_tables([*rest, t.slice(0, last)]).combine_chunks()
                rest = []
                if whole.num_rows and (out := compare(whole)):
                    yield out
            rest.append(t.slice(last))
        if rest and (out := compare(pa.concat_tables(rest).combine_chunks())):
            yield out

    return run


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            texts, sets = b.column(0).to_pylist(), []
            for t, s in zip(texts, shingle_sets(texts, width), strict=True):
                if s is not None and (sid := set_id(s, t)) not in seen:
                    seen.add(sid)
                    sets.append((sid, s))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in sets], pa.binary()), pa.array([s.view(np.int64) for _, s in sets], pa.list_(pa.int64()))], names=["sid", "hs"])

    return run


def set_links(df: DataFrame, id_col: str, text_col: str, width: int = 5, threshold: float = 0.8, slots_log2: int = 24, hot: int = 4096, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(members: id, sid) and (links: a, b): the distinct pairs a < b of set ids at the threshold."""
    spark = ship(df.sparkSession)
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    first = staged(src.mapInArrow(_count_pass(width, slots_log2), "id string, sid binary, n int, blk int, cnt binary"), "shingles")
    members = first.where("id is not null").select("id", "sid").distinct()

    partial = first.where("blk is not null").select("blk", "cnt", F.expr("pmod(xxhash64(cnt), 64)").alias("salt"))
    merged = partial.groupBy("blk", "salt").applyInPandas(_merge_counters, "blk int, cnt binary").groupBy("blk").applyInPandas(_merge_counters, "blk int, cnt binary")
    counters_b = spark.sparkContext.broadcast([(r.blk, bytes(r.cnt)) for r in merged.collect()])  # at most 2**slots_log2 bytes

    rows = src.mapInArrow(_prefix_pass(width, threshold, slots_log2, hot, counters_b), _ROWS)
    bucketed = rows.repartition("bucket").sortWithinPartitions("bucket", "n", "sid")
    cand = staged(bucketed.mapInArrow(_bucket_pass(threshold, tile), "a binary, b binary").distinct(), "candidates")

    need = cand.select(F.col("a").alias("sid")).union(cand.select(F.col("b").alias("sid"))).distinct()
    reps = staged(members.groupBy("sid").agg(F.min("id").alias("id")).join(need, "sid", "left_semi").select("id"), "representatives")
    some = marked(src, F.col("id"), reps).where("_maybe").select("text")
    sets = staged(some.mapInArrow(_set_rows(width), "sid binary, hs array<bigint>").join(need, "sid", "left_semi").dropDuplicates(["sid"]), "sets")
    both = cand.join(sets.select(F.col("sid").alias("a"), F.col("hs").alias("ha")), "a").join(sets.select(F.col("sid").alias("b"), F.col("hs").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    links = both.withColumn("shared", shared).where(F.col("shared") >= threshold * (F.size("ha") + F.size("hb") - F.col("shared")) - 1e-9).select("a", "b")
    return members, staged(links, "links")


def expanded(members: DataFrame, links: DataFrame, block: int = COPY_BLOCK) -> DataFrame:
    """(id_a, id_b) of all ids whose sets are linked or equal. Copies are cut into blocks of about
    `block` by a hash of their id; a pair of blocks is a join key of its own, so neither side of the
    join has a hot key."""
    size = staged(members.groupBy("sid").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("copies")), "copies")
    cut = members.join(size.where("blocks > 1").select("sid", "blocks"), "sid", "left").select("sid", F.coalesce(F.pmod(F.xxhash64("id"), "blocks").cast("int"), F.lit(0)).alias("blk"), "id")
    several = size.where("copies > 1").select(F.col("sid").alias("a"), F.col("sid").alias("b"))
    pairs = links.select("a", "b").unionByName(several)
    for side in ("a", "b"):
        held = size.where("blocks > 1").select(F.col("sid").alias(side), "blocks")
        pairs = pairs.join(held, side, "left").withColumn(f"k{side}", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    pairs = pairs.where("a <> b OR ka <= kb")
    for side, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(cut.select(F.col("sid").alias(side), F.col("blk").alias(f"k{side}"), F.col("id").alias(name)), [side, f"k{side}"])
    pairs = pairs.where("x <> y AND (a <> b OR ka < kb OR x < y)")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, width: int = 5, threshold: float = 0.8, **kw) -> DataFrame:
    """All pairs (id_a < id_b) of ids at the threshold, copies included. `near_duplicate_groups` gives
    the same links without one row a pair."""
    return expanded(*set_links(df, id_col, text_col, width, threshold, **kw))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(node, root): connected components by alternating large-star and small-star steps, each
    round a written table, until one changes no edge; root is the smallest node of the component.
    No end within `max_rounds` is an error."""
    cur = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    for _ in range(max_rounds):
        nb = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = nb.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = nb.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        last, cur = cur, staged(small, "cc")
        # both hold distinct edges: as many of them, and none that the other lacks
        settled = last.count() == cur.count() and last.join(cur, ["u", "v"], "left_anti").isEmpty()
        unstage(last)
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, width: int = 5, threshold: float = 0.8, **kw) -> DataFrame:
    """One row per non-null text id: (id, group_id, n_links). group_id is the hex name of the
    smallest set of the group; n_links counts the other ids at the threshold, copies included."""
    members, links = set_links(df, id_col, text_col, width, threshold, **kw)
    size = members.groupBy("sid").agg(F.count("*").alias("copies"))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    deg = both.join(size.withColumnRenamed("sid", "b"), "b").groupBy(F.col("a").alias("sid")).agg(F.sum("copies").alias("others"))
    per = size.join(deg, "sid", "left").join(components(links).select(F.col("node").alias("sid"), "root"), "sid", "left")
    per = per.select("sid", F.lower(F.hex(F.coalesce("root", "sid"))).alias("group_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("bigint").alias("n_links"))
    return members.join(per, "sid").select("id", "group_id", "n_links")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf_dir, "chunk"), "id", "content", width=3, threshold=0.7)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "chunk"), "id", "content", width=3, threshold=0.7)
