"""The k most similar vectors of every vector, by an inverted index with balanced posting lists.

1. Vectors that can't take part (null, other dimension, NaN or infinite, all zero) are left out;
   vectors of equal direction become one row with its ids, so a hot group of copies costs one.
2. Lists are about `list_rows` long and their number grows with the vectors. Their centroids come from
   recursive k-means, which splits until a leaf holds `leaf` sample rows and so keeps lists balanced:
   first cells (one for `lists_a_cell` lists) on a hash sample of at most `max_sample` rows, then the
   lists of each cell on a sample of its own rows (`leaf` rows a list, at most `max_sample`), in Spark.
3. A neighbour graph over the centroids, held in memory, is searched best first for the nearest
   cells, and one over the lists of a cell for the nearest lists. What is broadcast are the cells, at
   most max_sample / leaf rows; a task holds the lists of one cell.
4. Every vector is posted to the lists whose centroid is within (1 + `replicate`) of its nearest
   distance (boundary vectors go to several, up to `max_copies` a cell), and searches the lists within
   (1 + `prune`) of it (up to `max_lists` a cell, at least `min_lists`), in its home cell and in the
   cells within (1 + `spread`) (up to `max_cells`).
5. Lists that are longer than `block` all the same are cut into blocks of postings and of searches,
   so a task never holds a whole hot list; each block pair is one matrix product, whose best k merge
   by vector.

Result: (id, neighbour_id, rank, cosine), ties by smaller id. Copies are expanded from the
k + 1 smallest ids of a direction, which is exact under that order.

Defined cases: repeated rows of an id count once (of different vectors under one id the smallest
counts); fewer than k others give fewer rows; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.search import nearest_chunks
from siltstone.session import ship, staged, table


CELLS = 1 << 20  # numbers of cells of a field, and of lists of a cell, are below it


def normalised(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, leaf: int, seed: int = 7) -> np.ndarray:
    """Centroids of the leaves of a recursive spherical k-means."""
    rng = np.random.default_rng(seed)
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        part = x[rows]
        k = min(16, -(-len(rows) // leaf))
        if k > 1:
            c = part[rng.choice(len(part), k, replace=False)]
            for _ in range(8):
                a = (part @ c.T).argmax(1)
                for j in range(k):
                    s = part[a == j].sum(0)
                    n = np.linalg.norm(s)
                    if n > 0:
                        c[j] = s / n
            groups = [rows[a == j] for j in range(k)]
            groups = [g for g in groups if len(g)]
            if len(groups) > 1:
                todo += groups
                continue
        m = part.sum(0)
        n = np.linalg.norm(m)
        out.append(m / n if n > 0 else part[0])
    return np.stack(out).astype(np.float32) if out else np.zeros((0, x.shape[1] if x.ndim == 2 else 1), np.float32)


class CentroidGraph:
    """Neighbour graph over centroids with a batched best-first search."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, entries: int = 16, seed: int = 7):
        self.c, n = centroids, len(centroids)
        near = min(degree, max(1, n - 1))
        rng = np.random.default_rng(seed)
        self.links = np.empty((n, near + min(4, n)), np.int64)
        for a in range(0, n, 1024):
            s = centroids[a : a + 1024] @ centroids.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -9
            self.links[a : a + 1024, :near] = np.argpartition(-s, near - 1, axis=1)[:, :near] if n > 1 else 0
        self.links[:, near:] = rng.integers(0, n, (n, self.links.shape[1] - near))  # long links
        self.entries = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(np.int64))

    def search(self, q: np.ndarray, k: int, beam: int = 32, ratio: float | None = None, sure: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of about the k nearest centroids of each row, best first. With `ratio`
        only the `sure` best and what lies within (1 + ratio) of the best distance is expanded."""
        n, b = len(self.c), len(q)
        k, beam = min(k, n), min(max(beam, k), n)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, n), bool)
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -9.0, np.float32)
        done = np.ones((b, beam), bool)

        def add(new: np.ndarray) -> None:
            nonlocal ids, sims, done
            s = np.einsum("bd,bjd->bj", q, self.c[new]).astype(np.float32)
            fresh = ~seen[rows, new]
            srt = np.argsort(new, axis=1)  # the same link twice in a row counts once
            dup = np.zeros_like(fresh)
            ordered = np.take_along_axis(new, srt, 1)
            np.put_along_axis(dup, srt[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            fresh &= ~dup
            s[~fresh] = -9
            seen[rows, new] = True
            ids = np.concatenate([ids, new], 1)
            sims = np.concatenate([sims, s], 1)
            done = np.concatenate([done, ~fresh], 1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, done = (np.take_along_axis(x, best, 1) for x in (ids, sims, done))
            if ratio is not None and sims.shape[1] > sure:
                dist = np.sqrt(np.maximum(2 - 2 * sims, 0))
                done[:, sure:] |= dist[:, sure:] > (1 + ratio) * dist[:, :1] + 1e-6

        add(np.broadcast_to(self.entries, (b, len(self.entries))))
        while True:
            todo = np.where(done, -9, sims)
            pick = todo.argmax(1)
            live = todo[np.arange(b), pick] > -9
            if not live.any():
                return ids[:, :k], sims[:, :k]
            done[np.arange(b), pick] = True
            add(np.where(live[:, None], self.links[np.maximum(ids[np.arange(b), pick], 0)], self.entries[0]))


def _matrix(col) -> np.ndarray:
    """Vectors from the bytes they travel in."""
    return np.frombuffer(b"".join(col), np.float32).reshape(len(col), -1) if len(col) else np.zeros((0, 1), np.float32)


def _direction_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        if b.num_rows:
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in (np.round(normalised(v), 7) + 0.0).astype(np.float32)]
            raw = [x.tobytes() for x in np.ascontiguousarray(v, np.float32)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["field", "id", "dir", "vec"])


def _search_rows(graph, v: np.ndarray, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of about the k nearest centroids of unit vectors, nearest first."""
    ids, sims = graph.search(v, k, ratio=ratio)
    return ids, np.sqrt(np.maximum(2 - 2 * sims, 0))


def _to_cells(graphs_b, spread: float, max_cells: int):
    """Home cell of each vector and the other cells within (1 + spread) of its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            field, raw = b.column("field").to_numpy(), b.column("vec").to_pylist()
            home, others = np.zeros(len(raw), np.int32), [[] for _ in raw]
            for f in np.unique(field):
                graph, rows = graphs_b.value[int(f)], np.flatnonzero(field == f)
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    q = normalised(_matrix([raw[i] for i in part])).astype(np.float32)
                    ids, dist = _search_rows(graph, q, max_cells, spread)
                    near = (dist <= (1 + spread) * (dist[:, :1] + 1e-6)) & (ids >= 0)
                    home[part] = f * CELLS + ids[:, 0]
                    for i, row, ok in zip(part.tolist(), ids[:, 1:].tolist(), near[:, 1:].tolist(), strict=True):
                        others[i] = [int(f * CELLS + c) for c, yes in zip(row, ok, strict=True) if yes]
            yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("vec"), pa.array(home), pa.array(others, pa.list_(pa.int32()))], names=["vid", "vec", "home", "others"])

    return run


def _fit_cell(leaf: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = fit_centroids(normalised(_matrix(pdf.sort_values("vid")["vec"])).astype(np.float32), leaf)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "vec": [c.tobytes()]})

    return run


def _to_lists(dim: int, replicate: float, max_copies: int, prune: float, min_lists: int, max_lists: int):
    """Lists of the vectors of cells. Rows come sorted by cell, the centroids of the cell first. A
    vector without `near` is at home: it learns the distance of its nearest list, and goes on to its
    other cells with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, of = None, None
        for b in batches:
            cells, kinds, raw = b.column("cell").to_numpy(), b.column("kind").to_numpy(), b.column("vec").to_pylist()
            vid, near = b.column("vid").to_numpy(zero_copy_only=False), b.column("near").to_numpy(zero_copy_only=False)
            others = b.column("others").to_pylist()
            out: list[list[np.ndarray]] = [[], [], [], []]
            on: tuple[list, list, list] = ([], [], [])
            edges = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])])
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(cells)], strict=True):
                if not kinds[s]:
                    graph, of = CentroidGraph(np.frombuffer(raw[s], np.float32).reshape(-1, dim)), cells[s]
                    continue
                assert of == cells[s]
                for at in range(s, e, 1024):
                    rows = np.arange(at, min(e, at + 1024))
                    q = normalised(_matrix([raw[i] for i in rows])).astype(np.float32)
                    ids, dist = _search_rows(graph, q, max(max_copies, max_lists), max(prune, replicate))
                    home = np.isnan(near[rows])
                    first = np.where(home, dist[:, 0], np.minimum(near[rows], dist[:, 0]))[:, None] + 1e-6
                    place, real = np.arange(ids.shape[1])[None, :], ids >= 0
                    post = (dist <= (1 + replicate) * first) & (place < max_copies) & real
                    look = ((dist <= (1 + prune) * first) & (place < max_lists) | (home[:, None] & (place < min_lists))) & real
                    r, c = np.nonzero(post | look)  # side: 1 posted, 2 searches, 3 both
                    for x, y in zip(out, (np.int64(cells[s]) * CELLS + ids[r, c], post[r, c] + 2 * look[r, c], vid[rows][r].astype(np.int64), rows[r]), strict=True):
                        x.append(y)
                    for k in np.flatnonzero(home).tolist():
                        i = int(rows[k])
                        on[0].extend(others[i]), on[1].extend([i] * len(others[i])), on[2].extend([float(dist[k, 0])] * len(others[i]))
            if out[0]:
                lists, side, who, at = map(np.concatenate, out)
                yield _list_rows(pa.array(lists), pa.array(side.astype(np.int8)), pa.array(who), b.column("vec").take(pa.array(at)))
            if on[0]:
                at = pa.array(on[1])
                yield _list_rows(None, None, b.column("vid").take(at), b.column("vec").take(at), pa.array(on[0], pa.int32()), pa.array(on[2]))

    return run


_LISTS = "list bigint, side byte, vid bigint, vec binary, cell int, near double"


def _list_rows(lists, side, vid, vec, cell=None, near=None) -> pa.RecordBatch:
    n = len(vid)
    cols = [lists if lists is not None else pa.nulls(n, pa.int64()), side if side is not None else pa.nulls(n, pa.int8()), vid, vec, cell if cell is not None else pa.nulls(n, pa.int32()), near if near is not None else pa.nulls(n, pa.float64())]
    return pa.RecordBatch.from_arrays(cols, names=["list", "side", "vid", "vec", "cell", "near"])


def fit_cells(points: DataFrame, sizes: dict[int, int], list_rows: int, lists_a_cell: int, leaf: int, max_sample: int) -> dict[int, np.ndarray]:
    """Centroids of the cells of each field: one for `lists_a_cell` lists of `list_rows` vectors, on a hash
    sample of at most `max_sample` rows a field."""
    out = {}
    for f, n in sizes.items():
        cells = min(-(-n // (list_rows * lists_a_cell)), max_sample // leaf)
        rows = F.col("field") == f
        if cells > 1:
            rows &= F.pmod(F.xxhash64("vid"), F.lit(1_000_003)) < F.lit(int(min(1.0, cells * leaf / n) * 1_000_003) + 1)
        got = points.where(rows).select("vid", "vec").limit(max_sample if cells > 1 else 1).toPandas().sort_values("vid")
        if len(got):
            out[f] = fit_centroids(normalised(_matrix(got["vec"])).astype(np.float32), leaf if cells > 1 else 1)
    return out


def place_in_lists(points: DataFrame, dim: int, leaf: int, list_rows: int, lists_a_cell: int, max_sample: int, spread: float, max_cells: int, replicate: float, max_copies: int, prune: float, min_lists: int, max_lists: int, task_rows: int = 8_192) -> DataFrame:
    """(list, side, vid, vec) of the vectors (field, vid, vec): where each is posted and where it searches.

    Lists keep their length and their number grows with the vectors: cells are fitted on a bounded
    sample, lists inside of each cell on a sample of its own, in Spark."""
    spark = points.sparkSession
    sizes = {r.field: r.n for r in points.groupBy("field").agg(F.count("*").alias("n")).collect()}
    cells = fit_cells(points, sizes, list_rows, lists_a_cell, leaf, max_sample)
    graphs_b = spark.sparkContext.broadcast({f: CentroidGraph(c) for f, c in cells.items()})
    homed = staged(points.mapInArrow(_to_cells(graphs_b, spread, max_cells), "vid bigint, vec binary, home int, others array<int>"), "cells")

    held = homed.groupBy("home").agg(F.count("*").alias("n"))  # a row a cell
    share = F.least(F.lit(1.0), F.ceil(F.col("n") / list_rows) * leaf / F.col("n"), F.lit(max_sample) / F.col("n"))
    sample = homed.join(F.broadcast(held.select("home", share.alias("share"))), "home").where(F.pmod(F.xxhash64(F.lit(1), "vid"), F.lit(1_000_003)) < F.floor(F.col("share") * 1_000_003) + 1)
    fitted = staged(sample.select(F.col("home").alias("cell"), "vid", "vec").groupBy("cell").applyInPandas(_fit_cell(leaf), "cell int, vec binary"), "centroids")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number, for the work isn't in the bytes

    def through(rows: DataFrame) -> DataFrame:
        """Rows (cell, vid, vec, near, others) past the centroids of their cell, a cell in as many tasks as it has `task_rows`."""
        parts = staged(rows.groupBy("cell").agg(F.ceil(F.count("*") / task_rows).cast("int").alias("parts")), "cell-parts")
        salted = rows.join(F.broadcast(parts), "cell").withColumn("salt", F.pmod(F.xxhash64("vid"), "parts").cast("int")).drop("parts").withColumn("kind", F.lit(1))
        heads = fitted.join(parts, "cell").select("cell", F.lit(None).cast("bigint").alias("vid"), "vec", F.lit(None).cast("double").alias("near"), F.lit(None).cast("array<int>").alias("others"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("kind"))
        both = salted.unionByName(heads).repartition(tasks, "cell", "salt").sortWithinPartitions("cell", "salt", "kind")
        return both.mapInArrow(_to_lists(dim, replicate, max_copies, prune, min_lists, max_lists), _LISTS)

    first = staged(through(homed.select(F.col("home").alias("cell"), "vid", "vec", F.lit(None).cast("double").alias("near"), "others")), "postings")
    out = first.where("list IS NOT NULL")
    if any(len(c) > 1 for c in cells.values()):
        on = first.where("cell IS NOT NULL").select("cell", "vid", "vec", "near", F.array().cast("array<int>").alias("others"))
        out = out.unionByName(staged(through(on), "postings").where("list IS NOT NULL"))
    return out.select("list", "side", "vid", "vec")


def _block_top(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf[pdf["side"] % 2 == 1], pdf[pdf["side"] >= 2]
        if not len(p) or not len(q):
            return pd.DataFrame({"vid": [], "d": [], "nid": []})
        a, b = normalised(_matrix(q["vec"])), normalised(_matrix(p["vec"]))
        pid, qid = p["vid"].to_numpy(), q["vid"].to_numpy()
        s = a @ b.T
        s[qid[:, None] == pid[None, :]] = -9
        order = np.argsort(pid, kind="stable")  # ties by smaller id
        s, pid = s[:, order], pid[order]
        top = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :k] if s.shape[1] <= 4 * k else _best(s, k)
        got = np.take_along_axis(s, top, 1)
        near = pid[top]
        ok = got.ravel() > -9
        return pd.DataFrame({"vid": np.repeat(qid, top.shape[1])[ok], "d": np.round(-got.ravel()[ok], 12), "nid": near.ravel()[ok]})

    return run


def _best(s: np.ndarray, k: int) -> np.ndarray:
    part = np.argpartition(-s, 2 * k, axis=1)[:, : 2 * k]
    part.sort(axis=1)
    return np.take_along_axis(part, np.argsort(-np.round(np.take_along_axis(s, part, 1), 12), axis=1, kind="stable")[:, :k], 1)


def nearest_in_fields(fields: dict[str, DataFrame], dim: int = 64, k: int = 10, leaf: int = 64, list_rows: int = 512, lists_a_cell: int = 64, max_sample: int = 131_072, spread: float = 0.25, max_cells: int = 16, replicate: float = 0.04, max_copies: int = 4, prune: float = 0.15, min_lists: int = 4, max_lists: int = 64, block: int = 2048, search_block: int = 4096) -> DataFrame:
    """(field, id, neighbour_id, rank, cosine) of the k nearest of each id in the frames (id, vec) of
    each field, all in one plan."""
    names = sorted(fields)
    spark = ship(next(iter(fields.values())).sparkSession)
    src = None
    for f, name in enumerate(names):
        part = fields[name].select(F.lit(f).alias("field"), F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<float>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
        src = part if src is None else src.unionByName(part)
    src = src.where((F.size("vec") == dim) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0))
    rows = src.mapInArrow(_direction_batches, "field int, id bigint, dir binary, vec binary").groupBy("field", "id").agg(F.min(F.struct("vec", "dir")).alias("m"))
    named = staged(rows.select("field", "id", "m.dir", "m.vec"), "vectors")

    # a direction is one row with its k + 1 smallest ids; a hot one keeps k + 1 rows a task
    w = Window.partitionBy("field", "dir").orderBy("id")
    few = named.withColumn("o", F.row_number().over(w)).where(F.col("o") <= k + 1)
    dirs = few.groupBy("field", "dir").agg(F.array_sort(F.collect_list("id")).alias("head"), F.min_by("vec", "id").alias("vec"))
    # the number of a direction is its smallest id and its field, so that all fields share the lists
    dirs = staged(dirs.select("field", "dir", (F.element_at("head", 1) * len(names) + F.col("field")).alias("vid"), "head", "vec"), "directions")

    placed = staged(place_in_lists(dirs.select("field", "vid", "vec"), dim, leaf, list_rows, lists_a_cell, max_sample, spread, max_cells, replicate, max_copies, prune, min_lists, max_lists), "lists")
    # blocks of each side of a list; lists are about `list_rows` long, so nearly all are one block
    posted, looks = F.col("side") % 2 == 1, F.col("side") >= 2
    size = placed.groupBy("list").agg(F.greatest(F.ceil(F.count_if(posted) / block), F.lit(1)).cast("int").alias("np"), F.greatest(F.ceil(F.count_if(looks) / search_block), F.lit(1)).cast("int").alias("nq"))
    size = staged(size.where("np > 1 OR nq > 1"), "long-lists")
    cut = placed.join(size, "list", "left").withColumn("np", F.coalesce("np", F.lit(1))).withColumn("nq", F.coalesce("nq", F.lit(1)))
    own_p, own_q = (F.pmod(F.xxhash64("vid"), F.col(n)).cast("int") for n in ("np", "nq"))
    # a row that is posted meets every block of searches and one that searches every block of
    # postings; in its own block pair a row that does both goes once
    as_post = F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda k: F.struct(own_p.alias("pb"), k.alias("qb"), F.when(looks & (k == own_q), 3).otherwise(1).cast("byte").alias("side")))
    as_look = F.transform(F.sequence(F.lit(0), F.col("np") - 1), lambda k: F.struct(k.alias("pb"), own_q.alias("qb"), F.lit(2).cast("byte").alias("side")))
    as_look = F.when(posted, F.filter(as_look, lambda x: x["pb"] != own_p)).otherwise(as_look)
    none = F.filter(as_post, lambda x: F.lit(False))
    place = F.concat(F.when(posted, as_post).otherwise(none), F.when(looks, as_look).otherwise(none))
    cut = cut.select("list", "vid", "vec", F.explode(place).alias("p")).select("list", "p.pb", "p.qb", "p.side", "vid", "vec")
    tops = cut.groupBy("list", "pb", "qb").applyInPandas(_block_top(k + 1), "vid bigint, d double, nid bigint")
    best = tops.groupBy("vid").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "nid"))), 1, k + 1).alias("near"))

    # from directions to ids: the k + 1 smallest ids of a direction are enough
    several = dirs.where(F.size("head") > 1).select("vid", "head")
    flat = best.select("vid", F.explode("near").alias("s")).select("vid", F.col("s.d").alias("d"), F.col("s.nid").alias("nid"))
    flat = flat.join(several.withColumnRenamed("vid", "nid"), "nid", "left").select("vid", "d", F.explode(F.coalesce("head", F.array(_id_of("nid", len(names))))).alias("nid"))
    own_head = several.select("vid", F.lit(-1.0).alias("d"), F.explode("head").alias("nid"))
    lists = staged(flat.unionByName(own_head).groupBy("vid").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "nid"))), 1, k + 1).alias("near")), "nearest")
    # ids of a direction of one id are known; only copies look their direction up
    alone = lists.join(several.select("vid"), "vid", "left_anti").select(F.pmod("vid", F.lit(len(names))).cast("int").alias("field"), _id_of("vid", len(names)).alias("id"), "near")
    copies = named.select("field", "id", "dir").join(dirs.where(F.size("head") > 1).select("field", "dir", "vid"), ["field", "dir"]).join(lists, "vid").select("field", "id", "near")
    per_id = alone.unionByName(copies).select("field", "id", F.expr(f"slice(filter(near, s -> s.nid <> id), 1, {k})").alias("near"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("field") + 1)
    return per_id.select(name.alias("field"), "id", F.posexplode("near").alias("pos", "s")).select("field", "id", F.col("s.nid").alias("neighbour_id"), (F.col("pos") + 1).cast("int").alias("rank"), (-F.col("s.d")).alias("cosine"))


def _id_of(vid: str, n_fields: int):
    return F.floor(F.col(vid) / n_fields).cast("bigint") if n_fields > 1 else F.col(vid)


def nearest_neighbours(df: DataFrame, id_col: str, vec_col: str, **kw) -> DataFrame:
    """(id, neighbour_id, rank, cosine) of the k nearest of each id."""
    return nearest_in_fields({"": df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))}, **kw).drop("field")


def mutual_pairs(near: DataFrame, least: float) -> DataFrame:
    """(field, a, b), a < b: each among the other's neighbours, at least this cosine."""
    kept = near.where(F.col("cosine") >= least - 1e-9)
    return kept.groupBy("field", F.least("id", "neighbour_id").alias("a"), F.greatest("id", "neighbour_id").alias("b")).agg(F.count("*").alias("n")).where("n > 1").select("field", "a", "b")


def _both(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    q = table(spark, sf_dir, "query_pair")
    return nearest_in_fields({f: q.select(F.col("pair_id").alias("id"), F.col(f).alias("vec")) for f in ("vector", "code_vector")}, **kw)


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutual_pairs(_both(spark, sf_dir), 0.9).select("field", F.col("a").alias("pair_id_a"), F.col("b").alias("pair_id_b"))


def exact_neighbours(df: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 10, every: int = 20) -> DataFrame:
    """(id, neighbour_id) by brute force for the ids divisible by `every`, against all rows; the
    queries are broadcast in blocks."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vector")).where("id is not null").dropDuplicates(["id"])
    named = rows.select(F.lpad(F.col("id").cast("string"), 20, "0").alias("id"), "vector")
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), "vector")
    top = nearest_chunks(named, queries, dim, "vector", k + 1).select(F.col("query_id").alias("id"), F.col("id").cast("bigint").alias("neighbour_id"), "rank")
    others = top.where("id <> neighbour_id")
    w = Window.partitionBy("id").orderBy("rank")
    return others.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("id", "neighbour_id")


def p4_recall(spark: SparkSession, sf_dir: str, list_rows: int = 32) -> DataFrame:
    """Share of the true ten nearest that the index finds, over every row whose id is divisible by
    20, against all rows. Lists are shorter than in p4_found, so that small tables have many of them."""
    q = table(spark, sf_dir, "query_pair")
    got = staged(_both(spark, sf_dir, list_rows=list_rows).select("field", "id", "neighbour_id", F.lit(1).alias("hit")), "neighbours")
    out = None
    for f in ("vector", "code_vector"):
        true = exact_neighbours(q, "pair_id", f)
        r = true.join(got.where(F.col("field") == f).drop("field"), ["id", "neighbour_id"], "left").agg(F.count_distinct("id").alias("n_queries"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
        r = r.select(F.lit(f).alias("field"), "n_queries", "recall")
        out = r if out is None else out.unionByName(r)
    return out
