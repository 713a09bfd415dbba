"""Facet values, corpus overviews, coverage, centroids: small results from whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scoring import l2_normalised, nearest_centroid, topic_label
from siltstone.model import ATTRIBUTIONS, Corpus
from siltstone.session import ship, staged

TOP_TARGETS, TOP_CONSTRAINTS, TOP_VALUES = 6, 5, 10  # fixed values


def live_documents(corpus: Corpus) -> DataFrame:
    """Documents of active versions of sources that aren't retired, with their source."""
    v = corpus.active_versions.select(F.col("id").alias("source_version_id"), "source_id", "ingested_at")
    s = corpus.sources.where("retired_at IS NULL").select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug"), F.col("kind").alias("source_kind"))
    return corpus.wide_documents.join(v, "source_version_id").join(s, "source_id")


def facet_values(corpus: Corpus, facet: str) -> DataFrame:
    """(value, n): values of a facet with the number of live documents."""
    d = live_documents(corpus)
    prov = F.col("provenance")
    one: dict[str, Column] = {"language": F.col("language"), "kind": F.col("kind"), "source_slug": F.col("source_slug"), "source_kind": F.col("source_kind"), "attribution": F.coalesce(prov["attribution"], F.lit("unknown")), "content_type": F.coalesce(prov["content_type"], F.lit("other"))}
    if facet in one:
        rows = d.select("id", one[facet].alias("value"))
    elif facet == "tags":
        rows = d.select("id", F.explode(prov["tags"]).alias("value"))
    elif facet == "language_target":
        rows = d.select("id", F.explode(prov["language_targets"]).alias("t")).select("id", F.col("t.name").alias("value"))
    elif facet == "sdk_dependency":
        rows = d.select("id", F.explode(prov["sdk_dependencies"]).alias("t")).select("id", F.col("t.name").alias("value"))
    elif facet == "package":
        p = corpus.packages.select(F.col("id").alias("package_id"), F.col("name").alias("value"))
        rows = d.join(p, "package_id").select("id", "value")
    else:
        raise ValueError(f"{facet} has no values to list")
    return rows.where("value IS NOT NULL").groupBy("value").agg(F.count_distinct("id").alias("n"))


def facet_total(corpus: Corpus, facet: str, approximate: bool = False) -> DataFrame:
    """Number of distinct values; exact unless asked otherwise."""
    f = F.approx_count_distinct if approximate else F.count_distinct
    return facet_values(corpus, facet).agg(f("value").alias("n_values"))


def facet_samples(corpus: Corpus) -> DataFrame:
    """(facet, value, n): all languages and slugs, the most frequent tags and packages."""
    out = None
    for facet, top in (("language", None), ("source_slug", None), ("tags", TOP_VALUES), ("package", TOP_VALUES)):
        v = facet_values(corpus, facet)
        v = v.orderBy(F.desc("n"), "value").limit(top) if top else v
        v = v.select(F.lit(facet).alias("facet"), "value", "n")
        out = v if out is None else out.unionByName(v)
    return out


def sources_by_kind(corpus: Corpus) -> DataFrame:
    return corpus.sources.where("retired_at IS NULL").groupBy("kind").agg(F.count("*").alias("n_sources"))


def attribution_rank(c: Column) -> Column:
    """0 for the strongest origin."""
    out = F.lit(len(ATTRIBUTIONS) - 1)
    for i, a in enumerate(ATTRIBUTIONS):
        out = F.when(c == a, F.lit(i)).otherwise(out)
    return out


def sources_by_attribution(corpus: Corpus) -> DataFrame:
    """(attribution, n_sources): each source counts by the strongest origin of its documents; one
    without documents as unknown."""
    rank = attribution_rank(F.coalesce(F.col("provenance.attribution"), F.lit("unknown")))
    per = live_documents(corpus).groupBy("source_id").agg(F.min(rank).alias("r"))
    s = corpus.sources.where("retired_at IS NULL").select(F.col("id").alias("source_id")).join(per, "source_id", "left")
    names = F.array(*map(F.lit, ATTRIBUTIONS))
    return s.groupBy(F.element_at(names, F.coalesce("r", F.lit(len(ATTRIBUTIONS) - 1)) + 1).alias("attribution")).agg(F.count("*").alias("n_sources"))


def version_coverage(corpus: Corpus, targets: int = TOP_TARGETS, constraints: int = TOP_CONSTRAINTS) -> DataFrame:
    """(target, place, version_constraint, n): the constraints most documents declare, for the
    targets most documents declare."""
    t = live_documents(corpus).select("id", F.explode("provenance.language_targets").alias("t")).select("id", F.col("t.name").alias("target"), F.col("t.version_constraint").alias("version_constraint")).where("target IS NOT NULL AND version_constraint IS NOT NULL")
    n = t.groupBy("target", "version_constraint").agg(F.count("*").alias("n"))
    total = n.groupBy("target").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "target").limit(targets)
    w = Window.partitionBy("target").orderBy(F.desc("n"), "version_constraint")
    return n.join(total, "target").withColumn("place", F.row_number().over(w)).where(F.col("place") <= constraints).select("target", "place", "version_constraint", "n")


def freshness(corpus: Corpus) -> DataFrame:
    d = live_documents(corpus)
    at = F.coalesce("source_modified_at", "ingested_at")
    return d.agg(F.min(at).alias("oldest"), F.max(at).alias("newest"), F.count("*").alias("n_documents"))


def ingest_status(corpus: Corpus) -> DataFrame:
    """(slug, total, ready, embed_failed) of every source, also of those without an active version."""
    v = corpus.active_versions.select(F.col("id").alias("source_version_id"), "source_id")
    c = corpus.chunks.select("id", "source_version_id", "status").join(v, "source_version_id").select("source_id", "status")
    n = c.groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "embed_failed").alias("embed_failed"))
    return corpus.sources.select(F.col("id").alias("source_id"), "slug").join(n, "source_id", "left").select("slug", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "ready", "embed_failed")])


def inventory(corpus: Corpus) -> DataFrame:
    """(document_id, source_path, n_chunks, n_failed, complete) of active versions."""
    v = corpus.active_versions.select(F.col("id").alias("source_version_id"))
    d = corpus.documents.join(v, "source_version_id", "left_semi").select(F.col("id").alias("document_id"), "source_path")
    n = corpus.chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "embed_failed").alias("f"))
    return d.join(n, "document_id", "left").select("document_id", "source_path", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce("f", F.lit(0)).alias("n_failed"), ((F.coalesce("n", F.lit(0)) > 0) & (F.coalesce("f", F.lit(0)) == 0)).alias("complete"))


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding", normalise: bool = True) -> DataFrame:
    """(label, centroid, n): mean vector of each label. Vectors are summed in Arrow batches, so that one
    row a label and task is shuffled, whatever the number of vectors."""
    ship(vectors.sparkSession)
    src = vectors.where(F.col(vector).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            flat = [(k[0], *v) for k, v in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.list_(pa.float64())), pa.array([x[2] for x in flat], pa.list_(pa.int64()))], names=["label", "s", "k"])

        for b in batches:
            names = b.column(0).dictionary_encode()
            of = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)
            words = [*names.dictionary.to_pylist(), None]
            sizes = np.diff(b.column(1).offsets.to_numpy())
            flat = b.column(1).flatten()
            there = np.asarray(flat.is_valid())
            x = np.where(there, flat.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
            at = np.r_[0, np.cumsum(sizes)][:-1]
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                place = at[rows][:, None] + np.arange(d)[None, :]
                for g in np.unique(of[rows]):
                    mine = place[of[rows] == g]
                    old = sums.setdefault((words[g], int(d)), [np.zeros(d), np.zeros(d, np.int64)])
                    old[0] += x[mine].sum(0)
                    old[1] += there[mine].sum(0)
            if len(sums) > 10_000:
                yield out()
        if sums:
            yield out()

    part = src.mapInArrow(run, "label string, s array<double>, k array<bigint>").select("label", F.posexplode(F.arrays_zip("s", "k")).alias("pos", "z"))
    each = part.groupBy("label", "pos").agg((F.sum("z.s") / F.sum("z.k")).alias("m"), F.sum("z.k").alias("k"))
    back = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"), F.max("k").alias("n"))
    return back.withColumn("centroid", l2_normalised(F.col("centroid"))) if normalise else back


LABEL_BLOCK = 1000  # labels whose centroids are literals of the plan at once


def topics(rows: DataFrame, vector: str, centroid_rows: DataFrame, least: float) -> DataFrame:
    """Rows with the label of their nearest centroid (label, centroid); every label counts, in blocks of
    LABEL_BLOCK, which bound what is on the driver. 'other' below `least` or without a vector."""
    cs = staged(centroid_rows.where("label IS NOT NULL").select("label", "centroid"), "centroids")
    blocks = -(-cs.count() // LABEL_BLOCK)
    nearest = []
    for k in range(blocks):
        mine = cs.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == k).orderBy("label").collect()
        if mine:
            nearest.append(nearest_centroid(F.col(vector), F.array(*[F.struct(F.lit(r.label).alias("label"), F.array(*[F.lit(float(x)) for x in r.centroid]).alias("centroid")) for r in mine])))
    if not nearest:
        return rows.withColumn("topic", F.lit("other"))
    best = nearest[0] if len(nearest) == 1 else F.greatest(*nearest)
    return rows.withColumn("topic", topic_label(best, least))


def label_centroids(corpus: Corpus) -> DataFrame:
    """Centroids of the chunks of each source kind on the corpus model."""
    v = corpus.active_versions.select(F.col("id").alias("source_version_id"), "source_id")
    s = corpus.sources.select(F.col("id").alias("source_id"), F.col("kind").alias("label"))
    c = corpus.chunks.where("status = 'ready' AND embedding IS NOT NULL").select("source_version_id", "embedding").join(v, "source_version_id").join(s, "source_id")
    return centroids(c)


def daily_events(events: DataFrame) -> DataFrame:
    """(day, event_type, n)."""
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


def search_rollup(queries: DataFrame) -> DataFrame:
    """(day, mode, code_mode, client, n, with_vector): what was asked a day."""
    return queries.groupBy(F.to_date("asked_at").alias("day"), "mode", "code_mode", "client").agg(F.count("*").alias("n"), F.count("vector").alias("with_vector"))


def sources_off_model(corpus: Corpus, model_id: Column) -> DataFrame:
    """(slug, best_rank): sources whose active version isn't on a model, with the best attribution of
    their documents (0 is the best), those first."""
    a = corpus.documents.groupBy("source_version_id").agg(F.min(attribution_rank(F.coalesce(F.col("provenance.attribution"), F.lit("unknown")))).alias("best_rank"))
    v = corpus.active_versions.where(F.col("embedding_model_id") != model_id).select(F.col("id").alias("source_version_id"), "source_id")
    return v.join(corpus.sources.select(F.col("id").alias("source_id"), "slug"), "source_id").join(a, "source_version_id", "left").select("slug", "best_rank").orderBy(F.asc_nulls_last("best_rank"), "slug")


def overview_block(parts: dict[str, DataFrame]) -> DataFrame:
    """(section, payload): each part as one JSON array in a fixed order; parts are capped lists."""
    out = None
    for name, df in parts.items():
        j = df.select(F.to_json(F.struct(*df.columns)).alias("j")).agg(F.array_sort(F.collect_list("j")).alias("js"))
        j = j.select(F.lit(name).alias("section"), F.concat(F.lit("["), F.array_join("js", ","), F.lit("]")).alias("payload"))
        out = j if out is None else out.unionByName(j)
    return out


class Cached:
    """Rows of a small result, computed again after `seconds`."""

    def __init__(self, build, seconds: float = 60.0, clock=None):
        import time

        self.build, self.seconds, self.clock = build, seconds, clock or time.monotonic
        self.rows, self.at = None, None

    def get(self) -> list:
        now = self.clock()
        if self.at is None or now - self.at >= self.seconds:
            self.rows, self.at = self.build().collect(), now
        return self.rows
