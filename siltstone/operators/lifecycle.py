"""Versions of sources: start, finalise, roll back, retire, sweep; and keyed upserts and patches.

Tables are Parquet directories. A change writes the new table beside the old one and flips a one-row
pointer (`publish`), so readers see the whole change or none of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEEP_DEFAULT = 5  # fixed value: versions a source keeps


# --- checks ----------------------------------------------------------------------------------------


def active_violations(versions: DataFrame) -> DataFrame:
    """Sources with more than one active version, and versions whose flag and status differ: no
    rows when all is well."""
    many = versions.where("is_active").groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1").select("source_id", F.lit("several active").alias("why"))
    odd = versions.where("is_active <> (status = 'active')").select("source_id", F.lit("flag and status differ").alias("why")).distinct()
    return many.unionByName(odd)


def model_violations(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks whose embedding isn't of their version's model."""
    v = versions.select(F.col("id").alias("source_version_id"), F.col("embedding_model_id").alias("want"))
    return chunks.where("embedding IS NOT NULL").join(v, "source_version_id").where(~F.col("embedding_model_id").eqNullSafe(F.col("want"))).select("id", "source_version_id", "embedding_model_id", "want")


def dimension_violations(chunks: DataFrame, column: str, dim: int) -> DataFrame:
    return chunks.where(F.col(column).isNotNull() & (F.size(column) != dim)).select("id", F.size(column).alias("dim"))


def next_revision(versions: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, revision) of the next run, 1 for a source without versions."""
    top = versions.groupBy("source_id").agg(F.max("revision").alias("r"))
    return sources.select(F.col("id").alias("source_id")).join(top, "source_id", "left").select("source_id", (F.coalesce("r", F.lit(0)) + 1).cast("int").alias("revision"))


def may_start(versions: DataFrame, models: DataFrame, model_name: str) -> DataFrame:
    """One row (allowed): a run must use the model the active corpus uses, if there is one."""
    used = versions.where("is_active").join(models.select(F.col("id").alias("embedding_model_id"), "name"), "embedding_model_id").agg(F.collect_set("name").alias("names"))
    return used.select(((F.size("names") == 0) | F.array_contains("names", model_name)).alias("allowed"))


def completeness(documents: DataFrame, version_id: str, expected: int) -> DataFrame:
    """One row (n_documents, complete): the guard before a version becomes active."""
    n = documents.where(F.col("source_version_id") == version_id).agg(F.count_distinct("id").alias("n_documents"))
    return n.select("n_documents", (F.col("n_documents") == expected).alias("complete"))


# --- transitions: each gives the whole new version table -------------------------------------------


def promoted(versions: DataFrame, version_id: str, as_of: str) -> DataFrame:
    """The version becomes the active one of its source; the one before becomes inactive."""
    mine = F.col("id") == version_id
    same = F.max(F.when(mine, F.lit(True))).over(Window.partitionBy("source_id")).isNotNull()
    status = F.when(mine, "active").when(same & F.col("is_active"), "inactive").otherwise(F.col("status"))
    return versions.withColumn("_same", same).withColumn("status", status).withColumn("is_active", F.when(mine, True).when(F.col("_same"), False).otherwise(F.col("is_active"))).withColumn("ingested_at", F.when(mine & F.col("ingested_at").isNull(), F.to_timestamp(F.lit(as_of))).otherwise(F.col("ingested_at"))).drop("_same")


def finalised(versions: DataFrame, version_id: str, as_of: str) -> DataFrame:
    """Promotes a building version; another status is an error of the caller and changes nothing."""
    ok = F.max(F.when((F.col("id") == version_id) & (F.col("status") == "building"), 1)).over(Window.partitionBy("source_id"))
    new = promoted(versions, version_id, as_of)
    old = versions.withColumn("_ok", ok).select("id", "_ok")
    out = new.join(old, "id").join(versions.select("id", F.col("status").alias("_s"), F.col("is_active").alias("_a")), "id")
    return out.withColumn("status", F.when(F.col("_ok").isNotNull(), F.col("status")).otherwise(F.col("_s"))).withColumn("is_active", F.when(F.col("_ok").isNotNull(), F.col("is_active")).otherwise(F.col("_a"))).select(versions.columns)


def rolled_back(versions: DataFrame, source_id: str, revision: int, as_of: str) -> DataFrame:
    """An inactive revision becomes active again."""
    target = (F.col("source_id") == source_id) & (F.col("revision") == revision) & F.col("status").isin("inactive", "active")
    hit = F.max(F.when(target, 1)).over(Window.partitionBy("source_id")).isNotNull()
    status = F.when(F.col("_hit") & target, "active").when(F.col("_hit") & F.col("is_active"), "inactive").otherwise(F.col("status"))
    return versions.withColumn("_hit", hit).withColumn("status", status).withColumn("is_active", F.when(F.col("_hit"), target).otherwise(F.col("is_active"))).drop("_hit")


def with_status(versions: DataFrame, version_id: str, old: str, new: str, as_of: str | None = None) -> DataFrame:
    """building -> aborted, inactive -> retired: only from the old status."""
    hit = (F.col("id") == version_id) & (F.col("status") == old)
    out = versions.withColumn("_hit", hit)
    out = out.withColumn("status", F.when(F.col("_hit"), new).otherwise(F.col("status"))).withColumn("is_active", F.col("is_active") & ~F.col("_hit"))
    if as_of:
        out = out.withColumn("retired_at", F.when(F.col("_hit"), F.coalesce("retired_at", F.to_timestamp(F.lit(as_of)))).otherwise(F.col("retired_at")))
    return out.drop("_hit")


def source_retired(sources: DataFrame, slug: str, as_of: str) -> DataFrame:
    """Soft delete; the first time stays."""
    return sources.withColumn("retired_at", F.when(F.col("slug") == slug, F.coalesce("retired_at", F.to_timestamp(F.lit(as_of)))).otherwise(F.col("retired_at")))


def with_license(sources: DataFrame, source_id: str, license_: list[str] | None) -> DataFrame:
    value = F.lit(None).cast("array<string>") if license_ is None else F.array(*map(F.lit, license_))
    return sources.withColumn("license", F.when(F.col("id") == source_id, value).otherwise(F.col("license")))


# --- sweeps ----------------------------------------------------------------------------------------


def swept_versions(versions: DataFrame, sources: DataFrame, as_of: str, grace_days: int, keep: int | None = None) -> DataFrame:
    """Versions to delete: beyond the newest `retention_count` of their source, not active or
    building, and older than the grace."""
    s = sources.select(F.col("id").alias("source_id"), F.coalesce("retention_count", F.lit(KEEP_DEFAULT)).alias("keep"))
    w = Window.partitionBy("source_id").orderBy(F.desc("revision"), "id")
    ranked = versions.where("status IN ('active', 'inactive', 'retired')").join(s, "source_id").withColumn("place", F.row_number().over(w))
    limit = F.col("keep") if keep is None else F.lit(keep)
    old = F.col("ingested_at") < F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {int(grace_days)} DAYS")
    return ranked.where((F.col("place") > limit) & F.col("status").isin("inactive", "retired") & old)


def swept_sources(sources: DataFrame, as_of: str, grace_days: int) -> DataFrame:
    return sources.where(F.col("retired_at") < F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {int(grace_days)} DAYS"))


def swept_aborted(versions: DataFrame, as_of: str, grace_days: int) -> DataFrame:
    return versions.where((F.col("status") == "aborted") & (F.col("ingested_at") < F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {int(grace_days)} DAYS")))


def sweep_once(versions: DataFrame, sources: DataFrame, as_of: str, grace_days: int) -> DataFrame:
    """(kind, id) of all that a sweep deletes."""
    return (
        swept_sources(sources, as_of, grace_days).select(F.lit("source").alias("kind"), "id")
        .unionByName(swept_versions(versions, sources, as_of, grace_days).select(F.lit("version").alias("kind"), "id"))
        .unionByName(swept_aborted(versions, as_of, grace_days).select(F.lit("aborted").alias("kind"), "id"))
    )


# --- keyed changes ---------------------------------------------------------------------------------


def upserted(old: DataFrame, new: DataFrame, key: list[str], newest: str = "_new") -> DataFrame:
    """New rows replace old ones of their key; of several new ones any deterministic last wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("_new"), *[F.desc(c) for c in old.columns if c not in key and not dict(old.dtypes)[c].startswith("map")])
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def upsert_conflicts(old: DataFrame, new: DataFrame, key: list[str], fixed: list[str]) -> DataFrame:
    """New rows that would change what identifies an old one."""
    o = old.select(*key, *[F.col(c).alias(f"old_{c}") for c in fixed])
    differs = F.lit(False)
    for c in fixed:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return new.join(o, key).where(differs)


def patched(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Given columns of a patch replace those of its row, missing ones leave them."""
    p = patches.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    out = rows.join(p, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"new_{c}", c))
    return out.select(rows.columns)


def removed(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def embedded(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of (id, vector) set where the chunk had failed, and only there."""
    v = vectors.select("id", F.col("vector").alias("_v"))
    hit = (F.col("status") == "embed_failed") & F.col("_v").isNotNull()
    return chunks.join(v, "id", "left").withColumn("embedding", F.when(hit, F.col("_v")).otherwise(F.col("embedding"))).withColumn("status", F.when(hit, "ready").otherwise(F.col("status"))).select(chunks.columns)


def roots_created(nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """Root nodes that versions lack, with ids made from the version."""
    have = nodes.where("kind = 'root'").select("source_version_id")
    lack = versions.select(F.col("id").alias("source_version_id")).join(have, "source_version_id", "left_anti")
    return lack.select(F.concat(F.lit("root-"), F.col("source_version_id")).alias("id"), "source_version_id", F.lit(None).cast("string").alias("parent_node_id"), F.lit("root").alias("kind"), F.lit("/").alias("name"), F.lit(0).alias("order_index"))


# --- publishing ------------------------------------------------------------------------------------


def publish(df: DataFrame, base: str) -> str:
    """Write the table under a new name, then point to it; gives the new path."""
    path = f"{base}/data-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").json(f"{base}/pointer")
    return path


def published(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(spark.read.schema("path string").json(f"{base}/pointer").first().path)


def status_of(embedding: Column) -> Column:
    """Status a new chunk lands with."""
    return F.when(embedding.isNull(), "embed_failed").otherwise("ready")
