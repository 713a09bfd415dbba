"""Session helpers: the shared folder for written stages and code shipping."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
_SHIPPED: set[str] = set()
_STAGED: dict[str, set[str]] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siltstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only where that is unset, as in
    tests on one machine, a temporary folder of this process is used."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="siltstone-")
    return _OWN_DIR[app]


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again: the lineage is cut, the
    result survives lost executors, and every later use reads it instead of computing it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    _STAGED.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unstage(df: DataFrame) -> None:
    """Delete a written stage that nothing reads any more."""
    if path := getattr(df, "_staged_at", None):
        _STAGED.get(df.sparkSession.sparkContext.applicationId, set()).discard(path)
        _delete(df.sparkSession, path)


def drop_staged(spark: SparkSession) -> None:
    """Delete all stages of this application: for the end of a query, after its result is written."""
    for path in _STAGED.pop(spark.sparkContext.applicationId, set()):
        _delete(spark, path)


def drop_own_dir(spark: SparkSession) -> None:
    """Remove what `staged` wrote where spark.checkpoint.dir was unset."""
    path = _OWN_DIR.pop(spark.sparkContext.applicationId, None)
    if path:
        shutil.rmtree(path, ignore_errors=True)


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in every Python worker, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        shared = shared_dir(spark).removeprefix("file://")
        # a shared folder that is mounted takes the archive; from elsewhere Spark's file server sends it
        base = Path(shared) / "siltstone" / f"code-{uuid.uuid4().hex}" if shared.startswith("/") else Path(tempfile.mkdtemp(prefix="siltstone-code-"))
        base.mkdir(parents=True, exist_ok=True)
        target = base / "siltstone.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, os.path.join("siltstone", f.relative_to(root)))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
