"""Writing corpus tables and reading them back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from siltstone.operators.lifecycle import status_of

VERSIONED = ("new_document", "chunk")  # tables partitioned by version


def append(df: DataFrame, base: str, name: str) -> None:
    """Rows of the big tables go to the partition of their version, in one job a run."""
    w = df.write.mode("append")
    if name in VERSIONED:
        w = w.partitionBy("source_version_id")
    w.parquet(f"{base}/{name}")


def append_chunks(df: DataFrame, base: str) -> None:
    append(df.withColumn("status", status_of(F.col("embedding"))), base, "chunk")


def append_unique(df: DataFrame, base: str, name: str, key: list[str]) -> int:
    """Rows whose key isn't there yet (sources, nodes, overrides); gives the number of conflicts."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(f"{base}/{name}").select(*key)
    except Exception as e:  # noqa: BLE001 - no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], df.select(*key).schema)
    fresh = df.join(old, key, "left_anti").dropDuplicates(key)
    n = df.count() - fresh.count()
    append(fresh, base, name)
    return n


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}")


def embed_texts(df: DataFrame, text_col: str, out_col: str, embed) -> DataFrame:
    """A vector column by a plug-in: `embed(list of texts) -> list of vectors`, called per Arrow
    batch in the workers."""
    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embed(texts.fillna("").tolist())))

    return df.withColumn(out_col, run(text_col))


def hashed_vectors(dim: int = 64):
    """A deterministic stand-in for an embedding model: signed feature hashing of words."""
    def embed(texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dim
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h & (1 << 20) else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n if n else 0.0 for x in v])
        return out

    return embed
