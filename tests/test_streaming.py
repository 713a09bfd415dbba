"""Streams against a batch recomputation of the same rows."""

import pandas as pd
from pyspark.sql import functions as F

from siltstone.streaming import limits, usage

SF = "/root/testdata/sf0.001"


def run(spark, df, name, mode="append"):
    # one batch: with processing-time timeouts another batch is always due, so availableNow never ends
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(once=True).start()
    assert q.awaitTermination(100)
    return spark.sql(f"SELECT * FROM {name}")


def stream(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("subject"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("tokens"), F.lit(1.0).alias("cost"))
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    return src, spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))


def test_event_counts(spark, tmp_path):
    src, s = stream(spark, tmp_path)
    got = run(spark, limits.event_counts(s), "ec", "complete").toPandas()
    want = src.groupBy(F.window("ts", "1 hour"), "event_type").count().select(F.col("window.start").alias("hour"), "event_type", F.col("count").alias("n")).toPandas()
    key = ["hour", "event_type"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True))


def test_usage_and_repeats(spark, tmp_path):
    src, s = stream(spark, tmp_path)
    got = run(spark, limits.hourly_usage(s), "hu", "complete").agg(F.sum("tokens").alias("t")).first().t
    assert got == src.where("subject is not null").agg(F.sum("tokens").alias("t")).first().t or got == src.agg(F.sum("tokens").alias("t")).first().t
    assert run(spark, limits.without_repeats(s), "wr").count() == src.select("event_id").distinct().count()


def test_token_buckets_equal_a_replay(spark, tmp_path):
    src, s = stream(spark, tmp_path)
    got = {r.event_id: (r.allowed, r.remaining) for r in run(spark, limits.token_buckets(s, 2.0), "tb").collect()}
    want = {}
    for _, pdf in src.toPandas().sort_values(["ts", "event_id"]).groupby("subject"):
        tokens, last = 2.0, None
        for e in pdf.itertuples():
            now = e.ts.timestamp()
            tokens, ok, _ = limits.charge(tokens, now if last is None else last, now, 2.0, 1.0)
            last = now
            want[e.event_id] = (ok, int(tokens))
    assert got == want


def test_reservations():
    u = usage.Usage()
    assert u.reserve(1, 60, 1000, 100, 1000) is None and u.reserve(2, 60, 1001, 100, 1000) == "hour"
    u.settle(1, 10, 1002)
    assert u.reserve(2, 60, 1003, 100, 1000) is None and u.left(1003, 100, 1000) == (90, 990)
    u.release(2)
    assert u.reserve(3, 90, 1004, 100, 95) == "day" and u.reserve(3, 80, 1004, 100, 95) is None
    assert u.reserve(4, 90, 1004 + 61, 100, 1000) is None  # the hold of 3 has lapsed
    u.holds = {}
    assert u.used(1002 + 3600) == (0, 10) and u.used(1002 + 86400) == (0, 0)
    assert usage.Usage.unpack(u.pack()) == u


def test_limits_equal_a_replay(spark, tmp_path):
    src, s = stream(spark, tmp_path)
    shaped = lambda d: d.select("subject", "event_id", "ts", F.when(F.col("event_id") % 3 == 0, "charge").otherwise("reserve").alias("op"), F.col("event_id").alias("number"), "tokens")
    got = {r.event_id: (r.rejected_by, r.hour_left) for r in run(spark, usage.limited(shaped(s), 9000, 40_000), "lim").collect()}
    want = {}
    for _, pdf in shaped(src).toPandas().sort_values(["ts", "event_id"]).groupby("subject"):
        u = usage.Usage()
        for e in pdf.itertuples():
            now = int(e.ts.timestamp())
            why = usage.apply(u, e.op, e.number, e.tokens, now, 9000, 40_000)
            want[e.event_id] = (why, u.left(now, 9000, 40_000)[0])
    assert got == want and any(w for w, _ in want.values())
