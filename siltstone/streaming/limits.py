"""Streaming forms of the limits: token buckets, usage windows, rollups, duplicate removal."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKET_OUT = "subject string, event_id bigint, ts timestamp, allowed boolean, remaining int, retry_after bigint"


def charge(tokens: float, last: float, now: float, rate: float, cost: float) -> tuple[float, bool, int]:
    """(tokens left, allowed, seconds to wait): refilled by the time gone, up to one second's worth;
    a negative cost gives tokens back."""
    tokens = min(tokens + max(0.0, now - last) * rate, rate)
    if cost < 0:
        return min(tokens - cost, rate), True, 0
    if tokens >= cost:
        return tokens - cost, True, 0
    wait = -int(-(cost - tokens) // rate) if rate > 0 else 2**63 - 1
    return tokens, False, max(1, wait)


def bucket_batch(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState, rate: float) -> Iterator[pd.DataFrame]:
    """One subject's events of a batch in time order; state is (tokens, last second). A subject
    that stays idle leaves the state store."""
    if state.hasTimedOut:
        state.remove()
        return
    pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
    tokens, last = state.get if state.exists else (rate, pdf["ts"].iloc[0].timestamp())
    out = []
    for e in pdf.itertuples():
        now = e.ts.timestamp()
        tokens, ok, wait = charge(tokens, last, now, rate, e.cost)
        last = max(last, now)
        out.append((str(key[0]), e.event_id, e.ts, ok, int(tokens), wait))
    state.update((float(tokens), float(last)))
    state.setTimeoutDuration(600_000)
    yield pd.DataFrame(out, columns=["subject", "event_id", "ts", "allowed", "remaining", "retry_after"])


def token_buckets(events: DataFrame, rate: float) -> DataFrame:
    """Decisions for a stream of (subject, event_id, ts, cost)."""
    def run(key: Any, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from bucket_batch(key, rows, state, rate)

    return events.groupBy("subject").applyInPandasWithState(run, BUCKET_OUT, "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def replayed_buckets(events: DataFrame, rate: float) -> DataFrame:
    """The same decisions for a table of (subject, event_id, ts, cost), subjects sorted apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, tokens, last = None, rate, 0.0
        for pdf in batches:
            out = []
            for e in pdf.itertuples():
                now = e.ts.timestamp()
                if e.subject != subject:
                    subject, tokens, last = e.subject, rate, now
                tokens, ok, wait = charge(tokens, last, now, rate, e.cost)
                last = max(last, now)
                out.append((e.subject, e.event_id, e.ts, ok, int(tokens), wait))
            yield pd.DataFrame(out, columns=["subject", "event_id", "ts", "allowed", "remaining", "retry_after"])

    order = events.select("subject", "event_id", "ts", "cost").where("subject IS NOT NULL AND ts IS NOT NULL")
    return order.repartition("subject").sortWithinPartitions("subject", "ts", "event_id").mapInPandas(run, BUCKET_OUT)


def hourly_usage(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tokens by subject and hour of a stream, late rows up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "subject").agg(F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("hour"), "subject", "tokens")


def rolling_usage(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tokens by subject in sliding hours."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour", "1 minute"), "subject").agg(F.sum("tokens").alias("tokens")).select(F.col("window.end").alias("until"), "subject", "tokens")


def event_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows by type and hour."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a subject, ended by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "subject").agg(F.count("*").alias("n")).select("subject", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def with_overrides(read_overrides, out_path: str) -> Any:
    """A foreachBatch function that reads the overrides anew for each batch and appends its rows
    with the override that applies."""
    from siltstone.operators.quota import by_network

    def run(batch: DataFrame, _: int) -> None:
        by_network(batch, read_overrides(batch.sparkSession)).write.mode("append").parquet(out_path)

    return run
