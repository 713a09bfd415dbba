"""Usage limits with reservations: what a subject used in the last hour and day, what it holds in
flight, and what it may still take. A pure state machine and its streaming form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR_BUCKETS, DAY_BUCKETS, HOLD_SECONDS = 60, 24, 60  # fixed values


@dataclass
class Usage:
    """Tokens by minute and by hour, and the holds of requests in flight."""

    minutes: dict[int, int] = field(default_factory=dict)
    hours: dict[int, int] = field(default_factory=dict)
    holds: dict[int, tuple[int, int]] = field(default_factory=dict)

    def prune(self, now: int) -> None:
        """Drop buckets and holds that no window sees any more."""
        self.minutes = {m: t for m, t in self.minutes.items() if m > now // 60 - HOUR_BUCKETS}
        self.hours = {h: t for h, t in self.hours.items() if h > now // 3600 - DAY_BUCKETS}
        self.holds = {i: (t, at) for i, (t, at) in self.holds.items() if at >= now - HOLD_SECONDS}

    def used(self, now: int) -> tuple[int, int]:
        """(last hour, last day) without holds."""
        self.prune(now)
        return sum(self.minutes.values()), sum(self.hours.values())

    def resets(self, now: int) -> tuple[int, int]:
        """Seconds at which the oldest bucket of each window leaves it."""
        return (min(self.minutes) + HOUR_BUCKETS) * 60 if self.minutes else now, (min(self.hours) + DAY_BUCKETS) * 3600 if self.hours else now

    def reserve(self, number: int, estimate: int, now: int, hourly: int, daily: int) -> str | None:
        """Hold the estimate, or name the window that it would exceed."""
        hour, day = self.used(now)
        held = sum(t for t, _ in self.holds.values())
        if hour + held + estimate > hourly:
            return "hour"
        if day + held + estimate > daily:
            return "day"
        self.holds[number] = (estimate, now)
        return None

    def charge(self, tokens: int, now: int) -> None:
        self.minutes[now // 60] = self.minutes.get(now // 60, 0) + tokens
        self.hours[now // 3600] = self.hours.get(now // 3600, 0) + tokens

    def settle(self, number: int, actual: int, now: int) -> None:
        """The hold becomes what was really used."""
        self.holds.pop(number, None)
        self.charge(actual, now)

    def release(self, number: int) -> None:
        self.holds.pop(number, None)

    def left(self, now: int, hourly: int, daily: int) -> tuple[int, int]:
        hour, day = self.used(now)
        return max(hourly - hour, 0), max(daily - day, 0)

    def pack(self) -> tuple:
        return ([*self.minutes], [*self.minutes.values()], [*self.hours], [*self.hours.values()], [*self.holds], [t for t, _ in self.holds.values()], [a for _, a in self.holds.values()])

    @staticmethod
    def unpack(s: tuple) -> Usage:
        m, mt, h, ht, i, it, ia = s
        return Usage(dict(zip(m, mt, strict=True)), dict(zip(h, ht, strict=True)), {k: (t, a) for k, t, a in zip(i, it, ia, strict=True)})


STATE = "m array<bigint>, mt array<bigint>, h array<bigint>, ht array<bigint>, i array<bigint>, it array<bigint>, ia array<bigint>"
OUT = "subject string, event_id bigint, op string, rejected_by string, hour_left bigint, day_left bigint"


def apply(usage: Usage, op: str, number: int, tokens: int, now: int, hourly: int, daily: int) -> str | None:
    """One event: reserve, settle, release or charge."""
    if op == "reserve":
        return usage.reserve(number, tokens, now, hourly, daily)
    if op == "settle":
        usage.settle(number, tokens, now)
    elif op == "release":
        usage.release(number)
    elif op == "charge":
        usage.charge(tokens, now)
    else:
        raise ValueError(f"unknown operation {op}")
    return None


def replayed(events: DataFrame, hourly: int, daily: int) -> DataFrame:
    """The same decisions for a table of events. Subjects are sorted apart and read as they come, one
    event at a time, so nothing of a subject but its state is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, usage = None, Usage()
        for pdf in batches:
            out = []
            for e in pdf.itertuples():
                if e.subject != subject:
                    subject, usage = e.subject, Usage()
                now = int(e.ts.timestamp())
                why = apply(usage, e.op, int(e.number), int(e.tokens), now, hourly, daily)
                out.append((e.subject, e.event_id, e.op, why, *usage.left(now, hourly, daily)))
            yield pd.DataFrame(out, columns=["subject", "event_id", "op", "rejected_by", "hour_left", "day_left"])

    order = events.select("subject", "event_id", "ts", "op", "number", "tokens").where("subject IS NOT NULL AND ts IS NOT NULL")
    return order.repartition("subject").sortWithinPartitions("subject", "ts", "event_id").mapInPandas(run, OUT)


def limited(events: DataFrame, hourly: int, daily: int) -> DataFrame:
    """Decisions on a stream of (subject, event_id, ts, op, number, tokens), in time order per
    subject and batch. State is bounded: 60 minutes, 24 hours, holds of a minute."""

    def run(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        usage = Usage.unpack(state.get) if state.exists else Usage()
        out = []
        for e in pdf.itertuples():
            now = int(e.ts.timestamp())
            why = apply(usage, e.op, int(e.number), int(e.tokens), now, hourly, daily)
            out.append((str(key[0]), e.event_id, e.op, why, *usage.left(now, hourly, daily)))
        state.update(usage.pack())
        state.setTimeoutDuration(25 * 3600 * 1000)
        yield pd.DataFrame(out, columns=["subject", "event_id", "op", "rejected_by", "hour_left", "day_left"])

    return events.groupBy("subject").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
