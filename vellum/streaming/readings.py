"""Readings of papers out of the event log, as a stream with state and as a batch.

A reading of a paper begins with an opening event. Notes that come before its end belong to it, and a new reading's notes take
the place of the last one's. A terminal event closes it with an outcome; a second opening closes it as interrupted, and so does
a worker that says nothing for `patience` after the opening: then the reading is closed at that time, by a timer on the event
time. Notes and terminal events without an open reading count for nothing.

As a stream, events are held until the watermark has passed them and then taken in the order of (ts, event_id), so their order
of arrival doesn't matter; what comes later than the watermark is left out. A paper's state is its open reading (a few numbers)
and its events of the last `late` minutes and of one micro-batch, which maxFilesPerTrigger bounds. Rows are final when they are written, so the output is appended to, and a stream that
is started again from its checkpoint goes on where it stopped. As a batch, the same rows come from windows over a paper's events.

Nulls: events without a paper, a time or a type are passed over. Repeated events (same paper, time and id) count once. A paper's events
run through one task in order, a batch of rows at a time, in either form; memory doesn't grow with their number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

READINGS = "paper long, reading long, opened_at timestamp, closed_at timestamp, outcome string, notes long, last_note long"
_STATE = "done long, opened long, reading long, notes long, last_note long, waiting string"


@dataclass(frozen=True)
class Rules:
    """Types of the events that open a reading, are its notes, and close it (with their outcomes), and the minutes of patience."""

    opening: str = "click"
    notes: tuple[str, ...] = ("view", "signup")
    closing: tuple[tuple[str, str], ...] = (("purchase", "parsed"), ("error", "failed"))
    patience: int = 240

    @property
    def micros(self) -> int:
        return self.patience * 60_000_000


class Reader:
    """One paper's state."""

    def __init__(self, rules: Rules, paper: int, kept: tuple | None = None):
        self.rules, self.paper = rules, paper
        self.outcomes = dict(rules.closing)
        self.done, self.opened, self.reading, self.notes, self.last_note, waiting = kept or (-1 << 62, None, None, 0, None, "[]")
        self.waiting: list[list] = json.loads(waiting)
        self.rows: list[tuple] = []

    def close(self, at: int, outcome: str) -> None:
        self.rows.append((self.paper, self.reading, self.opened, at, outcome, self.notes, self.last_note))
        self.opened = self.reading = self.last_note = None
        self.notes = 0

    def take(self, ts: int, event: int, kind: str) -> None:
        self.expire(ts)
        if kind == self.rules.opening:
            if self.opened is not None:
                self.close(ts, "interrupted")
            self.opened, self.reading = ts, event
        elif self.opened is not None and kind in self.outcomes:
            self.close(ts, self.outcomes[kind])
        elif self.opened is not None and kind in self.rules.notes:
            self.notes, self.last_note = self.notes + 1, event

    def expire(self, now: int) -> None:
        """A reading whose patience ended before now is closed at its end."""
        if self.opened is not None and self.opened + self.rules.micros < now:
            self.close(self.opened + self.rules.micros, "interrupted")

    def advance(self, events: list[list], watermark: int) -> None:
        """Take in what the watermark has passed, and keep the rest waiting."""
        own = {(ts, event): kind for ts, event, kind in [*self.waiting, *events] if ts >= self.done}
        for (ts, event), kind in sorted(own.items()):
            if ts < watermark:
                self.take(ts, event, kind)
        self.waiting = [[ts, event, kind] for (ts, event), kind in sorted(own.items()) if ts >= watermark]
        self.expire(watermark)
        self.done = max(self.done, watermark)

    def kept(self) -> tuple:
        return self.done, self.opened, self.reading, self.notes, self.last_note, json.dumps(self.waiting)

    def next_time(self) -> int | None:
        """When something is to be done if no event comes."""
        times = [self.waiting[0][0]] if self.waiting else []
        if self.opened is not None:
            times.append(self.opened + self.rules.micros)
        return min(times) if times else None


def _events(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("paper"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("kind")).filter("paper is not null and ts is not null and kind is not null")


def stream(events: DataFrame, rules: Rules = Rules(), late: str = "10 minutes") -> DataFrame:
    """A streaming DataFrame of events to one of closed readings, for output mode append."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reader = Reader(rules, int(key[0]), tuple(state.get) if state.exists else None)
        watermark = state.getCurrentWatermarkMs() * 1000
        come: list[list] = []
        if not state.hasTimedOut:
            for x in frames:
                come += [[int(t), int(e), k] for t, e, k in zip(x["micros"], x["event_id"], x["kind"], strict=True)]
        reader.advance(come, watermark)
        if (then := reader.next_time()) is None:
            state.remove()
        else:
            state.update(reader.kept())
            state.setTimeoutTimestamp(max(then // 1000, watermark // 1000) + 1)
        if reader.rows:
            out = pd.DataFrame(reader.rows, columns=["paper", "reading", "opened_at", "closed_at", "outcome", "notes", "last_note"])
            yield out.assign(opened_at=pd.to_datetime(out["opened_at"], unit="us"), closed_at=pd.to_datetime(out["closed_at"], unit="us"), last_note=out["last_note"].astype("Int64"))

    timed = _events(events).withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    return timed.groupBy("paper").applyInPandasWithState(run, READINGS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def batch(events: DataFrame, rules: Rules = Rules(), late: str = "10 minutes") -> DataFrame:
    """The readings that a stream of all these events has closed when it has seen the last of them."""
    own = _events(events).dropDuplicates(["paper", "ts", "event_id"])
    # A watermark has milliseconds. One row: the time up to which events count.
    until = own.agg(F.date_trunc("millisecond", F.max("ts")).alias("last")).select((F.col("last") - F.expr(f"INTERVAL {late}")).alias("until"))
    opening, patience = F.col("kind") == rules.opening, F.expr(f"INTERVAL {rules.patience} minutes")
    w = Window.partitionBy("paper").orderBy("ts", "event_id")
    n = own.crossJoin(F.broadcast(until)).filter("ts < until").withColumn("n", F.sum(opening.cast("long")).over(w)).filter("n > 0")
    n = n.withColumns({"opened_at": F.first(F.when(opening, F.col("ts")), ignorenulls=True).over(Window.partitionBy("paper", "n").orderBy("ts", "event_id"))})
    at, in_time = F.struct("ts", "event_id", "kind"), F.col("ts") <= F.col("opened_at") + patience
    ends = F.col("kind").isin(*[k for k, _ in rules.closing])
    n = n.withColumn("ended", F.min(F.when(ends & in_time, at)).over(Window.partitionBy("paper", "n")))
    noted = F.col("kind").isin(*rules.notes) & in_time & (F.col("ended").isNull() | (F.struct("ts", "event_id") < F.struct("ended.ts", "ended.event_id")))
    # A reading's rows meet again; the next one's opening is the only row that another reading has to give.
    read = n.groupBy("paper", "n", "until").agg(
        F.min(F.when(opening, F.struct("ts", "event_id"))).alias("o"), F.min("ended").alias("ended"), F.count_if(noted).alias("notes"), F.max(F.when(noted, F.struct("ts", "event_id"))).alias("last")
    )
    following = F.lead("o.ts").over(Window.partitionBy("paper").orderBy("n"))
    read = read.withColumns({"next": following, "deadline": F.col("o.ts") + patience})
    closed = F.when(F.col("ended").isNotNull(), F.col("ended.ts")).when(F.col("next") <= F.col("deadline"), F.col("next")).when(F.col("deadline") < F.col("until"), F.col("deadline"))
    outcome = F.coalesce(*[F.when(F.col("ended.kind") == k, F.lit(v)) for k, v in rules.closing], F.lit("interrupted"))
    return read.select("paper", F.col("o.event_id").alias("reading"), F.col("o.ts").alias("opened_at"), closed.alias("closed_at"), outcome.alias("outcome"), "notes", F.col("last.event_id").alias("last_note")).filter("closed_at is not null")


def latest(readings: DataFrame) -> DataFrame:
    """The state of each paper: its last reading, whose notes stand in the place of all earlier ones."""
    fields = [c for c in readings.columns if c != "paper"]
    last = readings.groupBy("paper").agg(F.max_by(F.struct(*fields), F.struct("opened_at", "reading")).alias("r"), F.count("*").alias("readings"))
    return last.select("paper", *[F.col(f"r.{c}").alias(c) for c in fields], "readings")
