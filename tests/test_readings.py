"""Readings as a stream: any order of arrival, restarts, late rows, timers; equal to the batch."""

import datetime as dt
import random

import pytest

from vellum.streaming import readings as R

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def run(spark, folder, out, rules=R.Rules()):
    """All that is in the folder, a file at a time, then stop; another call goes on from the checkpoint."""
    log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    R.stream(log, rules).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(R.READINGS).parquet(f"{out}/rows")


def put(spark, events, folder):
    spark.createDataFrame([(*e, None, None) for e in events], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_any_order_of_arrival_and_a_restart(spark, tmp_path):
    rnd = random.Random(2)
    kinds = ["click", "view", "signup", "purchase", "error", "other"]
    # One paper has a third of all events; events come up to nine minutes late, some twice.
    events = [(i, at(i * 1.7 + rnd.random()), 1 if i % 3 == 0 else rnd.randrange(2, 9), rnd.choice(kinds)) for i in range(900)]
    arrival = sorted(events + events[100:120], key=lambda e: e[1] + dt.timedelta(minutes=rnd.random() * 9))
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    for i in range(0, 460, 230):
        put(spark, arrival[i : i + 230], folder)
    early = rows(run(spark, folder, out))
    put(spark, arrival[460:], folder)
    got = rows(run(spark, folder, out))
    want = rows(R.batch(spark.createDataFrame([(*e, None, None) for e in events], SCHEMA)))
    assert got == want and set(early) < set(got)
    assert {r[4] for r in got} == {"parsed", "failed", "interrupted"}


def by_hand(spark, events, rules=R.Rules(patience=60)):
    df = spark.createDataFrame([(i, at(m), p, k, None, None) for i, (m, p, k) in enumerate(events)], SCHEMA)
    return [(r["paper"], r["reading"], (r["closed_at"] - START).total_seconds() / 60, r["outcome"], r["notes"], r["last_note"]) for r in R.batch(df, rules).orderBy("paper", "opened_at").collect()]


def test_batch_by_hand(spark):
    events = [
        (0, 1, "view"), (1, 1, "click"), (2, 1, "view"), (3, 1, "signup"), (4, 1, "purchase"), (5, 1, "view"), (6, 1, "error"),  # notes and ends outside a reading count for nothing
        (0, 2, "click"), (10, 2, "view"), (20, 2, "click"), (30, 2, "view"), (31, 2, "error"),  # opened again
        (0, 3, "click"), (59, 3, "view"), (61, 3, "view"), (62, 3, "purchase"),  # patience ended
        (0, 4, "click"), (60, 4, "purchase"),  # just in time
        (0, 5, "click"), (100, 5, "click"), (400, 5, "other"),
        (395, 6, "click"), (396, 6, "purchase"), (380, 7, "click"),  # not yet passed by the watermark; still open
    ]
    assert by_hand(spark, events) == [
        (1, 1, 4, "parsed", 2, 3), (2, 7, 20, "interrupted", 1, 8), (2, 9, 31, "failed", 1, 10), (3, 12, 60, "interrupted", 1, 13), (4, 16, 60, "parsed", 0, None),
        (5, 18, 60, "interrupted", 0, None), (5, 19, 160, "interrupted", 0, None),
    ]


def test_late_rows_are_left_out(spark, tmp_path):
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    put(spark, [(1, at(0), 1, "click"), (2, at(100), 2, "other")], folder)
    assert rows(run(spark, folder, out)) == []
    put(spark, [(3, at(5), 1, "purchase"), (4, at(120), 1, "error"), (5, at(140), 2, "other")], folder)
    got = rows(run(spark, folder, out))
    assert [(r[0], r[1], r[4]) for r in got] == [(1, 1, "failed")]


def test_timers_fire_without_events_of_the_paper(spark, tmp_path):
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    put(spark, [(1, at(0), 1, "click"), (2, at(1), 1, "view")], folder)
    run(spark, folder, out)
    put(spark, [(3, at(500), 2, "other")], folder)
    assert rows(run(spark, folder, out)) == [(1, 1, at(0), at(240), "interrupted", 1, 2)]


def test_notes_of_the_last_reading(spark):
    events = spark.createDataFrame([(i, at(m), 1, k, None, None) for i, (m, k) in enumerate([(0, "click"), (1, "view"), (2, "error"), (3, "click"), (4, "signup"), (5, "purchase"), (99, "other")])], SCHEMA)
    assert [(r["reading"], r["outcome"], r["notes"], r["last_note"], r["readings"]) for r in R.latest(R.batch(events)).collect()] == [(3, "parsed", 1, 4, 2)]


@pytest.mark.parametrize("bad", [(None, 1, "click"), (0, None, "click"), (0, 1, None)])
def test_nulls_and_empty(spark, bad):
    minutes, paper, kind = bad
    df = spark.createDataFrame([(1, None if minutes is None else at(minutes), paper, kind, None, None), (2, at(900), 9, "other", None, None)], SCHEMA)
    assert R.batch(df).isEmpty() and R.batch(df.limit(0)).isEmpty()
