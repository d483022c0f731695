"""Queries of the stateful stream over the event log, each with SQL over the whole log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.library import load
from ..streaming import readings as R
from .registry import query
from .session import checkpoints

_READINGS = """
e AS (SELECT DISTINCT user_id AS paper, ts, event_id, event_type AS kind FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
u AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS until FROM e),
n AS (SELECT e.*, until, count(*) FILTER (kind = 'click') OVER (PARTITION BY paper ORDER BY ts, event_id) AS n FROM e, u WHERE ts < until),
o AS (SELECT *, ts AS opened_at, event_id AS reading, lead(ts) OVER (PARTITION BY paper ORDER BY n) AS next FROM n WHERE kind = 'click'),
c AS (SELECT n.paper, n.n, arg_min(n.ts, (n.ts, n.event_id)) AS t, arg_min(n.event_id, (n.ts, n.event_id)) AS i, arg_min(n.kind, (n.ts, n.event_id)) AS k FROM n JOIN o ON o.paper = n.paper AND o.n = n.n
  WHERE n.kind IN ('purchase', 'error') AND n.ts <= o.opened_at + INTERVAL 240 MINUTE GROUP BY 1, 2),
w AS (SELECT n.paper, n.n, count(*) AS notes, arg_max(n.event_id, (n.ts, n.event_id)) AS last_note FROM n JOIN o ON o.paper = n.paper AND o.n = n.n LEFT JOIN c ON c.paper = n.paper AND c.n = n.n
  WHERE n.kind IN ('view', 'signup') AND n.ts <= o.opened_at + INTERVAL 240 MINUTE AND (c.t IS NULL OR (n.ts, n.event_id) < (c.t, c.i)) GROUP BY 1, 2),
readings AS (SELECT * FROM (SELECT o.paper, reading, opened_at, CASE WHEN c.t IS NOT NULL THEN c.t WHEN next <= opened_at + INTERVAL 240 MINUTE THEN next WHEN opened_at + INTERVAL 240 MINUTE < until THEN opened_at + INTERVAL 240 MINUTE END AS closed_at,
  CASE c.k WHEN 'purchase' THEN 'parsed' WHEN 'error' THEN 'failed' ELSE 'interrupted' END AS outcome, coalesce(notes, 0) AS notes, last_note
  FROM o LEFT JOIN c ON c.paper = o.paper AND c.n = o.n LEFT JOIN w ON w.paper = o.paper AND w.n = o.n) WHERE closed_at IS NOT NULL)"""
#: Times as text: the two engines show them in different types.
_COLUMNS = "paper, reading, strftime(opened_at, '%Y-%m-%d %H:%M:%S.%f') AS opened_at, strftime(closed_at, '%Y-%m-%d %H:%M:%S.%f') AS closed_at, outcome, notes, coalesce(last_note, -1) AS last_note"


def _shown(x: DataFrame) -> DataFrame:
    return x.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("opened_at", "closed_at")} | {"last_note": F.coalesce("last_note", F.lit(-1))})


@query("reading_outcomes", f"WITH {_READINGS} SELECT {_COLUMNS} FROM readings")  # E08 E25
def reading_outcomes(spark, d):
    return _shown(R.batch(load(spark, d, "events")))


@query("reading_notes", f"WITH {_READINGS} SELECT {_COLUMNS}, readings FROM (SELECT *, count(*) OVER (PARTITION BY paper) AS readings, row_number() OVER (PARTITION BY paper ORDER BY opened_at DESC, reading DESC) AS r FROM readings) WHERE r = 1")  # E07
def reading_notes(spark, d):
    return _shown(R.latest(R.batch(load(spark, d, "events"))))


@query("reading_stream", f"WITH {_READINGS} SELECT {_COLUMNS} FROM readings")  # E08 E25
def reading_stream(spark, d):
    """The whole log through the stream: what it has closed once it has seen all of it."""
    out = f"{checkpoints(spark).rstrip('/')}/readings-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    log = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    R.stream(log).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return _shown(spark.read.schema(R.READINGS).parquet(f"{out}/rows"))
