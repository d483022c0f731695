"""Range joins by equality: intervals are written under the buckets they touch, points meet them there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points_in_intervals(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, width: int, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of points with the intervals (both ends inside) that hold them, and equal on columns. width: about an interval's
    usual length, so that one touches few buckets; any width is correct."""
    left = points.withColumn("__b", F.floor(F.col(at) / width))
    right = intervals.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return left.join(right, ["__b", *on]).filter(F.col(at).between(F.col(start), F.col(end))).drop("__b")
