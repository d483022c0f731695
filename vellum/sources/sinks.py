"""Sinks: replace the partitions of the papers written, publish by manifest, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_papers(rows: DataFrame, path: str, key: str = "paper") -> None:
    """Overwrite the partitions of the keys in rows; others stay. Idempotent."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def export_labels(rows: DataFrame, path: str) -> None:
    """Labels as JSON lines in a fixed order."""
    rows.orderBy("paper", "finding", "method").write.mode("overwrite").json(path)


def plot_csv(values: DataFrame, path: str) -> None:
    """Chart values as CSV with their fixed columns."""
    values.select("series", "category", "x", "y", "err_lo", "err_hi").write.mode("overwrite").option("header", True).csv(path)


def rekey(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Node ids (a paper's key, #, a place) moved from one paper's key to another's; those of longer keys stay."""
    c = F.col(column)
    return rows.withColumn(column, F.when((c == old) | c.startswith(old + "#"), F.concat(F.lit(new), F.substring(c, F.lit(len(old) + 1), F.length(c)))).otherwise(c))
