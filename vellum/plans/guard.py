"""Read-only SQL: one statement, a SELECT or WITH, with a limit around it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class Refused(ValueError):
    pass


def run_select(spark: SparkSession, sql: str, limit: int = 200, **args) -> DataFrame:
    """Run a guarded statement. Text in quotes and comments don't count where its words are checked."""
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";")
    if ";" in bare:
        raise Refused("one statement only")
    if not re.match(r"(?is)(select|with)\b", bare):
        raise Refused("only SELECT or WITH")
    if re.search(r"(?i)\b(insert|update|delete|drop|alter|create|merge|truncate|load|set|add|cache|uncache|refresh|msck|grant|revoke)\b\s+(?!by\b)", bare):
        raise Refused("reading only")
    return spark.sql(f"SELECT * FROM ({sql.strip().rstrip(';')}) LIMIT {int(limit)}", args=args or None)
