"""Incremental upkeep: equal to making all rows again, and no more work than the changes ask for."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators.upkeep import Report, Source, Upkeep

SCHEMA = "key long, text string, extra string"


def derived(rows):
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.max("text").alias("last"))


def made(spark, tmp_path, rows, derive=derived, version=1, buckets=8):
    df = spark.createDataFrame(rows, SCHEMA)
    source = Source(spark, f"file://{tmp_path}/source", "key", df.schema, buckets)
    if rows:
        source.replace(df)
    return source, Upkeep(source, f"file://{tmp_path}/kept", derive, derived(df).schema, version)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_changes_are_followed(spark, tmp_path):
    rnd = random.Random(3)
    now = {k: [(k, f"t{k}", None)] * (1 + (k or 0) % 3) for k in [None, *range(40)]}
    seen = []

    def watched(rows):
        rows = rows.checkpoint()
        seen.extend(r["key"] for r in rows.select("key").distinct().collect())
        return derived(rows)

    source, upkeep = made(spark, tmp_path, [r for rs in now.values() for r in rs], watched)
    assert upkeep.sync().made == 41 and rows_of(upkeep.rows()) == rows_of(derived(source.rows()))
    for step in range(3):
        seen.clear()
        gone = rnd.sample([k for k in now if k is not None], 3)
        new = [rnd.randrange(60) for _ in range(2)] + ([None] if step == 1 else [])
        for k in gone:
            del now[k]
        for k in dict.fromkeys(new):
            now[k] = [(k, f"step{step}", None), (k, None, "x")]
        source.apply(spark.createDataFrame([r for k in dict.fromkeys(new) for r in now[k]], SCHEMA), spark.createDataFrame([(k, None, None) for k in gone], SCHEMA))
        report = upkeep.sync()
        assert rows_of(source.rows()) == rows_of(spark.createDataFrame([r for rs in now.values() for r in rs], SCHEMA))
        assert rows_of(upkeep.rows()) == rows_of(derived(source.rows()))
        assert set(seen) == set(new) and report.made == len(set(new)) and report.gone == len(set(gone) - set(new))
    upkeep.tidy()
    assert rows_of(upkeep.rows()) == rows_of(derived(source.rows()))


def test_without_changes_no_row_is_read(spark, tmp_path, monkeypatch):
    source, upkeep = made(spark, tmp_path, [(k, "t", None) for k in range(30)])
    first = upkeep.sync()
    monkeypatch.setattr(source, "rows", lambda *a: pytest.fail("rows were read"))
    assert upkeep.sync() == Report(first.version)


def test_only_buckets_that_changed_are_read(spark, tmp_path, monkeypatch):
    source, upkeep = made(spark, tmp_path, [(k, "t", None) for k in range(60)])
    upkeep.sync()
    source.apply(spark.createDataFrame([(7, "new", None)], SCHEMA), spark.createDataFrame([], SCHEMA))
    read, rows = [], source.rows
    monkeypatch.setattr(source, "rows", lambda only=None: (read.extend(only), rows(only))[1])
    report = upkeep.sync()
    assert len(read) == 1 == report.buckets and (report.made, report.gone) == (1, 0)


def test_a_rewritten_bucket_with_equal_rows_changes_nothing(spark, tmp_path):
    source, upkeep = made(spark, tmp_path, [(k, "t", None) for k in range(20)])
    upkeep.sync()
    source.replace(source.rows().checkpoint())
    report = upkeep.sync()
    assert report.buckets > 0 and (report.made, report.gone) == (0, 0)
    assert rows_of(upkeep.rows()) == rows_of(derived(source.rows()))


def test_a_sync_that_fails_leaves_the_last_version(spark, tmp_path):
    source, upkeep = made(spark, tmp_path, [(k, "t", None) for k in range(20)])
    upkeep.sync()
    before = rows_of(upkeep.rows())
    source.apply(spark.createDataFrame([(3, "new", None)], SCHEMA), spark.createDataFrame([], SCHEMA))

    def broken(rows):
        return derived(rows).withColumn("last", F.raise_error(F.lit("broken off")).cast("string"))

    with pytest.raises(Exception, match="broken off"):
        Upkeep(source, upkeep.path, broken, upkeep.schema).sync()
    assert rows_of(upkeep.rows()) == before
    assert upkeep.sync().made == 1 and rows_of(upkeep.rows()) == rows_of(derived(source.rows()))


def test_another_derivation_makes_all_again(spark, tmp_path):
    source, upkeep = made(spark, tmp_path, [(k, "t", None) for k in range(20)])
    upkeep.sync()
    shouted = Upkeep(source, upkeep.path, lambda rows: derived(rows).withColumn("last", F.upper("last")), upkeep.schema, version=2)
    assert shouted.sync().made == 20 and {r["last"] for r in shouted.rows().collect()} == {"T"}


def test_two_syncs_at_once_are_noticed(spark, tmp_path, monkeypatch):
    source, upkeep = made(spark, tmp_path, [(k, "t", None) for k in range(5)])
    monkeypatch.setattr(upkeep.folder, "put", lambda *a: False)
    with pytest.raises(RuntimeError, match="another sync"):
        upkeep.sync()


def test_empty_source_and_last_row_gone(spark, tmp_path):
    source, upkeep = made(spark, tmp_path, [])
    assert upkeep.sync() == Report(0) and upkeep.rows().isEmpty()
    none = spark.createDataFrame([], SCHEMA)
    source.apply(spark.createDataFrame([(1, "t", None)], SCHEMA), none)
    assert upkeep.sync().made == 1
    source.apply(none, spark.createDataFrame([(1, None, None)], SCHEMA))
    assert upkeep.sync().gone == 1 and upkeep.rows().isEmpty()


def test_derived_rows_are_not_dealt_out_again(spark, tmp_path):
    """Words of a text: shuffled are the texts and what is kept, not the many rows that are made of them."""
    words = lambda rows: rows.select("key", F.explode(F.split("text", " ")).alias("w")).groupBy("key", "w").agg(F.count("*").alias("n"))
    df = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(300)), None) for k in range(60)] + [(None, "a b", None)], SCHEMA)
    source = Source(spark, f"file://{tmp_path}/source", "key", df.schema, 8)
    source.replace(df)
    plans = []

    def derive(rows):
        made_ = words(rows)
        plans.append(made_._jdf.queryExecution().executedPlan().toString())
        return made_

    upkeep = Upkeep(source, f"file://{tmp_path}/kept", derive, words(df).schema)
    assert upkeep.sync().made == 61
    source.apply(spark.createDataFrame([(3, "a a b", None), (None, "c", None)], SCHEMA), df.filter("key = 5").limit(1))
    assert upkeep.sync() == Report(2, len({b for b in upkeep_buckets(spark, [3, None, 5])}), 2, 1)
    assert rows_of(upkeep.rows()) == rows_of(words(source.rows()))
    plan = plans[0]
    assert "hashpartitioning(key" in plan and "hashpartitioning(key" in plan.split("Generate")[-1] and "Exchange" not in plan.split("Generate")[0]
    files = [f for f in upkeep.rows().inputFiles()]
    assert len(files) <= 2 * 8


def upkeep_buckets(spark, keys):
    from vellum.operators.upkeep import bucket

    return [r[0] for r in spark.createDataFrame([(k,) for k in keys], "key long").select(bucket("key", 8)).collect()]
