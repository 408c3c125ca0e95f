"""The keyed store against a dictionary; what an upsert writes; what a failed one leaves."""

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.sources.store import KeyedStore

SCHEMA = "k string, part int, v double, created long"


def store(spark, path, buckets=8):
    return KeyedStore(spark, str(path), SCHEMA, ["k", "part"], "created", buckets)


def held(df):
    return {(r["k"], r["part"]): (r["v"], r["created"]) for r in df.collect()}


def test_upserts_against_a_dictionary(spark, tmp_path):
    s, want, r = store(spark, tmp_path), {}, random.Random(3)
    assert held(s.read()) == {}
    for step in range(4):
        rows = {(r.choice([None, *"abcdefghij"]), r.choice([None, 1, 2])): (r.choice([None, r.random()]), step) for _ in range(12)}
        assert s.upsert(spark.createDataFrame([(*k, *v) for k, v in rows.items()], SCHEMA)) == step + 1
        want |= rows
        assert held(s.read()) == want
        assert s.read().count() == len(want)
    asked = spark.createDataFrame([("a", 1), (None, None), ("none", 5)], "k string, part int")
    assert held(s.read_keys(asked)) == {k: v for k, v in want.items() if k in {("a", 1), (None, None)}}


def test_repeated_keys_and_other_columns(spark, tmp_path):
    s = store(spark, tmp_path)
    rows = spark.createDataFrame([("a", 1, 1.0, 1), ("a", 1, 2.0, 5), ("a", 1, 3.0, 2)], SCHEMA).withColumn("other", F.lit(0))
    s.upsert(rows)
    assert held(s.read()) == {("a", 1): (2.0, 5)}
    assert s.read().columns == ["k", "part", "v", "created"]
    s.upsert(spark.createDataFrame([("a", 1, 9.0, 0)], SCHEMA))  # what comes later replaces, whatever its order
    assert held(s.read()) == {("a", 1): (9.0, 0)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    s = store(spark, tmp_path, 16)
    s.upsert(spark.range(4000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("part"), F.rand(1).alias("v"), F.lit(0).cast("long").alias("created")))
    before = s._versions()[1]
    s.upsert(spark.createDataFrame([("7", 1, 0.5, 1), ("new", 1, 0.5, 1)], SCHEMA))
    after = s._versions()[1]
    changed = {b for b in after if after[b] != before.get(b)}
    assert len(before) == 16 and 1 <= len(changed) <= 2
    size = lambda v: sum(p.stat().st_size for p in (tmp_path / "data" / v).rglob("*.parquet"))
    assert size(after[min(changed)]) < size(before[min(set(before) - changed)]) / 4
    assert s.read().count() == 4001
    assert s.upsert(spark.createDataFrame([], SCHEMA)) == 2  # nothing new: no commit


def test_a_failed_upsert_changes_nothing(spark, tmp_path):
    s = store(spark, tmp_path)
    s.upsert(spark.createDataFrame([("a", 1, 1.0, 1)], SCHEMA))
    bad = spark.createDataFrame([("a", 1, 2.0, 2)], SCHEMA).withColumn("v", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        s.upsert(bad)
    (tmp_path / "commits" / "2").mkdir()  # a commit that was never finished
    assert held(s.read()) == {("a", 1): (1.0, 1)}
    assert s.upsert(spark.createDataFrame([("b", 1, 1.0, 1)], SCHEMA)) == 2
    assert len(s.read().collect()) == 2


def test_earlier_commits_vacuum_and_own_rows(spark, tmp_path):
    s = store(spark, tmp_path)
    s.upsert(spark.createDataFrame([("a", 1, 1.0, 1), ("b", 1, 1.0, 1)], SCHEMA))
    s.upsert(s.read().filter("k = 'a'").withColumn("v", F.col("v") + 1))
    assert held(s.read(1)) == {("a", 1): (1.0, 1), ("b", 1): (1.0, 1)}
    now = held(s.read())
    assert now == {("a", 1): (2.0, 1), ("b", 1): (1.0, 1)}
    assert s.vacuum() >= 1 and held(s.read()) == now
    with pytest.raises(ValueError, match="no commit 1"):
        s.read(1)
    with pytest.raises(ValueError, match="buckets"):
        store(spark, tmp_path, 4).read()
