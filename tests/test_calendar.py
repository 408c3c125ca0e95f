from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import calendar as C
from tidegauge.operators import features as H

START = date(2018, 1, 1)


def days(spark, n, bad=(), value=lambda i: -9.0):
    rows = [("a", START + timedelta(i), i not in bad, None if i in bad else 1e-4, None if i in bad else float(value(i))) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, day date, valid boolean, rv double, log_rv double")


def kept(df):
    return [(r["day"] - START).days for r in df.filter("eligible").orderBy("day").collect()]


def test_lag_sampler(spark):
    got = kept(C.sample_lag_days(days(spark, 90, {10})))
    assert 33 in got and 32 not in got
    assert len(kept(C.sample_lag_days(days(spark, 40)))) == 18


def test_patch_sampler(spark):
    out = C.sample_days(days(spark, 40))
    assert len(kept(out)) == 10 and kept(out)[0] == 30
    assert out.filter("removal_reason = 'calendar_history'").count() == 30


def test_future_does_not_change_features(spark):
    a = C.market_state(days(spark, 30, value=lambda i: -10 + i / 6))
    b = C.market_state(days(spark, 30, value=lambda i: 999 if i >= 25 else -10 + i / 6))
    cut = F.col("day") <= F.lit(START + timedelta(25))
    cols = ["day", "lag_1", "mean_5", "mean_22", "last_minus_5", "five_minus_22", "change_1", "std_5"]
    assert a.filter(cut).select(cols).orderBy("day").collect() == b.filter(cut).select(cols).orderBy("day").collect()


def test_weights(spark):
    d = days(spark, 1000)
    assert C.training_weights(d, "rolling", ["series_id"]).count() == 730
    w = [r["weight"] for r in C.training_weights(d, "decay", ["series_id"]).orderBy("day").collect()]
    assert sum(w) / len(w) == pytest.approx(1) and w[-1] / w[-366] == pytest.approx(2)


def test_refit_folds(spark):
    folds = C.fold_table(spark, [("f", "2018-01-01", "2018-06-30", "2018-07-01", "2018-09-30", "2018-10-01", "2018-12-31")])
    core = C.refit_folds(folds).filter("block = 'core'").first()
    assert (str(core["start"]), str(core["end"])) == ("2018-01-01", "2018-09-30")
    bad = C.fold_table(spark, [("f", "2018-01-01", "2018-07-30", "2018-07-01", "2018-09-30", "2018-10-01", "2018-12-31")])
    with pytest.raises(Exception, match="blocks overlap"):
        C.refit_folds(bad).collect()


def test_slow_state_is_the_recursion(spark):
    alpha, values = 0.1, [None, 1.0, 3.0, None, -2.0] + [float(i % 7) for i in range(40)]
    rows = [("a", START + timedelta(i), None if v is None else [v, 2 * v]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, day date, v array<double>")
    got = H.slow_state(df, ["series_id"], "v", alpha, rebase=7).orderBy("day").collect()
    slow, seen = 0.0, False
    for v, r in zip(values, got, strict=True):
        fast = 0.0
        if v is not None:
            slow = (1 - alpha) * slow + alpha * v if seen else v
            seen, fast = True, v - slow
        assert r["slow"] == pytest.approx([slow, 2 * slow]) and r["fast"] == pytest.approx([fast, 2 * fast])


def test_every_fold_is_assigned(spark):
    """One day in 10,001 folds is there 10,001 times."""
    folds = spark.range(10_001).select(F.col("id").cast("string").alias("fold"), F.lit("core").alias("block"), F.lit(START).alias("start"), F.lit(START + timedelta(1)).alias("end"))
    got = C.assign_blocks(days(spark, 1), folds)
    assert got.columns == ["series_id", "day", "valid", "rv", "log_rv", "fold", "block"]
    assert got.select("fold").distinct().count() == got.count() == 10_001


def test_every_family_is_scored(spark):
    """1,001 prototypes give 1,001 scores of a day."""
    protos = spark.range(1_001).select(F.col("id").cast("string").alias("family"), F.array(F.lit(1.0), F.lit(0.0)).alias("prototype"))
    got = H.prototype_scores(days(spark, 1).withColumn("semantic", F.array(F.lit(3.0), F.lit(4.0))), protos, ["series_id"])
    assert got.count() == 1_001 and got.filter("abs(score - 0.6) < 1e-9").count() == 1_001
