import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import bars as B
from tidegauge.schemas import BARS

STEP = 300


def day_bars(spark, first=datetime(2017, 12, 31, 23, 55), n=289, leave=()):
    rows = []
    for i in range(n):
        ts = first + timedelta(seconds=STEP * i)
        close = 10_000 * math.exp(i * 1e-4)
        if ts not in leave:
            rows.append(("a", ts, close, close * 1.001, close * 0.999, close, 10.0, 10 * close, 5.0, 5.0, 5 * close))
    return spark.createDataFrame(rows, BARS)


def one(days, day):
    return days.filter(F.col("day") == F.lit(day).cast("date")).first()


def test_full_day_is_valid(spark):
    r = B.gap_aware_returns(day_bars(spark), STEP)
    day = one(B.day_table(r, STEP), "2018-01-01")
    assert day["valid"] and day["n_bars"] == 288
    assert math.isclose(day["rv"], 288 * 1e-8, rel_tol=1e-6)


def test_missing_boundary(spark):
    r = B.gap_aware_returns(day_bars(spark, datetime(2018, 1, 1), 288), STEP)
    days = B.day_table(r, STEP)
    assert one(days, "2018-01-01")["invalid_reason"] == "missing_boundary_return"
    assert B.reason_counts(days).first()["n"] == 1


def test_verified_gap(spark):
    first = datetime(2021, 8, 12, 23, 55)
    gone = {datetime(2021, 8, 13, 2) + timedelta(seconds=STEP * i) for i in range(54)}
    bars = day_bars(spark, first, 289, gone)
    gaps = spark.createDataFrame([("a", datetime(2021, 8, 13, 2), datetime(2021, 8, 13, 6, 25))], "series_id string, start timestamp, end timestamp")
    filled = B.fill_verified_gaps(bars, gaps, STEP)
    assert filled.filter("synthetic").count() == 54
    assert B.gap_audit(filled, gaps).first()["inserted"] == 54
    r = B.gap_aware_returns(filled, STEP)
    days = B.day_table(r, STEP)
    assert one(days, "2021-08-13")["valid"]
    assert r.filter("synthetic and r = 0").count() == 54
    audit = B.zero_volume_audit(filled, days).first()
    assert (audit["organic"], audit["synthetic"]) == (0, 54)


def test_unverified_gap_stays_invalid(spark):
    bars = day_bars(spark, leave={datetime(2018, 1, 1, 12)})
    days = B.day_table(B.gap_aware_returns(bars, STEP), STEP)
    assert one(days, "2018-01-01")["invalid_reason"] == "bar_count"


def test_gap_without_reference_bar_is_an_error(spark):
    bars = day_bars(spark, leave={datetime(2018, 1, 1, 12), datetime(2018, 1, 1, 11, 55)})
    gaps = spark.createDataFrame([("a", datetime(2018, 1, 1, 12), datetime(2018, 1, 1, 12))], "series_id string, start timestamp, end timestamp")
    with pytest.raises(Exception, match="no positive close"):
        B.fill_verified_gaps(bars, gaps, STEP).collect()


def test_duplicates_drop_every_copy(spark):
    bars = day_bars(spark, n=3)
    twice = bars.union(bars.limit(1)).union(bars.limit(1))
    assert B.drop_duplicated(twice).count() == 2
    c = B.duplicate_counts(twice).first()
    assert (c["extra_copies"], c["dropped_rows"]) == (2, 3)


def test_patches(spark):
    rows = [("a", datetime(2018, 1, 1, 0, 5 * i), datetime(2018, 1, 1).date(), r) for i, r in enumerate([0.1, -0.2, 0.3, -0.4])]
    r = spark.createDataFrame(rows, "series_id string, ts timestamp, day date, r double")
    got = [x["log_rv"] for x in B.patch_log_rv(r, 2).orderBy("patch").collect()]
    assert got == pytest.approx([math.log(0.05 + 1e-12), math.log(0.25 + 1e-12)])
