"""Day validity over faulty bars, and table fingerprints."""

import datetime as dt
import math

import pytest

from tidegauge.operators import bars as B
from tidegauge.sources import files

BAR = "series_id string, ts timestamp, open double, high double, low double, close double, volume double, quote_volume double, trades double, taker_base double, taker_quote double"
START = dt.datetime(2021, 3, 1, 23, tzinfo=dt.UTC)


def day(changes):
    rows = []
    for i in range(25):
        c = 50 * math.exp(0.01 * (i % 5))
        row = dict(series_id="x", ts=START + dt.timedelta(hours=i), open=c, high=c * 1.02, low=c * 0.98, close=c, volume=3.0, quote_volume=3 * c, trades=2.0, taker_base=1.0, taker_quote=c)
        rows.append(row | changes.get(i, {}))
    return rows


@pytest.mark.parametrize(
    "changes,reason",
    [
        ({}, None),
        ({5: {"close": math.nan}}, "nonfinite_or_nonpositive"),
        ({5: {"close": math.inf}}, "nonfinite_or_nonpositive"),
        ({5: {"close": -1.0}}, "nonfinite_or_nonpositive"),
        ({5: {"close": None}}, "nonfinite_or_nonpositive"),
        ({1: {"close": math.nan}}, "missing_boundary_return"),
        ({0: {"close": 0.0}}, "missing_boundary_return"),
        ({7: {"high": math.inf}}, "nonfinite_or_nonpositive"),
        ({7: {"low": 0.0}}, "nonfinite_or_nonpositive"),
        ({7: {"volume": math.nan}}, "nonfinite_or_nonpositive"),
        ({7: {"trades": -1.0}}, "nonfinite_or_nonpositive"),
        ({7: {"taker_base": math.inf}}, "nonfinite_or_nonpositive"),
        ({7: {"volume": 0.0, "taker_base": math.nan}}, None),
        ({i: {"close": 50.0} for i in range(25)}, "nonfinite_or_nonpositive"),
    ],
)
def test_reasons(spark, changes, reason):
    bars = spark.createDataFrame([tuple(r.values()) for r in day(changes)], BAR)
    got = [r for r in B.day_table(B.gap_aware_returns(bars, 3600), 3600).collect() if r["n_bars"] == 24]
    assert len(got) == 1 and got[0]["invalid_reason"] == reason and got[0]["valid"] == (reason is None)
    assert (got[0]["rv"] is None) == (reason is not None)


def test_fingerprint_sees_changes(spark):
    of = lambda rows, schema="a int, b int": tuple(files.fingerprint(spark.createDataFrame(rows, schema)).first())
    assert of([(1, 1), (1, 1)]) != of([(2, 2), (2, 2)])
    assert of([(1, None)]) != of([(None, 1)])
    assert of([(None, None)]) != of([]) and of([])[0] == 0
    assert of([(1, 2), (3, 4), (3, 4)]) == of([(3, 4), (1, 2), (3, 4)]) != of([(3, 4), (1, 2), (1, 2)])
    assert of([(1, 2)]) == of([(2, 1)], "b int, a int") != of([(1, 2)], "a int, c int")
    assert of([("a", "bc")], "a string, b string") != of([("ab", "c")], "a string, b string")
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    rows, digest = files.fingerprint(df).first()
    assert files.verify_fingerprint(df, rows, digest) is df
    with pytest.raises(ValueError):
        files.verify_fingerprint(df.union(df), rows, digest)
