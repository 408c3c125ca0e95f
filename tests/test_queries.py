"""Every query with SQL against DuckDB on the small tables; the others must give rows."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry
from tidegauge.plans import forecasts

DATA = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # the first with 22 days in a row
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {n for plan in entry.PLANS for n in plan.QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT"):
            return None
        return round(float(x), 4) if isinstance(x, float) or "float" in type(x).__name__ else bool(x) if "bool" in type(x).__name__ else int(x) if hasattr(x, "__index__") else str(x)

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def close(a, b):
    return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) <= 2e-4 * max(1, abs(a)))


@pytest.mark.parametrize("name", sorted(OWN & set(entry.oracle_sql())))
def test_against_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(close(x, y) for r, q in zip(a, b, strict=True) for x, y in zip(r, q, strict=True))


@pytest.mark.parametrize("name", ["i02_har_ols", "i03_har_gamma", "i04_anchored_probe", "i08_spike_gate"])
def test_fits_of_every_fold(spark, name):
    """Predictions for the test block of each fold, as many as there are days with lags."""
    days = forecasts._blocks(spark, LARGER).filter("block = 'test'").groupBy("fold").count().collect()
    assert {r["fold"] for r in days} == {f[0] for f in forecasts.T.FOLDS}
    got = entry.queries()[name](spark, LARGER).groupBy("fold").count().collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in days}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
