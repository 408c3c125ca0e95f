"""Tables of sequence models and gates against numpy, and what they refuse."""

import datetime as dt

import numpy as np
import pytest

from tidegauge.operators import tokens as K

LAYOUT = K.Layout({"v": 2}, ("s", "no_news"), ("o",))
SCHEMA = "fold string, day date, core boolean, v_slow array<double>, v_fast array<double>, s double, no_news int, o double"
FIRST = dt.date(2024, 1, 1)


def days(n=60, core=45, seed=9, **change):
    """n days of one fold; every eleventh has no news; change maps a day's number to other values of s."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        slow, fast, s = rng.normal(size=2).tolist(), rng.normal(size=2).tolist(), float(rng.normal())
        out.append(("f", FIRST + dt.timedelta(i), i < core, slow, fast, change.get(f"d{i}", s), int(i % 11 == 10), 7.0))
    return out


def numbers(df, column):
    return np.array([r[column] for r in df.orderBy("day").collect()])


def test_token_matrix(spark):
    rows = days()
    raw = np.array([[*r[4], r[5], r[6], r[7]] for r in rows])
    core = raw[:45]
    spread = np.where(core.std(axis=0) > 1e-12, core.std(axis=0), 1.0)
    table, names = K.token_matrix(spark.createDataFrame(rows, SCHEMA), ["fold"], "fast", LAYOUT)
    assert names == ["v_fast_01", "v_fast_02", "s", "no_news", "o"]
    assert np.allclose(numbers(table, "token"), (raw - core.mean(axis=0)) / spread, atol=1e-12)
    bare, names = K.token_matrix(spark.createDataFrame(rows, SCHEMA), ["fold"], "no_slow", LAYOUT)
    assert names == ["s", "no_news", "o"] and np.allclose(numbers(bare, "token"), ((raw - core.mean(axis=0)) / spread)[:, 2:], atol=1e-12)
    # what lies after the core block changes no core row
    later, _ = K.token_matrix(spark.createDataFrame(days(d50=1e6), SCHEMA), ["fold"], "fast", LAYOUT)
    assert np.array_equal(numbers(later, "token")[:45], numbers(table, "token")[:45])
    with pytest.raises(ValueError, match="state"):
        K.token_matrix(table, ["fold"], "quick", LAYOUT)


@pytest.mark.parametrize("value", [None, float("nan"), float("inf")])
def test_a_row_that_lacks_a_number_is_an_error(spark, value):
    table, _ = K.token_matrix(spark.createDataFrame(days(d3=value), SCHEMA), ["fold"], "slow", LAYOUT)
    with pytest.raises(Exception, match="finite elements"):
        table.collect()


def test_update_matrix(spark):
    rows = days()
    slow, rest = np.array([r[3] for r in rows]), np.array([[r[5], r[6], r[7]] for r in rows])
    news = np.array([r[6] == 0 for r in rows])
    raw = np.hstack([np.vstack([np.zeros((1, 2)), np.diff(slow, axis=0)]), rest])
    fit = raw[:45][news[:45]]
    spread = np.where(fit.std(axis=0) > 1e-12, fit.std(axis=0), 1.0)
    want = np.where(news[:, None], (raw - fit.mean(axis=0)) / spread, 0.0)
    table, names, levels = K.update_matrix(spark.createDataFrame(rows, SCHEMA), ["fold"], LAYOUT)
    assert names == ["v_change_01", "v_change_02", "s", "no_news", "o"] and levels == ["v_slow_01", "v_slow_02", "s", "no_news"]
    assert np.allclose(numbers(table, "update"), want, atol=1e-12)
    level = np.hstack([slow, rest[:, :2]])
    assert np.allclose(numbers(table, "level"), (level - level[:45].mean(axis=0)) / level[:45].std(axis=0), atol=1e-12)
    assert [r["available"] for r in table.orderBy("day").collect()] == news.tolist()


@pytest.mark.parametrize("core", [0, 20, 31])
def test_few_updates_are_an_error(spark, core):
    table, _, _ = K.update_matrix(spark.createDataFrame(days(core=core), SCHEMA), ["fold"], LAYOUT)
    with pytest.raises(Exception, match="fewer than 30|no scaler"):
        table.collect()


def test_sequences(spark):
    tokens = spark.createDataFrame([("f", FIRST + dt.timedelta(i), [float(i)]) for i in range(10)], "fold string, day date, token array<double>")
    targets = [("f", FIRST + dt.timedelta(i), i) for i in (3, 7, 10)]
    got = K.sequences(spark.createDataFrame(targets, "fold string, day date, n int"), tokens, ["fold"], 3).collect()
    assert {r["n"]: [x[0] for x in r["sequence"]] for r in got} == {n: [n - 3.0, n - 2.0, n - 1.0] for n in (3, 7, 10)}
    early = spark.createDataFrame([("f", FIRST + dt.timedelta(2), 2)], "fold string, day date, n int")
    with pytest.raises(Exception, match="no token"):
        K.sequences(early, tokens, ["fold"], 3).collect()


def test_gate_matrix(spark):
    schema = "fold string, day date, " + ", ".join(f"{c} double" for c in K.MARKET)
    news_schema = "fold string, day date, norm double, " + ", ".join(f"{c} double" for c in K.SCALARS)
    target = [("f", FIRST + dt.timedelta(1), *(float(i) for i in range(7)))]
    news = [("f", FIRST + dt.timedelta(i), 50.0 + i, *(10.0 * i + j for j in range(11))) for i in range(3)]
    rows, names = K.gate_matrix(spark.createDataFrame(target, schema), spark.createDataFrame(news, news_schema), ["fold"], ("norm",))
    (r,) = rows.collect()
    assert r["news_day"] == FIRST and list(r["gate"]) == [*map(float, range(7)), *map(float, range(11)), 50.0]
    assert names[:7] == list(K.MARKET) and names[-2:] == ["news_no_news", "news_norm"] and len(names) == 19
    alone = [("f", FIRST, *(float(i) for i in range(7)))]
    with pytest.raises(Exception, match="finite elements"):
        K.gate_matrix(spark.createDataFrame(alone, schema), spark.createDataFrame(news, news_schema), ["fold"], ("norm",))[0].collect()
