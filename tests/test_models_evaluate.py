import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.losses import half_gamma_deviance, qlike
from tidegauge.operators import evaluate as J
from tidegauge.operators import models as M

D = [date(2024, 1, 1) + timedelta(i) for i in range(40)]


def preds(spark, rows):
    return spark.createDataFrame(rows, "fold string, model string, target_date date, true_rv double, predicted_rv double")


def test_loss_identity(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 0.5)], "t double, p double").select(qlike("t", "p").alias("a"), half_gamma_deviance("t", "p").alias("b"))
    assert all(r["a"] == pytest.approx(r["b"]) for r in df.collect())
    with pytest.raises(Exception, match="positive"):
        spark.createDataFrame([(1.0, 0.0)], "t double, p double").select(qlike("t", "p")).collect()


def test_ensemble_and_incomplete_models(spark):
    """Three seeds on two folds; a model that lacks one seed of one fold is left out."""
    values = {5: (2.0, 5.0, 0.5), 6: (4.0, 5.0, 0.7), 7: (6.0, 11.0, 0.9)}
    rows = [(f, m, s, D[i], 1.5, v) for m in ("whole", "part") for s, vs in values.items() for i, (f, v) in enumerate(zip(("f1", "f1", "f2"), vs, strict=True)) if (m, s, f) != ("part", 7, "f2")]
    df = spark.createDataFrame(rows, "fold string, model string, seed int, target_date date, true_rv double, predicted_rv double")
    got = M.seed_ensemble(df, 2, 3).orderBy("target_date").collect()
    assert {r["model"] for r in got} == {"whole"}
    assert [r["predicted_rv"] for r in got] == pytest.approx([4.0, 7.0, 0.7]) and got[1]["predicted_log_rv"] == pytest.approx(math.log(7))


def test_common_support(spark):
    days = {"p": [("f1", 0), ("f1", 3), ("f2", 9)], "q": [("f1", 3), ("f2", 8), ("f2", 9)], "r": [("f1", 3), ("f1", 9), ("f2", 9)]}
    df = preds(spark, [(f, m, D[i], 2.0, 1.0) for m, x in days.items() for f, i in x])
    assert {(r["fold"], r["target_date"]) for r in J.common_support(df).collect()} == {("f1", D[3]), ("f2", D[9])}


def test_spike_flags(spark):
    """Flags are strict: a value at the threshold is no spike."""
    df = preds(spark, [("f", "m", D[i], t, p) for i, (t, p) in enumerate([(0.7, 0.6), (0.9, 0.4), (0.2, 0.8), (0.6, 0.9)])])
    got = J.annotate(df, spark.createDataFrame([("f", 0.6)], "fold string, threshold double")).orderBy("target_date").collect()
    assert [r["is_spike"] for r in got] == [True, True, False, False] and [r["predicted_spike"] for r in got] == [False, False, True, True]


def test_routing_and_threshold(spark):
    truth, calm, hot, p = [2.0, 1.0, 6.0], [1.5, 1.2, 3.0], [4.0, 2.4, 5.0], [0.3, 0.55, 0.8]
    make = lambda v: spark.createDataFrame([("f", D[i], t, x) for i, (t, x) in enumerate(zip(truth, v, strict=True))], "fold string, target_date date, true_rv double, predicted_rv double")
    gate = spark.createDataFrame([("f", D[i], x) for i, x in enumerate(p)], "fold string, target_date date, p double")
    values = lambda df: [r["predicted_rv"] for r in df.orderBy("target_date").collect()]
    assert values(M.route(make(calm), make(hot), gate, 0.5)) == pytest.approx([1.5, 2.4, 5.0])
    assert values(M.route(make(calm), make(hot), gate, soft=True)) == pytest.approx([a ** (1 - w) * b**w for a, b, w in zip(calm, hot, p, strict=True)])
    assert values(M.route(make(calm), make(hot), gate, 0.5, selected=False)) == pytest.approx(calm)
    s = M.select_threshold(make(calm), make(hot), gate).first()  # 0.4 and 0.5 route alike: the higher is taken
    loss = lambda v: sum(t / x - math.log(t / x) - 1 for t, x in zip(truth, v, strict=True)) / 3
    assert s["selected"] and s["threshold"] == 0.5 and s["loss"] == pytest.approx(loss([1.5, 2.4, 5.0])) and s["normal_loss"] == pytest.approx(loss(calm))


def test_blend_between_two_forecasts(spark):
    """The truth lies a quarter of the way from one forecast to the other, in logs."""
    a = spark.createDataFrame([("f", D[i], x**0.75 * y**0.25, x) for i, (x, y) in enumerate([(1.2, 4.1), (0.3, 0.9), (7.0, 2.0)])], "fold string, target_date date, true_rv double, predicted_rv double")
    b = spark.createDataFrame([("f", D[i], x**0.75 * y**0.25, y) for i, (x, y) in enumerate([(1.2, 4.1), (0.3, 0.9), (7.0, 2.0)])], a.schema)
    chosen = M.select_blend(a, b)
    assert chosen.first()["alpha"] == 0.25 and chosen.first()["loss"] == pytest.approx(0, abs=1e-12)
    assert all(r["predicted_rv"] == pytest.approx(r["true_rv"]) for r in M.blend(a, b, chosen).collect())


def test_gamma_fit_is_the_qlike_optimum(spark):
    """Against Newton steps on the mean loss plus lam / n * beta^2."""
    lam, x = 0.6, np.linspace(-1.0, 1.4, 9)
    rv = np.exp(0.3 - 0.5 * x) * (1 + 0.25 * np.sin(5 * x))
    df = spark.createDataFrame([(float(a), float(b), 0.2) for a, b in zip(x, rv, strict=True)], "x double, rv double, anchor double")
    fit = M.fit_gamma(df, ["x"], offset="anchor", lam=lam)
    beta, n, design, penalty = np.zeros(2), len(x), np.column_stack([np.ones(9), x]), np.array([0, 2 * lam / 9])
    for _ in range(100):
        r = rv / np.exp(0.2 + design @ beta)
        beta -= np.linalg.solve(design.T @ (design * r[:, None]) / n + np.diag(penalty), design.T @ (1 - r) / n + penalty * beta)
    assert fit.model.intercept == pytest.approx(beta[0], abs=1e-6) and fit.model.coefficients[0] == pytest.approx(beta[1], abs=1e-6)


def test_gamma_fit_settles_on_features_that_vary_little(spark):
    """Means of many orders: raw coefficients differ by rounding at every step."""
    r = np.random.default_rng(5)
    x = 250 + np.column_stack([r.normal(0, s, 400) for s in (0.02, 0.009, 0.005)])
    rv = np.exp(2.0 + (x - 250) @ [0.5, -0.2, 0.9]) * r.gamma(40, 1 / 40, 400)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, rv, strict=True)], "a double, b double, c double, rv double")
    got = M.fit_gamma(df, ["a", "b", "c"]).predict(df).toPandas()
    design, beta = np.column_stack([np.ones(400), (x - x.mean(0)) / x.std(0)]), np.array([2.0, 0, 0, 0])
    for _ in range(100):
        q = rv / np.exp(design @ beta)
        beta -= np.linalg.solve(design.T @ (design * q[:, None]), design.T @ (1 - q))
    assert np.abs(got["predicted_log_rv"].to_numpy() - design @ beta).max() < 1e-8


def test_useless_features_fall_back(spark):
    """Where the anchor is exact no correction can gain."""
    rows = [(math.sin(i * i), 2.5, math.log(2.5)) for i in range(83)]
    make = lambda a, b: spark.createDataFrame(rows[a:b], "x double, rv double, anchor_log_rv double")
    probe = M.fit_probe(make(0, 50), make(50, 68), ["x"], lambdas=(0.0, 0.4))
    assert probe.fit is None
    assert {r["correction"] for r in probe.predict(make(68, 83)).collect()} == {0.0}


def test_selection_is_an_ordered_scan(spark):
    df = spark.createDataFrame([("k", 0.0, 1.0), ("k", 1.0, 0.5), ("k", 2.0, 0.500005), ("k", 3.0, 0.6)], "k string, lam double, loss double")
    assert M.pick_in_order(df, ["k"], "lam").first()["lam"] == 2.0


def test_before_after(spark):
    a = spark.createDataFrame([("m", 1.6), ("n", 0.5)], "model string, loss double")
    b = spark.createDataFrame([("m", 2.0), ("n", 0.2)], "model string, loss double")
    r = {x["model"]: x for x in J.before_after(a, b, ["model"], ["loss"]).collect()}
    assert [(r[k]["loss_delta"], r[k]["loss_percent"]) for k in "mn"] == [pytest.approx((0.4, 25)), pytest.approx((-0.3, -60))]
    with pytest.raises(Exception, match="keys before and after"):
        J.before_after(a, b.withColumn("model", F.lit("x")), ["model"], ["loss"]).collect()


def test_screen(spark):
    rows = [(f"f{i}", m, q) for m, qs in (("anchor", [1.0] * 4), ("good", [0.9, 0.9, 0.9, 1.1]), ("bad", [0.9, 0.9, 0.9, 0.9])) for i, q in enumerate(qs)]
    per = spark.createDataFrame(rows, "fold string, model string, mean_qlike double")
    pool = spark.createDataFrame([("anchor", 1.0), ("good", 0.95), ("bad", 1.2)], "model string, mean_qlike double")
    got = {r["model"]: r["passed"] for r in J.screen(per, pool, "anchor", wins=3).collect()}
    assert got == {"good": True, "bad": False}


def test_variance_filter(spark):
    x = spark.createDataFrame([("s", D[i], r) for i, r in enumerate([1.0, -2.0, 0.5])], "series_id string, day date, return_percent double")
    spec = spark.createDataFrame([("g", "garch", 0.0, 0.1, [0.2], 0.0, 0.7, 1.0)], "spec string, kind string, mu double, omega double, alpha array<double>, gamma double, beta double, start double")
    got = [r["variance"] for r in M.variance_filter(x, spec, ["series_id"]).orderBy("day").collect()]
    assert got == pytest.approx([1e-4, (0.1 + 0.2 + 0.7) / 1e4, (0.1 + 0.2 * 4 + 0.7) / 1e4])


def test_bootstrap_of_a_constant(spark):
    df = spark.createDataFrame([("m", d, 2.0) for d in D], "model string, target_date date, loss double")
    r = J.bootstrap_interval(J.block_bootstrap(df, ["model"], 7, 20), ["model"]).first()
    assert (r["low"], r["high"]) == pytest.approx((2.0, 2.0))
