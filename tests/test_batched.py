"""Fits in common passes against MLlib, numpy and each other; checked parameters; the studies on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import batched as L
from tidegauge.operators import models as M
from tidegauge.plans import profiles as P


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(17)
    out = []
    for fold, shift in (("a", 0.0), ("b", 1.5)):
        for block, n in (("core", 160), ("validation", 60), ("test", 40)):
            for i in range(n):
                x = r.normal(size=3)
                rv = float(np.exp(0.5 + 0.4 * x[0] - 0.2 * x[1] + shift) * r.gamma(5, 0.2))
                out.append((fold, block, i, float(x[0] * 3 + 7), float(x[1] / 50), float(x[2]), float(x[0] * 3 + 7 + x[1] / 50), 4.0, rv, float(1 + i % 3), bool(rv > 2.5 * np.exp(shift))))
    return spark.createDataFrame(out, "fold string, block string, i int, x double, y double, z double, both double, flat double, rv double, w double, hot boolean").cache()


def numpy_fit(x, t, w, alpha, measure):
    """Newton on standardised columns, one model by itself."""
    m, s = np.average(x, axis=0, weights=w), np.sqrt(np.average((x - np.average(x, axis=0, weights=w)) ** 2, axis=0, weights=w))
    z = np.column_stack([np.ones(len(t)), (x - m) / s])
    b, free = np.zeros(z.shape[1]), np.append(0.0, np.full(x.shape[1], alpha))
    for _ in range(200):
        _, d, h = measure(z @ b, t)
        b = b - 0.5 * np.linalg.solve((z * (w * h)[:, None]).T @ z / w.sum() + np.diag(free), z.T @ (w * d) / w.sum() + free * b)
    return lambda v: np.column_stack([np.ones(len(v)), (v - m) / s]) @ b


@pytest.mark.parametrize("family,target", [("gamma", "rv"), ("gaussian", "rv"), ("logistic", "hot")])
@pytest.mark.parametrize("weight", [None, "w"])
def test_against_numpy(rows, family, target, weight):
    sets = {"two": ("x", "y"), "three": ("z", "x", "y")}
    core = rows.filter("block = 'core'")
    fits = L.fit(core, [L.Spec(k, c, lam) for k, c in sets.items() for lam in (0.0, 0.3, 10.0)], F.col(target).cast("double"), family, weight)
    assert fits.table.count() == 12 and fits.table.filter("converged").count() == 12
    got = fits.predict(rows.filter("block = 'test'")).toPandas()
    data = core.toPandas()
    for (fold, model, lam), part in got.groupby(["fold", "model", "lam"]):
        own = data[data.fold == fold]
        c = list(sets[model])
        w = own[weight].to_numpy() if weight else np.ones(len(own))
        want = numpy_fit(own[c].to_numpy(), own[target].to_numpy().astype(float), w, 2 * lam / len(own), L.FAMILIES[family][0])
        assert np.abs(part["eta"].to_numpy() - want(part[c].to_numpy())).max() < 1e-7


def test_against_mllib(rows):
    """Unpenalised Gamma fits and the balanced gate equal those of fit_gamma and fit_gate."""
    core, test = rows.filter("block = 'core'"), rows.filter("block = 'test'").orderBy("fold", "i")
    fits = L.fit(core, [L.Spec("m", ("x", "y"))], "rv").predict(test).orderBy("fold", "i").toPandas()
    gate = P.gates(core, ["z", "y"], "hot").predict(test).orderBy("fold", "i").toPandas()
    for fold in ("a", "b"):
        own, new = core.filter(F.col("fold") == fold), test.filter(F.col("fold") == fold)
        want = M.fit_gamma(own, ["x", "y"]).predict(new).orderBy("i").toPandas()["predicted_log_rv"]
        assert np.abs(fits[fits.fold == fold]["eta"].to_numpy() - want.to_numpy()).max() < 1e-6
    z = core.select(*[((F.col(c) - m) / s).alias(c) for c, m, s in [(c, *core.filter("fold = 'a'").agg(F.avg(c), F.stddev_pop(c)).first()) for c in ("z", "y")]], "hot", "fold").filter("fold = 'a'")
    m, s = zip(*[core.filter("fold = 'a'").agg(F.avg(c), F.stddev_pop(c)).first() for c in ("z", "y")], strict=True)
    new = test.filter("fold = 'a'").withColumns({c: (F.col(c) - a) / b for c, a, b in zip(("z", "y"), m, s, strict=True)})
    want = M.gate_probability(M.fit_gate(z, ["z", "y"], "hot"), new, ["z", "y"]).orderBy("i").toPandas()["p"].to_numpy()
    assert np.abs(1 / (1 + np.exp(-gate[gate.fold == "a"]["eta"].to_numpy())) - want).max() < 1e-6


def test_features_that_repeat_or_do_not_vary(rows):
    """They change no forecast of an unpenalised fit."""
    core, test = rows.filter("block = 'core'"), rows.filter("block = 'test'")
    got = L.fit(core, [L.Spec("plain", ("x", "y")), L.Spec("more", ("x", "y", "both", "flat"))], "rv").predict(test).toPandas().pivot(index=["fold", "i"], columns="model", values="eta")
    assert np.abs(got["plain"] - got["more"]).max() < 1e-6
    with pytest.raises(ValueError):
        L.fit(core.withColumn("x", F.lit(float("nan"))), [L.Spec("m", ("x",))], "rv")
    with pytest.raises(ValueError):
        L.fit(core.filter("false"), [L.Spec("m", ("x",))], "rv")


def test_parameters_are_checked(spark, rows, tmp_path):
    """Saved parameters score alike; a changed value stops the scorer."""
    core, test = rows.filter("block = 'core'"), rows.filter("block = 'test'")
    fits = L.fit(core, [L.Spec("m", ("x", "y"), 0.1)], "rv")
    fits.save(str(tmp_path / "p"))
    again = L.load(spark, str(tmp_path / "p"), fits.columns, fits.digest)
    assert sorted(map(tuple, again.predict(test).select("fold", "i", "eta").collect())) == sorted(map(tuple, fits.predict(test).select("fold", "i", "eta").collect()))
    bent = L.Fits(again.table.withColumn("beta", F.transform("beta", lambda x: x + 1e-12)), fits.columns, fits.digest)
    with pytest.raises(ValueError):
        bent.predict(test)


def test_probes_equal_single_fits(rows):
    """The chosen penalty, the decision and the forecasts are those of one probe at a time on standardised columns."""
    a = rows.withColumn("anchor_log_rv", F.lit(0.8) + F.when(F.col("fold") == "b", 1.4).otherwise(0.0))
    many = P.fit_probes(a, {"good": ["x", "y"], "noise": ["z"]}, (0.01, 0.3, 10.0))
    got = many.predict(a.filter("block = 'test'")).toPandas()
    chosen = {(r["fold"], r["model"]): r for r in many.chosen.collect()}
    for fold in ("a", "b"):
        own = a.filter(F.col("fold") == fold)
        for model, columns in (("good", ["x", "y"]), ("noise", ["z"])):
            scale = {c: own.filter("block = 'core'").agg(F.avg(c), F.stddev_pop(c)).first() for c in columns}
            z = own.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()})
            one = M.fit_probe(z.filter("block = 'core'"), z.filter("block = 'validation'"), columns, lambdas=(0.01, 0.3, 10.0))
            pick = chosen[fold, model]
            assert pick["selected"] == (one.fit is not None) and abs(pick["loss"] - one.loss) < 1e-7 and abs(pick["base"] - one.anchor_loss) < 1e-9
            want = one.predict(z.filter("block = 'test'")).orderBy("i").toPandas()["correction"].to_numpy()
            mine = got[(got.fold == fold) & (got.model == model)].sort_values("i")["correction"].to_numpy()
            assert np.abs(mine - want).max() < 1e-6


def test_only_the_core_is_fitted(rows):
    """Other values in validation and test change no parameter."""
    spec = [L.Spec("m", ("x", "y"), 0.1)]
    one = L.fit(rows.filter("block = 'core'"), spec, "rv").table.collect()
    bent = rows.withColumn("rv", F.when(F.col("block") == "core", F.col("rv")).otherwise(999.0))
    assert L.fit(bent.filter("block = 'core'"), spec, "rv").table.collect() == one


def test_wide_fits_equal_narrow_ones(spark, rows):
    x = rows.withColumn("v", F.array("x", "y", "z", "both"))
    core, test = x.filter("block = 'core'"), x.filter("block = 'test'")
    lambdas = (0.1, 3.0, 100.0)
    narrow = L.fit(core, [L.Spec("m", ("x", "y", "z", "both"), lam) for lam in lambdas], "rv").predict(test).toPandas()
    wide = L.fit_wide(core, "v", "rv", lambdas).predict(test, "v").toPandas()
    both = narrow.merge(wide, on=["fold", "i", "lam"], suffixes=("", "_wide"))
    assert len(both) == len(narrow) == len(wide) and np.abs(both["eta"] - both["eta_wide"]).max() < 1e-5
    with pytest.raises(ValueError):
        L.fit_wide(core.withColumn("v", F.when(F.col("i") == 3, F.array("x")).otherwise(F.col("v"))), "v", "rv", lambdas)


def test_wider_than_a_gram_matrix(spark):
    """7,170 columns and few rows, against the dual solution of a least-squares ridge."""
    r = np.random.default_rng(4)
    n, d, lam = 60, 7170, 30.0
    x, t = r.normal(size=(n, d)), r.normal(size=n)
    df = spark.createDataFrame([("a", x[i].tolist(), float(t[i])) for i in range(n)], "fold string, v array<double>, t double")
    got = L.fit_wide(df, "v", "t", (lam,), "gaussian").predict(df, "v").toPandas()["eta"].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    k = z @ z.T
    want = t.mean() + k @ np.linalg.solve(k + 2 * lam * np.eye(n), t - t.mean())
    assert np.abs(np.sort(got) - np.sort(want)).max() < 1e-5
