"""Fits on a fold's core block by Spark MLlib, selection with fallback, routing, blending and ensembles.

Forecast frames have fold, model, seed, target_date, true_rv, predicted_rv.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.losses import qlike
from tidegauge.operators.sizes import small

LAMBDAS = (0.0, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0)
MIN_GAIN = 1e-5
GATE_THRESHOLDS = (0.2, 0.3, 0.4, 0.5)
BLENDS = (0.0, 0.25, 0.5, 0.75, 1.0)


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(df)


def random_walk(rows: DataFrame) -> DataFrame:
    """The last value as the forecast."""
    return rows.withColumn("predicted_log_rv", F.col("lag_1")).withColumn("predicted_rv", F.exp("lag_1"))


@dataclass
class OlsFit:
    model: object
    smearing: float
    r2: float
    features: list[str]

    def predict(self, rows: DataFrame) -> DataFrame:
        """Forecast of RV: exp(linear prediction) times the mean of exp(core residuals)."""
        out = self.model.transform(_assembled(rows, self.features)).withColumn("predicted_rv", F.exp("_p") * self.smearing)
        return out.withColumn("predicted_log_rv", F.ln("predicted_rv")).drop("_features", "_p")


def fit_ols(core: DataFrame, features: list[str], y: str = "log_rv") -> OlsFit:
    train = _assembled(core, features).select("_features", y)
    model = LinearRegression(featuresCol="_features", labelCol=y, predictionCol="_p", solver="normal").fit(train)
    smear = model.transform(train).agg(F.avg(F.exp(F.col(y) - F.col("_p")))).first()[0]
    return OlsFit(model, smear, model.summary.r2, features)


@dataclass
class Linear:
    """A linear predictor in units of the raw features."""

    intercept: float
    coefficients: list[float]


@dataclass
class GammaFit:
    model: Linear
    features: list[str]
    offset: str | None = None

    def predict(self, rows: DataFrame) -> DataFrame:
        log = F.col(self.offset) if self.offset else F.lit(0.0)
        for c, b in zip(self.features, self.model.coefficients, strict=True):
            log = log + F.col(c) * b
        return rows.dropna(subset=self.features).withColumn("predicted_log_rv", log + self.model.intercept).withColumn("predicted_rv", F.exp("predicted_log_rv"))


def fit_gamma(core: DataFrame, features: list[str], y: str = "rv", offset: str | None = None, lam: float = 0.0, weight: str | None = None, iterations: int = 100) -> GammaFit:
    """Gamma GLM with log link: its deviance is twice the exact QLIKE, so it fits that loss.

    With offset (a log anchor) the target is y / exp(anchor). lam is the sum-form
    penalty lam * |beta|^2; the intercept is free. An error where it doesn't
    converge.

    Features are centred and put in units of the least of their deviations, which
    changes neither the optimum nor the penalty's form: raw features that vary
    little around a large mean move the coefficients by rounding alone, step after step.
    """
    target = F.col(y) / F.exp(F.col(offset)) if offset else F.col(y)
    kept = core.withColumn("_y", target).dropna(subset=features).select(*features, "_y", *([weight] if weight else [])).persist()
    try:
        moments = kept.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features))).first()
        means = [moments[f"m{i}"] for i in range(len(features))]
        unit = min((s for i, m in enumerate(means) if m is not None and (s := moments[f"s{i}"]) > 1e-12 * max(1, abs(m))), default=1.0)
        scaled = kept.select(*(((F.col(c) - m) / unit).alias(f"_x{i}") for i, (c, m) in enumerate(zip(features, means, strict=True))), "_y", *([F.col(weight)] if weight else []))
        train = _assembled(scaled, [f"_x{i}" for i in range(len(features))])
        glr = GeneralizedLinearRegression(family="gamma", link="log", featuresCol="_features", labelCol="_y", predictionCol="_p", tol=1e-10, maxIter=iterations, regParam=2 * lam / (moments["n"] or 1) / unit**2)
        model = (glr.setWeightCol(weight) if weight else glr).fit(train)
        if model.summary.numIterations >= iterations:
            raise ValueError("the Gamma fit did not converge")
    finally:
        kept.unpersist()
    beta = [float(b) / unit for b in model.coefficients]
    return GammaFit(Linear(model.intercept - sum(b * m for b, m in zip(beta, means, strict=True)), beta), features, offset)


def weighted_standardise(rows: DataFrame, core: DataFrame, columns: list[str], weight: str = "weight", floor: float = 1e-8) -> DataFrame:
    """rows at the weighted mean and deviation of the core rows."""
    w = F.col(weight)
    s = core.agg(F.sum(w).alias("_w"), *(F.sum(w * F.col(c)).alias(f"_a_{c}") for c in columns), *(F.sum(w * F.col(c) * F.col(c)).alias(f"_q_{c}") for c in columns))
    s = s.select(*((F.col(f"_a_{c}") / F.col("_w")).alias(f"_m_{c}") for c in columns), *(F.greatest(F.sqrt(F.greatest(F.col(f"_q_{c}") / F.col("_w") - F.pow(F.col(f"_a_{c}") / F.col("_w"), 2), F.lit(0.0))), F.lit(floor)).alias(f"_s_{c}") for c in columns))
    return rows.crossJoin(F.broadcast(s)).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns}).drop(*(f"_{x}_{c}" for x in "ms" for c in columns))  # one row


def pick_in_order(candidates: DataFrame, keys: list[str], by: str, loss: str = "loss", delta: float = MIN_GAIN) -> DataFrame:
    """(keys, by, loss): scanning `by` upwards, a candidate is taken if better by more than delta, or within delta (the later wins ties).

    Ties are judged against the best so far, so this is a fold and no arg-min.
    The candidates of a key are a short grid.
    """
    grid = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(by).cast("double").alias("v"), F.col(loss).alias("l")))).alias("_g"))
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(float("inf")).alias("l"))
    best = F.aggregate("_g", start, lambda a, c: F.when((c["l"] < a["l"] - delta) | (F.abs(c["l"] - a["l"]) <= delta), c).otherwise(a))
    return grid.withColumn("_b", best).select(*keys, F.col("_b.v").alias(by), F.col("_b.l").alias(loss))


@dataclass
class Probe:
    fit: GammaFit | None
    lam: float | None
    anchor_loss: float
    loss: float | None

    def predict(self, rows: DataFrame, anchor: str = "anchor_log_rv") -> DataFrame:
        """Corrected forecasts; the anchor itself where no correction was selected."""
        if self.fit is None:
            return rows.withColumn("predicted_log_rv", F.col(anchor)).withColumn("predicted_rv", F.exp(anchor)).withColumn("correction", F.lit(0.0))
        out = self.fit.predict(rows)
        return out.withColumn("correction", F.col("predicted_log_rv") - F.col(anchor))


def mean_loss(rows: DataFrame, y: str = "rv") -> float:
    return rows.agg(F.avg(qlike(y, "predicted_rv"))).first()[0]


def fit_probe(core: DataFrame, validation: DataFrame, features: list[str], anchor: str = "anchor_log_rv", y: str = "rv", lambdas=LAMBDAS, delta: float = MIN_GAIN, weight: str | None = None) -> Probe:
    """A ridge correction of an anchor: one fit for each lambda, chosen on validation, dropped unless it gains delta.

    The grid is fixed and short; each fit is a Spark job over the cached core.
    """
    core, validation = core.persist(), validation.persist()
    base = validation.agg(F.avg(qlike(y, "_anchor_rv"))).first()[0] if "_anchor_rv" in validation.columns else validation.withColumn("_anchor_rv", F.exp(anchor)).agg(F.avg(qlike(y, "_anchor_rv"))).first()[0]
    best: tuple[float, float | None, GammaFit | None] = (float("inf"), None, None)
    for lam in sorted(lambdas):
        fit = fit_gamma(core, features, y, anchor, lam, weight)
        loss = mean_loss(fit.predict(validation), y)
        if loss < best[0] - delta or abs(loss - best[0]) <= delta:
            best = (loss, lam, fit)
    core.unpersist()
    validation.unpersist()
    if best[0] < base - delta:
        return Probe(best[2], best[1], base, best[0])
    return Probe(None, None, base, best[0])


def refit_probe(selected: Probe, pool: DataFrame, features: list[str], anchor: str = "anchor_log_rv", y: str = "rv") -> Probe:
    """The selected lambda and decision kept, the coefficients fitted anew on core and validation together."""
    if selected.fit is None:
        return selected
    return Probe(fit_gamma(pool, features, y, anchor, selected.lam), selected.lam, selected.anchor_loss, selected.loss)


def fit_gate(core: DataFrame, features: list[str], label: str = "is_spike", c: float = 0.1, least: int = 5):
    """Balanced logistic regression with the penalty 1 / C; an error with fewer than `least` rows of a class."""
    n = {r[label]: r["n"] for r in core.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if min(n.get(True, 0), n.get(False, 0)) < least:
        raise ValueError("a class has too few rows")
    total = n[True] + n[False]
    w = F.when(F.col(label), total / (2 * n[True])).otherwise(total / (2 * n[False]))
    train = _assembled(core.withColumn("_w", w).withColumn("_y", F.col(label).cast("double")), features)
    return LogisticRegression(featuresCol="_features", labelCol="_y", weightCol="_w", regParam=1 / (c * total), standardization=False, tol=1e-10, maxIter=500).fit(train.select("_features", "_y", "_w"))


def gate_probability(model, rows: DataFrame, features: list[str]) -> DataFrame:
    out = model.transform(_assembled(rows, features)).withColumn("p", vector_to_array("probability")[1])
    return out.drop("_features", "rawPrediction", "probability", "prediction")


KEY = ["fold", "target_date"]


def _pair(normal: DataFrame, spike: DataFrame) -> DataFrame:
    """Both forecasts of a target; an error where their targets differ."""
    b = spike.select(*KEY, F.col("true_rv").alias("_t"), F.col("predicted_rv").alias("_spike"))
    out = normal.withColumnRenamed("predicted_rv", "_normal").join(b, KEY)
    same = F.when(F.col("_t") == F.col("true_rv"), F.col("true_rv")).otherwise(F.raise_error(F.lit("two forecasts of a target differ in its value")).cast("double"))
    return out.withColumn("true_rv", same).drop("_t")


def route(normal: DataFrame, spike: DataFrame, p: DataFrame, threshold: Column | float | None = None, soft: bool = False, selected: Column | bool = True) -> DataFrame:
    """Mix of two forecasts in logs: weight p (soft) or whether p reaches the threshold (hard); not selected: normal."""
    both = _pair(normal, spike).join(p.select(*KEY, "p"), KEY)
    w = F.col("p") if soft else (F.col("p") >= threshold).cast("double")
    w = F.when(selected if isinstance(selected, Column) else F.lit(selected), w).otherwise(0.0)
    out = both.withColumn("spike_weight", w)
    return out.withColumn("predicted_rv", F.exp((1 - F.col("spike_weight")) * F.ln("_normal") + F.col("spike_weight") * F.ln("_spike"))).drop("_normal", "_spike")


def select_threshold(normal: DataFrame, spike: DataFrame, p: DataFrame, thresholds=GATE_THRESHOLDS, delta: float = MIN_GAIN) -> DataFrame:
    """(fold, threshold, loss, normal_loss, selected) on validation rows; ties take the higher threshold."""
    grid = normal.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    both = _pair(normal, spike).join(p.select(*KEY, "p"), KEY).crossJoin(F.broadcast(grid))  # a row for each threshold
    routed = both.withColumn("predicted_rv", F.when(F.col("p") >= F.col("threshold"), F.col("_spike")).otherwise(F.col("_normal")))
    losses = routed.groupBy("fold", "threshold").agg(F.avg(qlike("true_rv", "predicted_rv")).alias("loss"), F.avg(qlike("true_rv", "_normal")).alias("normal_loss"))
    best = pick_in_order(losses, ["fold"], "threshold", delta=delta)
    base = losses.groupBy("fold").agg(F.max("normal_loss").alias("normal_loss"))
    return best.join(base, "fold").withColumn("selected", F.col("loss") < F.col("normal_loss") - delta)


def select_blend(a: DataFrame, b: DataFrame, blends=BLENDS, delta: float = MIN_GAIN) -> DataFrame:
    """(fold, alpha, loss): the convex mix in logs of two forecasts on validation rows; ties take the larger alpha."""
    grid = a.sparkSession.createDataFrame([(float(x),) for x in blends], "alpha double")
    both = _pair(a, b).crossJoin(F.broadcast(grid))  # a row for each blend
    mixed = both.withColumn("predicted_rv", F.exp((1 - F.col("alpha")) * F.ln("_normal") + F.col("alpha") * F.ln("_spike")))
    losses = mixed.groupBy("fold", "alpha").agg(F.avg(qlike("true_rv", "predicted_rv")).alias("loss"))
    return pick_in_order(losses, ["fold"], "alpha", delta=delta)


def blend(a: DataFrame, b: DataFrame, chosen: DataFrame) -> DataFrame:
    both = _pair(a, b).join(chosen.select("fold", "alpha"), "fold")
    return both.withColumn("predicted_rv", F.exp((1 - F.col("alpha")) * F.ln("_normal") + F.col("alpha") * F.ln("_spike"))).drop("_normal", "_spike")


def tail_mixture(normal: DataFrame, tail: DataFrame, p: DataFrame) -> DataFrame:
    """(1 - p) * normal + p * tail."""
    both = _pair(normal, tail).join(p.select(*KEY, "p"), KEY)
    return both.withColumn("predicted_rv", (1 - F.col("p")) * F.col("_normal") + F.col("p") * F.col("_spike")).drop("_normal", "_spike")


def variance_filter(returns: DataFrame, parameters: DataFrame, keys: list[str], r: str = "return_percent") -> DataFrame:
    """(keys, spec, day, variance) of each day from returns before it, with fixed parameters.

    parameters: (spec, kind, mu, omega, alpha ARRAY, gamma, beta, start) of
    arch, garch, gjr or egarch. The recursion runs day by day inside a series
    and specification; series and specifications run in parallel. The
    result is in squared units of the log return (percent squared / 10^4).
    """
    import numpy as np
    import pandas as pd

    rows = returns.select(*keys, "day", r).crossJoin(small(parameters))
    types = dict(returns.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "spec string, day date, variance double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        q = pdf.iloc[0]
        e = pdf[r].to_numpy(float) - q["mu"]
        alpha = np.asarray(q["alpha"], float)
        out = np.empty(len(e))
        h = np.log(q["start"]) if q["kind"] == "egarch" else q["start"]
        past = [q["start"]] * len(alpha)
        for i in range(len(e)):
            out[i] = np.exp(h) if q["kind"] == "egarch" else h
            if q["kind"] == "arch":
                past = [e[i] ** 2, *past[:-1]]
                h = q["omega"] + float(alpha @ np.array(past))
            elif q["kind"] == "egarch":
                z = e[i] / np.sqrt(out[i])
                h = q["omega"] + alpha[0] * (abs(z) - np.sqrt(2 / np.pi)) + q["gamma"] * z + q["beta"] * h
            else:
                h = q["omega"] + alpha[0] * e[i] ** 2 + q["gamma"] * e[i] ** 2 * (e[i] < 0) + q["beta"] * h
        done = pdf[[*keys, "spec", "day"]].copy()
        done["variance"] = out / 10_000
        return done

    return rows.groupBy(*keys, "spec").applyInPandas(run, schema)


def seed_ensemble(predictions: DataFrame, folds: int, seeds: int) -> DataFrame:
    """Mean RV over seeds of each (model, fold, target); models without every seed on every fold are left out."""
    done = predictions.groupBy("model").agg(F.count_distinct("fold").alias("_f"), F.count_distinct("fold", "seed").alias("_fs"))
    whole = done.filter((F.col("_f") == folds) & (F.col("_fs") == folds * seeds)).select("model")
    mean = predictions.join(whole, "model", "left_semi").groupBy("model", *KEY).agg(F.avg("predicted_rv").alias("predicted_rv"), F.min("true_rv").alias("true_rv"), F.max("true_rv").alias("_t"), F.count_distinct("seed").alias("seeds"))
    same = F.when(F.col("_t") == F.col("true_rv"), F.col("true_rv")).otherwise(F.raise_error(F.lit("two seeds of a target differ in its value")).cast("double"))
    out = mean.withColumn("true_rv", same).filter(F.col("seeds") == seeds).drop("_t", "seeds")
    return out.withColumn("predicted_log_rv", F.ln("predicted_rv")).withColumn("qlike", qlike("true_rv", "predicted_rv"))


def completion(predictions: DataFrame, expected: DataFrame, folds: list[str]) -> DataFrame:
    """Per expected model (model): completed and missing folds, and whether it is eligible."""
    got = predictions.groupBy("model").agg(F.sort_array(F.collect_set("fold")).alias("completed"))
    every = F.array(*(F.lit(f) for f in folds))
    out = expected.join(got, "model", "left").withColumn("completed", F.coalesce("completed", F.array().cast("array<string>")))
    out = out.withColumn("missing", F.array_except(every, "completed"))
    return out.withColumn("status", F.when(F.size("completed") == 0, "missing").when(F.size("missing") > 0, "ineligible_incomplete_folds").otherwise("eligible"))


