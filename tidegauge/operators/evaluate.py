"""Forecast evaluation: losses, pooled metrics, common support, screens and bootstrap.

Predictions are one long table (fold, model, target_date, true_rv,
predicted_rv); folds and models are grouping keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.losses import finite, usable

KEY = ["fold", "target_date"]


def annotate(predictions: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """predictions with logs, loss (null where a value isn't usable) and, with (fold, threshold), spike flags."""
    ok = usable("true_rv", "predicted_rv")
    u = F.ln("true_rv") - F.ln("predicted_rv")
    out = predictions.withColumns({"usable": ok, "true_log_rv": F.when(ok, F.ln("true_rv")), "predicted_log_rv": F.when(ok, F.ln("predicted_rv")), "qlike": F.when(ok, F.exp(u) - u - 1)})
    if thresholds is None:
        return out
    out = out.join(thresholds.select("fold", F.col("threshold").alias("spike_threshold")), "fold", "left")
    return out.withColumns({"is_spike": F.col("true_rv") > F.col("spike_threshold"), "predicted_spike": F.col("predicted_rv") > F.col("spike_threshold")})


def metrics(annotated: DataFrame, by: list[str]) -> DataFrame:
    """n, bad rows, mean and summed loss (all, normal, spike), R2, RMSE and MAE of RV."""
    ok = F.col("usable")
    e = F.col("predicted_rv") - F.col("true_rv")
    when = lambda test, x: F.when(test, x)
    cols = [
        F.count_if(ok).alias("n"),
        F.count_if(~ok).alias("bad_n"),
        F.avg("qlike").alias("mean_qlike"),
        F.sum("qlike").alias("sum_qlike"),
        (1 - F.try_divide(F.sum(when(ok, e * e)), F.count_if(ok) * F.var_pop(when(ok, F.col("true_rv"))))).alias("r2"),
        F.sqrt(F.avg(when(ok, e * e))).alias("rmse"),
        F.avg(when(ok, F.abs(e))).alias("mae"),
    ]
    if "is_spike" in annotated.columns:
        cols += [F.avg(when(~F.col("is_spike"), F.col("qlike"))).alias("normal_qlike"), F.avg(when(F.col("is_spike"), F.col("qlike"))).alias("spike_qlike")]
    return annotated.groupBy(*by).agg(*cols)


def log_diagnostics(annotated: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """MSE, median absolute error, bias, correlation and directional accuracy of log forecasts.

    Direction compares sign(y_t - y_{t-1}) with sign(forecast_t - y_{t-1}) inside
    `within` (a model and fold); a move of zero (below 1e-9) has the sign zero.
    """
    move = lambda c: F.signum(F.round(F.col(c) - F.col("_b"), 9))
    w = Window.partitionBy(*within).orderBy("target_date")
    x = annotated.filter("usable").withColumn("_b", F.lag("true_log_rv").over(w))
    e = F.col("predicted_log_rv") - F.col("true_log_rv")
    hit = F.when(F.col("_b").isNotNull(), (move("true_log_rv") == move("predicted_log_rv")).cast("double"))
    flat = (F.stddev_pop("true_log_rv") > 0) & (F.stddev_pop("predicted_log_rv") > 0)
    return x.groupBy(*by).agg(F.avg(e * e).alias("log_mse"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_abs_error"), F.avg(e).alias("bias"), F.when(flat, F.corr("true_log_rv", "predicted_log_rv")).alias("correlation"), F.avg(hit).alias("direction"))


def spike_diagnostics(annotated: DataFrame, by: list[str]) -> DataFrame:
    """Spikes, predicted spikes, captured spikes and their rate, ratio of deviations, mean ratio on spikes."""
    s, p = F.col("is_spike"), F.col("predicted_spike")
    return annotated.filter("usable").groupBy(*by).agg(
        F.count_if(s).alias("spikes"),
        F.count_if(p).alias("predicted_spikes"),
        F.count_if(s & p).alias("captured"),
        F.try_divide(F.count_if(s & p), F.count_if(s)).alias("capture_rate"),
        F.try_divide(F.stddev_pop("predicted_log_rv"), F.stddev_pop("true_log_rv")).alias("std_ratio"),
        F.avg(F.when(s, F.col("predicted_rv") / F.col("true_rv"))).alias("spike_mean_ratio"),
    )


def pooled(annotated: DataFrame) -> DataFrame:
    """Metrics of each model over all folds; direction is judged inside folds and averaged over all hits."""
    m = metrics(annotated, ["model"])
    d = log_diagnostics(annotated, ["model"], ["model", "fold"])
    out = m.join(d, "model", "left")
    return out.join(spike_diagnostics(annotated, ["model"]), "model", "left") if "is_spike" in annotated.columns else out


def probability_metrics(rows: DataFrame, by: list[str], p: str = "p", label: str = "is_spike") -> DataFrame:
    """AUC (ties count half), average precision (sum of steps), Brier, mean, P90 and base rate.

    Rows are first counted for each distinct score, so ranks come from sums over
    scores and a key's rows are never sorted together. No rows at all, and no
    keys: one row with n = 0 and null for the rest.
    """
    y = F.col(label).cast("long")
    each = rows.groupBy(*by, p).agg(F.sum(y).alias("_pos"), F.count("*").alias("_n"), F.sum((F.col(p) - y) * (F.col(p) - y)).alias("_sq"))
    up = Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    neg = F.col("_n") - F.col("_pos")
    x = each.withColumns({"_below": F.coalesce(F.sum(neg).over(up), F.lit(0)), "_tp": F.sum("_pos").over(down), "_all": F.sum("_n").over(down)})
    out = x.groupBy(*by).agg(
        F.sum("_pos").alias("_p"),
        F.sum("_n").alias("n"),
        F.sum(F.col("_pos") * (F.col("_below") + neg / 2)).alias("_u"),
        F.sum(F.col("_pos") * F.col("_tp") / F.col("_all")).alias("_ap"),
        F.sum("_sq").alias("_sq"),
        F.sum(F.col(p) * F.col("_n")).alias("_sum"),
    )
    out = out.withColumns({"auc": F.try_divide(F.col("_u"), F.col("_p") * (F.col("n") - F.col("_p"))), "average_precision": F.try_divide("_ap", "_p"), "brier": F.try_divide("_sq", "n"), "mean_p": F.try_divide("_sum", "n"), "base_rate": F.try_divide("_p", "n"), "n": F.coalesce("n", F.lit(0))})
    q = rows.groupBy(*by).agg(F.percentile(p, F.lit(0.9)).alias("p90"))
    out = out.drop("_p", "_u", "_ap", "_sq", "_sum")
    return out.join(q, by) if by else out.crossJoin(q)


def correction_metrics(rows: DataFrame, by: list[str], correction: str = "correction", anchor: str = "anchor_log_rv") -> DataFrame:
    """Mean, deviation, mean and largest size of a correction, and its correlation with the anchor's gap to the truth."""
    gap = F.ln("true_rv") - F.col(anchor)
    c = F.col(correction)
    return rows.groupBy(*by).agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.avg(F.abs(c)).alias("mean_abs"), F.max(F.abs(c)).alias("max_abs"), F.when((F.stddev_pop(c) > 0) & (F.stddev_pop(gap) > 0), F.corr(c, gap)).alias("gap_correlation"))


def common_support(predictions: DataFrame) -> DataFrame:
    """The rows whose (fold, target) every model has."""
    models = predictions.agg(F.count_distinct("model").alias("_m"))
    keys = predictions.groupBy(*KEY).agg(F.count_distinct("model").alias("_n")).join(models, F.col("_n") == F.col("_m")).select(*KEY)
    return predictions.join(keys, KEY, "left_semi")


def against_anchor(table: DataFrame, anchor: str, columns: list[str], order: str = "mean_qlike", keys: list[str] | None = None) -> DataFrame:
    """A metric table with deltas to the anchor model and the rank (equal values share the smallest)."""
    keys = keys or []
    a = table.filter(F.col("model") == anchor).select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = table.join(a, keys) if keys else table.crossJoin(a)
    out = joined.withColumns({f"{c}_delta": F.col(c) - F.col(f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))
    # one row a model: the table that is ranked is short
    return out.withColumn("rank", F.rank().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy(order)))


def seed_summary(per_seed: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample deviation over seeds of each model's metrics."""
    return per_seed.groupBy("model").agg(F.count_distinct("seed").alias("seeds"), *(F.avg(c).alias(f"{c}_mean") for c in columns), *(F.stddev_samp(c).alias(f"{c}_std") for c in columns))


def fold_stability(per_fold: DataFrame, anchor: str, loss: str = "mean_qlike") -> DataFrame:
    """Folds won against the anchor, and the mean and sample deviation of fold losses."""
    a = per_fold.filter(F.col("model") == anchor).select("fold", F.col(loss).alias("_a"))
    return per_fold.join(a, "fold").groupBy("model").agg(F.count("*").alias("folds"), F.count_if(F.col(loss) < F.col("_a")).alias("wins"), F.avg(loss).alias("fold_mean"), F.stddev_samp(loss).alias("fold_std"))


def threshold_conflicts(annotated: DataFrame) -> DataFrame:
    """Folds whose rows don't agree on the spike threshold."""
    return annotated.groupBy("fold").agg(F.count_distinct("spike_threshold").alias("thresholds")).filter("thresholds > 1")


def screen(per_fold: DataFrame, pooled_: DataFrame, anchor: str, wins: int, delta: float = 1e-5, normal_guard: float | None = None) -> DataFrame:
    """(model, wins, improved, guard_ok, passed): fold wins by more than delta, a better pooled mean, and normal days not worse than the guard."""
    a = per_fold.filter(F.col("model") == anchor).select("fold", F.col("mean_qlike").alias("_a"))
    w = per_fold.filter(F.col("model") != anchor).join(a, "fold").groupBy("model").agg(F.count_if(F.col("mean_qlike") < F.col("_a") - delta).alias("wins"))
    extra = ["normal_qlike"] if normal_guard else []
    b = pooled_.filter(F.col("model") == anchor).select(F.col("mean_qlike").alias("_p"), *(F.col(c).alias(f"_{c}") for c in extra))
    out = pooled_.join(w, "model").crossJoin(b).withColumn("improved", F.col("mean_qlike") < F.col("_p") - delta)
    guard = F.coalesce(F.col("normal_qlike") <= F.col("_normal_qlike") * normal_guard, F.lit(False)) if normal_guard else F.lit(True)
    out = out.withColumn("guard_ok", guard)
    return out.select("model", "wins", "improved", "guard_ok", ((F.col("wins") >= wins) & F.col("improved") & F.col("guard_ok")).alias("passed"))


def before_after(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Delta and relative percent of each metric; an error where the keys differ."""
    b = before.select(*keys, F.lit(1).alias("_b"), *(F.col(c).alias(f"{c}_before") for c in columns))
    a = after.select(*keys, F.lit(1).alias("_a"), *(F.col(c).alias(f"{c}_after") for c in columns))
    out = b.join(a, keys, "full_outer")
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    bad = F.raise_error(F.lit("the keys before and after differ")).cast("double")
    deltas = {}
    for c in columns:
        change = F.col(f"{c}_after") - F.col(f"{c}_before")
        deltas[f"{c}_delta"] = F.when(ok, change).otherwise(bad)
        deltas[f"{c}_percent"] = F.when(ok, 100 * F.try_divide(change, F.abs(f"{c}_before"))).otherwise(bad)
    return out.withColumns(deltas).drop("_a", "_b")


def dimension_deltas(table: DataFrame, reference: int, columns: list[str]) -> DataFrame:
    """Metrics of each dimension less those of the reference dimension, per model."""
    r = table.filter(F.col("dimension") == reference).select("model", *(F.col(c).alias(f"_{c}") for c in columns))
    return table.join(r, "model").select("model", "dimension", *((F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in columns))


def worst_days(annotated: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("model").orderBy(F.desc_nulls_last("qlike"), "fold", "target_date")
    return annotated.withColumn("worst_rank", F.row_number().over(w)).filter(F.col("worst_rank") <= k)


def influence(annotated: DataFrame, anchor: str, most: int = 3) -> DataFrame:
    """(model, dropped, n, mean_qlike): means without the anchor's worst 0 .. most spike days."""
    spikes = annotated.filter((F.col("model") == anchor) & F.col("is_spike"))
    top = spikes.orderBy(F.desc("qlike"), *KEY).limit(most)
    ranked = top.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("qlike"), *KEY))).select(*KEY, "_r")  # `most` rows
    x = annotated.join(F.broadcast(ranked), KEY, "left")
    kept = x.withColumn("dropped", F.explode(F.sequence(F.lit(0), F.lit(most)))).filter(F.col("_r").isNull() | (F.col("_r") > F.col("dropped")))
    return kept.groupBy("model", "dropped").agg(F.count("qlike").alias("n"), F.avg("qlike").alias("mean_qlike"))


def support_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: keys only in a, only in b, and the largest difference of targets."""
    x = a.select(*KEY, F.col("true_rv").alias("_x")).join(b.select(*KEY, F.col("true_rv").alias("_y")), KEY, "full_outer")
    return x.agg(F.count_if(F.col("_y").isNull()).alias("only_a"), F.count_if(F.col("_x").isNull()).alias("only_b"), F.max(F.abs(F.col("_x") - F.col("_y"))).alias("max_difference"))


def non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many values of each column are null, NaN or infinite."""
    return df.agg(*(F.count_if(~finite(c)).alias(c) for c in columns))


def block_bootstrap(losses: DataFrame, by: list[str], block: int, replicates: int, seed: int = 7, value: str = "loss") -> DataFrame:
    """(by, replicate, mean): means of circular blocks of successive days drawn at random.

    Draws come from hashes of (replicate, draw), so they don't depend on
    partitions, and replicates are made in parallel. A block's sum is taken from
    the running sum, so each draw is one equi-join row whatever the block size.
    """
    w = Window.partitionBy(*by).orderBy("target_date")
    x = losses.withColumns({"_i": F.row_number().over(w) - 1, "_s": F.coalesce(F.sum(value).over(w.rowsBetween(0, block - 1)), F.lit(0.0))})
    size = losses.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(value).alias("_all"))
    head = x.filter(F.col("_i") < block).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", value))), lambda s: s[value]).alias("_h"))
    # blocks that pass the end go on at the beginning
    x = x.join(size, by).join(head, by).withColumn("_over", F.greatest(F.lit(0), F.col("_i") + block - F.col("_n")).cast("int"))
    x = x.withColumn("_s", F.col("_s") + F.aggregate(F.slice("_h", F.lit(1), F.col("_over")), F.lit(0.0), lambda a, v: a + v)).select(*by, "_i", "_s")
    draws = size.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_d", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_n") / block).cast("int"))))
    draws = draws.withColumn("_i", F.pmod(F.xxhash64(F.lit(seed), "replicate", "_d"), F.col("_n")).cast("int")).select(*by, "replicate", "_i")
    return draws.join(x, [*by, "_i"]).groupBy(*by, "replicate").agg((F.sum("_s") / (F.count("*") * block)).alias("mean"))


def bootstrap_interval(replicates: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return replicates.groupBy(*by).agg(F.percentile("mean", F.lit(a)).alias("low"), F.percentile("mean", F.lit(0.5)).alias("middle"), F.percentile("mean", F.lit(1 - a)).alias("high"))


def confidence_set(annotated: DataFrame, block: int = 10, replicates: int = 200, level: float = 0.10, seed: int = 7) -> DataFrame:
    """(model, p_value, included) by eliminating, one at a time, the model with the largest standardised mean loss.

    All models are resampled with the same draws, so a model's replicate means
    are comparable; what is iterated is a table of models by replicates.
    """
    wide = common_support(annotated).filter("usable")
    reps = block_bootstrap(wide.select("model", "target_date", F.col("qlike").alias("loss")), ["model"], block, replicates, seed)
    means = {r["model"]: r["m"] for r in wide.groupBy("model").agg(F.avg("qlike").alias("m")).collect()}
    import numpy as np

    models = sorted(means)
    table = {r["model"]: r["x"] for r in reps.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("replicate", "mean"))), lambda s: s["mean"]).alias("x")).collect()}
    boot, mean = np.array([table[m] for m in models]), np.array([means[m] for m in models])
    alive, p, highest = list(range(len(models))), {}, 0.0
    while len(alive) > 1:
        d = mean[alive] - mean[alive].mean()
        b = boot[alive] - boot[alive].mean(axis=0) - d[:, None]
        sd = np.maximum(np.sqrt((b**2).mean(axis=1)), 1e-15)
        t, tb = d / sd, (b / sd[:, None]).max(axis=0)
        highest = max(highest, float((tb >= t.max()).mean()))
        out = alive[int(t.argmax())]
        p[out] = highest
        alive.remove(out)
    p[alive[0]] = 1.0
    return annotated.sparkSession.createDataFrame([(models[i], v, bool(v >= level)) for i, v in p.items()], "model string, p_value double, included boolean")


def loss_difference(annotated: DataFrame, a: str, b: str, lags: int = 5) -> DataFrame:
    """One row: mean loss difference of two models on common support, its long-run deviation and t-statistic."""
    x = annotated.filter("usable").filter(F.col("model").isin(a, b)).groupBy(*KEY).pivot("model", [a, b]).agg(F.first("qlike")).na.drop()
    d = x.select(*KEY, (F.col(a) - F.col(b)).alias("d"))
    mean = d.agg(F.avg("d").alias("_m"))
    w = Window.partitionBy("fold").orderBy("target_date")
    c = d.crossJoin(mean).withColumn("c", F.col("d") - F.col("_m"))
    terms = c.withColumns({f"_g{k}": F.col("c") * (F.lag("c", k).over(w) if k else F.col("c")) for k in range(lags + 1)})
    s = terms.agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), *(F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)).alias(f"_s{k}") for k in range(lags + 1)))
    lrv: Column = F.col("_s0")
    for k in range(1, lags + 1):
        lrv = lrv + 2 * (1 - k / (lags + 1)) * F.col(f"_s{k}")
    sd = F.sqrt(F.try_divide(F.greatest(lrv, F.lit(0.0)), F.col("n")))
    return s.select("n", "mean_difference", sd.alias("long_run_std"), F.try_divide(F.col("mean_difference") * F.sqrt("n"), sd).alias("t"))


