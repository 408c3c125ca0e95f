"""Queries over forecasts: fits, routing, metrics, screens, intervals."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tidegauge.operators import calendar as C
from tidegauge.operators import evaluate as J
from tidegauge.operators import models as M
from tidegauge.plans import tables as T
from tidegauge.plans.tables import tidy, tidy_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return keep


_P = T.PREDICTIONS


@query("j02_annotated", tidy_sql("SELECT fold, model, target_date, qlike, is_spike, predicted_spike FROM ann", "qlike", "target_date", ctes=_P))
def annotated(s, d):
    return T.annotated(s, d).select("fold", "model", "target_date", "qlike", "is_spike", "predicted_spike")


_METRICS = "count(*) AS n, CAST(0 AS BIGINT) AS bad_n, avg(qlike) AS mean_qlike, sum(qlike) AS sum_qlike, 1 - sum((predicted_rv - true_rv) ** 2) / (count(*) * var_pop(true_rv)) AS r2, sqrt(avg((predicted_rv - true_rv) ** 2)) AS rmse, avg(abs(predicted_rv - true_rv)) AS mae, avg(qlike) FILTER (WHERE NOT is_spike) AS normal_qlike, avg(qlike) FILTER (WHERE is_spike) AS spike_qlike"
_MD = "mean_qlike sum_qlike r2 rmse mae normal_qlike spike_qlike"
_FOLD = _P + f", perfold AS (SELECT fold, model, {_METRICS} FROM ann GROUP BY 1, 2), permodel AS (SELECT model, {_METRICS} FROM ann GROUP BY 1)"


def _fold_pool(s, d):
    a = T.annotated(s, d)
    return J.metrics(a, ["fold", "model"]), J.metrics(a, ["model"])


@query("j03_fold_metrics", tidy_sql("SELECT * FROM perfold", _MD, ctes=_FOLD))
def fold_metrics(s, d):
    return J.metrics(T.annotated(s, d), ["fold", "model"])


_LOG = ", dir AS (SELECT *, lag(ly) OVER (PARTITION BY model, fold ORDER BY target_date) AS b FROM ann)"
_LOGS = "avg((lp - ly) ** 2) AS log_mse, quantile_cont(abs(lp - ly), 0.5) AS median_abs_error, avg(lp - ly) AS bias, corr(ly, lp) AS correlation, avg(CASE WHEN b IS NOT NULL THEN CASE WHEN sign(round(ly - b, 9)) = sign(round(lp - b, 9)) THEN 1.0 ELSE 0.0 END END) AS direction"


@query("j04_log_diagnostics", tidy_sql(f"SELECT model, {_LOGS} FROM dir GROUP BY 1", "log_mse median_abs_error bias correlation direction", ctes=_P + _LOG))
def logs(s, d):
    return J.log_diagnostics(T.annotated(s, d), ["model"], ["model", "fold"])


_SPIKES = "count(*) FILTER (WHERE is_spike) AS spikes, count(*) FILTER (WHERE predicted_spike) AS predicted_spikes, count(*) FILTER (WHERE is_spike AND predicted_spike) AS captured, count(*) FILTER (WHERE is_spike AND predicted_spike) / nullif(count(*) FILTER (WHERE is_spike), 0)::DOUBLE AS capture_rate, stddev_pop(lp) / nullif(stddev_pop(ly), 0) AS std_ratio, avg(predicted_rv / true_rv) FILTER (WHERE is_spike) AS spike_mean_ratio"


@query("j05_spike_diagnostics", tidy_sql(f"SELECT fold, model, {_SPIKES} FROM ann GROUP BY 1, 2", "capture_rate std_ratio spike_mean_ratio", ctes=_P))
def spikes(s, d):
    return J.spike_diagnostics(T.annotated(s, d), ["fold", "model"])


@query("j06_pooled_metrics", tidy_sql(f"SELECT * FROM (SELECT model, {_METRICS} FROM ann GROUP BY 1) JOIN (SELECT model, {_LOGS} FROM dir GROUP BY 1) USING (model) JOIN (SELECT model, {_SPIKES} FROM ann GROUP BY 1) USING (model)", _MD + " log_mse median_abs_error bias correlation direction capture_rate std_ratio spike_mean_ratio", ctes=_P + _LOG))
def pooled(s, d):
    return J.pooled(T.annotated(s, d))


_PROB = ", pr AS (SELECT fold, target_date, is_spike, 1 / (1 + exp(-(lp - ln(threshold)))) AS p FROM ann WHERE model = 'mean_5')"


def _prob(s, d):
    a = T.annotated(s, d).filter("model = 'mean_5'")
    return a.withColumn("p", 1 / (1 + F.exp(-(F.col("predicted_log_rv") - F.ln("spike_threshold")))))


@query("j07_probability_metrics", tidy_sql("""SELECT (SELECT count(*) FROM pr) AS n, (SELECT avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) FROM pr a JOIN pr b ON a.is_spike AND NOT b.is_spike) AS auc,
(SELECT avg(tp::DOUBLE / al) FROM (SELECT is_spike, count(*) FILTER (WHERE is_spike) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS tp, count(*) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS al FROM pr) WHERE is_spike) AS average_precision,
(SELECT avg((p - CASE WHEN is_spike THEN 1 ELSE 0 END) ** 2) FROM pr) AS brier, (SELECT avg(p) FROM pr) AS mean_p, (SELECT avg(CASE WHEN is_spike THEN 1.0 ELSE 0 END) FROM pr) AS base_rate, (SELECT quantile_cont(p, 0.9) FROM pr) AS p90""", "auc average_precision brier mean_p base_rate p90", ctes=_P + _PROB))
def probability(s, d):
    return J.probability_metrics(_prob(s, d), [])


@query("j08_correction_metrics", tidy_sql("SELECT fold, avg(c) AS mean, stddev_pop(c) AS std, avg(abs(c)) AS mean_abs, max(abs(c)) AS max_abs, corr(c, g) AS gap_correlation FROM (SELECT a.fold, b.lp - a.lp AS c, a.ly - a.lp AS g FROM ann a JOIN ann b USING (fold, target_date) WHERE a.model = 'mean_22' AND b.model = 'mean_5') GROUP BY 1", "mean std mean_abs max_abs gap_correlation", ctes=_P))
def corrections(s, d):
    a = T.annotated(s, d)
    anchor = a.filter("model = 'mean_22'").select("fold", "target_date", F.col("predicted_log_rv").alias("anchor_log_rv"))
    x = a.filter("model = 'mean_5'").join(anchor, ["fold", "target_date"]).withColumn("correction", F.col("predicted_log_rv") - F.col("anchor_log_rv"))
    return J.correction_metrics(x, ["fold"])


@query("j09_common_support", tidy_sql("SELECT fold, model, target_date, predicted_rv FROM part WHERE (fold, target_date) IN (SELECT (fold, target_date) FROM part GROUP BY fold, target_date HAVING count(DISTINCT model) = 3)", "predicted_rv", "target_date", ctes=_P + ", part AS (SELECT * FROM pred WHERE NOT (model = 'mean_5' AND dayofweek(target_date) = 1) AND NOT (model = 'mean_22' AND day(target_date) = 3))"))
def support(s, d):
    p = T.predictions(s, d).filter(~((F.col("model") == "mean_5") & (F.dayofweek("target_date") == 2)) & ~((F.col("model") == "mean_22") & (F.dayofmonth("target_date") == 3)))
    return J.common_support(p).select("fold", "model", "target_date", "predicted_rv")


@query("j10_metric_table", tidy_sql("SELECT p.*, p.mean_qlike - a.mean_qlike AS mean_qlike_delta, p.rmse - a.rmse AS rmse_delta, rank() OVER (ORDER BY p.mean_qlike) AS rank FROM permodel p CROSS JOIN permodel a WHERE a.model = 'mean_22'", _MD + " mean_qlike_delta rmse_delta", ctes=_FOLD))
def table(s, d):
    return J.against_anchor(_fold_pool(s, d)[1], "mean_22", ["mean_qlike", "rmse"])


@query("j11_seed_summary", tidy_sql("SELECT model, count(DISTINCT fold) AS seeds, avg(mean_qlike) AS mean_qlike_mean, avg(rmse) AS rmse_mean, stddev_samp(mean_qlike) AS mean_qlike_std, stddev_samp(rmse) AS rmse_std FROM perfold GROUP BY 1", "mean_qlike_mean rmse_mean mean_qlike_std rmse_std", ctes=_FOLD))
def seeds(s, d):
    # the folds stand for seeds here
    return J.seed_summary(_fold_pool(s, d)[0].withColumnRenamed("fold", "seed"), ["mean_qlike", "rmse"])


@query("j12_fold_stability", tidy_sql("SELECT p.model, count(*) AS folds, count(*) FILTER (WHERE p.mean_qlike < a.mean_qlike) AS wins, avg(p.mean_qlike) AS fold_mean, stddev_samp(p.mean_qlike) AS fold_std FROM perfold p JOIN perfold a ON a.fold = p.fold AND a.model = 'mean_5' GROUP BY 1", "fold_mean fold_std", ctes=_FOLD))
def stability(s, d):
    return J.fold_stability(_fold_pool(s, d)[0], "mean_5")


@query("j13_screen", tidy_sql("SELECT p.model, wins, p.mean_qlike < a.mean_qlike - 1e-5 AS improved, p.normal_qlike <= a.normal_qlike * 1.01 AS guard_ok, wins >= 2 AND p.mean_qlike < a.mean_qlike - 1e-5 AND p.normal_qlike <= a.normal_qlike * 1.01 AS passed FROM permodel p JOIN (SELECT f.model, count(*) FILTER (WHERE f.mean_qlike < b.mean_qlike - 1e-5) AS wins FROM perfold f JOIN perfold b ON b.fold = f.fold AND b.model = 'random_walk' WHERE f.model <> 'random_walk' GROUP BY 1) USING (model) CROSS JOIN permodel a WHERE a.model = 'random_walk'", ctes=_FOLD))
def screen(s, d):
    f, p = _fold_pool(s, d)
    return J.screen(f, p, "random_walk", wins=2, normal_guard=1.01)


@query("j14_before_after", tidy_sql("SELECT b.fold, b.mean_qlike AS mean_qlike_before, a.mean_qlike AS mean_qlike_after, a.mean_qlike - b.mean_qlike AS mean_qlike_delta, 100 * (a.mean_qlike - b.mean_qlike) / abs(b.mean_qlike) AS mean_qlike_percent FROM perfold a JOIN perfold b USING (fold) WHERE b.model = 'random_walk' AND a.model = 'mean_22'", "mean_qlike_before mean_qlike_after mean_qlike_delta mean_qlike_percent", ctes=_FOLD))
def before_after(s, d):
    f, _ = _fold_pool(s, d)
    return J.before_after(f.filter("model = 'random_walk'"), f.filter("model = 'mean_22'"), ["fold"], ["mean_qlike"])


@query("j15_dimension_deltas", tidy_sql("SELECT p.fold AS model, CAST(CASE p.model WHEN 'random_walk' THEN 1 WHEN 'mean_5' THEN 5 ELSE 22 END AS BIGINT) AS dimension, p.mean_qlike - a.mean_qlike AS mean_qlike_delta FROM perfold p JOIN perfold a ON a.fold = p.fold AND a.model = 'mean_22'", "mean_qlike_delta", ctes=_FOLD))
def dimensions(s, d):
    f, _ = _fold_pool(s, d)
    x = f.withColumn("dimension", F.when(F.col("model") == "random_walk", 1).when(F.col("model") == "mean_5", 5).otherwise(22)).drop("model").withColumnRenamed("fold", "model")
    return J.dimension_deltas(x, 22, ["mean_qlike"])


@query("j16_worst_days", tidy_sql("SELECT model, fold, target_date, qlike, row_number() OVER (PARTITION BY model ORDER BY qlike DESC, fold, target_date) AS worst_rank FROM ann QUALIFY worst_rank <= 10", "qlike", "target_date", ctes=_P))
def worst(s, d):
    return J.worst_days(T.annotated(s, d)).select("model", "fold", "target_date", "qlike", "worst_rank")


@query("j17_influence", tidy_sql("SELECT a.model, n.d AS dropped, count(*) AS n, avg(qlike) AS mean_qlike FROM ann a CROSS JOIN range(0, 4) n(d) LEFT JOIN (SELECT fold, target_date, row_number() OVER (ORDER BY qlike DESC, fold, target_date) AS r FROM ann WHERE model = 'mean_22' AND is_spike) t ON t.fold = a.fold AND t.target_date = a.target_date AND t.r <= n.d WHERE t.r IS NULL GROUP BY 1, 2", "mean_qlike", ctes=_P))
def influence(s, d):
    return J.influence(T.annotated(s, d), "mean_22").withColumn("dropped", F.col("dropped").cast("long"))


@query("j18_support_differences", tidy_sql("SELECT count(*) FILTER (WHERE b.y IS NULL) AS only_a, count(*) FILTER (WHERE a.x IS NULL) AS only_b, max(abs(x - y)) AS max_difference FROM (SELECT fold, target_date, true_rv AS x FROM pred WHERE model = 'mean_5' AND day(target_date) <> 1) a FULL JOIN (SELECT fold, target_date, true_rv AS y FROM pred WHERE model = 'mean_22' AND day(target_date) <> 2) b USING (fold, target_date)", "max_difference", ctes=_P))
def differences(s, d):
    p = T.predictions(s, d)
    return J.support_differences(p.filter((F.col("model") == "mean_5") & (F.dayofmonth("target_date") != 1)), p.filter((F.col("model") == "mean_22") & (F.dayofmonth("target_date") != 2)))


@query("j20_non_finite", tidy_sql("SELECT count(*) FILTER (WHERE rv IS NULL) AS rv, count(*) FILTER (WHERE log_rv IS NULL) AS log_rv FROM days", ctes=T.long_days_sql()))
def non_finite(s, d):
    return J.non_finite(T.long_days(s, d), ["rv", "log_rv"])


_SEEDS = _P + ", seeded AS (SELECT p.*, k.seed, predicted_rv * (1 + k.seed / 100.0) AS prv FROM pred p CROSS JOIN range(0, 3) k(seed) WHERE NOT (model = 'mean_5' AND fold = 'fold_1999' AND k.seed = 2))"


def _seeded(s, d):
    p = T.predictions(s, d).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2))))
    p = p.filter(~((F.col("model") == "mean_5") & (F.col("fold") == "fold_1999") & (F.col("seed") == 2)))
    return p.withColumn("predicted_rv", F.col("predicted_rv") * (1 + F.col("seed") / 100.0))


@query("i14_seed_ensemble", tidy_sql("SELECT fold, model, target_date, avg(prv) AS predicted_rv FROM seeded WHERE model <> 'mean_5' GROUP BY 1, 2, 3", "predicted_rv", "target_date", ctes=_SEEDS))
def ensemble(s, d):
    return M.seed_ensemble(_seeded(s, d), 3, 3).select("fold", "model", "target_date", "predicted_rv")


@query("j19_completion", f"WITH {_P}, done AS (SELECT model, count(DISTINCT fold) AS k FROM pred WHERE NOT (model = 'mean_5' AND fold = 'fold_1999') GROUP BY 1) SELECT model, CASE WHEN k IS NULL THEN 'missing' WHEN k < 3 THEN 'ineligible_incomplete_folds' ELSE 'eligible' END AS status, 3 - coalesce(k, 0) AS missing FROM (VALUES ('random_walk'), ('mean_5'), ('mean_22'), ('none')) t(model) LEFT JOIN done USING (model)")
def completion(s, d):
    p = T.predictions(s, d).filter("not (model = 'mean_5' and fold = 'fold_1999')")
    every = s.createDataFrame([("random_walk",), ("mean_5",), ("mean_22",), ("none",)], "model string")
    return M.completion(p, every, ["fold_1998", "fold_1999", "fold_2000"]).select("model", "status", F.size("missing").alias("missing"))


_ROUTE = _P + _PROB + ", routed AS (SELECT a.fold, a.target_date, a.true_rv, CASE WHEN p >= 0.3 THEN b.predicted_rv ELSE a.predicted_rv END AS hard, exp((1 - p) * a.lp + p * b.lp) AS soft, (1 - p) * a.predicted_rv + p * b.predicted_rv AS mixed FROM ann a JOIN ann b USING (fold, target_date) JOIN pr USING (fold, target_date) WHERE a.model = 'mean_22' AND b.model = 'random_walk')"


def _two(s, d):
    a = T.annotated(s, d).select("fold", "model", "target_date", "true_rv", "predicted_rv")
    return a.filter("model = 'mean_22'").drop("model"), a.filter("model = 'random_walk'").drop("model"), _prob(s, d).select("fold", "target_date", "p")


@query("i09_routing", tidy_sql("SELECT fold, target_date, hard, soft, mixed FROM routed", "hard soft mixed", "target_date", ctes=_ROUTE))
def routing(s, d):
    a, b, p = _two(s, d)
    key = ["fold", "target_date"]
    pick = lambda df, name: df.select(*key, F.col("predicted_rv").alias(name))
    return pick(M.route(a, b, p, 0.3), "hard").join(pick(M.route(a, b, p, soft=True), "soft"), key).join(pick(M.tail_mixture(a, b, p), "mixed"), key)


_GRID = _P + _PROB + ", losses AS (SELECT a.fold, t, avg(CASE WHEN p >= t THEN b.qlike ELSE a.qlike END) AS loss, avg(a.qlike) AS base FROM ann a JOIN ann b USING (fold, target_date) JOIN pr USING (fold, target_date) CROSS JOIN (VALUES (0.2), (0.3), (0.4), (0.5)) g(t) WHERE a.model = 'mean_22' AND b.model = 'random_walk' GROUP BY 1, 2)"
_PICK = "list_reduce(list(struct_pack(v := {v}::DOUBLE, l := loss) ORDER BY {v}), lambda a, c: CASE WHEN c.l < a.l - 1e-5 OR abs(c.l - a.l) <= 1e-5 THEN c ELSE a END)"


@query("i10_gate_threshold", tidy_sql("SELECT fold, b.v AS threshold, b.l AS loss, base AS normal_loss, b.l < base - 1e-5 AS selected FROM (SELECT fold, max(base) AS base, " + _PICK.format(v="t") + " AS b FROM losses GROUP BY 1)", "threshold loss normal_loss", ctes=_GRID))
def threshold(s, d):
    a, b, p = _two(s, d)
    return M.select_threshold(a, b, p)


@query("i11_log_blend", tidy_sql("SELECT fold, b.v AS alpha, b.l AS loss FROM (SELECT fold, " + _PICK.format(v="x") + " AS b FROM (SELECT a.fold, x, avg(a.true_rv / exp((1 - x) * a.lp + x * b.lp) - 1 - (a.ly - ((1 - x) * a.lp + x * b.lp))) AS loss FROM ann a JOIN ann b USING (fold, target_date) CROSS JOIN (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) g(x) WHERE a.model = 'mean_22' AND b.model = 'random_walk' GROUP BY 1, 2) GROUP BY 1)", "alpha loss", ctes=_P))
def blend(s, d):
    a, b, _ = _two(s, d)
    return M.select_blend(a, b)


def _blocks(s, d):
    x = C.har_lags(T.long_days(s, d, False)).filter("lag_1 is not null and log_rv is not null")
    return C.assign_blocks(x, C.fold_table(s, T.FOLDS))


def _each_fold(rows, predict):
    """predict(core, validation, test) of every fold, with the fold."""
    parts = []
    for fold in T.FOLDS:
        of = rows.filter(F.col("fold") == fold[0])
        parts.append(predict(*(of.filter(F.col("block") == x) for x in ("core", "validation", "test"))))
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


_HAR = ["lag_1", "mean_5", "mean_22"]


@query("i02_har_ols")
def ols(s, d):
    return _each_fold(_blocks(s, d), lambda core, _, test: M.fit_ols(core, _HAR).predict(test).select("fold", "day", "rv", "predicted_rv"))


@query("i03_har_gamma")
def gamma(s, d):
    return _each_fold(_blocks(s, d), lambda core, _, test: M.fit_gamma(core, _HAR).predict(test).select("fold", "day", "rv", "predicted_rv"))


@query("i04_anchored_probe")
def probe(s, d):
    b = _blocks(s, d).withColumns({"anchor_log_rv": F.col("mean_22"), "x1": F.col("lag_1") - F.col("mean_22"), "x2": F.col("mean_5") - F.col("mean_22")})
    return _each_fold(b, lambda core, validation, test: M.fit_probe(core, validation, ["x1", "x2"]).predict(test).select("fold", "day", "rv", "predicted_rv", "correction"))


@query("i08_spike_gate")
def gate(s, d):
    b = _blocks(s, d)
    b = b.join(C.core_threshold(b, 0.9).select("fold", "threshold"), "fold").withColumn("is_spike", F.col("rv") > F.col("threshold"))
    return _each_fold(b, lambda core, _, test: M.gate_probability(M.fit_gate(core, _HAR), test, _HAR).select("fold", "day", "is_spike", "p"))


@query("i13_variance_filter")
def variance(s, d):
    x = T.long_days(s, d).filter("rv is not null").select("series_id", "day", (F.col("log_rv") * 10).alias("return_percent"))
    specs = s.createDataFrame([("garch", "garch", 0.0, 0.1, [0.1], 0.0, 0.8, 1.0), ("gjr", "gjr", 0.0, 0.1, [0.05], 0.1, 0.8, 1.0), ("egarch", "egarch", 0.0, 0.05, [0.1], -0.05, 0.9, 1.0), ("arch5", "arch", 0.0, 0.5, [0.2, 0.1, 0.1, 0.05, 0.05], 0.0, 0.0, 1.0)], "spec string, kind string, mu double, omega double, alpha array<double>, gamma double, beta double, start double")
    return M.variance_filter(x, specs, ["series_id"])


@query("m04_block_bootstrap")
def bootstrap(s, d):
    losses = T.annotated(s, d).select("model", "target_date", F.col("qlike").alias("loss"))
    return J.bootstrap_interval(J.block_bootstrap(losses, ["model"], 20, 200), ["model"])


@query("m05_confidence_set")
def confidence(s, d):
    return J.confidence_set(T.annotated(s, d))


@query("m05_loss_difference", tidy_sql("SELECT n, m AS mean_difference, sd AS long_run_std, m * sqrt(n) / nullif(sd, 0) AS t FROM (SELECT n, m, sqrt(greatest(0, g0 + 2 * (2 / 3.0 * g1 + 1 / 3.0 * g2)) / n) AS sd FROM (SELECT count(*) AS n, max(m) AS m, sum(c * c) AS g0, sum(c * l1) AS g1, sum(c * l2) AS g2 FROM (SELECT c, m, lag(c) OVER w AS l1, lag(c, 2) OVER w AS l2 FROM (SELECT fold, target_date, m, x - m AS c FROM (SELECT *, avg(x) OVER () AS m FROM (SELECT fold, target_date, a.qlike - b.qlike AS x FROM ann a JOIN ann b USING (fold, target_date) WHERE a.model = 'mean_5' AND b.model = 'mean_22'))) WINDOW w AS (PARTITION BY fold ORDER BY target_date))))", "mean_difference long_run_std t", ctes=_P))
def difference(s, d):
    return J.loss_difference(T.annotated(s, d), "mean_5", "mean_22", lags=2)
