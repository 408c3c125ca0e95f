"""Composite studies: each takes tables and gives a dict of result DataFrames.

Rows of a study (`study_rows`) hold one target day of one fold and block, with
what was known the day before. Folds, models and feature sets are short lists of
names, and all fits of a study take their passes over the core rows together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.lexicon import DEFAULT, Lexicon
from tidegauge.functions.losses import qlike
from tidegauge.operators import articles as A
from tidegauge.operators import bars as B
from tidegauge.operators import batched as L
from tidegauge.operators import calendar as C
from tidegauge.operators import daily as G
from tidegauge.operators import evaluate as J
from tidegauge.operators import features as H
from tidegauge.operators import models as M
from tidegauge.operators import review as R
from tidegauge.sources.staging import staged

HAR = ["lag_1", "mean_5", "mean_22"]
MARKET = [*HAR, "last_minus_5", "five_minus_22", "change_1", "std_5"]
MOOD = ["negative_ratio", "max_negative", "negative_std", "max_positive", "entropy"]
VOLUME = ["articles", "sources", "mean_relevance", "intensity", "log_sources", "log_negative"]
NEWS = [*MOOD, "dispersion", *VOLUME]
#: Named feature sets over the columns of study_rows.
FEATURE_SETS = {
    "market": MARKET,
    "mood": MOOD,
    "volume": VOLUME,
    "dispersion": ["dispersion", "surprise_norm"],
    "scalars": NEWS,
    "surprise": ["surprise_norm", "news_share"],
    "market_mood": [*MARKET, *MOOD],
    "all": [*MARKET, *NEWS, "surprise_norm"],
}
GATE = [*MARKET, *MOOD, "intensity", "surprise_norm"]
KEYS = ["series_id"]


def news_features(articles: DataFrame, start, end, balanced: bool = False) -> DataFrame:
    """Daily news of a series on the full calendar, with intensity, states, surprise norm and share of news days."""
    x = staged(G.intensity(G.on_spine(G.daily_news(articles, KEYS, balanced), KEYS, start, end), KEYS), "news")  # read by the states and again by their join
    x = H.surprise_norm(H.slow_state(x, KEYS, "semantic"))
    return H.news_share(x, KEYS)


def study_rows(days: DataFrame, news: DataFrame, folds: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Target days of each fold and block with market state and, from the day before, news columns scaled on core days."""
    columns = columns or [*NEWS, "surprise_norm", "news_share"]
    scalars = news.select(*KEYS, "day", "no_news", *columns)
    market = C.market_state(days).filter("valid and lag_1 is not null")
    rows = C.join_previous_day(market, scalars, KEYS).filter("no_news is not null")
    rows = staged(C.assign_blocks(rows, folds).withColumns({c: F.col(c).cast("double") for c in columns}), "rows")  # the scaler reads the core, and then every row is scaled
    return staged(H.scaled_scalars(rows, columns, rows.filter("block = 'core'"), ["fold"]), "study-rows")


def _block(rows: DataFrame, *blocks: str) -> DataFrame:
    return rows.filter(F.col("block").isin(*blocks))


def _frame(rows: DataFrame, model: str | None = None) -> DataFrame:
    """Forecasts of rows; model: a name, or none if rows have one."""
    keep = [c for c in ("anchor_log_rv", "correction") if c in rows.columns]
    return rows.select("fold", (F.lit(model) if model else F.col("model")).alias("model"), F.col("day").alias("target_date"), F.col("rv").alias("true_rv"), "predicted_rv", *keep)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def baselines(rows: DataFrame, block: str = "test") -> DataFrame:
    """Last value, least squares and Gamma forecasts of every fold.

    Least squares are of log RV; its forecast is exp times the mean of exp of the core residuals.
    """
    core, test = _block(rows, "core"), _block(rows, block)
    gamma = L.fit(core, [L.Spec("har_gamma", tuple(HAR))], "rv")
    ols = L.fit(core, [L.Spec("har_ols", tuple(HAR))], "log_rv", "gaussian")
    smear = ols.predict(core).groupBy("fold").agg(F.avg(F.exp(F.col("log_rv") - F.col("eta"))).alias("_s"))
    return _union(
        [
            _frame(M.random_walk(test), "random_walk"),
            _frame(ols.predict(test).join(F.broadcast(smear), "fold").withColumn("predicted_rv", F.exp("eta") * F.col("_s"))),  # a row a fold
            _frame(gamma.predict(test).withColumn("predicted_rv", F.exp("eta"))),
        ]
    )


def anchored(rows: DataFrame) -> DataFrame:
    """The rows with their fold's Gamma forecast as anchor."""
    fits = L.fit(_block(rows, "core"), [L.Spec("anchor", tuple(HAR))], "rv")
    return fits.predict(rows, eta="anchor_log_rv").drop("model", "lam")


@dataclass
class Probes:
    """Corrections of an anchor: parameters of every candidate, and (fold, model, lam, loss, base, selected) of the chosen."""

    fits: L.Fits
    chosen: DataFrame

    def predict(self, rows: DataFrame) -> DataFrame:
        """Forecasts of every model; the anchor itself where no correction was selected."""
        out = self.fits.predict(rows, self.chosen).join(F.broadcast(self.chosen.select("fold", "model", "selected")), ["fold", "model"])  # a row a fold and model
        out = out.withColumn("correction", F.when(F.col("selected"), F.col("eta")).otherwise(0.0)).drop("eta", "selected", "lam")
        return out.withColumn("predicted_rv", F.exp(F.col("anchor_log_rv") + F.col("correction")))


def fit_probes(rows: DataFrame, sets: dict[str, list[str]], lambdas=M.LAMBDAS, weight: str | None = None) -> Probes:
    """All feature sets, penalties and folds at once on the core; penalty and fallback are chosen on validation."""
    specs = [L.Spec(name, tuple(columns), lam) for name, columns in sets.items() for lam in lambdas]
    fits = L.fit(_block(rows, "core"), specs, F.col("rv") / F.exp("anchor_log_rv"), weight=weight)
    seen = fits.predict(_block(rows, "validation"), fits.table.filter("converged")).withColumns({"_p": F.exp(F.col("anchor_log_rv") + F.col("eta")), "_a": F.exp("anchor_log_rv")})
    losses = seen.groupBy("fold", "model", "lam").agg(F.avg(qlike("rv", "_p")).alias("loss"), F.avg(qlike("rv", "_a")).alias("base"))
    best = M.pick_in_order(losses, ["fold", "model"], "lam").join(losses.groupBy("fold", "model").agg(F.max("base").alias("base")), ["fold", "model"])
    return Probes(fits, staged(best.withColumn("selected", F.col("loss") < F.col("base") - M.MIN_GAIN), "chosen"))


def probes(rows: DataFrame, sets: dict[str, list[str]], lambdas=M.LAMBDAS, weight: str | None = None, block: str = "test") -> DataFrame:
    """The anchor and its corrections by each feature set, on every fold."""
    a = anchored(rows)
    test = _block(a, block)
    anchor = _frame(test.withColumns({"predicted_rv": F.exp("anchor_log_rv"), "correction": F.lit(0.0)}), "anchor")
    return _union([anchor, _frame(fit_probes(a, sets, lambdas, weight).predict(test))])


def thresholds(rows: DataFrame, q: float = 0.9) -> DataFrame:
    return C.core_threshold(rows, q).groupBy("fold").agg(F.max("threshold").alias("threshold"))


def report(predictions: DataFrame, cut: DataFrame, anchor: str, wins: int) -> dict[str, DataFrame]:
    """Fold and pooled metrics, worst days, deltas to the anchor and the screen."""
    a = J.annotate(predictions, cut)
    per_fold, pooled = J.metrics(a, ["fold", "model"]), J.pooled(a)
    return {"annotated": a, "per_fold": per_fold, "pooled": pooled, "worst": J.worst_days(a), "table": J.against_anchor(J.metrics(a, ["model"]), anchor, ["mean_qlike"]), "screen": J.screen(per_fold, J.metrics(a, ["model"]), anchor, wins, normal_guard=1.01)}


def main_study(bars: DataFrame, gaps: DataFrame, step: int) -> dict[str, DataFrame]:
    """Bars to valid days: filled bars, returns, days, reasons and quality audits."""
    filled = B.fill_verified_gaps(B.drop_duplicated(bars), gaps, step)
    returns = B.gap_aware_returns(filled, step)
    days = B.day_table(returns, step)
    return {"filled": filled, "returns": returns, "days": days, "reasons": B.reason_counts(days), "zero_volume": B.zero_volume_audit(filled, days), "gaps": B.gap_audit(filled, gaps)}


WEEKDAYS = [f"weekday_{i}" for i in range(1, 7)]
SIMPLE_NEWS = ["intensity", "negative_ratio", "max_negative", "no_news"]
#: Lambdas of the ridge baselines, in sum form.
RIDGE_LAMBDAS = tuple(10.0**k for k in range(-6, 5))


def extended_baselines(rows: DataFrame) -> dict[str, DataFrame]:
    """HAR with weekday dummies of the target day (Monday is the base), with four news scalars of the day before, and with both."""
    x = H.weekday_dummies(rows)
    specs = {"har": HAR, "har_weekday": [*HAR, *WEEKDAYS], "har_news": [*HAR, *SIMPLE_NEWS], "har_weekday_news": [*HAR, *WEEKDAYS, *SIMPLE_NEWS]}
    fits = L.fit(_block(x, "core"), [L.Spec(k, tuple(c)) for k, c in specs.items()], "rv")
    p = _frame(fits.predict(_block(x, "test")).withColumn("predicted_rv", F.exp("eta")))
    return report(p, thresholds(rows), "har", _most(rows))


def stress_study(rows: DataFrame, least: int = 60) -> dict[str, DataFrame]:
    """A diagnostic fold by itself: an error with fewer validation targets than least; never pooled with other folds."""
    if _block(rows, "validation").select("day").distinct().count() < least:
        raise ValueError("the stress fold has too few validation targets")
    out = report(baselines(rows), thresholds(rows), "har_gamma", 1)
    return {k: out[k] for k in ("annotated", "per_fold", "worst")}


def ridge_rows(days: DataFrame, news: DataFrame, folds: DataFrame, lags: int = 60, lookback: int = 30) -> DataFrame:
    """Target days of each fold with x_reduced and x_full, all known the day before.

    x_reduced: so many lags of log RV, slow and fast states of vectors and
    sentiment, scalars. x_full: the lags, and states and scalars of every one of
    the last lookback days. Scalars are imputed and scaled on core days; targets
    without all lags or all news days are left out.
    """
    state = lambda c, d: F.coalesce(c, F.array_repeat(F.lit(0.0), d))
    mood = H.slow_state(news.select(*KEYS, "day", "sentiment"), KEYS, "sentiment").select(*KEYS, "day", F.col("slow").alias("mood_slow"), F.col("fast").alias("mood_fast"))
    states = news.join(mood, [*KEYS, "day"])
    width = {c: states.agg(F.max(F.size(c))).first()[0] for c in ("slow", "fast", "mood_slow", "mood_fast")}
    scalars = [*NEWS[:11]]
    x = states.withColumns({c: F.col(c).cast("double") for c in scalars})
    served = C.assign_blocks(x.withColumns({"news_day": F.col("day"), "day": F.date_add("day", 1)}), folds)
    scaled = H.scaled_scalars(served, scalars, served.filter("block = 'core'"), ["fold"])
    vector = F.concat(*(state(c, d) for c, d in width.items()), F.array(*(F.coalesce(F.col(c), F.lit(0.0)) for c in scalars)))
    daily = staged(scaled.select("fold", *KEYS, F.col("news_day").alias("day"), vector.alias("v")).distinct(), "news-vectors")
    w = Window.partitionBy("fold", *KEYS).orderBy("day").rowsBetween(-(lookback - 1), 0)
    windows = daily.withColumn("_w", F.collect_list("v").over(w)).filter(F.size("_w") == lookback).select("fold", *KEYS, F.date_add("day", 1).alias("day"), F.col("v").alias("_last"), F.flatten("_w").alias("_w"))
    wl = Window.partitionBy(*KEYS).orderBy("day").rowsBetween(-lags, -1)
    lagged = days.withColumns({"_l": F.collect_list("log_rv").over(wl)}).filter("valid").filter(F.size("_l") > 0)
    y = C.assign_blocks(C.har_lags(days).filter("valid and lag_1 is not null").join(lagged.select(*KEYS, "day", "_l"), [*KEYS, "day"]), folds)
    y = y.filter(F.size("_l") == lags).join(windows, ["fold", *KEYS, "day"])
    return staged(y.select("fold", "block", *KEYS, "day", "rv", "log_rv", F.concat("_l", "_last").alias("x_reduced"), F.concat("_l", "_w").alias("x_full")), "ridge-rows")


def ridge_study(rows: DataFrame, cut: DataFrame, vectors: tuple[str, ...] = ("x_reduced", "x_full"), lambdas=RIDGE_LAMBDAS) -> dict[str, DataFrame]:
    """Ridge fits of RV on wide rows; the penalty is chosen on validation, ties to the larger."""
    out, picks = [], []
    for v in vectors:
        fits = L.fit_wide(_block(rows, "core"), v, "rv", lambdas)
        seen = fits.predict(_block(rows, "validation"), v).withColumn("_p", F.exp("eta"))
        chosen = staged(M.pick_in_order(seen.groupBy("fold", "lam").agg(F.avg(qlike("rv", "_p")).alias("loss")), ["fold"], "lam"), "ridge-chosen")
        picks.append(chosen.withColumns({"model": F.lit(v), "width": F.lit(fits.width)}))
        out.append(_frame(fits.predict(_block(rows, "test"), v, chosen).withColumn("predicted_rv", F.exp("eta")), v))
    a = J.annotate(_union(out), cut)
    return {"per_fold": J.metrics(a, ["fold", "model"]), "chosen": _union(picks), "annotated": a}


def _most(rows: DataFrame) -> int:
    """Wins that a screen asks for: all folds but one."""
    return max(1, rows.select("fold").distinct().count() - 1)


def forecast_study(rows: DataFrame) -> dict[str, DataFrame]:
    """Baselines on common support."""
    p = J.common_support(baselines(rows))
    return report(p, thresholds(rows), "har_gamma", _most(rows))


def anchor_diagnostic(rows: DataFrame, lambdas=M.LAMBDAS) -> dict[str, DataFrame]:
    """What text adds to an anchor: corrections of market and text sets."""
    p = probes(rows, {"market": MARKET, "market_mood": FEATURE_SETS["market_mood"]}, lambdas)
    out = report(p, thresholds(rows), "anchor", _most(rows))
    return out | {"corrections": J.correction_metrics(out["annotated"].filter("usable"), ["model"])}


def representation_audit(rows: DataFrame, sets: dict[str, list[str]] | None = None, lambdas=M.LAMBDAS) -> dict[str, DataFrame]:
    return report(probes(rows, sets or FEATURE_SETS, lambdas), thresholds(rows), "anchor", _most(rows))


def gates(rows: DataFrame, features: list[str], label: str, c: float = 0.1, least: int = 5) -> L.Fits:
    """Balanced logistic gates of every fold, with the penalty 1 / C; an error with fewer than `least` rows of a class."""
    sizes = rows.groupBy("fold").agg(F.count_if(F.col(label)).alias("_hot"), F.count_if(~F.col(label)).alias("_cold"))
    if sizes.filter(F.least("_hot", "_cold") < least).limit(1).count():
        raise ValueError("a class has too few rows")
    n = F.col("_hot") + F.col("_cold")
    weighted = rows.join(F.broadcast(sizes), "fold").withColumn("_w", n / (2 * F.when(F.col(label), F.col("_hot")).otherwise(F.col("_cold"))))  # a row a fold
    return L.fit(weighted, [L.Spec("gate", tuple(features))], F.col(label).cast("double"), "logistic", "_w", alpha=lambda _, n: 1 / (c * n), weighted_scale=False)


def _probability(fits: L.Fits, rows: DataFrame, *more: str) -> DataFrame:
    return fits.predict(rows).select("fold", F.col("day").alias("target_date"), (1 / (1 + F.exp(-F.col("eta")))).alias("p"), *more)


def gate_study(rows: DataFrame, lambdas=M.LAMBDAS) -> dict[str, DataFrame]:
    """A normal and a spike component, a gate on both, and five routes of every fold."""
    cut = thresholds(rows)
    a = staged(anchored(rows.join(cut, "fold").withColumn("is_spike", F.col("rv") > F.col("threshold"))), "gate-rows")
    gate, spike = gates(_block(a, "core"), GATE, "is_spike"), fit_probes(a, {"spike": GATE}, lambdas)

    def parts(block: str):
        x = _block(a, block)
        normal = _frame(x.withColumn("predicted_rv", F.exp("anchor_log_rv"))).drop("anchor_log_rv") if "model" in x.columns else _frame(x.withColumn("predicted_rv", F.exp("anchor_log_rv")), "anchor").drop("model", "anchor_log_rv")
        return normal, _frame(spike.predict(x)).select("fold", "target_date", "true_rv", "predicted_rv"), _probability(gate, x, "is_spike")

    chosen = staged(M.select_threshold(*parts("validation")), "threshold")
    normal, hot, p = parts("test")
    routed = normal.join(F.broadcast(chosen.select("fold", "threshold", "selected")), "fold")  # a row a fold
    routes = {
        "anchor": normal,
        "spike": hot,
        "hard_05": M.route(normal, hot, p, 0.5),
        "soft": M.route(normal, hot, p, soft=True),
        "selected": M.route(routed, hot, p, F.col("threshold"), selected=F.col("selected")),
    }
    out = _union([r.select("fold", F.lit(n).alias("model"), "target_date", "true_rv", "predicted_rv") for n, r in routes.items()])
    return report(out, cut, "anchor", _most(rows)) | {"gates": chosen.join(J.probability_metrics(p, ["fold"]), "fold")}


def refit_study(rows: DataFrame, columns: list[str], lambdas=M.LAMBDAS) -> dict[str, DataFrame]:
    """Probes selected on validation, then their coefficients fitted anew on core and validation: before and after.

    Penalty and decision stay as selected.
    """
    a = staged(anchored(rows), "refit-rows")
    test = _block(a, "test")
    selected = fit_probes(a, {"probe": columns}, lambdas)
    locked = [L.Spec("probe", tuple(columns), r["lam"], (r["fold"],)) for r in selected.chosen.collect()]  # a row a fold
    again = Probes(L.fit(_block(a, "core", "validation"), locked, F.col("rv") / F.exp("anchor_log_rv")), selected.chosen)
    m = [J.metrics(J.annotate(_frame(p.predict(test))), ["fold", "model"]) for p in (selected, again)]
    return {"before": m[0], "after": m[1], "comparison": J.before_after(*m, ["fold", "model"], ["mean_qlike", "rmse"])}


def tail_study(rows: DataFrame, summary: DataFrame | None = None, lambdas=M.LAMBDAS, least: int = 5) -> dict[str, DataFrame]:
    """Corrections and tail mixtures under three temporal weightings, and what was known before spike days.

    A mixture is (1 - p) * normal + p * tail: weighted Gamma fits of all core
    rows and of those above the 80th percentile, and the gate's probability.
    """
    cut = thresholds(rows, 0.8)
    a = staged(anchored(rows.join(cut, "fold").withColumn("is_tail", F.col("rv") > F.col("threshold"))), "tail-rows")
    core, test = _block(a, "core"), _block(a, "test")
    p = _probability(gates(core, GATE, "is_tail", least=least), test)
    relative = F.col("rv") / F.exp("anchor_log_rv")
    out = [_frame(test.withColumns({"predicted_rv": F.exp("anchor_log_rv"), "correction": F.lit(0.0)}), "anchor")]
    for kind in ("expanding", "rolling", "decay"):
        w = C.training_weights(core, kind, ["fold"])
        weighted = w.unionByName(_block(a, "validation", "test").withColumn("weight", F.lit(1.0)))
        out.append(_frame(fit_probes(weighted, {f"{kind}_market": MARKET, f"{kind}_mood": FEATURE_SETS["market_mood"]}, lambdas, "weight").predict(test)))
        both = []
        for part in (w, w.filter("is_tail")):
            fits = L.fit(part, [L.Spec("part", tuple(HAR), 1.0)], relative, weight="weight")
            both.append(_frame(fits.predict(test).drop("model").withColumn("predicted_rv", F.exp(F.col("anchor_log_rv") + F.col("eta"))), f"{kind}_mixture"))
        out.append(M.tail_mixture(both[0].drop("anchor_log_rv"), both[1], p))
    done = report(_union([x.drop("anchor_log_rv") for x in out]), cut, "anchor", _most(rows))
    if summary is not None:
        spikes = done["annotated"].filter("model = 'anchor' and is_spike").select("fold", F.col("target_date").alias("day"))
        info = H.spike_information(spikes, summary)
        done |= {"spike_information": info, "availability": info.groupBy("fold", "availability").agg(F.count("*").alias("n"))}
    return done


def slow_update_study(rows: DataFrame, lambdas=M.LAMBDAS) -> dict[str, DataFrame]:
    """A probe blended with its anchor by a weight chosen on validation, and influence of the worst spikes."""
    a = staged(anchored(rows), "slow-rows")
    fits = fit_probes(a, {"probe": FEATURE_SETS["surprise"]}, lambdas)

    def pair(block: str):
        x = _block(a, block)
        return _frame(x.withColumn("predicted_rv", F.exp("anchor_log_rv")), "anchor").drop("model", "anchor_log_rv"), _frame(fits.predict(x)).select("fold", "target_date", "true_rv", "predicted_rv")

    alpha = staged(M.select_blend(*pair("validation")), "blend")
    base, probe = pair("test")
    out = _union([x.select("fold", F.lit(n).alias("model"), "target_date", "true_rv", "predicted_rv") for n, x in (("anchor", base), ("probe", probe), ("blend", M.blend(base, probe, alpha)))])
    done = report(out, thresholds(rows), "anchor", _most(rows))
    return done | {"alphas": alpha, "influence": J.influence(done["annotated"], "anchor")}


def update_tokens(news: DataFrame, lookback: int = 30) -> DataFrame:
    """Token tables for a sequence model: changes of states and scalars over the last days, oldest first."""
    t = H.update_tokens(news, KEYS, ["slow"], ["intensity", "negative_ratio"])
    return C.lookback_arrays(t, ["slow_change", "intensity_change", "negative_ratio_change", "no_news"], lookback, "tokens")


def vector_study(rows: DataFrame, articles: DataFrame, core_end, families: list[str], lambdas=M.LAMBDAS) -> dict[str, DataFrame]:
    """Corrections from prototype scores of the families, known the day before.

    Prototypes are of articles up to core_end, the end of the first fold's core.
    """
    daily = G.weighted_mean(G.article_weights(articles, KEYS), [*KEYS, "day"], "semantic")
    protos = H.prototypes(articles.filter(F.col("day") <= F.lit(core_end).cast("date")))
    names = [f"proto_{f}" for f in families]
    wide = H.prototype_scores(daily, protos, KEYS).groupBy(*KEYS, "day").pivot("family", families).agg(F.first("score"))
    wide = wide.select(*KEYS, "day", *(F.col(f).alias(n) for f, n in zip(families, names, strict=True)))
    joined = C.join_previous_day(rows, wide, KEYS).fillna(0.0, names)
    return report(probes(joined, {"prototypes": names, "market_prototypes": [*MARKET, *names], "market": MARKET}, lambdas), thresholds(rows), "anchor", _most(rows))


def dimension_study(rows: DataFrame, news: DataFrame, fold: str, sizes: tuple[int, ...], lambdas=M.LAMBDAS) -> DataFrame:
    """Metrics of corrections by so many principal components of the daily centroid, less those of the first size."""
    own = rows.filter(F.col("fold") == fold)
    core_days = _block(own, "core").select(*KEYS, F.date_sub("day", 1).alias("day")).distinct()
    z, _ = H.project(news, news.join(core_days, [*KEYS, "day"], "left_semi"), max(sizes))
    names = [f"z{i}" for i in range(max(sizes))]  # components are nested: the first k of more are those of k
    flat = z.select(*KEYS, "day", *(F.col("z")[i].alias(n) for i, n in enumerate(names)))
    x = C.join_previous_day(own, flat, KEYS).fillna(0.0, names)
    m = J.metrics(J.annotate(probes(x, {str(k): names[:k] for k in sizes}, lambdas).filter("model <> 'anchor'")), ["model"])
    m = m.withColumn("dimension", F.col("model").cast("int")).withColumn("model", F.lit("components"))
    return J.dimension_deltas(m, sizes[0], ["mean_qlike", "rmse"])


def walk_forward(predictions: DataFrame, folds: list[str], seeds: int, anchor: str) -> dict[str, DataFrame]:
    """Seed ensembles of the complete models on common support: table, stability and completion."""
    whole = M.seed_ensemble(predictions, len(folds), seeds)
    a = J.annotate(J.common_support(whole.select("fold", "model", "target_date", "true_rv", "predicted_rv")))
    per_fold = J.metrics(a, ["fold", "model"])
    seeds_ = J.metrics(J.annotate(predictions.select("fold", "model", "seed", "target_date", "true_rv", "predicted_rv")), ["model", "seed"])
    expected = predictions.select("model").distinct()
    return {"table": J.against_anchor(J.metrics(a, ["model"]), anchor, ["mean_qlike"]), "stability": J.fold_stability(per_fold, anchor), "seeds": J.seed_summary(seeds_, ["mean_qlike"]), "completion": M.completion(predictions, expected, folds)}


def event_aware_study(articles: DataFrame, review: DataFrame, holdout: DataFrame, lexicon: Lexicon = DEFAULT, refined: bool = False) -> dict[str, DataFrame]:
    """A policy fitted on labels outside the holdout, its decisions, and both filters' metrics on the holdout."""
    policy = A.fit_policy(review, holdout, lexicon.context_families)
    decided = A.decided(articles, A.enabled_families(policy), lexicon, refined)
    old = articles.select("doc_id", F.col("keep").alias("rule_keep")) if "keep" in articles.columns else decided.select("doc_id", F.col("keep").alias("rule_keep"))
    rows = holdout.join(decided.select("doc_id", F.col("keep").alias("event_keep"), "reason"), "doc_id").join(old, "doc_id")
    rows = rows.withColumn("year", F.year("ts"))
    metrics = R.metrics_by_groups(rows, {"rule": F.col("rule_keep"), "event": F.col("event_keep")}, F.col("label") == "relevant", ["year", "evidence", "band"])
    return {"policy": policy, "reasons": A.reason_counts(decided), "holdout": metrics}


def review_export(articles: DataFrame, k: int = 100) -> dict[str, DataFrame]:
    """First examples of each decision, a stratified sample and the strata's sizes."""
    x = articles.withColumns({"decision": F.when(F.col("keep"), "retained").otherwise("removed"), "year": F.year("ts")})
    return {"examples": A.first_examples(x, k), "sample": R.stratified_sample(x, k), "population": R.population(x)}


def expanded_review(articles: DataFrame, old: DataFrame, target: int, fields: list[str]) -> DataFrame:
    """A quota sample near the target size, with weights, family hints and the labels of an older review.

    The articles are staged with the columns that they have, so that they are scored
    once for strata, quotas and sample; leave out texts that the review doesn't need.
    """
    x = articles.withColumns({"decision": F.when(F.col("keep"), "retained").otherwise("removed"), "year": F.year("ts")})
    x = staged(x, "review-articles")
    counts = staged(R.population(x), "review-strata")  # a row a stratum
    sample = R.carry_over(R.quota_sample(x, R.choose_quotas(counts, target), counts=counts), old, fields)
    return sample.orderBy("decision", "year", "evidence", "band", "sample_rank")
