"""Queries that run the composite studies over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import calendar as C
from tidegauge.operators import features as H
from tidegauge.plans import profiles as P
from tidegauge.plans import tables as T
from tidegauge.plans import texts
from tidegauge.plans.tables import tidy, tidy_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return keep


def _articles(s, d) -> DataFrame:
    """Article vectors spread over the orders' years."""
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("vec_id") * 7919 % 2400).cast("int"))
    return T.vectors(s, d).withColumns({"day": day, "series_id": F.lit("all"), "semantic": F.slice("semantic", 1, 8)})


@query("n01_market_study", tidy_sql("SELECT series_id, count(*) AS days, count(*) FILTER (WHERE valid) AS valid, sum(rv) AS total_rv FROM days GROUP BY 1", "total_rv", ctes=T.DAYS))
def market(s, d):
    b = T.bars(s, d)
    days = P.main_study(b, T.gaps(b), T.HOUR)["days"]
    return days.groupBy("series_id").agg(F.count("*").alias("days"), F.count_if("valid").alias("valid"), F.sum("rv").alias("total_rv"))


@query("n02_spike_diagnostic", tidy_sql("SELECT fold, model, count(*) AS n, avg(qlike) AS mean_qlike, avg(qlike) FILTER (WHERE is_spike) AS spike_qlike FROM ann GROUP BY 1, 2", "mean_qlike spike_qlike", ctes=T.PREDICTIONS))
def spikes(s, d):
    cut = P.thresholds(C.assign_blocks(T.long_days(s, d, False), C.fold_table(s, T.FOLDS)))
    return P.report(T.predictions(s, d), cut, "mean_22", 2)["per_fold"].select("fold", "model", "n", "mean_qlike", "spike_qlike")


@query("n12_walk_forward", tidy_sql("SELECT model, rank() OVER (ORDER BY mean_qlike) AS rank, n, mean_qlike, mean_qlike - (SELECT avg(q) FROM ens WHERE model = 'mean_22') AS mean_qlike_delta FROM (SELECT model, count(*) AS n, avg(q) AS mean_qlike FROM ens GROUP BY 1)", "mean_qlike mean_qlike_delta", ctes=T.PREDICTIONS + ", ens AS (SELECT model, true_rv / (predicted_rv * 1.01) - 1 - ln(true_rv / (predicted_rv * 1.01)) AS q FROM pred WHERE model <> 'mean_5')"))
def walk(s, d):
    p = T.predictions(s, d).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2))))
    p = p.filter(~((F.col("model") == "mean_5") & (F.col("seed") == 2) & (F.col("fold") == T.FOLDS[1][0]))).withColumn("predicted_rv", F.col("predicted_rv") * (1 + F.col("seed") / 100.0))
    return P.walk_forward(p, [f[0] for f in T.FOLDS], 3, "mean_22")["table"].select("model", "rank", "n", "mean_qlike", "mean_qlike_delta")


@query("n13_review_export", tidy_sql("SELECT decision, year, evidence, band, count(*) AS population_n FROM review GROUP BY ALL", ctes=texts.REVIEW))
def review(s, d):
    return P.review_export(texts._scored(s, d))["population"].withColumn("year", F.col("year").cast("long"))


@query("e04_expanded_review")
def expanded(s, d):
    x = texts._scored(s, d).drop("title", "body")
    old = T.read(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "relevant").otherwise("irrelevant").alias("label"))
    return P.expanded_review(x, old, 200, ["label"]).select("doc_id", "decision", "origin", "label", "sample_rank", "sampling_weight")


@query("n05_event_aware_study")
def events(s, d):
    x = texts._scored(s, d)
    lab = T.read(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "relevant").otherwise("irrelevant").alias("label"))
    r = x.join(lab, "doc_id").withColumns({"weight": F.lit(1.0), "sampling_weight": F.lit(1.0)})
    return P.event_aware_study(x, r, r.filter("doc_id % 4 = 0").drop("keep", "score"), texts.LEXICON, refined=True)["holdout"]


@query("h18_spike_information", tidy_sql("SELECT s.day, coalesce(p.n, 0) AS prior_articles, coalesce(c.n, 0) AS same_articles, CASE WHEN p.n > 0 AND c.n > 0 THEN 'both' WHEN p.n > 0 THEN 'prior_only' WHEN c.n > 0 THEN 'contemporaneous_only_no_t_minus_1_news' ELSE 'no_news' END AS availability FROM (SELECT day FROM days WHERE rv > (SELECT quantile_cont(rv, 0.9) FROM days)) s LEFT JOIN sm p ON p.day = s.day - 1 LEFT JOIN sm c ON c.day = s.day", days="day", ctes=T.long_days_sql(False) + ", sm AS (SELECT DATE '1995-01-01' + CAST(vec_id * 7919 % 2400 AS INTEGER) AS day, count(*) AS n FROM embeddings GROUP BY 1)"))
def information(s, d):
    x = T.long_days(s, d, False)
    cut = x.agg(F.percentile("rv", F.lit(0.9)).alias("cut"))
    summary = _articles(s, d).groupBy("day").agg(F.count("*").alias("articles"))
    return H.spike_information(x.crossJoin(cut).filter("rv > cut").select("day"), summary).select("day", "prior_articles", "same_articles", "availability")


# --- studies that fit: every feature set, penalty and fold in the same passes ------------------------


def _news(s, d) -> DataFrame:
    return P.news_features(_articles(s, d), "1995-01-01", "2001-07-31")


def _rows(s, d) -> DataFrame:
    return P.study_rows(T.long_days(s, d, False), _news(s, d), C.fold_table(s, T.FOLDS))


_SHOWN = ["fold", "model", "n", "mean_qlike", "normal_qlike", "spike_qlike", "rmse"]


@query("n01_forecast_study")
def forecast(s, d):
    return P.forecast_study(_rows(s, d))["per_fold"].select(*_SHOWN)


@query("n03_anchor_diagnostic")
def anchor(s, d):
    return P.anchor_diagnostic(_rows(s, d))["per_fold"].select(*_SHOWN)


@query("n04_representation_audit")
def representation(s, d):
    return P.representation_audit(_rows(s, d))["per_fold"].select(*_SHOWN)


@query("n06_gate_study")
def gate(s, d):
    return P.gate_study(_rows(s, d))["per_fold"].select(*_SHOWN)


@query("n07_refit_study")
def refit(s, d):
    return P.refit_study(_rows(s, d), P.FEATURE_SETS["market_mood"])["comparison"]


@query("n08_tail_study")
def tail(s, d):
    summary = _articles(s, d).groupBy("day").agg(F.count("*").alias("articles"))
    return P.tail_study(_rows(s, d), summary)["per_fold"].select(*_SHOWN)


@query("n09_vector_study")
def vector(s, d):
    families = sorted(r["family"] for r in T.vectors(s, d).select("family").distinct().collect())  # ten labels
    return P.vector_study(_rows(s, d), _articles(s, d), T.FOLDS[0][2], families)["per_fold"].select(*_SHOWN)


@query("n10_slow_update_study")
def slow(s, d):
    return P.slow_update_study(_rows(s, d))["per_fold"].select(*_SHOWN)


@query("n11_dimension_study")
def dimension(s, d):
    news = _news(s, d)
    rows = P.study_rows(T.long_days(s, d, False), news, C.fold_table(s, T.FOLDS))
    return P.dimension_study(rows, news, T.FOLDS[0][0], (2, 4))


@query("m02_extended_baselines")
def extended(s, d):
    """HAR alone, with weekdays, with news and with both."""
    return P.extended_baselines(_rows(s, d))["per_fold"].select(*_SHOWN)


#: A fold of its own: two years of core, half a year of validation and 180 days of test.
STRESS = [("stress", "1995-01-01", "1996-12-31", "1997-01-01", "1997-06-30", "1997-07-01", "1997-12-27")]


@query("m07_stress_fold")
def stress(s, d):
    days = C.market_state(T.long_days(s, d, False)).filter("valid and lag_1 is not null")
    return P.stress_study(C.assign_blocks(days, C.fold_table(s, STRESS)), 20)["per_fold"].select(*_SHOWN)


@query("m03_reduced_ridge")
def ridge(s, d):
    """The reduced ridge; 5 lags, as a tenth of the synthetic days has no value."""
    folds = C.fold_table(s, T.FOLDS)
    x = T.long_days(s, d, False)
    rows = P.ridge_rows(x, _news(s, d), folds, 5)
    return P.ridge_study(rows, P.thresholds(C.assign_blocks(x, folds)), ("x_reduced",), (1.0, 100.0, 10000.0))["per_fold"].select(*_SHOWN)
