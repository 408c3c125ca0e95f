from datetime import date

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import articles as A
from tidegauge.operators import daily as G
from tidegauge.operators import embed as E
from tidegauge.operators import review as R


def test_weighted_confusion(spark):
    df = spark.createDataFrame([("retained", "relevant", 5.0), ("retained", "relevant", 1.5), ("retained", "irrelevant", 0.5), ("removed", "relevant", 3.5), ("removed", "irrelevant", 7.5)], "decision string, label string, sampling_weight double")
    c = R.confusion(df, F.col("decision") == "retained", F.col("label") == "relevant").first()
    assert (c["precision"], c["recall"], c["specificity"]) == pytest.approx((6.5 / 7, 6.5 / 10, 7.5 / 8))


def test_quotas(spark):
    """Cells of unequal size: what a small one lacks, larger ones of its decision give."""
    cells = [("retained", 6), ("retained", 500), ("removed", 300), ("removed", 9), ("removed", 400)]
    q = R.choose_quotas(spark.createDataFrame(cells, "decision string, population_n long"), 60).first()
    taken = {d: sum(min(n, q[f"{d}_quota"]) for k, n in cells if k == d) for d in ("retained", "removed")}
    assert q["total"] == sum(taken.values()) == 60
    # 29 + 31 and 31 + 29 meet the target alike; the former has the smaller quotas
    assert (taken["retained"], taken["removed"], q["retained_quota"], q["removed_quota"]) == (29, 31, 23, 11)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quotas_read_the_strata_once(spark):
    cells = spark.createDataFrame([("retained", 6), ("removed", 9)], "decision string, n long").groupBy("decision").agg(F.sum("n").alias("population_n"))
    q = R.choose_quotas(cells, 60)
    assert plan(q).count("LogicalRDD") == 1
    assert R.choose_quotas(cells.filter("decision = 'removed'"), 5).first().asDict() == {"retained_quota": 4, "removed_quota": 5, "total": 5}


def test_scores_are_made_once(spark):
    """A filter on what the rules decide repeats none of them."""
    df = spark.createDataFrame([(1, "Bitcoin", "bitcoin <b>here</b>. Related stories x"), (2, "Ports", None)], "doc_id long, title string, body string").withColumn("ts", F.current_timestamp())
    kept = A.scored(df, entities=False).filter("keep")
    assert plan(kept).count("<[^>]+>") == 1
    r = kept.first()
    assert (r["doc_id"], r["body"], r["score"], r["evidence"], kept.count()) == (1, "bitcoin here .", 5, "title_primary", 1)


def test_quota_sample(spark):
    """The quota's rows of each stratum; those of small strata weigh 1."""
    rows = [(i, "retained" if i % 3 else "removed", 2024, "e", "b") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, decision string, year int, evidence string, band string")
    q = spark.createDataFrame([(4, 15, 14)], "retained_quota long, removed_quota long, total long")
    sample = R.quota_sample(df, q)
    assert plan(sample).count("LogicalRDD") == 2  # the sample and its population
    got = sample.groupBy("decision").agg(F.count("*"), F.min("sampling_weight"), F.max("sampling_weight"), F.max("sample_rank")).collect()
    assert sorted(map(tuple, got)) == [("removed", 10, 1.0, 1.0, 10), ("retained", 4, 5.0, 5.0, 4)]


def test_policy(spark):
    """Shares are weighted, and the holdout takes no part."""
    rows = [("k1", "security_hack", "relevant", 4.0), ("k2", "security_hack", "irrelevant", 3.0), ("k3", "macro_liquidity", "relevant", 1.0), ("k4", "macro_liquidity", "irrelevant", 2.0), ("k5", "macro_liquidity", "relevant", 9.0), ("k6", "regulation_etf", "relevant", 1.0)]
    review = spark.createDataFrame(rows, "doc_id string, family string, label string, weight double")
    p = A.fit_policy(review, review.filter("doc_id = 'k5'"), least=2)
    got = {r["family"]: (r["sample_n"], r["enabled"]) for r in p.collect()}
    assert got["security_hack"] == (2, True) and got["macro_liquidity"] == (2, False) and got["regulation_etf"] == (1, False)


def articles(spark):
    rows = [("A", 1.0, [0.1, 0.6, 0.3]), ("A", 5.0, [0.3, 0.5, 0.2]), ("A", 3.0, [0.2, 0.2, 0.6]), ("B", 7.0, [0.05, 0.9, 0.05])]
    return spark.createDataFrame([("s", date(2024, 1, 1), src, 1, [x, 1.0], m) for src, x, m in rows], "series_id string, day date, source string, relevance int, semantic array<double>, sentiment array<double>")


@pytest.mark.parametrize(("balanced", "want"), [(False, 4.0), (True, 5.0)])
def test_centroids(spark, balanced, want):
    r = G.daily_news(articles(spark), ["series_id"], balanced).first()
    assert r["semantic"][0] == pytest.approx(want) and r["articles"] == 4 and r["sources"] == 2
    assert r["negative_ratio"] == pytest.approx(3 / 4 if G.NEGATIVE == 1 else 0) and r["strong_negative"] == (1 if G.NEGATIVE == 1 else 0)


def test_no_news_days(spark):
    d = G.on_spine(G.daily_news(articles(spark), ["series_id"]), ["series_id"], "2024-01-01", "2024-01-02").orderBy("day").collect()
    assert [x["no_news"] for x in d] == [0, 1] and d[1]["semantic"] is None and d[1]["articles"] == 0


def test_cache_hits_are_not_encoded(spark):
    docs = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "a")], "doc_id string, text string")
    asked = E.requests(docs, "m", "r", F.col("text"))
    empty = spark.createDataFrame([], "content_hash string, model string, representation string, dimension int, vector array<float>")
    out, new = E.embed(asked, empty, E.hash_encoder(4), 4)
    assert out.filter("vector is not null").count() == 3 and new.count() == 2

    def never(texts):
        raise AssertionError("encoded a hit")

    again, none = E.embed(asked, spark.createDataFrame(new.collect(), new.schema), never, 4)
    assert again.filter("vector is not null").count() == 3 and none.count() == 0
    assert E.cache_statistics(asked, new).first().asDict() == {"texts": 2, "hits": 2, "misses": 0}
