"""Daily weighted vectors and sentiment.

Input: article vectors (keys, day, source, relevance, semantic ARRAY, sentiment
ARRAY of negative, neutral, positive). `keys` are what days are kept apart by, such
as series or representation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import vectors as V
from tidegauge.operators.articles import named_source

NEGATIVE, POSITIVE = 0, 2


def article_weights(articles: DataFrame, keys: list[str], balanced: bool = False) -> DataFrame:
    """articles with w: the relevance, or shares by which every source of a day counts alike."""
    if not balanced:
        return articles.withColumn("w", F.col("relevance").cast("double"))
    src = articles.withColumn("_s", named_source())
    sums = src.groupBy(*keys, "day", "_s").agg(F.sum("relevance").alias("_sum"))
    n = sums.groupBy(*keys, "day").agg(F.count("*").alias("_n"))
    return src.join(sums.join(n, [*keys, "day"]), [*keys, "day", "_s"]).withColumn("w", F.col("relevance") / F.col("_sum") / F.col("_n")).drop("_s", "_sum", "_n")


def weighted_mean(rows: DataFrame, keys: list[str], vector: str, weight: str = "w", to: str | None = None) -> DataFrame:
    """The weighted mean vector of each key.

    Elements are summed in long form, so partial sums are made before the
    shuffle and no group of vectors is gathered.
    """
    each = rows.select(*keys, F.col(weight).alias("_w"), F.posexplode(vector).alias("_p", "_x"))
    mean = each.groupBy(*keys, "_p").agg((F.sum(F.col("_w") * F.col("_x").cast("double")) / F.sum("_w")).alias("_m"))
    return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias(to or vector))


def daily_news(articles: DataFrame, keys: list[str], balanced: bool = False, strong: float = 0.70) -> DataFrame:
    """One row for each day with articles: centroid, sentiment, dispersion, entropy and counts."""
    k = [*keys, "day"]
    a = article_weights(articles, keys, balanced)
    centroid, mood = weighted_mean(a, k, "semantic"), weighted_mean(a, k, "sentiment")
    neg, pos = F.col("sentiment")[NEGATIVE].cast("double"), F.col("sentiment")[POSITIVE].cast("double")
    wsum = F.sum("w")
    mean_neg = F.sum(F.col("w") * neg) / wsum
    spread = F.sqrt(F.greatest(F.sum(F.col("w") * neg * neg) / wsum - mean_neg * mean_neg, F.lit(0.0))) if balanced else F.stddev_pop(neg)
    counts = a.groupBy(*k).agg(
        F.count("*").alias("articles"),
        F.count_distinct(named_source()).alias("sources"),
        F.avg("relevance").alias("mean_relevance"),
        (F.count_if(V.argmax("sentiment") == NEGATIVE) / F.count("*")).alias("negative_ratio"),
        F.count_if(neg > strong).alias("strong_negative"),
        F.max(neg).alias("max_negative"),
        spread.alias("negative_std"),
        F.max(pos).alias("max_positive"),
        (F.sum(F.col("w") * V.entropy("sentiment")) / wsum).alias("entropy"),
    )
    far = a.join(centroid.withColumnRenamed("semantic", "_c"), k).groupBy(*k).agg((F.sum(F.col("w") * (1 - V.cosine("semantic", "_c"))) / F.sum("w")).alias("dispersion"))
    return counts.join(centroid, k).join(mood, k).join(far, k)


def on_spine(daily: DataFrame, keys: list[str], start, end) -> DataFrame:
    """daily on every calendar day: counts 0, vectors null and no_news 1 on days without articles."""
    days = daily.select(*keys).distinct().withColumn("day", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY")))) if keys else daily.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY"))).alias("day"))
    out = days.join(daily, [*keys, "day"], "left").withColumn("no_news", F.when(F.col("articles").isNull(), 1).otherwise(0))
    return out.fillna(0, [c for c in ("articles", "sources", "strong_negative") if c in daily.columns])


def causal_median(keys: list[str], x, days: int = 365):
    """Median of the last `days` rows up to this one.

    While a series is shorter than that, the frame is all rows so far, so the
    expanding median of young series is the same expression.
    """
    return F.percentile(x, F.lit(0.5)).over(Window.partitionBy(*keys).orderBy("day").rowsBetween(-(days - 1), 0))


def intensity(spined: DataFrame, keys: list[str], days: int = 365) -> DataFrame:
    """spined with intensity (log1p count less its causal median), log_sources and log_negative."""
    x = spined.withColumn("_l", F.log1p("articles"))
    out = x.withColumn("intensity", F.col("_l") - causal_median(keys, F.col("_l"), days)).drop("_l")
    return out.withColumns({"log_sources": F.log1p(F.coalesce("sources", F.lit(0))), "log_negative": F.log1p(F.coalesce("strong_negative", F.lit(0)))})


def family_surprise(articles: DataFrame, spine: DataFrame, keys: list[str], days: int = 365) -> DataFrame:
    """(keys, family, day, articles, surprise, breadth) on the spine (keys, day) of every family."""
    each = articles.groupBy(*keys, "family", "day").agg(F.count("*").alias("articles"), F.count_distinct(named_source()).alias("sources"))
    families = articles.select(*keys, "family").distinct()
    grid = (families.join(spine.select(*keys, "day"), keys) if keys else families.crossJoin(F.broadcast(spine.select("day")))).join(each, [*keys, "family", "day"], "left").fillna(0, ["articles", "sources"])
    x = grid.withColumn("_l", F.log1p("articles"))
    return x.select(*keys, "family", "day", "articles", (F.col("_l") - causal_median([*keys, "family"], F.col("_l"), days)).alias("surprise"), F.log1p("sources").alias("breadth"))


def centroid_drift(vectors: DataFrame, keys: list[str], unit: str = "month", vector: str = "semantic") -> DataFrame:
    """Per period: the mean vector, and 1 - cosine to that of the previous period with data."""
    rows = vectors.withColumns({"period": F.trunc("day", unit), "_one": F.lit(1.0)})
    mean = weighted_mean(rows, [*keys, "period"], vector, "_one", "centroid")
    before = F.lag("centroid").over(Window.partitionBy(*keys).orderBy("period"))
    return mean.withColumn("_b", before).withColumn("drift", F.when(F.col("_b").isNotNull(), 1 - V.cosine("centroid", "_b"))).drop("_b")


