"""Features fitted on a fold's core block, and causal states."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import vectors as V
from tidegauge.operators.sizes import small

ALPHA = 2 / 31
#: Observations after which the closed form of a state starts anew, well before its powers overflow.
REBASE = 5000


def standardise(df: DataFrame, columns: list[str], fit: DataFrame, keys: list[str], floor: float = 1e-8, impute: bool = False) -> DataFrame:
    """df with columns at mean 0 and population deviation 1 over `fit` (the core rows), per key.

    With impute, nulls take the median of `fit` first, in both.
    """
    if impute:
        med = fit.groupBy(*keys).agg(*(F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in columns))
        fill = lambda d: d.join(med, keys).withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*(f"_m_{c}" for c in columns))
        df, fit = fill(df), fill(fit)
    s = fit.groupBy(*keys).agg(*(F.avg(c).alias(f"_a_{c}") for c in columns), *(F.greatest(F.stddev_pop(c), F.lit(floor)).alias(f"_s_{c}") for c in columns))
    out = df.join(s, keys)
    return out.withColumns({c: (F.col(c) - F.col(f"_a_{c}")) / F.col(f"_s_{c}") for c in columns}).drop(*(f"_{x}_{c}" for x in "as" for c in columns))


def scaled_scalars(daily: DataFrame, columns: list[str], core: DataFrame, keys: list[str]) -> DataFrame:
    """Scalars imputed and standardised on core days; 0 on days without news, after scaling."""
    out = standardise(daily, columns, core, keys, impute=True)
    return out.withColumns({c: F.when(F.col("no_news") == 1, 0.0).otherwise(F.col(c)) for c in columns})


def project(days: DataFrame, core: DataFrame, k: int, vector: str = "semantic", floor: float = 1e-8) -> tuple[DataFrame, object]:
    """(days with z, the model): standardised on core news days, then k principal components of them."""
    each = core.filter(F.col(vector).isNotNull()).select(F.posexplode(vector).alias("p", "x"))
    stats = each.groupBy("p").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("s"))
    row = stats.agg(F.array_sort(F.collect_list(F.struct("p", "m", "s"))).alias("st"))  # one element for each dimension
    z = lambda d: d.crossJoin(F.broadcast(row)).withColumn("_z", F.zip_with(vector, "st", lambda x, s: (x - s["m"]) / s["s"])).drop("st")
    train = z(core.filter(F.col(vector).isNotNull())).select(array_to_vector("_z").alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_o").fit(train)
    with_news = z(days.filter(F.col(vector).isNotNull())).withColumn("_v", array_to_vector("_z"))
    done = model.transform(with_news).withColumn("z", vector_to_array("_o"))
    return done.drop("_v", "_o"), model


def captured_ratio(projected: DataFrame, by: list[str]) -> DataFrame:
    """Share of the standardised vectors' squared length that the components keep."""
    return projected.groupBy(*by).agg((F.sum(V.dot("z", "z")) / F.sum(V.dot("_z", "_z"))).alias("captured"))


def slow_state(days: DataFrame, keys: list[str], vector: str, alpha: float = ALPHA, rebase: int = REBASE) -> DataFrame:
    """days with slow and fast: an exponential mean of the vectors so far, and what is new against it.

    The first vector starts the mean; days without one hold it and have fast 0;
    before the first both are 0. The recursion is written as a windowed sum with
    weights (1 - alpha)^(k - i), in blocks that carry over the last value of the
    block before.
    """
    w = Window.partitionBy(*keys).orderBy("day")
    dim = days.agg(F.max(F.size(vector))).first()[0] or 0
    long = days.select(*keys, "day", F.posexplode_outer(F.coalesce(vector, F.array_repeat(F.lit(None).cast("double"), dim))).alias("_p", "_x"))
    keys_p = [*keys, "_p"]
    wp = Window.partitionBy(*keys_p).orderBy("day")
    sofar = wp.rowsBetween(Window.unboundedPreceding, 0)
    x = long.withColumn("_k", F.count("_x").over(sofar))
    x = x.withColumn("_b", F.floor((F.greatest(F.col("_k"), F.lit(1)) - 1) / rebase)).withColumn("_j", F.col("_k") - F.col("_b") * rebase)
    decay = 1 - alpha
    first = F.when(F.col("_k") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    term = F.when(F.col("_x").isNotNull(), first * F.col("_x") * F.pow(F.lit(decay), -F.col("_j").cast("double")))
    wb = Window.partitionBy(*keys_p, "_b").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_part", F.pow(F.lit(decay), F.col("_j").cast("double")) * F.coalesce(F.sum(term).over(wb), F.lit(0.0)))
    # what a block ends with, carried into the next: a short table, one row for each block
    ends = x.groupBy(*keys_p, "_b").agg(F.max_by("_part", "day").alias("_e"), F.max("_j").alias("_n"))
    chain = F.aggregate(F.array_sort(F.collect_list(F.struct("_b", "_e", "_n")).over(Window.partitionBy(*keys_p).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))), F.lit(0.0), lambda a, s: a * F.pow(F.lit(decay), s["_n"].cast("double")) + s["_e"])
    x = x.join(ends.withColumn("_carry", chain).select(*keys_p, "_b", "_carry"), [*keys_p, "_b"])
    x = x.withColumn("_slow", F.when(F.col("_k") == 0, 0.0).otherwise(F.col("_part") + F.col("_carry") * F.pow(F.lit(decay), F.col("_j").cast("double"))))
    x = x.withColumn("_fast", F.when(F.col("_x").isNull(), 0.0).otherwise(F.col("_x") - F.col("_slow")))
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_p", c))), lambda s: s[c])
    states = x.groupBy(*keys, "day").agg(pick("_slow").alias("slow"), pick("_fast").alias("fast"))
    return days.join(states, [*keys, "day"])


def surprise_norm(days: DataFrame, vector: str = "fast", to: str = "surprise_norm") -> DataFrame:
    return days.withColumn(to, V.norm(vector))


def update_tokens(days: DataFrame, keys: list[str], vectors: list[str], scalars: list[str]) -> DataFrame:
    """Day-over-day changes of vectors and scalars; 0 on days without news and on the first day."""
    w = Window.partitionBy(*keys).orderBy("day")
    still = F.col("no_news") == 1
    out = {}
    for v in vectors:
        change = V.minus(v, F.coalesce(F.lag(v).over(w), F.col(v)))
        out[f"{v}_change"] = F.when(still, F.transform(v, lambda x: F.lit(0.0))).otherwise(change)
    for s in scalars:
        out[f"{s}_change"] = F.when(still, 0.0).otherwise(F.col(s) - F.coalesce(F.lag(s).over(w), F.col(s)))
    return days.withColumns(out)


def news_share(days: DataFrame, keys: list[str], n: int = 30) -> DataFrame:
    """days with the share of days with news among the last n."""
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(-(n - 1), 0)
    return days.withColumn("news_share", F.avg(1 - F.col("no_news")).over(w))


def prototypes(articles: DataFrame, vector: str = "semantic") -> DataFrame:
    """(family, prototype, members): the mean of unit vectors at length 1, from core articles."""
    from tidegauge.operators.daily import weighted_mean

    units = articles.withColumns({"_u": V.unit(vector), "_one": F.lit(1.0)})
    n = units.groupBy("family").agg(F.count("*").alias("members"))
    return weighted_mean(units, ["family"], "_u", "_one", "_m").join(n, "family").select("family", V.unit("_m").alias("prototype"), "members")


def prototype_scores(days: DataFrame, protos: DataFrame, keys: list[str], vector: str = "semantic") -> DataFrame:
    """(keys, day, family, score): dot of the unit centroid with each prototype; 0 on days without one."""
    return days.select(*keys, "day", vector).crossJoin(small(protos.select("family", "prototype"))).select(*keys, "day", "family", F.coalesce(V.dot(V.unit(vector), "prototype"), F.lit(0.0)).alias("score"))


def directional_margins(articles: DataFrame, core: DataFrame, keys: list[str], vector: str = "semantic") -> DataFrame:
    """(keys, day, family, margin): core-centred cosine to the own family's prototype less the strongest other's."""
    from tidegauge.operators.daily import weighted_mean

    mean = weighted_mean(core.withColumns({"_one": F.lit(1.0), "_k": F.lit(1)}), ["_k"], vector, "_one", "_mean").select("_mean")
    centred = lambda d: d.crossJoin(F.broadcast(mean)).withColumn(vector, V.unit(V.minus(vector, "_mean"))).drop("_mean")  # noqa: E731  one row
    protos = prototypes(centred(core), vector)
    table = protos.agg(F.collect_list(F.struct("family", "prototype")).alias("_ps"))  # a row for each family of the lexicon
    a = centred(articles).crossJoin(F.broadcast(table))
    cos = V.let(vector, lambda v: F.transform("_ps", lambda p: F.struct(p["family"].alias("f"), V.dot(v, p["prototype"]).alias("c"))))
    a = a.withColumn("_c", cos)
    own = F.filter("_c", lambda c: c["f"] == F.col("family"))
    other = F.filter("_c", lambda c: c["f"] != F.col("family"))
    a = a.withColumn("margin", F.try_element_at(F.transform(own, lambda c: c["c"]), F.lit(1)) - F.coalesce(F.array_max(F.transform(other, lambda c: c["c"])), F.lit(0.0)))
    return a.groupBy(*keys, "day", "family").agg(F.avg("margin").alias("margin"))


def winsorise(rows: DataFrame, core: DataFrame, columns: list[str], keys: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """rows with columns held between quantiles of the core rows."""
    q = core.groupBy(*keys).agg(*(F.percentile(c, F.lit(low)).alias(f"_l_{c}") for c in columns), *(F.percentile(c, F.lit(high)).alias(f"_h_{c}") for c in columns))
    return rows.join(q, keys).withColumns({c: F.greatest(F.col(f"_l_{c}"), F.least(F.col(c), F.col(f"_h_{c}"))) for c in columns}).drop(*(f"_{x}_{c}" for x in "lh" for c in columns))


def weekday_dummies(rows: DataFrame, day: str = "day") -> DataFrame:
    """rows with weekday_1 .. weekday_6; Monday is the base."""
    return rows.withColumns({f"weekday_{i}": (F.weekday(day) == i).cast("int") for i in range(1, 7)})


def spike_information(spikes: DataFrame, summary: DataFrame) -> DataFrame:
    """Spike days (fold, day) with the summaries of the day before and of the day, and the class of what was known."""
    pre = summary.select(F.date_add("day", 1).alias("day"), *(F.col(c).alias(f"prior_{c}") for c in summary.columns if c != "day"))
    post = summary.select("day", *(F.col(c).alias(f"same_{c}") for c in summary.columns if c != "day"))
    out = spikes.join(pre, "day", "left").join(post, "day", "left").fillna(0, ["prior_articles", "same_articles"])
    a, b = F.col("prior_articles") > 0, F.col("same_articles") > 0
    return out.withColumn("availability", F.when(a & b, "both").when(a, "prior_only").when(b, "contemporaneous_only_no_t_minus_1_news").otherwise("no_news"))
