"""Training tables of sequence models and gates: vectors of named elements, scaled on core days.

Input days hold, for every key (such as a fold) and calendar day, the slow and
fast states of some vectors, scalars and a no_news mark. A layout fixes which
elements a row has and in which order; a row that lacks one, or has a null or
non-finite one, is an error and never a shifted vector.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import vectors as V
from tidegauge.operators.daily import causal_median
from tidegauge.operators.features import slow_state, standardise

#: What a day of news says beside its vectors, in this order; the last is the mark of days without any.
SCALARS = ("intensity", "log_sources", "negative_ratio", "log_negative", "max_negative", "negative_std", "max_positive", "entropy", "dispersion", "mean_relevance", "no_news")
#: Of these, what a day without news does not have.
UNDEFINED = ("negative_ratio", "max_negative", "negative_std", "max_positive", "entropy", "dispersion", "mean_relevance")
MARKET = ("lag_1", "mean_5", "mean_22", "last_minus_5", "five_minus_22", "change_1", "std_5")
STATES = ("slow", "fast", "no_slow")
#: Days with news that a core block needs for its changes to be scaled.
LEAST_UPDATES = 30


@dataclass(frozen=True)
class Layout:
    """The vectors with their sizes, scalars and further columns of a row, in order."""

    vectors: dict[str, int] = field(default_factory=lambda: {"semantic": 64, "sentiment": 3})
    scalars: tuple[str, ...] = SCALARS
    others: tuple[str, ...] = ()

    def names(self, kind: str | None) -> list[str]:
        """Names of the elements; kind says which state or change of the vectors leads, None that none does."""
        led = [f"{v}_{kind}_{i:02d}" for v, n in self.vectors.items() for i in range(1, n + 1)] if kind else []
        return [*led, *self.scalars, *self.others]


def row(parts: list[Column | str], size: int) -> Column:
    """One array of all parts, arrays and numbers; an error unless it has `size` finite elements."""
    as_array = [F.transform(p, lambda x: x.cast("double")) if isinstance(p, Column) else F.array(F.col(p).cast("double")) for p in parts]
    return V.checked(F.concat(*as_array), size)


def states(days: DataFrame, keys: list[str], layout: Layout) -> DataFrame:
    """days with `<vector>_slow` and `<vector>_fast` for every vector of the layout."""
    for v in layout.vectors:
        days = slow_state(days, keys, v).withColumnsRenamed({"slow": f"{v}_slow", "fast": f"{v}_fast"})
    return days


def news_scalars(spined: DataFrame, folds: Column, window: int = 365) -> DataFrame:
    """spined for every fold of an array of (fold, start, end), with its scalars scaled on that core block.

    Scalars other than the mark are imputed with core medians and standardised;
    those that days without news do not have are 0 there, counts keep their value.
    """
    x = spined.withColumn("_l", F.log1p("articles")).withColumn("intensity", F.col("_l") - causal_median([], F.col("_l"), window)).drop("_l")
    x = x.withColumns({"log_sources": F.log1p("sources"), "log_negative": F.log1p("strong_negative"), "_f": F.explode(folds)})
    x = x.withColumns({"fold": F.col("_f.fold"), "core": F.col("day").between(F.col("_f.start"), F.col("_f.end"))}).drop("_f")
    scaled = standardise(x, list(SCALARS[:-1]), x.filter("core"), ["fold"], impute=True)
    return scaled.withColumns({c: F.when(F.col("no_news") == 1, 0.0).otherwise(F.col(c)) for c in UNDEFINED})


def scaler(rows: DataFrame, keys: list[str], column: str = "token") -> DataFrame:
    """(keys, n, mean, scale) of the elements of rows: the population deviation, 1 where an element is constant."""
    s = rows.groupBy(*keys).agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(column)).alias("_s"))
    n = F.col("_s.count").cast("double")
    deviation = F.transform(vector_to_array("_s.variance"), lambda v: F.sqrt(v * F.greatest(n - 1, F.lit(0.0)) / n))
    mean = vector_to_array("_s.mean")
    scale = F.zip_with(deviation, mean, lambda d, m: F.when(d > 1e-12 * F.greatest(F.abs(m), F.lit(1.0)), d).otherwise(1.0))
    return s.select(*keys, F.col("_s.count").alias("n"), mean.alias("mean"), scale.alias("scale"))


def scale(rows: DataFrame, fitted: DataFrame, keys: list[str], column: str = "token") -> DataFrame:
    """rows with their elements scaled; a key that no scaler was fitted for is an error."""
    mean = F.coalesce("mean", F.raise_error(F.lit("a key has no scaler")).cast("array<double>"))
    z = F.zip_with(F.zip_with(column, mean, lambda x, m: x - m), "scale", lambda x, s: x / s)
    return rows.join(fitted, keys, "left").withColumn(column, z).drop("n", "mean", "scale")


def token_matrix(days: DataFrame, keys: list[str], state: str, layout: Layout = Layout()) -> tuple[DataFrame, list[str]]:
    """((keys, day, token) scaled on core days, names of its elements) of the slow, fast or no_slow table."""
    if state not in STATES:
        raise ValueError(f"state must be one of {', '.join(STATES)}")
    led = [] if state == "no_slow" else [F.col(f"{v}_{state}") for v in layout.vectors]
    names = layout.names(None if state == "no_slow" else state)
    raw = days.withColumn("token", row([*led, *layout.scalars, *layout.others], len(names)))
    done = scale(raw, scaler(raw.filter("core"), keys), keys)
    return done.select(*keys, "day", "token"), names


def update_matrix(days: DataFrame, keys: list[str], layout: Layout = Layout(), least: int = LEAST_UPDATES) -> tuple[DataFrame, list[str], list[str]]:
    """((keys, day, available, update, level), names of updates, names of levels).

    An update holds the slow vectors' changes since the day before, scalars and
    further columns; it is scaled on core days with news, an error for a key with
    fewer than `least`, and 0 on days without news. A level holds the slow vectors
    and scalars, scaled on all core days.
    """
    w = Window.partitionBy(*keys).orderBy("day")
    slow = [F.col(f"{v}_slow") for v in layout.vectors]
    change = [V.minus(f"{v}_slow", F.coalesce(F.lag(f"{v}_slow").over(w), F.col(f"{v}_slow"))) for v in layout.vectors]
    bare = Layout(layout.vectors, layout.scalars)
    names, levels = layout.names("change"), bare.names("slow")
    x = days.withColumn("available", F.col("no_news") == 0).withColumns({"update": row([*change, *layout.scalars, *layout.others], len(names)), "level": row([*slow, *layout.scalars], len(levels))})
    fitted = scaler(x.filter("core and available"), keys, "update")
    # a core block without any news has no scaler, so the check starts from all core days
    known = x.groupBy(*keys).agg(F.count_if(F.col("core") & F.col("available")).alias("_n")).join(fitted, keys, "left")
    enough = F.when(F.col("_n") >= least, F.col("mean")).otherwise(F.raise_error(F.lit(f"a core block has fewer than {least} days with news")).cast("array<double>"))
    done = scale(x, known.withColumn("mean", enough).drop("_n"), keys, "update")
    done = done.withColumn("update", F.when(F.col("available"), F.col("update")).otherwise(F.transform("update", lambda _: F.lit(0.0))))
    done = scale(done, scaler(x.filter("core"), keys, "level"), keys, "level")
    return done.select(*keys, "day", "available", "update", "level"), names, levels


def sequences(targets: DataFrame, tokens: DataFrame, keys: list[str], lookback: int, column: str = "token") -> DataFrame:
    """targets (keys, day) with the tokens of the `lookback` days before, oldest first; an error where one is missing.

    Every token is dealt to the days it serves and gathered there, so that no task
    holds more than the sequences of its own targets.
    """
    served = tokens.select(*keys, F.col("day").alias("_day"), column, F.explode(F.transform(F.sequence(F.lit(1), F.lit(lookback)), lambda n: F.date_add("day", n))).alias("day"))
    each = targets.select(*keys, "day").distinct().join(served, [*keys, "day"], "left")
    some = F.array_sort(F.collect_list(F.when(F.col("_day").isNotNull(), F.struct("_day", column))))
    whole = each.groupBy(*keys, "day").agg(some.alias("_s")).withColumn("sequence", F.when(F.size("_s") == lookback, F.transform("_s", lambda s: s[column])).otherwise(F.raise_error(F.lit("a day of the lookback has no token")).cast("array<array<double>>")))
    return targets.join(whole.drop("_s"), [*keys, "day"])


def gate_matrix(targets: DataFrame, news: DataFrame, keys: list[str], norms: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(targets with gate and news_day, names): seven market columns known before the day, then scalars and norms of the day before.

    keys are those of news that targets have too. A target without news features of
    the day before, or without a finite value in any column, is an error.
    """
    names = [*MARKET, *(f"news_{c}" for c in SCALARS), *(f"news_{c}" for c in norms)]
    before = news.select(*keys, F.date_add("day", 1).alias("day"), F.col("day").alias("news_day"), *(F.col(c).alias(f"news_{c}") for c in (*SCALARS, *norms)))
    joined = targets.join(before, [*keys, "day"], "left")
    return joined.withColumn("gate", row(list(names), len(names))).drop(*(n for n in names if n.startswith("news_"))), names
