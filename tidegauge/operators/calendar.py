"""Point-in-time samplers, folds and look-back windows over daily tables.

A row for day t uses nothing dated after t - 1: every frame ends one row, or one
day, before the row it belongs to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Walk-forward folds: fold, then the inclusive first and last days of core, validation and test.
BLOCKS = ("core", "validation", "test")


def fold_table(spark, folds: list[tuple]) -> DataFrame:
    """folds: (name, core start, core end, validation start, validation end, test start, test end)."""
    rows = [(f[0], b, f[1 + 2 * i], f[2 + 2 * i]) for f in folds for i, b in enumerate(BLOCKS)]
    return spark.createDataFrame(rows, "fold string, block string, start string, end string").select("fold", "block", F.to_date("start").alias("start"), F.to_date("end").alias("end"))


def day_number(day: str = "day") -> F.Column:
    return F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))


def sample_days(days: DataFrame, long: int = 22, short: int = 7, history: int = 30) -> DataFrame:
    """days (full calendar with valid) with eligible and removal_reason.

    A target needs itself valid, `history` calendar days before it, and its
    `short` and `long` days before it all there and valid. Reasons in this order.
    """
    w = Window.partitionBy("series_id").orderBy("day")

    def whole(n: int):
        frame = w.rowsBetween(-n, -1)
        return (F.count("*").over(frame) == n) & F.min("valid").over(frame)

    n = F.row_number().over(w) - 1
    reason = F.when(~F.col("valid"), "invalid_target").when(n < history, "calendar_history").when(~F.coalesce(whole(short), F.lit(False)), "short_window").when(~F.coalesce(whole(long), F.lit(False)), "long_window")
    return days.withColumn("removal_reason", reason).withColumn("eligible", F.col("removal_reason").isNull())


def sample_lag_days(days: DataFrame, lags: int = 22) -> DataFrame:
    """days with eligible: a valid target after `lags` days with finite log-RV."""
    w = Window.partitionBy("series_id").orderBy("day").rowsBetween(-lags, -1)
    known = F.coalesce(F.col("valid") & F.col("log_rv").isNotNull() & ~F.isnan("log_rv"), F.lit(False))
    return days.withColumn("eligible", known & (F.count(F.when(known, 1)).over(w) == lags))


def assign_blocks(days: DataFrame, folds: DataFrame) -> DataFrame:
    """days once for every fold and block that contains them; folds meet them by day, however many there are."""
    each = folds.filter("start <= end").withColumn("day", F.explode(F.sequence(F.col("start").cast("date"), F.col("end").cast("date"))))
    return days.join(each, "day").select(*days.columns, *(c for c in folds.columns if c not in ("start", "end")))


def block_counts(assigned: DataFrame) -> DataFrame:
    """Sample counts per fold, block and removal reason (kept: eligible)."""
    return assigned.groupBy("fold", "block", F.coalesce("removal_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def eligible_by_history(days: DataFrame, lookback: int = 30) -> DataFrame:
    """days with eligible: each of the previous `lookback` calendar days is in the table."""
    w = Window.partitionBy("series_id").orderBy(day_number()).rangeBetween(-lookback, -1)
    return days.withColumn("eligible", F.count("*").over(w) == lookback)


def lookback_arrays(days: DataFrame, columns: list[str], lookback: int, to: str = "window") -> DataFrame:
    """days with an array of the rows of the previous `lookback` days, oldest first, and its padding."""
    w = Window.partitionBy("series_id").orderBy("day").rowsBetween(-lookback, -1)
    rows = F.collect_list(F.struct("day", *columns)).over(w)
    return days.withColumn(to, rows).withColumn(f"{to}_padding", F.lit(lookback) - F.size(rows))


def lookback_long(days: DataFrame, columns: list[str], lookback: int) -> DataFrame:
    """(series_id, target, lag, columns): the window in long form, by an equi-join on the day it serves."""
    served = days.select("series_id", *columns, F.explode(F.sequence(F.lit(1), F.lit(lookback))).alias("lag"), "day")
    served = served.withColumn("target", F.date_add("day", F.col("lag"))).drop("day")
    return served.join(days.select("series_id", F.col("day").alias("target")), ["series_id", "target"])


def refit_folds(folds: DataFrame) -> DataFrame:
    """Folds whose core is core and validation together and whose validation is empty; an error where blocks overlap."""
    wide = folds.groupBy("fold").pivot("block", list(BLOCKS)).agg(F.first(F.struct("start", "end")))
    bad = (F.col("core.end") >= F.col("validation.start")) | (F.col("validation.end") >= F.col("test.start"))
    span = F.when(bad, F.raise_error(F.lit("blocks overlap")).cast("date")).otherwise(F.col("core.start"))
    core = wide.select("fold", F.lit("core").alias("block"), span.alias("start"), F.col("validation.end").alias("end"))
    return core.union(wide.select("fold", F.lit("test"), "test.start", "test.end"))


def core_threshold(assigned: DataFrame, q: float, column: str = "rv") -> DataFrame:
    """(fold, series_id, threshold): the exact quantile of core rows."""
    return assigned.filter("block = 'core'").groupBy("fold", "series_id").agg(F.percentile(column, F.lit(q)).alias("threshold"))


def target_scale(assigned: DataFrame, floor: float = 1e-8) -> DataFrame:
    """Mean and floored population deviation of log-RV and mean RV on core rows."""
    return assigned.filter("block = 'core'").groupBy("fold", "series_id").agg(F.avg("log_rv").alias("mean"), F.greatest(F.stddev_pop("log_rv"), F.lit(floor)).alias("scale"), F.avg("rv").alias("mean_rv"))


def har_lags(days: DataFrame, y: str = "log_rv") -> DataFrame:
    """days with the last value, the means of 5 and of 22 days before; null unless all 22 are known."""
    w = Window.partitionBy("series_id").orderBy("day")
    full = F.count(y).over(w.rowsBetween(-22, -1)) == 22
    mean = lambda n: F.when(full, F.avg(y).over(w.rowsBetween(-n, -1)))
    return days.withColumns({"lag_1": F.when(full, F.lag(y).over(w)), "mean_5": mean(5), "mean_22": mean(22)})


def market_state(days: DataFrame, y: str = "log_rv") -> DataFrame:
    """The seven market features of a gate, from days before only."""
    w = Window.partitionBy("series_id").orderBy("day")
    out = har_lags(days, y)
    return out.withColumns(
        {
            "last_minus_5": F.col("lag_1") - F.col("mean_5"),
            "five_minus_22": F.col("mean_5") - F.col("mean_22"),
            "change_1": F.when(F.col("lag_1").isNotNull(), F.lag(y).over(w) - F.lag(y, 2).over(w)),
            "std_5": F.when(F.col("lag_1").isNotNull(), F.stddev_pop(y).over(w.rowsBetween(-5, -1))),
        }
    )


def join_previous_day(targets: DataFrame, features: DataFrame, keys: list[str], on: str = "day", prefix: str = "") -> DataFrame:
    """targets with the features of the day before."""
    shifted = features.select(*keys, F.date_add(on, 1).alias(on), *(F.col(c).alias(f"{prefix}{c}") for c in features.columns if c not in (*keys, on)))
    return targets.join(shifted, [*keys, on], "left")


def training_weights(rows: DataFrame, kind: str, keys: list[str], day: str = "day", window: int = 730, half_life: int = 365) -> DataFrame:
    """rows with weight: expanding (1), rolling (the last `window` days only) or decay (halved each half_life, mean 1)."""
    if kind == "expanding":
        return rows.withColumn("weight", F.lit(1.0))
    last = rows.groupBy(*keys).agg(F.max(day).alias("_last"))
    age = F.datediff("_last", day)
    aged = rows.join(last, keys)
    if kind == "rolling":
        return aged.filter(age < window).withColumn("weight", F.lit(1.0)).drop("_last")
    raw = aged.withColumn("_w", F.pow(F.lit(0.5), age / half_life)).drop("_last")
    mean = raw.groupBy(*keys).agg(F.avg("_w").alias("_m"))
    return raw.join(mean, keys).withColumn("weight", F.col("_w") / F.col("_m")).drop("_w", "_m")
