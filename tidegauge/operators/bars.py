"""Bars: repair of verified gaps, gap-aware returns, day validity, realized measures.

Every window is partitioned by series; one row is one bar. `step` is the bar's
length in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.losses import finite

EPS = 1e-12


def _seconds(c: str | Column) -> Column:
    return F.unix_micros(c) / F.lit(1_000_000.0)


def drop_duplicated(bars: DataFrame) -> DataFrame:
    """Bars without every copy of a (series_id, ts) that occurs twice or more."""
    n = F.count("*").over(Window.partitionBy("series_id", "ts"))
    return bars.withColumn("_n", n).filter("_n = 1").drop("_n")


def duplicate_counts(bars: DataFrame) -> DataFrame:
    """Per series: copies beyond the first, and rows that drop_duplicated leaves out."""
    each = bars.groupBy("series_id", "ts").agg(F.count("*").alias("n"))
    return each.groupBy("series_id").agg(F.sum(F.col("n") - 1).alias("extra_copies"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("dropped_rows"))


def fill_verified_gaps(bars: DataFrame, gaps: DataFrame, step: int) -> DataFrame:
    """Bars with no-trade bars inside the listed gaps (series_id, start, end; both inclusive), flagged synthetic.

    Prices are the close of the bar one step before the gap, volumes 0. Only
    bars that are missing and within the series' range are inserted. An error
    if a gap that lacks bars has no positive close before it.
    """
    span = bars.groupBy("series_id").agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    clipped = gaps.join(span, "series_id").filter((F.col("end") >= F.col("_lo")) & (F.col("start") <= F.col("_hi")))
    each = clipped.select("series_id", "start", F.explode(F.sequence(F.greatest("start", "_lo"), F.least("end", "_hi"), F.expr(f"INTERVAL {step} SECONDS"))).alias("ts"))
    absent = each.join(bars.select("series_id", "ts"), ["series_id", "ts"], "left_anti")
    before = bars.select("series_id", (F.col("ts") + F.expr(f"INTERVAL {step} SECONDS")).alias("start"), F.col("close").alias("_close"))
    priced = absent.join(before, ["series_id", "start"], "left").withColumn("_close", F.when(F.col("_close") > 0, F.col("_close")).otherwise(F.raise_error(F.lit("a verified gap has no positive close before it")).cast("double")))
    zero = [c for c in bars.columns if c not in ("series_id", "ts", "open", "high", "low", "close")]
    new = priced.select("series_id", "ts", *(F.col("_close").alias(c) for c in ("open", "high", "low", "close") if c in bars.columns), *(F.lit(0).cast(dict(bars.dtypes)[c]).alias(c) for c in zero))
    return bars.withColumn("synthetic", F.lit(False)).unionByName(new.withColumn("synthetic", F.lit(True)))


def gap_audit(filled: DataFrame, gaps: DataFrame) -> DataFrame:
    """Inserted bars of each gap."""
    inside = filled.filter("synthetic").join(gaps, "series_id").filter(F.col("ts").between(F.col("start"), F.col("end")))
    return gaps.join(inside.groupBy("series_id", "start").agg(F.count("*").alias("inserted")), ["series_id", "start"], "left").fillna(0, ["inserted"])


def gap_aware_returns(bars: DataFrame, step: int) -> DataFrame:
    """Bars with day and r: the log return, null unless there is a bar exactly one step earlier.

    The step is fixed, so each bar meets the one before it by an equality of
    times, and one long series is dealt over all tasks. A (series_id, ts) occurs
    once, as after drop_duplicated.
    """
    before = bars.select("series_id", (F.col("ts") + F.expr(f"INTERVAL {step} SECONDS")).alias("ts"), F.col("close").alias("_before"))
    good = (F.col("close") > 0) & (F.col("_before") > 0)
    out = bars.join(before, ["series_id", "ts"], "left").withColumn("r", F.when(good, F.ln("close") - F.ln("_before")))
    return out.select(*bars.columns, "r", F.to_date("ts").alias("day"))


def channels(bars: DataFrame) -> DataFrame:
    """Seven channels of a bar with a return."""
    ratio = F.when(F.col("volume") > 0, F.col("taker_base") / F.col("volume")).otherwise(0.5)
    return bars.withColumns({"log_r2": F.ln(F.col("r") * F.col("r") + EPS), "log_range": F.ln(F.try_divide("high", "low")), "log_volume": F.log1p("volume"), "log_trades": F.log1p("trades"), "taker_ratio": ratio, "imbalance": 2 * ratio - 1})


def spine(days: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """(series_id, day) for every calendar day of each series' range, or of the range given."""
    ends = days.groupBy("series_id").agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    return ends.select("series_id", F.explode(F.sequence(start if start is not None else F.col("_a"), end if end is not None else F.col("_b"), F.expr("INTERVAL 1 DAY"))).alias("day"))


CHANNELS = ["r", "log_r2", "log_range", "log_volume", "log_trades", "taker_ratio", "imbalance"]


def day_table(returns: DataFrame, step: int) -> DataFrame:
    """series_id, day, n_bars, rv, log_rv, valid, invalid_reason, on the full calendar.

    Reasons in this order: bar count, grid gap, no finite return of the day's
    first bar, a channel of any bar that is not a finite number or a variance
    that is not finite and positive; a day without bars has the reason no_bars.
    Invalid days have null measures.
    """
    full = 86_400 // step
    each = (
        channels(returns)
        .withColumn("_bad", ~finite(*CHANNELS))
        .groupBy("series_id", "day")
        .agg(
            F.count("*").alias("n_bars"),
            F.min("ts").alias("_first"),
            F.max("ts").alias("_last"),
            F.min_by(F.struct("r"), "ts").alias("_open"),
            F.count_if("_bad").alias("_bad"),
            F.sum(F.when(~F.col("_bad"), F.col("r") * F.col("r"))).alias("_rv"),
        )
        .withColumn("_open", F.col("_open.r"))
    )
    gap = (_seconds("_last") - _seconds("_first") != (full - 1) * step) | (_seconds("_first") % 86_400 != 0)
    reason = F.when(F.col("n_bars").isNull(), "no_bars").when(F.col("n_bars") != full, "bar_count").when(gap, "grid_gap").when(~finite("_open"), "missing_boundary_return").when((F.col("_bad") > 0) | ~finite("_rv") | ~(F.col("_rv") > 0), "nonfinite_or_nonpositive")
    days = spine(each).join(each, ["series_id", "day"], "left").withColumn("invalid_reason", reason)
    rv = F.when(F.col("invalid_reason").isNull(), F.col("_rv"))
    return days.select("series_id", "day", F.coalesce("n_bars", F.lit(0)).alias("n_bars"), rv.alias("rv"), F.ln(rv).alias("log_rv"), F.col("invalid_reason").isNull().alias("valid"), "invalid_reason")


def reason_counts(days: DataFrame) -> DataFrame:
    return days.filter("not valid").groupBy("series_id", "invalid_reason").agg(F.count("*").alias("n"))


def zero_volume_audit(bars: DataFrame, days: DataFrame) -> DataFrame:
    """Zero-volume bars on valid days, organic and synthetic, with the organic rate."""
    on = bars.withColumn("day", F.to_date("ts")).join(days.filter("valid").select("series_id", "day"), ["series_id", "day"], "left_semi")
    zero = F.col("volume") <= 0
    out = on.groupBy("series_id").agg(F.count("*").alias("bars"), F.count_if(zero & ~F.col("synthetic")).alias("organic"), F.count_if(zero & F.col("synthetic")).alias("synthetic"))
    return out.withColumn("organic_rate", F.col("organic") / F.col("bars"))


def quote_consistency(bars: DataFrame) -> DataFrame:
    """Median, p99 and maximum of |quote - volume * close| / max(|quote|, 1e-12), NaN skipped."""
    err = F.abs(F.col("quote_volume") - F.col("volume") * F.col("close")) / F.greatest(F.abs("quote_volume"), F.lit(EPS))
    x = bars.select("series_id", F.nanvl(err, F.lit(None).cast("double")).alias("e"))
    return x.groupBy("series_id").agg(F.percentile("e", F.lit(0.5)).alias("median"), F.percentile("e", F.lit(0.99)).alias("p99"), F.max("e").alias("maximum"))


def patch_log_rv(returns: DataFrame, size: int, eps: float = EPS) -> DataFrame:
    """ln(sum of squared returns + eps) of each block of `size` successive bars of a day."""
    w = Window.partitionBy("series_id", "day").orderBy("ts")
    at = returns.withColumn("patch", F.floor((F.row_number().over(w) - 1) / size))
    return at.groupBy("series_id", "day", "patch").agg(F.ln(F.sum(F.col("r") * F.col("r")) + eps).alias("log_rv"), F.count("r").alias("n"))


def daily_returns_percent(returns: DataFrame, days: DataFrame) -> DataFrame:
    """Close-to-close return of each valid day in percent."""
    ok = days.filter("valid").select("series_id", "day")
    return returns.join(ok, ["series_id", "day"], "left_semi").groupBy("series_id", "day").agg((F.sum("r") * 100).alias("return_percent"))


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Sine and cosine of the hour and of the weekday (Monday is 0)."""
    import math

    hour, day = F.hour(ts) * (2 * math.pi / 24), F.weekday(ts) * (2 * math.pi / 7)
    return df.withColumns({"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "day_sin": F.sin(day), "day_cos": F.cos(day)})


def channel_scaler(bars: DataFrame, days: DataFrame, folds: DataFrame, columns: list[str], floor: float = 1e-8) -> DataFrame:
    """Per fold and series: mean and floored population deviation of each channel over valid core days."""
    core = F.broadcast(folds.filter("block = 'core'").select("fold", "start", "end"))  # a row per fold
    on = bars.join(days.filter("valid").select("series_id", "day"), ["series_id", "day"]).join(core, F.col("day").between(F.col("start"), F.col("end")))
    each = on.groupBy("fold", "series_id").agg(*(F.avg(c).alias(f"{c}_mean") for c in columns), *(F.greatest(F.stddev_pop(c), F.lit(floor)).alias(f"{c}_scale") for c in columns))
    return each


def patch_scaler(patches: DataFrame, targets: DataFrame, lookback: int, floor: float = 1e-8) -> DataFrame:
    """Mean and deviation of patch log-RV over the lookback windows of core targets (fold, series_id, day).

    Windows overlap: a patch counts once for each target that looks back on it.
    """
    t = targets.select("fold", "series_id", F.col("day").alias("target"), F.explode(F.sequence(F.lit(1), F.lit(lookback))).alias("lag"))
    uses = t.select("fold", "series_id", F.date_sub("target", F.col("lag")).alias("day")).groupBy("fold", "series_id", "day").agg(F.count("*").alias("w"))
    x = patches.join(uses, ["series_id", "day"])
    out = x.groupBy("fold", "series_id").agg(F.sum("w").alias("_w"), F.sum(F.col("w") * F.col("log_rv")).alias("_s"), F.sum(F.col("w") * F.col("log_rv") * F.col("log_rv")).alias("_q"))
    mean = F.col("_s") / F.col("_w")
    return out.select("fold", "series_id", mean.alias("mean"), F.greatest(F.sqrt(F.greatest(F.col("_q") / F.col("_w") - mean * mean, F.lit(0.0))), F.lit(floor)).alias("scale"))
