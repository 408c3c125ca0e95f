"""Queries over bars, days and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import bars as B
from tidegauge.operators import calendar as C
from tidegauge.operators import features as H
from tidegauge.plans import tables as T
from tidegauge.plans.tables import tidy, tidy_sql
from tidegauge.sources import files
from tidegauge.sources.arrays import read_json_array, write_json_array
from tidegauge.sources.staging import shared_path

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return keep


def _filled(s, d):
    b = T.bars(s, d)
    return B.fill_verified_gaps(b, T.gaps(b), T.HOUR)


def _returns(s, d):
    return B.gap_aware_returns(_filled(s, d), T.HOUR)


def _days(s, d):
    return B.day_table(_returns(s, d), T.HOUR)


@query("a02_range_with_preroll", tidy_sql("SELECT series_id, ts, close FROM bars WHERE ts >= TIMESTAMP '2024-01-09 23:00:00' AND ts < TIMESTAMP '2024-01-16'", "close", times="ts", ctes=T.BARS))
def range_(s, d):
    return files.in_range(T.bars(s, d), "2024-01-10", "2024-01-15", "1 HOUR").select("series_id", "ts", "close")


@query("a03_json_array", "SELECT doc_id, source, lang, CAST(n_chars AS BIGINT) AS n_chars, md5(text) AS digest FROM documents")
def json_array(s, d):
    docs = T.read(s, d, "documents")
    path = shared_path(s, "json-array")
    write_json_array(docs, path)
    return read_json_array(s, path, docs.schema).select("doc_id", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("a12_table_fingerprint")
def fingerprint(s, d):
    return files.fingerprint(T.read(s, d, "orders"))


@query("b01_duplicate_counts", "SELECT series_id, CAST(sum(n - 1) AS BIGINT) AS extra_copies, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS dropped_rows FROM (SELECT event_type AS series_id, date_trunc('minute', ts) AS m, count(*) AS n FROM events GROUP BY 1, 2) AS q GROUP BY 1")
def duplicates(s, d):
    return B.duplicate_counts(T.ticks(s, d).withColumn("ts", F.date_trunc("minute", "ts")))


@query("b01_drop_duplicated", "SELECT series_id, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM (SELECT event_type AS series_id, value, count(*) OVER (PARTITION BY event_type, date_trunc('minute', ts)) AS c FROM events) AS q WHERE c = 1 GROUP BY 1")
def dropped(s, d):
    return B.drop_duplicated(T.ticks(s, d).withColumn("ts", F.date_trunc("minute", "ts"))).groupBy("series_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("b02_verified_gap_fill", tidy_sql("SELECT series_id, ts, close, volume, synthetic FROM filled", "close volume", times="ts", ctes=T.GAPS))
def filled(s, d):
    return _filled(s, d).select("series_id", "ts", "close", "volume", "synthetic")


@query("b02_gap_audit", tidy_sql("SELECT g.series_id, g.start, g.\"end\", count(f.ts) AS inserted FROM gaps g LEFT JOIN filled f ON f.series_id = g.series_id AND f.synthetic AND f.ts BETWEEN g.start AND g.\"end\" GROUP BY ALL", times="start \"end\"", ctes=T.GAPS))
def audit(s, d):
    b = T.bars(s, d)
    g = T.gaps(b)
    return B.gap_audit(B.fill_verified_gaps(b, g, T.HOUR), g)


@query("b03_gap_aware_return", tidy_sql("SELECT series_id, ts, day, r FROM rets", "r", "day", "ts", T.RETURNS))
def returns(s, d):
    return _returns(s, d).select("series_id", "ts", "day", "r")


@query("b06_day_validity", tidy_sql("SELECT * FROM days", "rv log_rv", "day", ctes=T.DAYS))
def days(s, d):
    return _days(s, d)


@query("b06_faulty_bars", tidy_sql("SELECT * FROM days", "rv log_rv", "day", ctes=T.PLANTED))
def faulty(s, d):
    """Days of bars of which some are not numbers, infinite, missing or not positive."""
    return B.day_table(B.gap_aware_returns(T.planted(_filled(s, d)), T.HOUR), T.HOUR)


@query("b06_reason_counts", tidy_sql("SELECT series_id, invalid_reason, count(*) AS n FROM days WHERE NOT valid GROUP BY 1, 2", ctes=T.DAYS))
def reasons(s, d):
    return B.reason_counts(_days(s, d))


@query("b07_channels", tidy_sql("SELECT series_id, ts, ln(r * r + 1e-12) AS log_r2, CASE WHEN low <> 0 THEN ln(high / low) END AS log_range, ln(1 + volume) AS log_volume, ln(1 + trades) AS log_trades, CASE WHEN volume > 0 THEN taker_base / volume ELSE 0.5 END AS taker_ratio, 2 * CASE WHEN volume > 0 THEN taker_base / volume ELSE 0.5 END - 1 AS imbalance FROM rets", "log_r2 log_range log_volume log_trades taker_ratio imbalance", times="ts", ctes=T.RETURNS))
def channels(s, d):
    return B.channels(_returns(s, d)).select("series_id", "ts", "log_r2", "log_range", "log_volume", "log_trades", "taker_ratio", "imbalance")


@query("b09_zero_volume_audit", tidy_sql("SELECT series_id, count(*) AS bars, count(*) FILTER (WHERE volume <= 0 AND NOT synthetic) AS organic, count(*) FILTER (WHERE volume <= 0 AND synthetic) AS synthetic, count(*) FILTER (WHERE volume <= 0 AND NOT synthetic)::DOUBLE / count(*) AS organic_rate FROM rets SEMI JOIN (SELECT series_id, day FROM days WHERE valid) v USING (series_id, day) GROUP BY 1", "organic_rate", ctes=T.DAYS))
def zero(s, d):
    f = _filled(s, d)
    return B.zero_volume_audit(f, B.day_table(B.gap_aware_returns(f, T.HOUR), T.HOUR))


@query("b10_quote_consistency", tidy_sql("SELECT series_id, quantile_cont(e, 0.5) AS median, quantile_cont(e, 0.99) AS p99, max(e) AS maximum FROM (SELECT series_id, abs(quote_volume - volume * close) / greatest(abs(quote_volume), 1e-12) AS e FROM bars) GROUP BY 1", "median p99 maximum", ctes=T.BARS))
def quotes(s, d):
    return B.quote_consistency(T.bars(s, d))


@query("b11_patch_log_rv", tidy_sql("SELECT series_id, day, CAST((rn - 1) // 6 AS BIGINT) AS patch, ln(coalesce(sum(r * r), NULL) + 1e-12) AS log_rv, count(r) AS n FROM (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY ts) AS rn FROM rets) GROUP BY 1, 2, 3", "log_rv", "day", ctes=T.RETURNS))
def patches(s, d):
    return B.patch_log_rv(_returns(s, d), 6)


@query("b12_daily_return_percent", tidy_sql("SELECT series_id, day, 100 * sum(r) AS return_percent FROM rets SEMI JOIN (SELECT series_id, day FROM days WHERE valid) v USING (series_id, day) GROUP BY 1, 2", "return_percent", "day", ctes=T.DAYS))
def daily(s, d):
    r = _returns(s, d)
    return B.daily_returns_percent(r, B.day_table(r, T.HOUR))


@query("b13_calendar_features", tidy_sql("SELECT series_id, ts, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos, sin(2 * pi() * (isodow(ts) - 1) / 7) AS day_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS day_cos FROM bars", "hour_sin hour_cos day_sin day_cos", times="ts", ctes=T.BARS))
def calendar(s, d):
    return B.calendar_features(T.bars(s, d)).select("series_id", "ts", "hour_sin", "hour_cos", "day_sin", "day_cos")


@query("b14_channel_scaler", tidy_sql("SELECT 'f1' AS fold, series_id, avg(ln(1 + volume)) AS log_volume_mean, avg(ln(1 + trades)) AS log_trades_mean, greatest(stddev_pop(ln(1 + volume)), 1e-8) AS log_volume_scale, greatest(stddev_pop(ln(1 + trades)), 1e-8) AS log_trades_scale FROM rets SEMI JOIN (SELECT series_id, day FROM days WHERE valid AND day BETWEEN DATE '2024-01-01' AND DATE '2024-01-20') v USING (series_id, day) GROUP BY 2", "log_volume_mean log_trades_mean log_volume_scale log_trades_scale", ctes=T.DAYS))
def scaler(s, d):
    r = _returns(s, d)
    folds = C.fold_table(s, [("f1", "2024-01-01", "2024-01-20", "2024-01-21", "2024-01-25", "2024-01-26", "2024-01-31")])
    return B.channel_scaler(B.channels(r), B.day_table(r, T.HOUR), folds, ["log_volume", "log_trades"])


_W = lambda n: f"(PARTITION BY series_id ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
_SAMPLE = f"""sampled AS (SELECT series_id, day, CASE WHEN NOT valid THEN 'invalid_target' WHEN i < 30 THEN 'calendar_history' WHEN NOT ok7 THEN 'short_window' WHEN NOT ok22 THEN 'long_window' END AS removal_reason FROM (
SELECT series_id, day, valid, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS i, count(*) OVER {_W(7)} = 7 AND bool_and(valid) OVER {_W(7)} AS ok7, count(*) OVER {_W(22)} = 22 AND bool_and(valid) OVER {_W(22)} AS ok22 FROM days))"""


@query("c01_patch_sampler", tidy_sql("SELECT series_id, day, removal_reason, removal_reason IS NULL AS eligible FROM sampled", days="day", ctes=f"{T.long_days_sql()}, {_SAMPLE}"))
def sampler(s, d):
    return C.sample_days(T.long_days(s, d)).select("series_id", "day", "removal_reason", "eligible")


@query("c02_lag_sampler", tidy_sql(f"SELECT series_id, day, valid AND count(log_rv) OVER {_W(22)} = 22 AS eligible FROM days", days="day", ctes=T.long_days_sql()))
def lag_sampler(s, d):
    return C.sample_lag_days(T.long_days(s, d)).select("series_id", "day", "eligible")


@query("c03_block_counts", tidy_sql('SELECT fold, block, coalesce(removal_reason, \'kept\') AS reason, count(*) AS n FROM sampled JOIN folds ON day BETWEEN start AND "end" GROUP BY 1, 2, 3', ctes=f"{T.long_days_sql()}, {_SAMPLE}, {T.FOLDS_SQL}"))
def blocks(s, d):
    return C.block_counts(C.assign_blocks(C.sample_days(T.long_days(s, d)), C.fold_table(s, T.FOLDS)))


@query("c04_history_eligibility", tidy_sql("SELECT series_id, day, count(*) OVER (PARTITION BY series_id ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) = 30 AS eligible FROM days WHERE valid", days="day", ctes=T.long_days_sql()))
def history(s, d):
    return C.eligible_by_history(T.long_days(s, d).filter("valid")).select("series_id", "day", "eligible")


@query("c05_lookback_long", tidy_sql("SELECT t.series_id, t.day AS target, CAST(t.day - p.day AS BIGINT) AS lag, p.log_rv FROM days t JOIN days p ON p.series_id = t.series_id AND t.day - p.day BETWEEN 1 AND 7", "log_rv", "target", ctes=T.long_days_sql()))
def lookback(s, d):
    return C.lookback_long(T.long_days(s, d), ["log_rv"], 7).select("series_id", "target", "lag", "log_rv")


@query("c05_lookback_arrays", tidy_sql(f"SELECT series_id, day, count(*) OVER {_W(22)} AS days, 22 - count(*) OVER {_W(22)} AS padding, 1e6 * coalesce(sum(rv) OVER {_W(22)}, 0) AS total FROM days", "total", "day", ctes=T.long_days_sql()))
def arrays(s, d):
    out = C.lookback_arrays(T.long_days(s, d), ["rv"], 22)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + F.coalesce(x["rv"], F.lit(0.0)))
    return out.select("series_id", "day", F.size("window").cast("long").alias("days"), F.col("window_padding").cast("long").alias("padding"), (1e6 * total).alias("total"))


_REFIT = """WITH e AS (SELECT min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi FROM orders), y AS (SELECT lo, unnest(range(lo + 2, hi + 1)) AS y FROM e)
SELECT 'fold_' || y AS fold, 'core' AS block, CAST(make_date(lo, 1, 1) AS VARCHAR) AS start, CAST(make_date(y - 1, 12, 31) AS VARCHAR) AS "end" FROM y
UNION ALL SELECT 'fold_' || y, 'test', CAST(make_date(y, 1, 1) AS VARCHAR), CAST(make_date(y, 12, 31) AS VARCHAR) FROM y"""


@query("c06_refit_folds", _REFIT)
def refit(s, d):
    """Folds of the orders' years: a test year, the year before for validation, all earlier ones as core."""
    span = T.read(s, d, "orders").agg(F.year(F.min("o_orderdate")).alias("lo"), F.year(F.max("o_orderdate")).alias("hi"))
    years = span.filter("hi >= lo + 2").select("lo", F.explode(F.expr("sequence(lo + 2, hi)")).alias("y"))
    blocks = F.expr("stack(3, 'core', make_date(lo, 1, 1), make_date(y - 2, 12, 31), 'validation', make_date(y - 1, 1, 1), make_date(y - 1, 12, 31), 'test', make_date(y, 1, 1), make_date(y, 12, 31)) AS (block, start, end)")
    return tidy(C.refit_folds(years.select(F.concat(F.lit("fold_"), F.col("y").cast("string")).alias("fold"), blocks)))


@query("c07_core_threshold", tidy_sql('SELECT fold, series_id, quantile_cont(rv, 0.9) AS threshold FROM days JOIN folds ON block = \'core\' AND day BETWEEN start AND "end" GROUP BY 1, 2', "threshold", ctes=f"{T.long_days_sql()}, {T.FOLDS_SQL}"))
def threshold(s, d):
    return C.core_threshold(C.assign_blocks(T.long_days(s, d), C.fold_table(s, T.FOLDS)), 0.9)


@query("c08_target_scale", tidy_sql('SELECT fold, series_id, avg(log_rv) AS mean, greatest(stddev_pop(log_rv), 1e-8) AS scale, avg(rv) AS mean_rv FROM days JOIN folds ON block = \'core\' AND day BETWEEN start AND "end" GROUP BY 1, 2', "mean scale mean_rv", ctes=f"{T.long_days_sql()}, {T.FOLDS_SQL}"))
def scale(s, d):
    return C.target_scale(C.assign_blocks(T.long_days(s, d), C.fold_table(s, T.FOLDS)))


@query("h13_market_state", tidy_sql("SELECT series_id, day, lag_1, mean_5, mean_22, lag_1 - mean_5 AS last_minus_5, mean_5 - mean_22 AS five_minus_22, CASE WHEN lag_1 IS NOT NULL THEN lag(log_rv) OVER w - lag(log_rv, 2) OVER w END AS change_1, CASE WHEN lag_1 IS NOT NULL THEN stddev_pop(log_rv) OVER " + _W(5) + " END AS std_5 FROM har WINDOW w AS (PARTITION BY series_id ORDER BY day)", "lag_1 mean_5 mean_22 last_minus_5 five_minus_22 change_1 std_5", "day", ctes=f"{T.long_days_sql()}, {T.HAR}"))
def state(s, d):
    return C.market_state(T.long_days(s, d)).select("series_id", "day", "lag_1", "mean_5", "mean_22", "last_minus_5", "five_minus_22", "change_1", "std_5")


@query("h15_har_lags", tidy_sql("SELECT series_id, day, lag_1, mean_5, mean_22 FROM har", "lag_1 mean_5 mean_22", "day", ctes=f"{T.long_days_sql()}, {T.HAR}"))
def har(s, d):
    return C.har_lags(T.long_days(s, d)).select("series_id", "day", "lag_1", "mean_5", "mean_22")


@query("h14_previous_day_join", tidy_sql("SELECT t.series_id, t.day, t.rv, p.rv AS prior_rv FROM days t LEFT JOIN days p ON p.series_id = t.series_id AND p.day = t.day - 1", "rv prior_rv", "day", ctes=T.long_days_sql()))
def previous(s, d):
    x = T.long_days(s, d)
    return C.join_previous_day(x.select("series_id", "day", "rv"), x.select("series_id", "day", "rv"), ["series_id"], prefix="prior_")


@query("h17_training_weights", tidy_sql("SELECT series_id, day, w / avg(w) OVER (PARTITION BY series_id) AS weight FROM (SELECT series_id, day, pow(0.5, (max(day) OVER (PARTITION BY series_id) - day) / 365.0) AS w FROM days WHERE valid)", "weight", "day", ctes=T.long_days_sql()))
def weights(s, d):
    return C.training_weights(T.long_days(s, d).filter("valid"), "decay", ["series_id"]).select("series_id", "day", "weight")


@query("m06_winsorised", tidy_sql('SELECT series_id, day, greatest(lo, least(rv, hi)) AS rv FROM days JOIN (SELECT series_id, quantile_cont(rv, 0.01) AS lo, quantile_cont(rv, 0.99) AS hi FROM days WHERE day <= DATE \'1996-12-31\' GROUP BY 1) USING (series_id)', "rv", "day", ctes=T.long_days_sql()))
def winsorised(s, d):
    x = T.long_days(s, d).select("series_id", "day", "rv")
    q = H.winsorise(x, x.filter("day <= DATE '1996-12-31'"), ["rv"], ["series_id"])
    # Spark's least and greatest pass over nulls; a day without a value has none here either
    return q


@query("m01_weekday_dummies", tidy_sql("SELECT series_id, day, " + ", ".join(f"CAST(isodow(day) - 1 = {i} AS BIGINT) AS weekday_{i}" for i in range(1, 7)) + " FROM days", days="day", ctes=T.long_days_sql()))
def dummies(s, d):
    return H.weekday_dummies(T.long_days(s, d).select("series_id", "day"))
