"""The test tables seen as the engine's tables, in Spark and as DuckDB CTEs of the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3600


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (no negative zero), dates and timestamps as text, so results compare across engines."""
    out = {}
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            out[c] = F.round(F.col(c).cast("double"), digits) + F.lit(0.0)
        elif kind == "date":
            out[c] = F.col(c).cast("string")
        elif kind in ("timestamp", "timestamp_ntz"):
            out[c] = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "int":
            out[c] = F.col(c).cast("long")
    return df.withColumns(out) if out else df


def tidy_sql(sql: str, doubles: str = "", days: str = "", times: str = "", ctes: str = "") -> str:
    """The same for a DuckDB query: names of its double, date and timestamp columns."""
    parts = [f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS VARCHAR) AS {c}" for c in days.split()] + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in times.split()]
    body = f"SELECT * {'REPLACE (' + ', '.join(parts) + ')' if parts else ''} FROM ({sql}) AS q"
    return f"WITH {ctes} {body}" if ctes else body


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick_id"), "user_id", "value")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events by type; the taker's part is that of even users."""
    order = F.struct("ts", "tick_id")
    h = ticks(spark, sf_dir).groupBy("series_id", F.date_trunc("hour", "ts").alias("hour"))
    b = h.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("value").alias("volume"), F.count("*").cast("double").alias("trades"), F.coalesce(F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value"))), F.lit(0.0)).alias("taker_base"), F.sum(F.col("value") * F.col("value")).alias("quote_volume"))
    return b.withColumnRenamed("hour", "ts")


BARS = """bars AS (SELECT series_id, h AS ts, open, high, low, close, volume, trades, taker_base, quote_volume FROM (
SELECT event_type AS series_id, date_trunc('hour', ts) AS h, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close,
sum(value) AS volume, count(*)::DOUBLE AS trades, coalesce(sum(value) FILTER (WHERE user_id % 2 = 0), 0) AS taker_base, sum(value * value) AS quote_volume FROM events GROUP BY 1, 2))"""
#: Hours that are missing between two bars, where at most three are.
GAPS = BARS + """, gaps AS (SELECT series_id, p + INTERVAL 1 HOUR AS start, ts - INTERVAL 1 HOUR AS "end" FROM (SELECT series_id, ts, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM bars)
WHERE date_diff('hour', p, ts) BETWEEN 2 AND 4),
filled AS (SELECT *, false AS synthetic FROM bars UNION ALL SELECT g.series_id, t.ts, b.close, b.close, b.close, b.close, 0, 0, 0, 0, true FROM (SELECT series_id, start, unnest(generate_series(start, "end", INTERVAL 1 HOUR)) AS ts FROM gaps) t
JOIN gaps g USING (series_id, start) JOIN bars b ON b.series_id = t.series_id AND b.ts = t.start - INTERVAL 1 HOUR)"""
def _days_sql(source: str) -> tuple[str, str]:
    """CTEs of returns and days over the bars of a CTE."""
    rets = f""", rets AS (SELECT b.*, CAST(b.ts AS DATE) AS day, CASE WHEN b.close > 0 AND p.close > 0 THEN ln(b.close) - ln(p.close) END AS r
FROM {source} b LEFT JOIN {source} p ON p.series_id = b.series_id AND p.ts = b.ts - INTERVAL 1 HOUR)"""
    days = """, sound AS (SELECT *, coalesce(isfinite(r) AND isfinite(r * r) AND low <> 0 AND high / low > 0 AND isfinite(high / low) AND volume > -1 AND isfinite(volume) AND trades > -1 AND isfinite(trades) AND (volume <= 0 OR isfinite(taker_base)), false) AS good FROM rets),
eachday AS (SELECT series_id, day, count(*) AS n_bars, min(ts) AS f, max(ts) AS l, arg_min(struct_pack(r := r), ts).r AS r0, sum(r * r) FILTER (WHERE good) AS s, count(*) FILTER (WHERE NOT good) AS bad FROM sound GROUP BY 1, 2),
span AS (SELECT series_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM eachday GROUP BY 1),
days AS (SELECT series_id, day, n_bars, CASE WHEN invalid_reason IS NULL THEN s END AS rv, CASE WHEN invalid_reason IS NULL THEN ln(s) END AS log_rv, invalid_reason IS NULL AS valid, invalid_reason FROM (
SELECT p.series_id, p.day, coalesce(n_bars, 0) AS n_bars, s, CASE WHEN n_bars IS NULL THEN 'no_bars' WHEN n_bars <> 24 THEN 'bar_count' WHEN date_diff('hour', f, l) <> 23 OR f <> date_trunc('day', f) THEN 'grid_gap' WHEN NOT coalesce(isfinite(r0), false) THEN 'missing_boundary_return' WHEN bad > 0 OR NOT coalesce(s > 0 AND isfinite(s), false) THEN 'nonfinite_or_nonpositive' END AS invalid_reason
FROM span p LEFT JOIN eachday e ON p.series_id = e.series_id AND p.day = e.day))"""
    return rets, days


RETURNS = GAPS + _days_sql("filled")[0]
DAYS = RETURNS + _days_sql("filled")[1]
#: Bars with a faulty value on some days: what, in which column, and at which hour.
FAULTS = (("close", "NaN", 12), ("high", "Infinity", 3), ("volume", "NaN", 5), ("trades", "-1", 7), ("close", "-1", 12), ("close", "Infinity", 0), ("taker_base", "-Infinity", 9), ("low", None, 8), ("low", "0", 10), ("close", "0", 23), ("volume", "-0.5", 4))
_FAULT = lambda c: "CASE " + " ".join(f"WHEN day(ts) % 14 = {i} AND hour(ts) = {h} THEN " + (f"'{v}'::DOUBLE" if v else "NULL") for i, (x, v, h) in enumerate(FAULTS) if x == c) + f" ELSE {c} END AS {c}"
PLANTED = GAPS + ", faulty AS (SELECT * REPLACE (" + ", ".join(_FAULT(c) for c in ("close", "high", "low", "volume", "trades", "taker_base")) + ") FROM filled)" + "".join(_days_sql("faulty"))


def planted(filled: DataFrame) -> DataFrame:
    """The bars with those faults."""
    columns = {}
    for i, (c, value, hour) in enumerate(FAULTS):
        here = (F.dayofmonth("ts") % 14 == i) & (F.hour("ts") == hour)
        columns[c] = F.when(here, F.lit(value).cast("double")).otherwise(columns.get(c, F.col(c)))
    return filled.withColumns(columns)


def gaps(b: DataFrame) -> DataFrame:
    """Runs of one to three hours that a series lacks."""
    before = F.lag("ts").over(Window.partitionBy("series_id").orderBy("ts"))
    x = b.withColumn("_p", before).withColumn("_h", (F.unix_seconds("ts") - F.unix_seconds("_p")) / HOUR)
    return x.filter("_h between 2 and 4").select("series_id", (F.col("_p") + F.expr("INTERVAL 1 HOUR")).alias("start"), (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("end"))


#: A prime near a million: no quotient of an amount in cents is a tie where results are rounded.
UNIT = 999_983.0


def long_days(spark: SparkSession, sf_dir: str, by_priority: bool = True) -> DataFrame:
    """A long daily series: order value per day and priority (or all), on the full calendar; about a tenth of days is invalid."""
    from tidegauge.operators.bars import spine

    o = read(spark, sf_dir, "orders").select((F.col("o_orderpriority") if by_priority else F.lit("all")).alias("series_id"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    d = o.groupBy("series_id", "day").agg((F.sum("o_totalprice") / UNIT).alias("rv"))
    out = spine(d).join(d, ["series_id", "day"], "left")
    return out.withColumns({"valid": F.col("rv").isNotNull(), "log_rv": F.ln("rv")})


def long_days_sql(by_priority: bool = True) -> str:
    series = "o_orderpriority" if by_priority else "'all'"
    return f"""base AS (SELECT {series} AS series_id, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) / {UNIT} AS rv FROM orders GROUP BY 1, 2),
cal AS (SELECT series_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM base GROUP BY 1),
days AS (SELECT c.series_id, c.day, b.rv, b.rv IS NOT NULL AS valid, ln(b.rv) AS log_rv FROM cal c LEFT JOIN base b ON c.series_id = b.series_id AND c.day = b.day)"""


#: Walk-forward folds over the orders' years.
FOLDS = [(f"fold_{y}", "1992-01-01", f"{y - 2}-12-31", f"{y - 1}-01-01", f"{y - 1}-12-31", f"{y}-01-01", f"{y}-12-31") for y in (1998, 1999, 2000)]
FOLDS_SQL = "folds AS (SELECT * FROM (VALUES " + ", ".join(f"('{f[0]}', '{b}', DATE '{f[1 + 2 * i]}', DATE '{f[2 + 2 * i]}')" for f in FOLDS for i, b in enumerate(("core", "validation", "test"))) + ') AS t(fold, block, start, "end"))'


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the daily order value by its last value and by means of 5 and 22 days, over the folds' test years."""
    from tidegauge.operators.calendar import assign_blocks, fold_table, har_lags

    d = har_lags(long_days(spark, sf_dir, False)).filter("lag_1 is not null and log_rv is not null")
    d = assign_blocks(d, fold_table(spark, FOLDS).filter("block = 'test'"))
    pairs = F.expr("stack(3, 'random_walk', lag_1, 'mean_5', mean_5, 'mean_22', mean_22) AS (model, p)")
    return d.select("fold", F.col("day").alias("target_date"), F.col("rv").alias("true_rv"), pairs).select("fold", "model", "target_date", "true_rv", F.exp("p").alias("predicted_rv"))


HAR = """har AS (SELECT *, CASE WHEN n22 = 22 THEN l1 END AS lag_1, CASE WHEN n22 = 22 THEN m5 END AS mean_5, CASE WHEN n22 = 22 THEN m22 END AS mean_22 FROM (SELECT *, lag(log_rv) OVER w AS l1,
avg(log_rv) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m5, avg(log_rv) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING) AS m22,
count(log_rv) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING) AS n22 FROM days WINDOW w AS (PARTITION BY series_id ORDER BY day)))"""
PREDICTIONS = f"""{long_days_sql(False)}, {HAR}, {FOLDS_SQL},
test AS (SELECT fold, day AS target_date, rv AS true_rv, lag_1, mean_5, mean_22 FROM har JOIN folds ON block = 'test' AND day BETWEEN start AND "end" WHERE lag_1 IS NOT NULL AND log_rv IS NOT NULL),
pred AS (SELECT fold, 'random_walk' AS model, target_date, true_rv, exp(lag_1) AS predicted_rv FROM test UNION ALL SELECT fold, 'mean_5', target_date, true_rv, exp(mean_5) FROM test UNION ALL SELECT fold, 'mean_22', target_date, true_rv, exp(mean_22) FROM test),
core AS (SELECT fold, quantile_cont(rv, 0.9) AS threshold FROM days JOIN folds ON block = 'core' AND day BETWEEN start AND "end" GROUP BY 1),
ann AS (SELECT p.*, threshold, ln(true_rv) AS ly, ln(predicted_rv) AS lp, true_rv / predicted_rv - 1 - (ln(true_rv) - ln(predicted_rv)) AS qlike, true_rv > threshold AS is_spike, predicted_rv > threshold AS predicted_spike FROM pred p JOIN core USING (fold))"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.operators.calendar import assign_blocks, core_threshold, fold_table
    from tidegauge.operators.evaluate import annotate

    d = assign_blocks(long_days(spark, sf_dir, False), fold_table(spark, FOLDS))
    return annotate(predictions(spark, sf_dir), core_threshold(d, 0.9).drop("series_id"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_articles(read(spark, sf_dir, "documents"))


def as_articles(d: DataFrame) -> DataFrame:
    """Documents as articles: the time from doc_id, the title from the first 60 characters."""
    ts = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") * 7919 % 43200) * 60)
    return d.select("doc_id", F.col("doc_id").alias("scan_pos"), ts.alias("ts"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("body"), "source", "lang")


ARTICLES = "articles AS (SELECT doc_id, doc_id AS scan_pos, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7919 % 43200) AS ts, substr(text, 1, 60) AS title, text AS body, source, lang FROM documents)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as article vectors: a day from the id, sentiment from the first three elements."""
    from tidegauge.functions.vectors import softmax

    e = read(spark, sf_dir, "embeddings")
    v = F.col("embedding")
    return e.select("vec_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") * 7 % 60).cast("int")).alias("day"), F.concat(F.lit("src"), (F.col("vec_id") % 5).cast("string")).alias("source"), (F.col("vec_id") % 3 + 1).cast("int").alias("relevance"), F.col("label").cast("string").alias("family"), v.alias("semantic"), softmax(F.slice(v, 1, 3)).alias("sentiment"))


VECTORS = """vectors AS (SELECT vec_id, DATE '2024-01-01' + CAST(vec_id * 7 % 60 AS INTEGER) AS day, 'src' || (vec_id % 5) AS source, CAST(vec_id % 3 + 1 AS INTEGER) AS relevance, CAST(label AS VARCHAR) AS family, embedding AS semantic,
[exp(embedding[1]::DOUBLE) / z, exp(embedding[2]::DOUBLE) / z, exp(embedding[3]::DOUBLE) / z] AS sentiment FROM (SELECT *, exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE) + exp(embedding[3]::DOUBLE) AS z FROM embeddings)),
elems AS (SELECT vec_id, day, source, relevance, family, unnest(semantic)::DOUBLE AS x, generate_subscripts(semantic, 1) AS pos FROM vectors)"""


def words_sql(x: str) -> str:
    """The words of a text in DuckDB, between runs of Unicode's white space."""
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '[\t-\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda w: w <> '')"


def pieces_sql(budget: int) -> str:
    """CTE pieces: (doc_id, chunk, chunk_text) of the whole documents."""
    return f"""tokens AS (SELECT doc_id, {words_sql("text")} AS w FROM documents),
pieces AS (SELECT doc_id, CAST(i AS BIGINT) AS chunk, array_to_string(w[i * {budget} + 1:(i + 1) * {budget}], ' ') AS chunk_text
FROM (SELECT doc_id, w, unnest(range(greatest(1, CAST(ceil(len(w) / {budget}.0) AS BIGINT)))) AS i FROM tokens))"""


def hashed_sql(text: str) -> str:
    """The first eight elements of hash_encoder in DuckDB, before they are scaled to length 1."""
    each = [f"(('0x' || substr(h, {i + 7}, 2) || substr(h, {i + 5}, 2) || substr(h, {i + 3}, 2) || substr(h, {i + 1}, 2))::UBIGINT / 2147483648.0 - 1)::DOUBLE" for i in range(0, 64, 8)]
    return f"(SELECT [{', '.join(each)}] FROM (SELECT sha256('0:' || {text}) AS h))"
