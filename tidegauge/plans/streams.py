"""Queries that run the streaming jobs over the event table until it is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.plans import tables as T
from tidegauge.plans import vectors
from tidegauge.plans.tables import tidy, tidy_sql
from tidegauge.sources.staging import shared_path, staged
from tidegauge.streaming import jobs

QUERIES, SQL = {}, {}


def _place(spark: SparkSession, name: str) -> str:
    return shared_path(spark, name)


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = jobs.read_stream(spark, f"{sf_dir}/event[s].parquet", T.read(spark, sf_dir, "events"))
    return raw.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick_id"), "user_id", "value")


def _finish(spark, stream, name):
    return jobs.run_to_table(stream, _place(spark, name), _place(spark, f"{name}-checkpoint"))


def hourly(spark, sf_dir):
    """Closed bars: those whose hour ended before the watermark, an hour behind the last tick."""
    return tidy(_finish(spark, jobs.tumbling_bars(_ticks(spark, sf_dir)), "stream-bars"))


def first_seen(spark, sf_dir):
    """Documents as articles of whole days, so that titles of a day meet; how many of a day are kept."""
    docs = jobs.read_stream(spark, f"{sf_dir}/document[s].parquet", T.read(spark, sf_dir, "documents"))
    plain = {c: F.regexp_replace(c, r"[^ -~\n]", "x") for c in ("title", "body")}  # as DuckDB has no NFKD
    articles = T.as_articles(docs).withColumns({"ts": F.date_trunc("day", "ts"), **plain})
    with jobs.state_store(spark):
        kept = _finish(spark, jobs.first_seen(articles.select("scan_pos", "ts", "title", "body")).select("ts"), "stream-first")
    return tidy(kept.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("kept")))


def joined(spark, sf_dir):
    daily = T.ticks(spark, sf_dir).groupBy("series_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("prior"))
    x = jobs.previous_day_join(_ticks(spark, sf_dir).withColumn("day", F.to_date("ts")).select("series_id", "day", "tick_id"), daily, ["series_id"])
    return tidy(_finish(spark, x, "stream-join").groupBy("series_id", "day").agg(F.count("*").alias("n"), F.max("prior").alias("prior")))


#: How far behind the newest a day may come: more than the year that a part of the stream spans.
LATE_DAYS = 400


def slow_fast(spark, sf_dir):
    """The daily order values as a stream that comes year by year; days that the watermark has closed."""
    days = staged(T.long_days(spark, sf_dir).select("series_id", "day", F.when(F.col("log_rv").isNotNull(), F.array("log_rv")).alias("vector")), "stream-days")
    first, last = days.agg(F.year(F.min("day")), F.year(F.max("day"))).first()
    source = _place(spark, "stream-years")
    for year in range(first, last + 1) if first else ():  # as years would arrive
        days.filter(F.year("day") == year).repartition(4, "series_id").write.mode("append").parquet(source)
    if not first:
        days.write.parquet(source)
    stream = jobs.read_stream(spark, source, days, 4)
    with jobs.state_store(spark):
        states = _finish(spark, jobs.slow_fast(stream, 1, late=f"{LATE_DAYS} days"), "stream-slow-fast")
    return tidy(states.select("series_id", "day", F.col("slow")[0].alias("slow"), F.col("fast")[0].alias("fast")))


#: Letters and digits in lower case, all between them one space.
_KEY = r"trim(regexp_replace(lower(regexp_replace(coalesce({}, ''), '[^ -~\n]', 'x', 'g')), '[^a-z0-9]+', ' ', 'g'))"
QUERIES |= {"k01_stream_bars": hourly, "k02_stream_first_seen": first_seen, "k03_stream_slow_fast": slow_fast, "k05_stream_previous_day": joined}
SQL |= {
    "k01_stream_bars": tidy_sql("SELECT series_id, ts, open, high, low, close, volume, CAST(trades AS BIGINT) AS trades FROM bars WHERE ts + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)", "open high low close volume", times="ts", ctes=T.BARS),
    "k02_stream_first_seen": f"""WITH RECURSIVE {T.ARTICLES}, keyed AS (SELECT doc_id, CAST(ts AS DATE) AS day, coalesce(nullif({_KEY.format('title')}, ''), '#' || doc_id) AS t, coalesce(nullif({_KEY.format('body')}, ''), '#' || doc_id) AS c FROM articles),
ranked AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY doc_id) AS i FROM keyed),
walk AS (SELECT DISTINCT day, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS titles, CAST([] AS VARCHAR[]) AS contents, CAST(0 AS BIGINT) AS kept FROM keyed
UNION ALL SELECT day, i, CASE WHEN fresh THEN list_append(titles, t) ELSE titles END, CASE WHEN fresh THEN list_append(contents, c) ELSE contents END, kept + CASE WHEN fresh THEN 1 ELSE 0 END
FROM (SELECT r.day, r.i, titles, contents, kept, t, c, NOT list_contains(titles, t) AND NOT list_contains(contents, c) AS fresh FROM walk w JOIN ranked r ON r.day = w.day AND r.i = w.i + 1) AS n)
SELECT CAST(day AS VARCHAR) AS day, max(kept) AS kept FROM walk GROUP BY day""",
    "k03_stream_slow_fast": tidy_sql(f"SELECT series_id, day, slow, CASE WHEN log_rv IS NULL THEN 0 ELSE log_rv - slow END AS fast FROM slow WHERE day <= (SELECT max(day) FROM days) - {LATE_DAYS}", "slow fast", "day", ctes=f"{T.long_days_sql()}, {vectors._EMA}"),
    "k05_stream_previous_day": "WITH d AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT a.series_id, CAST(a.day AS VARCHAR) AS day, a.n, b.n AS prior FROM d a LEFT JOIN d b ON b.series_id = a.series_id AND b.day = a.day - 1",
}
