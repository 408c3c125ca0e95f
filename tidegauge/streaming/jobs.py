"""Streaming versions: bars and counts, first-seen duplicates, slow and fast state, late rows, t-1 joins."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

from tidegauge.functions import text as X


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_bars(ticks: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Bars of a tick stream (series_id, ts, tick_id, value) in tumbling windows."""
    w = ticks.withWatermark("ts", late).groupBy("series_id", F.window("ts", size).alias("w"))
    order = F.struct("ts", "tick_id")
    bars = w.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("value").alias("volume"), F.count("*").alias("trades"))
    return bars.select("series_id", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "trades")


def daily_counts(articles: DataFrame, late: str = "1 day") -> DataFrame:
    out = articles.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("articles"), F.approx_count_distinct("source").alias("sources"))
    return out.select(F.to_date("w.start").alias("day"), "articles", "sources")


class _FirstSeen(StatefulProcessor):
    """The titles (with their times) and contents that the kept articles of a day have registered."""

    def __init__(self, columns: list[str], order: str, late_ms: int):
        self.columns, self.order, self.late_ms = columns, order, late_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.titles = handle.getMapState("titles", "k string", "seen boolean")
        self.contents = handle.getMapState("contents", "k string", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):
        day = pd.concat(list(rows)).set_axis(self.columns, axis=1)  # computed columns arrive without their names
        day = day.sort_values(self.order, kind="stable")
        if not self.titles.exists() and not self.contents.exists():
            self.handle.registerTimer(int(pd.Timestamp(key[0]).timestamp() * 1000) + 86_400_000 + self.late_ms)
        kept = []
        for title, content in day[["_title", "_content"]].itertuples(index=False):
            fresh = not (title and self.titles.containsKey((title,))) and not (content and self.contents.containsKey((content,)))
            kept.append(fresh)
            if fresh:
                if title:
                    self.titles.updateValue((title,), (True,))
                if content:
                    self.contents.updateValue((content,), (True,))
        yield day[kept].drop(columns=["_title", "_content", "_day"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """The watermark has passed the day: its keys are of no more use."""
        self.titles.clear()
        self.contents.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_seen(articles: DataFrame, order: str = "scan_pos", late: str = "1 day") -> DataFrame:
    """Articles without those whose time and title, or else day and content, an earlier kept one has.

    The batch rule exactly, over micro-batches and restarts: a removed article
    registers no keys. Within a batch articles go by order. Titles and contents
    without a letter or digit match nothing. A day is a key of the state, which
    holds its kept articles' keys as map entries, and is freed when the watermark
    is `late` past its end. The stream needs the RocksDB state store (state_store()).
    """
    known = lambda c: F.nullif(X.duplicate_key(c), F.lit(""))
    content = F.when(known("body").isNotNull(), X.content_key(known("body").alias("body")))
    title = F.when(known("title").isNotNull(), F.sha2(F.concat_ws("|", F.unix_micros("ts").cast("string"), known("title")), 256))
    keyed = articles.withColumns({"_day": F.to_date("ts").cast("string"), "_title": title, "_content": content}).withWatermark("ts", late)
    late_ms = int(pd.Timedelta(late).total_seconds() * 1000)
    return keyed.groupBy("_day").transformWithStateInPandas(_FirstSeen(keyed.columns, order, late_ms), articles.schema, "Append", "eventTime")


@contextmanager
def state_store(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which map states and timers need."""
    key, name = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, name)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


class _SlowFast(StatefulProcessor):
    """A series' slow vector, and its days that the watermark has not passed."""

    def __init__(self, dimension: int, alpha: float):
        self.dimension, self.alpha = dimension, alpha

    def init(self, handle) -> None:
        self.handle = handle
        self.slow = handle.getValueState("slow", "vector array<double>, started boolean, last string")
        self.open = handle.getMapState("open", "day string", "vector array<double>")

    def handleInputRows(self, key, rows, timerValues):
        last = self.slow.get()[2] if self.slow.exists() else ""
        new = {}
        for part in rows:
            new.update(zip(part["day"].astype(str), part["vector"], strict=True))
        for day, vector in new.items():
            if day > last:
                self.open.updateValue((day,), (None if vector is None else [float(x) for x in vector],))
        self._wake(min((d for d in new if d > last), default=None))
        return iter([])

    def _wake(self, day: str | None) -> None:
        """A series has one timer, at its earliest open day."""
        if day is None:
            return
        at = int(pd.Timestamp(day).timestamp() * 1000)
        for other in list(self.handle.listTimers()):
            if other <= at:
                return
            self.handle.deleteTimer(other)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """The earliest day is closed: it and all others that the watermark has reached are folded in by date."""
        reached = str(pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms").date())
        days = sorted((k[0], v[0]) for k, v in self.open.iterator())
        due = [x for x in days if x[0] <= reached]
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        self._wake(days[len(due)][0] if len(due) < len(days) else None)
        if not due:
            return
        vector, started, last = self.slow.get() if self.slow.exists() else ([0.0] * self.dimension, False, "")
        slow, out = np.array(vector, float), []
        for day, x in due:
            last, fast = day, np.zeros(self.dimension)
            if x is not None:
                x = np.asarray(x, float)
                slow = (1 - self.alpha) * slow + self.alpha * x if started else x
                fast, started = x - slow, True
            out.append((key[0], pd.Timestamp(day).date(), slow.tolist(), fast.tolist()))
            self.open.removeKey((day,))
        self.slow.update((slow.tolist(), bool(started), last))
        yield pd.DataFrame(out, columns=["series_id", "day", "slow", "fast"])

    def close(self) -> None:
        pass


def slow_fast(days: DataFrame, dimension: int, alpha: float = 2 / 31, late: str = "1 day") -> DataFrame:
    """(series_id, day, slow, fast) of a stream of days (series_id, day, vector or null).

    Days may come in any order up to `late` behind the newest: a day waits in the
    state of its series until the watermark has reached it, and days are folded in
    by date then, so that how the stream is cut into batches changes nothing. The
    first vector starts the slow one; a day without a vector holds it and has fast
    0; of rows that repeat an open day the last counts; a day behind the watermark
    is left out. The days since the watermark stay in the state. The stream needs
    the RocksDB state store (state_store()).
    """
    keyed = days.select("series_id", F.col("day").cast("string").alias("day"), F.transform("vector", lambda x: x.cast("double")).alias("vector"), F.col("day").cast("timestamp").alias("_ts")).withWatermark("_ts", late)
    return keyed.groupBy("series_id").transformWithStateInPandas(_SlowFast(dimension, alpha), "series_id string, day date, slow array<double>, fast array<double>", "Append", "eventTime")


class LateRows(StreamingQueryListener):
    """Counts rows that came after their watermark, over every batch since it listens.

    The progress that a query holds covers its last batches only; a listener sees
    each. A batch is counted once, as the largest figure told of it. Each stateful
    operator counts what it drops, and what one drops never reaches the next; an
    aggregation counts partial groups.
    """

    def __init__(self) -> None:
        self.batches: dict[str, dict[int, int]] = {}
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = self.batches.setdefault(str(p.runId), {})
        seen[p.batchId] = max(seen.get(p.batchId, 0), sum(op.numRowsDroppedByWatermark for op in p.stateOperators))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def total(self, query: StreamingQuery, wait: float = 60) -> int:
        """Late rows of a query; of one that has ended, only when its last event has come."""
        run = str(query.runId)
        if not query.isActive and not self._end(run).wait(wait):
            raise TimeoutError("the query's last event has not come")
        return sum(self.batches.get(run, {}).values())


@contextmanager
def late_rows(spark: SparkSession) -> Iterator[LateRows]:
    """Listens to all streams that start inside."""
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def previous_day_join(targets: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """A stream of targets (keys, day) with the static features of the day before."""
    shifted = features.select(*keys, F.date_add("day", 1).alias("day"), *(c for c in features.columns if c not in (*keys, "day")))
    return targets.join(shifted, [*keys, "day"], "left")


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to Parquet files at path, and give the query when it is done."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """run_to_files, and the files as a table. Windows that the watermark has not passed stay in the state."""
    run_to_files(stream, path, checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
