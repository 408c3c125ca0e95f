"""Streaming jobs against plain Python on a few files that arrive one by one."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidegauge.operators import articles as A
from tidegauge.operators import features as H
from tidegauge.streaming import jobs


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 3, day, hour, minute)


def stream_of(spark, folder, schema, parts):
    """A stream that takes each part as a batch, in order."""
    import os

    for i, part in enumerate(parts):
        path = folder / f"part-{i}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(path))
        for f in path.glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part-*")


ARTICLES = "scan_pos long, ts timestamp, title string, body string"


def test_first_seen(spark, tmp_path):
    (tmp_path / "in").mkdir()
    parts = [
        [(1, at(1, 9), "Harbour reopens", "The harbour took ships again.")],
        [(2, at(1, 9), "harbour REOPENS!", "Other words.")],  # title at one time
        [(3, at(1, 10), "Harbour reopens", "More of it.")],  # another time: kept
        [(4, at(1, 11), "Ships are back", "the harbour took ships, again")],  # content of the day
        [(5, at(1, 12), "Words", "Other words.")],  # content that only a removed article had: kept
        [(6, at(1, 13), "", ""), (7, at(1, 13), None, "...")],  # nothing to match: kept
        [(8, at(2, 9), "Harbour reopens", "The harbour took ships again.")],  # another day: kept
    ]
    parts.append([(9, at(1, 11), "Something else", "What a removed title had with it."), (10, at(1, 9), "Harbour reopens", "What a removed title had with it."), (11, at(1, 11), "Ships are back", "Still other words.")])
    stream = stream_of(spark, tmp_path / "in", ARTICLES, parts)
    with jobs.state_store(spark):
        got = jobs.run_to_table(jobs.first_seen(stream), f"{tmp_path}/out", f"{tmp_path}/state")
        assert got.columns == ["scan_pos", "ts", "title", "body"]
        # 11 has the time and title of 4, which its content removed and so claims nothing
        assert sorted(r["scan_pos"] for r in got.collect()) == [1, 3, 5, 6, 7, 8, 9, 11]
        batch = A.first_seen(spark.createDataFrame([r for p in parts for r in p], ARTICLES)).filter("removed_by is null")
        assert sorted(r["scan_pos"] for r in batch.collect()) == [1, 3, 5, 6, 7, 8, 9, 11]
        # a restart from the checkpoint goes on with the same keys
        late = spark.createDataFrame([(12, at(1, 20), "New", "Words that are new."), (13, at(1, 10), "Harbour reopens", "Yet other words.")], ARTICLES)
        late.coalesce(1).write.parquet(f"{tmp_path}/in/part-99")
        got = jobs.run_to_table(jobs.first_seen(stream), f"{tmp_path}/out", f"{tmp_path}/state")
        assert sorted(r["scan_pos"] for r in got.collect()) == [1, 3, 5, 6, 7, 8, 9, 11, 12]


def test_bars_close_and_late_rows_count(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "series_id string, ts timestamp, tick_id long, value double"
    parts = [
        [("a", at(1, 9, 10), 1, 5.0), ("a", at(1, 9, 50), 2, 7.0)],
        [("a", at(1, 12), 3, 1.0)],  # closes the hour of nine
        [("a", at(1, 12, 1), 4, 2.0)],
        [("a", at(1, 9, 20), 5, 99.0), ("a", at(1, 8), 6, 99.0)],  # late
    ]
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")  # the query forgets the batch with late rows
    try:
        with jobs.late_rows(spark) as late:
            query = jobs.run_to_files(jobs.tumbling_bars(stream_of(spark, tmp_path / "in", schema, parts)), f"{tmp_path}/out", f"{tmp_path}/state")
            total = late.total(query)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    got = spark.read.parquet(f"{tmp_path}/out").select(F.hour("ts").alias("h"), "open", "high", "low", "close", "volume", "trades").collect()
    assert [tuple(r) for r in got] == [(9, 5.0, 7.0, 5.0, 7.0, 12.0, 2)]  # the hour of twelve is still open
    assert total == 2 and len(query.recentProgress) <= 1


def test_slow_fast_in_any_split(spark, tmp_path):
    """Out of order, with days without vectors, a late day and a restart; against the batch state."""
    schema = "series_id string, day date, vector array<double>"
    rng = random.Random(3)
    rows = [(s, dt.date(2024, 1, d), None if (d + len(s)) % 5 == 0 else [rng.uniform(-1, 1), float(d)]) for s in ("a", "bb") for d in range(1, 21)]
    one = [r for r in rows if r[1].day <= 12]
    rng.shuffle(one)
    (tmp_path / "in").mkdir()
    parts = [one[i::4] for i in range(4)]
    stream = jobs.slow_fast(stream_of(spark, tmp_path / "in", schema, parts), 2, late="15 days")
    with jobs.state_store(spark):
        jobs.run_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/state")
        rest = [*(r for r in rows if r[1].day > 12), *((s, dt.date(2024, 3, 1), [0.0, 0.0]) for s in ("a", "bb"))]
        spark.createDataFrame(rest, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part-5")
        jobs.run_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/state")
        late = [("a", dt.date(2024, 1, 5), [9.0, 9.0]), ("a", dt.date(2024, 3, 30), [0.0, 0.0])]
        spark.createDataFrame(late, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part-6")
        jobs.run_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r["series_id"], r["day"]): [*r["slow"], *r["fast"]] for r in spark.read.parquet(f"{tmp_path}/out").filter("day < DATE '2024-02-01'").collect()}
    batch = H.slow_state(spark.createDataFrame(rows, schema), ["series_id"], "vector").collect()
    assert len(got) == len(batch) == len(rows)
    assert all(abs(x - y) < 1e-12 for r in batch for x, y in zip(got[r["series_id"], r["day"]], [*r["slow"], *r["fast"]], strict=True))
