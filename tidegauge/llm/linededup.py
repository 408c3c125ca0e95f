"""Removal of repeated line runs by a distributed suffix array over line ids.

The lines of all documents, in the order of doc_id and line, form one sequence
of positions. Lines get ids in the order of their hashes, and prefix doubling
refines them: the rank of 2h lines follows from the ranks of h lines at a
position and h lines further on, by sorting the distinct pairs. Positions whose
prefix is unique drop out at each round, so ranks are those of the suffix array's
intervals whose longest common prefix is at least h lines.

A run of lines is removed where the same run begins earlier and holds at least
min_words words. Such a run is covered by minimal windows (the shortest ones,
seen from their first or from their last line, that hold min_words words) that
occur earlier too; so ranks are needed only up to the longest minimal window,
and the covered lines are exactly those of all maximal repeated runs.

Copies of whole texts become one text beforehand: the sequence holds each
distinct text once, and nothing is ever compared within a group of copies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm import shared


@dataclass(frozen=True)
class Params:
    min_words: int = 50


def _mark(docs: DataFrame) -> str:
    """Underscores that no column of docs begins with: names after them are free."""
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    return mark


def _keyed(docs: DataFrame, mark: str) -> DataFrame:
    """docs with id and the 128-bit key (t1, t2) of the text, named behind mark; a null doc_id counts as the smallest."""
    text = F.col("text").cast("string")
    return docs.withColumns({f"{mark}id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), f"{mark}t1": F.xxhash64(text), f"{mark}t2": F.xxhash64(F.lit(1), text)})


def line_keys(docs: DataFrame) -> DataFrame:
    """id, t1, t2 and of each line with a word its 128-bit key and number of words."""
    longs = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            h1, h2, n = [], [], []
            for text in batch.column(3):
                lines = [x for x in (text.as_py() or b"").split(b"\n") if x.strip()]
                h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), "<i8").reshape(-1, 2)
                h1.append(h[:, 0])
                h2.append(h[:, 1])
                n.append([len(x.split()) for x in lines])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(h1, longs), pa.array(h2, longs), pa.array(n, longs)], ["id", "t1", "t2", "h1", "h2", "words"])

    rows = _keyed(docs.select("doc_id", "text"), "_").filter(F.col("text").isNotNull()).select("_id", "_t1", "_t2", F.col("text").cast("string").cast("binary"))
    return shared.in_small_batches(rows).mapInArrow(run, "id long, t1 long, t2 long, h1 array<long>, h2 array<long>, words array<long>")


def _ranked(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct keys with rank: increasing in the order of the keys, over all partitions."""
    parts = keys.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return shared.staged(keys.repartitionByRange(int(parts), *by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), name)


def minimal_windows(words: np.ndarray, at: np.ndarray, least: int) -> set[tuple[int, int]]:
    """(index of the first line, lines) of the minimal windows over repeated lines at positions `at`.

    Windows don't leave a stretch of successive positions.
    """
    found: set[tuple[int, int]] = set()
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
        sums = np.concatenate([[0], np.cumsum(words[part])])
        ends = np.searchsorted(sums, sums[:-1] + least)  # after the last line, from each first line
        found.update((int(part[s]), int(e - s)) for s, e in enumerate(ends) if e < len(sums))
        starts = np.searchsorted(sums, sums[1:] - least, side="right") - 1  # the first line, from each last line
        found.update((int(part[s]), int(e + 1 - s)) for e, s in enumerate(starts) if s >= 0)
    return found


def _windows(lines: DataFrame, least: int) -> DataFrame:
    """(head, pos, size) of the minimal windows; head is the position of the document's first line."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for head, each in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, words = np.array([x["pos"] for x in each]), np.array([x["words"] for x in each])
                out += [(head, int(at[i]), n) for i, n in sorted(minimal_windows(words, at, least))]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["head", "pos", "size"])

    by_doc = lines.groupBy("head").agg(F.sum("words").alias("_all"), F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("each")).filter(F.col("_all") >= least)
    return by_doc.select("head", "each").mapInArrow(run, "head long, pos long, size long")


def repeated_runs(keys: DataFrame, p: Params) -> DataFrame:
    """(id, t1, t2, spans): the lines to remove, counted among lines with a word, as (first, lines)."""
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["id", "t1", "t2"]
    # whole documents stay together, so a document's positions follow each other
    placed = (
        keys.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select(*order, F.posexplode(F.arrays_zip("h1", "h2", "words")).alias("i", "line"))
        .select(*order, "i", "line.*", F.monotonically_increasing_id().alias("pos"))
    )
    placed = shared.staged(placed.withColumn("head", F.col("pos") - F.col("i")), "positions")
    ids = _ranked(placed.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), ["h1", "h2"], "line-ids")
    lines = shared.staged(placed.join(ids, ["h1", "h2"]).select("pos", "head", "rank", "words"), "lines")
    windows = shared.staged(_windows(lines, p.min_words), "windows")
    longest = windows.agg(F.max("size")).first()[0] or 0
    level, h, found = lines.select("pos", "head", "rank"), 1, None
    while h <= longest:
        mine = windows.filter((F.col("size") >= h) & (F.col("size") < 2 * h))
        tail = level.select((F.col("pos")).alias("_tail"), F.col("rank").alias("_rank2"))
        named = mine.join(level.select("pos", F.col("rank").alias("_rank1")), "pos").withColumn("_tail", F.col("pos") + F.col("size") - h).join(tail, "_tail")
        first = named.groupBy("size", "_rank1", "_rank2").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        later = shared.staged(named.join(first, ["size", "_rank1", "_rank2"]).filter("pos > _first").select("head", "pos", "size"), "later-runs")
        found = later if found is None else found.union(later)
        if 2 * h <= longest:
            ahead = level.select((F.col("pos") - h).alias("pos"), "head", F.col("rank").alias("_rank2"))
            pairs = level.withColumnRenamed("rank", "_rank1").join(ahead, ["pos", "head"])
            names = _ranked(pairs.groupBy("_rank1", "_rank2").agg(F.count("*").alias("n")).filter("n > 1").select("_rank1", "_rank2"), ["_rank1", "_rank2"], "ranks")
            level = shared.staged(pairs.join(names, ["_rank1", "_rank2"]).select("pos", "head", "rank"), "level")
        h *= 2
    if found is None:
        found = spark.createDataFrame([], "head long, pos long, size long")
    spans = found.groupBy("head").agg(F.array_sort(F.collect_set(F.struct((F.col("pos") - F.col("head")).cast("int").alias("first"), F.col("size").cast("int").alias("n")))).alias("spans"))
    return placed.filter("i = 0").select(*order, "head").join(spans, "head").drop("head")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))
def _without(text, spans):
    """Texts without the lines of their spans; lines without a word stay as they are."""
    import pandas as pd

    out = []
    for t, cut in zip(text, spans, strict=True):
        if t is None:
            out.append((None, 0, 0))
            continue
        lines = t.encode().split(b"\n")
        real = [i for i, x in enumerate(lines) if x.strip()]
        gone: set[int] = set()
        for s in cut if cut is not None else ():
            gone.update(real[s["first"] : s["first"] + s["n"]] if s["n"] >= 0 else real)
        kept = t if not gone else b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode()
        out.append((kept, len(real), len(gone)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])


def remove_repeated_runs(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs with text less its later copies of line runs, and with n_lines and n_removed.

    Earlier means a smaller doc_id, or the same document further up. A null
    doc_id is the smallest; rows that repeat a doc_id and its text are one
    document and lose the same lines; of two texts under one doc_id the order is
    that of their hashes. Null texts stay null; lines without a word stay. Very
    long texts are cut into lines whole; their windows are found in one pass over
    their own lines. An empty table gives no rows. Columns of docs are kept,
    whatever their names (n_lines and n_removed are replaced).
    """
    keys = shared.staged(line_keys(docs), "line-keys")
    firsts = keys.groupBy("t1", "t2").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    marked = keys.join(firsts, ["t1", "t2"], "left")
    one = marked.filter("first is null or first = id").drop("first").dropDuplicates(["id", "t1", "t2"])
    runs = repeated_runs(one, p)
    whole = F.array(F.struct(F.lit(0).alias("first"), F.lit(-1).alias("n")))  # -1: all lines
    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)
    copies = marked.filter("first < id").filter(total >= p.min_words).select("id", "t1", "t2", whole.alias("spans")).distinct()
    # what a first text loses, its copies lose with all the rest; short copies lose nothing, as no run in them is long enough
    cuts = runs.select("id", "t1", "t2", "spans").union(copies)
    # a merge join at every size: the plan, and what it moves, is the same for small and large corpora
    mark = _mark(docs)
    cuts = shared.staged(cuts.select(*(F.col(c).alias(f"{mark}{c}") for c in ("id", "t1", "t2", "spans"))), "cuts").hint("merge")
    joined = shared.in_small_batches(_keyed(docs, mark)).join(cuts, [f"{mark}{c}" for c in ("id", "t1", "t2")], "left")
    # else a filter on its results would move below it and cut each text a second time
    done = joined.withColumn(f"{mark}out", _without.asNondeterministic()(F.col("text").cast("string"), f"{mark}spans"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return done.select(*rest, *(f"{mark}out.{c}" for c in ("text", "n_lines", "n_removed")))
