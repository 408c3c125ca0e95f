"""Best-fit packing with large-item matching over the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. A piece's length is an
integer of at most ``capacity``, so a packing is a matter of how many pieces of
each length there are: the plan is made on that histogram (``capacity`` rows at
most, whatever the corpus holds), and the pieces then take the planned places by
their rank within their length.

Pieces above a third of the capacity stand at most twice in a sequence: they are
matched greedily, the longest with the longest partner that fits. The shorter
pieces then go, longest first, to the smallest gap that holds them.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm import shared, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length that share a task when they are ranked.
GROUP_ROWS = 1024
MAX_GROUPS = 4096


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, piece, start, length and crc32 of the ids of each piece. Null text: empty."""

    def run(batches):
        encode = tokens.encoder(tokenizer, added=True)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return shared.in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset) of the packing.

    A row says that the pieces of that length with the ranks first .. first +
    count - 1 go, one each, into as many consecutive sequences at that offset.
    The number of rows depends on the capacity, not on how many pieces there are.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is empty or longer than the capacity")
    taken = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # the gaps in order
    opened = 0

    def put(n: int, count: int, sequence: int, gap: int) -> None:
        rows.append((n, taken[n], count, sequence, capacity - gap))
        taken[n] += count
        left[n] -= count

    def keep(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                bisect.insort(sizes, gap)
            gaps.setdefault(gap, []).append((sequence, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        if at < 0:
            count = left[a]
            put(a, count, opened, capacity)
            keep(capacity - a, opened, count)
        else:
            b = large[at]
            if a == b and left[a] == 1:
                if at == 0:
                    put(a, 1, opened, capacity)
                    keep(capacity - a, opened, 1)
                    opened += 1
                    large.pop()
                    continue
                b = large[at - 1]
            count = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, count, opened, capacity)
            put(b, count, opened, capacity - a)
            keep(capacity - a - b, opened, count)
        opened += count
        large = [n for n in large if left[n]]
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect.bisect_left(sizes, n)
            if at == len(sizes):
                gap, sequence, count = capacity, opened, -(-left[n] // (capacity // n))
                opened += count
            else:
                gap = sizes[at]
                sequence, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            each = gap // n
            full = min(count, left[n] // each)
            for k in range(each if full else 0):
                put(n, full, sequence, gap - k * n)
            keep(gap - each * n, sequence, full)
            rest = 0
            if full < count and left[n]:
                rest = left[n]
                for k in range(rest):
                    put(n, 1, sequence + full, gap - k * n)
                keep(gap - rest * n, sequence + full, 1)
            done = full + bool(rest)
            keep(gap, sequence + done, count - done)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces (a staged table with a length).

    Only the histogram of lengths reaches the driver. Lengths that many pieces
    share are ranked in salted groups, whose sizes are summed beforehand.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(plan(histogram, capacity))
    groups = spark.createDataFrame([(n, min(-(-c // GROUP_ROWS), MAX_GROUPS)) for n, c in histogram.items()], "length long, _groups int")
    # at most `capacity` rows, so the broadcast has a proven bound
    salted = pieces.join(F.broadcast(groups), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_groups")).cast("int")).drop("_groups")
    before = (
        salted.groupBy("length", "_salt")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length, rank):
        import pandas as pd

        p = places.value
        big = np.int64(1) << 48
        at = np.searchsorted(p[:, 0] * big + p[:, 1], length.to_numpy() * big + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": p[at, 3] + rank.to_numpy() - p[at, 1], "offset": p[at, 4]})

    placed = ranked.withColumn("_place", place("length", "_rank"))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most capacity tokens.

    Null texts count as empty and give the closing id alone; repeated rows and
    ties are packed each on their own; an empty table gives an empty result;
    columns other than doc_id and text are ignored, whatever their names.
    """
    pieces = shared.staged(token_pieces(docs, capacity, tokenizer or tokens.default_path(), end_id), "pieces")
    return pack(pieces, capacity)
