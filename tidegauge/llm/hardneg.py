"""Hard negatives by angular triangle filtering and integer scores.

A row stores its angles to a few reference directions. By the triangle inequality
of angles, two rows' angles to one direction bound the angle between them, and so
their cosine; times the norms this bounds their inner product. Scores are integer
inner products, and the bounds are widened by more than their rounding error.
Only where bounds and the wanted window of scores overlap are scores computed.

Anchors (the stated query set) and rows are packed into blocks of similar rows.
Bounds are taken between blocks, then between the rows and an anchor block, then
between the pairs; each pair of blocks is a row of a join, small and on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import shared


@dataclass(frozen=True)
class Params:
    """scale: components become floor(scale * x). positives and negatives: how many are taken.

    A negative's score lies between low and high hundredths of the positive's.
    directions of reference are picked from sample_rows rows, which changes only
    how much is filtered, never the result.
    """

    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    directions: int = 12
    sample_rows: int = 2000
    block_rows: int = 4096
    block_anchors: int = 512
    salts: int = 16


def usable(rows: DataFrame, p: Params) -> DataFrame:
    """(id, label, q) of the rows (vec_id, embedding, label) that take part, q of doubles with integer values."""
    x = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.filter(sound).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * p.scale).cast("double")).alias("q"))


def directions(rows: DataFrame, p: Params) -> np.ndarray:
    """Reference directions: of a bounded sample of rows by hash, each the farthest in angle from those before."""
    seen = rows.orderBy(F.xxhash64("id"), "id").limit(p.sample_rows).select("q").toPandas()["q"]
    q = np.array([v for v in seen], float).reshape(len(seen), -1)
    norms = np.linalg.norm(q, axis=1) if q.size else np.zeros(len(q))
    q = q[norms > 0] / norms[norms > 0, None] if q.size else q
    if not len(q):
        return np.zeros((1, q.shape[1] if q.ndim == 2 else 0))
    picked = [0]
    near = q @ q[0]
    while len(picked) < min(p.directions, len(q)) and near.min() < 1 - 1e-9:
        picked.append(int(near.argmin()))
        near = np.maximum(near, q @ q[picked[-1]])
    return q[picked]


def angles(q: np.ndarray, norms: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Of each row to each direction; 0 for rows without a direction, whose scores are all 0."""
    c = np.divide(q @ refs.T, norms[:, None], out=np.ones((len(q), len(refs))), where=norms[:, None] > 0)
    return np.arccos(np.clip(c, -1, 1))


#: Stands for no score.
NONE = -(1 << 63)
_BLOCK = "block long, labels array<long>, low array<double>, high array<double>, norm_low double, norm_high double, ids binary, label_of binary, q binary"


def blocks(rows: DataFrame, refs: np.ndarray, size: int, name: str, window: list | None = None) -> DataFrame:
    """Rows (id, label, q) packed into staged blocks of at most size similar rows.

    Sorted by label, nearest direction and angle to it; id last, so that equal
    vectors are split among blocks like any others. low and high are the block's
    angles to each direction. With window, rows also have known (array<long>),
    and two functions of a block's known give the least and most score wanted.
    """
    given = rows.sparkSession.sparkContext.broadcast(refs)  # directions x dimension, bounded
    known = window is not None

    def located(batches):
        for batch in batches:
            q = np.array(batch.column("q").flatten()).reshape(batch.num_rows, -1)
            a = angles(q, np.linalg.norm(q, axis=1), given.value) if len(q) else np.zeros((0, 1))
            near = a.argmin(axis=1)
            yield batch.append_column("_cell", pa.array(near.astype(np.int32))).append_column("_angle", pa.array(a[np.arange(len(a)), near]))

    def packed(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                b = batch.slice(at, size)
                order = np.argsort(b.column("id").to_numpy(), kind="stable")
                wide = lambda c: np.array(b.column(c).flatten()).reshape(b.num_rows, -1)[order]  # noqa: E731, B023
                ids, label, q = b.column("id").to_numpy()[order], b.column("label").to_numpy()[order], wide("q")
                if np.abs(q).max() >= 2**31:
                    raise OverflowError("components beyond 32 bits")
                norms = np.linalg.norm(q, axis=1)
                a = angles(q, norms, given.value)
                row = [number, np.unique(label).tolist(), a.min(0).tolist(), a.max(0).tolist(), float(norms.min()), float(norms.max()), ids.astype("<i8").tobytes(), label.astype("<i8").tobytes(), q.astype("<i4").tobytes()]
                if known:
                    x = wide("known")
                    row += [x.astype("<i8").tobytes(), *(float(f(x)) for f in window)]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)

    kind = _BLOCK + ", known binary, least double, most double" * known
    names = [c.split()[0] for c in kind.split(", ")]
    own = "id long, label long, q array<double>" + ", known array<long>" * known
    order = ("label", "_cell", "_angle", "id")
    n = rows.count()
    dealt = rows.mapInArrow(located, f"{own}, _cell int, _angle double").repartitionByRange(max(1, -(-n // size)), *order).sortWithinPartitions(*order)
    return shared.staged(dealt.mapInArrow(packed, kind), name)


def score_bounds(a_low, a_high, a_norms, r_low, r_high, r_norms):
    """(least, most) inner product of anything within angles and norms, by each direction and then the tightest.

    Arrays broadcast; the last axis is that of directions. Norms are (low, high).
    """
    gap = np.maximum(np.maximum(a_low - r_high, r_low - a_high), 0)
    most = np.cos(np.minimum(gap, np.pi)).min(-1)
    wide, tight = a_high + r_high, a_low + r_low
    least = np.where(wide <= np.pi, np.cos(wide), np.where(tight >= np.pi, np.cos(tight), -1.0)).max(-1)
    small, large = a_norms[0] * r_norms[0], a_norms[1] * r_norms[1]
    slack = 1 + 1e-6 * large  # above the rounding of angles and products
    return np.where(least < 0, least * large, least * small) - slack, np.where(most > 0, most * large, most * small) + slack


class Block:
    """A block inside a task."""

    def __init__(self, row: dict, side: str):
        get = lambda c: row[f"{side}_{c}"]
        self.ids, self.labels = np.frombuffer(get("ids"), "<i8"), np.frombuffer(get("label_of"), "<i8")
        self.q = np.frombuffer(get("q"), "<i4").astype(float).reshape(len(self.ids), -1)
        self.low, self.high, self.norms = np.array(get("low")), np.array(get("high")), (get("norm_low"), get("norm_high"))
        self.own_norms = np.linalg.norm(self.q, axis=1)


def scores(a: np.ndarray, r: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products; most bounds them and all their partial sums."""
    if most < 2.0**52:
        return (a @ r.T).astype(np.int64)  # exact: every partial sum is an integer below 2**53
    if most < 2.0**55:
        return a.astype(np.int64) @ r.astype(np.int64).T
    raise OverflowError("inner products of 2**55 and more")


def best(values: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest wanted values of each row, ties by smaller id; columns are in order of ids."""
    rows, cols = np.nonzero(wanted)
    order = np.lexsort((cols, -values[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.concatenate([[0], np.nonzero(np.diff(rows))[0] + 1]) if len(rows) else np.zeros(0, np.int64)
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return rows[rank < k], cols[rank < k]


def kth(values: np.ndarray, wanted: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest wanted value of each row, or the least long where there are fewer."""
    least = np.iinfo(np.int64).min
    held = np.where(wanted, values, least)
    return np.partition(held, -k, axis=1)[:, -k] if held.shape[1] >= k else np.full(len(held), least)


def windowed(a: Block, r: Block, refs: np.ndarray, least: np.ndarray, most: np.ndarray):
    """(anchors, rows, scores, overlap) of what can hold a score between least and most of the anchor; None: nothing.

    Anchors against the row block, rows against what is left of the anchors, then
    pairs by the direction nearest the row block.
    """
    a_angles, r_angles = angles(a.q, a.own_norms, refs), angles(r.q, r.own_norms, refs)
    lo, hi = score_bounds(a_angles, a_angles, (a.own_norms, a.own_norms), r.low, r.high, r.norms)
    mine = np.nonzero((hi >= least) & (lo <= most))[0]
    if not len(mine):
        return None
    lo, hi = score_bounds(a_angles[mine].min(0), a_angles[mine].max(0), (a.own_norms[mine].min(), a.own_norms[mine].max()), r_angles, r_angles, (r.own_norms, r.own_norms))
    theirs = np.nonzero((hi >= least[mine].min()) & (lo <= most[mine].max()))[0]
    if not len(theirs):
        return None
    k = int(r_angles.mean(0).argmin())
    x, y = a_angles[mine, k, None, None], r_angles[None, theirs, k, None]
    lo, hi = score_bounds(x, x, (a.own_norms[mine, None],) * 2, y, y, (r.own_norms[None, theirs],) * 2)
    overlap = (hi >= least[mine, None]) & (lo <= most[mine, None])
    some = overlap.any(0)
    theirs, overlap = theirs[some], overlap[:, some]
    if not len(theirs):
        return None
    return mine, theirs, scores(a.q[mine], r.q[theirs], float(a.own_norms[mine].max() * r.own_norms[theirs].max())), overlap


def _pairs(anchors: DataFrame, rows: DataFrame, p: Params, same: bool) -> DataFrame:
    """Pairs of blocks whose score bounds overlap the anchors' window, with all columns as a_* and r_*.

    same: a label is in both; else a label differs. Summaries are joined by label
    and salt, or by salt, which splits what one label or the whole table holds.
    """
    brief = ["block", "low", "high", "norm_low", "norm_high", "labels"]
    left = anchors.select(*[F.col(c).alias(f"a_{c}") for c in (*brief, "least", "most")]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    right = rows.select(*[F.col(c).alias(f"r_{c}") for c in brief]).withColumn("salt", F.pmod(F.xxhash64("r_block"), F.lit(p.salts)).cast("int"))
    if same:
        left, right = left.withColumn("label", F.explode("a_labels")), right.withColumn("label", F.explode("r_labels"))
        met = left.join(right, ["label", "salt"])
    else:
        met = left.join(right, "salt").filter("size(a_labels) > 1 OR size(r_labels) > 1 OR a_labels[0] <> r_labels[0]")

    def overlapping(batches):
        for batch in batches:
            m = lambda n: np.array(batch.column(n).flatten()).reshape(batch.num_rows, -1)  # noqa: E731, B023
            v = lambda n: batch.column(n).to_numpy()  # noqa: E731, B023
            lo, hi = score_bounds(m("a_low"), m("a_high"), (v("a_norm_low"), v("a_norm_high")), m("r_low"), m("r_high"), (v("r_norm_low"), v("r_norm_high")))
            keep = (hi >= v("a_least")) & (lo <= v("a_most"))
            yield pa.RecordBatch.from_arrays([batch.column("a_block"), batch.column("r_block")], ["a_block", "r_block"]).filter(pa.array(keep))

    kept = met.mapInArrow(overlapping, "a_block long, r_block long")
    kept = kept.distinct() if same else kept
    named = lambda t, s: t.select(*[F.col(c).alias(f"{s}_{c}") for c in t.columns])
    return kept.join(named(anchors, "a"), "a_block").join(named(rows, "r"), "r_block")


def _each(batches):
    for batch in batches:
        for k in range(batch.num_rows):  # a pair of blocks at a time
            yield batch.slice(k, 1).to_pylist()[0]


def _first(found: DataFrame, by: list[str], score: str, other: str, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), other)
    return found.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def positives(anchor_rows: DataFrame, row_blocks: DataFrame, refs: np.ndarray, every: int, p: Params) -> DataFrame:
    """(anchor_id, nth, positive_id, positive_score): the first rows of the anchor's label."""
    given = row_blocks.sparkSession.sparkContext.broadcast(refs)

    def seeds(batches):
        """The k-th best within an anchor's own block: what a positive scores at least."""
        for row in _each(batches):
            b = Block(row, "r")
            at = np.nonzero(b.ids % every == 0)[0]
            if len(at):
                s = scores(b.q[at], b.q, b.norms[1] ** 2)
                k = kth(s, (b.labels[at, None] == b.labels) & (b.ids[at, None] != b.ids), p.positives)
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[at]), pa.array(b.labels[at]), pa.array(k)], ["id", "label", "least"])

    def found(batches):
        for row in _each(batches):
            a, r = Block(row, "a"), Block(row, "r")
            least = np.frombuffer(row["a_known"], "<i8")
            got = windowed(a, r, given.value, least.astype(float), np.full(len(least), np.inf))
            if got is not None:
                mine, theirs, s, overlap = got
                wanted = overlap & (s >= least[mine, None]) & (a.labels[mine, None] == r.labels[theirs]) & (a.ids[mine, None] != r.ids[theirs])
                i, j = best(s, wanted, p.positives)
                yield pa.RecordBatch.from_arrays([pa.array(a.ids[mine][i]), pa.array(r.ids[theirs][j]), pa.array(s[i, j])], ["anchor_id", "positive_id", "positive_score"])

    floor = row_blocks.select(*[F.col(c).alias(f"r_{c}") for c in row_blocks.columns]).mapInArrow(seeds, "id long, label long, least long").groupBy("id", "label").agg(F.max("least").alias("_least"))
    known = anchor_rows.join(floor, ["id", "label"], "left").select("id", "label", "q", F.array(F.coalesce("_least", F.lit(NONE))).alias("known"))
    anchors = blocks(known, refs, p.block_anchors, "anchors", [lambda x: x[:, 0].min().astype(float), lambda x: np.inf])
    each = _pairs(anchors, row_blocks, p, True).mapInArrow(found, "anchor_id long, positive_id long, positive_score long")
    return _first(each, ["anchor_id"], "positive_score", "positive_id", p.positives, "nth")


def negatives(anchor_rows: DataFrame, row_blocks: DataFrame, chosen: DataFrame, refs: np.ndarray, p: Params) -> DataFrame:
    """(anchor_id, nth, rank, negative_id, negative_score) inside the window of each positive of chosen."""
    given = row_blocks.sparkSession.sparkContext.broadcast(refs)

    def bounds(known):
        """Least and most score of each positive's negatives; none between for places without a positive."""
        there = known != NONE
        x = np.where(there, known, 0)
        return np.where(there, -(-(p.low * x) // 100), 1), np.where(there, (p.high * x) // 100, 0)

    def span(known):
        lo, hi = bounds(known)
        open_ = lo <= hi
        return np.where(open_, lo, np.inf).min(-1), np.where(open_, hi, -np.inf).max(-1)

    def found(batches):
        for row in _each(batches):
            a, r = Block(row, "a"), Block(row, "r")
            known = np.frombuffer(row["a_known"], "<i8").reshape(len(a.ids), -1)
            got = windowed(a, r, given.value, *span(known))
            if got is None:
                continue
            mine, theirs, s, overlap = got
            lo, hi = bounds(known[mine])
            other = overlap & (a.labels[mine, None] != r.labels[theirs])
            for nth in range(known.shape[1]):
                i, j = best(s, other & (s >= lo[:, nth, None]) & (s <= hi[:, nth, None]), p.negatives)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(a.ids[mine][i]), pa.array(np.full(len(i), nth + 1, np.int32)), pa.array(r.ids[theirs][j]), pa.array(s[i, j])], ["anchor_id", "nth", "negative_id", "negative_score"])

    # at most `positives` entries an anchor
    held = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))).alias("_of"))
    place = F.transform(F.sequence(F.lit(0), F.lit(p.positives - 1)), lambda k: F.coalesce(F.get("_of", k)["positive_score"], F.lit(NONE)))
    anchors = blocks(anchor_rows.join(held, "id").select("id", "label", "q", place.alias("known")), refs, p.block_anchors, "anchors", [lambda x: span(x)[0].min(), lambda x: span(x)[1].max()])
    each = _pairs(anchors, row_blocks, p, False).mapInArrow(found, "anchor_id long, nth int, negative_id long, negative_score long")
    return _first(each, ["anchor_id", "nth"], "negative_score", "negative_id", p.negatives, "rank")


def mine(rows: DataFrame, every: int = 50, p: Params = Params()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, embedding, label).

    Anchors are the rows whose vec_id `every` divides. An anchor's positives are
    the first other rows of its label, higher scores first and ties by smaller
    vec_id; its negatives for a positive the first rows of another label whose
    score lies in the positive's window.

    Rows with a null vec_id, label or vector, or a null or non-finite component,
    take no part; vectors of another length than most (ties: the longest) take
    none either. A vec_id that repeats is one anchor, with its smallest label and
    vector; as partners its rows count each. A row of zeros scores 0 with all. An
    empty table gives no rows; other columns are ignored, whatever their names.
    Scores of 2**55 and more raise an error.
    """
    spark = rows.sparkSession
    all_rows = usable(rows, p)
    common = all_rows.groupBy(F.size("q").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None or not common["size"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    all_rows = all_rows.filter(F.size("q") == common["size"])
    refs = directions(all_rows, p)
    row_blocks = blocks(all_rows, refs, p.block_rows, "rows")
    anchor_rows = all_rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "q")).alias("_r")).select("id", "_r.label", "_r.q")
    chosen = shared.staged(positives(anchor_rows, row_blocks, refs, every, p), "positives")
    got = negatives(anchor_rows, row_blocks, chosen, refs, p)
    return got.join(chosen, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
