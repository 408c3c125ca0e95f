"""Quality classifier: a factorisation machine.

Features are hashed words, statistics of structure and numeric metadata, the
latter two in bins. Each feature has a weight and a short vector; a pair of
features interacts by the product of their vectors. The sum over all pairs is
half of (square of the sum) minus (sum of the squares), so a text is scored in
time linear in its features.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import docstats
from tidegauge.llm.langid import fold


@dataclass(frozen=True)
class Params:
    sample_rows: int = 10_000  # labelled documents that the model is fitted on, at most
    buckets: int = 1 << 15
    bins: int = 12
    rank: int = 6
    epochs: int = 8
    batch: int = 256
    rate: float = 0.02
    decay: float = 1e-5
    bin_value: float = 0.5
    metadata: tuple[str, ...] = ("n_chars",)


@dataclass
class Model:
    edges: np.ndarray  # [statistic, bins - 1]
    bias: float
    weight: np.ndarray
    factor: np.ndarray


class WordBuckets(dict):
    """word -> bucket, kept for the words met last."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = value = zlib.crc32(word) % self.buckets
        return value


def features(text: str | None, buckets: WordBuckets) -> tuple[np.ndarray, np.ndarray, tuple[float, ...]]:
    """Buckets and values of the words (unit length), and the statistics."""
    counts = Counter((text or "").encode().lower().split())
    at = np.fromiter(map(buckets.__getitem__, counts), np.int64, len(counts))
    value = np.sqrt(np.fromiter(counts.values(), float, len(counts)))
    return at, value / max(1e-9, np.sqrt((value**2).sum())), docstats.measure(text)[1]


def assemble(words: list, stats: np.ndarray, edges: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids, values and row starts of a batch; every row has its binned statistics, so none is empty."""
    width = stats.shape[1]
    bins = (stats[:, :, None] > edges[None]).sum(axis=2) + np.arange(width) * p.bins + p.buckets
    sizes = np.array([len(a) for a, _ in words])
    starts = np.concatenate([[0], np.cumsum(sizes + width)[:-1]]) if len(words) else np.zeros(0, np.int64)
    ids, values = np.empty(int(sizes.sum()) + width * len(words), np.int64), np.full(int(sizes.sum()) + width * len(words), p.bin_value)
    for i, (a, v) in enumerate(words):
        s = starts[i]
        ids[s : s + width] = bins[i]
        ids[s + width : s + width + len(a)] = a
        values[s + width : s + width + len(a)] = v
    return ids, values, starts


def margins(m: Model, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid, and the sums of the vectors."""
    vx = m.factor[ids] * values[:, None]
    sums = np.add.reduceat(vx, starts)
    pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(axis=1)
    return m.bias + np.add.reduceat(m.weight[ids] * values, starts) + pairs, sums


def train(words: list, stats: np.ndarray, y: np.ndarray, p: Params) -> Model:
    """Mini-batch Adam on the logistic loss."""
    edges = np.quantile(stats, np.linspace(0, 1, p.bins + 1)[1:-1], axis=0).T
    size = p.buckets + stats.shape[1] * p.bins
    rng = np.random.default_rng(2)
    m = Model(edges, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.zeros(size), rng.normal(0, 0.02, (size, p.rank)))
    first, second, t = np.zeros((size, p.rank + 1)), np.zeros((size, p.rank + 1)), 0
    for _ in range(p.epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(order), p.batch):
            rows = order[s : s + p.batch]
            ids, values, starts = assemble([words[i] for i in rows], stats[rows], edges, p)
            score, sums = margins(m, ids, values, starts)
            g = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[rows]
            row = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(ids))))
            gx = g[row] * values
            grad = np.empty((size, p.rank + 1))
            grad[:, 0] = np.bincount(ids, gx, size)
            own = gx * values
            for k in range(p.rank):
                grad[:, k + 1] = np.bincount(ids, gx * sums[row, k] - own * m.factor[ids, k], size)
            grad /= len(rows)
            grad[:, 0] += p.decay * m.weight
            grad[:, 1:] += p.decay * m.factor
            t += 1
            first += 0.1 * (grad - first)
            second += 0.01 * (grad**2 - second)
            step = p.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
            m.weight -= step[:, 0]
            m.factor -= step[:, 1:]
            m.bias -= p.rate * float(g.mean())
    return m


def _rows(docs: DataFrame, p: Params) -> DataFrame:
    """docs with a column _meta of the metadata; a missing or null value is -1."""
    values = [F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) if c in docs.columns else F.lit(None).cast("double") for c in p.metadata]
    return docs.withColumn("_meta", F.array(*(F.coalesce(v, F.lit(-1.0)) for v in values)))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model | None:
    """The model of labels.quality on at most sample_rows documents outside fold 2; None without both labels.

    Features are made on the executors; only they reach the driver.
    """

    def run(batches):
        buckets = WordBuckets(p.buckets)
        for batch in batches:
            found = [features(t.as_py(), buckets) for t in batch.column(0)]
            stats = [(*f[2], *m) for f, m in zip(found, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0].astype("<u4").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary()), pa.array(stats, pa.list_(pa.float64())), batch.column(2)], ["a", "v", "stats", "y"])

    meta = _rows(docs, p).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_meta")
    sample = docstats.labelled_sample(meta, labels, "quality", p.sample_rows, ["_meta"])
    rows = sample.select("text", "_meta", "y").mapInArrow(run, "a binary, v binary, stats array<double>, y int").collect()
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    words = [(np.frombuffer(r["a"], "<u4").astype(np.int64), np.frombuffer(r["v"], "<f4").astype(float)) for r in rows]
    order = np.argsort([zlib.crc32(r["a"]) for r in rows], kind="stable")  # the same order whatever the partitions
    return train([words[i] for i in order], np.array([rows[i]["stats"] for i in order], float), y[order], p)


def score(docs: DataFrame, model: Model | None, p: Params = Params(), cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    Null and empty texts have no words and are scored by their statistics;
    without a model every score is 0.5. A null doc_id is not held out. Repeated
    rows are scored each; an empty table gives no rows; columns other than
    doc_id, text and the metadata are ignored.
    """
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        buckets, m = WordBuckets(p.buckets), shared_model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            out = np.full(batch.num_rows, 0.5)
            if m is not None:
                found = [features(t.as_py(), buckets) for t in batch.column(2)]
                stats = np.array([(*f[2], *x) for f, x in zip(found, batch.column(3).to_pylist(), strict=True)], float)
                for s in range(0, len(found), 256):
                    ids, values, starts = assemble([f[:2] for f in found[s : s + 256]], stats[s : s + 256], m.edges, p)
                    out[s : s + 256] = 1 / (1 + np.exp(-np.clip(margins(m, ids, values, starts)[0], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    rows = _rows(docs, p).select(doc_id.alias("doc_id"), F.coalesce(fold(doc_id) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string"), "_meta")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
