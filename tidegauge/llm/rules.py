"""Quality rules: base limits, then gradient-boosted trees over document statistics.

The trees are grown on histograms of a bounded labelled sample, with
monotonic constraints (more symbols, repeats or duplicate lines never raise the
verdict), and flattened into numpy node arrays that score a batch of rows for
all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import docstats

#: -1: the score may only fall as the statistic grows; 0: free.
MONOTONE = {"symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "same_next_ratio": -1}


@dataclass(frozen=True)
class Params:
    sample_rows: int = 20_000  # labelled documents that the trees are fitted on, at most
    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    least_weight: float = 2.0  # hessian in a leaf, at least
    shrink: float = 1.0
    cut: float = 0.5


@dataclass
class Forest:
    """Complete binary trees as arrays [tree, node]; node i has the children 2i + 1 and 2i + 2."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray  # [tree, leaf]

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(x), len(self.feature)), np.int64)
        trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        depth = int(np.log2(self.value.shape[1])) if len(self.feature) else 0
        for _ in range(depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        total = self.start + (self.value[trees, at - (self.value.shape[1] - 1)].sum(axis=1) if depth else np.zeros(len(x)))
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, p: Params) -> Forest:
    """Logistic boosting with exact bounds on leaf values under the constraints."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    offset = binned + np.arange(width) * p.bins
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    total = np.full(n, start)
    inner, leaves = 2**p.depth - 1, 2**p.depth
    feature, threshold, value = np.zeros((p.trees, inner), np.int64), np.full((p.trees, inner), np.inf), np.zeros((p.trees, leaves))
    best_leaf = lambda g, h: -g / (h + p.shrink)
    for t in range(p.trees):
        prob = 1 / (1 + np.exp(-total))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        node = np.zeros(n, np.int64)
        low, high = np.full(2 * leaves - 1, -np.inf), np.full(2 * leaves - 1, np.inf)
        for i in range(inner):
            mine = np.flatnonzero(node == i)
            low[2 * i + 1 : 2 * i + 3], high[2 * i + 1 : 2 * i + 3] = low[i], high[i]
            if not len(mine):
                continue
            flat = offset[mine].ravel()
            gs = np.bincount(flat, np.repeat(g[mine], width), width * p.bins).reshape(width, p.bins)
            hs = np.bincount(flat, np.repeat(h[mine], width), width * p.bins).reshape(width, p.bins)
            gl, hl = gs.cumsum(axis=1)[:, :-1], hs.cumsum(axis=1)[:, :-1]
            gt, ht = g[mine].sum(), h[mine].sum()
            left, right = np.clip(best_leaf(gl, hl), low[i], high[i]), np.clip(best_leaf(gt - gl, ht - hl), low[i], high[i])
            worth = lambda g_, h_, v: -(g_ * v + 0.5 * (h_ + p.shrink) * v * v)
            gain = worth(gl, hl, left) + worth(gt - gl, ht - hl, right) - worth(gt, ht, np.clip(best_leaf(gt, ht), low[i], high[i]))
            gain[(hl < p.least_weight) | (ht - hl < p.least_weight) | ((right - left) * monotone[:, None] < 0)] = -np.inf
            j, b = np.unravel_index(gain.argmax(), gain.shape)
            if gain[j, b] > 1e-9 and b < len(edges[j]):
                feature[t, i], threshold[t, i] = j, edges[j][b]
                middle = (left[j, b] + right[j, b]) / 2
                if monotone[j] < 0:
                    low[2 * i + 1], high[2 * i + 2] = middle, middle
                elif monotone[j] > 0:
                    high[2 * i + 1], low[2 * i + 2] = middle, middle
            node[mine] = 2 * i + 1 + (x[mine, feature[t, i]] > threshold[t, i])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value[t] = p.rate * np.clip(best_leaf(gs, hs), low[inner:], high[inner:])
        total += value[t][leaf]
    return Forest(start, feature, threshold, value)


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Forest:
    """Trees fitted on labels.quality of at most sample_rows documents outside fold 2."""

    def run(batches):
        for batch in batches:
            found = [docstats.measure(t.as_py())[1] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = docstats.labelled_sample(docs, labels, "quality", p.sample_rows).select("text", "y").mapInArrow(run, "x array<double>, y int").collect()
    x, y = np.array([r["x"] for r in rows], float).reshape(-1, len(docstats.RATIOS)), np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():  # nothing to learn: the base rules alone decide
        empty = np.zeros((0, 1))
        return Forest(8.0 if not len(y) or y[0] else -8.0, empty.astype(int), empty, np.zeros((0, 2)))
    order = np.lexsort(x.T)
    return grow(x[order], y[order], np.array([MONOTONE.get(c, 0) for c in docstats.RATIOS]), p)


def judge(docs: DataFrame, forest: Forest, p: Params = Params()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score of every document.

    A null text has no words and fails; repeated rows are judged each; an empty
    table gives no rows; columns other than doc_id and text are ignored. Without
    labels to learn from, the base rules decide alone.
    """
    shared_forest = docs.sparkSession.sparkContext.broadcast(forest)
    names = ["doc_id", *docstats.BASE, "base_failed", "kept", "score"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [docstats.measure(t.as_py()) for t in batch.column(1)]
            base = np.array([f[0] for f in found], np.int64)
            score = shared_forest.value.score(np.array([f[1] for f in found], float))
            failed = docstats.base_failed(base[:, 0], base[:, 4])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(base[:, i]) for i in range(base.shape[1])), pa.array(failed), pa.array(~failed & (score >= p.cut)), pa.array(score)], names)

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in docstats.BASE), "base_failed boolean, kept boolean, score double"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
