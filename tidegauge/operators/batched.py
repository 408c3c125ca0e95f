"""Many penalised fits in the same passes over the data.

A study fits every feature set with every penalty on every fold. Here all of them
take Newton steps together: one pass sums, for each model that has not converged,
the loss, gradient and Hessian of its rows, and the driver solves the small
systems. What reaches the driver is (models x features^2) numbers a pass, whatever
the rows; the number of passes is that of the slowest model, about ten.

Losses are means over rows (weighted, if rows have weights), plus alpha / 2 times
the squared coefficients of the standardised features; the intercept is free.

- gamma: y exp(-eta) + eta, whose excess over its least value is the exact QLIKE
- logistic: of a 0 / 1 target
- gaussian: half the squared error
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.sources import files

PARAMETERS = "fold string, model string, lam double, intercept double, beta array<double>, rows long, loss double, passes int, converged boolean"


@dataclass(frozen=True)
class Spec:
    """A model: its features, and the sum-form penalty lam, which is 2 * lam / rows of a mean loss. folds: only those."""

    model: str
    features: tuple[str, ...]
    lam: float = 0.0
    folds: tuple[str, ...] | None = None


def _gamma(eta, y):
    r = y * np.exp(np.minimum(-eta, 700))
    return r + eta, 1 - r, r


def _logistic(eta, y):
    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    return np.logaddexp(0, eta) - y * eta, p - y, p * (1 - p)


def _gaussian(eta, y):
    return (eta - y) ** 2 / 2, eta - y, np.ones(len(y))


#: family -> (loss, first and second derivative by eta), start of the intercept from the mean target.
FAMILIES: dict[str, tuple[Callable, Callable]] = {"gamma": (_gamma, np.log), "logistic": (_logistic, lambda m: np.log(m / (1 - m))), "gaussian": (_gaussian, lambda m: m)}


class Fits:
    """Fitted parameters as a table of one row a (fold, model, lam), in units of the raw columns."""

    def __init__(self, table: DataFrame, columns: list[str], digest: tuple[int, str]):
        self.table, self.columns, self.digest = table, columns, digest

    def predict(self, rows: DataFrame, chosen: DataFrame | None = None, eta: str = "eta") -> DataFrame:
        """rows with model, lam and the linear predictor of every fit of their fold (or those of chosen: fold, model, lam).

        An error where the parameters are not those that were fitted.
        """
        files.verify_fingerprint(self.table, *self.digest)
        table = self.table.select("fold", "model", "lam", "intercept", "beta")
        if chosen is not None:
            table = table.join(chosen.select("fold", "model", "lam"), ["fold", "model", "lam"], "left_semi")
        # a row a fit, of a list of specifications that the caller wrote out
        out = rows.join(F.broadcast(table.withColumnsRenamed({"intercept": "_b", "beta": "_beta"})), "fold")
        return out.withColumn(eta, reduce(lambda a, k: a + F.col(self.columns[k]) * F.get("_beta", F.lit(k)), range(len(self.columns)), F.col("_b"))).drop("_b", "_beta")

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)


def load(spark, path: str, columns: list[str], digest: tuple[int, str]) -> Fits:
    """Saved parameters; scoring checks them against the digest of what was fitted."""
    return Fits(spark.read.schema(PARAMETERS).parquet(path), columns, digest)


def _summed(data: DataFrame, parts: Callable, width: str = "id long, sums array<double>") -> dict[int, np.ndarray]:
    """Sums of equally long arrays by id: partial ones by task, then by id, so that a task holds one array an id."""

    def gathered(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.array(x.values)
                total[i] = total[i] + x if i in total else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["id", "sums"])

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in parts(batch):
                total[i] = total[i] + x if i in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["id", "sums"])

    got = data.mapInArrow(partial, width).repartition("id").mapInArrow(gathered, width).toArrow()
    return {i: np.array(x.values) for i, x in zip(got["id"].to_pylist(), got["sums"], strict=True)}


def _folds_of(batch) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(fold, features, y, w) of a batch of rows (fold, x, y, w)."""
    fold = np.array(batch.column(0).to_pylist(), object)
    x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
    y, w = batch.column(2).to_numpy(), batch.column(3).to_numpy()
    return [(f, x[fold == f], y[fold == f], w[fold == f]) for f in dict.fromkeys(fold)]


def fit(rows: DataFrame, specs: list[Spec], y: Column | str, family: str = "gamma", weight: str | None = None, alpha: Callable[[float, float], float] = lambda lam, n: 2 * lam / n, passes: int = 80, tolerance: float = 1e-10, weighted_scale: bool = True) -> Fits:
    """Every spec on the rows of every fold (column fold). Rows without a target take no part.

    An error if a feature is not a finite number. Features are standardised by
    the mean and population deviation of the fold's rows (weighted, unless
    weighted_scale is off); one that does not vary has no effect. Of features that repeat each other, the
    coefficients of least norm are taken. A model whose loss does not settle is
    marked as not converged; all failing is an error.
    """
    measure, start = FAMILIES[family]
    columns = sorted({c for s in specs for c in s.features})
    y = F.col(y) if isinstance(y, str) else y
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    data = rows.select("fold", F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), y.cast("double").alias("y"), w.alias("w")).filter("y IS NOT NULL AND w > 0").persist()
    spark = rows.sparkSession

    scaling = (lambda v: v) if weighted_scale else np.ones_like

    def moments(batch):
        for f, x, t, v in _folds_of(batch):
            u = scaling(v)
            yield folds.index(f), np.concatenate([[len(t), v.sum(), v @ t, np.count_nonzero(~np.isfinite(x)) + np.count_nonzero(~np.isfinite(t)), u.sum()], u @ x])

    def spread(batch):
        for f, x, _, v in _folds_of(batch):
            yield folds.index(f), scaling(v) @ (x - means[folds.index(f)]) ** 2

    folds = sorted(r["fold"] for r in data.select("fold").distinct().collect())  # the study's folds
    if not folds:
        raise ValueError("no rows to fit")
    if not columns:
        data = data.withColumn("x", F.array().cast("array<double>"))
    first = _summed(data, moments)
    if any(m[3] for m in first.values()):
        raise ValueError("a feature or target is not a finite number")
    means = {k: m[5:] / m[4] for k, m in first.items()}
    scales = {k: np.sqrt(s / first[k][4]) for k, s in _summed(data, spread).items()}
    scales = {k: np.where(s > 1e-12, s, np.inf) for k, s in scales.items()}

    jobs = [(s, k) for s in specs for k, f in enumerate(folds) if s.folds is None or f in s.folds]
    at = [np.array([columns.index(c) for c in s.features], np.int64) for s, _ in jobs]
    now = [np.concatenate([[start(first[k][2] / first[k][1])], np.zeros(len(a))]) for (_, k), a in zip(jobs, at, strict=True)]
    penalty = [alpha(s.lam, first[k][0]) for s, k in jobs]
    before: list = [None] * len(jobs)  # the last accepted point and its loss
    best, done, count = [np.inf] * len(jobs), [False] * len(jobs), 0
    while not all(done) and count < passes:
        count += 1
        state = spark.sparkContext.broadcast([(i, jobs[i][1], at[i], now[i]) for i in range(len(jobs)) if not done[i]])

        def step(batch):
            for f, x, t, v in _folds_of(batch):
                k = folds.index(f)
                z = (x - means[k]) / scales[k]
                for i, j, a, b in state.value:  # noqa: B023
                    if j == k:
                        m = np.column_stack([np.ones(len(t)), z[:, a]])
                        loss, d, h = measure(m @ b, t)
                        yield i, np.concatenate([[v @ loss], m.T @ (v * d), ((m * (v * h)[:, None]).T @ m).ravel()])

        for i, sums in _summed(data, step).items():
            n, size = first[jobs[i][1]][1], len(now[i])
            free = np.append(0.0, np.full(size - 1, penalty[i]))
            loss = sums[0] / n + (free * now[i] ** 2).sum() / 2
            if before[i] is not None and not loss <= best[i] + 1e-13 * max(1, abs(best[i])):
                if np.abs(now[i] - before[i]).max() < 1e-14:
                    now[i], done[i] = before[i], True
                else:
                    now[i] = (now[i] + before[i]) / 2  # too far: halfway back
                continue
            gradient = sums[1 : size + 1] / n + free * now[i]
            hessian = sums[size + 1 :].reshape(size, size) / n + np.diag(free)
            move = -np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0]
            best[i], before[i] = loss, now[i]
            if np.abs(gradient).max() < tolerance or np.abs(move).max() < tolerance * max(1, np.abs(now[i]).max()):
                done[i] = True
            else:
                now[i] = now[i] + move
        state.unpersist()
    data.unpersist()
    if not any(done):
        raise ValueError("no fit converged")
    table = []
    for (s, k), a, b, ok, loss in zip(jobs, at, before, done, best, strict=True):
        beta = np.zeros(len(columns))
        beta[a] = b[1:] / scales[k][a]
        table.append((folds[k], s.model, float(s.lam), float(b[0] - (beta * means[k]).sum()), beta.tolist(), int(first[k][0]), float(loss), count, ok))
    out = spark.createDataFrame(table, PARAMETERS)
    return Fits(out, columns, tuple(files.fingerprint(out).first()))


class WideFits:
    """Parameters of fits on a wide vector column: a row a (fold, lam, block of coefficients)."""

    def __init__(self, table: DataFrame, width: int):
        self.table, self.width = table, width

    def predict(self, rows: DataFrame, vector: str, chosen: DataFrame | None = None, eta: str = "eta") -> DataFrame:
        """rows with lam and the linear predictor of every fit of their fold (or those of chosen: fold, lam)."""
        table = self.table if chosen is None else self.table.join(chosen.select("fold", "lam"), ["fold", "lam"], "left_semi")
        # a row a fit, of the width that the vector column has
        out = rows.join(F.broadcast(table.select("fold", "lam", F.col("intercept").alias("_b"), F.col("beta").alias("_beta"))), "fold")
        dot = F.aggregate(F.zip_with(vector, "_beta", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return out.withColumn(eta, F.col("_b") + dot).drop("_b", "_beta")


def fit_wide(rows: DataFrame, vector: str, y: Column | str, lambdas, family: str = "gamma", history: int = 10, passes: int = 400, tolerance: float = 1e-7) -> WideFits:
    """One vector column of any width by limited-memory quasi-Newton steps, all folds and penalties in each pass.

    A pass sums the losses and gradients (width numbers a fit); no matrix of
    width^2 is formed, so thousands of columns are no matter. Objective,
    standardisation and penalty are those of fit. An error if a vector has
    another width or a value that is not finite, or if a fit does not converge.
    """
    measure, start = FAMILIES[family]
    y = F.col(y) if isinstance(y, str) else y
    spark = rows.sparkSession
    data = rows.select("fold", F.col(vector).cast("array<double>").alias("x"), y.cast("double").alias("y"), F.lit(1.0).alias("w")).filter("y IS NOT NULL").persist()
    shape = data.groupBy("fold").agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b"), F.count_if(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).alias("bad")).collect()
    folds = sorted(r["fold"] for r in shape)
    if not folds or len({r[c] for r in shape for c in "ab"}) != 1 or any(r["bad"] for r in shape):
        raise ValueError("no rows, vectors of several widths, or values that are not finite")
    width = shape[0]["a"]
    first = _summed(data, lambda batch: ((folds.index(f), np.concatenate([[len(t), t.sum()], x.sum(0)])) for f, x, t, _ in _folds_of(batch)))
    means = {k: m[2:] / m[0] for k, m in first.items()}
    spread = _summed(data, lambda batch: ((folds.index(f), ((x - means[folds.index(f)]) ** 2).sum(0)) for f, x, _, _ in _folds_of(batch)))
    scales = {k: np.sqrt(v / first[k][0]) for k, v in spread.items()}
    scales = {k: np.where(v > 1e-12, v, np.inf) for k, v in scales.items()}
    fitted = spark.sparkContext.broadcast((means, scales))
    jobs = [(k, float(lam)) for k in range(len(folds)) for lam in lambdas]
    now = [np.concatenate([[start(first[k][1] / first[k][0])], np.zeros(width)]) for k, _ in jobs]
    free = [np.append(0.0, np.full(width, 2 * lam / first[k][0])) for k, lam in jobs]
    state: list[dict] = [{"at": None, "pairs": [], "done": False, "step": 1.0} for _ in jobs]

    count = 0
    while count < passes and not all(s["done"] for s in state):
        count += 1
        points = spark.sparkContext.broadcast({k: [(i, now[i]) for i, (j, _) in enumerate(jobs) if j == k and not state[i]["done"]] for k in range(len(folds))})

        def step(batch):
            m, v = fitted.value
            for f, x, t, _ in _folds_of(batch):
                k = folds.index(f)
                mine = points.value[k]  # noqa: B023
                if mine:
                    z = (x - m[k]) / v[k]
                    for i, eta in zip([i for i, _ in mine], (z @ np.array([b[1:] for _, b in mine]).T + np.array([b[0] for _, b in mine])).T, strict=True):
                        loss, d, _ = measure(eta, t)
                        yield i, np.concatenate([[loss.sum(), d.sum()], z.T @ d])

        for i, sums in _summed(data, step).items():
            s, n = state[i], first[jobs[i][0]][0]
            loss, gradient = sums[0] / n + (free[i] * now[i] ** 2).sum() / 2, sums[1:] / n + free[i] * now[i]
            if s["at"] is not None and not loss <= s["loss"] + 1e-4 * s["step"] * s["slope"] + 1e-13 * abs(s["loss"]):
                s["step"] /= 2
                if s["step"] < 1e-12:
                    now[i], s["done"] = s["at"], np.abs(s["gradient"]).max() < 1e3 * tolerance
                    if not s["done"]:
                        raise ValueError("a wide fit did not converge")
                else:
                    now[i] = s["at"] + s["step"] * s["move"]
                continue
            if s["at"] is not None:
                a, b = now[i] - s["at"], gradient - s["gradient"]
                if a @ b > 1e-14 * (b @ b) ** 0.5 * (a @ a) ** 0.5:
                    s["pairs"] = [*s["pairs"], (a, b)][-history:]
            s |= {"at": now[i], "loss": loss, "gradient": gradient}
            if np.abs(gradient).max() < tolerance:
                s["done"] = True
                continue
            q, used = gradient.copy(), []
            for a, b in reversed(s["pairs"]):
                used.append((a @ q) / (a @ b))
                q = q - used[-1] * b
            if s["pairs"]:
                a, b = s["pairs"][-1]
                q = q * ((a @ b) / (b @ b))
            else:
                q = q / max(1.0, np.abs(gradient).sum())
            for (a, b), c in zip(s["pairs"], reversed(used), strict=True):
                q = q + (c - (b @ q) / (a @ b)) * a
            s |= {"move": -q, "slope": -(gradient @ q), "step": 1.0}
            now[i] = now[i] - q
        points.unpersist()
    data.unpersist()
    if not all(s["done"] for s in state):
        raise ValueError("a wide fit did not converge")
    table = []
    for i, (k, lam) in enumerate(jobs):
        beta = now[i][1:] / scales[k]
        table.append((folds[k], lam, float(now[i][0] - beta @ means[k]), beta.tolist(), count))
    return WideFits(spark.createDataFrame(table, "fold string, lam double, intercept double, beta array<double>, passes int"), width)
