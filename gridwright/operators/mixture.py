"""Gaussian mixtures and k-means for many groups at once.

One pass over the cells per step serves all groups: each task adds up the
sufficient statistics of its rows under the current parameters (k numbers,
k x d means and k x d x d products per group) and only those leave it. A group
may be as large as the table; none is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Groups whose parameters are held at once, each k x (1 + d + d^2) numbers.
MAX_GROUPS = 10_000


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    log_likelihood: float = -np.inf
    n: float = 0.0

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) of each row under each component."""
        d = x.shape[1]
        out = np.empty((len(x), len(self.weights)))
        for j, (w, m, c) in enumerate(zip(self.weights, self.means, self.covs, strict=True)):
            low = np.linalg.cholesky(c)
            z = np.linalg.solve(low, (x - m).T)
            out[:, j] = np.log(max(w, 1e-300)) - 0.5 * (d * np.log(2 * np.pi) + (z * z).sum(0)) - np.log(np.diag(low)).sum()
        return out

    def posteriors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ld = self.log_density(x)
        top = ld.max(1, keepdims=True)
        p = np.exp(ld - top)
        total = p.sum(1, keepdims=True)
        return p / total, (top + np.log(total))[:, 0]

    def bic_of(self, n: float, log_likelihood: float) -> float:
        """The criterion on n rows with this likelihood."""
        k, d = self.means.shape
        free = k - 1 + k * d + k * d * (d + 1) // 2
        return -2 * log_likelihood + free * np.log(max(n, 1.0))

    def bic(self) -> float:
        return self.bic_of(self.n, self.log_likelihood)


def nothing() -> Mixture:
    """The mixture of no rows: it has no components."""
    return Mixture(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0, 0)))


Key = tuple[str, int, int]  # group, number of components, restart


def _sums(points: DataFrame, models: dict[Key, object], weigh) -> dict[Key, np.ndarray]:
    """For each model the sum of ``weigh(model, x)`` over the rows x of its group. All models share one pass."""
    of_group: dict[str, list[Key]] = {}
    for key in models:
        of_group.setdefault(key[0], []).append(key)
    if len(of_group) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")

    def packed(total: dict[Key, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if total:
            keys = list(total)
            cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64()), pa.array([total[k].tobytes() for k in keys], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["g", "k", "r", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[Key, np.ndarray] = {}
        for batch in batches:
            groups = np.array(batch.column(0).to_pylist(), dtype=object)
            rows = batch.column(1).to_pylist()
            for g in pd.unique(groups):
                x = np.array([rows[i] for i in np.flatnonzero(groups == g)], dtype=float)  # groups may differ in length
                for key in of_group.get(g, ()):
                    part = np.concatenate([np.ravel(a) for a in weigh(models[key], x)])
                    total[key] = part if key not in total else total[key] + part
        yield from packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[Key, np.ndarray] = {}
        for batch in batches:
            for g, k, r, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[g, k, r] = total.get((g, k, r), 0) + np.frombuffer(s)
        yield from packed(total)

    part = points.select(F.col("g").cast("string"), "v").mapInArrow(run, "g string, k long, r long, s binary")
    rows = part.repartition("g", "k", "r").mapInArrow(add, "g string, k long, r long, s binary").collect()  # a row per model
    return {(r["g"], r["k"], r["r"]): np.frombuffer(r["s"]) for r in rows}


def seeds(points: DataFrame, ks: list[int], restarts: int, seed: int) -> dict[Key, np.ndarray]:
    """k rows of each group for every k and restart, from rows chosen by a seeded hash; fewer if there are fewer different rows."""
    most = 4 * max(ks, default=1) * restarts
    h = F.xxhash64(F.lit(seed), "g", "v")
    few = points.select(F.col("g").cast("string").alias("g"), "v", h.alias("h")).groupBy("g", F.pmod("h", F.lit(most)).alias("b")).agg(F.min(F.struct("h", "v")).alias("m"))
    rows = few.groupBy("g").agg(F.sort_array(F.collect_list("m")).alias("m")).collect()  # ``most`` rows per group
    out: dict[Key, np.ndarray] = {}
    for row in rows:
        cand = np.unique(np.array([x["v"] for x in row["m"]], float), axis=0)
        for k in ks:
            for r in range(restarts):
                pick = [int(np.random.default_rng(seed + r).integers(len(cand)))]
                while len(pick) < min(k, len(cand)):  # farthest first
                    pick.append(int(((cand[:, None] - cand[pick][None]) ** 2).sum(2).min(1).argmax()))
                out[row["g"], k, r] = cand[pick]
    return out


def kmeans_all(points: DataFrame, ks: list[int], seed: int = 35, restarts: int = 3, steps: int = 20) -> dict[Key, tuple[np.ndarray, float]]:
    """(centres, cost) of every group, k and restart of ``points`` (g, v)."""
    centres = seeds(points, ks, restarts, seed)
    cost: dict[Key, float] = {}

    def weigh(c: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        one = np.eye(len(c))[d.argmin(1)]
        return [one.sum(0), one.T @ x, np.array([d.min(1).sum()])]

    for _ in range(steps):
        moved = 0.0
        for key, flat in _sums(points, centres, weigh).items():
            k, d = centres[key].shape
            n, s = flat[:k], flat[k : k + k * d].reshape(k, d)
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres[key])
            moved = max(moved, float(np.abs(new - centres[key]).max()))
            centres[key], cost[key] = new, float(flat[-1])
        if moved < 1e-4:
            break
    return {key: (c, cost.get(key, 0.0)) for key, c in centres.items()}


def kmeans(points: DataFrame, k: int, seed: int = 35, restarts: int = 3, steps: int = 20) -> dict[str, tuple[np.ndarray, float]]:
    """(centres, cost) of each group: the best of several seeded starts."""
    best: dict[str, tuple[np.ndarray, float]] = {}
    for (g, _, _), (c, cost) in sorted(kmeans_all(points, [k], seed, restarts, steps).items()):
        if g not in best or cost < best[g][1]:
            best[g] = (c, cost)
    return best


def fit_all(points: DataFrame, ks: list[int], seed: int = 35, restarts: int = 1, steps: int = 30, reg: float = 1e-6, tol: float = 1e-3) -> dict[tuple[str, int], Mixture]:
    """A full-covariance mixture for every group and k, started from k-means; the likelihood never falls. The best restart is kept."""
    start = {key: c for key, (c, _) in kmeans_all(points, ks, seed, restarts, steps=8).items()}
    now: dict[Key, object] = dict(start)

    def weigh(model, x: np.ndarray) -> list[np.ndarray]:
        if isinstance(model, Mixture):
            p, ll = model.posteriors(x)
        else:
            p, ll = np.eye(len(model))[((x[:, None] - model[None]) ** 2).sum(2).argmin(1)], np.zeros(len(x))
        return [p.sum(0), p.T @ x, np.einsum("nk,ni,nj->kij", p, x, x), np.array([ll.sum(), len(x)])]

    for step in range(steps):
        gain = 0.0
        for key, flat in _sums(points, now, weigh).items():
            k, d = start[key].shape
            n = np.maximum(flat[:k], 1e-10)
            m = flat[k : k + k * d].reshape(k, d) / n[:, None]
            c = flat[k + k * d : -2].reshape(k, d, d) / n[:, None, None] - np.einsum("ki,kj->kij", m, m) + reg * np.eye(d)
            was = now[key].log_likelihood if step > 1 else -np.inf
            now[key] = Mixture(n / n.sum(), m, c, float(flat[-2]) if step else -np.inf, float(flat[-1]))
            gain = max(gain, (now[key].log_likelihood - was) / now[key].n) if step else np.inf
        if gain < tol:
            break
    best: dict[tuple[str, int], Mixture] = {}
    for (g, k, _), m in sorted(now.items(), key=lambda x: x[0]):
        if (g, k) not in best or m.log_likelihood > best[g, k].log_likelihood:
            best[g, k] = m
    return best


def fit(points: DataFrame, k: int, seed: int = 35, restarts: int = 1, steps: int = 30) -> dict[str, Mixture]:
    return {g: m for (g, _), m in fit_all(points, [k], seed, restarts, steps).items()}


def evaluate(points: DataFrame, models: dict[tuple[str, int], Mixture]) -> dict[tuple[str, int], tuple[float, float, float]]:
    """(rows, log likelihood, entropy of the posteriors) of each model on all rows of its group, in one pass."""
    def weigh(model: Mixture, x: np.ndarray) -> list[np.ndarray]:
        p, ll = model.posteriors(x)
        return [np.array([len(x), ll.sum(), -(p * np.log(p + 1e-300)).sum()])]

    return {(g, k): tuple(map(float, s)) for (g, k, _), s in _sums(points, {(g, k, 0): m for (g, k), m in models.items()}, weigh).items()}


def silhouettes(points: DataFrame, models: dict[tuple[str, int], Mixture | np.ndarray]) -> dict[tuple[str, int], float]:
    """Mean silhouette of each (group, k) over all rows of its group, by squared distances; -1 where only one cluster has rows.

    The mean squared distance of a row to a cluster follows from the cluster's count, sum and sum of squares, so two
    passes over the rows do, whatever their number. Models are mixtures or centres.
    """
    def ones(model: Mixture | np.ndarray, x: np.ndarray) -> np.ndarray:
        near = model.posteriors(x)[0].argmax(1) if isinstance(model, Mixture) else ((x[:, None] - model[None]) ** 2).sum(2).argmin(1)
        return np.eye(len(model.weights) if isinstance(model, Mixture) else len(model))[near]

    def moments(model, x: np.ndarray) -> list[np.ndarray]:
        one = ones(model, x)
        return [one.sum(0), one.T @ (x * x).sum(1), one.T @ x]

    seen = {}
    for key, flat in _sums(points, {(g, k, 0): m for (g, k), m in models.items()}, moments).items():
        k = len(models[key[:2]].weights) if isinstance(models[key[:2]], Mixture) else len(models[key[:2]])
        seen[key] = (models[key[:2]], flat[:k], flat[k : 2 * k], flat[2 * k :].reshape(k, -1))

    def score(stats, x: np.ndarray) -> list[np.ndarray]:
        model, n, squares, sums = stats
        one = ones(model, x).astype(bool)
        total = np.maximum(n * (x * x).sum(1)[:, None] - 2 * x @ sums.T + squares, 0)
        own_n = np.broadcast_to(n, one.shape)[one]
        own = total[one] / np.maximum(own_n - 1, 1)
        other = np.where(one | (n == 0), np.inf, total / np.maximum(n, 1)).min(1)
        top = np.maximum(own, np.where(np.isinf(other), 0, other))
        s = np.where((own_n > 1) & (top > 0) & np.isfinite(other), (np.where(np.isinf(other), 0, other) - own) / np.where(top > 0, top, 1), 0.0)
        return [np.array([s.sum(), len(x)])]

    result = _sums(points, seen, score)
    return {(g, k): float(s[0] / s[1]) if (seen[g, k, 0][1] > 0).sum() > 1 else -1.0 for (g, k, _), s in result.items()}


def of_labels(points: DataFrame, label: str = "label", reg: float = 1e-6) -> Mixture:
    """The mixture whose components are the labels' shares, means and covariances in ``points`` (label, v); one pass, a row per label on the driver."""
    first = points.first()
    if first is None:
        return nothing()
    d = len(first["v"])
    v = [F.get("v", F.lit(i)) for i in range(d)]
    rows = points.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(x) for x in v]).alias("m"), F.array(*[F.covar_pop(a, b) for a in v for b in v]).alias("c")).orderBy(label).collect()
    n = np.array([r["n"] for r in rows], float)
    return Mixture(n / n.sum(), np.array([r["m"] for r in rows]), np.array([r["c"] for r in rows]).reshape(-1, d, d) + reg * np.eye(d), n=float(n.sum()))


def score(points: DataFrame, model: Mixture) -> DataFrame:
    """Adds proba, label, d (distances to the means), confidence and ambiguous to ``points`` (v, ...), batch or stream.

    The model's numbers become literals, so all of it runs in the JVM; its size is k (1 + d + d^2). Without components
    the arrays are empty and label and confidence NULL.
    """
    k, d = model.means.shape
    parts = []
    for w, m, c in zip(model.weights, model.means, model.covs, strict=True):
        low = np.linalg.cholesky(c)
        inverse = np.linalg.inv(low)
        const = float(np.log(max(w, 1e-300)) - 0.5 * d * np.log(2 * np.pi) - np.log(np.diag(low)).sum())
        z = [sum((F.lit(float(inverse[i, j])) * (F.get("v", F.lit(j)) - float(m[j])) for j in range(i + 1)), F.lit(0.0)) for i in range(d)]
        parts.append(F.lit(const) - sum((x * x for x in z), F.lit(0.0)) / 2)
    p = points.withColumn("_l", F.array(*parts).cast("array<double>")).withColumn("_e", F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))))
    p = p.withColumn("proba", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))).drop("_e")
    p = p.withColumn("label", F.array_position("_l", F.array_max("_l")).cast("int") - 1).drop("_l")
    second = F.get(F.reverse(F.array_sort("proba")), F.lit(1))
    apart = F.array(*[X.euclidean(F.col("v"), F.array(*[F.lit(float(x)) for x in m])) for m in model.means])
    return p.withColumns({"d": apart.cast("array<double>"), "confidence": F.array_max("proba"), "ambiguous": F.coalesce(second > 0.30, F.lit(False))})


def predict(points: DataFrame, models: dict[str, Mixture]) -> DataFrame:
    """Adds proba and label to ``points`` (g, v, ...)."""
    shared = points.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("array<double>")
    def proba(g: pd.Series, v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(g), dtype=object)
        for name in pd.unique(g):
            here = np.flatnonzero(g.to_numpy() == name)
            p, _ = shared.value[name].posteriors(np.array(v.iloc[here].tolist(), float))
            for i, row in zip(here, p, strict=True):
                out.iat[i] = row.tolist()
        return out

    p = points.withColumn("proba", proba(F.col("g").cast("string"), "v"))
    return p.withColumn("label", F.array_position("proba", F.array_max("proba")).cast("int") - 1)


def choose_k(points: DataFrame, ks: list[int], seed: int = 35, steps: int = 15) -> DataFrame:
    """(g, k, bic) for each k, as a small table for :mod:`selection`."""
    rows = [(g, k, float(m.bic())) for (g, k), m in fit_all(points, ks, seed, steps=steps).items()]
    return points.sparkSession.createDataFrame(rows, "g string, k int, bic double")
