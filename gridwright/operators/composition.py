"""Dirichlet regression of compositions on groups and covariates.

The likelihood depends on the rows through counts and sums of logarithms per
different row of the design only. Spark adds those up; the driver holds a row
per different design (one per group without covariates) and fits on them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different rows of a design held by the driver. Groups alone give one each; beyond the bound covariates are to be binned.
MAX_DESIGNS = 100_000


@dataclass
class Regression:
    levels: list
    coefficients: np.ndarray
    log_likelihood: float
    null_log_likelihood: float
    degrees: int

    @property
    def ratio(self) -> float:
        return 2.0 * (self.log_likelihood - self.null_log_likelihood)

    @property
    def p(self) -> float:
        return chi2_tail(max(self.ratio, 0.0), self.degrees)


def design(rows: DataFrame, levels: list, group: str = "grp", covariates: tuple[str, ...] = ()) -> DataFrame:
    """Adds x: 1, an indicator of every level but the last, the covariates."""
    parts = [F.lit(1.0), *[(F.col(group) == F.lit(g)).cast("double") for g in levels[:-1]], *[F.col(c).cast("double") for c in covariates]]
    return rows.withColumn("x", F.array(*parts))


def log_sums(rows: DataFrame, parts: int) -> DataFrame:
    """(x, n, s): rows and sums of the logarithms of ``parts`` shares (column v, closed to 1) per different x."""
    clipped = F.transform("v", lambda p: F.least(F.greatest(p, F.lit(1e-10)), F.lit(1.0)))
    closed = rows.select("x", clipped.alias("v")).withColumn("t", F.aggregate("v", F.lit(0.0), lambda a, b: a + b))
    return closed.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.ln(F.get("v", F.lit(i)) / F.col("t"))) for i in range(parts)]).alias("s"))


def digamma(x: np.ndarray) -> np.ndarray:
    """The recurrence up to arguments above 8, then the asymptotic series (error below 1e-11)."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(8):
        out -= 1.0 / x
        x += 1.0
    z = 1.0 / (x * x)
    return out + np.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240)))


def chi2_tail(x: float, degrees: int) -> float:
    """P(chi square > x) for a whole number of degrees: a finite sum, plus the error function if the number is odd."""
    y, odd = x / 2, degrees % 2
    if y == 0:
        return 1.0
    first = math.erfc(math.sqrt(y)) if odd else 0.0
    return min(1.0, first + sum(math.exp((i + odd / 2) * math.log(y) - y - math.lgamma(i + odd / 2 + 1)) for i in range((degrees - odd) // 2)))


def _minimum(f, start: np.ndarray, steps: int = 500) -> tuple[np.ndarray, float]:
    """Quasi-Newton descent with halved steps; ``f`` gives value and gradient."""
    at, (value, slope) = start, f(start)
    inverse = np.eye(len(at)) / max(np.linalg.norm(slope), 1.0)
    for _ in range(steps):
        if np.abs(slope).max() < 1e-7 * (1 + abs(value)):
            break
        way = -inverse @ slope
        if way @ slope >= 0:
            inverse = np.eye(len(at)) / max(np.linalg.norm(slope), 1.0)
            way = -inverse @ slope
        size = 1.0
        while size > 1e-12 and (new := f(at + size * way))[0] > value + 1e-4 * size * (way @ slope):
            size /= 2
        if size <= 1e-12:
            break
        s, y = size * way, new[1] - slope
        at, (value, slope) = at + s, new
        if s @ y > 1e-14:
            left = np.eye(len(at)) - np.outer(s, y) / (s @ y)
            inverse = left @ inverse @ left.T + np.outer(s, s) / (s @ y)
    return at, value


def fitted(x: np.ndarray, n: np.ndarray, s: np.ndarray, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """(coefficients, penalised log likelihood) of a log link; intercepts, which start at the mean logarithms' shares, are not penalised."""
    k = s.shape[1]
    lgamma = np.vectorize(math.lgamma, otypes=[float])

    def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
        b = flat.reshape(x.shape[1], k)
        raw = x @ b
        a = np.exp(np.clip(raw, -10.0, 10.0))
        total = a.sum(1)
        ll = (n * (lgamma(total) - lgamma(a).sum(1))).sum() + ((a - 1.0) * s).sum()
        inner = (n[:, None] * (digamma(total)[:, None] - digamma(a)) + s) * a * (np.abs(raw) < 10.0)
        pull = np.vstack([np.zeros((1, k)), b[1:]])
        return float(l2 * (pull**2).sum() - ll), (2 * l2 * pull - x.T @ inner).ravel()

    mean = np.exp(s.sum(0) / n.sum())
    start = np.zeros((x.shape[1], k))
    start[0] = np.log(np.clip(mean / mean.sum(), 1e-6, 1.0))
    best, value = _minimum(loss, start.ravel())
    return best.reshape(x.shape[1], k), -value


def dirichlet(rows: DataFrame, parts: int, group: str = "grp", covariates: tuple[str, ...] = (), l2: float = 1e-3) -> Regression:
    """Fit and likelihood-ratio test of ``rows`` (v, grp, covariates); rows with a null among them are left out, and the last level is the reference."""
    whole = rows.dropna(subset=["v", group, *covariates])
    levels = [r[0] for r in whole.select(group).distinct().orderBy(group).limit(MAX_DESIGNS + 1).collect()]
    found = log_sums(design(whole, levels, group, covariates), parts).orderBy("x").limit(MAX_DESIGNS + 1).collect()
    if len(found) > MAX_DESIGNS:
        raise ValueError(f"more than {MAX_DESIGNS} different rows of the design")
    if not found:
        raise ValueError("no rows")
    x, n, s = (np.array([r[c] for r in found], float) for c in ("x", "n", "s"))
    full, ll = fitted(x, n, s, l2)
    _, null = fitted(np.ones((1, 1)), n.sum(keepdims=True), s.sum(0, keepdims=True), l2)
    return Regression(levels, full, ll, null, (x.shape[1] - 1) * parts)
