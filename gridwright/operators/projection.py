"""Principal axes of any number of rows, and places of rows on them.

Tasks add up products of components; one row of sums reaches the driver, where
the axes (components x components numbers) are found. Rows are projected by a
column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axes:
    mean: np.ndarray
    vectors: np.ndarray  # a row an axis
    variances: np.ndarray
    total: float


def axes(rows: DataFrame, k: int, value: str = "v") -> Axes:
    """The ``k`` axes of largest variance of ``rows`` (v). Of each axis the largest component by size (of equal ones the first) is positive."""
    first = rows.where(F.col(value).isNotNull()).select(F.size(value)).first()
    d = first[0] if first else 0
    if not d:
        return Axes(np.zeros(0), np.zeros((0, 0)), np.full(k, np.nan), 0.0)  # no axes, and no shares
    v = [F.col(value)[i] for i in range(d)]
    mean = np.array(rows.agg(*[F.avg(x) for x in v]).first(), float)
    c = [x - float(m) for x, m in zip(v, mean, strict=True)]  # around the mean, so that products lose no digits
    upper = rows.agg(*[F.avg(c[i] * c[j]) for i in range(d) for j in range(i, d)]).first()
    cov = np.zeros((d, d))
    cov[np.triu_indices(d)] = upper
    cov = cov + np.triu(cov, 1).T
    variance, vector = np.linalg.eigh(cov)
    order = np.argsort(variance)[::-1]
    vector = vector[:, order].T
    lead = np.array([np.flatnonzero(np.abs(x) >= np.abs(x).max() - 1e-12)[0] for x in vector])
    sign = np.where(vector[np.arange(d), lead] < 0, -1.0, 1.0)
    return Axes(mean, (vector * sign[:, None])[:k], np.maximum(variance[order], 0.0)[:k], float(np.trace(cov)))


def explained(found: Axes) -> DataFrame:
    """(axis, share) of the variance; shares of no rows are NULL."""
    from pyspark.sql import SparkSession

    rows = [(i, None if np.isnan(x) else float(x / found.total) if found.total > 0 else 0.0) for i, x in enumerate(found.variances)]
    return SparkSession.active().createDataFrame(rows, "axis int, share double")


def project(rows: DataFrame, found: Axes, value: str = "v") -> DataFrame:
    """Adds ``pc``, the place on each axis."""
    def place(axis: np.ndarray):
        terms = [(F.col(value)[i] - float(m)) * float(a) for i, (a, m) in enumerate(zip(axis, found.mean, strict=True))]
        return sum(terms[1:], terms[0])

    return rows.withColumn("pc", F.array(*[place(a) for a in found.vectors]).cast("array<double>"))


def boundary_places(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n, pc0, pc1): cells that touch another habitat, by own (a) and other habitat (b): how many, and their mean place.

    ``rows`` (subject, slice, x, y, habitat, pc); ``edges`` from :func:`spatial.neighbour_pairs`.
    """
    e = edges.where("own <> other")
    place = lambda x, y, other: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(other).alias("beside"))
    sides = e.select("subject", "slice", F.inline(F.array(place("x0", "y0", "other"), place("x", "y", "own")))).distinct()
    j = rows.join(sides, ["subject", "slice", "x", "y"])
    return j.groupBy(F.col("habitat").alias("a"), F.col("beside").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.get("pc", F.lit(0))).alias("pc0"), F.avg(F.get("pc", F.lit(1))).alias("pc1"))
