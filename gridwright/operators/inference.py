"""Rank tests, bootstrap intervals and the gap statistic.

A bootstrap works on cells of any number: each task keeps sums per resample, with
Poisson(1) weights drawn from a hash of the row, the usual form of the bootstrap
for data that no task can hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.results import written
from . import mixture
from .permutations import mixed

#: Chances of at most 0, 1, 2, ... under a mean of 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def poisson_weights(rows: np.ndarray, n: int) -> np.ndarray:
    """[row, resample]: Poisson(1) numbers that depend on the rows' hashes and the resample alone."""
    with np.errstate(over="ignore"):
        h = mixed(rows.astype(np.uint64)[:, None] + np.arange(1, n + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15))
    return np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(float) / float(1 << 53), "right").astype(float)


def rank_sum_p(u: str, n1: str = "n1", n2: str = "n2"):
    """Two-sided normal approximation of the rank-sum test, with continuity correction and without ties.

    The error function is the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7).
    """
    mean = F.col(n1) * F.col(n2) / 2
    sd = F.sqrt(F.col(n1) * F.col(n2) * (F.col(n1) + F.col(n2) + 1) / 12)
    z = F.greatest((F.abs(F.col(u) - mean) - 0.5) / sd, F.lit(0.0)) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-z * z))


def bootstrap_means(points: DataFrame, keys: list[str], n_boot: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(g, i, mean, lo, hi): percentile interval of each group's mean of component i of ``points`` (g, v, keys...).

    A row's weights depend on its keys and the seed alone, not on files or tasks.
    """
    ids = points.select("g", "v", F.xxhash64(F.lit(seed), *keys, "v").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            g = np.array(batch.column(0).to_pylist(), dtype=object)
            x = np.array(batch.column(1).to_pylist(), float)
            w = poisson_weights(batch.column(2).to_numpy(), n_boot)
            for name in pd.unique(g):
                here = g == name
                ww = np.hstack([np.ones((here.sum(), 1)), w[here]])
                part = np.hstack([ww.sum(0)[:, None], ww.T @ x[here]])
                total[name] = part if name not in total else total[name] + part
        for name, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(range(len(part)), pa.int32()), pa.array(part.tolist(), pa.list_(pa.float64()))], names=["g", "b", "s"])

    sums = ids.select(F.col("g").cast("string"), "v", "h").mapInArrow(run, "g string, b int, s array<double>")
    flat = sums.select("g", "b", F.element_at("s", 1).alias("w"), F.posexplode(F.slice("s", 2, 1 << 20)).alias("i", "x")).groupBy("g", "b", "i").agg((F.sum("x") / F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    return flat.groupBy("g", "i").agg(  # n_boot + 1 rows a group and component
        F.max(F.when(F.col("b") == 0, F.col("m"))).alias("mean"), F.percentile(F.when(F.col("b") > 0, F.col("m")), F.lit(tail)).alias("lo"), F.percentile(F.when(F.col("b") > 0, F.col("m")), F.lit(1 - tail)).alias("hi"))


def gap_statistic(points: DataFrame, ks: list[int], refs: int = 5, seed: int = 35) -> DataFrame:
    """(g, k, gap, s) of ``points`` (g, v): log inertia of uniform references in the bounding box against that of the data.

    The references of all groups are generated by Spark from hashes of the
    rows' numbers and clustered in the same passes as each other.
    """
    spark, schema = points.sparkSession, "g string, k int, gap double, s double"
    points = points.select(F.col("g").cast("string").alias("g"), "v")
    first = points.first()
    if first is None:
        return spark.createDataFrame([], schema)
    d = len(first["v"])
    box = points.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(F.col("v")[i]) for i in range(d)]).alias("lo"), F.array(*[F.max(F.col("v")[i]) for i in range(d)]).alias("hi"))
    rows = points.groupBy("g").count().select("g", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("row")).join(box, "g")

    def draw(i: int):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + i), "g", "ref", "row"), 12).cast("double") + 0.5) / float(1 << 52)
        return F.col("lo")[i] + u * (F.col("hi")[i] - F.col("lo")[i])

    made = rows.select("g", "row", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(refs - 1))).alias("ref")).select(F.concat_ws("|", "g", F.col("ref").cast("string")).alias("g"), F.array(*[draw(i) for i in range(d)]).alias("v"))
    made = written(made, "gap-references")
    own = {(g, k): math.log(c + 1e-10) for (g, k, _), (_, c) in sorted(mixture.kmeans_all(points, ks, seed, restarts=1).items())}
    ref: dict = {}
    for (name, k, _), (_, c) in mixture.kmeans_all(made, ks, seed, restarts=1).items():
        ref.setdefault((name.rpartition("|")[0], k), []).append(math.log(c + 1e-10))
    table = [(g, k, float(np.mean(ref[g, k]) - w), float(np.std(ref[g, k]) * math.sqrt(1 + 1 / refs))) for (g, k), w in own.items()]
    return spark.createDataFrame(table, schema)
