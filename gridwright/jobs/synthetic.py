"""Synthetic subjects: ellipses of cells whose parameters mix a few habitat types.

Everything is a column expression: positions come from sequences, mixing
weights from distances to seeds, and noise from hashes of (seed, subject, cell,
parameter), so a rerun gives the same cells on any cluster.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = 128


@dataclass(frozen=True)
class Habitat:
    x: float
    y: float
    sigma: float
    weight: float
    means: dict[str, float] = field(default_factory=dict)
    sds: dict[str, float] = field(default_factory=dict)


def uniform(seed: int, *cols: Column | str) -> Column:
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12)
    return (h.cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, *cols: Column | str) -> Column:
    """Box-Muller from two hashed uniforms."""
    return F.sqrt(-2 * F.ln(uniform(seed, *cols))) * F.cos(2 * 3.141592653589793 * uniform(seed + 1, *cols))


def subject(spark: SparkSession, name: str, habitats: list[Habitat], radius: int, slices: int, seed: int = 42, noise: float = 0.0) -> DataFrame:
    """Long cells (subject, param, roi, slice, x, y, value) with ``truth``, the type of the largest mixing weight."""
    cells = spark.range(GRID * GRID * slices).select(
        F.lit(name).alias("subject"), (F.col("id") % GRID + 1).cast("int").alias("x"), (F.floor(F.col("id") / GRID) % GRID + 1).cast("int").alias("y"), (F.floor(F.col("id") / (GRID * GRID)) + 1).cast("int").alias("slice"))
    r = radius * F.sin(F.col("slice") / (slices + 1.0) * 3.141592653589793)
    c = GRID / 2
    cells = cells.where((F.col("x") - c) ** 2 + (F.col("y") - c) ** 2 <= r * r)
    logits = F.array(*[F.ln(F.lit(h.weight)) - ((F.col("x") - c - h.x * radius) ** 2 + (F.col("y") - c - h.y * radius) ** 2) / (2 * (h.sigma * radius) ** 2) for h in habitats])
    cells = cells.withColumn("l", logits).withColumn("w", F.transform("l", lambda z: F.exp(z - F.array_max("l"))))
    cells = cells.withColumn("w", F.transform("w", lambda z: z / F.aggregate("w", F.lit(0.0), lambda a, b: a + b)))
    params = list(habitats[0].means)
    key = ["subject", "slice", "x", "y"]
    values = []
    for p in params:
        draws = [F.get("w", F.lit(i)) * (h.means[p] + normal(seed + 10 * i, *key, F.lit(p)) * (h.sds[p] + noise * abs(h.means[p]))) for i, h in enumerate(habitats)]
        v = sum(draws[1:], draws[0])
        values.append(F.struct(F.lit(p).alias("param"), (F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) if "FA" in p else F.greatest(v, F.lit(0.001))).alias("value")))
    truth = F.array_position("w", F.array_max("w")).cast("int") - 1
    return cells.select(*key, F.lit("ALL").alias("roi"), truth.alias("truth"), F.inline(F.array(*values)))


def cohort(spark: SparkSession, configs: dict[str, tuple[list[Habitat], int, int]], seed: int = 42) -> DataFrame:
    """All subjects of ``configs`` (name: (habitats, radius, slices)) in one table."""
    out = None
    for i, (name, (habitats, radius, slices)) in enumerate(configs.items()):
        one = subject(spark, name, habitats, radius, slices, seed + 1000 * i)
        out = one if out is None else out.unionByName(one)
    return out
