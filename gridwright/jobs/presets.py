"""Seven presets of synthetic subjects with planted habitats, expanded by Spark from a table of subjects.

A preset is a row: radius, slices, noise and seeds, each with its habitat type's means and deviations. Subjects name
their preset and place; cells, truth and values follow as column expressions, so any number of subjects can be made.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .synthetic import GRID, normal, uniform

# Parameters, and mean and deviation of each of them by habitat type.
PARAMETERS = ("DTI-AD", "DTI-FA", "DTI-MD", "DTI-RD", "T2star", "MTR", "T2")
BIOLOGY = {
    "necrotic": ((1650.0, 280.0), (0.033, 0.014), (1420.0, 210.0), (1560.0, 230.0), (7.5, 2.8), (19.0, 4.5), (68.0, 12.0)),
    "hypoxic": ((920.0, 110.0), (0.072, 0.022), (830.0, 95.0), (870.0, 100.0), (11.5, 3.2), (27.0, 5.0), (42.0, 8.0)),
    "proliferative": ((640.0, 75.0), (0.092, 0.024), (575.0, 68.0), (605.0, 72.0), (14.0, 3.0), (36.0, 5.0), (29.0, 5.0)),
    "viable": ((730.0, 88.0), (0.135, 0.030), (665.0, 78.0), (695.0, 82.0), (18.5, 4.0), (30.0, 5.0), (45.0, 8.0)),
    "edematous": ((785.0, 92.0), (0.225, 0.042), (725.0, 82.0), (748.0, 86.0), (24.5, 5.0), (21.0, 4.0), (62.0, 12.0)),
    "contralateral": ((558.0, 28.0), (0.225, 0.028), (512.0, 26.0), (533.0, 27.0), (17.2, 1.8), (39.0, 3.0), (56.0, 5.5)),
}
# Fixed values: (radius, slices, noise, seeds (type, x, y, sigma, weight)), places and sigmas in radii.
PRESETS = {
    "uniform": (20, 3, 0.05, (("proliferative", 0.0, 0.0, 1.2, 1.0),)),
    "two_habitats": (22, 4, 0.08, (("necrotic", -0.42, 0.0, 0.38, 1.0), ("proliferative", 0.42, 0.0, 0.38, 1.0))),
    "three_habitats": (26, 5, 0.08, (
        ("necrotic", 0.0, 0.0, 0.28, 4.0),
        ("hypoxic", 0.50, 0.0, 0.32, 1.0), ("hypoxic", -0.50, 0.0, 0.32, 1.0), ("hypoxic", 0.0, 0.50, 0.32, 1.0), ("hypoxic", 0.0, -0.50, 0.32, 1.0),
        ("proliferative", 0.84, 0.0, 0.20, 1.0), ("proliferative", -0.84, 0.0, 0.20, 1.0), ("proliferative", 0.0, 0.84, 0.20, 1.0), ("proliferative", 0.0, -0.84, 0.20, 1.0))),
    "necrotic_dominant": (28, 5, 0.08, (
        ("necrotic", 0.0, 0.0, 0.55, 2.0),
        ("viable", 0.78, 0.0, 0.24, 1.0), ("viable", -0.78, 0.0, 0.24, 1.0), ("viable", 0.0, 0.78, 0.24, 1.0), ("viable", 0.0, -0.78, 0.24, 1.0))),
    "split_same_type": (30, 5, 0.08, (
        ("necrotic", -0.52, 0.0, 0.22, 1.0), ("necrotic", 0.52, 0.0, 0.22, 1.0), ("proliferative", 0.0, 0.0, 0.28, 1.0), ("edematous", 0.0, 0.72, 0.24, 1.0))),
    "four_habitats": (30, 6, 0.08, (
        ("necrotic", 0.0, 0.0, 0.24, 1.0), ("hypoxic", 0.50, 0.0, 0.30, 1.0), ("hypoxic", -0.50, 0.0, 0.30, 1.0), ("viable", 0.0, 0.62, 0.28, 1.0), ("edematous", 0.0, -0.62, 0.28, 1.0))),
    "edematous_heavy": (22, 4, 0.07, (
        ("edematous", 0.0, 0.0, 0.50, 2.0),
        ("proliferative", 0.78, 0.0, 0.28, 1.0), ("proliferative", -0.78, 0.0, 0.28, 1.0), ("proliferative", 0.0, 0.78, 0.28, 1.0), ("proliferative", 0.0, -0.78, 0.28, 1.0))),
}
# The reference tissue's radius and share of the noise, the flattest slice, and the bound of ellipticity.
REFERENCE_RADIUS, REFERENCE_NOISE, LEAST_SCALE, MOST_ELLIPTIC = 9.0, 0.45, 0.38, 0.18

_BIO = "array<struct<param: string, mean: double, sd: double>>"
_KEY = ["subject", "slice", "x", "y"]


def _bio(kind: str) -> list[tuple[str, float, float]]:
    return [(p, m, s) for p, (m, s) in zip(PARAMETERS, BIOLOGY[kind], strict=True)]


def _bio_column(kind: str) -> Column:
    return F.array(*[F.struct(F.lit(p).alias("param"), F.lit(m).alias("mean"), F.lit(d).alias("sd")) for p, m, d in _bio(kind)])


def table(spark: SparkSession) -> DataFrame:
    """The presets, a row each, with their types in order of first mention."""
    rows = [(name, float(radius), slices, noise, list(dict.fromkeys(s[0] for s in seeds)), [(*s, _bio(s[0])) for s in seeds]) for name, (radius, slices, noise, seeds) in PRESETS.items()]
    return spark.createDataFrame(rows, f"preset string, radius double, slices int, noise double, types array<string>, seeds array<struct<type: string, sx: double, sy: double, sigma: double, weight: double, bio: {_BIO}>>")


def placed(subjects: DataFrame, seed: int = 42) -> DataFrame:
    """Adds a seeded place (cx, cy), ellipticity, angle and place of the reference tissue (rx, ry) to ``subjects`` (subject, preset)."""
    u = lambda i: uniform(seed + i, "subject")
    return subjects.withColumns({
        "cx": GRID * 0.545 + u(0) * 12 - 6, "cy": GRID * 0.545 + u(1) * 12 - 6, "elliptic": u(2) * MOST_ELLIPTIC, "angle": u(3) * math.pi,
        "rx": GRID * 0.33 + u(4) * 8 - 4, "ry": GRID * 0.53 + u(5) * 8 - 4})


def _box(rows: DataFrame, cx: str, cy: str, reach: Column) -> DataFrame:
    """Each row once for every place of the grid within ``reach`` of its centre."""
    span = lambda c: F.explode(F.sequence(F.greatest(F.lit(1), F.floor(F.col(c) - reach).cast("int")), F.least(F.lit(GRID), F.ceil(F.col(c) + reach).cast("int"))))
    return rows.withColumn("x", span(cx)).withColumn("y", span(cy))


def tumour_cells(subjects: DataFrame) -> DataFrame:
    """(subject, preset, noise, slice, x, y, truth, confidence, bio): an ellipse per slice.

    ``truth`` is the type whose seeds weigh most together, ``bio`` that of the single seed that weighs most.
    """
    parts = [_cells_of(subjects, name) for name in PRESETS]  # seven
    return reduce(lambda a, b: a.unionByName(b), parts)


def _cells_of(subjects: DataFrame, preset: str) -> DataFrame:
    """The cells of the subjects of one preset; its seeds are literals, so that a cell's weights are plain columns and not arrays."""
    radius, slices, noise, seeds = PRESETS[preset]
    s = subjects.where(F.col("preset") == preset).select("subject", "preset", "cx", "cy", "elliptic", "angle", F.explode(F.sequence(F.lit(1), F.lit(slices))).alias("slice"))
    height = (F.col("slice") - 1) / F.lit(max(slices - 1, 1))
    s = s.withColumn("scale", F.greatest(F.sin((height * 0.8 + 0.1) * math.pi), F.lit(LEAST_SCALE)))
    s = s.select("subject", "preset", "slice", "cx", "cy", F.cos("angle").alias("cos"), F.sin("angle").alias("sin"), (radius * (1 + F.col("elliptic")) * F.col("scale")).alias("a"), (radius * (1 - F.col("elliptic")) * F.col("scale")).alias("b"))
    s = _box(s, "cx", "cy", F.col("a"))
    s = s.withColumns({"dx": F.col("x") - F.col("cx"), "dy": F.col("y") - F.col("cy")})
    along, across = (F.col("dx") * F.col("cos") + F.col("dy") * F.col("sin")) / F.col("a"), (F.col("dy") * F.col("cos") - F.col("dx") * F.col("sin")) / F.col("b")
    s = s.where(along * along + across * across <= 1)

    def log_weight(x: float, y: float, sigma: float, weight: float) -> Column:
        apart = [F.col("dx") - x * radius, F.col("dy") - y * radius]
        return F.ln(F.lit(weight)) - (apart[0] * apart[0] + apart[1] * apart[1]) / (2 * (sigma * radius) ** 2)

    largest = lambda names: F.greatest(*names) if len(names) > 1 else F.col(names[0])
    first = lambda names, top, values: F.coalesce(*[F.when(F.col(n) == F.col(top), v) for n, v in zip(names, values, strict=True)])
    ls, types = [f"l{i}" for i in range(len(seeds))], list(dict.fromkeys(z[0] for z in seeds))
    ws = [f"w{i}" for i in range(len(types))]
    s = s.withColumns({n: log_weight(*z[1:]) for n, z in zip(ls, seeds, strict=True)}).withColumn("top", largest(ls))
    weight = lambda t: reduce(lambda a, b: a + b, [F.exp(F.col(n) - F.col("top")) for n, z in zip(ls, seeds, strict=True) if z[0] == t])
    s = s.withColumns({n: weight(t) for n, t in zip(ws, types, strict=True)}).withColumn("most", largest(ws))
    total = reduce(lambda a, b: a + b, [F.col(n) for n in ws])
    bio = first(ls, "top", [_bio_column(z[0]) for z in seeds])
    return s.select("subject", "preset", F.lit(noise).alias("noise"), "slice", "x", "y", first(ws, "most", [F.lit(t) for t in types]).alias("truth"), (F.col("most") / total).alias("confidence"), bio.alias("bio"))


def reference_cells(subjects: DataFrame) -> DataFrame:
    """The same columns for a circle of healthy tissue on each slice."""
    s = subjects.join(F.broadcast(table(subjects.sparkSession).select("preset", "slices", "noise")), "preset")
    s = _box(s.withColumn("slice", F.explode(F.sequence(F.lit(1), F.col("slices")))), "rx", "ry", F.lit(REFERENCE_RADIUS))
    s = s.where((F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2 <= REFERENCE_RADIUS**2)
    return s.select("subject", "preset", (F.col("noise") * REFERENCE_NOISE).alias("noise"), "slice", "x", "y", F.lit("contralateral").alias("truth"), F.lit(1.0).alias("confidence"), _bio_column("contralateral").alias("bio"))


def long_cells(subjects: DataFrame, seed: int = 42) -> DataFrame:
    """(subject, preset, roi, slice, x, y, truth, confidence, param, value) of ``subjects`` (subject, preset, places as of :func:`placed`)."""
    both = tumour_cells(subjects).withColumn("roi", F.lit("ALL")).unionByName(reference_cells(subjects).withColumn("roi", F.lit("CL")))
    rows = both.select(*_KEY, "preset", "roi", "truth", "confidence", "noise", F.inline("bio"))
    value = F.col("mean") + normal(seed, *_KEY, "roi", "param") * (F.col("sd") + F.col("noise") * F.abs("mean"))
    bounded = F.when(F.col("param") == "DTI-FA", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).otherwise(F.greatest(value, F.lit(0.001)))
    return rows.select("subject", "preset", "roi", "slice", "x", "y", "truth", "confidence", "param", bounded.alias("value"))
