"""Habitats within zones and within habitats: a core and a periphery, each segmented on its own; sub-habitats.

All groups of a level are fitted in the same passes (:mod:`mixture`); what the driver holds is parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import mixture, rules
from ..sources.results import written
from .modes import guarded_k

# Share of the largest variance that keeps a parameter, most habitats of a core and of a periphery.
KEEP, CORE_MOST, PERIPHERY_MOST = 0.10, 4, 5
FEATURES = ("t2", "md", "fa", "t2star", "mtr")


def telling_components(points: DataFrame, keep: float = KEEP) -> DataFrame:
    """(g, idx): components of v whose variance in the group is at least ``keep`` of the largest; two at least."""
    each = points.select("g", F.posexplode("v").alias("i", "x")).groupBy("g", "i").agg(F.var_pop("x").alias("var"))
    w = Window.partitionBy("g")  # a row per component
    ranked = each.withColumns({"most": F.max("var").over(w), "nth": F.row_number().over(w.orderBy(F.desc("var"), "i"))})
    kept = ranked.where((F.col("var") >= keep * F.col("most")) | (F.col("nth") <= 2))
    return kept.groupBy("g").agg(F.sort_array(F.collect_list("i")).alias("idx"))


def zones(points: DataFrame, names: list[str], seed: int = 35, restarts: int = 1, steps: int = 15) -> DataFrame:
    """``points`` (g, v, ...) with ``zone`` core or periphery; groups that one component fits as well, or whose halves hardly differ, are left out.

    ``names`` tells which of t2, md, fa, t2star, mtr the components of v are.
    """
    points = written(points, "zone-points")  # read once per pass
    models = mixture.fit_all(points, [1, 2], seed, restarts, steps)
    split = {g: m for (g, k), m in models.items() if k == 2 and len(m.means) == 2 and m.bic() < models[g, 1].bic()}
    spark = points.sparkSession
    halves = mixture.predict(points.join(spark.createDataFrame([(g,) for g in split], "g string"), "g", "left_semi"), split).drop("proba")
    halves = written(halves, "halves")
    means = halves.groupBy("g", "label").agg(*[F.avg(F.get("v", F.lit(i))).alias(c) for i, c in enumerate(names)])
    means = means.withColumns({c: F.lit(None).cast("double") for c in FEATURES if c not in names})
    guard = rules.zone_guard(means, ["g"], "label", tuple(names)).where("valid").select("g", "core")
    return halves.join(guard, "g").withColumn("zone", F.when(F.col("label") == F.col("core"), "core").otherwise("periphery")).drop("label", "core")


def segment(points: DataFrame, names: list[str], seed: int = 35, restarts: int = 1, steps: int = 15) -> DataFrame:
    """(..., zone, habitat): habitats numbered from 0, those of the core first.

    Each zone is clustered on its telling parameters: a core in 1 to 4, a periphery in 2 to 5 habitats by BIC, in no
    more than a fifth of its cells. A zone too small for its least number stays one habitat.
    """
    both = zones(points, names, seed, restarts, steps).withColumn("z", F.concat_ws("|", "g", "zone"))
    idx = telling_components(both.select(F.col("z").alias("g"), "v")).withColumnRenamed("g", "z")
    small = F.transform("idx", lambda i: F.get("v0", i))
    part = written(both.join(idx, "z").withColumnsRenamed({"g": "g0", "v": "v0"}).select(F.col("z").alias("g"), small.alias("v"), "*").drop("z", "idx"), "zones")
    fits = mixture.fit_all(part, list(range(1, PERIPHERY_MOST + 1)), seed, restarts, steps)
    best: dict[str, mixture.Mixture] = {}
    for g in {g for g, _ in fits}:
        n, core = fits[g, 1].n, g.endswith("|core")
        ks = [k for k in range(1 if core else 2, (CORE_MOST if core else PERIPHERY_MOST) + 1) if 5 * k <= n] or [1]
        best[g] = fits[g, min(ks, key=lambda k: fits[g, k].bic())]
    found = mixture.predict(part, best).drop("proba")
    found = written(found.drop("v", "g").withColumnsRenamed({"g0": "g", "v0": "v"}), "zone-habitats")
    seen = found.select("g", "zone", "label").distinct()
    number = seen.withColumn("habitat", F.row_number().over(Window.partitionBy("g").orderBy("zone", "label")) - 1)  # a row per habitat
    return found.join(number, ["g", "zone", "label"]).drop("label")


def sub_habitats(points: DataFrame, most: int = 4, least_cells: int = 200, least_part: int = 30, least_share: float = 0.05, seed: int = 35, restarts: int = 1, steps: int = 15) -> DataFrame:
    """``points`` (habitat, subject, v, ...) with ``sub``: the parts of each habitat of at least ``least_cells`` cells, others left out.

    Cells are centred per subject first. Up to ``most`` parts by BIC, one per 50 cells at most, as many as leave no
    part below ``least_part`` cells or ``least_share``; a habitat of one part is homogeneous.
    """
    points = points.withColumn("g", F.col("habitat").cast("string"))
    size = points.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_cells)
    mean = points.select("g", "subject", F.posexplode("v").alias("i", "x")).groupBy("g", "subject", "i").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("g", "subject").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))  # one number per parameter
    raw = points.join(size.select("g"), "g", "left_semi").join(mean, ["g", "subject"]).withColumnRenamed("v", "raw")
    centred = written(raw.withColumn("v", F.zip_with("raw", "m", lambda a, b: a - b)).drop("m"), "centred")
    fits = mixture.fit_all(centred, list(range(1, most + 1)), seed, restarts, steps)
    best = {}
    for g in {g for g, _ in fits}:
        ks = [k for k in range(1, most + 1) if 50 * k <= fits[g, 1].n] or [1]
        best[g] = min(ks, key=lambda k: fits[g, k].bic())
    k = guarded_k(centred, fits, best, least_share, least_part)
    out = mixture.predict(centred, {g: fits[g, x] for g, x in k.items()})
    return out.drop("g", "v", "proba").withColumnsRenamed({"raw": "v", "label": "sub"})
