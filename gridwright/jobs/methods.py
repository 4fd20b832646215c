"""The methods of clustering behind one way in, and comparisons of their habitats across subjects or methods, from cells to records."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import comparison, inference, mixture, scaling, selection, spectral
from ..operators.mixture import Mixture
from ..sources.results import written
from . import modes

METHODS = ("gmm", "kmeans", "srsc")
Models = dict[tuple[str, int], Mixture | np.ndarray]
KEY = ["subject", "method", "habitat"]
# Least cells and least mean effect size of an instance that counts in full, and the weight of the others.
LEAST_CELLS, LEAST_ETA2, LOW_WEIGHT = 30, 0.10, 0.5


def _grouped(points: DataFrame) -> DataFrame:
    return points.withColumn("g", F.col("subject").cast("string"))


def _centres(points: DataFrame, ks: list[int], seed: int, restarts: int, steps: int) -> Models:
    best: dict = {}
    for (g, k, _), (c, cost) in sorted(mixture.kmeans_all(points, ks, seed, restarts, steps).items()):
        if (g, k) not in best or cost < best[g, k][1]:
            best[g, k] = (c, cost)
    return {key: c for key, (c, _) in best.items()}


def choose_k(points: DataFrame, method: str, ks: list[int], seed: int = 35, restarts: int = 2, steps: int = 20, refs: int = 5, least_silhouette: float | None = None, gap_guard: bool = False) -> tuple[DataFrame, Models]:
    """(choice (g, ..., k) per subject, the models fitted on the way) for ``points`` (subject, slice, x, y, v).

    ``gmm``: the least information criterion, or the silhouette's elbow where the silhouette at it is below ``least_silhouette``.
    ``kmeans`` and ``srsc``: the gap rule, or the silhouette's elbow with ``gap_guard``. No models are kept of ``srsc``.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method!r}")
    if method == "srsc":
        return spectral.choose_k(points, ks, seed=seed, refs=refs, guard=gap_guard)[1], {}
    p = _grouped(points)
    models: Models = dict(mixture.fit_all(p, ks, seed, restarts, steps)) if method == "gmm" else _centres(p, ks, seed, restarts, steps)
    seen = mixture.silhouettes(p, models)
    bic = lambda m: float(m.bic()) if isinstance(m, Mixture) else None
    scores = points.sparkSession.createDataFrame([(g, k, bic(m), float(seen[g, k])) for (g, k), m in models.items()], "g string, k int, bic double, silhouette double")
    if method == "gmm":
        return selection.criterion_or_elbow(scores, ["g"], least_silhouette), models
    gap = inference.gap_statistic(p.select("g", "v"), ks, refs, seed).withColumn("k", F.col("k").cast("int"))
    return selection.elbow_or_gap(scores.drop("bic").join(gap, ["g", "k"]), ["g"], gap_guard), models


def cluster(points: DataFrame, method: str, k: int | dict[str, int], models: Models | None = None, seed: int = 35, restarts: int = 2, steps: int = 20) -> DataFrame:
    """``points`` (subject, slice, x, y, v) with ``label``: the subject's clustering by one of METHODS into k (or each subject's k) clusters.

    Models that :func:`choose_k` fitted are used again. Subjects without a k have no rows.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method!r}")
    columns = [*points.columns, "label"]
    if isinstance(k, dict):
        spark = points.sparkSession
        own = written(spark.createDataFrame(list(k.items()), "_g string, _k int"), "methods-k")  # a row per subject
        points = scaling.with_stats(points.withColumn("_g", F.col("subject").cast("string")), own, ["_g"])
    ks = sorted(set(k.values())) if isinstance(k, dict) else [k]
    if not ks:
        return points.withColumn("label", F.lit(None).cast("int")).select(*columns)  # no subject has a k, so no row is left
    if method == "srsc":
        parts = [spectral.spectral(points.where(F.col("_k") == one) if isinstance(k, dict) else points, one, seed=seed) for one in ks]  # a handful of k
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.select(*columns)
    p = _grouped(points)
    mine = lambda found: {g: m for (g, n), m in found.items() if n == (k.get(g) if isinstance(k, dict) else k)}
    if method == "gmm":
        return mixture.predict(p, mine(models or mixture.fit_all(p, ks, seed, restarts, steps))).select(*columns)
    return spectral.nearest(p, {g: (c, 0.0) for g, c in mine(models or _centres(p, ks, seed, restarts, steps)).items()}).select(*columns)


def instances(cells: DataFrame, long: DataFrame, params: list[str]) -> DataFrame:
    """Habitats as :mod:`comparison` takes them, with (subject, method) in place of ``source``, from ``cells`` (subject, method, habitat, v, d or not).

    ``v`` holds robustly scaled parameters first; ``long`` has the raw ones. Labels come from the weighted votes. Means and effect
    sizes follow from a count, a sum and a sum of squares per habitat; the mean in raw units from the mean scaled one.
    """
    at = [F.get("v", F.lit(i)) for i in range(len(params))]
    m = cells.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in at]).alias("v"), F.array(*[F.sum(c * c) for c in at]).alias("q"))
    m = written(m, "instances-means")
    each = m.select(*KEY, "n", F.posexplode(F.arrays_zip("v", "q")).alias("i", "z")).select(*KEY, "n", "i", F.col("z.v").alias("m"), F.col("z.q").alias("q"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    total, between = F.sum("q") - F.sum("n") * mean * mean, F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * mean * mean
    eta = each.groupBy("subject", "method", "i").agg(F.sum("n").alias("all"), F.when(total > 1e-12, between / total).otherwise(0.0).alias("e")).groupBy("subject", "method").agg(F.max("all").alias("all"), F.avg("e").alias("eta2"))
    stats = scaling.median_iqr(scaling.tumour(long), ["subject", "param"]).select("subject", "param", F.col("median").alias("center"), "iqr")
    refs = scaling.reference_stats(long).select("subject", "param", F.col("median").alias("rmed"), "sd")
    named = each.withColumn("param", F.element_at(F.array(*[F.lit(p) for p in params]), F.col("i") + 1))
    raw = named.join(stats, ["subject", "param"]).join(refs, ["subject", "param"], "left").withColumn("one", (F.col("m") * F.col("iqr") + F.col("center") - F.col("rmed")) / F.greatest("sd", F.lit(scaling.FLOOR)))
    z = raw.groupBy(*KEY).agg(F.when(F.count("one") > 0, F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("one", F.lit(0.0)).alias("x")))), lambda s: s["x"])).alias("z"))  # a number per parameter
    labels = modes.voted_labels(modes.cluster_profiles(cells, params, KEY), KEY)
    ok = (F.col("n") >= LEAST_CELLS) & (F.col("eta2") >= LEAST_ETA2)
    j = m.join(eta, ["subject", "method"]).join(z, KEY, "left").join(labels, KEY)
    out = j.select("subject", "method", F.col("habitat").alias("cluster"), "label", "v", "z", (F.col("n") / F.col("all")).alias("proportion"), "eta2", F.when(ok, 1.0).otherwise(LOW_WEIGHT).alias("weight"), (~ok).alias("low_conf"))
    return written(out, "instances")


def across_subjects(long: DataFrame, params: list[str], cfg: modes.Config = modes.Config()) -> DataFrame:
    """From cells to one record per label: each subject's own analysis, then the comparison of all subjects."""
    cells = written(modes.classic(long, params, cfg).select("subject", F.lit("gmm").alias("method"), "habitat", "v", "d"), "classic-cells")
    return comparison.compare(instances(cells, long, params).withColumnRenamed("subject", "source").drop("method"))


def across_methods(long: DataFrame, params: list[str], k: int, methods: tuple[str, ...] = METHODS, seed: int = 35) -> DataFrame:
    """From cells to one record per subject and label: the subject's clusterings by several methods, compared with each other."""
    points = written(modes.scaled_points(long, params), "methods-points")
    cells = None
    for method in methods:
        one = cluster(points, method, k, seed=seed).select("subject", F.lit(method).alias("method"), F.col("label").alias("habitat"), "v")
        cells = one if cells is None else cells.unionByName(one)
    return comparison.compare(instances(written(cells, "methods-cells"), long, params).withColumnRenamed("method", "source"), by=["subject"])
