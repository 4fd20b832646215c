"""Soft assignment to frozen centroids, and descriptors of subjects from it.

``points`` hold (keys..., v); ``model`` is the list of centroids, a few short
vectors that become literals of the plan, so all of this runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def distances(v: Column, model: list[list[float]]) -> Column:
    return F.array(*[X.euclidean(v, F.array(*[F.lit(float(x)) for x in c])) for c in model]).cast("array<double>")  # typed without centroids, too


def assign(points: DataFrame, model: list[list[float]]) -> DataFrame:
    """Adds d (distances), proba (softmax of the negative distances), label, confidence and ambiguous (second above 0.30)."""
    p = points.withColumn("d", distances(F.col("v"), model)).withColumn("proba", X.softmax_of_distances(F.col("d")))
    ranked = F.reverse(F.array_sort("proba"))
    label = F.array_position("d", F.array_min("d")).cast("int") - 1
    return p.withColumns({"label": label, "confidence": F.array_max("proba"), "ambiguous": F.get(ranked, F.lit(1)) > 0.30})


def describe(assigned: DataFrame, by: list[str], k: int) -> DataFrame:
    """Per ``by`` and cluster: pi (mean posterior), sigma2 (posterior-weighted variance, mean over dimensions) and residual (posterior-weighted distance).

    One pass: sums of w, w v, w v^2 and w d per dimension, pre-aggregated.
    """
    cells = assigned.select(*by, "v", F.posexplode(F.arrays_zip("proba", "d")).alias("cluster", "z"))
    rows = cells.select(*by, "cluster", F.col("z.proba").alias("w"), F.col("z.d").alias("d"), F.posexplode("v").alias("dim", "x"))
    per = rows.groupBy(*by, "cluster", "dim").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("wxx"), F.sum(F.col("w") * F.col("d")).alias("wd"))
    mean = F.col("wx") / F.col("w")
    var = F.when(F.col("w") >= 1e-10, F.col("wxx") / F.col("w") - mean * mean)
    return per.groupBy(*by, "cluster").agg((F.max("w") / F.max("n")).alias("pi"), F.avg(var).alias("sigma2"), F.when(F.max("w") >= 1e-10, F.max("wd") / F.max("w")).alias("residual"))


def certainty(assigned: DataFrame, by: list[str], sure: float = 0.8, unsure: float = 0.5) -> DataFrame:
    return assigned.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= sure).alias("n_sure"), F.count_if(F.col("confidence") < unsure).alias("n_unsure"), F.count_if("ambiguous").alias("n_ambiguous"))


def classification_likelihood(assigned: DataFrame, by: list[str], k: int, dims: int) -> DataFrame:
    """(by, entropy, bic, icl) of equally weighted unit Gaussians at the model's ``k`` centroids: icl adds twice the posteriors' entropy to bic."""
    entropy = F.aggregate("proba", F.lit(0.0), lambda s, p: s - p * F.ln(p + F.lit(1e-300)))
    like = F.ln(F.aggregate("d", F.lit(0.0), lambda s, d: s + F.exp(-d * d / 2)) / k) - F.lit(dims / 2) * F.ln(2 * F.pi())
    # the posteriors of these Gaussians are those of the squared distances, the given ones of the distances: the entropy is that of the given ones
    bic = -2 * F.sum(like) + k * dims * F.ln(F.count(F.lit(1)))
    return assigned.groupBy(*by).agg(F.sum(entropy).alias("entropy"), bic.alias("bic")).withColumn("icl", F.col("bic") + 2 * F.col("entropy"))
