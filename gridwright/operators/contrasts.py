"""Contrasts with the reference tissue, quality gates, merges and narrations of profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.results import written
from .pairs import all_pairs


def relative_extent(means: DataFrame, ref: DataFrame, tumour: DataFrame, small: float = 0.05) -> DataFrame:
    """(raw - reference median) / (tumour median - reference median) per habitat mean; 1 where the tumour hardly differs from the reference.

    ``means`` (subject, habitat, param, mean), ``ref`` and ``tumour`` (subject, param, median).
    """
    by = ["subject", "param"]
    j = means.join(ref.select(*by, F.col("median").alias("r")), by).join(tumour.select(*by, F.col("median").alias("t")), by)
    ext = F.col("t") - F.col("r")
    return j.select("subject", "habitat", "param", F.when(F.abs(ext) / F.greatest(F.abs("r"), F.lit(1e-8)) < small, 1.0).otherwise((F.col("mean") - F.col("r")) / ext).alias("extent"))


def reference_zscores(means: DataFrame, ref: DataFrame) -> DataFrame:
    """(raw mean - reference median) / reference deviation (floored). ``ref`` (subject, param, median, sd)."""
    j = means.join(ref.select("subject", "param", "median", "sd"), ["subject", "param"])
    return j.select("subject", "habitat", "param", ((F.col("mean") - F.col("median")) / F.greatest("sd", F.lit(1e-8))).alias("z"))


def quality_gate(sizes: DataFrame, eta: DataFrame, least: int = 30, least_eta: float = 0.10) -> DataFrame:
    """(subject, habitat, n, eta2, passes, weight): enough cells and a mean share of variance; weight 1 or 0.5."""
    e = eta.groupBy("subject").agg(F.avg("eta2").alias("eta2"))
    ok = (F.col("n") >= least) & (F.col("eta2") >= least_eta)
    return sizes.join(e, "subject").select("subject", "habitat", "n", "eta2", ok.alias("passes"), F.when(ok, 1.0).otherwise(0.5).alias("weight"))


def similar_groups(vectors: DataFrame, key: str, threshold: float, near_zero: float = 0.25) -> DataFrame:
    """(key, grp): smallest key reachable over cosines of at least ``threshold``; short vectors stay alone.

    For summary vectors: labels spread along links until nothing changes, in
    at most as many rounds as there are rows on a path.
    """
    long = vectors.where(X.norm(F.col("v")) >= near_zero)
    p = all_pairs(long, ["v"], key).where(1 - X.cosine_distance(F.col("v_a"), F.col("v_b")) >= threshold)
    links = p.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    links = written(links, "similar-links")
    now = vectors.select(F.col(key).alias("id"), F.col(key).alias("grp"))
    while True:
        least = links.join(now, F.col("b") == F.col("id")).groupBy("a").agg(F.min("grp").alias("least"))
        new = now.join(least, F.col("id") == F.col("a"), "left").select("id", "grp", F.least("grp", F.coalesce("least", "grp")).alias("new"))
        new = written(new, "similar-groups")
        changed = new.where("new < grp").head(1)
        now = new.select("id", F.col("new").alias("grp"))
        if not changed:
            return now.withColumnRenamed("id", key)


def merged_groups(presence: DataFrame, groups: DataFrame, label: str = "habitat") -> DataFrame:
    """Each label under the most present member of its group, numbered from 0 without gaps."""
    j = presence.join(groups, label)
    lead = j.groupBy("grp").agg(F.min_by(label, F.struct(-F.col("rate"), F.col(label))).alias("lead"))
    out = j.join(lead, "grp").select(label, "lead")
    return out.withColumn("meta", F.dense_rank().over(Window.orderBy("lead")) - 1)  # a row per label


def witness(points: DataFrame, lo: float, hi: float, n: int, sigma: float) -> DataFrame:
    """Difference of two groups' mean kernels on an n x n grid. ``points`` (first boolean, x, y) are summary rows."""
    step = (hi - lo) / (n - 1)
    grid = points.sparkSession.range(n * n).select((F.col("id") % n).cast("int").alias("i"), F.floor(F.col("id") / n).cast("int").alias("j"))
    grid = grid.withColumns({"gx": F.lit(lo) + F.col("i") * step, "gy": F.lit(lo) + F.col("j") * step})
    k = X.rbf((F.col("x") - F.col("gx")) ** 2 + (F.col("y") - F.col("gy")) ** 2, sigma)
    each = points.join(F.broadcast(grid))  # the grid has n * n rows
    return each.groupBy("i", "j").agg((F.avg(F.when(F.col("first"), k)) - F.avg(F.when(~F.col("first"), k))).alias("witness"))


def top_witness_pairs(points: DataFrame, dims: int, lo: float, hi: float, n: int, sigma: float, top: int) -> DataFrame:
    """(i, j, score): the ``top`` pairs of dimensions with the largest absolute witness. ``points`` (first boolean, v) are summary rows."""
    pairs = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(j).alias("q")) for i in range(dims) for j in range(i + 1, dims)])
    each = points.select("first", "v", F.inline(pairs)).select("first", "p", "q", F.get("v", F.col("p")).alias("x"), F.get("v", F.col("q")).alias("y"))
    step = (hi - lo) / (n - 1)
    grid = points.sparkSession.range(n * n).select((F.lit(lo) + (F.col("id") % n) * step).alias("gx"), (F.lit(lo) + F.floor(F.col("id") / n) * step).alias("gy"))
    k = X.rbf((F.col("x") - F.col("gx")) ** 2 + (F.col("y") - F.col("gy")) ** 2, sigma)
    w = each.join(F.broadcast(grid)).groupBy("p", "q", "gx", "gy").agg((F.avg(F.when(F.col("first"), k)) - F.avg(F.when(~F.col("first"), k))).alias("w"))  # the grid has n * n rows
    return w.groupBy(F.col("p").alias("i"), F.col("q").alias("j")).agg(F.max(F.abs("w")).alias("score")).orderBy(F.desc("score")).limit(top)
