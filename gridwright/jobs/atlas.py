"""An atlas: one mixture of all subjects, frozen, with the stability of its centres over resampled subjects."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import composition, descriptors, inference, mixture, permutations, profiles, ranks, selection, spectral
from ..sources import results
from ..sources.results import written
from .modes import CELL, balanced_sample

# Regularisation of the covariances, and the mean shift below which a centre is stable.
REG, STABLE = 1e-4, 0.10
#: Cells of the sample whose distances give the kernel's bandwidth.
BANDWIDTH_CELLS = 500


@dataclass(frozen=True)
class Config:
    ks: tuple[int, ...] = (2, 3, 4, 5)
    seed: int = 35
    restarts: int = 3
    steps: int = 60
    per_subject: int = 500
    resamples: int = 30


def criteria(points: DataFrame, models: dict[tuple[str, int], mixture.Mixture]) -> DataFrame:
    """(k, bic, icl, silhouette), each on all cells; silhouettes by squared distances, so that they need two passes and no pairs."""
    seen, apart = mixture.evaluate(points, models), mixture.silhouettes(points, models)
    rows = []
    for (g, k), m in sorted(models.items()):  # a handful of k
        n, ll, entropy = seen[g, k]
        bic = float(m.bic_of(n, ll))
        rows.append((k, bic, bic + 2 * entropy, apart[g, k]))
    return points.sparkSession.createDataFrame(rows, "k int, bic double, icl double, silhouette double")


def chosen_k(scores: DataFrame) -> int | None:
    """The k that two of elbow of BIC, least ICL and elbow of the silhouette name, else that of ICL; None without scores."""
    s = scores.withColumn("g", F.lit("all"))
    a = selection.elbow(s, ["g"], "bic").withColumnRenamed("k", "a")
    b = selection.best_k(s, ["g"], "icl").withColumnRenamed("k", "b")
    c = selection.elbow(s, ["g"], "silhouette").withColumnRenamed("k", "c")
    found = selection.majority(a.join(b, "g").join(c, "g"), ["g"], "b").first()
    return found and found["k"]


def aligned(ref: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Rows of ``other`` in the order that brings their distances to the rows of ``ref`` to the least sum.

    Best costs over subsets of columns, row by row: 2^k k steps for k centres. If ``other`` has fewer rows, they are repeated.
    """
    k = len(ref)
    other = other[np.arange(max(k, len(other))) % len(other)]
    cost = np.linalg.norm(ref[:, None] - other[None], axis=2)
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for i in range(k):
        grown: dict[int, tuple[float, tuple[int, ...]]] = {}
        for taken, (total, order) in best.items():
            for j in range(len(other)):
                at = taken | 1 << j
                if at != taken and (at not in grown or total + cost[i, j] < grown[at][0]):
                    grown[at] = (total + cost[i, j], (*order, j))
        best = grown
    return other[list(min(best.values())[1])]


def resampled(sample: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(g, v): per resample as many subjects as there are, drawn with replacement, each with its cells of the balanced sample."""
    who = sample.select("subject").distinct()
    blocks = who.withColumn("b", F.pmod(F.xxhash64("subject"), F.lit(256)))  # numbered in blocks, not in one window
    counts = blocks.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"))  # at most 256 rows
    ids = blocks.join(F.broadcast(before), "b").select("subject", (F.row_number().over(Window.partitionBy("b").orderBy("subject")) - 1 + F.col("before")).alias("i"))
    ids = written(ids, "atlas-subjects")
    n = ids.count()
    draws = ids.sparkSession.range(resamples * n).select(
        F.floor(F.col("id") / n).cast("string").alias("g"), F.floor((F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 12).cast("double") + 0.5) / float(1 << 52) * n).alias("i"))
    times = draws.groupBy("g", "i").agg(F.count(F.lit(1)).cast("int").alias("times")).join(ids, "i")
    return sample.select("subject", "v").join(times, "subject").select("g", "v", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")


def stability(sample: DataFrame, model: mixture.Mixture, cfg: Config = Config()) -> DataFrame:
    """(habitat, mean_shift, max_shift, stable): how far the centres move when the subjects are resampled. All refits share their passes."""
    schema = "habitat int, mean_shift double, max_shift double, stable boolean"
    if not len(model.means):
        return sample.sparkSession.createDataFrame([], schema)
    drawn = written(resampled(sample, cfg.resamples, cfg.seed + 1), "atlas-resampled")
    fits = mixture.fit_all(drawn, [len(model.means)], cfg.seed, cfg.restarts, cfg.steps, REG)
    shifts = np.array([np.linalg.norm(model.means - aligned(model.means, m.means), axis=1) for _, m in sorted(fits.items())])
    rows = [(h, float(shifts[:, h].mean()), float(shifts[:, h].max()), bool(shifts[:, h].mean() < STABLE)) for h in range(len(model.means))]
    return sample.sparkSession.createDataFrame(rows, schema)


def fit(points: DataFrame, cfg: Config = Config()) -> tuple[mixture.Mixture, DataFrame, DataFrame]:
    """(model, criteria, balanced sample) of ``points`` (subject, slice, x, y, v); the model is fitted on equally many cells of each subject. Without cells it has no components."""
    points = written(points.withColumn("g", F.lit("all")), "atlas-points")
    sample = written(balanced_sample(points, cfg.per_subject, cfg.seed), "atlas-sample")
    models = mixture.fit_all(sample, list(cfg.ks), cfg.seed, cfg.restarts, cfg.steps, REG)
    scores = criteria(points, models)
    return models["all", chosen_k(scores)] if models else mixture.nothing(), scores, sample


def run(points: DataFrame, groups: DataFrame, params: list[str], path: str, cfg: Config = Config(), n_perm: int = 499, level: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(verdicts (step, test, habitat, statistic, p, verdict), descriptors (subject, habitat, pi, sigma2, residual)) from scaled cells.

    Chooses k, freezes the atlas and stores it at ``path``, measures its stability, assigns all cells softly by the
    stored atlas, and tests the ``groups`` (subject, grp): location and spread of the compositions, location of the
    subjects' distributions of cells, Dirichlet regression, and each habitat's share by rank tests, Bonferroni adjusted.
    Without cells there is nothing to store or to test, and both tables are empty.
    """
    spark = points.sparkSession
    points = written(points.withColumn("subject", F.col("subject").cast("string")), "atlas-cells")
    groups = written(groups.select(F.col("subject").cast("string").alias("subject"), "grp"), "atlas-groups")
    model, scores, sample = fit(points, cfg)
    if not len(model.means):
        verdicts = spark.createDataFrame([], "step string, test string, habitat int, statistic double, p double, verdict string")
        return verdicts, spark.createDataFrame([], "subject string, habitat int, pi double, sigma2 double, residual double")
    results.write_atlas(spark, model, params, path)
    frozen = results.read_atlas(spark, path)[0]
    k = len(frozen.means)
    found = descriptors.describe(mixture.score(points.select("subject", "v"), frozen), ["subject"], k).withColumnRenamed("cluster", "habitat")
    found = written(found, "atlas-descriptors")
    shares = written(profiles.spread(found, "habitat", "pi", k).join(groups, "subject"), "atlas-shares")
    ratios = written(shares.select("subject", "grp", X.clr(F.transform("pi", lambda p: F.greatest(p, F.lit(1e-10)))).alias("v")), "atlas-ratios")
    few = sample.orderBy(F.xxhash64(F.lit(cfg.seed), *CELL), *CELL).limit(BANDWIDTH_CELLS).select("v").collect()  # a fixed number
    cells = written(permutations.mean_embeddings(points, spectral.bandwidth(np.array([r["v"] for r in few], float))).join(groups, "subject"), "atlas-embeddings")
    rows = lambda df, step, test: df.select(F.lit(step).alias("step"), F.lit(test).alias("test"), F.lit(None).cast("int").alias("habitat"), F.col("f").alias("statistic"), "p")
    law = composition.dirichlet(shares.select("grp", F.col("pi").alias("v")), k)
    regression = spark.createDataFrame([("composition", "dirichlet", None, float(law.ratio), float(law.p))], "step string, test string, habitat int, statistic double, p double")
    long = found.join(groups, "subject")
    levels = [r[0] for r in groups.select("grp").distinct().orderBy("grp").limit(3).collect()]
    if len(levels) == 2:
        each = ranks.mann_whitney(long, ["habitat"], "pi", "grp", levels[0]).select("habitat", F.col("u").cast("double").alias("statistic"), inference.rank_sum_p("u").alias("p"))
        tests = each.select(F.lit("habitats").alias("step"), F.lit("rank sum").alias("test"), F.col("habitat").cast("int").alias("habitat"), "statistic", F.least(F.lit(1.0), F.col("p") * k).alias("p"))
    else:
        tests = regression.limit(0)
    out = rows(permutations.permanova_test(ratios, n_perm), "composition", "location").unionByName(rows(permutations.dispersion_test(ratios, n_perm), "composition", "spread"))
    out = out.unionByName(rows(permutations.permanova_test(cells, n_perm), "cells", "location")).unionByName(regression).unionByName(tests)
    out = out.withColumn("verdict", F.when(F.col("p") < level, "different").otherwise("no difference shown"))
    steady = stability(sample, frozen, cfg).select(F.lit("stability").alias("step"), F.lit("mean shift").alias("test"), "habitat", F.col("mean_shift").alias("statistic"), F.lit(None).cast("double").alias("p"), F.when(F.col("stable"), "stable").otherwise("unstable").alias("verdict"))
    choice = scores.where(F.col("k") == k).select(F.lit("choice").alias("step"), F.lit("icl").alias("test"), F.lit(None).cast("int").alias("habitat"), F.col("icl").alias("statistic"), F.lit(None).cast("double").alias("p"), F.concat(F.lit("k = "), F.col("k").cast("string")).alias("verdict"))
    return choice.unionByName(steady).unionByName(out), found
