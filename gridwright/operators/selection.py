"""Choice of the number of clusters from a table (k, score), one row per k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_k(scores: DataFrame, by: list[str], score: str, largest: bool = False) -> DataFrame:
    """k with the least (or largest) score; the least k of ties."""
    s = -F.col(score) if largest else F.col(score)
    return scores.groupBy(*by).agg(F.min_by("k", F.struct(s, "k")).alias("k"))


def elbow(scores: DataFrame, by: list[str], score: str, below_only: bool = False) -> DataFrame:
    """k farthest from the chord between the first and the last point, on axes scaled to 0..1.

    ``below_only`` measures distance below the chord and leaves the end points out.
    """
    w = Window.partitionBy(*by)
    lo, hi = F.min("k").over(w), F.max("k").over(w)
    s = scores.withColumns({"x": (F.col("k") - lo) / F.greatest(hi - lo, F.lit(1)), "least": F.min(score).over(w), "most": F.max(score).over(w)})
    s = s.withColumn("y", F.when(F.col("most") > F.col("least"), (F.col(score) - F.col("least")) / (F.col("most") - F.col("least"))).otherwise(0.0))
    first, last = F.min_by("y", "k").over(w), F.max_by("y", "k").over(w)
    gap = first + (last - first) * F.col("x") - F.col("y")
    s = s.withColumns({"gap": gap if below_only else F.abs(gap), "end": (F.col("k") == lo) | (F.col("k") == hi)})
    s = s.where("not end") if below_only else s
    return s.groupBy(*by).agg(F.min_by("k", F.struct(-F.col("gap"), "k")).alias("k"))


def gap_rule(scores: DataFrame, by: list[str]) -> DataFrame:
    """Least k with gap(k) >= gap(k + 1) - s(k + 1), else the last. ``scores`` (by, k, gap, s)."""
    w = Window.partitionBy(*by).orderBy("k")
    ok = scores.withColumn("ok", F.col("gap") >= F.lead("gap").over(w) - F.lead("s").over(w))
    return ok.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("ok"), F.col("k"))), F.max("k")).alias("k"))


def elbow_or_gap(scores: DataFrame, by: list[str], guard: bool = False) -> DataFrame:
    """(by, elbow, gap_k, k): where the silhouette's elbow and the gap rule differ, the gap rule decides, or the elbow with ``guard``. ``scores`` (by, k, silhouette, gap, s)."""
    a = elbow(scores, by, "silhouette").withColumnRenamed("k", "elbow")
    return a.join(gap_rule(scores, by).withColumnRenamed("k", "gap_k"), by).withColumn("k", F.col("elbow" if guard else "gap_k"))


def criterion_or_elbow(scores: DataFrame, by: list[str], least: float | None = None) -> DataFrame:
    """(by, bic_k, elbow, silhouette, k): the k of the least criterion, or the silhouette's elbow where the silhouette at that k is below ``least``. ``scores`` (by, k, bic, silhouette)."""
    best = best_k(scores, by, "bic").join(scores.select(*by, "k", "silhouette"), [*by, "k"]).withColumnRenamed("k", "bic_k")
    j = best.join(elbow(scores, by, "silhouette").withColumnRenamed("k", "elbow"), by)
    return j.withColumn("k", F.col("bic_k") if least is None else F.when(F.col("silhouette") < least, F.col("elbow")).otherwise(F.col("bic_k")))


def majority(candidates: DataFrame, by: list[str], fallback: str) -> DataFrame:
    """The k that at least two of (a, b, c) name, else that of ``fallback``."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return candidates.select(*by, F.when((a == b) | (a == c), a).when(b == c, b).otherwise(F.col(fallback)).alias("k"))


def size_guard(sizes: DataFrame, by: list[str], ratio: float) -> DataFrame:
    """(by, k, ok): whether every cluster of a solution holds at least ``ratio`` of the rows. ``sizes`` (by, k, cluster, n)."""
    return sizes.groupBy(*by, "k").agg((F.min("n") >= ratio * F.sum("n")).alias("ok"))
