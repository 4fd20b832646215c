"""Pairs of summary vectors (habitat means of subjects): similarity, coherence, grouping.

Pairs are formed between summary rows only (subjects x habitats), never
between cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def vectors(means: DataFrame, by: list[str], params: list[str], value: str = "mean") -> DataFrame:
    """(by, v): means of the listed parameters in order, 0 where missing."""
    cols = [F.coalesce(F.max(F.when(F.col("param") == p, F.col(value))), F.lit(0.0)) for p in params]
    return means.groupBy(*by).agg(F.array(*cols).alias("v"))


#: Summary rows of a tile.
TILE = 256


def all_pairs(points: DataFrame, cols: list[str], key: str = "id") -> DataFrame:
    """Ordered pairs of different rows, columns with _a and _b, by an equi-join of tiles: no side is broadcast whole, and a task sees a tile of each."""
    tiles = max(1, -(-points.count() // TILE))
    own = F.pmod(F.xxhash64(key), F.lit(tiles)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    a = points.select(F.col(key).alias("id_a"), *[F.col(c).alias(f"{c}_a") for c in cols], own.alias("i"), every.alias("j"))
    b = points.select(F.col(key).alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in cols], own.alias("j"), every.alias("i"))
    return a.join(b.hint("shuffle_merge"), ["i", "j"]).where("id_a <> id_b").drop("i", "j")


def instance_pairs(instances: DataFrame, source: str = "subject", label: str = "habitat") -> DataFrame:
    """Pairs of instances of one label from different sources, with distances."""
    a = instances.select(F.col(source).alias("a"), label, F.col("v").alias("va"))
    b = instances.select(F.col(source).alias("b"), label, F.col("v").alias("vb"))
    return a.join(b, label).where("a < b").select(
        label, "a", "b", X.cosine_distance(F.col("va"), F.col("vb")).alias("cosine"), X.euclidean(F.col("va"), F.col("vb")).alias("euclid"), X.weighted_cosine(F.col("va"), F.col("vb")).alias("weighted"))


def coherence(instances: DataFrame, source: str = "subject", label: str = "habitat") -> DataFrame:
    """Per label: mean distances inside and to other labels, their ratio, and whether the label is coherent."""
    inside = instance_pairs(instances, source, label).groupBy(label).agg(
        F.avg("cosine").alias("intra"), F.avg("euclid").alias("intra_euclid"), F.avg("weighted").alias("weighted"), F.count(F.lit(1)).alias("n_pairs"))
    each = instances.select(F.struct(source, label).alias("id"), F.col(label).alias("label"), "v")
    across = all_pairs(each, ["label", "v"]).where("label_a <> label_b").groupBy(F.col("label_a").alias(label)).agg(
        F.avg(X.cosine_distance(F.col("v_a"), F.col("v_b"))).alias("inter"), F.avg(X.euclidean(F.col("v_a"), F.col("v_b"))).alias("inter_euclid"))
    out = across.join(inside, label, "left")
    out = out.withColumns({"intra": F.coalesce("intra", F.lit(0.0)), "intra_euclid": F.coalesce("intra_euclid", F.lit(0.0)), "weighted": F.coalesce("weighted", F.lit(1.0)), "n_pairs": F.coalesce("n_pairs", F.lit(0))})
    ratio, ratio_e = F.col("intra") / F.col("inter"), F.col("intra_euclid") / F.col("inter_euclid")
    return out.withColumns({"ratio": ratio, "ratio_euclid": ratio_e, "coherent": (ratio < 0.5) & (ratio_e < 0.5) & (F.col("weighted") >= 0.45)})


def shape_concordance(instances: DataFrame, tolerance: float = 0.25, source: str = "subject", label: str = "habitat") -> DataFrame:
    """Pairs of one label with the number of unit-vector components that differ by more than ``tolerance``; near-zero pairs agree."""
    def unit(v):
        return F.transform(v, lambda x: x / X.norm(v))

    a = instances.select(F.col(source).alias("a"), label, F.col("v").alias("va"))
    b = instances.select(F.col(source).alias("b"), label, F.col("v").alias("vb"))
    pairs = a.join(b, label).where("a < b")
    tiny = (X.norm(F.col("va")) < 1e-8) | (X.norm(F.col("vb")) < 1e-8)
    apart = F.size(F.filter(F.zip_with(unit(F.col("va")), unit(F.col("vb")), lambda x, y: F.abs(x - y)), lambda d: d > tolerance))
    return pairs.select(label, "a", "b", F.when(tiny, 0).otherwise(apart).alias("n_divergent"), F.when(tiny, True).otherwise(apart == 0).alias("concordant"))


def aitchison(parts: DataFrame, key: str = "subject") -> DataFrame:
    """Pairs (a < b) of compositions with the Aitchison distance. ``parts`` (key, v)."""
    c = parts.select(F.col(key).alias("id"), X.clr(F.col("v")).alias("c"))
    p = all_pairs(c, ["c"]).where("id_a < id_b")
    return p.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), X.euclidean(F.col("c_a"), F.col("c_b")).alias("distance"))


def permanova(pairs: DataFrame, groups: DataFrame, key: str = "subject") -> DataFrame:
    """Pseudo-F and R2 from pair distances (a, b, distance) and ``groups`` (key, grp)."""
    g = groups.select(F.col(key), "grp")
    sizes = g.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.join(g.select(F.col(key).alias("a"), F.col("grp").alias("ga")), "a").join(g.select(F.col(key).alias("b"), F.col("grp").alias("gb")), "b")
    sq = F.col("distance") ** 2
    within = both.where("ga = gb").groupBy(F.col("ga").alias("grp")).agg(F.sum(sq).alias("s")).join(sizes, "grp").agg(F.sum(F.col("s") / F.col("n")).alias("ss_within"))
    total = both.agg(F.sum(sq).alias("s"))
    counts = sizes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    out = total.join(F.broadcast(within)).join(F.broadcast(counts))  # one row each
    ss, ssw = F.col("s") / F.col("n"), F.col("ss_within")
    return out.select(ss.alias("ss_total"), ssw.alias("ss_within"), (((ss - ssw) / (F.col("k") - 1)) / (ssw / (F.col("n") - F.col("k")))).alias("f"), ((ss - ssw) / ss).alias("r2"))


def mmd(points: DataFrame, sigma: float, group: str = "grp", key: str = "id") -> DataFrame:
    """Unbiased squared maximum mean discrepancy of each pair of groups of a bounded sample ``points`` (group, key, v), floored at 0."""
    p = all_pairs(points.select(F.col(key).alias("id"), F.col(group).alias("g"), "v"), ["g", "v"])
    d = X.euclidean(F.col("v_a"), F.col("v_b"))
    means = p.where("g_a <= g_b").groupBy(F.col("g_a").alias("ga"), F.col("g_b").alias("gb")).agg(F.avg(X.rbf(d * d, sigma)).alias("k"))
    own = means.where("ga = gb").select(F.col("ga").alias("g"), F.col("k").alias("own"))
    cross = means.where("ga < gb")
    out = cross.join(own.select(F.col("g").alias("ga"), F.col("own").alias("ka")), "ga").join(own.select(F.col("g").alias("gb"), F.col("own").alias("kb")), "gb")
    return out.select("ga", "gb", F.greatest(F.col("ka") + F.col("kb") - 2 * F.col("k"), F.lit(0.0)).alias("mmd2"))


def bandwidth(points: DataFrame, key: str = "id") -> DataFrame:
    """One row ``sigma``: root of half the median squared distance between different points of a summary table."""
    p = all_pairs(points.select(F.col(key).alias("id"), "v"), ["v"])
    sq = X.euclidean(F.col("v_a"), F.col("v_b")) ** 2
    return p.select(sq.alias("sq")).where("sq > 0").agg(F.sqrt(F.median("sq") / 2).alias("sigma"))


def conditional_mmd(points: DataFrame, by: str, sigma: float, least: int = 10) -> DataFrame:
    """(by, n0, n1, mmd2): discrepancy of the groups 0 and 1 of ``points`` (by, grp, id, v) within each value of ``by``; NULL with fewer than ``least`` points of a group."""
    n = points.groupBy(by).agg(F.count_if(F.col("grp") == 0).alias("n0"), F.count_if(F.col("grp") == 1).alias("n1"))
    a = points.select(by, F.col("grp").alias("ga"), F.col("id").alias("ia"), F.col("v").alias("va"))
    b = points.select(by, F.col("grp").alias("gb"), F.col("id").alias("ib"), F.col("v").alias("vb"))
    k = X.rbf(X.euclidean(F.col("va"), F.col("vb")) ** 2, sigma)
    pick = lambda x, y: F.avg(F.when((F.col("ga") == x) & (F.col("gb") == y), k))
    m = a.join(b, by).where("ia <> ib").groupBy(by).agg((pick(0, 0) + pick(1, 1) - 2 * pick(0, 1)).alias("m"))
    return n.join(m, by).select(by, "n0", "n1", F.when((F.col("n0") >= least) & (F.col("n1") >= least), F.greatest("m", F.lit(0.0))).alias("mmd2"))


def silhouette(points: DataFrame, label: str = "label", key: str = "id", cosine: bool = False) -> DataFrame:
    """Mean Euclidean (or cosine) silhouette per label of a bounded sample ``points`` (key, label, v); 0 for labels of one point."""
    p = all_pairs(points.select(F.col(key).alias("id"), F.col(label).alias("l"), "v"), ["l", "v"])
    apart = X.cosine_distance(F.col("v_a"), F.col("v_b")) if cosine else X.euclidean(F.col("v_a"), F.col("v_b"))
    d = p.groupBy(F.col("id_a").alias("ia"), F.col("l_a").alias("la"), F.col("l_b").alias("lb")).agg(F.avg(apart).alias("d"))
    s = d.groupBy("ia", "la").agg(F.max(F.when(F.col("la") == F.col("lb"), F.col("d"))).alias("own"), F.min(F.when(F.col("la") != F.col("lb"), F.col("d"))).alias("other"))
    one = F.when(F.col("own").isNull(), 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))
    return s.groupBy(F.col("la").alias(label)).agg(F.avg(one).alias("silhouette"), F.count(F.lit(1)).alias("n"))
