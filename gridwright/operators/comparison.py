"""Comparison of habitats across sources (subjects, methods): one record per label.

``instances`` (source, cluster, label, v, z, proportion, eta2, weight, low_conf): habitat means of each source, scaled
(``v``) and against its reference tissue (``z``). They are summary rows: sources times clusters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .pairs import all_pairs

# Norm below which direction means nothing, tolerance of shapes, and the least weighted cosine of a coherent label.
NEAR_ORIGIN, SHAPE, WEIGHTED = 0.35, 0.25, 0.45


def divergent(a: Column, b: Column) -> Column:
    """How many components of two unit vectors differ by more than the tolerance; none near the origin."""
    na, nb = X.norm(a), X.norm(b)
    apart = F.zip_with(F.transform(a, lambda x: x / na), F.transform(b, lambda x: x / nb), lambda x, y: F.abs(x - y))
    return F.when(F.least(na, nb) < NEAR_ORIGIN, 0).otherwise(F.size(F.filter(apart, lambda d: d > SHAPE)))


def label_pairs(instances: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of instances of one label (and one group of ``by``), each once: (by, label, sa, ca, sb, cb, va, vb)."""
    a = instances.select(*by, "label", F.col("source").alias("sa"), F.col("cluster").alias("ca"), F.col("v").alias("va"))
    b = instances.select(*by, "label", F.col("source").alias("sb"), F.col("cluster").alias("cb"), F.col("v").alias("vb"))
    return a.join(b, [*by, "label"]).where("sa < sb or sa = sb and ca < cb")


def archetypes(instances: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, archetype, magnitude): mean of ``z`` per label; labels without or with a near-zero archetype have none."""
    parts = instances.where("z is not null").select(*by, "label", F.posexplode("z").alias("i", "x")).groupBy(*by, "label", "i").agg(F.avg("x").alias("x"))
    a = parts.groupBy(*by, "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("archetype"))  # a number per parameter
    return a.withColumn("magnitude", X.norm(F.col("archetype"))).where("magnitude >= 1e-8")


def compare(instances: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per label: separation from the other labels, agreement across sources, presence, spread of proportions, alignment with the archetype.

    Groups of ``by`` are compared apart. Such a group has to be small, like the methods on one subject; the whole table may have any size.
    """
    key = [*by, "label"]
    p = label_pairs(instances, by).where("sa <> sb")
    va, vb = F.col("va"), F.col("vb")
    inside = p.groupBy(*key).agg(
        F.avg(X.cosine_distance(va, vb)).alias("intra_cosine"), F.avg(X.euclidean(va, vb)).alias("intra_euclid"), F.avg(X.weighted_cosine(va, vb)).alias("weighted_cosine"),
        F.count_if(F.least(X.norm(va), X.norm(vb)) < NEAR_ORIGIN).alias("n_skipped"), F.count_if(divergent(va, vb) == 0).alias("n_concordant"), F.count(F.lit(1)).alias("n_pairs"))
    each = instances.select(*by, F.struct("source", "cluster").alias("id"), "label", "v")
    if by:
        ends = [each.select(*by, F.col("label").alias(f"label_{e}"), F.col("v").alias(f"v_{e}")) for e in "ab"]
        apart = ends[0].join(ends[1], [*by])
    else:
        apart = all_pairs(each, ["label", "v"])
    across = apart.where("label_a <> label_b").groupBy(*by, F.col("label_a").alias("label")).agg(
        F.avg(X.cosine_distance(F.col("v_a"), F.col("v_b"))).alias("inter_cosine"), F.avg(X.euclidean(F.col("v_a"), F.col("v_b"))).alias("inter_euclid"))
    total = instances.groupBy(*by).agg(F.count_distinct("source").alias("n_sources_total"))
    mean = F.avg("proportion")
    own = instances.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_instances"), F.count_distinct("source").alias("n_sources"), mean.alias("mean_proportion"),
        F.when(mean > 1e-6, F.coalesce(F.stddev_samp("proportion"), F.lit(0.0)) / mean).otherwise(0.0).alias("proportion_cv"),
        F.count_if("low_conf").alias("low_conf"), (F.sum(F.col("weight") * F.col("eta2")) / F.sum("weight")).alias("weighted_eta2"))
    aligned = instances.where("z is not null").join(archetypes(instances, by), key)
    size = X.norm(F.col("z")) / F.col("magnitude")
    aligned = aligned.groupBy(*key).agg(F.avg(1 - X.cosine_distance(F.col("z"), F.col("archetype"))).alias("arch_align"), F.when(F.count(F.lit(1)) > 1, F.stddev_pop(size) / F.avg(size)).alias("mag_cv"))
    j = own.join(inside, key, "left").join(across, key, "left").join(aligned, key, "left")
    j = j.join(total, [*by]) if by else j.join(F.broadcast(total))  # one row
    filled = {"intra_cosine": 0.0, "intra_euclid": 0.0, "inter_cosine": 1.0, "inter_euclid": 1.0, "weighted_cosine": 1.0, "n_skipped": 0, "n_concordant": 0, "n_pairs": 0}
    j = j.na.fill(filled)
    ratio = lambda a, b: F.when(F.col(b) > 1e-8, F.col(a) / F.col(b)).otherwise(0.0)
    j = j.withColumns({"ratio": ratio("intra_cosine", "inter_cosine"), "ratio_euclid": ratio("intra_euclid", "inter_euclid"), "presence_rate": F.col("n_sources") / F.col("n_sources_total")})
    coherent = (F.col("ratio") < 0.5) & (F.col("ratio_euclid") < 0.5) & (F.col("weighted_cosine") >= WEIGHTED)
    return j.withColumns({"coherent": coherent, "c1": 1 - F.col("ratio")})


def within_divergence(instances: DataFrame) -> DataFrame:
    """(label, source, cluster, other_source, other_cluster, n_divergent): instances of sources that hold two unlike clusters of a label, against the other sources'."""
    p = label_pairs(instances)
    unlike = p.where((F.col("sa") == F.col("sb")) & (divergent(F.col("va"), F.col("vb")) > 0)).select("label", F.col("sa").alias("source")).distinct()
    a = instances.join(unlike, ["label", "source"], "left_semi").select("label", "source", "cluster", "v")
    b = instances.select("label", F.col("source").alias("other_source"), F.col("cluster").alias("other_cluster"), F.col("v").alias("w"))
    return a.join(b, "label").where("source <> other_source").select("label", "source", "cluster", "other_source", "other_cluster", divergent(F.col("v"), F.col("w")).alias("n_divergent"))


def greedy_match(pairs: DataFrame, by: list[str], a: str, b: str, score: str, threshold: float = 0.65) -> DataFrame:
    """One-to-one matches within ``by``: the ``a`` in their order each take the best free ``b`` with a score above ``threshold``.

    The habitats of one group of ``by`` are few (two sets of clusters), so a group is one fold over its sorted pairs.
    """
    item = F.struct(F.col(a).alias("a"), (-F.col(score)).alias("s"), F.col(b).alias("b"))
    g = pairs.where(F.col(score) > threshold).groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("p"))
    none = F.array().cast(g.schema["p"].dataType)
    step = lambda done, x: F.when(F.exists(done, lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"])), done).otherwise(F.concat(done, F.array(x)))
    return g.select(*by, F.explode(F.aggregate("p", none, step)).alias("m")).select(*by, F.col("m.a").alias(a), F.col("m.b").alias(b), (-F.col("m.s")).alias(score))


# By measure, the tiers and what the largest mean, its distance to the least one, or their ratio must pass.
TREND = 0.10
SPREAD_HIGH, SPREAD_HIGH_RATIO, SPREAD_MORE, SPREAD_SLIGHT = 2.0, 1.4, 1.5, 1.2
RESIDUAL_HIGH, RESIDUAL_RATIO = 1.5, 1.4


def group_verdicts(descriptors: DataFrame, groups: DataFrame) -> DataFrame:
    """Per cluster and measure (pi, sigma2, residual): each group's mean and spread, the ratio of the extreme means, and a tier.

    ``descriptors`` (subject, cluster, pi, sigma2, residual), ``groups`` (subject, grp).
    """
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("pi", "sigma2", "residual")])
    j = descriptors.join(groups, "subject").select("cluster", "grp", F.inline(rows))
    g = j.groupBy("cluster", "measure", "grp").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    e = g.groupBy("cluster", "measure").agg(F.max("mean").alias("most"), F.min("mean").alias("least"), F.max_by("grp", F.struct("mean", -F.col("grp"))).alias("top_group"))
    ratio = F.when(F.col("least") > 1e-8, F.col("most") / F.col("least")).otherwise(F.lit(1.0))
    m = F.col("measure")
    tier = F.when(m == "pi", F.when(F.col("most") - F.col("least") > TREND, "trend").otherwise("equal")).when(
        m == "sigma2", F.when((F.col("most") > SPREAD_HIGH) & (ratio > SPREAD_HIGH_RATIO), "high").when(ratio > SPREAD_MORE, "more heterogeneous").when(ratio > SPREAD_SLIGHT, "slight").otherwise("comparable")).otherwise(
        F.when(F.col("most") > RESIDUAL_HIGH, "high").when(ratio > RESIDUAL_RATIO, "farther").otherwise("aligned"))
    return g.join(e.withColumns({"ratio": ratio, "tier": tier}), ["cluster", "measure"]).select("cluster", "measure", "grp", "mean", "sd", "top_group", "ratio", "tier")
