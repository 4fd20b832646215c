"""Whole analyses made of the operators: per subject, joint, and discovery across subjects.

Each takes the canonical long table and returns DataFrames; what the driver
holds between steps is parameters and counts per (subject, k, cluster). Cells
with their labels are written between steps, so that spatial features can be
taken from a first clustering and fed into a second one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import mixture, pairs, passes, profiles, rules, scaling, selection, spatial
from ..sources.results import written


@dataclass(frozen=True)
class Config:
    ks: tuple[int, ...] = (2, 3, 4, 5)
    seed: int = 35
    restarts: int = 2
    steps: int = 30
    least_share: float = 0.05
    joint_least_share: float = 0.03
    per_subject: int = 500
    least_cells: int = 30
    # Weights of the distance column for a subject's own clustering and the joint one, and a subject's least share of necrosis.
    distance_weight: float = 1.0
    joint_distance_weight: float = 0.3
    least_necrosis: float = 0.05


#: Columns of the rules' profiles by parameter.
PROFILE = {"T2": "t2", "DTI-MD": "md", "DTI-FA": "fa", "T2star": "t2star", "MTR": "mtr", "DTI-RD": "rd", "DTI-AD": "ad"}
CELL = ["subject", "slice", "x", "y"]


def scaled_points(long: DataFrame, params: list[str], scheme=scaling.robust) -> DataFrame:
    """(subject, slice, x, y, v): scaled tumour cells, missing parameters 0."""
    s = scheme(long).drop("value").withColumnRenamed("scaled", "value")
    return pairs.vectors(s, CELL, params, "value")


def guarded_k(points: DataFrame, models: dict[tuple[str, int], mixture.Mixture], best: dict[str, int], least_share: float, least: int = 0) -> dict[str, int]:
    """Per group the largest k up to the best whose clusters all hold the least share and number; at least the smallest k.

    All k are counted in one pass over the cells.
    """
    shared = points.sparkSession.sparkContext.broadcast(models)
    ks = sorted({k for _, k in models})

    @F.pandas_udf("array<int>")
    def labels(g: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros((len(g), len(ks)), int)
        for name in pd.unique(g):
            here = np.flatnonzero(g.to_numpy() == name)
            x = np.array(v.iloc[here].tolist(), float)
            for i, k in enumerate(ks):
                if (name, k) in shared.value:
                    out[here, i] = shared.value[name, k].posteriors(x)[0].argmax(1)
        return pd.Series(out.tolist())

    each = points.select("g", F.posexplode(labels("g", "v")).alias("i", "cluster")).groupBy("g", "i", "cluster").count().collect()
    sizes: dict[tuple[str, int], list[int]] = {}
    for r in each:
        sizes.setdefault((r["g"], ks[r["i"]]), []).append(r["count"])
    out = {}
    for g, k in best.items():
        ok = [x for x in ks if x <= k and len(sizes[g, x]) == x and min(sizes[g, x]) >= max(least, least_share * sum(sizes[g, x]))]
        out[g] = max(ok, default=ks[0])
    return out


def cluster_profiles(rows: DataFrame, params: list[str], keys: list[str]) -> DataFrame:
    """(keys, n, t2, md, ...; d): mean parameters of each cluster, from the first components of ``v``, and its mean seed distance ``d``.

    Parameters that were not measured are NULL, as is ``d`` where no cell has one; MD comes from AD and RD where only those were.
    """
    at = {c: F.avg(F.col("v")[params.index(p)]) if p in params else F.lit(None).cast("double") for p, c in PROFILE.items()}
    d = F.avg("d") if "d" in rows.columns else F.lit(None).cast("double")
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), d.alias("d"), *[e.alias(c) for c, e in at.items()])
    return out.withColumn("md", X.virtual_md(F.col("md"), F.col("ad"), F.col("rd")))


def voted_labels(p: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label): the label that the votes on a profile give; the last key is the cluster."""
    return rules.decide(rules.weighted_vote(rules.votes(rules.profile_features(p, keys[:-1]), keys), keys), keys).select(*keys, "label")


def solutions(points: DataFrame, models: dict[tuple[str, int], mixture.Mixture], params: list[str]) -> DataFrame:
    """(g, k, cluster, n, label) of every model on all cells of its group, in one pass; ``points`` (g, v, d)."""
    shared = points.sparkSession.sparkContext.broadcast(models)
    ks = sorted({k for _, k in models})

    @F.pandas_udf("array<int>")
    def labels(g: pd.Series, v: pd.Series) -> pd.Series:
        out = np.full((len(g), len(ks)), -1)
        for name in pd.unique(g):
            here = np.flatnonzero(g.to_numpy() == name)
            x = np.array(v.iloc[here].tolist(), float)
            for i, k in enumerate(ks):
                if (name, k) in shared.value:
                    out[here, i] = shared.value[name, k].posteriors(x)[0].argmax(1)
        return pd.Series(out.tolist())

    each = points.select("g", "v", *[c for c in ("d",) if c in points.columns], F.posexplode(labels("g", "v")).alias("i", "cluster")).where("cluster >= 0")
    each = each.withColumn("k", F.element_at(F.array(*[F.lit(k) for k in ks]), F.col("i") + 1))
    p = written(cluster_profiles(each, params, ["g", "k", "cluster"]), "solutions")
    return p.select("g", "k", "cluster", "n").join(voted_labels(p, ["g", "k", "cluster"]), ["g", "k", "cluster"])


def size_guarded_k(points: DataFrame, models: dict[tuple[str, int], mixture.Mixture], best: dict[str, int], params: list[str], least_share: float, protect: bool) -> dict[str, int]:
    """Per group the first k from the best one downwards without a cluster that is too small, where ``protect`` spares small clusters by their label; 2 at least."""
    if not models:
        return {}
    start = points.sparkSession.createDataFrame(sorted(best.items()), "g string, start int")  # a row a group
    sizes = solutions(points, models, params).join(start, "g")
    guard = passes.size_guarded(sizes, ["g"], "start", least_share, floor=min(k for _, k in models), **({} if protect else {"protected": ()}))
    return {r["g"]: r["k"] for r in guard.collect()}


def prepared(points: DataFrame, params: list[str], cfg: Config = Config()) -> DataFrame:
    """``points`` (subject, slice, x, y, v) with ``d``, the distance to the more necrotic one of two clusters of the subject, and ``necrotic``.

    Where that cluster is clearly necrotic, ``v`` gets the distance as a last component, weighted; in slices without
    seed the subject's mean distance (0.5 if it has none). Otherwise ``v`` stays as it is.
    """
    rows = written(points.withColumn("g", F.col("subject").cast("string")), "prepared")
    two = {g: m for (g, _), m in mixture.fit_all(rows, [2], cfg.seed, cfg.restarts, cfg.steps).items()}
    found = written(mixture.predict(rows, two).drop("proba"), "prepared")
    guard = rules.necrosis_guard(cluster_profiles(found, params, ["subject", "label"]), ["subject"], "label")
    guard = written(guard, "guard")
    seeded = scaling.with_stats(found, guard, ["subject"])
    d = written(spatial.seed_distance(seeded, F.col("label") == F.col("candidate")).select(*CELL, F.col("d_norm").alias("d")), "seed-distance")
    mean = d.groupBy("subject").agg(F.coalesce(F.avg("d"), F.lit(0.5)).alias("fill"))
    stats = guard.join(mean, "subject").select("subject", F.col("passes").alias("necrotic"), "fill")
    out = scaling.with_stats(rows.join(d, CELL), stats, ["subject"])
    more = F.array(F.coalesce("d", "fill") * F.lit(cfg.distance_weight))
    return out.withColumn("v", F.when(F.col("necrotic"), F.concat("v", more)).otherwise(F.col("v"))).drop("fill")


def classic(long: DataFrame, params: list[str], cfg: Config = Config(), scheme=scaling.robust) -> DataFrame:
    """Habitats of each subject: (subject, slice, x, y, v, d, necrotic, habitat, proba, confidence).

    The number of habitats is the best one by BIC, lowered while a cluster is too small and not protected by its label.
    """
    points = written(prepared(scaled_points(long, params, scheme), params, cfg), "classic")
    models = mixture.fit_all(points, list(cfg.ks), cfg.seed, cfg.restarts, cfg.steps)
    scores = points.sparkSession.createDataFrame([(g, k, float(m.bic())) for (g, k), m in models.items()], "g string, k int, bic double")
    best = {r["g"]: r["k"] for r in selection.best_k(scores, ["g"], "bic").collect()}  # a row per subject
    k = size_guarded_k(points, models, best, params, cfg.least_share, protect=True)
    return _assigned(points, {g: models[g, x] for g, x in k.items()})


def balanced_sample(points: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly n cells of each subject, chosen by a seeded hash; a subject with fewer is drawn from with replacement.

    Ranks are limited before the shuffle, so that a task holds n cells of a subject, not all.
    """
    h = F.xxhash64(F.lit(seed), *CELL)
    w = Window.partitionBy("subject").orderBy("h", *CELL)
    pool = points.withColumn("h", h).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("h")
    pool = pool.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("subject")))
    spare = pool.where(F.col("m") < n)
    draws = spare.select("subject", "m").distinct().select("subject", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"), "m")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "subject", "i"), 12).cast("double") + 0.5) / float(1 << 52)
    again = draws.select("subject", (F.floor(u * F.col("m")) + 1).cast("int").alias("rn")).join(spare.drop("m"), ["subject", "rn"])
    return pool.where(F.col("m") >= n).drop("m", "rn").unionByName(again.drop("rn"))


def joint_once(points: DataFrame, params: list[str], cfg: Config, k: int | None = None) -> tuple[DataFrame, int]:
    """(cells with their habitat, k): one clustering of all subjects, fitted on equally many cells of each and applied to all.

    Without ``k`` the best one by BIC on all cells, lowered while a cluster is too small.
    """
    sample = written(balanced_sample(points, cfg.per_subject, cfg.seed), "joint-sample")
    models = mixture.fit_all(sample, [k] if k else list(cfg.ks), cfg.seed, cfg.restarts, cfg.steps)
    if not models:  # no cells
        return _assigned(points, {}), 0
    if not k:
        bics = {x: models["all", x].bic_of(n, ll) for (_, x), (n, ll, _) in mixture.evaluate(points, models).items()}
        k = size_guarded_k(points, models, {"all": min(cfg.ks, key=lambda x: bics[x])}, params, cfg.joint_least_share, protect=False)["all"]
    return _assigned(points, {"all": models["all", k]}), k


def joint(long: DataFrame, params: list[str], cfg: Config = Config(), scheme=scaling.cohort) -> DataFrame:
    """Habitats of all subjects together, in two passes: (subject, slice, x, y, v, habitat, proba, confidence, habitat_1, included, d_scaled).

    If a habitat of the first pass is clearly necrotic, each cell gets its scaled distance to it (0 in subjects with too
    little of it and in slices without any) as a weighted component, and the cells are clustered anew with as many
    habitats. Otherwise the first pass stands, ``included`` is false and ``d_scaled`` NULL.
    """
    points = written(scaled_points(long, params, scheme).withColumn("g", F.lit("all")), "joint")
    first, k = joint_once(points, params, cfg)
    first = written(first, "joint-first")
    guard = rules.necrosis_guard(cluster_profiles(first.withColumn("g", F.lit(0)), params, ["g", "habitat"]), ["g"]).first()
    if guard is None or not guard["passes"] or not cfg.joint_distance_weight:
        return first.withColumns({"habitat_1": F.col("habitat"), "included": F.lit(False), "d_scaled": F.lit(None).cast("double")})
    d = written(spatial.joint_distance(first, guard["candidate"], cfg.least_necrosis), "joint-distance")
    more = first.select(*CELL, "v", F.col("habitat").alias("habitat_1")).join(d, CELL)
    more = more.withColumns({"v": F.concat("v", F.array(F.col("d_scaled") * F.lit(cfg.joint_distance_weight))), "g": F.lit("all")})
    return joint_once(written(more, "joint-second"), params, cfg, k)[0]


def _assigned(points: DataFrame, models: dict[str, mixture.Mixture]) -> DataFrame:
    out = mixture.predict(points, models).withColumnRenamed("label", "habitat")
    return out.withColumn("confidence", F.array_max("proba")).drop("g")


def discovery(assigned: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Meta-habitats: the subjects' habitat means, clustered; (subject, habitat, n, proportion, v, meta, rate).

    Habitats of fewer than ``least_cells`` cells are left out; the number of
    meta-habitats has the largest silhouette; ``rate`` is the share of
    subjects in which a meta-habitat occurs.
    """
    n = profiles.shares(assigned, ["subject"]).where(F.col("n") >= cfg.least_cells)
    means = assigned.select("subject", "habitat", F.posexplode("v").alias("i", "x")).groupBy("subject", "habitat", "i").agg(F.avg("x").alias("x"))
    means = means.groupBy("subject", "habitat").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))  # one number per parameter
    inst = written(n.join(means, ["subject", "habitat"]).withColumn("g", F.lit("all")), "instances")
    spark, count = assigned.sparkSession, inst.count()
    fits = {k: c for (_, k, _), (c, _) in mixture.kmeans_all(inst, [k for k in cfg.ks if k < count], cfg.seed, restarts=1).items()}
    scored = []
    for k, centres in fits.items():  # a handful of k over summary rows
        d = F.array(*[F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in centres])
        lab = inst.withColumn("meta", F.array_position(d, F.array_min(d)).cast("int") - 1)
        s = pairs.silhouette(lab.select(F.concat_ws("|", F.col("subject").cast("string"), F.col("habitat").cast("string")).alias("id"), F.col("meta").alias("label"), "v"))
        scored.append((s.agg(F.sum(F.col("silhouette") * F.col("n")) / F.sum("n")).first()[0] or -1.0, -k, lab))
    if not scored:
        return inst.withColumn("meta", F.lit(0)).withColumn("rate", F.lit(1.0)).select("subject", "habitat", "n", F.col("share").alias("proportion"), "v", "meta", "rate")
    lab = max(scored, key=lambda x: x[:2])[2]
    subjects = inst.select("subject").distinct().count()
    rate = lab.groupBy("meta").agg((F.count_distinct("subject") / F.lit(subjects)).alias("rate"))
    return lab.join(rate, "meta").select("subject", "habitat", "n", F.col("share").alias("proportion"), "v", "meta", "rate")


def discovered_cells(long: DataFrame, params: list[str], cfg: Config = Config(), scheme=scaling.robust) -> DataFrame:
    """Cells to cells: each subject is segmented by itself, its habitats are grouped over subjects, and the groups go back to the cells.

    (subject, slice, x, y, habitat, confidence, meta, rate); ``meta`` is NULL in habitats too small to be grouped.
    """
    cells = written(classic(long, params, cfg, scheme).withColumn("v", F.slice("v", 1, len(params))), "discovery-cells")  # without distances, which are a subject's own
    meta = written(discovery(cells, cfg).select("subject", "habitat", "meta", "rate"), "discovery-meta")
    return scaling.with_stats(cells.select(*CELL, "habitat", "confidence"), meta, ["subject", "habitat"], how="left")
