"""Queries of the atlas, of composition regression, of hierarchies and sub-habitats.

Fits have no SQL; property tests on planted habitats stand in its place.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composition, mixture, profiles
from ..sources import results, roi
from . import atlas, hierarchy
from .catalog import ROB, SHARES, query, r, voxel_vectors

HABITATS = [0, 1, 2]
NAMES = ["t2", "md", "t2star", "mtr"]  # as the parameters of the vectors
ATLAS = atlas.Config(restarts=1, steps=15)


def _compositions(spark, sf_dir):
    """(subject, grp, v): shares of the habitats."""
    m = profiles.presence_matrix(roi.cells(spark, sf_dir), HABITATS)
    return m.select("subject", (F.col("subject") % 2).alias("grp"), F.array(*[f"l_{h}" for h in HABITATS]).alias("v"))


@query("g10_design", f"""+ {SHARES}, c AS (SELECT subject, [{', '.join(f'greatest(coalesce(max(share) FILTER (habitat = {h}), 0), 1e-10)' for h in HABITATS)}] AS v FROM sh GROUP BY ALL)
 SELECT CAST(subject % 2 = 0 AS DOUBLE) AS first_group, count(*) AS n, {', '.join(f'{r(f"sum(ln(v[{h + 1}] / list_sum(v)))")} AS s_{h}' for h in HABITATS)} FROM c GROUP BY ALL""")
def g10(spark, sf_dir):
    """Counts and sums of log shares per row of the design: all that the regression's likelihood needs."""
    sums = composition.log_sums(composition.design(_compositions(spark, sf_dir), [0, 1]), len(HABITATS))
    return sums.select(F.get("x", F.lit(1)).alias("first_group"), "n", *[F.get("s", F.lit(i)).alias(f"s_{h}") for i, h in enumerate(HABITATS)])


@query("g9_dirichlet")
def g9(spark, sf_dir):
    """Coefficients of each group against the last, with the test of all of them."""
    f = composition.dirichlet(_compositions(spark, sf_dir), len(HABITATS))
    rows = [(int(g), h, float(b), f.ratio, f.degrees, f.p) for g, line in zip(f.levels[:-1], f.coefficients[1:], strict=True) for h, b in zip(HABITATS, line, strict=True)]
    return spark.createDataFrame(rows, "grp int, habitat int, coefficient double, ratio double, degrees int, p double")


@query("m22_atlas_choice")
def m22(spark, sf_dir):
    """Criteria of the atlas for each k, and the k that their vote takes."""
    _, scores, _ = atlas.fit(voxel_vectors(spark, sf_dir), ATLAS)
    return scores.withColumn("chosen", F.col("k") == F.lit(atlas.chosen_k(scores)))


@query("m25_atlas_stability")
def m25(spark, sf_dir):
    model, _, sample = atlas.fit(voxel_vectors(spark, sf_dir), ATLAS)
    return atlas.stability(sample, model, ATLAS)


@query("m30_zone_habitats")
def m30(spark, sf_dir):
    """Cells of each subject by zone and habitat; subjects without a core are absent."""
    points = voxel_vectors(spark, sf_dir).select(F.col("subject").cast("string").alias("g"), "v", "slice", "x", "y")
    return hierarchy.segment(points, NAMES).groupBy(F.col("g").alias("subject"), "zone", "habitat").agg(F.count(F.lit(1)).alias("n"))


@query("m29_sub_habitats")
def m29(spark, sf_dir):
    return hierarchy.sub_habitats(voxel_vectors(spark, sf_dir)).groupBy("habitat", "sub").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("subject").alias("n_subjects"))


@query("m23_frozen_shares", f"""+ {ROB}, b AS (SELECT subject, slice, x, y, habitat, max(value) FILTER (param = 'T2') AS a, max(value) FILTER (param = 'DTI-MD') AS b FROM rob GROUP BY ALL),
 m AS (SELECT habitat AS h, count(*) / sum(count(*)) OVER () AS w, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) + 1e-4 AS saa, covar_pop(a, b) AS sab, covar_pop(b, b) + 1e-4 AS sbb FROM b GROUP BY habitat),
 e AS (SELECT subject, slice, x, y, h, ln(w) - 0.5 * ln(saa * sbb - sab * sab) - 0.5 * ((a - ma) ** 2 * sbb - 2 * (a - ma) * (b - mb) * sab + (b - mb) ** 2 * saa) / (saa * sbb - sab * sab) AS l FROM b CROSS JOIN m),
 q AS (SELECT subject, slice, x, y, h, exp(l - max(l) OVER w) AS q FROM e WINDOW w AS (PARTITION BY subject, slice, x, y)), p AS (SELECT subject, h, q / sum(q) OVER (PARTITION BY subject, slice, x, y) AS p FROM q)
 SELECT subject, CAST(h AS INTEGER) AS habitat, {r('avg(p)')} AS pi FROM p GROUP BY ALL""")
def m23(spark, sf_dir):
    """Mean posteriors of each subject under an atlas that was stored and read again; its components are the given habitats in two parameters."""
    points = voxel_vectors(spark, sf_dir).select("subject", "habitat", F.slice("v", 1, 2).alias("v"))
    points = results.written(points, "cells")
    fitted = mixture.of_labels(points, "habitat", atlas.REG)
    if not len(fitted.means):  # no cells, so there is no atlas to store
        return points.select("subject", "habitat", F.lit(None).cast("double").alias("pi"))
    path = results.run_folder(spark, "atlas")
    results.write_atlas(spark, fitted, NAMES[:2], path)
    model, _, _ = results.read_atlas(spark, path)
    scored = mixture.score(points, model)
    return scored.select("subject", F.posexplode("proba").alias("habitat", "p")).groupBy("subject", "habitat").agg(F.avg("p").alias("pi"))


@query("q6_atlas_verdicts")
def q6(spark, sf_dir):
    """From cells to the verdicts of all six steps, even against odd subjects."""
    points = voxel_vectors(spark, sf_dir).drop("habitat")
    groups = points.select("subject").distinct().withColumn("grp", F.col("subject") % 2)
    return atlas.run(points, groups, NAMES, results.run_folder(spark, "atlas"), atlas.Config(restarts=1, steps=15, resamples=10))[0]
