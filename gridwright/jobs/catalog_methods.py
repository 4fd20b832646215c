"""Queries on the choice of method, on comparisons from cells, and summaries of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import descriptors, profiles, scaling, spatial
from ..sources import results, roi
from . import methods, modes
from .catalog import ASSIGN, PARAMS, ROB, SHARES, assigned, longs, query, r
from .catalog_modes import CFG


def _points(spark, sf_dir):
    return results.written(modes.scaled_points(longs(spark, sf_dir), PARAMS), "cells")


@query("m12_chosen_k")
def m12(spark, sf_dir):
    """Per method and subject the number of clusters by the method's own rule (that of ``srsc`` is ``m11_spectral_k``)."""
    points = _points(spark, sf_dir)
    picked = [methods.choose_k(points, m, [2, 3, 4], refs=3)[0].select(F.lit(m).alias("method"), F.col("g").alias("subject"), "elbow", "k") for m in ("gmm", "kmeans")]
    return picked[0].unionByName(picked[1])


@query("m4_method_sizes")
def m4(spark, sf_dir):
    """Cells per subject and cluster by mixtures and k-means, k as chosen for mixtures (``m3_spectral_sizes`` has the third method)."""
    points = _points(spark, sf_dir)
    choice, models = methods.choose_k(points, "gmm", [2, 3, 4])
    k = {r["g"]: r["k"] for r in choice.collect()}  # a row per subject
    out = None
    for m in ("gmm", "kmeans"):
        one = methods.cluster(points, m, k, models if m == "gmm" else None).groupBy("subject", F.lit(m).alias("method"), "label").agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("q7_subjects_compared")
def q7(spark, sf_dir):
    """Each subject's own analysis, then one record per label across subjects."""
    return methods.across_subjects(longs(spark, sf_dir), PARAMS, CFG)


@query("q8_methods_compared")
def q8(spark, sf_dir):
    """Each subject by three methods, then one record per subject and label across methods."""
    return methods.across_methods(longs(spark, sf_dir), PARAMS, 3)


# --- summaries of a run --------------------------------------------------------------------


@query("a37_run_summary", f"""RECURSIVE + {ASSIGN}, cu AS (SELECT subject, slice, x, y, max(p) AS confidence FROM po GROUP BY ALL),
 cn AS (SELECT subject, count(*) AS n, count(*) FILTER (confidence >= 0.8) AS n_sure, count(*) FILTER (confidence < 0.5) AS n_unsure FROM cu GROUP BY subject),
 cc AS (SELECT subject, slice, habitat, x, y, (subject * 10 + slice) * 16384 + y * 128 + x AS id FROM cells),
 ed AS (SELECT a.id AS a, b.id AS b FROM cc a JOIN cc b ON a.subject = b.subject AND a.slice = b.slice AND a.habitat = b.habitat AND ((b.y = a.y AND b.x IN (a.x + 1, a.x - 1)) OR (b.x = a.x AND b.y IN (a.y + 1, a.y - 1)))),
 reach AS (SELECT id, id AS other FROM cc UNION SELECT reach.id, ed.b FROM reach JOIN ed ON reach.other = ed.a),
 top AS (SELECT id, min(other) AS top FROM reach GROUP BY id), part AS (SELECT subject, top, count(*) AS m FROM cc JOIN top USING (id) GROUP BY ALL),
 mi AS (SELECT subject, count(*) FILTER (m < 20) AS n_micro FROM part GROUP BY subject)
 SELECT subject, n, n_sure, n_unsure, {r('100 * n_sure / n')} AS percent_sure, {r('100 * n_unsure / n')} AS percent_unsure, n_micro FROM cn JOIN mi USING (subject)""")
def a37s(spark, sf_dir):
    """Per subject the cells with sure and unsure posteriors and the micro components of its habitats in all."""
    sure = descriptors.certainty(assigned(spark, sf_dir), ["subject"]).drop("n_ambiguous")
    micro = spatial.coherence(roi.cells(spark, sf_dir)).groupBy("subject").agg(F.sum("n_micro").alias("n_micro"))
    return sure.join(micro, "subject").withColumns({"percent_sure": 100 * F.col("n_sure") / F.col("n"), "percent_unsure": 100 * F.col("n_unsure") / F.col("n")})


@query("a39_composition_and_score", f"""+ {ROB}, {SHARES}, su AS (SELECT subject, param, avg(value) AS m FROM rob GROUP BY ALL), sd AS (SELECT avg(s) AS score FROM (SELECT stddev_pop(m) AS s FROM su GROUP BY param))
 SELECT subject, habitat, n, {r('100 * share')} AS percent, {r('score')} AS score FROM sh, sd""")
def a39(spark, sf_dir):
    """Composition of each subject, with the run's score: the mean over parameters of the deviation of the subjects' means."""
    score = scaling.consistency(scaling.robust(longs(spark, sf_dir))).agg(F.avg("spread").alias("score"))
    shares = profiles.shares(roi.cells(spark, sf_dir), ["subject"])
    return shares.select("subject", "habitat", "n", (100 * F.col("share")).alias("percent")).join(F.broadcast(score))  # one row
