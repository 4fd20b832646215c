"""Queries that write results and start from what they read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contrasts, profiles, quantiles, rules, scaling, spatial
from ..sources import results, roi
from .catalog import CEN, KEYS, PARAMS, ROB, SHARES, SQL, STAT, WEIGHTED, _centroids, longs, query, r, robust_long, rule_profiles


NAMES = {0: "Necrosis", 1: "Bulk tumor"}
NAME_SQL = "CASE habitat WHEN 0 THEN 'Necrosis' WHEN 1 THEN 'Bulk tumor' ELSE concat('Habitat ', habitat) END"


def scaled_cells(spark, sf_dir):
    """(subject, slice, x, y, habitat, label, T2, DTI-MD, T2star, MTR): robustly scaled tumour cells."""
    long = robust_long(spark, sf_dir)
    wide = long.groupBy("subject", "slice", "x", "y", "habitat").agg(*[F.max(F.when(F.col("param") == p, F.col("value"))).alias(p) for p in PARAMS])
    label = F.coalesce(*[F.when(F.col("habitat") == h, F.lit(n)) for h, n in NAMES.items()])
    return wide.withColumn("label", label)


WIDE = f"""{ROB}, w AS (SELECT subject, slice, x, y, habitat, max(value) FILTER (param = 'T2') AS t2, max(value) FILTER (param = 'DTI-MD') AS md, max(value) FILTER (param = 'T2star') AS t2star, max(value) FILTER (param = 'MTR') AS mtr
 FROM rob GROUP BY ALL)"""


def stored_cells(spark, sf_dir):
    path = results.run_folder(spark, "cells")
    results.write_cells(scaled_cells(spark, sf_dir), PARAMS, path)
    return results.read_cells(spark, path)


@query("k1_result_cells", f"""+ {WIDE} SELECT subject, CAST(slice AS INTEGER) AS "Slice", CAST(x AS INTEGER) AS "X", CAST(y AS INTEGER) AS "Y", {r('t2')} AS "T2", {r('md')} AS "MD", {r('t2star')} AS "T2star", {r('mtr')} AS "MTR", habitat AS "Habitat", {NAME_SQL} AS "Habitat_label" FROM w""")
def k1(spark, sf_dir):
    return stored_cells(spark, sf_dir).withColumnRenamed("DTI-MD", "MD")


@query("k9_cells_by_subject", f"+ {WIDE} SELECT subject, count(*) AS n, count(DISTINCT habitat) AS n_habitats, {r('avg(t2)')} AS \"T2\" FROM w GROUP BY subject")
def k9(spark, sf_dir):
    """A folder per subject is written; each is read as a part of its own."""
    return stored_cells(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("Habitat").alias("n_habitats"), F.avg("T2").alias("T2"))


@query("s12_joint_results", f"""+ {WIDE} SELECT subject, habitat AS "Habitat", count(*) AS n, {r('avg(md)')} AS "MD" FROM w GROUP BY ALL""")
def s12(spark, sf_dir):
    """Result folders of all subjects as one table; the subject comes from the folder."""
    path = results.run_folder(spark, "joint")
    results.write_cells(scaled_cells(spark, sf_dir), PARAMS, path)
    raw = results.raw_cells(spark, path, recursiveFileLookup="true")
    subject = F.regexp_extract(F.col("_metadata.file_path"), r"subject=([^/]+)/", 1).cast("long")
    rows = raw.select(subject.alias("subject"), F.col("Habitat").cast("int").alias("Habitat"), F.col("`DTI-MD`").cast("double").alias("MD"))
    return rows.groupBy("subject", "Habitat").agg(F.count(F.lit(1)).alias("n"), F.avg("MD").alias("MD"))


def _stats(spark, sf_dir):
    long = longs(spark, sf_dir)
    return quantiles.median_iqr(scaling.tumour(long), ["subject", "param"]).select("subject", "param", "median", "iqr"), scaling.reference_stats(long)


META = f"""{STAT}, ref AS (SELECT subject, param, median(value) AS rm, CASE WHEN count(value) = 1 THEN 1.0 ELSE greatest(stddev_samp(value), 1e-8) END AS rsd, avg(value) AS rmean, count(value) AS rn FROM long WHERE roi = 'CL' GROUP BY ALL)"""


@query("k2_run_meta", f"+ {META} SELECT subject, param, {r('med', 9)} AS median, {r('iqr', 9)} AS iqr, {r('rm', 9)} AS ref_median, {r('rsd', 9)} AS ref_std, {r('rmean', 9)} AS ref_mean, rn AS ref_n FROM s JOIN ref USING (subject, param)", places=9)
def k2(spark, sf_dir):
    path = results.run_folder(spark, "meta")
    results.write_meta(*_stats(spark, sf_dir), path)
    return results.read_meta(spark, path)


@query("s9_relative_centroids", f"""+ {CEN}, ref AS (SELECT subject, param, median(value) AS rm, CASE WHEN count(value) = 1 THEN 1.0 ELSE greatest(stddev_samp(value), 1e-8) END AS rsd FROM long WHERE roi = 'CL' GROUP BY ALL)
 SELECT subject, habitat, param, {r('(mean * iqr + med - rm) / rsd')} AS z FROM cen JOIN s USING (subject, param) JOIN ref USING (subject, param)""")
def s9(spark, sf_dir):
    """Scaled habitat means put against the reference tissue by the stored meta data of their run."""
    path = results.run_folder(spark, "meta")
    results.write_meta(*_stats(spark, sf_dir), path)
    j = _centroids(spark, sf_dir).join(results.read_meta(spark, path), ["subject", "param"])
    return j.select("subject", "habitat", "param", ((F.col("mean") * F.col("iqr") + F.col("median") - F.col("ref_median")) / F.col("ref_std")).alias("z"))


@query("k3_centroids_json", f"+ {CEN} SELECT subject, habitat, param, {r('mean')} AS mean FROM cen")
def k3(spark, sf_dir):
    path = results.run_folder(spark, "centroids")
    results.write_centroids(_centroids(spark, sf_dir), path)
    return results.read_centroids(spark, path)


@query("s10_centroid_precedence", f"""+ {CEN}, raw AS (SELECT subject, habitat, param, avg(value) AS mean FROM t GROUP BY ALL), st AS (SELECT * FROM cen WHERE habitat < 2 OR subject < 5),
 u AS (SELECT subject, count(DISTINCT st.habitat) >= count(DISTINCT raw.habitat) AS stored FROM raw LEFT JOIN st USING (subject) GROUP BY subject)
 SELECT subject, habitat, param, {r("mean", 9)} AS mean, 'stored' AS origin FROM st JOIN u USING (subject) WHERE stored
 UNION ALL SELECT subject, habitat, param, {r("mean", 9)}, 'computed' FROM raw JOIN u USING (subject) WHERE NOT stored""", places=9)
def s10(spark, sf_dir):
    """Stored means (one habitat is missing in some runs) win where they cover as many clusters as the cells do."""
    path = results.run_folder(spark, "centroids")
    results.write_centroids(_centroids(spark, sf_dir).where("habitat < 2 or subject < 5"), path)
    computed = profiles.centroids(scaling.tumour(longs(spark, sf_dir)), ["subject", "habitat"])
    return results.stored_or_computed(results.read_centroids(spark, path), computed)


@query("k4_scaling_table", f"+ {STAT} SELECT subject, param AS parameter, {r('med', 9)} AS median_raw, {r('iqr', 9)} AS iqr_raw FROM s", places=9)
def k4(spark, sf_dir):
    info = _stats(spark, sf_dir)[0].select("subject", F.col("param").alias("parameter"), F.col("median").alias("median_raw"), F.col("iqr").alias("iqr_raw"))
    return results.write_table(info, results.run_folder(spark, "scaling"))


@query("k5_mask", "SELECT subject, x - 1 AS i, y - 1 AS j, CAST(slice - 1 AS INTEGER) AS k, CAST(habitat + 1 AS SMALLINT) AS value FROM cells WHERE roi = 'ALL' AND x - 1 BETWEEN 0 AND 119 AND y - 1 BETWEEN 0 AND 119 AND slice - 1 BETWEEN 0 AND 5")
def k5(spark, sf_dir):
    return results.mask(roi.cells(spark, sf_dir).where("roi = 'ALL'"), 120, 120, 6)[0]


@query("k5_mask_bounds", "SELECT subject, count(*) FILTER (NOT ok) AS n_out, count(*) FILTER (ok) AS n_in FROM (SELECT subject, x - 1 BETWEEN 0 AND 119 AND y - 1 BETWEEN 0 AND 119 AND slice - 1 BETWEEN 0 AND 5 AS ok FROM cells WHERE roi = 'ALL') GROUP BY subject")
def k5b(spark, sf_dir):
    return results.mask(roi.cells(spark, sf_dir).where("roi = 'ALL'"), 120, 120, 6)[1]


META_OF = "CASE WHEN habitat = 0 THEN 1 ELSE 2 END"


@query("k6_assignment_table", f"+ {SHARES} SELECT subject AS mouse, habitat AS cluster_id, {NAME_SQL} AS user_label, n AS n_voxels, {r('share', 4)} AS proportion, concat('MH', {META_OF}) AS meta_habitat FROM sh", places=4)
def k6(spark, sf_dir):
    s = profiles.shares(roi.cells(spark, sf_dir), ["subject"])
    name = F.coalesce(*[F.when(F.col("habitat") == h, F.lit(n)) for h, n in NAMES.items()])
    rows = s.select(F.col("subject").alias("mouse"), F.col("habitat").alias("cluster_id"), results.habitat_name(F.col("habitat"), name).alias("user_label"), F.col("n").alias("n_voxels"),
                    F.round("share", 4).alias("proportion"), F.concat(F.lit("MH"), F.when(F.col("habitat") == 0, "1").otherwise("2")).alias("meta_habitat"))
    return results.write_table(rows, results.run_folder(spark, "assignment"))


@query("k7_coherence_table", SQL["sp8_coherence"], cells=False)
def k7(spark, sf_dir):
    return results.write_table(spatial.coherence(roi.cells(spark, sf_dir)), results.run_folder(spark, "coherence"))


@query("k10_label_table", f"""WITH {WEIGHTED}, k AS (SELECT *, row_number() OVER (PARTITION BY run, habitat ORDER BY p DESC, place) AS rn FROM pr) SELECT run, habitat, label FROM k WHERE rn = 1""", cells=False)
def k10(spark, sf_dir):
    """Final labels, written as a JSON object per run and read back."""
    labels = rules.decide(rules.weighted_vote(rules.votes(rule_profiles(spark, sf_dir), KEYS), KEYS), KEYS)
    path = results.run_folder(spark, "labels")
    one = labels.groupBy("run").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("habitat").cast("string"), "label")))).alias("labels"))
    one.write.json(path)
    raw = spark.read.schema("run long, labels map<string, string>").json(path)
    return raw.select("run", F.explode("labels").alias("habitat", "label")).withColumn("habitat", F.col("habitat").cast("int"))


@query("k12_explanation", f"""+ {SHARES} SELECT concat('META-HABITAT MH', {META_OF}, ': present in ', count(DISTINCT subject), ' subjects, ', count(*), ' clusters, ', CAST(sum(n) AS BIGINT), ' voxels') AS value FROM sh GROUP BY {META_OF}""")
def k12(spark, sf_dir):
    """Lines of the text that explains the meta-habitats, written as text and read back."""
    s = profiles.shares(roi.cells(spark, sf_dir), ["subject"]).groupBy(F.when(F.col("habitat") == 0, 1).otherwise(2).alias("meta"))
    n = s.agg(F.count_distinct("subject").alias("subjects"), F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("n"))
    line = F.concat(F.lit("META-HABITAT MH"), F.col("meta").cast("string"), F.lit(": present in "), F.col("subjects").cast("string"), F.lit(" subjects, "), F.col("clusters").cast("string"), F.lit(" clusters, "), F.col("n").cast("string"), F.lit(" voxels"))
    path = results.run_folder(spark, "explanation")
    n.select(line.alias("value")).write.text(path)
    return spark.read.text(path)


@query("s11_member_cells", f"+ {WIDE} SELECT subject, CAST(slice AS INTEGER) AS \"Slice\", CAST(x AS INTEGER) AS \"X\", CAST(y AS INTEGER) AS \"Y\", {r('coalesce(t2, 0)')} AS \"T2\", {r('coalesce(mtr, 0)')} AS \"MTR\", 0.0::DOUBLE AS \"FA\" FROM w WHERE {META_OF} = 2")
def s11(spark, sf_dir):
    """Stored cells of one meta-habitat; a parameter that a run lacks is 0."""
    cells = stored_cells(spark, sf_dir).withColumnRenamed("Habitat", "habitat")
    assigned = cells.select("subject", "habitat").distinct().withColumn("meta", F.when(F.col("habitat") == 0, 1).otherwise(2))
    return results.members(cells, assigned, 2, ["T2", "MTR", "FA"]).select("subject", "Slice", "X", "Y", "T2", "MTR", "FA")


@query("s13_posterior_maps", """SELECT subject, list_sort(list(DISTINCT CAST(slice AS INTEGER)))[len(list(DISTINCT slice)) // 2 + 1] AS slice, CAST(count(DISTINCT slice) AS INTEGER) AS n_slices, 3 AS n_maps FROM cells WHERE roi = 'ALL' GROUP BY subject""")
def s13(spark, sf_dir):
    """Posterior columns are found by name, and the middle slice is the one to show."""
    path = results.run_folder(spark, "maps")
    share = F.array(*[F.when(F.col("habitat") == h, 0.8).otherwise(0.1) for h in range(3)])
    results.write_cells(scaled_cells(spark, sf_dir).withColumn("proba", share), PARAMS, path, "proba")
    cells = results.read_cells(spark, path)
    return results.middle_slice(cells).withColumn("n_maps", F.lit(len(results.posterior_columns(cells.columns))))


@query("s8_instances", f"""+ {SHARES}, tt AS (SELECT * FROM long WHERE roi = 'ALL'), m AS (SELECT subject, param, avg(value) AS g FROM tt GROUP BY ALL), h AS (SELECT subject, param, habitat, avg(value) AS hm FROM tt GROUP BY ALL),
 e AS (SELECT subject, param, sum((hm - g) ** 2) / sum((value - g) ** 2) AS eta2 FROM tt JOIN m USING (subject, param) JOIN h USING (subject, param, habitat) GROUP BY ALL), ee AS (SELECT subject, avg(eta2) AS eta2 FROM e GROUP BY ALL),
 n AS (SELECT subject, habitat, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY subject) AS proportion FROM cells WHERE roi = 'ALL' GROUP BY subject, habitat)
 SELECT subject, habitat, {NAME_SQL} AS label, n, {r('proportion')} AS proportion, {r('eta2')} AS eta2, n >= 30 AS size_ok, eta2 >= 0.10 AS eta_ok, NOT (n >= 30 AND eta2 >= 0.10) AS low_conf FROM n JOIN ee USING (subject)""")
def s8(spark, sf_dir):
    """One row per habitat of a run: label, size, share and quality flags."""
    cells = roi.cells(spark, sf_dir).where("roi = 'ALL'")
    sizes = profiles.shares(cells, ["subject"])
    gate = contrasts.quality_gate(sizes, profiles.eta_squared(scaling.tumour(longs(spark, sf_dir)), ["subject"]))
    j = sizes.join(gate.select("subject", "habitat", "eta2", "passes"), ["subject", "habitat"])
    name = F.coalesce(*[F.when(F.col("habitat") == h, F.lit(n)) for h, n in NAMES.items()])
    return j.select("subject", "habitat", results.habitat_name(F.col("habitat"), name).alias("label"), "n", F.col("share").alias("proportion"), "eta2", (F.col("n") >= 30).alias("size_ok"), (F.col("eta2") >= 0.10).alias("eta_ok"), (~F.col("passes")).alias("low_conf"))
