"""More queries of the catalog: contrasts, labels, choices, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import contrasts, inference, metrics, pairs, permutations, profiles, quantiles, ranks, rules, scaling, spectral
from ..sources import results, roi
from .catalog import CEN, COS, EUC, KEYS, PARAMS, PTS, REF, SHARES, STAT, TUM, VEC, VOTE_SQL, PROFILE_SQL, _centroids, _instances, longs, query, r, robust_long, rule_profiles, voxel_vectors

RAW = f"{TUM}, raw AS (SELECT subject, habitat, param, avg(value) AS mean FROM t GROUP BY ALL)"
REFS = "refs AS (SELECT subject, param, median(value) AS rmed, greatest(stddev_samp(value), 1e-8) AS rsd FROM long WHERE roi = 'CL' GROUP BY ALL)"


def raw_means(spark, sf_dir):
    return profiles.centroids(scaling.tumour(longs(spark, sf_dir)), ["subject", "habitat"])


@query("p13_reference_zscore", f"+ {RAW}, {REFS} SELECT subject, habitat, param, {r('(mean - rmed) / rsd')} AS z FROM raw JOIN refs USING (subject, param)")
def p13(spark, sf_dir):
    return contrasts.reference_zscores(raw_means(spark, sf_dir), scaling.reference_stats(longs(spark, sf_dir)))


EXT = f"{RAW}, {REFS}, tm AS (SELECT subject, param, median(value) AS tmed FROM t GROUP BY ALL), ext AS (SELECT subject, habitat, param, CASE WHEN abs(tmed - rmed) / greatest(abs(rmed), 1e-8) < 0.05 THEN 1.0 ELSE (mean - rmed) / (tmed - rmed) END AS extent FROM raw JOIN refs USING (subject, param) JOIN tm USING (subject, param))"


def extents(spark, sf_dir):
    long = longs(spark, sf_dir)
    med = lambda x: quantiles.quantiles(x, ["subject", "param"], "value", {"median": 0.5})
    return contrasts.relative_extent(raw_means(spark, sf_dir), med(scaling.reference(long)), med(scaling.tumour(long)))


@query("p14_relative_extent", f"+ {EXT} SELECT subject, habitat, param, {r('extent')} AS extent FROM ext")
def p14(spark, sf_dir):
    return extents(spark, sf_dir)


@query("a13_confusion", f"""+ n AS (SELECT slice % 3 AS t, habitat AS p, count(*) AS n FROM cells GROUP BY ALL)
 SELECT t, p, n, {r('n / sum(n) OVER (PARTITION BY t)')} AS row_share, {r('n / sum(n) OVER (PARTITION BY p)')} AS column_share FROM n""")
def a13(spark, sf_dir):
    c = roi.cells(spark, sf_dir).select((F.col("slice") % 3).alias("t"), F.col("habitat").alias("p"))
    return profiles.contingency(c, "t", "p")


@query("a14_composition", f"+ {SHARES} SELECT subject, habitat, n, {r('100 * share')} AS percent FROM sh")
def a14(spark, sf_dir):
    return profiles.shares(roi.cells(spark, sf_dir), ["subject"]).select("subject", "habitat", "n", (100 * F.col("share")).alias("percent"))


@query("a15_seed_distance_by_habitat", f"""+ seeds AS (SELECT subject, slice, x AS sx, y AS sy FROM cells WHERE habitat = 0),
 d AS (SELECT c.subject, c.slice, c.x, c.y, c.habitat, min(sqrt((x - sx) ** 2 + (y - sy) ** 2)) AS distance FROM cells c LEFT JOIN seeds s ON c.subject = s.subject AND c.slice = s.slice GROUP BY ALL)
 SELECT habitat, {r('avg(distance)')} AS mean, {r('min(distance)')} AS least, {r('max(distance)')} AS most FROM d GROUP BY ALL""")
def a15(spark, sf_dir):
    from ..operators import spatial

    c = roi.cells(spark, sf_dir)
    d = spatial.seed_distance(c, F.col("habitat") == 0).join(c.select(*roi.CELL, "habitat"), list(roi.CELL))
    return d.groupBy("habitat").agg(F.avg("distance").alias("mean"), F.min("distance").alias("least"), F.max("distance").alias("most"))


@query("a36_quality_gate", f"""+ {TUM}, hn2 AS (SELECT subject, habitat, count(*) AS n FROM cells WHERE roi = 'ALL' GROUP BY ALL), m AS (SELECT subject, param, avg(value) AS g FROM t GROUP BY ALL), h AS (SELECT subject, param, habitat, avg(value) AS hm FROM t GROUP BY ALL),
 e AS (SELECT subject, param, sum((hm - g) ** 2) / sum((value - g) ** 2) AS eta2 FROM t JOIN m USING (subject, param) JOIN h USING (subject, param, habitat) GROUP BY ALL), ee AS (SELECT subject, avg(eta2) AS eta2 FROM e GROUP BY ALL)
 SELECT subject, habitat, n, {r('eta2')} AS eta2, n >= 30 AND eta2 >= 0.10 AS passes, CASE WHEN n >= 30 AND eta2 >= 0.10 THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM hn2 JOIN ee USING (subject)""")
def a36(spark, sf_dir):
    t = scaling.tumour(longs(spark, sf_dir))
    sizes = roi.cells(spark, sf_dir).where("roi = 'ALL'").groupBy("subject", "habitat").agg(F.count(F.lit(1)).alias("n"))
    return contrasts.quality_gate(sizes, profiles.eta_squared(t, ["subject"]))


@query("a27_vote_precision", f"""WITH {VOTE_SQL}, tr AS (SELECT run, habitat, label AS truth FROM (SELECT run, habitat, CASE WHEN md > 0.3 THEN 'Necrosis' WHEN md < -0.1 THEN 'Cellular/proliferative' ELSE 'Bulk tumor' END AS label FROM f))
 SELECT lf, count(vote) AS n_votes, {r("CASE WHEN count(vote) > 0 THEN count(*) FILTER (vote = truth) / count(vote) ELSE 0.5 END")} AS precision FROM v JOIN tr USING (run, habitat) GROUP BY lf""", cells=False)
def a27(spark, sf_dir):
    p = rule_profiles(spark, sf_dir)
    truth = p.select(*KEYS, F.when(F.col("md") > 0.3, "Necrosis").when(F.col("md") < -0.1, "Cellular/proliferative").otherwise("Bulk tumor").alias("truth"))
    return rules.precision(rules.votes(p, KEYS), truth, KEYS)


@query("l27_aggressive_mark", f"""WITH {PROFILE_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t2 + md DESC, habitat) AS rn FROM f)
 SELECT run, habitat, CASE WHEN rn = 1 AND t2 > 0 AND md > 0 THEN concat('Habitat ', habitat, ' +') ELSE concat('Habitat ', habitat) END AS name FROM k""", cells=False)
def l27(spark, sf_dir):
    w = Window.partitionBy("run").orderBy(F.desc(F.col("t2") + F.col("md")), "habitat")
    p = rule_profiles(spark, sf_dir).withColumn("rn", F.row_number().over(w))
    name = F.concat(F.lit("Habitat "), F.col("habitat").cast("string"))
    return p.select("run", "habitat", F.when((F.col("rn") == 1) & (F.col("t2") > 0) & (F.col("md") > 0), F.concat(name, F.lit(" +"))).otherwise(name).alias("name"))


@query("f6_unlike_labels", "SELECT p_partkey, NOT contains(lower(p_type), lower(p_brand)) AND NOT contains(lower(p_brand), lower(p_type)) AS unlike FROM part", cells=False)
def f6(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", X.unlike(F.col("p_type"), F.col("p_brand")).alias("unlike"))


@query("f11_composition_entropy", f"+ {SHARES} SELECT subject, {r('sum(CASE WHEN share > 0 THEN -share * log2(share) ELSE 0 END)')} AS entropy FROM sh GROUP BY subject")
def f11(spark, sf_dir):
    m = profiles.presence_matrix(roi.cells(spark, sf_dir), [0, 1, 2])
    return m.select("subject", X.entropy_bits(F.array("l_0", "l_1", "l_2")).alias("entropy"))


@query("j3_label_map", f"""+ names AS (SELECT * FROM (VALUES (0, 'Necrosis'), (1, 'Bulk tumor')) AS v(habitat, label)) SELECT subject, coalesce(label, concat('Habitat ', habitat)) AS label, count(*) AS n FROM cells LEFT JOIN names USING (habitat) GROUP BY ALL""")
def j3(spark, sf_dir):
    names = spark.createDataFrame([(0, "Necrosis"), (1, "Bulk tumor")], "habitat int, label string")
    j = roi.cells(spark, sf_dir).join(F.broadcast(names), "habitat", "left")  # a row per known label
    return j.groupBy("subject", F.coalesce("label", F.concat(F.lit("Habitat "), F.col("habitat").cast("string"))).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("o9_majority_map", """+ n AS (SELECT habitat AS p, truth AS t, count(*) AS n FROM cells GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, t) AS rn, sum(n) OVER (PARTITION BY p) AS all_n FROM n)
 SELECT p AS habitat, CAST(t AS INTEGER) AS truth, round(n / all_n, 6) + 0.0 AS purity FROM k WHERE rn = 1""")
def o9(spark, sf_dir):
    n = metrics.counts(roi.cells(spark, sf_dir), "truth", "habitat")
    best = n.groupBy("p").agg(F.min_by("t", F.struct(-F.col("n"), "t")).alias("truth"), (F.max("n") / F.sum("n")).alias("purity"))
    return best.withColumnRenamed("p", "habitat")


@query("o11_bulk_and_core", f"""+ {CEN}, n AS (SELECT subject, habitat, count(*) AS n FROM cells GROUP BY ALL), b AS (SELECT subject, habitat AS bulk FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, habitat) AS rn FROM n) WHERE rn = 1),
 d AS (SELECT subject, habitat, sqrt(sum(mean ** 2) FILTER (param IN ('T2', 'DTI-MD'))) AS d FROM cen GROUP BY ALL),
 c AS (SELECT d.subject, habitat, row_number() OVER (PARTITION BY d.subject ORDER BY d DESC, habitat) AS rn FROM d JOIN b USING (subject) WHERE habitat <> bulk)
 SELECT b.subject, bulk, habitat AS core FROM b JOIN c ON b.subject = c.subject AND rn = 1""")
def o11(spark, sf_dir):
    n = profiles.shares(roi.cells(spark, sf_dir), ["subject"])
    bulk = n.groupBy("subject").agg(F.min_by("habitat", F.struct(-F.col("n"), "habitat")).alias("bulk"))
    d = _centroids(spark, sf_dir).where(F.col("param").isin("T2", "DTI-MD")).groupBy("subject", "habitat").agg(F.sqrt(F.sum(F.col("mean") ** 2)).alias("d"))
    rest = d.join(bulk, "subject").where("habitat <> bulk")
    return rest.groupBy("subject", "bulk").agg(F.min_by("habitat", F.struct(-F.col("d"), "habitat")).alias("core"))


@query("o12_kept_slices", "+ s AS (SELECT DISTINCT subject, slice FROM cells) SELECT subject, slice FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY slice) AS rn FROM s) WHERE rn <= 4")
def o12(spark, sf_dir):
    s = roi.cells(spark, sf_dir).select("subject", "slice").distinct()
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("subject").orderBy("slice"))).where("rn <= 4").drop("rn")


@query("s7_result_clusters", f"""+ n AS (SELECT subject, habitat, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY subject) AS proportion FROM cells WHERE roi = 'ALL' GROUP BY subject, habitat)
 SELECT subject, habitat, n, {r('proportion')} AS proportion FROM n WHERE n >= 30""")
def s7(spark, sf_dir):
    return profiles.shares(roi.cells(spark, sf_dir).where("roi = 'ALL'"), ["subject"]).where("n >= 30").withColumnRenamed("share", "proportion")


@query("s6_cohort_scan", "SELECT subject, count(*) AS n, count(DISTINCT param) AS n_params FROM long WHERE roi = 'ALL' AND value IS NOT NULL GROUP BY ALL")
def s6(spark, sf_dir):
    long = scaling.tumour(longs(spark, sf_dir)).where("value is not null")
    return long.groupBy("subject", "param").agg(F.count(F.lit(1)).alias("n")).groupBy("subject").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_params"))


@query("w2_subtype_names", f"""+ {CEN}, u AS (SELECT subject, habitat, param, CASE WHEN max(mean) OVER w - min(mean) OVER w <= 1e-8 THEN 0.5 ELSE (mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w) END AS unit FROM cen WINDOW w AS (PARTITION BY subject, param)),
 l AS (SELECT *, CASE WHEN habitat = 0 THEN 'Core' ELSE 'Rim' END AS label FROM u), va AS (SELECT subject, label, param, var_pop(unit) AS v FROM l GROUP BY ALL),
 ch AS (SELECT subject, label, param FROM (SELECT *, row_number() OVER (PARTITION BY subject, label ORDER BY round(v, 12) DESC, param) AS rn FROM va) WHERE rn = 1),
 k AS (SELECT subject, habitat, label, param, row_number() OVER w AS i, count(*) OVER (PARTITION BY subject, label) AS n FROM l JOIN ch USING (subject, label, param) WINDOW w AS (PARTITION BY subject, label ORDER BY round(unit, 12), habitat))
 SELECT subject, habitat, label, CASE WHEN n = 1 THEN label WHEN n = 2 THEN concat(label, ' (', param, CASE WHEN i = 1 THEN 'v' ELSE '^' END, ')') WHEN n = 3 THEN concat(label, ' (', param, ' ', ['low', 'mid', 'high'][i], ')') ELSE concat(label, ' (', param, ' ', i, '/', n, ')') END AS name FROM k""")
def w2(spark, sf_dir):
    u = profiles.minmax_columns(_centroids(spark, sf_dir), ["subject"])
    labels = u.select("subject", "habitat", F.when(F.col("habitat") == 0, "Core").otherwise("Rim").alias("label")).distinct()
    return rules.subtypes(u, labels, ["subject"])


@query("w4_occurrence_of_names", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS INTEGER) AS occurrence FROM customer", cells=False)
def w4(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey")).alias("occurrence"))


@query("u5_similar_groups", f"""RECURSIVE + {VEC}, i AS (SELECT subject * 10 + habitat AS id, v FROM vec), e AS (SELECT a.id AS a, b.id AS b FROM i a JOIN i b ON a.id <> b.id WHERE 1 - {COS} >= 0.92 AND list_sum(list_transform(a.v, lambda x: x * x)) >= 0.0001 AND list_sum(list_transform(b.v, lambda x: x * x)) >= 0.0001),
 reach AS (SELECT id, id AS other FROM i UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.other = e.a) SELECT id, min(other) AS grp FROM reach GROUP BY id""")
def u5(spark, sf_dir):
    i = _instances(spark, sf_dir).select((F.col("subject") * 10 + F.col("habitat")).alias("id"), "v")
    return contrasts.similar_groups(i, "id", 0.92, near_zero=0.01)


@query("m34_centroid_matrix", f"+ {VEC} SELECT subject, habitat, " + ", ".join(f"{r(f'v[{i + 1}]')} AS p{i}" for i in range(4)) + " FROM vec")
def m34(spark, sf_dir):
    return _instances(spark, sf_dir).select("subject", "habitat", *[F.get("v", F.lit(i)).alias(f"p{i}") for i in range(4)])


@query("a40_subject_centroids", f"""+ {CEN}, want AS (SELECT DISTINCT s.subject, h.habitat, p.param FROM cen s, cen h, cen p) SELECT subject, habitat, param, {r('coalesce(mean, 0.0)')} AS mean FROM want LEFT JOIN cen USING (subject, habitat, param)""")
def a40(spark, sf_dir):
    c = _centroids(spark, sf_dir)
    want = c.select("subject").distinct().select("subject", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("habitat")).select("*", F.explode(F.array(*[F.lit(p) for p in PARAMS])).alias("param"))
    return want.join(c, ["subject", "habitat", "param"], "left").select("subject", "habitat", "param", F.coalesce("mean", F.lit(0.0)).alias("mean"))


@query("g12_witness", f"""+ a AS (SELECT subject, slice, (avg(t2) - 25) / 5 AS x, (avg(md) - 37) / 5 AS y FROM cells GROUP BY ALL), g AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, -1 + i * 0.2 AS gx, -1 + j * 0.2 AS gy FROM range(11) t(i), range(11) u(j))
 SELECT i, j, {r('avg(exp(-((x - gx) ** 2 + (y - gy) ** 2) / 2)) FILTER (subject % 2 = 0) - avg(exp(-((x - gx) ** 2 + (y - gy) ** 2) / 2)) FILTER (subject % 2 = 1)')} AS witness FROM a, g GROUP BY i, j""")
def g12(spark, sf_dir):
    a = roi.cells(spark, sf_dir).groupBy("subject", "slice").agg(((F.avg("T2") - 25) / 5).alias("x"), ((F.avg("DTI-MD") - 37) / 5).alias("y"))
    return contrasts.witness(a.select((F.col("subject") % 2 == 0).alias("first"), "x", "y"), -1.0, 1.0, 11, 1.0)


_TRUTH = "CASE WHEN md > 0.3 THEN 'Necrosis' WHEN md < -0.1 THEN 'Cellular/proliferative' ELSE 'Bulk tumor' END"
_LOO = f"""{VOTE_SQL}, tr AS (SELECT run, habitat, {_TRUTH} AS truth FROM f),
 c AS (SELECT lf, run, count(vote) AS n, count(*) FILTER (vote = truth) AS hit FROM v JOIN tr USING (run, habitat) GROUP BY ALL), t AS (SELECT lf, sum(n) AS n, sum(hit) AS hit FROM c GROUP BY ALL),
 wt AS (SELECT c.run, c.lf, CASE WHEN t.n - c.n > 0 THEN (t.hit - c.hit) / (t.n - c.n) ELSE 0.5 END AS weight FROM c JOIN t USING (lf))"""
_HELD = f"""{_LOO}, names AS (SELECT * FROM (VALUES {', '.join(f"('{x}', {rules.FLOOR[x]}, {i})" for i, x in enumerate(rules.LABELS))}) AS n(label, eps, place)),
 mass AS (SELECT run, habitat, label, place, round(any_value(eps) + coalesce(sum(weight) FILTER (vote = label), 0), 9) AS s FROM v JOIN wt USING (run, lf) CROSS JOIN names GROUP BY ALL),
 held AS (SELECT run, habitat, truth, label FROM (SELECT *, row_number() OVER (PARTITION BY run, habitat ORDER BY s DESC, place) AS rn FROM mass) JOIN tr USING (run, habitat) WHERE rn = 1)"""


def _votes_and_truth(spark, sf_dir):
    p = rule_profiles(spark, sf_dir)
    truth = p.select(*KEYS, F.when(F.col("md") > 0.3, "Necrosis").when(F.col("md") < -0.1, "Cellular/proliferative").otherwise("Bulk tumor").alias("truth"))
    return rules.votes(p, KEYS), truth


@query("e5_leave_one_out", f"WITH {_LOO} SELECT run, lf, {r('weight')} AS weight FROM wt", cells=False)
def e5(spark, sf_dir):
    """Weight of each labelling function without the run at hand: its precision over all other runs, from sums and not from pairs of runs."""
    return rules.weights_without(*_votes_and_truth(spark, sf_dir), KEYS)


@query("e5_accuracy_by_run", f"WITH {_HELD} SELECT coalesce(CAST(run AS VARCHAR), 'all') AS run, count(*) AS n, count(*) FILTER (truth = label) AS n_right, {r('count(*) FILTER (truth = label) / count(*)')} AS accuracy FROM held GROUP BY ROLLUP (run)", cells=False)
def e5r(spark, sf_dir):
    """How many habitats of each run, and of all, are labelled right by weights without that run."""
    held = rules.held_out_labels(*_votes_and_truth(spark, sf_dir), KEYS)
    right = F.count_if(F.col("truth") == F.col("label"))
    return held.rollup("run").agg(F.count(F.lit(1)).alias("n"), right.alias("n_right"), (right / F.count(F.lit(1))).alias("accuracy")).withColumn("run", F.coalesce(F.col("run").cast("string"), F.lit("all")))


@query("e5_scores_by_class", f"""WITH {_HELD}, q AS (SELECT truth AS class, count(*) AS support, count(*) FILTER (truth = label) AS tp FROM held GROUP BY ALL), nm AS (SELECT label AS class, count(*) AS named FROM held GROUP BY ALL),
 z AS (SELECT class, support, coalesce(tp / named, 0.0) AS p, tp / support AS rc FROM q LEFT JOIN nm USING (class)) SELECT class, support, {r('p')} AS precision, {r('rc')} AS recall, {r('CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END')} AS f1 FROM z""", cells=False)
def e5c(spark, sf_dir):
    return rules.scores_by_class(rules.held_out_labels(*_votes_and_truth(spark, sf_dir), KEYS))


# --- resampling: deterministic by seed, without SQL ----------------------------------------


def _log_ratios(spark, sf_dir):
    """(subject, grp, v): compositions as centred log ratios, whose Euclidean distance is the Aitchison distance."""
    m = profiles.presence_matrix(roi.cells(spark, sf_dir), [0, 1, 2])
    return results.written(m.select("subject", (F.col("subject") % 2).alias("grp"), X.clr(F.array("l_0", "l_1", "l_2")).alias("v")), "compositions")


@query("g6_permutation_p")
def g6p(spark, sf_dir):
    return permutations.permanova_test(_log_ratios(spark, sf_dir), n_perm=999)


@query("g7_dispersion")
def g7(spark, sf_dir):
    return permutations.dispersion_test(_log_ratios(spark, sf_dir), n_perm=999)


@query("g4_kernel_test")
def g4(spark, sf_dir):
    """The subjects' slices, odd against even subjects."""
    m = profiles.centroids(robust_long(spark, sf_dir), ["subject", "slice"])
    v = pairs.vectors(m, ["subject", "slice"], PARAMS).select((F.col("subject") * 10 + F.col("slice")).alias("subject"), (F.col("subject") % 2).alias("grp"), "v")
    return permutations.kernel_test(results.written(v, "slices"), 1.0, n_perm=499)


@query("g4_kernel_statistic", f"""+ {PTS}, k AS (SELECT a.grp % 2 AS ga, b.grp % 2 AS gb, avg(exp(-({EUC.format('a.v', 'b.v')} ** 2) / 2.0)) AS k FROM pts a JOIN pts b ON a.id <> b.id GROUP BY ALL)
 SELECT {r('max(k) FILTER (ga = 0 AND gb = 0) + max(k) FILTER (ga = 1 AND gb = 1) - 2 * max(k) FILTER (ga = 0 AND gb = 1)')} AS f FROM k""")
def g4f(spark, sf_dir):
    return g4(spark, sf_dir).select("f")


@query("g11_rank_sum_p")
def g11p(spark, sf_dir):
    s = profiles.shares(roi.cells(spark, sf_dir), ["subject"]).withColumn("grp", F.col("subject") % 2)
    u = ranks.mann_whitney(s, ["habitat"], "share", "grp", 0).withColumn("p", inference.rank_sum_p("u"))
    return u.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p") * 3))


@query("g13_bootstrap_means")
def g13(spark, sf_dir):
    points = voxel_vectors(spark, sf_dir).select(F.concat_ws("|", F.col("subject").cast("string"), F.col("habitat").cast("string")).alias("g"), "v", "subject", "slice", "x", "y")
    return inference.bootstrap_means(points, ["subject", "slice", "x", "y"])


@query("m13_gap_statistic")
def m13(spark, sf_dir):
    points = voxel_vectors(spark, sf_dir).select(F.col("subject").cast("string").alias("g"), "v")
    return inference.gap_statistic(results.written(points, "cells"), list(range(2, 7)), refs=5)


@query("m3_spectral_sizes")
def m3(spark, sf_dir):
    points = voxel_vectors(spark, sf_dir).select("subject", "slice", "x", "y", "v")
    return spectral.spectral(points, 3).groupBy("subject", "label").agg(F.count(F.lit(1)).alias("n"))


@query("m11_spectral_k")
def m11(spark, sf_dir):
    """Per subject the k that silhouettes and gaps name in one shared embedding of all cells."""
    points = results.written(voxel_vectors(spark, sf_dir).select("subject", "slice", "x", "y", "v"), "cells")
    return spectral.choose_k(points, [2, 3, 4], refs=3)[1].withColumnRenamed("g", "subject")
