"""Queries that compare habitats across subjects and groups, and the tables behind figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import comparison, contrasts, descriptors, pairs, profiles, quantiles, scaling
from ..sources import results, roi
from .catalog import ASSIGN, CEN, COS, DOT, EUC, GRAND, PARAMS, PTS, ROB, SHARES, STAT, TUM, VEC, _centroids, _instances, _slice_points, assigned, longs, query, r, robust_long
from .catalog_more import REFS

LABEL_SQL = "CASE WHEN habitat = 0 THEN 'Core' ELSE 'Rim' END"


def label():
    return F.when(F.col("habitat") == 0, "Core").otherwise("Rim")


def instances(spark, sf_dir):
    """Habitats of all subjects under two labels, with both kinds of means, share and quality."""
    long = longs(spark, sf_dir)
    t = scaling.tumour(long)
    raw = profiles.centroids(t, ["subject", "habitat"])
    z = contrasts.reference_zscores(raw, scaling.reference_stats(long)).withColumnRenamed("z", "mean")
    key = ["subject", "habitat"]
    gate = contrasts.quality_gate(profiles.shares(roi.cells(spark, sf_dir).where("roi = 'ALL'"), ["subject"]).withColumnRenamed("share", "s"), profiles.eta_squared(t, ["subject"]))
    share = profiles.shares(roi.cells(spark, sf_dir), ["subject"]).select(*key, F.col("share").alias("proportion"))
    j = _instances(spark, sf_dir).join(pairs.vectors(z, key, PARAMS).withColumnRenamed("v", "z"), key, "left").join(gate.select(*key, "eta2", "weight", (~F.col("passes")).alias("low_conf")), key).join(share, key)
    v = F.transform("v", lambda x: 6 * x)  # so that directions mean something
    out = j.select(F.col("subject").alias("source"), F.col("habitat").alias("cluster"), label().alias("label"), v.alias("v"), "z", "proportion", "eta2", "weight", "low_conf")
    return results.written(out, "instances")


_VECTOR = lambda c, p: f"coalesce(max({c}) FILTER (param = '{p}'), 0)"
INST = f"""{VEC}, {REFS}, rawm AS (SELECT subject, habitat, param, avg(value) AS mean FROM t GROUP BY ALL), zz AS (SELECT subject, habitat, param, (mean - rmed) / rsd AS z FROM rawm JOIN refs USING (subject, param)),
 zv AS (SELECT subject, habitat, [{', '.join(_VECTOR('z', p) for p in PARAMS)}] AS z FROM zz GROUP BY ALL), {SHARES}, mm AS (SELECT subject, param, avg(value) AS g FROM t GROUP BY ALL), hm AS (SELECT subject, param, habitat, avg(value) AS hm FROM t GROUP BY ALL),
 e0 AS (SELECT subject, param, sum((hm - g) ** 2) / sum((value - g) ** 2) AS eta2 FROM t JOIN mm USING (subject, param) JOIN hm USING (subject, param, habitat) GROUP BY ALL), ee AS (SELECT subject, avg(eta2) AS eta2 FROM e0 GROUP BY ALL),
 hn2 AS (SELECT subject, habitat, count(*) AS n2 FROM cells WHERE roi = 'ALL' GROUP BY ALL),
 inst AS (SELECT vec.subject AS source, vec.habitat AS cluster, CASE WHEN vec.habitat = 0 THEN 'Core' ELSE 'Rim' END AS label, list_transform(v, lambda x: 6 * x) AS v, z, share AS proportion, eta2, CASE WHEN n2 >= 30 AND eta2 >= 0.10 THEN 1.0 ELSE 0.5 END AS weight, NOT (n2 >= 30 AND eta2 >= 0.10) AS low_conf
  FROM vec JOIN zv USING (subject, habitat) JOIN sh USING (subject, habitat) JOIN ee USING (subject) JOIN hn2 USING (subject, habitat))"""
_NV = lambda x: f"sqrt({DOT.format(x, x)})"
_UNIT = lambda x: f"list_transform({x}, lambda q: q / {_NV(x)})"
DIV = f"CASE WHEN least({_NV('a.v')}, {_NV('b.v')}) < 0.35 THEN 0 ELSE len(list_filter(list_zip({_UNIT('a.v')}, {_UNIT('b.v')}), lambda p: abs(p[1] - p[2]) > 0.25)) END"
WC = f"CASE WHEN least({_NV('a.v')}, {_NV('b.v')}) >= 0.35 THEN (1 - {COS}) * least({_NV('a.v')}, {_NV('b.v')}, 1.0) END"
RECORD = f"""{INST}, ins AS (SELECT a.label, avg({COS}) AS intra_cosine, avg({EUC.format('a.v', 'b.v')}) AS intra_euclid, coalesce(avg({WC}), 1.0) AS weighted_cosine, count(*) FILTER (least({_NV('a.v')}, {_NV('b.v')}) < 0.35) AS n_skipped, count(*) FILTER ({DIV} = 0) AS n_concordant, count(*) AS n_pairs
  FROM inst a JOIN inst b ON a.label = b.label AND a.source < b.source GROUP BY a.label),
 acr AS (SELECT a.label, avg({COS}) AS inter_cosine, avg({EUC.format('a.v', 'b.v')}) AS inter_euclid FROM inst a JOIN inst b ON a.label <> b.label GROUP BY a.label),
 own AS (SELECT label, count(*) AS n_instances, count(DISTINCT source) AS n_sources, avg(proportion) AS mean_proportion, coalesce(stddev_samp(proportion), 0) / avg(proportion) AS proportion_cv, count(*) FILTER (low_conf) AS low_conf, sum(weight * eta2) / sum(weight) AS weighted_eta2 FROM inst GROUP BY label),
 ar AS (SELECT label, [{', '.join(f'avg(z[{i + 1}])' for i in range(len(PARAMS)))}] AS v FROM inst GROUP BY label),
 al AS (SELECT label, avg(1 - {COS}) AS arch_align, stddev_pop({_NV('a.v')} / {_NV('b.v')}) / avg({_NV('a.v')} / {_NV('b.v')}) AS mag_cv FROM (SELECT label, z AS v FROM inst) a JOIN ar b USING (label) GROUP BY label),
 rec AS (SELECT *, intra_cosine / inter_cosine AS ratio, intra_euclid / inter_euclid AS ratio_euclid, n_sources / (SELECT count(DISTINCT source) FROM inst) AS presence_rate, (SELECT count(DISTINCT source) FROM inst) AS n_sources_total FROM own JOIN ins USING (label) JOIN acr USING (label) JOIN al USING (label))"""
_ROUNDED = ("intra_cosine", "intra_euclid", "weighted_cosine", "inter_cosine", "inter_euclid", "mean_proportion", "proportion_cv", "weighted_eta2", "arch_align", "mag_cv", "ratio", "ratio_euclid", "presence_rate")


@query("q9_comparison", f"+ {RECORD} SELECT label, n_instances, n_sources, n_sources_total, low_conf, n_skipped, n_concordant, n_pairs, {', '.join(f'{r(c)} AS {c}' for c in _ROUNDED)}, ratio < 0.5 AND ratio_euclid < 0.5 AND weighted_cosine >= 0.45 AS coherent, {r('1 - ratio')} AS c1 FROM rec")
def q9(spark, sf_dir):
    """The record of each label: separation, agreement, presence, proportions, alignment with the archetype, verdict."""
    return comparison.compare(instances(spark, sf_dir))


@query("k8_comparison_summary", f"+ {RECORD} SELECT label, n_instances, {r('ratio', 4)} AS ratio, {r('1 - ratio', 4)} AS c1, {r('arch_align', 4)} AS arch_align, {r('mag_cv', 4)} AS mag_cv, ratio < 0.5 AND ratio_euclid < 0.5 AND weighted_cosine >= 0.45 AS coherent FROM rec", places=4)
def k8(spark, sf_dir):
    """The summary as JSON, rounded to four places, written and read back."""
    c = comparison.compare(instances(spark, sf_dir))
    path = results.run_folder(spark, "summary")
    body = F.struct("n_instances", *[F.round(x, 4).alias(x) for x in ("ratio", "c1", "arch_align", "mag_cv")], "coherent")
    c.select(F.to_json(F.create_map(F.col("label"), body)).alias("value")).write.text(path)
    raw = spark.read.text(path).select(F.explode(F.from_json("value", "map<string, struct<n_instances: bigint, ratio: double, c1: double, arch_align: double, mag_cv: double, coherent: boolean>>")).alias("label", "s"))
    return raw.select("label", "s.*")


@query("j13_divergent_sources", f"""+ {INST}, un AS (SELECT DISTINCT a.label, a.source FROM inst a JOIN inst b ON a.label = b.label AND a.source = b.source AND a.cluster < b.cluster WHERE {DIV} > 0)
 SELECT a.label, a.source, a.cluster, b.source AS other_source, b.cluster AS other_cluster, CAST({DIV} AS INTEGER) AS n_divergent FROM inst a SEMI JOIN un ON un.label = a.label AND un.source = a.source JOIN inst b ON a.label = b.label AND a.source <> b.source""")
def j13(spark, sf_dir):
    return comparison.within_divergence(instances(spark, sf_dir))


@query("a16_weighted_eta", f"+ {RECORD} SELECT label, {r('weighted_eta2')} AS weighted_eta2 FROM rec")
def a16(spark, sf_dir):
    i = instances(spark, sf_dir)
    return i.groupBy("label").agg((F.sum(F.col("weight") * F.col("eta2")) / F.sum("weight")).alias("weighted_eta2"))


@query("a23_separation", f"""+ {INST}, i AS (SELECT a.label, avg({EUC.format('a.v', 'b.v')}) AS inside FROM inst a JOIN inst b ON a.label = b.label AND (a.source, a.cluster) <> (b.source, b.cluster) GROUP BY a.label),
 o AS (SELECT a.label, avg({EUC.format('a.v', 'b.v')}) AS across FROM inst a JOIN inst b ON a.label <> b.label GROUP BY a.label)
 SELECT label, {r('inside')} AS inside, {r('across')} AS across, {r('inside / across')} AS ratio, CASE WHEN inside / across < 0.5 THEN 'well-separated' ELSE 'overlapping' END AS verdict FROM i JOIN o USING (label)""")
def a23(spark, sf_dir):
    p = pairs.all_pairs(instances(spark, sf_dir).select(F.struct("source", "cluster").alias("id"), "label", "v"), ["label", "v"])
    d, same = X.euclidean(F.col("v_a"), F.col("v_b")), F.col("label_a") == F.col("label_b")
    g = p.groupBy(F.col("label_a").alias("label")).agg(F.coalesce(F.avg(F.when(same, d)), F.lit(0.0)).alias("inside"), F.coalesce(F.avg(F.when(~same, d)), F.lit(1.0)).alias("across"))
    ratio = F.when(F.col("across") > 1e-8, F.col("inside") / F.col("across")).otherwise(0.0)
    return g.withColumns({"ratio": ratio, "verdict": F.when(ratio < 0.5, "well-separated").otherwise("overlapping")})


@query("a25_archetypes", f"+ {INST}, ar AS (SELECT label, [{', '.join(f'avg(z[{i + 1}])' for i in range(len(PARAMS)))}] AS v FROM inst GROUP BY label) SELECT label, unnest(['{chr(39).join([])}" + "', '".join(PARAMS) + f"']) AS param, round(unnest(v), 6) + 0.0 AS mean, {r(_NV('v'))} AS magnitude, round(unnest({_UNIT('v')}), 6) + 0.0 AS direction FROM ar")
def a25(spark, sf_dir):
    """Mean profile of a label against the reference tissue, its length and its direction."""
    a = comparison.archetypes(instances(spark, sf_dir))
    names = F.array(*[F.lit(p) for p in PARAMS])
    rows = a.select("label", "magnitude", F.posexplode("archetype").alias("i", "mean"))
    return rows.select("label", F.get(names, F.col("i")).alias("param"), "mean", "magnitude", (F.col("mean") / F.col("magnitude")).alias("direction"))


@query("a34_source_means", f"+ {CEN} SELECT {LABEL_SQL} AS label, subject, param, {r('avg(mean)', 9)} AS mean FROM cen GROUP BY ALL", places=9)
def a34(spark, sf_dir):
    return _centroids(spark, sf_dir).groupBy(label().alias("label"), "subject", "param").agg(F.avg("mean").alias("mean"))


@query("a35_medians_near_zero", f"""+ {STAT}, {GRAND}, x AS (SELECT subject, param, (value - grand) / greatest(iqr, 1e-8) AS z FROM t JOIN s USING (subject, param) JOIN g USING (param)), m AS (SELECT subject, param, median(z) AS z FROM x GROUP BY ALL)
 SELECT subject, {r('max(abs(z))')} AS most, max(abs(z)) < 0.15 AS near_zero FROM m GROUP BY subject""")
def a35(spark, sf_dir):
    """Whether all medians of a subject's scaled values (by the cohort's median) are within 0.15 of zero."""
    x = scaling.recalibrated(longs(spark, sf_dir)).select("subject", "param", F.col("scaled").alias("value"))
    m = quantiles.quantiles(x, ["subject", "param"], "value", {"m": 0.5})
    return m.groupBy("subject").agg(F.max(F.abs("m")).alias("most")).withColumn("near_zero", F.col("most") < 0.15)


@query("a10_presence", f"""+ {CEN}, n AS (SELECT subject, habitat, count(*) AS n FROM cells GROUP BY ALL HAVING count(*) >= 30),
 a AS (SELECT habitat, count(*) AS n_subjects, CAST(sum(n) AS BIGINT) AS n_cells, count(*) / (SELECT count(DISTINCT subject) FROM cells) AS rate, string_agg(CAST(subject AS VARCHAR), ',' ORDER BY subject) AS members FROM n GROUP BY ALL),
 c AS (SELECT habitat, sqrt(sum(v)) AS spread FROM (SELECT habitat, param, var_pop(mean) AS v FROM cen JOIN n USING (subject, habitat) GROUP BY ALL) GROUP BY ALL)
 SELECT habitat, n_subjects, n_cells, {r('rate')} AS rate, CAST(row_number() OVER (ORDER BY rate DESC, habitat) AS INTEGER) AS rank, members, {r('spread')} AS spread FROM a JOIN c USING (habitat)""")
def a10(spark, sf_dir):
    """Presence of each habitat, its members, and the spread of their profiles (root of the summed population variances)."""
    cells = roi.cells(spark, sf_dir)
    big = profiles.shares(cells, ["subject"]).where("n >= 30").select("subject", "habitat")
    spread = _centroids(spark, sf_dir).join(big, ["subject", "habitat"], "left_semi").groupBy("habitat", "param").agg(F.var_pop("mean").alias("v")).groupBy("habitat").agg(F.sqrt(F.sum("v")).alias("spread"))
    members = big.groupBy("habitat").agg(F.array_join(F.transform(F.sort_array(F.collect_list("subject")), lambda s: s.cast("string")), ",").alias("members"))  # a number per subject
    return profiles.presence(cells, least=30).join(members, "habitat").join(spread, "habitat")


@query("j11_matched_habitats")
def j11(spark, sf_dir):
    """Habitats of every two subjects matched one to one: in order, each takes the best free one above 0.65."""
    v = _instances(spark, sf_dir)
    p = pairs.all_pairs(v.select(F.struct("subject", "habitat").alias("id"), "subject", "habitat", "v"), ["subject", "habitat", "v"]).where("subject_a < subject_b")
    p = p.select(F.col("subject_a").alias("sa"), F.col("subject_b").alias("sb"), F.col("habitat_a").alias("a"), F.col("habitat_b").alias("b"), F.round(1 - X.cosine_distance(F.col("v_a"), F.col("v_b")), 9).alias("score"))
    return comparison.greedy_match(p, ["sa", "sb"], "a", "b", "score")


@query("m17_cosine_silhouette", f"""+ {INST}, d AS (SELECT a.source AS s, a.cluster AS c, a.label AS la, b.label AS lb, avg({COS}) AS d FROM inst a JOIN inst b ON (a.source, a.cluster) <> (b.source, b.cluster) GROUP BY ALL),
 si AS (SELECT la, s, c, max(d) FILTER (la = lb) AS own, min(d) FILTER (la <> lb) AS other FROM d GROUP BY ALL) SELECT la AS label, {r('avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END)')} AS silhouette, count(*) AS n FROM si GROUP BY la""")
def m17(spark, sf_dir):
    i = instances(spark, sf_dir).select(F.concat_ws("|", F.col("source").cast("string"), F.col("cluster").cast("string")).alias("id"), "label", "v")
    return pairs.silhouette(i, cosine=True)


# --- atlas -----------------------------------------------------------------------------------------


@query("g1_bandwidth", f"+ {PTS} SELECT {r('sqrt(median(sq) / 2)')} AS sigma FROM (SELECT {EUC.format('a.v', 'b.v')} ** 2 AS sq FROM pts a JOIN pts b ON a.id <> b.id) WHERE sq > 0")
def g1(spark, sf_dir):
    """Median heuristic over the pairs of slice means."""
    return pairs.bandwidth(_slice_points(spark, sf_dir))


@query("g3_mmd_by_heuristic", f"""+ {PTS}, q AS (SELECT sqrt(median(sq) / 2) AS sigma FROM (SELECT {EUC.format('a.v', 'b.v')} ** 2 AS sq FROM pts a JOIN pts b ON a.id <> b.id) WHERE sq > 0),
 k AS (SELECT a.grp AS ga, b.grp AS gb, avg(exp(-({EUC.format('a.v', 'b.v')} ** 2) / (2 * sigma * sigma))) AS k FROM pts a JOIN pts b ON a.grp <= b.grp AND a.id <> b.id CROSS JOIN q GROUP BY ALL)
 SELECT c.ga, c.gb, {r('greatest(x.k + y.k - 2 * c.k, 0)')} AS mmd2 FROM k c JOIN k x ON x.ga = c.ga AND x.gb = c.ga JOIN k y ON y.ga = c.gb AND y.gb = c.gb WHERE c.ga < c.gb""")
def g3(spark, sf_dir):
    points = _slice_points(spark, sf_dir)
    return pairs.mmd(points, pairs.bandwidth(points).first()[0] or 1.0)


@query("g5_mmd_by_habitat", f"""+ {ROB}, sm AS (SELECT subject, slice, habitat, param, avg(value) AS mean FROM rob GROUP BY ALL), pt AS (SELECT subject % 2 AS grp, subject * 10 + slice AS id, habitat, [{', '.join(_VECTOR('mean', p) for p in PARAMS)}] AS v FROM sm GROUP BY subject, slice, habitat),
 k AS (SELECT a.habitat, a.grp AS ga, b.grp AS gb, avg(exp(-({EUC.format('a.v', 'b.v')} ** 2) / 2.0)) AS k FROM pt a JOIN pt b ON a.habitat = b.habitat AND a.id <> b.id GROUP BY ALL), n AS (SELECT habitat, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1 FROM pt GROUP BY ALL)
 SELECT habitat, n0, n1, CASE WHEN n0 >= 10 AND n1 >= 10 THEN {r('greatest(max(k) FILTER (ga = 0 AND gb = 0) + max(k) FILTER (ga = 1 AND gb = 1) - 2 * max(k) FILTER (ga = 0 AND gb = 1), 0)')} END AS mmd2 FROM k JOIN n USING (habitat) GROUP BY habitat, n0, n1""")
def g5(spark, sf_dir):
    """Discrepancy of two groups within each habitat, over slice means; none with fewer than ten of a group."""
    m = profiles.centroids(robust_long(spark, sf_dir), ["subject", "slice", "habitat"])
    p = pairs.vectors(m, ["subject", "slice", "habitat"], PARAMS).select("habitat", (F.col("subject") % 2).alias("grp"), (F.col("subject") * 10 + F.col("slice")).alias("id"), "v")
    return pairs.conditional_mmd(p, "habitat", 1.0)


@query("a21_group_verdicts", f"""+ {ASSIGN}, u AS (SELECT subject, cluster, p, d, unnest([1, 2, 3, 4]) AS dim, unnest(v) AS x FROM po), g0 AS (SELECT subject, cluster, dim, avg(p) AS pi, sum(p * x * x) / sum(p) - (sum(p * x) / sum(p)) ** 2 AS var, sum(p * d) / sum(p) AS res FROM u GROUP BY ALL),
 ds AS (SELECT subject, subject % 2 AS grp, CAST(cluster AS INTEGER) AS cluster, max(pi) AS pi, avg(var) AS sigma2, max(res) AS residual FROM g0 GROUP BY ALL), l AS (SELECT cluster, grp, unnest(['pi', 'sigma2', 'residual']) AS measure, unnest([pi, sigma2, residual]) AS value FROM ds),
 g AS (SELECT cluster, measure, grp, avg(value) AS mean, stddev_samp(value) AS sd FROM l GROUP BY ALL), e AS (SELECT cluster, measure, max(mean) AS most, min(mean) AS least, arg_max(grp, mean) AS top_group FROM g GROUP BY ALL), f AS (SELECT *, CASE WHEN least > 1e-8 THEN most / least ELSE 1.0 END AS ratio FROM e)
 SELECT cluster, measure, grp, {r('mean')} AS mean, {r('sd')} AS sd, top_group, {r('ratio')} AS ratio, CASE measure WHEN 'pi' THEN CASE WHEN most - least > 0.10 THEN 'trend' ELSE 'equal' END
  WHEN 'sigma2' THEN CASE WHEN most > 2 AND ratio > 1.4 THEN 'high' WHEN ratio > 1.5 THEN 'more heterogeneous' WHEN ratio > 1.2 THEN 'slight' ELSE 'comparable' END ELSE CASE WHEN most > 1.5 THEN 'high' WHEN ratio > 1.4 THEN 'farther' ELSE 'aligned' END END AS tier FROM g JOIN f USING (cluster, measure)""")
def a21(spark, sf_dir):
    d = descriptors.describe(assigned(spark, sf_dir), ["subject"], 3)
    return comparison.group_verdicts(d, d.select("subject", (F.col("subject") % 2).alias("grp")).distinct())


@query("f25_classification_entropy", f"""+ {ASSIGN}, l AS (SELECT subject, slice, x, y, sum(-p * ln(p + 1e-300)) AS h, ln(sum(exp(-d * d / 2)) / 3) - 2 * ln(2 * pi()) AS ll FROM po GROUP BY ALL)
 SELECT subject, {r('sum(h)')} AS entropy, {r('-2 * sum(ll) + 12 * ln(count(*))')} AS bic, {r('-2 * sum(ll) + 12 * ln(count(*)) + 2 * sum(h)')} AS icl FROM l GROUP BY subject""")
def f25(spark, sf_dir):
    """Criterion with twice the entropy of the posteriors added, for a mixture of unit Gaussians at the three means."""
    return descriptors.classification_likelihood(assigned(spark, sf_dir), ["subject"], 3, len(PARAMS))


@query("o5_witness_pairs", f"""+ m AS (SELECT subject, slice, [(avg(t2) - 25) / 5, (avg(md) - 37) / 5, (avg(t2star) - 0.05) * 50, (avg(mtr) - 0.04) * 50] AS v FROM cells GROUP BY ALL), pr AS (SELECT i, j FROM range(4) t(i), range(4) u(j) WHERE i < j),
 g AS (SELECT -1 + i * 0.2 AS gx, -1 + j * 0.2 AS gy FROM range(11) t(i), range(11) u(j)), w AS (SELECT i, j, gx, gy, avg(exp(-((v[i + 1] - gx) ** 2 + (v[j + 1] - gy) ** 2) / 2)) FILTER (subject % 2 = 0) - avg(exp(-((v[i + 1] - gx) ** 2 + (v[j + 1] - gy) ** 2) / 2)) FILTER (subject % 2 = 1) AS w FROM m, pr, g GROUP BY ALL)
 SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r('max(abs(w))')} AS score FROM w GROUP BY i, j ORDER BY max(abs(w)) DESC LIMIT 3""")
def o5(spark, sf_dir):
    """The three pairs of parameters with the largest witness of a difference between two groups."""
    a = roi.cells(spark, sf_dir).groupBy("subject", "slice").agg(F.array((F.avg("T2") - 25) / 5, (F.avg("DTI-MD") - 37) / 5, (F.avg("T2star") - 0.05) * 50, (F.avg("MTR") - 0.04) * 50).alias("v"))
    return contrasts.top_witness_pairs(a.select((F.col("subject") % 2 == 0).alias("first"), "v"), 4, -1.0, 1.0, 11, 1.0, 3)


# --- tables behind figures ----------------------------------------------------------------------------


@query("r4_confidence_map", f"""+ {ASSIGN}, c AS (SELECT subject, slice, x, y, max(p) AS confidence FROM po GROUP BY ALL), n AS (SELECT subject, slice, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT subject, slice FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, slice) AS rn FROM n) WHERE rn = 1)
 SELECT subject, slice, x, y, {r('confidence')} AS confidence FROM c JOIN m USING (subject, slice)""")
def r4(spark, sf_dir):
    """Confidence of the cells of each subject's fullest slice."""
    c = assigned(spark, sf_dir).select("subject", "slice", "x", "y", "confidence")
    return c.join(profiles.modes(c, ["subject"], "slice").select("subject", "slice"), ["subject", "slice"], "left_semi")


@query("r5_habitat_map", """+ n AS (SELECT subject, slice, count(*) AS n FROM cells GROUP BY ALL), m AS (SELECT subject, slice FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, slice) AS rn FROM n) WHERE rn = 1)
 SELECT subject, slice, y - min(y) OVER (PARTITION BY subject, slice) AS row, x - min(x) OVER (PARTITION BY subject, slice) AS col, habitat FROM cells JOIN m USING (subject, slice)""")
def r5(spark, sf_dir):
    from ..operators import spatial

    c = roi.cells(spark, sf_dir).select("subject", "slice", "x", "y", "habitat")
    c = c.join(profiles.modes(c, ["subject"], "slice").select("subject", "slice"), ["subject", "slice"], "left_semi")
    return spatial.rasterised(c).select("subject", "slice", "row", "col", "habitat")


@query("r6_reference_picture", f"SELECT subject, slice, x, y, {r('CASE WHEN max(mtr) OVER w > min(mtr) OVER w THEN (mtr - min(mtr) OVER w) / (max(mtr) OVER w - min(mtr) OVER w) ELSE 0 END')} AS shade FROM cells WHERE roi = 'ALL' WINDOW w AS (PARTITION BY subject, slice)")
def r6(spark, sf_dir):
    """The reference picture behind posterior maps: 0 to 1 within a slice."""
    c = roi.cells(spark, sf_dir).where("roi = 'ALL'")
    box = c.groupBy("subject", "slice").agg(F.min("MTR").alias("lo"), F.max("MTR").alias("hi"))
    shade = F.when(F.col("hi") > F.col("lo"), (F.col("MTR") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return c.join(box, ["subject", "slice"]).select("subject", "slice", "x", "y", shade.alias("shade"))


@query("r13_cohort_profile", f"+ {STAT} SELECT subject, param, {r('CASE WHEN stddev_pop(med) OVER w < 1e-12 THEN 0 ELSE (med - avg(med) OVER w) / stddev_pop(med) OVER w END')} AS z_median, {r('CASE WHEN stddev_pop(iqr) OVER w < 1e-12 THEN 0 ELSE (iqr - avg(iqr) OVER w) / stddev_pop(iqr) OVER w END')} AS z_iqr FROM s WINDOW w AS (PARTITION BY param)")
def r13(spark, sf_dir):
    s = quantiles.median_iqr(scaling.tumour(longs(spark, sf_dir)), ["subject", "param"])
    w = Window.partitionBy("param")  # a row per subject
    z = lambda c: F.when(F.stddev_pop(c).over(w) < 1e-12, 0.0).otherwise((F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w))
    return s.select("subject", "param", z("median").alias("z_median"), z("iqr").alias("z_iqr"))


@query("r18_unsure_cells", f"+ {ASSIGN}, c AS (SELECT subject, slice, x, y, arg_max(cluster, p) AS label, max(p) AS confidence FROM po GROUP BY ALL) SELECT subject, slice, x, y, label, {r('confidence')} AS confidence FROM c WHERE confidence < 0.70")
def r18(spark, sf_dir):
    """Cells whose given label is held with less than 0.70."""
    return assigned(spark, sf_dir).where("confidence < 0.70").select("subject", "slice", "x", "y", "label", "confidence")


@query("r17_narrative", f"""+ {CEN}, m AS (SELECT habitat, param, avg(mean) AS mean FROM cen GROUP BY ALL), p AS (SELECT habitat, count(DISTINCT subject) AS n FROM cen GROUP BY ALL),
 w AS (SELECT habitat, param || ' ' || CASE WHEN abs(mean) >= 1.5 THEN 'strongly ' || CASE WHEN mean > 0 THEN 'elevated' ELSE 'decreased' END WHEN abs(mean) >= 0.7 THEN 'mildly ' || CASE WHEN mean > 0 THEN 'elevated' ELSE 'decreased' END ELSE 'near-normal' END AS t, param FROM m)
 SELECT habitat, 'Habitat ' || habitat || ' in ' || any_value(n) || ' subjects: ' || string_agg(t, ', ' ORDER BY param) AS text FROM w JOIN p USING (habitat) GROUP BY habitat""")
def r17(spark, sf_dir):
    """A line of text per habitat: where it occurs, and its signature in words."""
    from ..functions import labels as L

    c = _centroids(spark, sf_dir)
    m = c.groupBy("habitat", "param").agg(F.avg("mean").alias("mean"))
    words = m.groupBy("habitat").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("param", F.concat_ws(" ", "param", L.magnitude_words(F.col("mean"))).alias("t")))), lambda x: x["t"]), ", ").alias("words"))
    n = c.groupBy("habitat").agg(F.count_distinct("subject").alias("n"))
    return words.join(n, "habitat").select("habitat", F.concat(F.lit("Habitat "), F.col("habitat").cast("string"), F.lit(" in "), F.col("n").cast("string"), F.lit(" subjects: "), "words").alias("text"))


@query("q12_scheme_sweep", " UNION ALL ".join(f"SELECT '{n}' AS scheme, {r('avg(eta2)')} AS eta2, {r('max(eta2)')} AS best FROM ({{}})" .format(
    f"SELECT habitat_param AS param, sum(n * (hm - g) ** 2) / sum(ss + n * (hm - g) ** 2) AS eta2 FROM (SELECT param AS habitat_param, habitat, count(*) AS n, avg(z) AS hm, var_pop(z) * count(*) AS ss, any_value(g) AS g FROM (SELECT *, avg(z) OVER (PARTITION BY param) AS g FROM {n}) GROUP BY param, habitat) GROUP BY habitat_param") for n in ("robust", "recalibrated", "cohort", "pooled")), cells=False)
def q12(spark, sf_dir):
    """Share of the pooled variance between habitats under four scalings, mean and largest over the parameters."""
    long = longs(spark, sf_dir)
    out = None
    for name, scheme in (("robust", scaling.robust), ("recalibrated", scaling.recalibrated), ("cohort", scaling.cohort), ("pooled", scaling.pooled)):
        z = scheme(long).drop("value").withColumnRenamed("scaled", "value").withColumn("scheme", F.lit(name))
        e = profiles.eta_squared(z, ["scheme"]).groupBy("scheme").agg(F.avg("eta2").alias("eta2"), F.max("eta2").alias("best"))
        out = e if out is None else out.unionByName(e)
    names = spark.createDataFrame([("robust",), ("recalibrated",), ("cohort",), ("pooled",)], "scheme string")
    return names.join(out, "scheme", "left")  # without tumour cells a scheme has no shares


def _sweep_sql() -> str:
    from .catalog import SQL

    q = "qc AS (SELECT param, quantile_cont(cv, 0.75) - quantile_cont(cv, 0.25) AS iq FROM cc GROUP BY ALL)"
    views = f"""{ROB}, {GRAND}, robust AS (SELECT param, habitat, value AS z FROM rob), recalibrated AS (SELECT param, habitat, (value - grand) / greatest(iqr, 1e-8) AS z FROM t JOIN s USING (subject, param) JOIN g USING (param)),
     cc AS (SELECT t.param, t.habitat, value - grand AS cv FROM t JOIN g USING (param)), {q}, cohort AS (SELECT param, habitat, cv / greatest(iq, 1e-8) AS z FROM cc JOIN qc USING (param)),
     sp AS (SELECT param, median(value) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM t GROUP BY ALL), pooled AS (SELECT param, habitat, (value - med) / greatest(iqr, 1e-8) AS z FROM t JOIN sp USING (param))"""
    return f"WITH {roi.SQL}, {views} {SQL['q12_scheme_sweep']}"


def _register() -> None:
    from .catalog import SQL

    SQL["q12_scheme_sweep"] = _sweep_sql()


_register()
