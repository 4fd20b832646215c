"""Queries over the given tables, one per operator, each with SQL that says the same.

Names start with the operator's number in the inventory. Doubles are rounded
to six places on both sides, since sums may run in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import descriptors, metrics, mixture, pairs, profiles, quantiles, ranks, rules, scaling, selection, spatial
from ..sources import results, roi

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PARAMS = list(roi.MODALITIES)
BY = ["subject", "param"]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def r(expr: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0"


def query(name: str, sql: str | None = None, cells: bool = True, places: int = 6):
    """Registers a function of (spark, sf_dir); ``sql`` may use the CTEs ``cells`` and ``long``.

    Means of a few decimals can end on a 5 at the sixth place; those queries keep more places.
    """
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), places)
        QUERIES[name].module = f.__module__
        if sql and cells:
            body = sql.removeprefix("RECURSIVE ")
            SQL[name] = f"WITH {'RECURSIVE ' if body != sql else ''}{roi.SQL}{',' if body.startswith('+') else ''} {body.removeprefix('+')}"
        elif sql:
            SQL[name] = sql
        return f
    return add


def longs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.long_cells(spark, sf_dir)


def robust_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumour cells with the robustly scaled value in place of the raw one."""
    return scaling.robust(longs(spark, sf_dir)).drop("value").withColumnRenamed("scaled", "value")


TUM = "t AS (SELECT * FROM long WHERE roi = 'ALL')"
STAT = f"""{TUM}, s AS (SELECT subject, param, median(value) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM t GROUP BY ALL)"""
ROB = f"""{STAT}, rob AS (SELECT t.subject, t.slice, t.x, t.y, t.habitat, t.truth, t.param, CASE WHEN iqr = 0 THEN 0.0 ELSE (value - med) / iqr END AS value FROM t JOIN s USING (subject, param))"""
CEN = f"""{ROB}, cen AS (SELECT subject, habitat, param, avg(value) AS mean FROM rob GROUP BY ALL)"""
VEC = f"""{CEN}, vec AS (SELECT subject, habitat, [coalesce(max(mean) FILTER (param = 'T2'), 0), coalesce(max(mean) FILTER (param = 'DTI-MD'), 0), coalesce(max(mean) FILTER (param = 'T2star'), 0), coalesce(max(mean) FILTER (param = 'MTR'), 0)] AS v FROM cen GROUP BY ALL)"""
CELLS_SCALED = "SELECT subject, slice, x, y, param, {} AS scaled FROM {}"


# --- scans and scalings ---------------------------------------------------


@query("s1_roi_pivot", f"SELECT subject, slice, x, y, {r('t2', 9)} AS T2, {r('md', 9)} AS MD, {r('t2star', 9)} AS T2star, {r('mtr', 9)} AS MTR FROM cells WHERE roi = 'ALL'", places=9)
def s1(spark, sf_dir):
    wide = roi.pivot_cells(roi.melt(roi.cells(spark, sf_dir), PARAMS), PARAMS, "T2")  # one pass, so the cells aren't written
    return wide.withColumnRenamed("DTI-MD", "MD")


@query("s3_reference_stats", f"""SELECT subject, param, {r('avg(value)')} AS mean, {r('CASE WHEN count(value) = 1 THEN 1.0 ELSE greatest(stddev_samp(value), 1e-8) END')} AS sd,
 {r('median(value)')} AS median, count(value) AS n FROM long WHERE roi = 'CL' GROUP BY ALL""")
def s3(spark, sf_dir):
    return scaling.reference_stats(longs(spark, sf_dir))


@query("s4_reference_median_iqr", f"""SELECT subject, param, {r('median(value)')} AS median, {r('greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1e-8)')} AS iqr, count(value) AS n
 FROM long WHERE roi = 'CL' GROUP BY ALL""")
def s4(spark, sf_dir):
    return scaling.reference_median_iqr(longs(spark, sf_dir), PARAMS)


@query("s5_all_roi_percentile", f"SELECT subject, param, {r('quantile_cont(value, 0.10)')} AS p, count(value) AS n FROM long GROUP BY ALL")
def s5(spark, sf_dir):
    return scaling.percentile_stats(longs(spark, sf_dir))


def _cells_scaled(df: DataFrame) -> DataFrame:
    return df.select("subject", "slice", "x", "y", "param", "scaled")


@query("p1_robust", f"+ {STAT} SELECT subject, slice, x, y, param, {r('CASE WHEN iqr = 0 THEN 0.0 ELSE (value - med) / iqr END')} AS scaled FROM t JOIN s USING (subject, param)")
def p1(spark, sf_dir):
    return _cells_scaled(scaling.robust(longs(spark, sf_dir)))


@query("p2_hybrid", f"""+ {STAT}, h AS (SELECT subject, param, quantile_cont(value, 0.10) AS p10 FROM long GROUP BY ALL)
 SELECT subject, slice, x, y, param, {r('CASE WHEN iqr = 0 THEN 0.0 ELSE (value - p10) / iqr END')} AS scaled FROM t JOIN s USING (subject, param) JOIN h USING (subject, param)""")
def p2(spark, sf_dir):
    return _cells_scaled(scaling.hybrid(longs(spark, sf_dir)))


REF = "ref AS (SELECT subject, param, median(value) AS rmed, greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1e-8) AS riqr FROM long WHERE roi = 'CL' GROUP BY ALL)"
for _name, _spread, _sql in (("p3_reference", "reference", "riqr"), ("p4_reference_hybrid", "tumour", "greatest(iqr, 1e-8)"), ("p5_reference_centred", "center", "1.0")):
    query(_name, f"+ {STAT}, {REF} SELECT subject, slice, x, y, param, {r(f'(value - rmed) / {_sql}')} AS scaled FROM t JOIN s USING (subject, param) JOIN ref USING (subject, param)")(
        lambda spark, sf_dir, _s=_spread: _cells_scaled(scaling.against_reference(longs(spark, sf_dir), PARAMS, _s)))


@query("p6_robust_floor", f"+ {STAT} SELECT subject, slice, x, y, param, {r('(value - med) / greatest(iqr, 1e-8)')} AS scaled FROM t JOIN s USING (subject, param)")
def p6(spark, sf_dir):
    return _cells_scaled(scaling.robust(longs(spark, sf_dir), "floor"))


GRAND = "g AS (SELECT param, median(med) AS grand FROM s GROUP BY ALL)"


@query("p7_recalibrated", f"+ {STAT}, {GRAND} SELECT subject, slice, x, y, param, {r('(value - grand) / greatest(iqr, 1e-8)')} AS scaled FROM t JOIN s USING (subject, param) JOIN g USING (param)")
def p7(spark, sf_dir):
    return _cells_scaled(scaling.recalibrated(longs(spark, sf_dir)))


@query("p8_pooled", f"""+ {TUM}, s AS (SELECT param, median(value) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM t GROUP BY ALL)
 SELECT subject, slice, x, y, param, {r('(value - med) / greatest(CASE WHEN iqr = 0 THEN 1.0 ELSE iqr END, 1e-8)')} AS scaled FROM t JOIN s USING (param)""")
def p8(spark, sf_dir):
    return _cells_scaled(scaling.pooled(longs(spark, sf_dir)))


@query("p9_cohort", f"""+ {STAT}, {GRAND}, c AS (SELECT t.*, value - grand AS cv FROM t JOIN g USING (param)),
 q AS (SELECT param, quantile_cont(cv, 0.75) - quantile_cont(cv, 0.25) AS iq FROM c GROUP BY ALL)
 SELECT subject, slice, x, y, param, {r('cv / greatest(iq, 1e-8)')} AS scaled FROM c JOIN q USING (param)""")
def p9(spark, sf_dir):
    return _cells_scaled(scaling.cohort(longs(spark, sf_dir)))


@query("p10_reference_pooled", f"""+ {TUM}, {REF}, c AS (SELECT t.*, value - rmed AS cv FROM t JOIN ref USING (subject, param)),
 q AS (SELECT param, quantile_cont(cv, 0.75) - quantile_cont(cv, 0.25) AS iq FROM c GROUP BY ALL)
 SELECT subject, slice, x, y, param, {r('cv / greatest(iq, 1e-8)')} AS scaled FROM c JOIN q USING (param)""")
def p10(spark, sf_dir):
    return _cells_scaled(scaling.reference_pooled(longs(spark, sf_dir), PARAMS))


@query("p16_centred_in_habitat", f"+ {ROB} SELECT subject, slice, x, y, param, {r('value - avg(value) OVER (PARTITION BY subject, habitat, param)', 9)} AS centred FROM rob", places=9)
def p16(spark, sf_dir):
    long = robust_long(spark, sf_dir)
    m = profiles.centroids(long, ["subject", "habitat"])
    return long.join(m, ["subject", "habitat", "param"]).select("subject", "slice", "x", "y", "param", (F.col("value") - F.col("mean")).alias("centred"))


@query("p17_unit_columns", f"""+ {CEN} SELECT subject, habitat, param, {r('CASE WHEN max(mean) OVER w - min(mean) OVER w <= 1e-8 THEN 0.5 ELSE (mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w) END')} AS unit
 FROM cen WINDOW w AS (PARTITION BY subject, param)""")
def p17(spark, sf_dir):
    return profiles.minmax_columns(_centroids(spark, sf_dir), ["subject"]).drop("mean")


@query("p18_zscore_columns", f"""+ {CEN} SELECT subject, habitat, param, {r('CASE WHEN stddev_pop(mean) OVER w < 1e-12 THEN 0 ELSE (mean - avg(mean) OVER w) / stddev_pop(mean) OVER w END')} AS z
 FROM cen WINDOW w AS (PARTITION BY habitat, param)""")
def p18(spark, sf_dir):
    return profiles.zscore_columns(_centroids(spark, sf_dir), ["habitat"]).drop("mean")


@query("p20_subject_weight", "+ n AS (SELECT subject, count(*) AS n FROM cells GROUP BY ALL) SELECT subject, n, round(1 / n / count(*) OVER (), 12) AS weight FROM n", places=12)
def p20(spark, sf_dir):
    return profiles.balanced_weights(roi.cells(spark, sf_dir))


@query("p24_features_by_variance", f"""+ v AS (SELECT subject, param, var_pop(value) AS variance FROM long GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY variance DESC, param) AS rank, max(variance) OVER (PARTITION BY subject) AS top FROM v)
 SELECT subject, param, {r('variance')} AS variance, CAST(rank AS INTEGER) AS rank FROM k WHERE variance >= 0.10 * top OR rank <= 2""")
def p24(spark, sf_dir):
    return scaling.feature_choice(longs(spark, sf_dir), ["subject"])


# --- aggregates -------------------------------------------------------------


def _centroids(spark, sf_dir):
    return profiles.centroids(robust_long(spark, sf_dir), ["subject", "habitat"])


@query("a2_grand_median", f"+ {STAT} SELECT param, {r('median(med)')} AS grand FROM s GROUP BY ALL")
def a2(spark, sf_dir):
    return scaling.grand_medians(longs(spark, sf_dir))


@query("a3_centroids", f"+ {CEN} SELECT subject, habitat, param, {r('mean')} AS mean FROM cen")
def a3(spark, sf_dir):
    return _centroids(spark, sf_dir)


@query("a4_raw_centroids", f"SELECT habitat, param, {r('avg(value)')} AS mean FROM long WHERE roi = 'ALL' GROUP BY ALL")
def a4(spark, sf_dir):
    return profiles.centroids(scaling.tumour(longs(spark, sf_dir)), ["habitat"])


SHARES = "hn AS (SELECT subject, habitat, count(*) AS n FROM cells GROUP BY subject, habitat), sh AS (SELECT subject, habitat, n, n / sum(n) OVER (PARTITION BY subject) AS share FROM hn)"


@query("a5_habitat_shares", f"+ {SHARES} SELECT subject, habitat, n, {r('share')} AS share FROM sh")
def a5(spark, sf_dir):
    return profiles.shares(roi.cells(spark, sf_dir), ["subject"])


@query("a6_eta_squared", f"""+ {TUM}, m AS (SELECT subject, param, avg(value) AS g FROM t GROUP BY ALL), h AS (SELECT subject, param, habitat, avg(value) AS hm FROM t GROUP BY ALL)
 SELECT subject, param, {r('CASE WHEN sum((value - g) ** 2) < 1e-12 THEN 0 ELSE sum((hm - g) ** 2) / sum((value - g) ** 2) END')} AS eta2
 FROM t JOIN m USING (subject, param) JOIN h USING (subject, param, habitat) GROUP BY ALL""")
def a6(spark, sf_dir):
    return profiles.eta_squared(scaling.tumour(longs(spark, sf_dir)), ["subject"])


@query("a7_modal_truth", """+ n AS (SELECT habitat, truth, count(*) AS n FROM cells GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY habitat ORDER BY n DESC, truth) AS rn FROM n) SELECT habitat, CAST(truth AS INTEGER) AS truth, n FROM k WHERE rn = 1""")
def a7(spark, sf_dir):
    return profiles.modes(roi.cells(spark, sf_dir), ["habitat"], "truth")


@query("a8_modal_slice", """+ n AS (SELECT subject, slice, count(*) AS n FROM cells GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, slice) AS rn FROM n) SELECT subject, slice, n FROM k WHERE rn = 1""")
def a8(spark, sf_dir):
    return profiles.modes(roi.cells(spark, sf_dir), ["subject"], "slice")


@query("a9_consistency", f"""+ {ROB}, m AS (SELECT subject, param, avg(value) AS m FROM rob GROUP BY ALL), d AS (SELECT param, stddev_pop(m) AS spread FROM m GROUP BY ALL)
 SELECT param, {r('spread')} AS spread, CASE WHEN spread < 0.25 THEN 'ok' WHEN spread < 0.5 THEN 'caution' ELSE 'warning' END AS severity FROM d""")
def a9(spark, sf_dir):
    return scaling.consistency(scaling.robust(longs(spark, sf_dir)))


@query("a11_presence_matrix", f"+ {SHARES} SELECT subject, " + ", ".join(f"{r(f'coalesce(max(share) FILTER (habitat = {i}), 0.0)')} AS l_{i}" for i in range(3)) + " FROM sh GROUP BY ALL")
def a11(spark, sf_dir):
    return profiles.presence_matrix(roi.cells(spark, sf_dir), [0, 1, 2])


@query("a12_contingency", f"""+ n AS (SELECT habitat, CAST(truth AS INTEGER) AS truth, count(*) AS n FROM cells GROUP BY ALL)
 SELECT habitat, truth, n, {r('n / sum(n) OVER (PARTITION BY habitat)')} AS row_share, {r('n / sum(n) OVER (PARTITION BY truth)')} AS column_share FROM n""")
def a12(spark, sf_dir):
    return profiles.contingency(roi.cells(spark, sf_dir), "habitat", "truth")


@query("a17_share_spread", f"+ {SHARES} SELECT habitat, {r('avg(share)')} AS mean_share, {r('stddev_samp(share) / avg(share)')} AS cv, count(*) AS n_subjects FROM sh GROUP BY ALL")
def a17(spark, sf_dir):
    return profiles.composition_spread(roi.cells(spark, sf_dir))


@query("a19_log_inertia", f"""+ {ROB}, s2 AS (SELECT habitat, param, var_pop(value) * count(value) AS v FROM rob GROUP BY ALL HAVING count(value) >= 2)
 SELECT {r('ln(sum(v) + 1e-10)')} AS log_inertia FROM s2""")
def a19(spark, sf_dir):
    return profiles.log_inertia(robust_long(spark, sf_dir))


@query("a20_deviation", f"""+ {CEN}, o AS (SELECT habitat, param, avg(value) AS o FROM rob GROUP BY ALL)
 SELECT subject, habitat, {r('sqrt(sum((mean - o) ** 2))')} AS deviation FROM cen JOIN o USING (habitat, param) GROUP BY ALL""")
def a20(spark, sf_dir):
    return profiles.deviation(robust_long(spark, sf_dir))


@query("a22_cohens_d", f"""+ {ROB}, h AS (SELECT DISTINCT habitat FROM rob) SELECT h.habitat, param,
 {r('(avg(value) FILTER (rob.habitat = h.habitat) - avg(value) FILTER (rob.habitat <> h.habitat)) / sqrt((var_samp(value) FILTER (rob.habitat = h.habitat) + var_samp(value) FILTER (rob.habitat <> h.habitat)) / 2 + 1e-10)')} AS cohens_d
 FROM rob CROSS JOIN h GROUP BY h.habitat, param""")
def a22(spark, sf_dir):
    return profiles.cohens_d(robust_long(spark, sf_dir))


DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"
EUC = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) ** 2)))"
COS = f"(1 - {DOT.format('a.v', 'b.v')} / sqrt({DOT.format('a.v', 'a.v')}) / sqrt({DOT.format('b.v', 'b.v')}))"
WCOS = f"CASE WHEN least(sqrt({DOT.format('a.v', 'a.v')}), sqrt({DOT.format('b.v', 'b.v')})) >= 0.35 THEN (1 - {COS}) * least(sqrt({DOT.format('a.v', 'a.v')}), sqrt({DOT.format('b.v', 'b.v')}), 1.0) END"


def _instances(spark, sf_dir):
    return results.written(pairs.vectors(_centroids(spark, sf_dir), ["subject", "habitat"], PARAMS), "instances")


@query("j7_instance_pairs", f"""+ {VEC} SELECT a.habitat, a.subject AS a, b.subject AS b, {r(COS)} AS cosine, {r(EUC.format('a.v', 'b.v'))} AS euclid, {r(WCOS)} AS weighted
 FROM vec a JOIN vec b ON a.habitat = b.habitat AND a.subject < b.subject""")
def j7(spark, sf_dir):
    return pairs.instance_pairs(_instances(spark, sf_dir))


@query("a24_label_coherence", f"""+ {VEC}, i AS (SELECT a.habitat, avg({COS}) AS intra, avg({EUC.format('a.v', 'b.v')}) AS intra_euclid, avg({WCOS}) AS weighted, count(*) AS n_pairs
  FROM vec a JOIN vec b ON a.habitat = b.habitat AND a.subject < b.subject GROUP BY ALL),
 o AS (SELECT a.habitat, avg({COS}) AS inter, avg({EUC.format('a.v', 'b.v')}) AS inter_euclid FROM vec a JOIN vec b ON a.habitat <> b.habitat GROUP BY ALL),
 f AS (SELECT habitat, inter, inter_euclid, coalesce(intra, 0.0) AS intra, coalesce(intra_euclid, 0.0) AS intra_euclid, coalesce(weighted, 1.0) AS weighted, coalesce(n_pairs, 0) AS n_pairs FROM o LEFT JOIN i USING (habitat))
 SELECT habitat, {r('inter')} AS inter, {r('inter_euclid')} AS inter_euclid, {r('intra')} AS intra, {r('intra_euclid')} AS intra_euclid, {r('weighted')} AS weighted, n_pairs, {r('intra / inter')} AS ratio,
  {r('intra_euclid / inter_euclid')} AS ratio_euclid, intra / inter < 0.5 AND intra_euclid / inter_euclid < 0.5 AND weighted >= 0.45 AS coherent FROM f""")
def a24(spark, sf_dir):
    return pairs.coherence(_instances(spark, sf_dir))


@query("f10_shape_concordance", f"""+ {VEC}, u AS (SELECT subject, habitat, list_transform(v, lambda x: x / sqrt({DOT.format('v', 'v')})) AS v FROM vec)
 SELECT a.habitat, a.subject AS a, b.subject AS b, CAST(len(list_filter(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]) > 0.25)) AS INTEGER) AS n_divergent,
 len(list_filter(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]) > 0.25)) = 0 AS concordant FROM u a JOIN u b ON a.habitat = b.habitat AND a.subject < b.subject""")
def f10(spark, sf_dir):
    return pairs.shape_concordance(_instances(spark, sf_dir))


@query("a37_neighbour_boundaries", """+ p AS (SELECT a.subject, a.slice, a.habitat <> b.habitat AS edge FROM cells a JOIN cells b ON a.subject = b.subject AND a.slice = b.slice
 AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))) SELECT subject, slice, count(*) AS n_pairs, count(*) FILTER (edge) AS n_boundary FROM p GROUP BY ALL""")
def j12(spark, sf_dir):
    return spatial.boundaries(roi.cells(spark, sf_dir))


# --- spatial ------------------------------------------------------------------


@query("sp1_seed_distance", f"""+ seeds AS (SELECT subject, slice, x AS sx, y AS sy FROM cells WHERE habitat = 0),
 d AS (SELECT c.subject, c.slice, c.x, c.y, min(sqrt((x - sx) ** 2 + (y - sy) ** 2)) AS distance FROM cells c LEFT JOIN seeds s ON c.subject = s.subject AND c.slice = s.slice GROUP BY ALL)
 SELECT subject, slice, x, y, {r('distance')} AS distance, {r('CASE WHEN max(distance) OVER (PARTITION BY subject) > 0 THEN distance / max(distance) OVER (PARTITION BY subject) ELSE distance END')} AS d_norm FROM d""")
def sp1(spark, sf_dir):
    return spatial.seed_distance(roi.cells(spark, sf_dir), F.col("habitat") == 0)


@query("sp8_coherence", """RECURSIVE + c AS (SELECT subject, slice, habitat, x, y, (subject * 10 + slice) * 16384 + y * 128 + x AS id FROM cells),
 e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.subject = b.subject AND a.slice = b.slice AND a.habitat = b.habitat AND ((b.y = a.y AND b.x IN (a.x + 1, a.x - 1)) OR (b.x = a.x AND b.y IN (a.y + 1, a.y - 1)))),
 reach AS (SELECT id, id AS other FROM c UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.other = e.a),
 top AS (SELECT id, min(other) AS top FROM reach GROUP BY id),
 k AS (SELECT subject, slice, habitat, top, count(*) AS n FROM c JOIN top USING (id) GROUP BY ALL)
 SELECT subject, slice, habitat, count(*) AS n_components, max(n) AS max_size, count(*) FILTER (n < 20) AS n_micro, CAST(coalesce(sum(n) FILTER (n < 20), 0) AS BIGINT) AS micro_cells FROM k GROUP BY ALL""")
def sp8(spark, sf_dir):
    return spatial.coherence(roi.cells(spark, sf_dir))


@query("sp11_raster", """SELECT subject, slice, x, y, y - min(y) OVER (PARTITION BY subject, slice) AS row, x - min(x) OVER (PARTITION BY subject, slice) AS col FROM cells""")
def sp11(spark, sf_dir):
    return spatial.rasterised(roi.cells(spark, sf_dir).select("subject", "slice", "x", "y"))


@query("sp12_anchors", f"SELECT subject, slice, habitat, {r('avg(x)')} AS cx, {r('avg(y)')} AS cy, count(*) AS n FROM cells GROUP BY ALL HAVING count(*) >= 3")
def sp12(spark, sf_dir):
    return spatial.anchors(roi.cells(spark, sf_dir))


# --- rules ----------------------------------------------------------------------

#: Profiles for the rules: suppliers as runs, return flags as habitats, six times the deviation from the table's mean.
PROFILE_SQL = """m AS (SELECT avg(l_quantity) q, stddev_pop(l_quantity) qs, avg(l_extendedprice) p, stddev_pop(l_extendedprice) ps, avg(l_discount) d, stddev_pop(l_discount) ds, avg(l_tax) t, stddev_pop(l_tax) ts FROM lineitem),
 pro AS (SELECT l_suppkey AS run, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS habitat, round(6 * (avg(l_quantity) - any_value(q)) / any_value(qs), 6) AS t2, round(6 * (avg(l_extendedprice) - any_value(p)) / any_value(ps), 6) AS md,
 round(6 * (avg(l_discount) - any_value(d)) / any_value(ds), 6) AS fa, round(6 * (avg(l_tax) - any_value(t)) / any_value(ts), 6) AS t2star,
 round(6 * (avg(l_discount + l_tax) - any_value(d) - any_value(t)) / any_value(ts), 6) AS mtr, round((count(*) % 100) / 100, 6) AS d, count(*) AS n, CAST(NULL AS DOUBLE) AS rd, CAST(NULL AS DOUBLE) AS ad FROM lineitem, m GROUP BY 1, 2),
 l2 AS (SELECT *, sqrt(t2 ** 2 + md ** 2 + fa ** 2 + t2star ** 2 + mtr ** 2) AS l2 FROM pro),
 f AS (SELECT *, CASE WHEN max(l2) OVER (PARTITION BY run) > 1e-8 THEN l2 / max(l2) OVER (PARTITION BY run) ELSE 0 END AS l2_rel FROM l2)"""


def rule_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cols = {"q": "l_quantity", "p": "l_extendedprice", "d": "l_discount", "t": "l_tax"}
    m = li.agg(*[F.avg(c).alias(f"_{k}") for k, c in cols.items()], *[F.stddev_pop(c).alias(f"_{k}s") for k, c in cols.items()])
    g = li.groupBy(F.col("l_suppkey").alias("run"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("habitat")).agg(
        *[F.avg(c).alias(k) for k, c in cols.items()], F.avg(F.col("l_discount") + F.col("l_tax")).alias("dt"), F.count(F.lit(1)).alias("n"))
    z = lambda a, b, s: F.round(6 * (F.col(a) - b) / F.col(s), 6)
    none = F.lit(None).cast("double")
    g = g.join(F.broadcast(m)).select(  # m is one row
        "run", "habitat", z("q", F.col("_q"), "_qs").alias("t2"), z("p", F.col("_p"), "_ps").alias("md"), z("d", F.col("_d"), "_ds").alias("fa"), z("t", F.col("_t"), "_ts").alias("t2star"),
        z("dt", F.col("_d") + F.col("_t"), "_ts").alias("mtr"), F.round((F.col("n") % 100) / 100, 6).alias("d"), "n", none.alias("rd"), none.alias("ad"))
    return rules.profile_features(g, ["run"])


KEYS = ["run", "habitat"]


@query("l2_median_anchor", f"WITH {PROFILE_SQL} SELECT run, arg_min(habitat, l2) AS anchor FROM f GROUP BY run", cells=False)
def l2(spark, sf_dir):
    return rules.median_anchor(rule_profiles(spark, sf_dir), ["run"])


@query("l3_necrotic_candidate", f"WITH {PROFILE_SQL} SELECT run, arg_max(habitat, t2 + md) AS necrotic FROM f WHERE t2 > 0 AND md > 0 GROUP BY run", cells=False)
def l3(spark, sf_dir):
    return rules.necrotic_candidate(rule_profiles(spark, sf_dir), ["run"])


def _vote_sql(when: str, unless: str | None) -> str:
    return f"({when}) AND NOT coalesce({unless}, false)" if unless else f"({when})"


VOTE_SQL = PROFILE_SQL + ", v AS (" + " UNION ALL ".join(
    f"SELECT run, habitat, '{n}' AS lf, '{label}' AS target, CASE WHEN {_vote_sql(w, u)} THEN '{label}' END AS vote FROM f" for n, label, w, u in rules.VOTES) + ")"


@query("l22_votes", f"WITH {VOTE_SQL} SELECT run, habitat, lf, target, vote FROM v", cells=False)
def l22(spark, sf_dir):
    return rules.votes(rule_profiles(spark, sf_dir), KEYS)


WEIGHTED = VOTE_SQL + ", lab AS (" + " UNION ALL ".join(f"SELECT '{x}' AS label, {rules.FLOOR[x]} AS eps, {i} AS place" for i, x in enumerate(rules.LABELS)) + """),
 w AS (SELECT run, habitat, label, place, any_value(eps) + count(*) FILTER (vote = label) AS s FROM v CROSS JOIN lab GROUP BY run, habitat, label, place),
 pr AS (SELECT run, habitat, label, place, s / sum(s) OVER (PARTITION BY run, habitat) AS p FROM w)"""


@query("l23_weighted_vote", f"WITH {WEIGHTED} SELECT run, habitat, label, {r('p')} AS p FROM pr", cells=False)
def l23(spark, sf_dir):
    return rules.weighted_vote(rules.votes(rule_profiles(spark, sf_dir), KEYS), KEYS).drop("place")


@query("l24_labels", f"""WITH {WEIGHTED}, k AS (SELECT *, row_number() OVER (PARTITION BY run, habitat ORDER BY p DESC, place) AS rn FROM pr),
 b AS (SELECT run, habitat, max(label) FILTER (rn = 1) AS label, max(p) FILTER (rn = 1) AS best, max(p) FILTER (rn = 2) AS second, sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) AS entropy FROM k GROUP BY ALL)
 SELECT run, habitat, label, {r('best')} AS score, CASE WHEN best >= 0.7 THEN 'high' WHEN best >= 0.5 THEN 'medium' ELSE 'low' END AS confidence, {r('entropy')} AS entropy, second >= best - 0.15 AS is_ambiguous, false AS abstained FROM b""", cells=False)
def l24(spark, sf_dir):
    return rules.decide(rules.weighted_vote(rules.votes(rule_profiles(spark, sf_dir), KEYS), KEYS), KEYS)


def _share_sql(conditions: dict) -> str:
    met = " + ".join(f"CASE WHEN {_in_sql(p, *b)} THEN 1 ELSE 0 END" for p, b in conditions.items())
    known = " + ".join(f"CASE WHEN {p} IS NOT NULL THEN 1 ELSE 0 END" for p in conditions)
    return f"CASE WHEN {known} > 0 THEN ({met}) / ({known}) ELSE 0.0 END"


def _in_sql(p: str, low, high) -> str:
    return "coalesce(" + " AND ".join([*([f"{p} >= {low}"] if low is not None else []), *([f"{p} <= {high}"] if high is not None else [])]) + ", false)"


def _score_sql(rule: dict) -> str:
    out = [*[f"{p} IS NULL" for p in rule["must_have"]], *[_in_sql(p, *b) for p, b in rule["exclude"].items()], *["(" + " AND ".join(_in_sql(p, *b) for p, b in c.items()) + ")" for c in rule["compound"]]]
    req, sup = _share_sql(rule["required"]), _share_sql(rule["support"])
    return f"CASE WHEN {' OR '.join(out)} THEN 0.0 WHEN ({req}) >= 1 THEN 0.60 + 0.40 * ({sup}) ELSE 0.30 * ({req}) + 0.10 * ({sup}) END"


@query("l25_suggestion", f"WITH {PROFILE_SQL}, sc AS (" + " UNION ALL ".join(f"SELECT run, habitat, '{x['name']}' AS name, {i} AS place, CAST({_score_sql(x)} AS DOUBLE) AS s FROM f" for i, x in enumerate(rules.RULES)) + f"""),
 k AS (SELECT *, row_number() OVER (PARTITION BY run, habitat ORDER BY s DESC, place) AS rn FROM sc),
 b AS (SELECT run, habitat, max(name) FILTER (rn = 1) AS name, max(s) FILTER (rn = 1) AS top, max(s) FILTER (rn = 2) AS second FROM k GROUP BY ALL)
 SELECT run, habitat, CASE WHEN top >= 0.55 THEN name ELSE 'Bulk tumor' END AS label,
 CASE WHEN top >= 0.55 AND name = 'Infiltrative' THEN 'low' WHEN top >= 0.9 THEN 'high' WHEN top >= 0.6 THEN 'medium' WHEN top >= 0.55 THEN 'low' WHEN top < 0.3 THEN 'high' ELSE 'medium' END AS confidence,
 {r('top')} AS score, top >= 0.55 AND second >= 0.55 AND top - second < 0.15 AS is_ambiguous FROM b""", cells=False)
def l25(spark, sf_dir):
    return rules.suggest(rule_profiles(spark, sf_dir), KEYS)


@query("sp6_necrosis_guard", f"""WITH {PROFILE_SQL}, k AS (SELECT *, t2 + md AS score, row_number() OVER w AS rn, lead(t2 + md) OVER w AS second FROM f WINDOW w AS (PARTITION BY run ORDER BY t2 + md DESC, habitat))
 SELECT run, habitat AS candidate, t2 >= 0.5 AND md >= 0.5 AND coalesce(score - second >= 0.5, true) AS passes FROM k WHERE rn = 1""", cells=False)
def sp6(spark, sf_dir):
    return rules.necrosis_guard(rule_profiles(spark, sf_dir), ["run"])


@query("sp7_core_score", f"WITH {PROFILE_SQL} SELECT run, arg_max(habitat, 2 * t2 + 2 * md - t2star - mtr) AS core, {r('max(2 * t2 + 2 * md - t2star - mtr)')} AS score FROM f GROUP BY run", cells=False)
def sp7(spark, sf_dir):
    p = rule_profiles(spark, sf_dir).withColumn("s", rules.core_score())
    return p.groupBy("run").agg(F.max_by("habitat", "s").alias("core"), F.max("s").alias("score"))


# --- inference and metrics ----------------------------------------------------------


@query("f14_aitchison", f"""+ {SHARES}, c AS (SELECT subject, [coalesce(max(share) FILTER (habitat = 0), 0) + 1e-6, coalesce(max(share) FILTER (habitat = 1), 0) + 1e-6, coalesce(max(share) FILTER (habitat = 2), 0) + 1e-6] AS p FROM sh GROUP BY ALL),
 l AS (SELECT subject, list_transform(p, lambda x: ln(x / list_sum(p))) AS g FROM c), k AS (SELECT subject, list_transform(g, lambda x: x - list_avg(g)) AS v FROM l)
 SELECT a.subject AS a, b.subject AS b, {r(EUC.format('a.v', 'b.v'))} AS distance FROM k a JOIN k b ON a.subject < b.subject""")
def f14(spark, sf_dir):
    return pairs.aitchison(_compositions(spark, sf_dir))


def _compositions(spark, sf_dir):
    m = profiles.presence_matrix(roi.cells(spark, sf_dir), [0, 1, 2])
    return results.written(m.select("subject", F.array("l_0", "l_1", "l_2").alias("v")), "compositions")


@query("g6_permanova", f"""+ {SHARES}, c AS (SELECT subject, [coalesce(max(share) FILTER (habitat = 0), 0) + 1e-6, coalesce(max(share) FILTER (habitat = 1), 0) + 1e-6, coalesce(max(share) FILTER (habitat = 2), 0) + 1e-6] AS p FROM sh GROUP BY ALL),
 l AS (SELECT subject, list_transform(p, lambda x: ln(x / list_sum(p))) AS g FROM c), k AS (SELECT subject, list_transform(g, lambda x: x - list_avg(g)) AS v FROM l),
 d AS (SELECT a.subject % 2 AS ga, b.subject % 2 AS gb, {EUC.format('a.v', 'b.v')} ** 2 AS sq FROM k a JOIN k b ON a.subject < b.subject),
 n AS (SELECT subject % 2 AS g, count(*) AS n FROM k GROUP BY ALL), w AS (SELECT sum(s / n) AS ssw FROM (SELECT ga AS g, sum(sq) AS s FROM d WHERE ga = gb GROUP BY ALL) JOIN n USING (g)),
 o AS (SELECT sum(sq) / (SELECT sum(n) FROM n) AS ss FROM d)
 SELECT {r('ss')} AS ss_total, {r('ssw')} AS ss_within, {r('(ss - ssw) / ((SELECT count(*) FROM n) - 1) / (ssw / ((SELECT sum(n) FROM n) - (SELECT count(*) FROM n)))')} AS f, {r('(ss - ssw) / ss')} AS r2 FROM o, w""")
def g6(spark, sf_dir):
    c = _compositions(spark, sf_dir)
    return pairs.permanova(pairs.aitchison(c), c.select("subject", (F.col("subject") % 2).alias("grp")))


def _slice_points(spark, sf_dir):
    m = profiles.centroids(robust_long(spark, sf_dir), ["subject", "slice"])
    return results.written(pairs.vectors(m, ["subject", "slice"], PARAMS).select(F.col("subject").alias("grp"), (F.col("subject") * 10 + F.col("slice")).alias("id"), "v"), "slices")


PTS = f"""{ROB}, sm AS (SELECT subject, slice, param, avg(value) AS mean FROM rob GROUP BY ALL),
 pts AS (SELECT subject AS grp, subject * 10 + slice AS id, [coalesce(max(mean) FILTER (param = 'T2'), 0), coalesce(max(mean) FILTER (param = 'DTI-MD'), 0), coalesce(max(mean) FILTER (param = 'T2star'), 0), coalesce(max(mean) FILTER (param = 'MTR'), 0)] AS v FROM sm GROUP BY subject, slice)"""


@query("g2_mmd", f"""+ {PTS}, k AS (SELECT a.grp AS ga, b.grp AS gb, avg(exp(-({EUC.format('a.v', 'b.v')} ** 2) / 2.0)) AS k FROM pts a JOIN pts b ON a.grp <= b.grp AND a.id <> b.id GROUP BY ALL)
 SELECT c.ga, c.gb, {r('greatest(x.k + y.k - 2 * c.k, 0)')} AS mmd2 FROM k c JOIN k x ON x.ga = c.ga AND x.gb = c.ga JOIN k y ON y.ga = c.gb AND y.gb = c.gb WHERE c.ga < c.gb""")
def g2(spark, sf_dir):
    return pairs.mmd(_slice_points(spark, sf_dir), 1.0)


@query("m15_silhouette", f"""+ {VEC}, d AS (SELECT a.subject, a.habitat AS la, b.habitat AS lb, avg({EUC.format('a.v', 'b.v')}) AS d FROM vec a JOIN vec b ON (a.subject, a.habitat) <> (b.subject, b.habitat) GROUP BY ALL),
 sil AS (SELECT subject, la, max(d) FILTER (la = lb) AS own, min(d) FILTER (la <> lb) AS other FROM d GROUP BY ALL)
 SELECT la AS habitat, {r('avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END)')} AS silhouette, count(*) AS n FROM sil GROUP BY ALL""")
def m15(spark, sf_dir):
    i = _instances(spark, sf_dir).withColumn("id", F.col("subject") * 10 + F.col("habitat"))
    return pairs.silhouette(i, "habitat", "id")


@query("e1_agreement", f"""+ n AS (SELECT truth AS t, habitat AS p, count(*) AS n FROM cells GROUP BY ALL), a AS (SELECT sum(n) AS a FROM n), x AS (SELECT t, sum(n) AS nt FROM n GROUP BY t), y AS (SELECT p, sum(n) AS np FROM n GROUP BY p),
 s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS ij, (SELECT sum(nt * (nt - 1) / 2) FROM x) AS i, (SELECT sum(np * (np - 1) / 2) FROM y) AS j, a * (a - 1) / 2 AS tot,
  (SELECT sum(-nt / a * ln(nt / a)) FROM x, a) AS ht, (SELECT sum(-np / a * ln(np / a)) FROM y, a) AS hp,
  (SELECT sum(-n / a * ln(n / np)) FROM n JOIN y USING (p), a) AS htp, (SELECT sum(-n / a * ln(n / nt)) FROM n JOIN x USING (t), a) AS hpt FROM a)
 SELECT {r('(ij - i * j / tot) / ((i + j) / 2 - i * j / tot)')} AS ari, {r('1 - htp / ht')} AS homogeneity, {r('1 - hpt / hp')} AS completeness, {r('2 * (1 - htp / ht) * (1 - hpt / hp) / (2 - htp / ht - hpt / hp)')} AS v_measure FROM s""")
def e1(spark, sf_dir):
    return metrics.agreement(metrics.counts(roi.cells(spark, sf_dir), "truth", "habitat"))


@query("e2_agreement_by_subject", f"""+ n AS (SELECT subject, truth AS t, habitat AS p, count(*) AS n FROM cells GROUP BY ALL), b AS (SELECT subject, p, max(n) AS hit, sum(n) AS n FROM n GROUP BY ALL)
 SELECT subject, {r('sum(hit) / sum(n)')} AS accuracy FROM b GROUP BY ALL""")
def e2(spark, sf_dir):
    return metrics.majority_accuracy(metrics.counts(roi.cells(spark, sf_dir), "truth", "habitat", ["subject"]), ["subject"])


@query("e4_per_class", f"""+ n AS (SELECT slice % 3 AS t, habitat AS p, count(*) AS n FROM cells GROUP BY ALL), c AS (SELECT DISTINCT t AS cls FROM n),
 s AS (SELECT cls, (SELECT sum(n) FROM n WHERE t = cls AND p = cls) AS hit, (SELECT sum(n) FROM n WHERE t = cls) AS nt, (SELECT sum(n) FROM n WHERE p = cls) AS np FROM c)
 SELECT cls, {r('hit / np')} AS precision, {r('hit / nt')} AS recall, {r('2 * (hit / np) * (hit / nt) / (hit / np + hit / nt)')} AS f1 FROM s""")
def e4(spark, sf_dir):
    return metrics.per_class(metrics.counts(roi.cells(spark, sf_dir).withColumn("t3", F.col("slice") % 3), "t3", "habitat"), without=None)


@query("g11_mann_whitney", f"""+ {SHARES}, k AS (SELECT subject, habitat, share, rank() OVER (PARTITION BY habitat ORDER BY share) + (count(*) OVER (PARTITION BY habitat, share) - 1) / 2 AS rk FROM sh)
 SELECT habitat, {r('sum(rk) FILTER (subject % 2 = 0) - count(*) FILTER (subject % 2 = 0) * (count(*) FILTER (subject % 2 = 0) + 1) / 2')} AS u, count(*) FILTER (subject % 2 = 0) AS n1, count(*) FILTER (subject % 2 = 1) AS n2 FROM k GROUP BY ALL""")
def g11(spark, sf_dir):
    s = profiles.shares(roi.cells(spark, sf_dir), ["subject"]).withColumn("grp", F.col("subject") % 2)
    return ranks.mann_whitney(s, ["habitat"], "share", "grp", 0)


@query("g11_kruskal_wallis", f"""+ {SHARES}, k AS (SELECT subject % 3 AS g, habitat, share, rank() OVER (PARTITION BY habitat ORDER BY share) + (count(*) OVER (PARTITION BY habitat, share) - 1) / 2 AS rk FROM sh),
 q AS (SELECT habitat, sum(s ** 2 / c) AS q, sum(c) AS n FROM (SELECT habitat, g, sum(rk) AS s, count(*) AS c FROM k GROUP BY ALL) GROUP BY ALL),
 t AS (SELECT habitat, sum(c ** 3 - c) AS t FROM (SELECT habitat, share, count(*) AS c FROM sh GROUP BY ALL) GROUP BY ALL)
 SELECT habitat, {r('(12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n))')} AS h FROM q JOIN t USING (habitat)""")
def g11b(spark, sf_dir):
    s = profiles.shares(roi.cells(spark, sf_dir), ["subject"]).withColumn("grp", F.col("subject") % 3)
    return ranks.kruskal_wallis(s, ["habitat"], "share", "grp")


@query("w3_spearman", f"""+ a AS (SELECT subject, slice, avg(t2) AS a, avg(md) AS b FROM cells GROUP BY ALL),
 k AS (SELECT subject, rank() OVER (PARTITION BY subject ORDER BY a) AS ra, rank() OVER (PARTITION BY subject ORDER BY b) AS rb FROM a) SELECT subject, {r('corr(ra, rb)')} AS rho FROM k GROUP BY ALL""")
def w3(spark, sf_dir):
    a = roi.cells(spark, sf_dir).groupBy("subject", "slice").agg(F.avg("T2").alias("a"), F.avg("DTI-MD").alias("b"))
    return ranks.spearman(a, ["subject"], "a", "b")


# --- choices and windows ----------------------------------------------------------------


def _scores(spark, sf_dir):
    """A score per slice of a subject, in the place of a score per k."""
    return roi.cells(spark, sf_dir).groupBy("subject", F.col("slice").alias("k")).agg(F.avg("DTI-MD").alias("score"), (F.stddev_pop("DTI-MD") / 100).alias("s"))


SC = "sc AS (SELECT subject, slice AS k, avg(md) AS score, stddev_pop(md) / 100 AS s FROM cells GROUP BY ALL)"
CHORD = """u AS (SELECT *, (k - min(k) OVER w) / (max(k) OVER w - min(k) OVER w) AS x, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS y, min(k) OVER w AS k0, max(k) OVER w AS k1 FROM sc WINDOW w AS (PARTITION BY subject)),
 g AS (SELECT *, arg_min(y, k) OVER w + (arg_max(y, k) OVER w - arg_min(y, k) OVER w) * x - y AS gap FROM u WINDOW w AS (PARTITION BY subject))"""


@query("o1_best_k", f"+ {SC} SELECT subject, arg_min(k, score) AS k FROM sc GROUP BY ALL")
def o1(spark, sf_dir):
    return selection.best_k(_scores(spark, sf_dir), ["subject"], "score")


@query("o2_elbow", f"+ {SC}, {CHORD} SELECT subject, arg_max(k, abs(gap)) AS k FROM g GROUP BY ALL")
def o2(spark, sf_dir):
    return selection.elbow(_scores(spark, sf_dir), ["subject"], "score")


@query("o3_elbow_below", f"+ {SC}, {CHORD} SELECT subject, arg_max(k, gap) AS k FROM g WHERE k <> k0 AND k <> k1 GROUP BY ALL")
def o3(spark, sf_dir):
    return selection.elbow(_scores(spark, sf_dir), ["subject"], "score", below_only=True)


@query("o4_gap_rule", f"+ {SC}, z AS (SELECT *, score >= lead(score) OVER w - lead(s) OVER w AS ok FROM sc WINDOW w AS (PARTITION BY subject ORDER BY k)) SELECT subject, coalesce(min(k) FILTER (ok), max(k)) AS k FROM z GROUP BY ALL")
def o4(spark, sf_dir):
    return selection.gap_rule(_scores(spark, sf_dir).withColumnRenamed("score", "gap"), ["subject"])


@query("o6_top_parameters", f"""+ {TUM}, m AS (SELECT subject, param, avg(value) AS g FROM t GROUP BY ALL), h AS (SELECT subject, param, habitat, avg(value) AS hm FROM t GROUP BY ALL),
 e AS (SELECT subject, param, sum((hm - g) ** 2) / sum((value - g) ** 2) AS eta2 FROM t JOIN m USING (subject, param) JOIN h USING (subject, param, habitat) GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY round(eta2, 12) DESC, param) AS rank FROM e) SELECT subject, CAST(rank AS INTEGER) AS rank, param FROM k WHERE rank <= 3""")
def o6(spark, sf_dir):
    e = profiles.eta_squared(scaling.tumour(longs(spark, sf_dir)), ["subject"])
    w = Window.partitionBy("subject").orderBy(F.desc(F.round("eta2", 12)), "param")
    return e.withColumn("rank", F.row_number().over(w)).where("rank <= 3").drop("eta2")


@query("w1_occurrence", """+ i AS (SELECT DISTINCT subject, truth, habitat FROM cells) SELECT subject, habitat, CAST(truth AS INTEGER) AS truth, CAST(least(row_number() OVER (PARTITION BY truth, subject ORDER BY habitat) - 1, 5) AS INTEGER) AS occurrence FROM i""")
def w1(spark, sf_dir):
    i = roi.cells(spark, sf_dir).select("subject", "truth", "habitat").distinct()
    return i.withColumn("occurrence", F.least(F.row_number().over(Window.partitionBy("truth", "subject").orderBy("habitat")) - 1, F.lit(5)))


@query("o10_pages", "+ s AS (SELECT DISTINCT subject FROM cells) SELECT subject, CAST(ntile(3) OVER (ORDER BY subject) AS INTEGER) AS page FROM s")
def o10(spark, sf_dir):
    return roi.cells(spark, sf_dir).select("subject").distinct().withColumn("page", F.ntile(3).over(Window.orderBy("subject")))  # a row per subject


@query("u2_common_parameters", "SELECT param FROM long WHERE value IS NOT NULL GROUP BY param HAVING count(DISTINCT subject) = (SELECT count(DISTINCT subject) FROM long)")
def u2(spark, sf_dir):
    long = longs(spark, sf_dir)
    total = long.agg(F.count_distinct("subject").alias("total"))
    n = long.where("value is not null").groupBy("param").agg(F.count_distinct("subject").alias("n"))
    return n.join(F.broadcast(total)).where("n = total").select("param")  # total is one row


@query("j2_truth_join", """+ p AS (SELECT subject, slice, x, y, habitat FROM cells WHERE roi = 'ALL'), g AS (SELECT subject, slice, x, y, truth FROM cells WHERE truth IS NOT NULL)
 SELECT habitat, CAST(truth AS INTEGER) AS truth, count(*) AS n FROM p JOIN g USING (subject, slice, x, y) GROUP BY ALL""")
def j2(spark, sf_dir):
    c = roi.cells(spark, sf_dir)
    key = list(roi.CELL)
    return c.where("roi = 'ALL'").select(*key, "habitat").join(c.where("truth is not null").select(*key, "truth"), key).groupBy("habitat", "truth").agg(F.count(F.lit(1)).alias("n"))


@query("j4_member_cells", f"+ {SHARES}, m AS (SELECT subject, habitat FROM sh WHERE share >= 0.3) SELECT subject, habitat, count(*) AS n, {r('avg(md)', 9)} AS md FROM cells SEMI JOIN m USING (subject, habitat) GROUP BY ALL", places=9)
def j4(spark, sf_dir):
    c = roi.cells(spark, sf_dir)
    m = profiles.shares(c, ["subject"]).where("share >= 0.3").select("subject", "habitat")
    return c.join(m, ["subject", "habitat"], "left_semi").groupBy("subject", "habitat").agg(F.count(F.lit(1)).alias("n"), F.avg("DTI-MD").alias("md"))


# --- soft assignment and mixtures -----------------------------------------------------------


def voxel_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, slice, x, y, habitat, v): robustly scaled tumour cells."""
    return pairs.vectors(robust_long(spark, sf_dir), ["subject", "slice", "x", "y", "habitat"], PARAMS, "value")


def assigned(spark, sf_dir):
    """Soft assignment of the scaled cells to the raw habitat means; the cells are scaled once and written."""
    long = results.written(robust_long(spark, sf_dir).select("subject", "slice", "x", "y", "habitat", "param", "value"), "scaled")
    means = pairs.vectors(profiles.centroids(long, ["habitat"]), ["habitat"], PARAMS)
    model = [row["v"] for row in means.orderBy("habitat").collect()]  # three short vectors
    return descriptors.assign(pairs.vectors(long, ["subject", "slice", "x", "y", "habitat"], PARAMS, "value"), model)


ASSIGN = f"""{ROB}, vx AS (SELECT subject, slice, x, y, habitat, [coalesce(max(value) FILTER (param = 'T2'), 0), coalesce(max(value) FILTER (param = 'DTI-MD'), 0), coalesce(max(value) FILTER (param = 'T2star'), 0), coalesce(max(value) FILTER (param = 'MTR'), 0)] AS v FROM rob GROUP BY subject, slice, x, y, habitat),
 hm AS (SELECT habitat, param, avg(value) AS m FROM rob GROUP BY ALL), hv AS (SELECT habitat AS cluster, [max(m) FILTER (param = 'T2'), max(m) FILTER (param = 'DTI-MD'), max(m) FILTER (param = 'T2star'), max(m) FILTER (param = 'MTR')] AS c FROM hm GROUP BY ALL),
 dist AS (SELECT subject, slice, x, y, v, cluster, {EUC.format('v', 'c')} AS d FROM vx CROSS JOIN hv),
 ex AS (SELECT *, exp(min(d) OVER (PARTITION BY subject, slice, x, y) - d) AS e FROM dist),
 po AS (SELECT *, e / sum(e) OVER (PARTITION BY subject, slice, x, y) AS p FROM ex)"""


@query("p15_confidence", f"""+ {ASSIGN}, k AS (SELECT *, row_number() OVER (PARTITION BY subject, slice, x, y ORDER BY p DESC) AS rn FROM po)
 SELECT subject, slice, x, y, {r('max(p)')} AS confidence, max(p) FILTER (rn = 2) > 0.30 AS ambiguous FROM k GROUP BY subject, slice, x, y""")
def p15(spark, sf_dir):
    return assigned(spark, sf_dir).select("subject", "slice", "x", "y", "confidence", "ambiguous")


@query("a31_descriptors", f"""+ {ASSIGN}, u AS (SELECT subject, cluster, p, d, unnest([1, 2, 3, 4]) AS dim, unnest(v) AS x FROM po),
 g AS (SELECT subject, cluster, dim, avg(p) AS pi, sum(p * x * x) / sum(p) - (sum(p * x) / sum(p)) ** 2 AS var, sum(p * d) / sum(p) AS res FROM u GROUP BY ALL)
 SELECT subject, CAST(cluster AS INTEGER) AS cluster, {r('max(pi)')} AS pi, {r('avg(var)')} AS sigma2, {r('max(res)')} AS residual FROM g GROUP BY ALL""")
def a31(spark, sf_dir):
    return descriptors.describe(assigned(spark, sf_dir), ["subject"], 3)


@query("a37_certainty", f"""+ {ASSIGN}, k AS (SELECT *, row_number() OVER (PARTITION BY subject, slice, x, y ORDER BY p DESC) AS rn FROM po),
 c AS (SELECT subject, slice, x, y, max(p) AS confidence, max(p) FILTER (rn = 2) > 0.30 AS ambiguous FROM k GROUP BY subject, slice, x, y)
 SELECT subject, count(*) AS n, count(*) FILTER (confidence >= 0.8) AS n_sure, count(*) FILTER (confidence < 0.5) AS n_unsure, count(*) FILTER (ambiguous) AS n_ambiguous FROM c GROUP BY subject""")
def a37(spark, sf_dir):
    return descriptors.certainty(assigned(spark, sf_dir), ["subject"])


def _points(spark, sf_dir):
    return voxel_vectors(spark, sf_dir).withColumn("g", F.col("subject").cast("string"))


@query("m2_kmeans")
def m2(spark, sf_dir):
    """k-means of each subject: cluster centres and cost."""
    best = mixture.kmeans(results.written(_points(spark, sf_dir), "cells"), 3, restarts=10)
    rows = [(g, i, [float(x) for x in c], cost) for g, (centres, cost) in sorted(best.items()) for i, c in enumerate(centres)]
    return spark.createDataFrame(rows, "subject string, cluster int, centre array<double>, cost double")


@query("m1_gmm_shares")
def m1(spark, sf_dir):
    """Gaussian mixture of each subject: count and mean posterior of each component."""
    points = results.written(_points(spark, sf_dir), "cells")
    out = mixture.predict(points, mixture.fit(points, 3, steps=15))
    return out.groupBy("subject", "label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_max("proba")).alias("confidence"))


@query("m9_choose_k")
def m9(spark, sf_dir):
    """Number of components of each subject by the information criterion."""
    scores = mixture.choose_k(results.written(_points(spark, sf_dir), "cells"), list(range(2, 11)))
    return selection.best_k(scores.withColumnRenamed("g", "subject"), ["subject"], "bic")
