"""Queries on label texts, parameter sets and covariates.

Labels are made from ``part`` (a name by size, a suffix by key); parameter sets
from ``lineitem`` (the parameters that an order's lines name).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import params, spatial
from .catalog import CEN, KEYS, PROFILE_SQL, _centroids, query, r, rule_profiles
from .catalog_more import EXT, extents

NAMES = ("Necrosis", "Hypoxic/vascular", "Cellular/proliferative", "Infiltrative", "Bulk tumor", "Astrocyte barrier", "Near-normal", "Mixed zone")
SUFFIXES = ("", " +", " (MTR^)", " (cystic) (T2v) +", " (hemorrhagic)", " (atypical)", " (T2 low) (MTR high)")
LAB = f"""lab AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(l) ELSE l END AS label FROM
 (SELECT p_partkey, concat(['{"', '".join(NAMES)}'][CAST(p_size % 8 + 1 AS INT)], ['{"', '".join(SUFFIXES)}'][CAST(p_partkey % 7 + 1 AS INT)]) AS l FROM part))"""


def labels(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), i.cast("int") + 1)
    text = F.concat(pick(NAMES, F.col("p_size") % 8), pick(SUFFIXES, F.col("p_partkey") % 7))
    return part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.upper(text)).otherwise(text).alias("label"))


def _prefix_sql(known, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(lower(trim(label)), '{k.lower()}') THEN '{k}'" for k in known) + f" ELSE {otherwise} END"


@query("f1_prefix_label", f"WITH {LAB} SELECT p_partkey, {_prefix_sql(L.CANONICAL, 'label')} AS label FROM lab", cells=False)
def f1(spark, sf_dir):
    return labels(spark, sf_dir).select("p_partkey", L.canonical(F.col("label")).alias("label"))


_BIO = ", ".join(f"'{b}'" for b in L.BIOLOGICAL)
_LAST = r"^(.*?)\s*\(([^)]+)\)\s*$"
_STRIP = ", ".join(
    f"s{i + 1} AS (SELECT p_partkey, CASE WHEN regexp_matches(l, '{_LAST}') AND trim(lower(regexp_extract(l, '{_LAST}', 2))) NOT IN ({_BIO}) THEN trim(regexp_extract(l, '{_LAST}', 1)) ELSE l END AS l FROM s{i})"
    for i in range(4))


@query("f2_without_suffixes", f"WITH {LAB}, s0 AS (SELECT p_partkey, trim(regexp_replace(label, '\\s*\\+\\s*$', '')) AS l FROM lab), {_STRIP} SELECT p_partkey, l AS label FROM s4", cells=False)
def f2(spark, sf_dir):
    return labels(spark, sf_dir).select("p_partkey", L.without_suffixes(F.col("label")).alias("label"))


@query("f3_base_label", f"WITH {LAB} SELECT p_partkey, trim(split_part(label, ' (', 1)) AS label FROM lab", cells=False)
def f3(spark, sf_dir):
    from ..functions import exprs as X

    return labels(spark, sf_dir).select("p_partkey", X.base_label(F.col("label")).alias("label"))


@query("f4_family", f"WITH {LAB} SELECT p_partkey, {_prefix_sql(L.FAMILIES, 'trim(label)')} AS family FROM lab", cells=False)
def f4(spark, sf_dir):
    return labels(spark, sf_dir).select("p_partkey", L.family(F.col("label")).alias("family"))


SMOOTH = _prefix_sql(L.SMOOTHING_FAMILIES, "'Bulk tumor'")


@query("f5_smoothing_family", f"WITH {LAB} SELECT p_partkey, {SMOOTH} AS family FROM lab", cells=False)
def f5(spark, sf_dir):
    return labels(spark, sf_dir).select("p_partkey", L.smoothing_family(F.col("label")).alias("family"))


_PAIRS = ", ".join(f"('{x}', '{y}', {p})" for (a, b), p in spatial.PENALTIES.items() for x, y in ((a, b), (b, a)))


@query("sp10_transition_penalty", f"""WITH {LAB}, fam AS (SELECT p_partkey, {SMOOTH} AS family FROM lab), t AS (SELECT * FROM (VALUES {_PAIRS}) AS v(a, b, p))
 SELECT x.p_partkey, x.family AS a, y.family AS b, CAST(coalesce(p, 0.0) AS DOUBLE) AS penalty FROM fam x JOIN fam y ON y.p_partkey = x.p_partkey + 1 LEFT JOIN t ON t.a = x.family AND t.b = y.family""", cells=False)
def sp10(spark, sf_dir):
    fam = labels(spark, sf_dir).select("p_partkey", L.smoothing_family(F.col("label")).alias("a"))
    after = fam.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return fam.join(after, "p_partkey").select("p_partkey", "a", "b", spatial.transition_penalty(F.col("a"), F.col("b")).alias("penalty"))


_FR = "CASE " + " ".join(f"WHEN starts_with(label, '{k}') THEN concat('{v}', substr(label, {len(k) + 1}))" for k, v in sorted(L.DISPLAY["fr"].items(), key=lambda x: -len(x[0]))) + " ELSE label END"


@query("f22_display_label", f"WITH {LAB} SELECT p_partkey, {_FR} AS label FROM lab", cells=False)
def f22(spark, sf_dir):
    return labels(spark, sf_dir).select("p_partkey", L.display(F.col("label"), "fr").alias("label"))


@query("f24_common_beginning", """SELECT p_size AS grp, regexp_replace(left(min(p_name), len(list_filter(range(1, len(min(p_name)) + 1), lambda i: left(min(p_name), i) = left(max(p_name), i)))), '[-_.]+$', '') AS name
 FROM (SELECT p_size, concat('sub-', p_size, '_', p_name) AS p_name FROM part) GROUP BY p_size""", cells=False)
def f24(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat(F.lit("sub-"), F.col("p_size").cast("string"), F.lit("_"), "p_name")
    return part.select(F.col("p_size").alias("grp"), name.alias("name")).groupBy("grp").agg(L.common_beginning(F.col("name")).alias("name"))


@query("f26_repaired_json", """SELECT p_partkey, 'Hypoxic/vascular' AS label, CAST(p_size AS INTEGER) AS n FROM part""", cells=False)
def f26(spark, sf_dir):
    """A label without its closing quote is put right before the text is parsed."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.lit('{"label": "Hypoxic/vascular, "n": '), F.col("p_size").cast("string"), F.lit("}"))
    return part.select("p_partkey", F.from_json(L.repaired(text), "label string, n int").alias("j")).select("p_partkey", "j.*")


@query("f19_relative_comparators", f"""WITH {PROFILE_SQL} SELECT run, habitat, abs(t2 - md) < 0.25 AS similar, t2 < md - 0.35 AS smaller, t2 < md - 0.75 AS much_smaller,
 greatest(md, fa) - least(md, fa) > 0.5 AND t2 > least(md, fa) + 0.25 AND t2 < greatest(md, fa) - 0.25 AS between FROM f""", cells=False)
def f19(spark, sf_dir):
    t2, md, fa = F.col("t2"), F.col("md"), F.col("fa")
    return rule_profiles(spark, sf_dir).select(*KEYS, L.similar(t2, md).alias("similar"), L.smaller(t2, md).alias("smaller"), L.much_smaller(t2, md).alias("much_smaller"), L.between(t2, md, fa).alias("between"))


@query("f17_magnitude_words", f"""+ {CEN} SELECT subject, habitat, param, CASE WHEN abs(mean) >= 1.5 THEN 'strongly ' || CASE WHEN mean > 0 THEN 'elevated' ELSE 'decreased' END
 WHEN abs(mean) >= 0.7 THEN 'mildly ' || CASE WHEN mean > 0 THEN 'elevated' ELSE 'decreased' END ELSE 'near-normal' END AS word FROM cen""")
def f17(spark, sf_dir):
    return _centroids(spark, sf_dir).select("subject", "habitat", "param", L.magnitude_words(F.col("mean")).alias("word"))


def _case(score: str, i: int) -> str:
    return "CASE " + " ".join(f"WHEN {score} < {x[0]} THEN '{x[i]}'" for x in L.EXTENT) + f" ELSE '{L.EXTENT_ABOVE[i - 1]}' END"


@query("f18_extent_verdict", f"+ {EXT}, s2 AS (SELECT subject, habitat, avg(extent) AS score FROM ext GROUP BY ALL) SELECT subject, habitat, {r('score')} AS score, {_case('score', 1)} AS level, {_case('score', 2)} AS label FROM s2")
def f18(spark, sf_dir):
    s = extents(spark, sf_dir).groupBy("subject", "habitat").agg(F.avg("extent").alias("score"))
    return s.withColumns({"level": L.extent_level(F.col("score")), "label": L.extent_label(F.col("score"))})


@query("o7_deviant_parameters", f"""+ {CEN}, k AS (SELECT *, row_number() OVER (PARTITION BY subject, habitat ORDER BY round(abs(mean), 9) DESC, param) AS rn FROM cen)
 SELECT subject, habitat, coalesce(string_agg(param || CASE WHEN mean > 0 THEN '↑' ELSE '↓' END, '  ' ORDER BY rn) FILTER (abs(mean) > 0.15), '') AS directions FROM k WHERE rn <= 3 GROUP BY ALL""")
def o7(spark, sf_dir):
    """The three most deviant parameters of a habitat, with an arrow where they deviate by more than 0.15."""
    w = Window.partitionBy("subject", "habitat").orderBy(F.desc(F.round(F.abs("mean"), 9)), "param")
    top = _centroids(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    named = F.when(F.abs("mean") > 0.15, F.concat("param", F.when(F.col("mean") > 0, "↑").otherwise("↓")))
    found = top.groupBy("subject", "habitat").agg(F.sort_array(F.collect_list(F.when(named.isNotNull(), F.struct("rn", named.alias("t"))))).alias("d"))  # three at most
    return found.select("subject", "habitat", F.array_join(F.transform("d", lambda x: x["t"]), "  ").alias("directions"))


@query("w5_display_names", f"""WITH {LAB}, c AS (SELECT DISTINCT {_prefix_sql(L.CANONICAL, 'label')} AS label FROM lab), g AS (SELECT label, {_prefix_sql(L.FAMILIES, 'trim(label)')} AS family FROM c)
 SELECT label, CASE WHEN count(*) OVER (PARTITION BY family) = 1 THEN family ELSE concat(family, ' ', row_number() OVER (PARTITION BY family ORDER BY label)) END AS name FROM g""", cells=False)
def w5(spark, sf_dir):
    """A family's name, numbered where several canonical labels share it."""
    c = labels(spark, sf_dir).select(L.canonical(F.col("label")).alias("label")).distinct().withColumn("family", L.family(F.col("label")))
    w = Window.partitionBy("family")
    n = F.row_number().over(w.orderBy("label"))
    return c.select("label", F.when(F.count(F.lit(1)).over(w) == 1, F.col("family")).otherwise(F.concat("family", F.lit(" "), n.cast("string"))).alias("name"))


# --- parameter sets ---------------------------------------------------------------------

_LIST = "['" + "', '".join(params.LISTED) + "']"
SETS = f"ps AS (SELECT DISTINCT l_orderkey AS source, l_orderkey // 4 AS cohort, {_LIST}[CAST(l_partkey % 7 + 1 AS INT)] AS param FROM lineitem)"


def parameter_sets(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    param = F.element_at(F.array(*[F.lit(p) for p in params.LISTED]), (F.col("l_partkey") % 7).cast("int") + 1)
    return li.select(F.col("l_orderkey").alias("source"), F.expr("l_orderkey div 4").alias("cohort"), param.alias("param")).distinct()


RESOLVED = "b AS (SELECT source, bool_or(param = 'DTI-AD') AND bool_or(param = 'DTI-RD') AS two FROM ps GROUP BY source), rs AS (SELECT source, cohort, param, CASE WHEN two THEN 'AD_RD' ELSE 'MD' END AS mode FROM ps JOIN b USING (source) WHERE NOT (two AND param = 'DTI-MD'))"


@query("p11_diffusivity", f"WITH {SETS}, {RESOLVED} SELECT source, param, mode FROM rs", cells=False)
def p11(spark, sf_dir):
    return params.resolved(parameter_sets(spark, sf_dir), ["source"])


def _place_sql(order) -> str:
    return "coalesce(nullif(list_position(['" + "', '".join(order) + f"'], param), 0), {len(order) + 1})"


COMMON = "tot AS (SELECT cohort, count(DISTINCT source) AS total FROM ps GROUP BY cohort), n AS (SELECT cohort, param FROM (SELECT cohort, param, count(DISTINCT source) AS c FROM ps GROUP BY ALL) JOIN tot USING (cohort) WHERE c = total)"


@query("u3_common_by_priority", f"WITH {SETS}, {COMMON} SELECT cohort, param, CAST(row_number() OVER (PARTITION BY cohort ORDER BY {_place_sql(params.PRIORITY)}, param) AS INTEGER) AS place FROM n", cells=False)
def u3(spark, sf_dir):
    return params.common(parameter_sets(spark, sf_dir), ["cohort"], "source", params.PRIORITY)


@query("u7_comparison_parameters", f"""WITH {SETS}, {COMMON}, b AS (SELECT cohort, bool_or(param = 'DTI-AD') AND bool_or(param = 'DTI-RD') AS two FROM n GROUP BY cohort)
 SELECT cohort, param, CASE WHEN two THEN 'AD_RD' ELSE 'MD' END AS mode FROM n JOIN b USING (cohort) WHERE NOT (two AND param = 'DTI-MD')""", cells=False)
def u7(spark, sf_dir):
    """Parameters that all sources of a cohort have, with diffusivity resolved."""
    return params.resolved(params.common(parameter_sets(spark, sf_dir), ["cohort"], "source", params.LISTED), ["cohort"])


@query("p22_reference_picture", f"WITH {SETS} SELECT source, arg_min(param, {_place_sql(params.PICTURE)}) AS param FROM ps GROUP BY source", cells=False)
def p22(spark, sf_dir):
    return params.picture(parameter_sets(spark, sf_dir), ["source"])


@query("p23_zones", "SELECT subject, CASE WHEN habitat IN (0) THEN 'core' ELSE 'periphery' END AS zone, count(*) AS n FROM cells GROUP BY ALL")
def p23(spark, sf_dir):
    from ..sources import roi

    return params.zones(roi.cells(spark, sf_dir), [0]).groupBy("subject", "zone").agg(F.count(F.lit(1)).alias("n"))


@query("p25_covariates", f"""WITH seen AS (SELECT c_mktsegment AS s, min(c_custkey) AS first_at FROM customer GROUP BY ALL), d AS (SELECT s FROM seen WHERE first_at < (SELECT max(first_at) FROM seen)),
 dates AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS dt FROM orders GROUP BY ALL)
 SELECT c_custkey, 'balance' AS name, {r('c_acctbal')} AS value FROM customer
 UNION ALL SELECT c_custkey, concat('segment[', s, ']'), CASE WHEN c_mktsegment = s THEN 1.0 ELSE 0.0 END FROM customer, d
 UNION ALL SELECT o_custkey, 'since', CAST(date_diff('day', (SELECT min(dt) FROM dates), dt) AS DOUBLE) FROM dates""", cells=False)
def p25(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("text"))
    text = lambda name, col: c.select("c_custkey", F.lit(name).alias("name"), F.col(col).cast("string").alias("text"))
    rows = text("balance", "c_acctbal").unionByName(text("segment", "c_mktsegment")).unionByName(o.select("c_custkey", F.lit("since").alias("name"), "text"))
    return params.covariates(rows, "c_custkey")
