"""Queries on rules: three passes, accuracy, vote quality, guards, zones and seeds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import passes, quantiles, rules, selection, spatial
from ..sources import results, roi
from .catalog import CHORD, KEYS, PROFILE_SQL, SC, VOTE_SQL, WEIGHTED, _score_sql, _scores, assigned, query, r, rule_profiles



def zone():
    return F.when(F.col("habitat") == 0, "core").otherwise("periphery")


_SC = ", sc AS (" + " UNION ALL ".join(f"SELECT run, habitat, '{x['name']}' AS name, {i} AS place, CAST({_score_sql(x)} AS DOUBLE) AS s FROM f" for i, x in enumerate(rules.RULES)) + ")"
_Z = lambda c: f"coalesce({c}, 0.0)"
_UNIT = ", ".join(f"CASE WHEN max({_Z(c)}) OVER w - min({_Z(c)}) OVER w > 1e-8 THEN ({_Z(c)} - min({_Z(c)}) OVER w) / (max({_Z(c)}) OVER w - min({_Z(c)}) OVER w) ELSE 0.5 END AS u_{c}" for c in passes.FEATURES)
PASSES = PROFILE_SQL + _SC + f""",
 k AS (SELECT run, habitat, name, s, row_number() OVER (PARTITION BY run, habitat ORDER BY s DESC, place) AS rn FROM sc WHERE s >= 0.55),
 p1 AS (SELECT f.run, f.habitat, coalesce(max(k.name) FILTER (rn = 1), 'Bulk tumor') AS label_p1, coalesce(max(s) FILTER (rn = 1) >= 0.9, false) AS high,
  coalesce(arg_min(k.name, rn) FILTER (k.name <> CASE WHEN f.habitat = 0 THEN 'Infiltrative' ELSE 'Necrosis' END), 'Bulk tumor') AS free FROM f LEFT JOIN k ON k.run = f.run AND k.habitat = f.habitat GROUP BY f.run, f.habitat),
 zo AS (SELECT *, CASE WHEN label_p1 = CASE WHEN habitat = 0 THEN 'Infiltrative' ELSE 'Necrosis' END THEN free ELSE label_p1 END AS label FROM p1),
 x AS (SELECT f.*, label_p1, label, high, n / sum(n) OVER w AS share, {_UNIT} FROM f JOIN zo USING (run, habitat) WINDOW w AS (PARTITION BY f.run)),
 am AS (SELECT run, habitat AS am, share AS am_share, u_fa AS m_fa, u_md AS m_md, coalesce(t2star, 0) AS m_t2star, coalesce(mtr, 0) AS m_mtr FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN share > 0.3 THEN 0 ELSE 1 END, l2, habitat) AS rn FROM x) WHERE rn = 1),
 an AS (SELECT run, habitat AS an, u_md AS n_md, u_t2 AS n_t2, u_fa AS n_fa FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY md - t2star DESC, habitat) AS rn FROM x WHERE label = 'Necrosis') WHERE rn = 1 AND high),
 y AS (SELECT *, CASE WHEN am_share > 0.3 THEN 'Bulk tumor' ELSE 'Bulk tumor (atypical)' END AS bulk FROM x JOIN am USING (run) LEFT JOIN an USING (run)),
 y1 AS (SELECT *, CASE WHEN habitat = am OR (label = 'Hypoxic/vascular' AND d > 0.75) THEN bulk ELSE label END AS l1, an IS NOT NULL AND habitat <> am AND habitat <> an AS ask FROM y),
 y2 AS (SELECT *, CASE WHEN ask AND l1 = 'Infiltrative' AND u_fa < m_fa - 0.75 AND u_md > m_md + 0.3 THEN 'Necrosis' WHEN ask AND l1 = 'Hypoxic/vascular' AND abs(u_md - n_md) < 0.25 AND abs(u_t2 - n_t2) < 0.25 THEN 'Necrosis'
  WHEN ask AND l1 = 'Necrosis' AND greatest(m_md, n_md) - least(m_md, n_md) > 0.5 AND u_md > least(m_md, n_md) + 0.25 AND u_md < greatest(m_md, n_md) - 0.25 AND u_fa > n_fa + 0.3 THEN 'Infiltrative' ELSE l1 END AS label_p2 FROM y1),
 tp AS (SELECT run, habitat, label_p1, label_p2, CASE WHEN contains(label_p2, 'Necrosis') THEN CASE WHEN t2star < m_t2star - 0.75 THEN 'Necrosis (hemorrhagic)' WHEN mtr > m_mtr + 0.35 THEN 'Necrosis (proteic)' WHEN mtr < m_mtr - 0.75 THEN 'Necrosis (cystic)' ELSE label_p2 END
  WHEN label_p2 = 'Infiltrative' AND 1 - m_fa > 0.05 THEN CASE WHEN (u_fa - m_fa) / (1 - m_fa) < 0.5 THEN 'Infiltrative (edematous)' ELSE 'Infiltrative (infiltrated)' END ELSE label_p2 END AS label, am AS anchor_median, an AS anchor_necrotic FROM y2)"""


@query("l26_three_passes", f"WITH {PASSES} SELECT * REPLACE (coalesce(anchor_necrotic, -1) AS anchor_necrotic) FROM tp", cells=False)
def l26(spark, sf_dir):
    return passes.three_passes(rule_profiles(spark, sf_dir), ["run"], zone=zone()).na.fill(-1, ["anchor_necrotic"])


WS = f"{WEIGHTED}, kk AS (SELECT *, row_number() OVER (PARTITION BY run, habitat ORDER BY p DESC, place) AS rn FROM pr), ws AS (SELECT run, habitat, label, p AS score FROM kk WHERE rn = 1)"


def voted(spark, sf_dir, table=rules.VOTES, threshold: float = 0.0):
    return rules.decide(rules.weighted_vote(rules.votes(rule_profiles(spark, sf_dir), KEYS, table), KEYS), KEYS, threshold)


_FAMILY = "CASE " + " ".join(f"WHEN starts_with(lower(l.label), '{x.lower()}') THEN '{x}'" for x in L.FAMILIES) + " ELSE l.label END"


@query("e6_three_pass_accuracy", f"WITH {PASSES}, {WS.removeprefix(PROFILE_SQL + ', ')} SELECT t.label AS truth, count(*) AS n, count(*) FILTER ({_FAMILY} = t.label) AS n_right, {r(f'count(*) FILTER ({_FAMILY} = t.label) / count(*)')} AS accuracy FROM tp l JOIN ws t USING (run, habitat) GROUP BY t.label", cells=False)
def e6(spark, sf_dir):
    """How often the three passes name the family that the weighted votes name."""
    return passes.agreement(passes.three_passes(rule_profiles(spark, sf_dir), ["run"], zone=zone()), voted(spark, sf_dir), KEYS)


# two functions with other thresholds: a simulation of a change
CHANGED = tuple((n, x, {"nec_md_extreme": "md > 0.8", "hyp_spatial": "d > 0.03 and d < 0.35"}.get(n, when), unless) for n, x, when, unless in rules.VOTES)


def _votes_sql(table) -> str:
    return " UNION ALL ".join(f"SELECT run, habitat, '{n}' AS lf, '{x}' AS target, CASE WHEN ({w})" + (f" AND NOT coalesce({u}, false)" if u else "") + f" THEN '{x}' END AS vote FROM f" for n, x, w, u in table)


@query("l30_changed_votes", f"WITH {PROFILE_SQL}, b AS ({_votes_sql(rules.VOTES)}), a AS ({_votes_sql(CHANGED)}) SELECT b.lf, count(b.vote) AS n_before, count(a.vote) AS n_after, count(*) FILTER (a.vote IS DISTINCT FROM b.vote) AS n_changed FROM b JOIN a USING (run, habitat, lf) GROUP BY b.lf", cells=False)
def l30(spark, sf_dir):
    """Votes of the labelling functions before and after two thresholds change."""
    p = rule_profiles(spark, sf_dir)
    before = rules.votes(p, KEYS).select(*KEYS, "lf", F.col("vote").alias("before"))
    j = before.join(rules.votes(p, KEYS, CHANGED).select(*KEYS, "lf", "vote"), [*KEYS, "lf"])
    return j.groupBy("lf").agg(F.count("before").alias("n_before"), F.count("vote").alias("n_after"), F.count_if(~F.col("vote").eqNullSafe(F.col("before"))).alias("n_changed"))


WS2 = WS.removeprefix(PROFILE_SQL + ", ").replace(VOTE_SQL.removeprefix(PROFILE_SQL + ", "), f"v2 AS ({_votes_sql(CHANGED)})").replace("FROM v CROSS", "FROM v2 CROSS").replace("lab AS", "lab2 AS").replace("JOIN lab ", "JOIN lab2 ").replace(" w AS (", " w2 AS (").replace("FROM w)", "FROM w2)").replace("pr AS", "pr2 AS").replace("FROM pr)", "FROM pr2)").replace("kk AS", "kk2 AS").replace("FROM kk ", "FROM kk2 ").replace("ws AS", "ws2 AS")


@query("e8_before_and_after", f"""WITH {PASSES}, {WS.removeprefix(PROFILE_SQL + ', ')}, {WS2} SELECT t.label_p1 AS truth, count(*) AS n, {r('count(*) FILTER (b.label = t.label_p1) / count(*)')} AS before, {r('count(*) FILTER (a.label = t.label_p1) / count(*)')} AS after
 FROM tp t JOIN ws b USING (run, habitat) JOIN ws2 a USING (run, habitat) GROUP BY t.label_p1""", cells=False)
def e8(spark, sf_dir):
    """Accuracy of the weighted votes by label, against the absolute rules, before and after the thresholds change."""
    truth = passes.first_pass(rule_profiles(spark, sf_dir)).select(*KEYS, F.col("label_p1").alias("truth"))
    j = truth.join(voted(spark, sf_dir).select(*KEYS, F.col("label").alias("b")), KEYS).join(voted(spark, sf_dir, CHANGED).select(*KEYS, F.col("label").alias("a")), KEYS)
    share = lambda c: F.count_if(F.col(c) == F.col("truth")) / F.count(F.lit(1))
    return j.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), share("b").alias("before"), share("a").alias("after"))


QUALITY = f"""{VOTE_SQL}, c AS (SELECT run, habitat, vote, count(*) AS n FROM v WHERE vote IS NOT NULL GROUP BY ALL),
 o AS (SELECT v.run, v.habitat, v.lf, v.vote AS own, c.vote AS other, c.n - CASE WHEN c.vote = v.vote THEN 1 ELSE 0 END AS m FROM v JOIN c ON c.run = v.run AND c.habitat = v.habitat WHERE v.vote IS NOT NULL),
 b AS (SELECT run, habitat, lf, own, arg_min(other, -m * 100 + list_position(['{"', '".join(rules.LABELS)}'], other)) AS most, max(m) AS m, coalesce(max(m) FILTER (other = own), 0) AS same FROM o GROUP BY ALL),
 a AS (SELECT v.lf, v.target, count(v.vote) AS n_votes, avg(CASE WHEN v.vote IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage, coalesce(avg(CASE WHEN b.m > 0 AND b.most <> b.own THEN 1.0 ELSE 0.0 END) FILTER (v.vote IS NOT NULL), 0.0) AS conflict,
  coalesce(avg(b.same) FILTER (v.vote IS NOT NULL), 0.0) AS overlap FROM v LEFT JOIN b USING (run, habitat, lf) GROUP BY ALL)"""


@query("a26_vote_coverage", f"WITH {QUALITY} SELECT lf, target, n_votes, {r('coverage')} AS coverage, {r('conflict')} AS conflict, {r('overlap')} AS overlap FROM a", cells=False)
def a26(spark, sf_dir):
    return rules.vote_analysis(rules.votes(rule_profiles(spark, sf_dir), KEYS), KEYS)


@query("e7_vote_flags", f"WITH {QUALITY} SELECT lf, CASE WHEN coverage > 0.80 THEN 'too wide' WHEN coverage < 0.05 THEN 'nearly useless' WHEN conflict > 0.50 THEN 'in conflict' ELSE '' END AS flag FROM a", cells=False)
def e7(spark, sf_dir):
    a = rules.vote_analysis(rules.votes(rule_profiles(spark, sf_dir), KEYS), KEYS)
    return a.select("lf", F.when(F.col("coverage") > 0.80, "too wide").when(F.col("coverage") < 0.05, "nearly useless").when(F.col("conflict") > 0.50, "in conflict").otherwise("").alias("flag"))


@query("a38_confidence_levels", f"WITH {WS} SELECT CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n, count(*) FILTER (score < 0.6) AS n_abstained FROM ws GROUP BY ALL", cells=False)
def a38(spark, sf_dir):
    return voted(spark, sf_dir, threshold=0.6).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if("abstained").alias("n_abstained"))


@query("l1_feature_table", f"""WITH {PROFILE_SQL}, nc AS (SELECT run, arg_max(md, t2 + md) AS nmd, arg_max(t2, t2 + md) AS nt2 FROM f WHERE t2 > 0 AND md > 0 GROUP BY run)
 SELECT f.run, habitat, {r('l2')} AS l2, {r('l2_rel')} AS l2_rel, {r('md - nmd')} AS delta_md, {r('t2 - nt2')} AS delta_t2 FROM f LEFT JOIN nc USING (run)""", cells=False)
def l1(spark, sf_dir):
    p = rule_profiles(spark, sf_dir)
    at = p.join(rules.necrotic_candidate(p, ["run"]), "run").where("habitat = necrotic").select("run", F.col("md").alias("nmd"), F.col("t2").alias("nt2"))
    return p.join(at, "run", "left").select("run", "habitat", "l2", "l2_rel", (F.col("md") - F.col("nmd")).alias("delta_md"), (F.col("t2") - F.col("nt2")).alias("delta_t2"))


@query("sp7_zone_guard", f"""WITH {PROFILE_SQL}, two AS (SELECT * FROM f WHERE habitat < 2), g AS (SELECT run, greatest(max(t2) - min(t2), max(md) - min(md), max(fa) - min(fa), max(t2star) - min(t2star), max(mtr) - min(mtr)) AS gap,
 arg_max(habitat, 2 * t2 + 2 * md - t2star - mtr) AS core, count(*) AS n FROM two GROUP BY run) SELECT run, {r('gap')} AS gap, gap >= 0.20 AND n = 2 AS valid, CASE WHEN gap >= 0.20 AND n = 2 THEN core END AS core, CASE WHEN gap >= 0.20 AND n = 2 THEN 1 - core END AS periphery FROM g""", cells=False)
def sp7b(spark, sf_dir):
    """Of a run's first two habitats the core and the periphery, if they differ enough in a parameter."""
    return rules.zone_guard(rule_profiles(spark, sf_dir).where("habitat < 2"), ["run"])


def _seed_sql(where: str) -> str:
    return f"""seeds AS (SELECT subject, slice, x AS sx, y AS sy FROM cells WHERE {where}), d AS (SELECT c.subject, c.slice, c.x, c.y, c.habitat, min(sqrt((x - sx) ** 2 + (y - sy) ** 2)) AS distance FROM cells c LEFT JOIN seeds s ON c.subject = s.subject AND c.slice = s.slice GROUP BY ALL)"""


_NORM = r("CASE WHEN max(distance) OVER (PARTITION BY subject) > 0 THEN distance / max(distance) OVER (PARTITION BY subject) ELSE distance END")


@query("sp2_zone_distance", f"+ {_seed_sql('habitat IN (0, 2)')} SELECT subject, slice, x, y, {_NORM} AS d_norm FROM d")
def sp2(spark, sf_dir):
    """Distance to the core zone, a set of habitats."""
    return spatial.zone_distance(roi.cells(spark, sf_dir), [0, 2]).drop("distance")


@query("sp3_necrotic_distance", f"+ hs AS (SELECT subject, count(*) FILTER (habitat = 0) / count(*) >= 0.25 AS ok FROM cells GROUP BY ALL), {_seed_sql('habitat = 0 OR habitat = 2 AND NOT (SELECT ok FROM hs WHERE hs.subject = cells.subject)')} SELECT subject, slice, x, y, ok AS necrotic, {_NORM} AS d_norm FROM d JOIN hs USING (subject)")
def sp3(spark, sf_dir):
    """Distance to the necrotic habitat of subjects whose guard holds, to the whole core of the others."""
    c = roi.cells(spark, sf_dir)
    ok = c.groupBy("subject").agg((F.count_if(F.col("habitat") == 0) / F.count(F.lit(1)) >= 0.25).alias("necrotic"))
    j = c.join(ok, "subject")
    d = spatial.seed_distance(j, (F.col("habitat") == 0) | ((F.col("habitat") == 2) & ~F.col("necrotic")))
    return d.join(ok, "subject").select("subject", "slice", "x", "y", "necrotic", "d_norm")


@query("sp4_joint_distance", f"""+ {_seed_sql('habitat = 0')}, fr AS (SELECT subject, count(*) FILTER (habitat = 0) / count(*) AS fraction FROM cells GROUP BY ALL),
 dn AS (SELECT *, CASE WHEN max(distance) OVER (PARTITION BY subject) > 0 THEN distance / max(distance) OVER (PARTITION BY subject) ELSE distance END AS dn FROM d),
 q AS (SELECT subject, median(dn) AS med, greatest(quantile_cont(dn, 0.75) - quantile_cont(dn, 0.25), 1e-8) AS iqr FROM dn GROUP BY subject)
 SELECT subject, slice, x, y, fraction >= 0.25 AS included, {r('CASE WHEN fraction >= 0.25 AND dn IS NOT NULL THEN (dn - med) / iqr ELSE 0.0 END')} AS d_scaled FROM dn JOIN fr USING (subject) JOIN q USING (subject)""")
def sp4(spark, sf_dir):
    return spatial.joint_distance(roi.cells(spark, sf_dir), 0, 0.25)


@query("l27_marked_labels", f"WITH {PASSES} SELECT run, habitat, CASE WHEN habitat = anchor_necrotic THEN concat(label, ' +') ELSE label END AS label FROM tp", cells=False)
def l27b(spark, sf_dir):
    """Labels of the three passes; that of the necrotic anchor, the most aggressive habitat, carries a mark."""
    return passes.marked(passes.three_passes(rule_profiles(spark, sf_dir), ["run"], zone=zone())).select("run", "habitat", "label")


# --- size guards -----------------------------------------------------------------------------


_KS = ", ".join(f"CAST(floor({k} * (x / 128.0) * (x / 128.0)) AS INTEGER)" for k in (2, 3, 4, 5))
SIZES = f"""g0 AS (SELECT subject, habitat, unnest([2, 3, 4, 5]) AS k, unnest([{_KS}]) AS cluster FROM cells), g1 AS (SELECT subject, k, cluster, count(*) AS n, arg_min(habitat, habitat) AS h0 FROM g0 GROUP BY ALL),
 g2 AS (SELECT *, CASE WHEN cluster = 0 THEN 'Necrosis (cystic)' WHEN cluster % 3 = 0 THEN 'Necrosis' WHEN cluster % 3 = 1 THEN 'Bulk tumor' ELSE 'Cellular/proliferative' END AS label FROM g1)"""


def solutions(spark, sf_dir):
    """Clusters of uneven size for each k, with labels."""
    ks = F.array(*[F.struct(F.lit(k).alias("k"), F.floor(k * (F.col("x") / 128.0) * (F.col("x") / 128.0)).cast("int").alias("cluster")) for k in (2, 3, 4, 5)])
    n = roi.cells(spark, sf_dir).select("subject", F.inline(ks)).groupBy("subject", "k", "cluster").agg(F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("cluster") == 0, "Necrosis (cystic)").when(F.col("cluster") % 3 == 0, "Necrosis").when(F.col("cluster") % 3 == 1, "Bulk tumor").otherwise("Cellular/proliferative")
    return n.withColumns({"label": label, "start": F.lit(5)})


def _guard_sql(small: str) -> str:
    return f"+ {SIZES}, b AS (SELECT subject, k, bool_or({small}) AS bad FROM (SELECT *, sum(n) OVER (PARTITION BY subject, k) AS total FROM g2) GROUP BY ALL) SELECT subject, max(k) FILTER (NOT bad OR k <= 2) AS k FROM b GROUP BY subject"


@query("m5_guarded_k", _guard_sql("n < 0.14 * total AND split_part(label, ' (', 1) NOT IN ('Necrosis', 'Infiltrative')"))
def m5(spark, sf_dir):
    return passes.size_guarded(solutions(spark, sf_dir), ["subject"], "start", 0.14)


@query("m6_joint_guarded_k", _guard_sql("n < 0.14 * total"))
def m6(spark, sf_dir):
    return passes.size_guarded(solutions(spark, sf_dir), ["subject"], "start", 0.14, protected=())


@query("m10_elbow_or_gap", f"""+ {SC}, {CHORD}, z AS (SELECT *, score >= lead(score) OVER w - lead(s) OVER w AS ok FROM sc WINDOW w AS (PARTITION BY subject ORDER BY k)), gr AS (SELECT subject, coalesce(min(k) FILTER (ok), max(k)) AS gap_k FROM z GROUP BY ALL),
 e AS (SELECT subject, arg_max(k, abs(gap)) AS elbow FROM g GROUP BY ALL) SELECT subject, elbow, gap_k, gap_k AS k, elbow AS guarded_k, elbow <> gap_k AS disagree FROM e JOIN gr USING (subject)""")
def m10(spark, sf_dir):
    """Number of clusters by the silhouette's elbow and by gap; where they disagree the gap decides, or with the guard the elbow."""
    s = _scores(spark, sf_dir).select("subject", "k", F.col("score").alias("silhouette"), F.col("score").alias("gap"), "s")
    guarded = selection.elbow_or_gap(s, ["subject"], guard=True).select("subject", F.col("k").alias("guarded_k"))
    return selection.elbow_or_gap(s, ["subject"]).join(guarded, "subject").withColumn("disagree", F.col("elbow") != F.col("gap_k"))


@query("sp9_smoothed")
def sp9(spark, sf_dir):
    """Cells by habitat before and after smoothing, whose costs follow from the families that the votes give the habitats; brute force in the tests."""
    a = results.written(assigned(spark, sf_dir).select("subject", "slice", "x", "y", F.col("label").alias("habitat"), "proba", "v"), "assigned")
    means = [F.avg(F.get("v", F.lit(i))).alias(c) for i, c in enumerate(("t2", "md", "t2star", "mtr"))]
    none = [F.lit(None).cast("double").alias(c) for c in ("fa", "rd", "ad", "d")]
    p = rules.profile_features(a.groupBy("habitat").agg(*means).select("*", *none, F.lit(0).alias("run")), ["run"])
    named = rules.decide(rules.weighted_vote(rules.votes(p, ["habitat"]), ["habitat"]), ["habitat"])
    families = {r["habitat"]: r["family"] for r in named.select("habitat", L.smoothing_family(F.col("label")).alias("family")).collect()}  # a row a habitat
    moved = spatial.smooth(a.drop("v"), spatial.family_penalties(families))
    return moved.groupBy("subject", "habitat", "smoothed").agg(F.count(F.lit(1)).alias("n"))
