"""Labelling of habitats by votes of labelling functions and by scored rules.

Rules are data; they are compiled to column expressions, so labelling runs
inside the JVM on the (small) table of habitat profiles. NULL is abstention,
and a comparison with a missing parameter abstains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

# Labels in the order that settles ties, and their mass when nothing votes.
LABELS = ("Necrosis", "Hypoxic/vascular", "Cellular/proliferative", "Infiltrative", "Bulk tumor", "Astrocyte barrier")
FLOOR = {"Necrosis": 0.01, "Hypoxic/vascular": 0.01, "Cellular/proliferative": 0.01, "Infiltrative": 0.0, "Bulk tumor": 0.05, "Astrocyte barrier": 0.0}

# The labelling functions (name, label, when it votes, when it holds back), in their order.
VOTES = (
    ("nec_t2_md", "Necrosis", "t2 > 0.5 and md > 0.5", None),
    ("nec_fa_collapse", "Necrosis", "fa < -0.3 and md > 0.2", None),
    ("nec_md_extreme", "Necrosis", "md > 1.0", None),
    ("hyp_t2s_t2", "Hypoxic/vascular", "t2star < -0.15 and t2 >= -0.5", None),
    ("hyp_spatial", "Hypoxic/vascular", "d > 0.03 and d < 0.45", "t2star > 0.3"),
    ("hyp_pericore", "Hypoxic/vascular", "d > 0.03 and d < 0.3", "(t2 > 1.5 and md > 1.5) or t2star > 0.5"),
    ("hyp_t2s_strong", "Hypoxic/vascular", "t2star < -0.5", "md > 1.5"),
    ("cel_md_mtr", "Cellular/proliferative", "md < -0.1 and mtr > 0.1", "fa > 0.3"),
    ("cel_md_strong", "Cellular/proliferative", "md < -0.3", "fa > 0.3"),
    ("cel_t2_md", "Cellular/proliferative", "t2 < -0.2 and md < -0.1", None),
    ("cel_pericore", "Cellular/proliferative", "d > 0.05 and d < 0.25 and t2star >= -0.1 and t2 <= -0.2 and (md < -0.2 or fa > 0.5)", None),
    ("inf_fa_periph", "Infiltrative", "fa > 0.1 and d > 0.5", None),
    ("inf_md_intermed", "Infiltrative", "md > -0.2 and md < 0.3 and fa > 0.0 and d > 0.4", None),
    ("bulk_near_median", "Bulk tumor", "abs(t2star) < 0.2 and abs(md) < 0.2 and abs(t2) < 0.3", None),
    ("bulk_periph", "Bulk tumor", "d > 0.75 and t2star > -0.2", None),
    ("bulk_rel_median", "Bulk tumor", "l2_rel < 0.25", "md < -0.1"),
    ("ast_fa_mtr", "Astrocyte barrier", "fa > 1.3 and mtr > 0.3", "t2 > 0.5 and md > 0.5"),
    ("ast_fa_rd", "Astrocyte barrier", "fa > 1.3 and rd < -0.5", "t2 > 0.5 and md > 0.5"),
)

# Scored rules; (low, high) bounds are inclusive, None is open.
RULES = (
    {"name": "Necrosis", "must_have": ("t2", "md"), "required": {"t2": (0.5, None), "md": (0.5, None)}, "support": {"fa": (None, -0.1), "t2star": (None, 0.0)},
     "exclude": {}, "compound": ()},
    {"name": "Hypoxic/vascular", "must_have": ("t2star",), "required": {"t2star": (None, -0.15), "t2": (0.0, None)},
     "support": {"md": (None, 0.3), "mtr": (None, 0.0), "d": (0.10, 0.70)}, "exclude": {"md": (0.5, None)}, "compound": ({"d": (0.80, None), "t2star": (-0.20, None)},)},
    {"name": "Cellular/proliferative", "must_have": ("md",), "required": {"md": (None, 0.0), "mtr": (0.1, None)}, "support": {"fa": (None, 0.0), "t2": (None, 0.0)},
     "exclude": {"t2": (0.5, None)}, "compound": ()},
    {"name": "Infiltrative", "must_have": ("fa",), "required": {"t2": (0.0, None), "fa": (0.1, None)},
     "support": {"md": (0.0, 0.8), "ad": (0.0, None), "rd": (0.0, None), "mtr": (0.3, None)}, "exclude": {"d": (None, 0.3), "md": (None, -0.1)},
     "compound": ({"md": (0.8, None), "t2": (0.3, None)},)},
)
PARAMETERS = ("t2", "md", "fa", "t2star", "mtr", "rd", "ad", "d")
WINS, MARGIN = 0.55, 0.15


def profile_features(profiles: DataFrame, by: list[str], features: tuple[str, ...] = ("t2", "md", "fa", "t2star", "mtr")) -> DataFrame:
    """Adds l2 (distance from the median, the origin) and l2_rel, relative to the largest of ``by``."""
    l2 = F.sqrt(sum((F.coalesce(F.col(c), F.lit(0.0)) ** 2 for c in features), F.lit(0.0)))
    out = profiles.withColumn("l2", l2)
    most = F.max("l2").over(Window.partitionBy(*by))
    return out.withColumn("l2_rel", F.when(most > 1e-8, F.col("l2") / most).otherwise(0.0))


def necrotic_candidate(profiles: DataFrame, by: list[str], label: str = "habitat") -> DataFrame:
    """Per group the habitat with the largest T2 + MD, both positive."""
    ok = profiles.where("t2 > 0 and md > 0")
    return ok.groupBy(*by).agg(F.max_by(label, F.struct(F.col("t2") + F.col("md"), -F.col(label))).alias("necrotic"))


def median_anchor(profiles: DataFrame, by: list[str], label: str = "habitat") -> DataFrame:
    return profiles.groupBy(*by).agg(F.min_by(label, F.struct("l2", label)).alias("anchor"))


def vote_column(when: str, unless: str | None, label: str) -> Column:
    hold = F.coalesce(F.expr(unless), F.lit(False)) if unless else F.lit(False)
    return F.when(F.expr(when) & ~hold, F.lit(label))


def votes(profiles: DataFrame, keys: list[str], table: tuple = VOTES) -> DataFrame:
    """(keys, lf, target, vote): one row per habitat and labelling function."""
    cols = F.array(*[F.struct(F.lit(n).alias("lf"), F.lit(label).alias("target"), vote_column(when, unless, label).alias("vote")) for n, label, when, unless in table])
    return profiles.select(*keys, F.inline(cols))


def weighted_vote(vote_rows: DataFrame, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(keys, label, p): floor plus weights of the votes, normalised over the labels."""
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("lf")), F.lit(1.0)) if weights else F.lit(1.0)
    each = [F.sum(F.when(F.col("vote") == x, w).otherwise(0.0)) + FLOOR[x] for x in LABELS]
    sums = vote_rows.groupBy(*keys).agg(*[e.alias(f"_{i}") for i, e in enumerate(each)])
    total = sum((F.col(f"_{i}") for i in range(len(LABELS))), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(x).alias("label"), (F.col(f"_{i}") / total).alias("p"), F.lit(i).alias("place")) for i, x in enumerate(LABELS)])
    return sums.select(*keys, F.inline(rows))


def weights_without(vote_rows: DataFrame, truth: DataFrame, keys: list[str], run: str = "run") -> DataFrame:
    """(run, lf, weight): the precision of a labelling function over all runs but this one, from sums less the run's own; 0.5 if it never votes there."""
    c = vote_rows.join(truth, keys).groupBy("lf", run).agg(F.count("vote").alias("n"), F.count_if(F.col("vote") == F.col("truth")).alias("hit"))
    t = c.groupBy("lf").agg(F.sum("n").alias("tn"), F.sum("hit").alias("th"))
    rest = F.col("tn") - F.col("n")
    return c.join(t, "lf").select(run, "lf", F.when(rest > 0, (F.col("th") - F.col("hit")) / rest).otherwise(0.5).alias("weight"))


def held_out_labels(vote_rows: DataFrame, truth: DataFrame, keys: list[str], run: str = "run") -> DataFrame:
    """(keys, truth, label): each habitat labelled under weights that its own run had no part in; ties go to the first of ``LABELS``."""
    w = vote_rows.join(weights_without(vote_rows, truth, keys, run), [run, "lf"])
    each = [F.round(F.sum(F.when(F.col("vote") == x, F.col("weight")).otherwise(0.0)) + FLOOR[x], 9) for x in LABELS]
    sums = w.groupBy(*keys).agg(F.array(*[F.struct(e.alias("s"), F.lit(-i).alias("place")) for i, e in enumerate(each)]).alias("a"))
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), 1 - F.array_max("a")["place"])
    return truth.join(sums.select(*keys, label.alias("label")), keys)


def scores_by_class(labelled: DataFrame) -> DataFrame:
    """(class, support, precision, recall, f1) of (truth, label), for classes that are the truth somewhere."""
    right = F.col("label") == F.col("truth")
    t = labelled.groupBy(F.col("truth").alias("class")).agg(F.count(F.lit(1)).alias("support"), F.count_if(right).alias("tp"))
    named = labelled.groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("named"))
    precision, recall = F.coalesce(F.col("tp") / F.col("named"), F.lit(0.0)), F.col("tp") / F.col("support")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return t.join(named, "class", "left").select("class", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def decide(probabilities: DataFrame, keys: list[str], threshold: float = 0.0) -> DataFrame:
    """Best label, its probability, bucket, entropy, whether a second is within the margin, and abstention."""
    rows = probabilities.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("m"), "place", "label"))).alias("r"))  # six labels
    best, second = -F.col("r")[0]["m"], -F.col("r")[1]["m"]
    gone = F.lit(threshold > 0) & (best < threshold)
    return rows.select(
        *keys, F.when(gone, "Unknown").otherwise(F.col("r")[0]["label"]).alias("label"), best.alias("score"), X.bucket(best).alias("confidence"),
        X.entropy_bits(F.transform("r", lambda x: -x["m"])).alias("entropy"), (second >= best - MARGIN).alias("is_ambiguous"), gone.alias("abstained"))


def _within(param: str, low: float | None, high: float | None) -> Column:
    c = F.col(param)
    return F.coalesce(X.all_of([*([c >= low] if low is not None else []), *([c <= high] if high is not None else [])]), F.lit(False))


def rule_score(rule: dict) -> Column:
    """0 if excluded; all required met: 0.60 + 0.40 of the share of support; else 0.30 and 0.10 of the shares."""
    def share(conditions: dict) -> Column:
        met = sum((F.when(_within(p, *b), 1).otherwise(0) for p, b in conditions.items()), F.lit(0))
        known = sum((F.when(F.col(p).isNotNull(), 1).otherwise(0) for p in conditions), F.lit(0))
        return F.when(known > 0, met / known).otherwise(0.0)

    missing = X.any_of([F.col(p).isNull() for p in rule["must_have"]])
    excluded = X.any_of([_within(p, *b) for p, b in rule["exclude"].items()]) | X.any_of([X.all_of([_within(p, *b) for p, b in c.items()]) for c in rule["compound"]])
    required, support = share(rule["required"]), share(rule["support"])
    return F.when(missing | excluded, 0.0).when(required >= 1, 0.60 + 0.40 * support).otherwise(0.30 * required + 0.10 * support)


def suggest(profiles: DataFrame, keys: list[str], rules: tuple = RULES) -> DataFrame:
    """The rule with the largest score if it reaches ``WINS``, else bulk; with confidence and ambiguity."""
    missing = [p for p in PARAMETERS if p not in profiles.columns]
    p = profiles.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else profiles
    scored = F.array_sort(F.array(*[F.struct((-rule_score(r)).alias("m"), F.lit(i).alias("place"), F.lit(r["name"]).alias("name")) for i, r in enumerate(rules)]))
    p = p.select(*keys, scored.alias("r"))
    top, second = -F.col("r")[0]["m"], -F.col("r")[1]["m"]
    wins = top >= WINS
    label = F.when(wins, F.col("r")[0]["name"]).otherwise("Bulk tumor")
    conf = F.when(wins, F.when(top >= 0.90, "high").when(top >= 0.60, "medium").otherwise("low")).otherwise(F.when(top < 0.30, "high").otherwise("medium"))
    return p.select(*keys, label.alias("label"), F.when(label == "Infiltrative", "low").otherwise(conf).alias("confidence"), top.alias("score"), (wins & (second >= WINS) & (top - second < MARGIN)).alias("is_ambiguous"))


def vote_analysis(vote_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per labelling function: number and share of habitats it votes on, how often the majority of the other votes differs, and how many of them agree.

    Of equally frequent other labels the first in the fixed order is the majority.
    """
    here = Window.partitionBy(*keys)  # a habitat's votes: one per function
    own = [(F.col("vote") == x).cast("int") for x in LABELS]
    others = F.array(*[F.coalesce(F.sum(c).over(here), F.lit(0)) - F.coalesce(c, F.lit(0)) for c in own])
    v = vote_rows.withColumn("others", others)
    most = F.array_max("others")
    majority = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position("others", most).cast("int"))
    same = F.element_at("others", F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("vote")).cast("int"))
    voted = F.col("vote").isNotNull()
    v = v.withColumns({"apart": F.when(voted, F.when((most > 0) & (majority != F.col("vote")), 1.0).otherwise(0.0)), "same": F.when(voted, same)})
    return v.groupBy("lf", "target").agg(F.count("vote").alias("n_votes"), F.avg(F.when(voted, 1.0).otherwise(0.0)).alias("coverage"), F.coalesce(F.avg("apart"), F.lit(0.0)).alias("conflict"), F.coalesce(F.avg("same"), F.lit(0.0)).alias("overlap"))


def precision(vote_rows: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Share of a labelling function's votes that agree with ``truth`` (keys, truth); 0.5 without votes."""
    j = vote_rows.join(truth, keys)
    voted = F.count("vote")
    return j.groupBy("lf").agg(voted.alias("n_votes"), F.when(voted > 0, F.count_if(F.col("vote") == F.col("truth")) / voted).otherwise(0.5).alias("precision"))


def necrosis_guard(profiles: DataFrame, by: list[str], label: str = "habitat", t2_min: float = 0.5, md_min: float = 0.5, separation: float = 0.5) -> DataFrame:
    """Per group: the habitat with the largest T2 + MD, and whether it is clearly necrotic."""
    score = F.coalesce("t2", F.lit(0.0)) + F.coalesce("md", F.lit(0.0))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), label)
    r = profiles.withColumn("score", score).withColumns({"rn": F.row_number().over(w), "second": F.lead("score").over(w)}).where("rn = 1")
    ok = (F.coalesce("t2", F.lit(0.0)) >= t2_min) & (F.coalesce("md", F.lit(0.0)) >= md_min) & F.coalesce(F.col("score") - F.col("second") >= separation, F.lit(True))
    return r.select(*by, F.col(label).alias("candidate"), ok.alias("passes"))


def core_score() -> Column:
    """2 T2 + 2 MD - T2* - MTR."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return 2.0 * z("t2") + 2.0 * z("md") - z("t2star") - z("mtr")


def zone_guard(profiles: DataFrame, by: list[str], label: str = "habitat", features: tuple[str, ...] = ("t2", "md", "fa", "t2star", "mtr"), least_gap: float = 0.20) -> DataFrame:
    """(by, gap, valid, core, periphery) of groups of two habitats: valid if they differ by ``least_gap`` in a parameter; the core has the larger core score."""
    p = profiles.withColumn("s", core_score())
    spread = F.greatest(*[F.max(c) - F.min(c) for c in features])
    out = p.groupBy(*by).agg(spread.alias("gap"), F.max_by(label, "s").alias("c"), F.min_by(label, "s").alias("o"), F.count(F.lit(1)).alias("n"))
    valid = (F.col("gap") >= least_gap) & (F.col("n") == 2)
    return out.select(*by, "gap", valid.alias("valid"), F.when(valid, F.col("c")).alias("core"), F.when(valid, F.col("o")).alias("periphery"))


def subtypes(means: DataFrame, labels: DataFrame, by: list[str], label: str = "habitat") -> DataFrame:
    """Names for habitats that share a label: ranks along the parameter that varies most, which the name tells.

    ``means`` (by, habitat, param, unit), ``labels`` (by, habitat, label). Two alike get a down and an up mark, three
    low, mid and high, more ``i/n``.
    """
    j = means.join(labels, [*by, label])
    w = Window.partitionBy(*by, "label")
    v = j.groupBy(*by, "label", "param").agg(F.round(F.var_pop("unit"), 12).alias("v")).withColumn("rn", F.row_number().over(w.orderBy(F.desc("v"), "param"))).where("rn = 1")
    chosen = j.join(v.select(*by, "label", "param"), [*by, "label", "param"])
    at, n = F.row_number().over(w.orderBy(F.round("unit", 12), label)), F.count(F.lit(1)).over(w)
    mark = F.when(n == 2, F.when(at == 1, F.lit("v")).otherwise("^")).otherwise(F.concat(F.lit(" "), F.when(n == 3, F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("high")), at)).otherwise(F.concat(at.cast("string"), F.lit("/"), n.cast("string")))))
    named = F.when(n == 1, F.col("label")).otherwise(F.concat("label", F.lit(" ("), "param", mark, F.lit(")")))
    return chosen.withColumn("name", named).select(*by, label, "label", "name")
