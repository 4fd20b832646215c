"""Habitat labels in three passes: absolute rules, comparison with anchors, subtypes.

All on the small table of habitat profiles (keys ``by`` and a habitat, t2, md, fa, t2star, mtr, d, n), by windows
over a run's habitats; a run's habitats are few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from .rules import RULES, WINS, rule_score

FEATURES = ("t2", "md", "fa", "t2star", "mtr")
# Least share of a bulk anchor, and the distance beyond which hypoxia is not believed.
BULK_SHARE, FAR = 0.30, 0.75
#: Labels that a zone can't have.
FORBIDDEN = {"core": "Infiltrative", "periphery": "Necrosis"}


def first_pass(profiles: DataFrame, zone: Column | None = None) -> DataFrame:
    """Adds label_p1 (absolute), label (after the zone's constraint) and high (whether the winning score is at least 0.90)."""
    scored = F.array_sort(F.array(*[F.struct((-rule_score(x)).alias("m"), F.lit(i).alias("place"), F.lit(x["name"]).alias("name")) for i, x in enumerate(RULES)]))
    p = profiles.withColumn("ranked", F.filter(scored, lambda x: -x["m"] >= WINS))
    best = lambda r: F.coalesce(F.get(r, F.lit(0))["name"], F.lit("Bulk tumor"))
    p = p.withColumns({"label_p1": best(F.col("ranked")), "label": best(F.col("ranked")), "high": F.coalesce(-F.get("ranked", F.lit(0))["m"] >= 0.90, F.lit(False))})
    if zone is None:
        return p.drop("ranked")
    barred = reduce(lambda a, kv: a.when(zone == kv[0], F.lit(kv[1])), FORBIDDEN.items(), F.when(F.lit(False), ""))
    other = F.coalesce(F.get(F.filter("ranked", lambda x: x["name"] != barred), F.lit(0))["name"], F.lit("Bulk tumor"))
    return p.withColumn("label", F.when(F.coalesce(F.col("label") == barred, F.lit(False)), other).otherwise(F.col("label"))).drop("ranked")


def three_passes(profiles: DataFrame, by: list[str], habitat: str = "habitat", zone: Column | None = None) -> DataFrame:
    """(by, habitat, label_p1, label_p2, label, anchor_median, anchor_necrotic)."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    w = Window.partitionBy(*by)
    p = first_pass(profiles, zone).withColumn("l2", F.sqrt(sum((zero(c) ** 2 for c in FEATURES), F.lit(0.0)))).withColumn("share", F.col("n") / F.sum("n").over(w))
    # the habitat nearest to the median among the large ones, else among all; the most necrotic one, if its label is sure
    near = F.struct(F.when(F.col("share") > BULK_SHARE, 0).otherwise(1), "l2", habitat)
    necrotic = F.when(F.col("label") == "Necrosis", F.struct((zero("md") - zero("t2star")).alias("s"), (-F.col(habitat)).alias("h"), "high"))
    p = p.withColumns({"anchor_median": F.min_by(habitat, near).over(w), "top": F.max(necrotic).over(w)})
    p = p.withColumn("anchor_necrotic", F.when(F.col("top.high"), -F.col("top.h"))).withColumn("bulk", F.when(F.max(F.when(F.col(habitat) == F.col("anchor_median"), F.col("share"))).over(w) > BULK_SHARE, "Bulk tumor").otherwise("Bulk tumor (atypical)"))
    for c in FEATURES:  # 0 to 1 within the run, and the anchors' values
        lo, hi = F.min(zero(c)).over(w), F.max(zero(c)).over(w)
        p = p.withColumn(f"u_{c}", F.when(hi - lo > 1e-8, (zero(c) - lo) / (hi - lo)).otherwise(0.5))
        for anchor, short in (("anchor_median", "m"), ("anchor_necrotic", "n")):
            at = F.col(habitat) == F.col(anchor)
            p = p.withColumns({f"{short}_{c}": F.max(F.when(at, F.col(f"u_{c}"))).over(w), f"raw_{short}_{c}": F.max(F.when(at, zero(c))).over(w)})
    u = lambda c: F.col(f"u_{c}")
    is_median, is_necrotic = F.col(habitat) == F.col("anchor_median"), F.coalesce(F.col(habitat) == F.col("anchor_necrotic"), F.lit(False))
    far = (F.col("label") == "Hypoxic/vascular") & F.coalesce(F.col("d") > FAR, F.lit(False))
    p = p.withColumn("label_p2", F.when(is_median | far, F.col("bulk")).otherwise(F.col("label")))
    ask = F.col("anchor_necrotic").isNotNull() & ~is_median & ~is_necrotic
    collapsed = (F.col("label_p2") == "Infiltrative") & L.much_smaller(u("fa"), F.col("m_fa")) & (u("md") > F.col("m_md") + 0.3)
    alike = (F.col("label_p2") == "Hypoxic/vascular") & L.similar(u("md"), F.col("n_md")) & L.similar(u("t2"), F.col("n_t2"))
    amid = (F.col("label_p2") == "Necrosis") & L.between(u("md"), F.col("m_md"), F.col("n_md")) & (u("fa") > F.col("n_fa") + 0.3)
    p = p.withColumn("label_p2", F.when(ask & (collapsed | alike), "Necrosis").when(ask & amid, "Infiltrative").otherwise(F.col("label_p2")))
    # subtypes: necrosis by raw values against the median anchor, infiltration by its place above the anchor's anisotropy
    kind = F.when(F.col("t2star").isNotNull() & L.much_smaller(F.col("t2star"), F.col("raw_m_t2star")), "Necrosis (hemorrhagic)").when(F.col("mtr") > F.col("raw_m_mtr") + L.SMALLER, "Necrosis (proteic)").when(
        L.much_smaller(F.col("mtr"), F.col("raw_m_mtr")), "Necrosis (cystic)").otherwise(F.col("label_p2"))
    above = 1.0 - F.col("m_fa")
    grade = F.when(above > 0.05, F.when((u("fa") - F.col("m_fa")) / above < 0.5, "Infiltrative (edematous)").otherwise("Infiltrative (infiltrated)")).otherwise(F.col("label_p2"))
    final = F.when(F.contains("label_p2", F.lit("Necrosis")), kind).when(F.col("label_p2") == "Infiltrative", grade).otherwise(F.col("label_p2"))
    return p.select(*by, habitat, "label_p1", "label_p2", final.alias("label"), "anchor_median", "anchor_necrotic")


def marked(labels: DataFrame, habitat: str = "habitat") -> DataFrame:
    """``labels`` of :func:`three_passes` with " +" after that of the necrotic anchor; runs without an anchor have no mark."""
    return labels.withColumn("label", F.when(F.col(habitat) == F.col("anchor_necrotic"), F.concat("label", F.lit(" +"))).otherwise(F.col("label")))


def size_guarded(sizes: DataFrame, by: list[str], start: str, least_share: float = 0.05, floor: int = 2, protected: tuple[str, ...] = ("Necrosis", "Infiltrative")) -> DataFrame:
    """(by, k): from the solution ``start`` downwards the first whose small clusters are all protected by their label; ``floor`` at least.

    ``sizes`` (by, start, k, cluster, n, label) has every solution from the floor to the start; what follows " (" in a label doesn't count.
    """
    w = Window.partitionBy(*by, "k")
    small = (F.col("n") < least_share * F.sum("n").over(w)) & ~F.coalesce(F.trim(F.substring_index("label", " (", 1)).isin(*protected), F.lit(False)) if protected else F.col("n") < least_share * F.sum("n").over(w)
    bad = sizes.withColumn("small", small).groupBy(*by, "k").agg(F.max("small").alias("bad"), F.first(start).alias("s"))
    ok = (F.col("k") <= F.col("s")) & (~F.col("bad") | (F.col("k") <= floor))
    return bad.groupBy(*by).agg(F.max(F.when(ok, F.col("k"))).alias("k"))


def agreement(labels: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(truth, n, n_right, accuracy) of labels whose text begins with the true family."""
    j = labels.select(*keys, L.family(F.col("label")).alias("label")).join(truth.select(*keys, F.col("label").alias("truth")), keys)
    right = F.count_if(F.col("label") == F.col("truth"))
    return j.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), right.alias("n_right"), (right / F.count(F.lit(1))).alias("accuracy"))
