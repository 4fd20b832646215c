"""Which parameters an analysis uses, and covariates from texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Orders in which parameters are listed, and the reference picture is looked for.
LISTED = ("DTI-AD", "DTI-FA", "DTI-MD", "DTI-RD", "T2star", "MTR", "T2")
PRIORITY = ("DTI-MD", "DTI-AD", "DTI-RD", "DTI-FA", "T2", "T2star", "MTR")
PICTURE = ("MTR", "T2", "T2star", "DTI-FA", "DTI-AD", "DTI-RD", "DTI-MD")
NOT_PARAMETERS = ("X", "Y", "Slice", "Habitat", "Habitat_label", "d_topo_norm", "label_confidence", "label_ambiguous")


def only_parameters(columns: list[str]) -> list[str]:
    """The parameter columns of a result table: neither keys, labels nor posteriors."""
    return [c for c in columns if c not in NOT_PARAMETERS and not c.startswith("P_H")]


def place_in(param: Column, order: tuple[str, ...]) -> Column:
    """Position of a parameter in a fixed order, after all for others."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in order]), param), F.lit(0)), F.lit(len(order) + 1)).cast("int")


def common(found: DataFrame, by: list[str], source: str, order: tuple[str, ...]) -> DataFrame:
    """(by, param, place): parameters that every source of a group has, by a fixed order, then by name. ``found`` (by, source, param)."""
    total = found.groupBy(*by).agg(F.count_distinct(source).alias("total"))
    n = found.groupBy(*by, "param").agg(F.count_distinct(source).alias("n"))
    w = Window.partitionBy(*by).orderBy(place_in(F.col("param"), order), "param")  # a handful of parameters
    return n.join(total, by).where("n = total").select(*by, "param").withColumn("place", F.row_number().over(w))


def resolved(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, param, mode): mean diffusivity goes where axial and radial diffusivity are there. ``found`` (by, param)."""
    has = lambda p: F.max(F.col("param") == p)
    both = found.groupBy(*by).agg((has("DTI-AD") & has("DTI-RD")).alias("both"))
    kept = found.select(*by, "param").distinct().join(both, by).where(~(F.col("both") & (F.col("param") == "DTI-MD")))
    return kept.select(*by, "param", F.when(F.col("both"), "AD_RD").otherwise("MD").alias("mode"))


def picture(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, param): the first parameter of the fixed order that is there, else the least name."""
    return found.groupBy(*by).agg(F.min_by("param", F.struct(place_in(F.col("param"), PICTURE), "param")).alias("param"))


def zones(cells: DataFrame, core: list[int], label: str = "habitat") -> DataFrame:
    return cells.withColumn("zone", F.when(F.col(label).isin(*core), "core").otherwise("periphery"))


def covariates(rows: DataFrame, key: str) -> DataFrame:
    """(key, name, value) from texts ``rows`` (key, name, text): numbers, else days since the first date, else 0/1 per category.

    A column is of numbers (dates) if all its texts are, an empty one of a number column being NULL. The category that
    is seen first last is the reference; a column of one category goes.
    """
    date, empty = F.expr("try_to_date(text, 'yyyy-MM-dd')"), F.col("text") == ""
    number = F.expr("try_cast(text AS double)")
    kind = rows.groupBy("name").agg(F.every(empty | number.isNotNull()).alias("numbers"), F.every(date.isNotNull()).alias("dates"), F.min(date).alias("first"))
    j = rows.join(kind, "name")
    numbers = j.where("numbers").select(key, "name", number.alias("value"))
    dates = j.where("not numbers and dates").select(key, "name", F.datediff(date, F.col("first")).cast("double").alias("value"))
    texts = j.where("not numbers and not dates").select(key, "name", "text")
    seen = texts.where("text <> ''").groupBy("name", "text").agg(F.min(key).alias("at"))
    w = Window.partitionBy("name").orderBy(F.desc("at"))  # a row per category
    dummies = seen.withColumn("rn", F.row_number().over(w)).where("rn > 1").select("name", F.col("text").alias("category"))
    own = texts.join(dummies, "name").select(key, F.concat("name", F.lit("["), "category", F.lit("]")).alias("name"), F.when(F.col("text") == F.col("category"), 1.0).otherwise(0.0).alias("value"))
    return numbers.unionByName(dates).unionByName(own)
