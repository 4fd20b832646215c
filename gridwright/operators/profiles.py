"""Aggregates per habitat and subject: profiles, shares, spreads, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shares(cells: DataFrame, by: list[str], label: str = "habitat") -> DataFrame:
    """Count and share of each label within ``by``."""
    n = cells.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def centroids(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean of a value per group and parameter."""
    return long.groupBy(*by, "param").agg(F.avg(value).alias("mean"))


def eta_squared(long: DataFrame, by: list[str], label: str = "habitat") -> DataFrame:
    """Between-label share of the sum of squares per parameter, from sums alone; NULL counts as 0."""
    v = F.coalesce("value", F.lit(0.0))
    part = long.groupBy(*by, "param", label).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s"))
    w = Window.partitionBy(*by, "param")
    part = part.withColumn("g", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    out = part.groupBy(*by, "param").agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("between"), F.sum(F.col("n") * F.col("s")).alias("within"))
    total = F.col("between") + F.col("within")
    return out.select(*by, "param", F.when(total < 1e-12, 0.0).otherwise(F.col("between") / total).alias("eta2"))


def modes(cells: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value; the smallest of ties. Counts are pre-aggregated per value."""
    n = cells.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def composition_spread(cells: DataFrame, label: str = "habitat") -> DataFrame:
    """Mean share per label over subjects and its coefficient of variation (sample deviation)."""
    s = shares(cells, ["subject"], label)
    return s.groupBy(label).agg(F.avg("share").alias("mean_share"), (F.stddev_samp("share") / F.avg("share")).alias("cv"), F.count(F.lit(1)).alias("n_subjects"))


def presence(cells: DataFrame, label: str = "habitat", least: int = 1) -> DataFrame:
    """Subjects in which a label has at least ``least`` cells, the rate, and a rank by rate."""
    n = cells.groupBy("subject", label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    total = cells.select("subject").distinct().agg(F.count(F.lit(1)).alias("total"))
    out = n.groupBy(label).agg(F.count(F.lit(1)).alias("n_subjects"), F.sum("n").alias("n_cells")).join(F.broadcast(total))  # one row
    out = out.withColumn("rate", F.col("n_subjects") / F.col("total")).drop("total")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rate"), label)))  # a row per label


def presence_matrix(cells: DataFrame, labels: list, label: str = "habitat") -> DataFrame:
    """Share of each label per subject as columns ``l_<label>``, 0 where absent."""
    s = shares(cells, ["subject"], label)
    return s.groupBy("subject").agg(*[F.coalesce(F.max(F.when(F.col(label) == x, F.col("share"))), F.lit(0.0)).alias(f"l_{x}") for x in labels])


def contingency(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of (a, b) with shares of the row and of the column."""
    n = cells.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumns({"row_share": F.col("n") / F.sum("n").over(Window.partitionBy(a)), "column_share": F.col("n") / F.sum("n").over(Window.partitionBy(b))})


def deviation(long: DataFrame, label: str = "habitat") -> DataFrame:
    """Per subject and label: Euclidean distance of its means from the overall means."""
    own = centroids(long, ["subject", label])
    overall = centroids(long, [label]).withColumnRenamed("mean", "overall")
    return own.join(overall, [label, "param"]).groupBy("subject", label).agg(F.sqrt(F.sum((F.col("mean") - F.col("overall")) ** 2)).alias("deviation"))


def log_inertia(long: DataFrame, label: str = "habitat") -> DataFrame:
    """log of the squared distances to the label's mean; labels with fewer than two rows left out."""
    s = long.groupBy(label, "param").agg(F.var_pop("value").alias("v"), F.count("value").alias("n")).where("n >= 2")
    return s.agg(F.ln(F.sum(F.col("v") * F.col("n")) + 1e-10).alias("log_inertia"))


def cohens_d(long: DataFrame, label: str = "habitat") -> DataFrame:
    """Difference of a label's mean from the rest, in pooled deviations (root of the mean variance), per parameter."""
    sums = long.where("value is not null").groupBy(label, "param").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    w = Window.partitionBy("param")
    out = sums.withColumns({"n2": F.sum("n").over(w) - F.col("n"), "s2": F.sum("s").over(w) - F.col("s"), "q2": F.sum("q").over(w) - F.col("q")})

    def variance(n: str, s: str, q: str):
        return (F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1)

    d = (F.col("s") / F.col("n") - F.col("s2") / F.col("n2")) / F.sqrt((variance("n", "s", "q") + variance("n2", "s2", "q2")) / 2 + 1e-10)
    return out.select(label, "param", F.when((F.col("n") < 2) | (F.col("n2") < 2), 0.0).otherwise(d).alias("cohens_d"))


def balanced_weights(cells: DataFrame) -> DataFrame:
    """1 / cells of the subject, normalised to a total of 1: a weight per subject's cell."""
    n = cells.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("weight", 1 / F.col("n") / F.count(F.lit(1)).over(Window.partitionBy()))  # a row per subject


def minmax_columns(means: DataFrame, by: list[str]) -> DataFrame:
    """Means to 0..1 over the labels of ``by``; 0.5 where they are all alike."""
    w = Window.partitionBy(*by, "param")
    lo, hi = F.min("mean").over(w), F.max("mean").over(w)
    return means.withColumn("unit", F.when(hi - lo <= 1e-8, 0.5).otherwise((F.col("mean") - lo) / (hi - lo)))


def zscore_columns(means: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by, "param")
    sd = F.stddev_pop("mean").over(w)
    return means.withColumn("z", F.when(sd < 1e-12, 0.0).otherwise((F.col("mean") - F.avg("mean").over(w)) / sd))


def spread(rows: DataFrame, place: str, value: str, k: int, by: str = "subject") -> DataFrame:
    """(by, value): the values of places 0 to k - 1 as an array, 0 where there is none."""
    return rows.groupBy(by).agg(F.array(*[F.coalesce(F.max(F.when(F.col(place) == i, F.col(value))), F.lit(0.0)) for i in range(k)]).alias(value))
