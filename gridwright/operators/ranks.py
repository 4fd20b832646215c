"""Rank tests and rank correlation of small summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds ``rank``: ties share their mean rank."""
    w = Window.partitionBy(*by)
    return rows.withColumn("rank", F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2)


def mann_whitney(rows: DataFrame, by: list[str], value: str, group: str, first) -> DataFrame:
    """U statistic of the group ``first`` against all others, per ``by``, with medians left to :mod:`quantiles`."""
    r = average_ranks(rows, by, value)
    is_first = F.col(group) == F.lit(first)
    n1 = F.count_if(is_first)
    return r.groupBy(*by).agg((F.sum(F.when(is_first, F.col("rank"))) - n1 * (n1 + 1) / 2).alias("u"), n1.alias("n1"), (F.count(F.lit(1)) - n1).alias("n2"))


def kruskal_wallis(rows: DataFrame, by: list[str], value: str, group: str) -> DataFrame:
    """H statistic, corrected for ties."""
    r = average_ranks(rows, by, value)
    n = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    g = r.groupBy(*by, group).agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("c")).groupBy(*by).agg(F.sum(F.col("s") ** 2 / F.col("c")).alias("q"))
    ties = r.groupBy(*by, value).agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    h = (12.0 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)) / (1 - F.col("ties") / (F.col("n") ** 3 - F.col("n")))
    return n.join(g, by).join(ties, by).select(*by, h.alias("h"))


def spearman(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    ra = average_ranks(rows, by, a).withColumnRenamed("rank", "ra")
    both = average_ranks(ra, by, b)
    return both.groupBy(*by).agg(F.corr("ra", "rank").alias("rho"))
