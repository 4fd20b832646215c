"""Exact quantiles of groups of any size.

A group may hold a third of all rows, so its values are never gathered. An
approximate pass brackets each quantile (partial aggregates, a digest a group
and task); brackets that still hold many rows are narrowed again. The brackets
are a small table, which is broadcast to the rows after a count; the rows are
counted per distinct value where they are, so that only values inside a bracket
and their counts are exchanged, dealt by value. The running count over those
gives the exact order statistics, interpolated linearly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.results import written

#: The approximate pass is exact to 1 / ACCURACY of a group's rows.
ACCURACY = 1000
#: Groups up to this size are counted whole; in larger ones a bracket has room for dozens of ranks.
SMALL = 20 * ACCURACY
#: Rows of a group that its brackets may hold; more are narrowed, to about 3 / CELLS a pass.
INSIDE, CELLS = 2_000_000, 64
#: Rows of a table that may be broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` (written), marked for broadcast if a count proves it small."""
    return F.broadcast(table) if table.count() <= rows else table


def quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group: a column for each named quantile, and ``n``, the values counted.

    NULL and NaN values are left out; groups without any other value have no row.
    ``df`` is read twice and should be cheap to read.
    """
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    names, eps = list(probs), 2.0 / ACCURACY
    cuts = F.array(*[F.lit(min(1.0, max(0.0, p + side * eps))) for p in probs.values() for side in (-1, 1)])
    marks = rows.groupBy(*by).agg(F.percentile_approx("v", cuts, F.lit(ACCURACY)).alias("cut"), F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    whole = F.col("n") <= SMALL
    bracket = F.array(*[
        F.struct(F.when(whole | F.lit(p <= eps), F.col("least")).otherwise(F.col("cut")[2 * i]).alias("lo"), F.when(whole | F.lit(p >= 1 - eps), F.col("most")).otherwise(F.col("cut")[2 * i + 1]).alias("hi"))
        for i, p in enumerate(probs.values())
    ])
    marks = written(marks.select(*by, "n", bracket.alias("at")), "quantile-marks")
    share = 2 * eps * len(names)
    while (marks.agg(F.max("n")).first()[0] or 0) * share > INSIDE:
        marks, share = written(_narrowed(rows, marks, by, list(probs.values())), "quantile-marks"), share * 3 / CELLS
    # each distinct value in a bracket is counted; the values between two brackets are counted together
    inside = F.exists("at", lambda a: (F.col("v") >= a["lo"]) & (F.col("v") <= a["hi"]))
    gap = F.aggregate("at", F.lit(0), lambda s, a: s + (a["hi"] < F.col("v")).cast("int"))
    placed = rows.join(small(marks), by).select(*by, "n", "v", gap.alias("gap"), F.when(inside, F.col("v")).alias("own"))
    counted = placed.groupBy(*by, "n", "gap", "own").agg(F.count(F.lit(1)).alias("c"), F.max("v").alias("v"))
    upto = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ends = counted.withColumn("end", F.sum("c").over(upto))

    def at(p: float):
        h = (F.first("n") - 1) * F.lit(p)
        rank = (F.col("n") - 1) * F.lit(p)
        low, high = (F.min(F.when(F.col("end") > f(rank), F.col("v"))) for f in (F.floor, F.ceil))
        return low + (high - low) * (h - F.floor(h))

    return ends.groupBy(*by).agg(F.first("n").alias("n"), *[at(p).alias(name) for name, p in probs.items()]).select(*by, "n", *names)


def _narrowed(rows: DataFrame, marks: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """The same table with brackets cut down to the cells of a finer approximate pass in which their ranks can lie."""
    grid = F.array(*[F.lit(i / CELLS) for i in range(CELLS + 1)])
    per = []
    for i in range(len(probs)):
        inside = (F.col("v") >= F.col("at")[i]["lo"]) & (F.col("v") <= F.col("at")[i]["hi"])
        per.append(F.struct(F.count_if(F.col("v") < F.col("at")[i]["lo"]).alias("below"), F.count_if(inside).alias("c"), F.percentile_approx(F.when(inside, F.col("v")), grid, F.lit(ACCURACY)).alias("cut")).alias(f"q{i}"))
    seen = rows.join(small(marks), by).groupBy(*by, "n").agg(F.first("at").alias("at"), *per)

    def cell(i: int, p: float):
        """From one cell below that of the lower rank to one above that of the upper one."""
        q, at = F.col(f"q{i}"), F.col("at")[i]
        place = lambda f: F.floor((f((F.col("n") - 1) * F.lit(p)) - q["below"]) / q["c"] * CELLS).cast("int")
        lo, hi = place(F.floor) - 1, place(F.ceil) + 2
        return F.struct(F.when(lo < 1, at["lo"]).otherwise(F.get(q["cut"], lo)).alias("lo"), F.when(hi >= CELLS, at["hi"]).otherwise(F.get(q["cut"], hi)).alias("hi"))

    return seen.select(*by, "n", F.array(*[cell(i, p) for i, p in enumerate(probs)]).alias("at"))


def median_iqr(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, n, median, iqr)."""
    q = quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.select(*by, "n", "median", (F.col("q3") - F.col("q1")).alias("iqr"))


def summary_median(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Median over a summary table, which has a few rows per group (one per subject)."""
    return df.groupBy(*by).agg(F.median(value).alias(name))
