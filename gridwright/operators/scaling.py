"""Scalings of the long cell table (subject, param, value, ...).

Each scheme is a centre and a spread per group from exact quantiles, joined
back; the statistics have a row per (subject, param) at most and are broadcast
after a count, with the rows of a group dealt by salt where they are too many.
Two policies for a spread of 0 exist: ``zero`` makes
the column 0, ``floor`` divides by 1e-8; each scheme has that of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.results import written
from .quantiles import BROADCAST_ROWS, median_iqr, quantiles, summary_median

FLOOR = 1e-8
#: Parts into which a group's rows are dealt where its statistics can't be broadcast.
SALTS = 16


def floored(spread: Column) -> Column:
    return F.greatest(spread, F.lit(FLOOR))


def apply_scale(long: DataFrame, stats: DataFrame, by: list[str], zero_policy: str = "floor") -> DataFrame:
    """Adds ``scaled`` from ``stats`` (by, center, spread); NULL values stay NULL."""
    diff = F.col("value") - F.col("center")
    scaled = F.when(F.col("spread") == 0, F.when(diff.isNotNull(), 0.0)).otherwise(diff / F.col("spread")) if zero_policy == "zero" else diff / floored(F.col("spread"))
    return with_stats(long, stats.select(*by, "center", "spread"), by).withColumn("scaled", scaled).drop("center", "spread")


def with_stats(rows: DataFrame, stats: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``stats``, one row a group. A group may hold any share of the rows, so they are never shuffled by group alone."""
    stats = written(stats, "scaling-stats")
    if stats.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(stats), by, how)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(stats.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))), [*by, "_salt"], how).drop("_salt")


def tumour(long: DataFrame) -> DataFrame:
    return long.where("roi = 'ALL'")


def reference(long: DataFrame) -> DataFrame:
    return long.where("roi = 'CL'")


def reference_stats(long: DataFrame) -> DataFrame:
    """Mean, sample deviation (floored; 1 for a single value), median and count of the reference tissue."""
    by = ["subject", "param"]
    ref = reference(long).where("value is not null")
    moments = ref.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
    med = quantiles(ref, by, "value", {"median": 0.5}).drop("n")
    return moments.join(med, by).withColumn("sd", F.when(F.col("n") == 1, 1.0).otherwise(floored(F.col("sd"))))


def reference_median_iqr(long: DataFrame, params: list[str]) -> DataFrame:
    """Median, IQR (floored) and count per subject and listed parameter; without data 0, 1 and 0."""
    want = long.select("subject").distinct().select("subject", F.explode(F.array(*[F.lit(p) for p in params])).alias("param"))
    got = median_iqr(reference(long), ["subject", "param"])
    return want.join(got, ["subject", "param"], "left").select(
        "subject", "param", F.coalesce("median", F.lit(0.0)).alias("median"), F.when(F.col("n").isNull(), 1.0).otherwise(floored(F.col("iqr"))).alias("iqr"), F.coalesce("n", F.lit(0)).alias("n"))


def percentile_stats(long: DataFrame, p: float = 0.10) -> DataFrame:
    """A percentile over all ROIs per subject and parameter."""
    return quantiles(long, ["subject", "param"], "value", {"p": p})


def robust(long: DataFrame, zero_policy: str = "zero") -> DataFrame:
    """(x - median) / IQR on tumour cells per subject."""
    t = tumour(long)
    s = median_iqr(t, ["subject", "param"])
    return apply_scale(t, s.withColumnsRenamed({"median": "center", "iqr": "spread"}), ["subject", "param"], zero_policy)


def hybrid(long: DataFrame, p: float = 0.10) -> DataFrame:
    """(x - low percentile of all ROIs) / tumour IQR."""
    t = tumour(long)
    s = percentile_stats(long, p).select("subject", "param", F.col("p").alias("center")).join(median_iqr(t, ["subject", "param"]), ["subject", "param"])
    return apply_scale(t, s.withColumnRenamed("iqr", "spread"), ["subject", "param"], "zero")


def against_reference(long: DataFrame, params: list[str], spread_of: str = "reference") -> DataFrame:
    """(x - reference median) / IQR of the reference, of the tumour, or 1 (``center``)."""
    t, by = tumour(long), ["subject", "param"]
    s = reference_median_iqr(long, params).withColumnsRenamed({"median": "center", "iqr": "spread"})
    if spread_of == "tumour":
        s = s.drop("spread").join(median_iqr(t, by).select(*by, F.col("iqr").alias("spread")), by)
    elif spread_of == "center":
        s = s.withColumn("spread", F.lit(1.0))
    return apply_scale(t, s, by)


def grand_medians(long: DataFrame) -> DataFrame:
    """(param, grand): the median over subjects of their medians."""
    per = median_iqr(tumour(long), ["subject", "param"])
    return summary_median(per, ["param"], "median", "grand")


def recalibrated(long: DataFrame) -> DataFrame:
    """(x - grand median) / own IQR."""
    t, by = tumour(long), ["subject", "param"]
    per = written(median_iqr(t, by), "scaling-medians")
    s = per.join(summary_median(per, ["param"], "median", "grand"), "param").withColumnsRenamed({"grand": "center", "iqr": "spread"})
    return apply_scale(t, s, by)


def pooled(long: DataFrame) -> DataFrame:
    """One median and IQR over all subjects; an IQR of 0 counts as 1."""
    t = tumour(long)
    s = median_iqr(t, ["param"]).select("param", F.col("median").alias("center"), F.when(F.col("iqr") == 0, 1.0).otherwise(F.col("iqr")).alias("spread"))
    return apply_scale(t, s, ["param"])


def cohort(long: DataFrame) -> DataFrame:
    """Centred by the grand median, divided by the pooled IQR of the centred values; NULL to 0."""
    centred = with_stats(tumour(long), grand_medians(long), ["param"]).withColumn("value", F.col("value") - F.col("grand")).drop("grand")
    s = median_iqr(centred, ["param"]).select("param", F.lit(0.0).alias("center"), F.col("iqr").alias("spread"))
    return apply_scale(centred, s, ["param"]).withColumn("scaled", F.coalesce("scaled", F.lit(0.0)))


def reference_pooled(long: DataFrame, params: list[str]) -> DataFrame:
    """Centred by the subject's reference median, divided by the pooled IQR; NULL to 0."""
    centred = against_reference(long, params, "center").drop("value").withColumnRenamed("scaled", "value")
    s = median_iqr(centred, ["param"]).select("param", F.lit(0.0).alias("center"), F.col("iqr").alias("spread"))
    return apply_scale(centred, s, ["param"]).withColumn("scaled", F.coalesce("scaled", F.lit(0.0)))


def consistency(scaled: DataFrame) -> DataFrame:
    """(param, spread, severity): population deviation over subjects of their means."""
    means = scaled.groupBy("param", "subject").agg(F.avg("scaled").alias("m"))
    s = means.groupBy("param").agg(F.stddev_pop("m").alias("spread"))
    return s.withColumn("severity", F.when(F.col("spread") < 0.25, "ok").when(F.col("spread") < 0.50, "caution").otherwise("warning"))


def feature_choice(long: DataFrame, by: list[str], ratio: float = 0.10, least: int = 2) -> DataFrame:
    """Parameters with a population variance of at least ``ratio`` of the largest, or among the ``least`` largest."""
    from pyspark.sql import Window

    v = long.groupBy(*by, "param").agg(F.var_pop("value").alias("variance"))
    w = Window.partitionBy(*by)
    v = v.withColumn("rank", F.row_number().over(w.orderBy(F.desc("variance"), "param"))).withColumn("top", F.max("variance").over(w))
    return v.where((F.col("variance") >= ratio * F.col("top")) | (F.col("rank") <= least)).drop("top")
