"""Scans of long ROI tables and the cell tables made from them.

The canonical long table has one row per (subject, slice, x, y, param). Files
come one per subject and parameter; which parameter is told by the file name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .results import written

# Parameters in the order in which file names are searched.
PARAMETERS = ("DTI-AD", "DTI-FA", "DTI-MD", "DTI-RD", "T2star", "MTR", "T2")
# Folder names that say nothing about the subject.
GENERIC_FOLDERS = ("v2", "gmm", "kmeans", "srsc", "results", "output")

# The columns of an ROI table.
ROI_CSV = T.StructType([
    T.StructField("Roi_ID", T.IntegerType()), T.StructField("Roi_Name", T.StringType()), T.StructField("Slice", T.IntegerType()),
    T.StructField("X", T.IntegerType()), T.StructField("Y", T.IntegerType()), T.StructField("Value", T.DoubleType()),
])
CELL = ("subject", "slice", "x", "y")


def param_of(file_name: Column) -> Column:
    """First parameter that occurs in a file name, else its stem."""
    found = [F.when(F.contains(file_name, F.lit(p)), F.lit(p)) for p in PARAMETERS]
    return F.coalesce(*found, F.regexp_replace(file_name, r"\.[^.]*$", ""))


def subject_of(path: Column) -> Column:
    """Parent folder of a file, or the grandparent if the parent is generic."""
    parts = F.split(path, "/")
    parent = F.element_at(parts, -2)
    return F.when(F.lower(parent).isin(*GENERIC_FOLDERS), F.element_at(parts, -3)).otherwise(parent)


def read_roi_csv(spark: SparkSession, path: str) -> DataFrame:
    """root/<subject>/*.csv as the canonical long table with the ROI's name; NaN becomes NULL."""
    raw = spark.read.schema(ROI_CSV).option("header", True).csv(path)
    file = F.col("_metadata.file_path")
    return raw.select(
        subject_of(file).alias("subject"), param_of(F.element_at(F.split(file, "/"), -1)).alias("param"), F.col("Roi_Name").alias("roi"),
        F.col("Slice").alias("slice"), F.col("X").alias("x"), F.col("Y").alias("y"), F.nanvl("Value", F.lit(None).cast("double")).alias("value"),
    )


def pivot_cells(long: DataFrame, params: list[str], anchor: str, roi: str = "ALL") -> DataFrame:
    """Wide cells of an ROI: the cells of the anchor parameter, other parameters NULL where missing.

    One grouping instead of a chain of joins; of repeated cells the least value is taken.
    """
    cells = long.where(F.col("roi") == roi).groupBy(*CELL)
    wide = cells.agg(*[F.min(F.when(F.col("param") == p, F.col("value"))).alias(p) for p in params], F.max(F.col("param") == anchor).alias("_there"))
    return wide.where("_there").drop("_there")


# The driver's tables as cells: see the README. lineitem repeats cells, so they are averaged.
MODALITIES = {"T2": "l_quantity", "DTI-MD": "l_extendedprice", "T2star": "l_discount", "MTR": "l_tax"}


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as cells: keys, four parameters, ROI flag, given habitat and truth."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = [(F.col("l_suppkey") % 10).alias("subject"), F.col("l_linenumber").alias("slice"), (F.col("l_orderkey") % 128).alias("x"), (F.col("l_partkey") % 128).alias("y")]
    flag = F.min("l_returnflag")
    return li.groupBy(*keys).agg(
        F.avg("l_quantity").alias("T2"), (F.avg("l_extendedprice") / 1000).alias("DTI-MD"), F.avg("l_discount").alias("T2star"), F.avg("l_tax").alias("MTR"),
        F.when(F.min("l_linestatus") == "O", "ALL").otherwise("CL").alias("roi"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("habitat"), F.min(F.year("l_shipdate")).alias("truth"),
    )


def long_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells, one row per parameter. They are grouped and written once, as most readers pass over them several times."""
    return melt(written(cells(spark, sf_dir), "cells"), list(MODALITIES))


def melt(wide: DataFrame, params: list[str]) -> DataFrame:
    keep = [c for c in wide.columns if c not in params]
    pairs = F.array(*[F.struct(F.lit(p).alias("param"), F.col(f"`{p}`").alias("value")) for p in params])
    return wide.select(*keep, F.inline(pairs))


SQL = """cells AS (SELECT l_suppkey % 10 AS subject, l_linenumber AS slice, l_orderkey % 128 AS x, l_partkey % 128 AS y,
 avg(l_quantity) AS t2, avg(l_extendedprice) / 1000 AS md, avg(l_discount) AS t2star, avg(l_tax) AS mtr,
 CASE WHEN min(l_linestatus) = 'O' THEN 'ALL' ELSE 'CL' END AS roi,
 CASE min(l_returnflag) WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS habitat, min(year(l_shipdate)) AS truth
 FROM lineitem GROUP BY 1, 2, 3, 4),
long AS (SELECT subject, slice, x, y, roi, habitat, truth, unnest(['T2', 'DTI-MD', 'T2star', 'MTR']) AS param, unnest([t2, md, t2star, mtr]) AS value FROM cells)"""
