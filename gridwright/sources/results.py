"""Stored results of analyses: writers, and readers that start a later analysis from them.

A run's folder holds ``cells`` (CSV by subject), ``meta``, ``centroids`` and ``labels`` (JSON lines, one object per
subject) and small CSV tables. Every writer is a Spark job, so a folder may hold any number of subjects.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = "subject long, scaling_info map<string, struct<median: double, iqr: double>>, cl_stats map<string, struct<median: double, std: double, mean: double, n: long>>"


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; without that setting only a local session has one."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="gridwright-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once into the shared folder and read back; a lost executor repeats only what comes after."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def habitat_name(habitat: Column, names: Column | None = None) -> Column:
    plain = F.concat(F.lit("Habitat "), habitat.cast("string"))
    return plain if names is None else F.coalesce(names, plain)


def write_cells(cells: DataFrame, params: list[str], path: str, posteriors: str | None = None) -> None:
    """X, Y, Slice, the parameters, Habitat, Habitat_label and, from an array of ``posteriors``, P_H0, P_H1, ...

    One folder per subject, and the names of the columns in a text file beside them, which tell what a run without
    cells would have held. ``cells`` (subject, slice, x, y, habitat, label or NULL, parameters...).
    """
    cols = [F.col("x").alias("X"), F.col("y").alias("Y"), F.col("slice").alias("Slice"), *[F.col(f"`{p}`") for p in params],
            F.col("habitat").alias("Habitat"), habitat_name(F.col("habitat"), F.col("label")).alias("Habitat_label")]
    if posteriors:
        k = cells.agg(F.max(F.size(posteriors))).first()[0] or 0
        cols += [F.get(posteriors, F.lit(i)).alias(f"P_H{i}") for i in range(k)]
    out = cells.select("subject", *cols)
    out.write.partitionBy("subject").option("header", True).csv(path)
    cells.sparkSession.createDataFrame([(c,) for c in out.columns if c != "subject"], "name string").coalesce(1).write.text(f"{path}-columns")


def raw_cells(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """What :func:`write_cells` left below ``path``, as text."""
    reader = spark.read.options(header="true", **options)
    try:
        return reader.csv(path)
    except AnalysisException as error:  # a run without cells has no folder of a subject
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
    names = [r[0] for r in spark.read.text(f"{path}-columns").collect()]  # a row a column
    return reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in [*names, "subject"]])).csv(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all subjects below ``path``, with columns typed by name: keys, labels, and else parameters or posteriors."""
    from ..operators.params import only_parameters

    raw = raw_cells(spark, path)
    numbers = {*only_parameters(raw.columns), "d_topo_norm"} | {c for c in raw.columns if c.startswith("P_H")}
    kind = {"X": "int", "Y": "int", "Slice": "int", "Habitat": "int", "label_ambiguous": "boolean", "subject": "long"}
    return raw.select(*[F.col(f"`{c}`").cast(kind.get(c, "double" if c in numbers else "string")).alias(c) for c in raw.columns])


def posterior_columns(columns: list[str]) -> list[str]:
    return sorted((c for c in columns if c.startswith("P_H") and c[3:].isdigit()), key=lambda c: int(c[3:]))


def middle_slice(cells: DataFrame) -> DataFrame:
    """(subject, slice, n_slices): the slice in the middle of those that are there."""
    found = cells.groupBy("subject").agg(F.sort_array(F.collect_set("Slice")).alias("s"))  # bounded by the scanner's slices
    return found.select("subject", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("slice"), F.size("s").alias("n_slices"))


def write_meta(scaling_info: DataFrame, reference: DataFrame, path: str) -> None:
    """One JSON object per subject from (subject, param, median, iqr) and (subject, param, median, sd, mean, n)."""
    pack = lambda df, name, fields: df.groupBy("subject").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("param", F.struct(*fields).alias("v"))))).alias(name))
    a = pack(scaling_info, "scaling_info", [F.col("median"), F.col("iqr")])
    b = pack(reference, "cl_stats", [F.col("median"), F.col("sd").alias("std"), F.col("mean"), F.col("n")])
    a.join(b, "subject", "full").write.json(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(subject, param, median, iqr, ref_median, ref_std, ref_mean, ref_n); an object that does not parse gives no row."""
    raw = spark.read.schema(META).option("mode", "DROPMALFORMED").json(path).where("subject is not null")
    rows = raw.select("subject", "cl_stats", F.explode("scaling_info").alias("param", "s"))
    c = F.element_at("cl_stats", F.col("param"))
    return rows.select("subject", "param", "s.median", "s.iqr", c["median"].alias("ref_median"), c["std"].alias("ref_std"), c["mean"].alias("ref_mean"), c["n"].alias("ref_n"))


def write_centroids(means: DataFrame, path: str) -> None:
    """One JSON object per subject: {cluster: {param: value}}. ``means`` (subject, habitat, param, mean)."""
    one = means.groupBy("subject", "habitat").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("param", "mean")))).alias("c"))
    all_ = one.groupBy("subject").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("habitat").cast("string"), F.to_json("c").alias("c"))))).alias("centroids"))
    all_.write.json(path)


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("subject long, centroids map<string, string>").json(path)
    rows = raw.select("subject", F.explode("centroids").alias("habitat", "c"))
    rows = rows.select("subject", F.col("habitat").cast("int").alias("habitat"), F.from_json("c", "map<string, double>").alias("c"))
    return rows.select("subject", "habitat", F.explode("c").alias("param", "mean"))


def stored_or_computed(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """(subject, habitat, param, mean, origin): the stored means of subjects with at least as many clusters stored as computed, else the computed ones."""
    n = lambda df, name: df.groupBy("subject").agg(F.count_distinct("habitat").alias(name))
    use = n(computed, "c").join(n(stored, "s"), "subject", "full").select("subject", (F.coalesce("s", F.lit(0)) >= F.coalesce("c", F.lit(0))).alias("use_stored"))
    pick = lambda df, flag, origin: df.join(use.where(flag), "subject", "left_semi").select("subject", "habitat", "param", "mean", F.lit(origin).alias("origin"))
    return pick(stored, "use_stored", "stored").unionByName(pick(computed, "not use_stored", "computed"))


def write_table(df: DataFrame, path: str) -> DataFrame:
    """A small result table as CSV, read back with the same types."""
    df.write.option("header", True).csv(path)
    return df.sparkSession.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).option("header", True).csv(path)


def mask(cells: DataFrame, nx: int, ny: int, nz: int) -> tuple[DataFrame, DataFrame]:
    """(sparse mask (subject, i, j, k, value), cells out of bounds per subject): places from 0, value = habitat + 1 as a short."""
    at = cells.select("subject", (F.col("x") - 1).alias("i"), (F.col("y") - 1).alias("j"), (F.col("slice") - 1).alias("k"), (F.col("habitat") + 1).cast("short").alias("value"))
    inside = F.expr(f"i between 0 and {nx - 1} and j between 0 and {ny - 1} and k between 0 and {nz - 1}")
    return at.where(inside), at.groupBy("subject").agg(F.count_if(~inside).alias("n_out"), F.count_if(inside).alias("n_in"))


def members(cells: DataFrame, assigned: DataFrame, meta: int, params: list[str]) -> DataFrame:
    """Cells of the (subject, habitat) of one meta-habitat, with missing parameters and NULL values 0. ``assigned`` (subject, habitat, meta)."""
    there = [p for p in params if p in cells.columns]
    zero = cells.withColumns({p: F.lit(0.0) for p in params if p not in there}).na.fill(0.0, there)
    return zero.join(assigned.where(F.col("meta") == meta).select("subject", "habitat"), ["subject", "habitat"], "left_semi")


ATLAS = "version int, component int, weight double, mean array<double>, cov array<double>, params array<string>, scale array<struct<center: double, spread: double>>"


def write_atlas(spark: SparkSession, model, params: list[str], path: str, scale: dict[str, tuple[float, float]] | None = None) -> int:
    """Appends a frozen mixture to the table at ``path`` and returns its version, one above the last. One writer at a time.

    ``scale``: (centre, spread) per parameter, for cells that aren't scaled by their own subject.
    """
    try:
        last = spark.read.schema(ATLAS).parquet(path).agg(F.max("version")).first()[0] or 0
    except AnalysisException:  # no table yet
        last = 0
    pairs = [scale[p] for p in params] if scale else None
    rows = [(last + 1, i, float(w), m.tolist(), c.ravel().tolist(), params, pairs) for i, (w, m, c) in enumerate(zip(model.weights, model.means, model.covs, strict=True))]
    spark.createDataFrame(rows, ATLAS).coalesce(1).write.mode("append").parquet(path)
    return last + 1


def read_atlas(spark: SparkSession, path: str, version: int | None = None):
    """(mixture, params, scale) of a version, the last if none is named."""
    from ..operators.mixture import Mixture

    table = spark.read.schema(ATLAS).parquet(path)
    rows = (table.where(F.col("version") == version) if version is not None else table.join(F.broadcast(table.agg(F.max("version").alias("version"))), "version")).orderBy("component").collect()  # a row a component
    if not rows:
        raise ValueError(f"no atlas of version {version} at {path}")
    means = np.array([r["mean"] for r in rows])
    model = Mixture(np.array([r["weight"] for r in rows]), means, np.array([r["cov"] for r in rows]).reshape(len(rows), means.shape[1], means.shape[1]))
    scale = rows[0]["scale"] and {p: (x["center"], x["spread"]) for p, x in zip(rows[0]["params"], rows[0]["scale"], strict=True)}
    return model, list(rows[0]["params"]), scale
