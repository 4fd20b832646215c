"""Helpers that several operators of this subpackage share.

Nothing here brings rows to the driver: intermediate tables are written as
Parquet below the cluster's shared checkpoint folder, which also cuts lineage
so that a lost executor repeats only the step it was in.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes at most in one Arrow batch handed to Python.
BATCH_ROWS, BATCH_BYTES = 1024, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, from ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one; on a cluster that would be the driver's own disk.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridwright-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def spent(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` whose last reader is done; rows that are still to be computed must not read them."""
    for t in tables:
        discard(t.sparkSession, t.written_to)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no later step reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Give memory that a finished task left in this Python worker's pools back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, with :func:`release` at its end, since idle workers live on beside those of the next stage."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def whole_rows(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns, and all columns as ``row``, so that no name can clash."""
    return df.select(*cols, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker, from here on in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def seeded_uniform(seed: int, *cols: Column | str) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12)
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def ranked(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Adds ``rank``, gapless from 0 within each value of ``by``.

    ``by`` must have a bounded number of values (shards, lengths). A value may
    hold any share of the rows: its rows are dealt by hash into about
    sqrt(count) blocks, numbered inside their block, and shifted by the counts
    of the blocks before, so that no task sees more than a block.
    ``df`` is read twice and should be a written table.
    """
    n = df.groupBy(by).agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_blocks"))
    d = df.join(F.broadcast(n), by).withColumn(
        "_block", F.pmod(F.xxhash64(*order), F.col("_blocks"))
    ).drop("_blocks")
    counts = d.groupBy(by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = materialize(
        counts.select(by, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")), f"{name}-shift"
    )
    inside = Window.partitionBy(by, "_block").orderBy(*order)
    numbered = d.withColumn("_row", F.row_number().over(inside) - 1)
    return numbered.join(shift, [by, "_block"]).withColumn("rank", (F.col("_row") + F.col("_shift")).cast("long")).drop("_block", "_row", "_shift")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): (id, component).

    ``component`` is the smallest id of the component; only ids that occur in
    an edge with two different ends are returned. Alternating large-star and
    small-star rounds (Kiveris et al., 2014); each round's table is written,
    and minima are pre-aggregated before the shuffle, so hubs do no harm.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    now = materialize(edges.where("a <> b").select(hi.alias("u"), lo.alias("v")).distinct(), name)

    def unfinished(df: DataFrame) -> bool:
        """Whether a node has two parents, or has one and is one: else every tree is a star."""
        ends = df.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("below")), F.struct(F.col("v").alias("id"), F.lit(0).alias("below")))))
        seen = ends.groupBy("id").agg(F.sum("below").alias("below"), F.min("below").alias("root"))
        return bool(seen.where("below > 1 or below = 1 and root = 0").head(1))

    while unfinished(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), name)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), name)
        spent(now, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        spent(large, least)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


#: Ids are broadcast up to this many; beyond, the tables are shuffled. A broadcast is on the driver's heap several times: as rows, as a hash table and in blocks.
BROADCAST_IDS = 200_000


def checked(ids: DataFrame, rows: int = BROADCAST_IDS, arrays: str | None = None) -> DataFrame:
    """``ids``, marked for broadcast if a count proves it small. Should be a written table.

    ``arrays``: a column of arrays whose elements are counted in the place of rows.
    """
    n = ids.count() if arrays is None else ids.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size(arrays)), F.lit(0))).first()[0]
    return F.broadcast(ids) if n <= rows else ids


#: Rows of a key that one task takes where its partner can't be broadcast.
KEY_ROWS = 50_000


def salted(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (written; at most one row a key). A key may hold any share of ``big``.

    ``small`` is broadcast if a count proves it small. Else the rows of a key that has more than ``KEY_ROWS`` in ``big``
    are dealt by hash, and only such a key's row of ``small`` is repeated, so that no task gets a whole hot key and the
    other rows are shuffled once. There is at most one such key in ``KEY_ROWS`` rows; ``big`` is read twice.
    """
    if small.count() <= BROADCAST_IDS:
        return big.join(F.broadcast(small), key, how)
    parts = F.ceil(F.count(F.lit(1)) / KEY_ROWS).cast("int")
    hot = F.broadcast(materialize(big.groupBy(key).agg(parts.alias("_parts")).where("_parts > 1"), "hot-keys"))
    n = F.coalesce("_parts", F.lit(1))
    dealt = big.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*big.columns), n).cast("int")).drop("_parts")
    again = small.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
    return dealt.join(again, [key, "_salt"], how).drop("_salt")
