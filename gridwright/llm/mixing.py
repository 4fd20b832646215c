"""Mixing sources to target weights by capped water-filling, JVM side only.

Each source has a size (words), a weight and a ceiling of ``max_epochs`` times
its size. All sources share the total by weight; those above their ceiling are
clamped and the excess goes to the others by weight, until none is above. A
source then takes every document floor(target / size) times, and one more,
fractional repetition: documents in a seeded order until the rest of the target
is reached, the last of them only in part.

No Python, pandas, Arrow or RDD code is involved. A hot source's documents are
dealt by their seeded number into about sqrt(count) blocks; block sums find
the block where the rest of the target ends, and only its rows are ordered.

Defined results
---------------
* Null or empty text: size 0, taken 0. Source null is a source of its own and
  sorts last. All sizes 0: every target is 0.
* Repeated rows are rows of their own; among rows with the same id, the
  smaller size comes first. Rows that are equal get equal results or share
  the boundary in either order.
* :func:`mix` returns whole input rows as the struct ``row``, so that extra
  columns of any name pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, seeded_uniform, table, whole_rows

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Broadcast the sources' table up to this many rows; beyond, it is shuffled.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, source_size, n, weight, target) from rows of (source, size)."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    placed = materialize(
        sums.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "mix-sources",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    shift = placed.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("shift"))
    turn = (F.pmod(F.col("row") + F.col("shift"), F.lit(len(weights))) + 1).cast("int")
    table_ = materialize(
        placed.join(shift, "part").select("source", "source_size", "n", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"),
                                          (F.col("source_size") * max_epochs).cast("double").alias("ceiling")),
        "mix-weights",
    )
    total = float(table_.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level, rounds = 0.0, 0
    while True:  # each round clamps at least one source more, mostly many at once
        clamped = F.col("ceiling") <= F.col("weight") * level
        held, free = table_.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("ceiling"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0))
        ).first()
        new = (total - held) / free if free else level
        rounds += 1
        if new <= level or not free:
            break
        level = new
    target = F.least("ceiling", F.col("weight") * level) if total > 0 else F.lit(0.0)
    return table_.withColumn("target", target).drop("ceiling")


def mix(docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(row, source_size, target, whole, part) for each row of ``docs`` (doc_id, source, size, ...).

    ``whole`` repetitions of all words and ``part`` words once more are taken.
    """
    targets = materialize(source_targets(docs.select("source", "size"), weights, max_epochs), "mix-targets")
    small = targets.count() <= BROADCAST_SOURCES
    aside = (lambda t: F.broadcast(t)) if small else (lambda t: t)
    rows = whole_rows(docs, "doc_id", "source", "size")
    one = targets.select(F.col("source").alias("s"), "source_size", "target", F.ceil(F.sqrt("n")).alias("blocks"))
    rows = rows.join(aside(one), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("whole", whole).withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    rows = rows.withColumn("u", seeded_uniform(seed, F.col("doc_id"))).withColumn("block", F.floor(F.col("u") * F.col("blocks")))
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("sum"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("upto", F.sum("sum").over(upto))
    # the block in which the rest ends, and the words of the blocks before it
    edge = blocks.where("upto > rest").groupBy("source").agg(F.min(F.struct("block", (F.col("upto") - F.col("sum")).alias("before"))).alias("e"))
    edge = materialize(edge.select(F.col("source").alias("s"), F.col("e.block").alias("edge"), F.col("e.before").alias("before")), "mix-edges")
    rows = rows.join(aside(edge), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    inside = Window.partitionBy("source", "block").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = F.col("block") == F.col("edge")
    taken = (F.col("edge").isNull() | (F.col("block") < F.col("edge"))) & (F.col("rest") > 0)
    sure = rows.where(F.coalesce(~at_edge, F.lit(True))).withColumn("part", F.when(taken, F.col("size")).otherwise(F.lit(0)))
    cut = rows.where(at_edge).withColumn(
        "part", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))))
    )
    return sure.unionByName(cut).select("row", "source_size", "target", "whole", F.col("part").cast("long").alias("part"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    return mix(docs).select("row.doc_id", "row.size", "source_size", "target", (F.col("whole") * F.col("row.size") + F.col("part")).alias("taken"))
