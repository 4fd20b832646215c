"""Exact top-k search over binary codes by incremental multi-index hashing.

Each distinct code is indexed by the value of each of its segments, as rows
(segment, value, code). A query looks up, round by round, the values that are
r = 0, 1, 2, ... bits away from its own in every segment, by an equi-join with
the index. After the round of radius r all codes within distance
m * (r + 1) - 1 have been met, m being the number of segments (else the
distances of the segments would add up to more), so a query whose last
neighbour is verified at most that far is done, and only the others go on.
Segments have about log2(n) bits, so a value holds about one code. A pair that
several lookups meet is taken at the first of them only, so that nothing needs
to be made distinct.

Skew: the index holds each distinct code once, with its k + 1 smallest ids
(ids beyond can't be in any answer), and each distinct query code is searched
once. So copies, even a third of all rows, cost one entry. Values that many
codes share are dealt into blocks, and a lookup goes to every block.

Defined results
---------------
* Vectors that are null, hold null or non-finite components, or are of another
  length than the code have no code: they are neither queries nor answers. A
  zero vector has code 0.
* Neighbours are ordered by (distance, id); a query never returns its own id.
* Fewer than k other rows: all of them. Repeated ids count as one. No rows or
  no queries give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import checked, materialize, table, tidy

BITS, K = 64, 10
#: Codes of one value of a segment that stay together.
BUCKET = 4096
#: Values that a task looks up at a time.
_LOOKUPS = 1 << 16


def sign_code(vector: Column, dims: int = BITS) -> Column:
    """Bit i tells whether component i is positive; null if the vector is unfit."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    code = F.lit(0).cast("long")
    for i in range(dims):
        one = (1 << i) - (1 << 64 if i == 63 else 0)
        code = code.bitwiseOR(F.when(F.get(vector, F.lit(i)) > 0, F.lit(one)).otherwise(F.lit(0)).cast("long"))
    return F.when(vector.isNotNull() & (F.size(vector) == dims) & ~bad, code)


def widths(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment: about log2(n) bits each, 8 to 32."""
    m = min(8, max(2, round(BITS / max(1.0, np.log2(max(n, 2))))))
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)]


def _segment(code: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << bits) - 1))


def masks(bits: int, radius: int) -> Iterator[np.ndarray]:
    """All values of ``bits`` bits with ``radius`` of them set, in parts."""
    part: list[int] = []
    for places in combinations(range(bits), radius):
        part.append(sum(1 << p for p in places))
        if len(part) == _LOOKUPS:
            yield np.array(part, np.int64)
            part = []
    if part:
        yield np.array(part, np.int64)


def _lookups(asked: DataFrame, segments: list[tuple[int, int]], radius: int) -> DataFrame:
    """(q, j, value): the values of segment j that are ``radius`` bits away from that of the query code q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.asarray(batch.column(0)).view(np.uint64)
            for j, (at, bits) in enumerate(segments):
                own = ((q >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                for mask in masks(bits, radius):
                    step = max(1, _LOOKUPS // len(mask))
                    for i in range(0, len(q), step):
                        value = own[i : i + step, None] ^ mask
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q[i : i + step].view(np.int64), len(mask))), pa.array(np.full(value.size, j, np.int32)), pa.array(value.ravel())], names=["q", "j", "value"])

    spread = asked.select("q").repartition(asked.sparkSession.sparkContext.defaultParallelism, "q")  # a few rows, but many lookups each
    return spread.mapInArrow(tidy(run), "q long, j int, value long")


def search(base: DataFrame, queries: DataFrame, k: int = K, name: str = "topk") -> DataFrame:
    """``base`` and ``queries`` hold (id, code). Returns (query_id, rank, id, distance)."""
    smallest = Window.partitionBy("code").orderBy("id")
    index = materialize(
        base.where("code is not null and id is not null").select("code", "id").distinct()
        .withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
        .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")),
        f"{name}-index",
    )  # at most k + 1 ids a code
    queries = queries.where("code is not null and id is not null").select("id", "code").distinct()
    asked = materialize(queries.select(F.col("code").alias("q")).distinct(), f"{name}-asked")
    n = index.count()
    segments = widths(n)
    values = F.array(*[F.struct(F.lit(j).alias("j"), _segment(F.col("code"), *x).alias("value")) for j, x in enumerate(segments)])
    rows = index.select("code", F.col("ids")[0].alias("first"), F.explode(values).alias("s")).select("s.j", "s.value", "code", "first")
    hot = rows.groupBy("j", "value").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("blocks")).where("blocks > 1")
    hot = checked(materialize(hot, f"{name}-hot"))  # at most codes / BUCKET values a segment
    many = F.coalesce("blocks", F.lit(1))
    rows = rows.join(hot, ["j", "value"], "left").withColumn("block", F.pmod(F.xxhash64("code"), many).cast("int")).drop("blocks")
    rows = materialize(rows, f"{name}-segments")
    # per query code the k + 1 codes that come first by (distance, smallest id): they hold the k best rows
    best = materialize(asked.select("q", F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("first"), F.lit(0).alias("distance")).where("false"), f"{name}-best")
    active = asked
    apart = F.col("code").bitwiseXOR(F.col("q"))
    for radius in range(max(bits for _, bits in segments) + 1):
        lookups = _lookups(active, segments, radius).join(hot, ["j", "value"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), many - 1))).drop("blocks")
        met = lookups.join(rows.hint("shuffle_merge"), ["j", "value", "block"])  # lookups grow with the radius: never broadcast
        here = [F.bit_count(_segment(apart, *x)) for x in segments]
        before = [(here[i] > radius) | (here[i] == radius) & (F.col("j") <= i) for i in range(len(segments))]
        for condition in before:  # met at no smaller radius, and at this one in no earlier segment
            met = met.where(condition)
        met = met.select("q", "code", "first", F.bit_count(apart).alias("distance"))
        order = Window.partitionBy("q").orderBy("distance", "first")
        ranked = best.unionByName(met).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
        best = materialize(ranked, f"{name}-best")
        proven = len(segments) * (radius + 1) - 1
        done = best.where(F.col("distance") <= proven).groupBy("q").count().where(F.col("count") >= min(k + 1, n)).select("q")
        active = materialize(active.join(done, "q", "left_anti"), f"{name}-active")
        if not active.head(1):
            break
    rows = best.join(index.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("id"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("r") <= k + 1).drop("r")
    pairs = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(materialize(rows, f"{name}-rows"), "q").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = materialize(
        table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code")), "topk-codes"
    )
    out = search(codes, codes.where("id % 50 = 0"))
    return out.select(F.col("query_id"), F.col("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("long").alias("distance"))


SQL = """
WITH codes AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(64 - list_sum(list_transform(list_zip(q.bits, c.bits), lambda p: CASE WHEN p[1] = p[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM codes q, codes c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM ranked WHERE rank <= 10
"""
