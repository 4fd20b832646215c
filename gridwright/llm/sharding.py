"""Sharding with near-equal bytes by Karmarkar-Karp differencing.

Documents with equal texts form a group that stays together. Groups heavier
than total / (64 * shards) are items of their own (fewer than 64 * shards of
them can exist); all others are hashed into 256 bundles per shard. So at most
320 items per shard, whatever the input, take part in the differencing:
start with one partial partition per item, and repeatedly combine the two with
the largest spread in opposite order.

Defined results
---------------
* Null text: 0 bytes, and all null texts form one group, apart from ''.
* Slots number a shard's rows from 0 without gaps, by hashed blocks of
  (doc_id, row content); repeated rows get different slots in one shard.
* An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, ranked, table

SHARDS, BUNDLES_PER_SHARD, HEAVY_PER_SHARD = 24, 256, 64
OVERHEAD = 8


def differencing(sizes: list[int], k: int) -> list[int]:
    """The part (0..k-1) of each size, by k-way Karmarkar-Karp differencing."""
    if not sizes:
        return []
    heap = []
    for i, s in enumerate(sizes):
        parts = [(0, ())] * (k - 1) + [(s, (i,))]
        heap.append((-s, i, parts))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # largest of one with smallest of the other; members as nested pairs, so that joining is constant time
        joined = sorted(((x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda p: p[0])
        low = joined[0][0]
        joined = [(s - low, m) for s, m in joined]
        heapq.heappush(heap, (-joined[-1][0], tie, joined))
        tie += 1
    part = [0] * len(sizes)
    for p, (_, members) in enumerate(heap[0][2]):
        stack = [members]
        while stack:
            m = stack.pop()
            if not m:
                continue
            if len(m) == 1:
                part[m[0]] = p
            else:
                stack += m
    return part


def shard(rows: DataFrame, shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """``rows`` (size, grp, ...) with ``shard``; rows of one grp go to one shard. Reads ``rows`` twice."""
    groups = materialize(rows.groupBy("grp").agg(F.sum("size").alias("bytes")), f"{name}-groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    heavy = F.col("bytes") > F.lit(total / (HEAVY_PER_SHARD * shards))
    big = groups.where(heavy).orderBy("grp").collect()  # fewer than HEAVY_PER_SHARD * shards rows
    bundle = F.pmod(F.xxhash64("grp"), F.lit(BUNDLES_PER_SHARD * shards)).cast("int")
    small = groups.where(~heavy).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes")).orderBy("bundle").collect()
    part = differencing([int(r["bytes"]) for r in [*big, *small]], shards)
    session = rows.sparkSession
    heavy_at = session.createDataFrame([(r["grp"], p) for r, p in zip(big, part, strict=False)], "grp string, _heavy int")
    of_bundle = [0] * (BUNDLES_PER_SHARD * shards)
    for r, p in zip(small, part[len(big) :], strict=True):
        of_bundle[r["bundle"]] = p
    lookup = session.createDataFrame([(i, p) for i, p in enumerate(of_bundle)], "_bundle int, _light int")
    return (
        rows.withColumn("_bundle", bundle).join(F.broadcast(heavy_at), "grp", "left").join(F.broadcast(lookup), "_bundle")
        .withColumn("shard", F.coalesce("_heavy", "_light")).drop("_bundle", "_heavy", "_light")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"), F.coalesce(F.md5(text), F.lit("null")).alias("grp"),
    )
    docs = materialize(docs, "shard-docs")
    placed = materialize(shard(docs), "shard-placed")
    return ranked(placed, "shard", ["doc_id", "size", "grp"], "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
