"""Exact near-duplicate vectors by PCA-ordered, tiled comparison.

Unit vectors are turned into a PCA basis. Two vectors with cosine >= t differ
by at most sqrt(2 - 2t) in every leading coordinate, so cells of that width on
the first two coordinates need only their neighbours. Cells are cut into
blocks of about ``BLOCK_BYTES``; a task compares two blocks in tiles: it
accumulates the leading coordinates first, adds the product of the suffix norms
as a bound for the rest, drops pairs that can't reach t, and takes the exact
cosine in double precision, on the given components, of those left.

Equal vectors of a label are compared once, as a class with a count. A task
returns sums per class and a spanning forest of its links, so neither copies
nor dense clusters make output grow with their square. A dense cluster of
different vectors is still compared in full, spread over block pairs.

Defined results
---------------
* Unfit vectors (null, zero, null or non-finite components, null label or
  null id) link with nothing: n_links 0, their own component, kept.
* Vectors of different length never link. Repeated rows link with each other.
* Cosine >= threshold links, ties at the threshold included.
* An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import components, materialize, seeded_uniform, table

THRESHOLD, LEADING = 0.98, 16
#: Bytes of vectors in a block (two meet in a task, and a vector is copied once for each block it meets), and vectors of a tile within it.
BLOCK_BYTES, TILE = 8 << 20, 1024
#: Vectors (as an expected number) from which the bases are fitted; any basis gives the same result,
#: and vectors of a length that is not among them keep their own coordinates.
BASIS_ROWS = 50_000


def packed(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v, dims): ``v`` holds the components as doubles, null if unfit."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        out = []
        for x in vectors:
            a = None if x is None else np.array([np.nan if c is None else c for c in x] if np.asarray(x).dtype == object else x, dtype=np.float64)
            out.append(a.tobytes() if a is not None and a.size and np.isfinite(a).all() and a.any() else None)
        return pd.Series(out, dtype=object)

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), pack(F.col(vector)).alias("v"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    return rows.withColumn("v", F.when(fit, F.col("v"))).withColumn("dims", F.octet_length("v") / 8)


def _unit(a: np.ndarray) -> np.ndarray:
    a = a / np.abs(a).max(1, keepdims=True)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def bases(classes: DataFrame, seed: int = 3) -> dict[int, np.ndarray]:
    """For each vector length in the sample a basis, columns by falling variance."""
    n = classes.count()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for v in batch.column(0).to_pylist():
                u = _unit(np.frombuffer(v)[None])[0]
                found[len(u)] = found.get(len(u), 0) + np.outer(u, u)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["d", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[d] = found.get(d, 0) + np.frombuffer(s)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["d", "s"])

    sample = classes.where(seeded_uniform(seed, F.col("rep")) < min(1.0, BASIS_ROWS / max(n, 1))).select("v")
    rows = sample.mapInArrow(sums, "d long, s binary").repartition(4).mapInArrow(add, "d long, s binary").collect()  # 4 per length
    total: dict[int, np.ndarray] = {}
    for r in rows:
        total[r["d"]] = total.get(r["d"], 0) + np.frombuffer(r["s"]).reshape(r["d"], r["d"])
    return {d: np.linalg.eigh(s)[1][:, ::-1].copy() for d, s in total.items()}


def linked(a: np.ndarray, b: np.ndarray, basis: np.ndarray | None, threshold: float, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of ``a`` and j of ``b`` with cosine >= threshold, tile by tile; ``same``: b is a, and only i < j are meant."""
    found = [(np.zeros(0, int), np.zeros(0, int))]
    for x in range(0, len(a), TILE):
        for y in range(x if same else 0, len(b), TILE):
            i, j = _linked_tile(a[x : x + TILE], b[y : y + TILE], basis, threshold)
            found.append((i + x, j + y))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    return (i[i < j], j[i < j]) if same else (i, j)


def _linked_tile(a: np.ndarray, b: np.ndarray, basis: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """No basis: the given coordinates."""
    ua, ub = _unit(a), _unit(b)
    if basis is not None:
        ua, ub = ua @ basis, ub @ basis
    p = min(LEADING, a.shape[1])
    upto = ua[:, :p] @ ub[:, :p].T
    bound = upto + np.outer(np.linalg.norm(ua[:, p:], axis=1), np.linalg.norm(ub[:, p:], axis=1))
    i, j = np.nonzero(bound >= threshold - 1e-9)
    dot = upto[i, j]
    while p < a.shape[1] and len(i):
        q = min(a.shape[1], 2 * p)
        dot += np.einsum("ij,ij->i", ua[i, p:q], ub[j, p:q])
        rest = np.linalg.norm(ua[:, q:], axis=1)[i] * np.linalg.norm(ub[:, q:], axis=1)[j]
        keep = dot + rest >= threshold - 1e-9
        i, j, dot, p = i[keep], j[keep], dot[keep], q
    if len(i):
        cosine = np.einsum("ij,ij->i", a[i], b[j]) / (np.linalg.norm(a, axis=1)[i] * np.linalg.norm(b, axis=1)[j])
        i, j = i[cosine >= threshold], j[cosine >= threshold]
    return i, j


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, other) of each component with more than one node."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return [(int(r), int(x)) for x, r in enumerate(root) if r != x]
        root = new


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, name: str = "near") -> DataFrame:
    """``vectors`` as from :func:`packed`; adds n_links, component_id and kept. Reads ``vectors`` twice."""
    spark = vectors.sparkSession
    fit = vectors.where("v is not null").withColumn("key", F.md5("v"))
    classes = materialize(
        fit.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("v").alias("v")), f"{name}-classes"
    )
    basis = spark.sparkContext.broadcast(bases(classes))
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    @F.pandas_udf("dims int, x int, y int")
    def cell(v: pd.Series) -> pd.DataFrame:
        out = []
        for x in v:
            a = np.frombuffer(x)
            lead, turn = _unit(a[None]), basis.value.get(len(a))
            lead = (lead if turn is None else lead @ turn[:, :2])[0]
            at = np.floor(np.append(lead, 0.0)[:2] / width)
            out.append((len(a), int(at[0]), int(at[1])))
        return pd.DataFrame(out, columns=["dims", "x", "y"])

    placed = classes.withColumn("c", cell("v")).select("label", "rep", "n", "v", "c.*")
    placed = materialize(placed, f"{name}-placed")
    where = ["label", "dims", "x", "y"]
    cells = placed.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) * 8 * F.first("dims") / BLOCK_BYTES).cast("int").alias("blocks"))
    cells = materialize(cells, f"{name}-cells")
    half = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    left = cells.select("*", F.explode(half).alias("h")).select("label", "dims", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("blocks").alias("lb"), (F.col("x") + F.col("h.dx")).alias("x"), (F.col("y") + F.col("h.dy")).alias("y"))
    pairs = left.join(cells, where).select("label", "dims", "lx", "ly", "lb", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("blocks").alias("rb"))
    pairs = materialize(pairs, f"{name}-cellpairs")
    rows = placed.withColumn("h", F.pmod(F.xxhash64("rep"), F.lit(1 << 30)))
    own = F.expr("(lx = rx and ly = ry)")
    as_left = rows.join(pairs.withColumn("x", F.col("lx")).withColumn("y", F.col("ly")), where)
    as_left = as_left.withColumn("bl", (F.col("h") % F.col("lb")).cast("int")).withColumn("br", F.explode(F.sequence(F.when(own, F.col("bl")).otherwise(F.lit(0)), F.col("rb") - 1)))
    as_right = rows.join(pairs.withColumn("x", F.col("rx")).withColumn("y", F.col("ry")), where)
    as_right = as_right.withColumn("br", (F.col("h") % F.col("rb")).cast("int")).where(~own | (F.col("br") > 0))
    as_right = as_right.withColumn("bl", F.explode(F.sequence(F.lit(0), F.when(own, F.col("br")).otherwise(F.col("lb")) - 1)))
    task = ["label", "dims", "lx", "ly", "rx", "ry", "bl", "br"]
    both = as_left.select(*task, "rep", "n", "v", F.lit(True).alias("first")).unionByName(as_right.select(*task, "rep", "n", "v", F.lit(False).alias("first")))

    def compare(t: pa.Table) -> pa.Table:
        first = t.column("first").to_numpy(zero_copy_only=False)
        rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
        m = np.frombuffer(b"".join(t.column("v").to_pylist())).reshape(t.num_rows, -1)
        one, other = np.flatnonzero(first), np.flatnonzero(~first)
        alone = not len(other) and t.column("bl")[0] == t.column("br")[0] and t.column("lx")[0] == t.column("rx")[0] and t.column("ly")[0] == t.column("ry")[0]
        if alone:
            other = one
        i, j = linked(m[one], m[other], basis.value.get(m.shape[1]), threshold, alone) if len(one) and len(other) else (np.zeros(0, int), np.zeros(0, int))
        i, j = one[i], other[j]
        total = np.zeros(len(rep), np.int64)
        np.add.at(total, i, n[j])
        np.add.at(total, j, n[i])
        hit = np.flatnonzero(total)
        edges = _forest(len(rep), i, j) if len(i) else []
        a = np.concatenate([rep[hit], rep[[e[0] for e in edges]]]) if len(hit) else np.zeros(0, np.int64)
        b = np.concatenate([np.full(len(hit), -1), rep[[e[1] for e in edges]]]) if len(hit) else np.zeros(0, np.int64)
        edge = np.arange(len(a)) >= len(hit)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64(), mask=~edge), "links": pa.array(np.concatenate([total[hit], np.zeros(len(edges), np.int64)]), pa.int64())})

    found = materialize(both.groupBy(*task).applyInArrow(compare, "a long, b long, links long"), f"{name}-found")
    sums = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(found.where("b is not null").select("a", "b"), f"{name}-components")
    named = classes.select("label", "key", "rep", "n").join(sums, "rep", "left").join(groups, F.col("rep") == F.col("id"), "left")
    named = materialize(named.select("label", "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), f"{name}-named")
    out = vectors.withColumn("key", F.md5("v")).join(named, ["label", "key"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialize(packed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"), "near-vectors")
    return near_duplicates(vectors)


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT e.vec_id, CAST((SELECT count(*) FROM links WHERE a = e.vec_id) AS BIGINT) AS n_links,
  (SELECT min(other) FROM reach WHERE id = e.vec_id) AS component_id, (SELECT min(other) FROM reach WHERE id = e.vec_id) = e.vec_id AS kept
FROM embeddings e
"""
