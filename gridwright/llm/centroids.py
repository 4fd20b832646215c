"""Centroid clustering of integer vectors with bounds that follow the centroids' history.

Every vector keeps an upper bound of the distance to its centroid, a lower bound
for each other one, and the round in which each bound was measured. All rounds'
centroids are kept (k x dims numbers a round), so a bound is loosened by the norm
of the centroid's total displacement since that round; the sum of the drifts of
the rounds between would be larger. A vector whose loosened bounds prove that no
other centroid is as near is left alone; for the others the centroids that the
bounds can't exclude are measured exactly, in integers.

A round reads the vectors with their bounds once and writes them; sums of the
vectors leave a task as one row per cluster. A lost executor repeats its tasks
of the round.

Defined results
---------------
* Vectors without exactly ``dims`` components, null ones, and those with a null
  or non-finite component have no row in the result.
* Repeated rows are vectors of their own. A null vec_id takes part, but starts
  no centroid unless ids run out; of equal ids the smaller vector starts first.
* Fewer vectors than ``k``: as many centroids. An empty table: an empty result.
* Ties go to the smaller centroid number. Extra columns are ignored.
* Components up to 2**27 are held as 64-bit integers, larger ones as integers
  without a bound; distances and inertias beyond 2**63 - 1 are given as that.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, new_path, table, tidy

K, DIMS, ROUNDS, SCALE, SEED = 16, 64, 3, 64, 1
#: The largest component whose squared distances fit 64 bits.
FAST = 1 << 27
MOST = (1 << 63) - 1
_STATE = "vec_id long, v binary, cluster int, upper double, upper_at int, lower binary, lower_at binary, distance decimal(38,0)"


def kept(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): whole numbers floor(scale * x) as doubles, which hold them exactly, packed into a binary."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                a = np.array([np.nan if c is None else c for c in x or ()], float)
                with np.errstate(over="ignore"):
                    a = np.floor(scale * a) + 0.0
                out.append(a.tobytes() if len(a) == dims and np.isfinite(a).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(tidy(pack), "vec_id long, v binary").where("v is not null")


def _whole(v: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: 64-bit ones, or Python's where squares would pass 64 bits."""
    if v.size and np.abs(v).max() > FAST:
        return np.array([int(x) for x in v.ravel()], object).reshape(v.shape)
    return v.astype(np.int64)


def _matrix(rows: list[list[int]]) -> np.ndarray:
    large = any(abs(x) > FAST for row in rows for x in row)
    return np.array(rows, object if large else np.int64)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to ``c``, or to its own row of ``c``."""
    d = x.astype(object) - c if c.dtype == object else x - c
    return (d * d).sum(1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float))


#: Relative room for the rounding of square roots and differences.
SLACK = 1e-9


def drifts(history: list[list[list[int]]]) -> np.ndarray:
    """[t, j]: the distance of centroid j's place in round t to its place now, a little enlarged."""
    now = np.array(history[-1], object)
    out = [[float(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))) ** 0.5 for p, q in zip(was, now, strict=True)] for was in history]
    return np.array(out) * (1 + SLACK)


def assign(v: np.ndarray, state: tuple | None, history: list[list[list[int]]]) -> tuple:
    """(cluster, upper, upper_at, lower, lower_at, measured) of the vectors under the last centroids; ``measured`` distances were taken.

    ``state`` holds the first five as they were, or is None in the first round.
    """
    now, t, n, k = _matrix(history[-1]), len(history) - 1, len(v), len(history[-1])
    x, own = _whole(v), np.arange(n)
    if state is None:
        d = np.stack([_squares(x, c) for c in now], 1)
        cluster = d.argmin(1)
        root = np.stack([_root(d[:, j]) for j in range(k)], 1)
        return cluster, root[own, cluster], np.full(n, t), root, np.full((n, k), t, np.int16), n * k
    cluster, upper, upper_at, lower, lower_at = (a.copy() for a in state)
    moved = drifts(history)
    loose_upper = (upper + moved[upper_at, cluster]) * (1 + SLACK)
    loose_lower = (lower - moved[lower_at, np.arange(k)[None]]) * (1 - SLACK) - SLACK
    open_ = loose_lower <= loose_upper[:, None]  # a centroid as near as the own one can't be excluded; ties may go to it
    open_[own, cluster] = False
    fail = np.flatnonzero(open_.any(1))  # the others are left as they are, their bounds stay those of an earlier round
    if not len(fail):
        return cluster, upper, upper_at, lower, lower_at, 0
    best, best_d = cluster[fail], _squares(x[fail], now[cluster[fail]])
    tight = _root(best_d)
    lower[fail, best], lower_at[fail, best] = tight, t
    still = open_[fail] & (loose_lower[fail] <= (tight * (1 + SLACK))[:, None])
    measured = len(fail) + int(still.sum())
    for j in range(k):
        here = np.flatnonzero(still[:, j])
        if len(here):
            rows = fail[here]
            d = _squares(x[rows], now[j])
            lower[rows, j], lower_at[rows, j] = _root(d), t
            nearer = (d < best_d[here]) | ((d == best_d[here]) & (j < best[here]))
            best[here[nearer]], best_d[here[nearer]] = j, d[nearer]
    cluster[fail], upper[fail], upper_at[fail] = best, _root(best_d), t
    return cluster, upper, upper_at, lower, lower_at, measured


def _step(history: list[list[list[int]]], dims: int, last: bool):
    """One round over the batches of (vec_id, v, state...); the last one also measures every vector's own distance."""
    k = len(history[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cols = batch.num_rows, {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            if not n:
                continue
            v = np.frombuffer(b"".join(cols["v"].to_pylist())).reshape(n, dims)
            state = None
            if "cluster" in cols:
                stack = lambda name, kind: np.frombuffer(b"".join(cols[name].to_pylist()), kind).reshape(n, k)
                state = cols["cluster"].to_numpy().astype(int), cols["upper"].to_numpy(), cols["upper_at"].to_numpy().astype(int), stack("lower", float), stack("lower_at", np.int16)
            cluster, upper, upper_at, lower, lower_at, _ = assign(v, state, history)
            distance = _squares(_whole(v), _matrix(history[-1])[cluster]) if last else np.zeros(n, int)
            arrays = [
                cols["vec_id"], cols["v"], pa.array(cluster, pa.int32()), pa.array(upper, pa.float64()), pa.array(upper_at, pa.int32()),
                pa.array([a.tobytes() for a in lower], pa.binary()), pa.array([a.tobytes() for a in lower_at], pa.binary()),
                pa.array([min(int(d), MOST) for d in distance], pa.decimal128(38, 0)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "v", "cluster", "upper", "upper_at", "lower", "lower_at", "distance"])

    return run


def _means(state: DataFrame, dims: int) -> dict[int, list[int]]:
    """Componentwise floor of the exact mean of each non-empty cluster; one row a cluster leaves a task, and one reaches the driver."""
    names, schema = ["cluster", "n", "s"], "cluster int, n long, s string"

    def rows(total: dict[int, tuple[int, list[int]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([json.dumps(s) for _, s in total.values()], pa.string())], names=names)

    def add(total: dict, j: int, n: int, s: list[int]) -> None:
        was = total.get(j, (0, [0] * dims))
        total[j] = was[0] + n, [a + b for a, b in zip(was[1], s, strict=True)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            cluster = batch.column(0).to_numpy()
            x = _whole(np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(len(cluster), dims))
            for j in np.unique(cluster):
                here = x[cluster == j]
                add(total, int(j), len(here), [int(c) for c in here.sum(0)])
        yield rows(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for j, n, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                add(total, j, n, json.loads(s))
        yield rows(total)

    found = state.select("cluster", "v").mapInArrow(tidy(sums), schema).repartition("cluster").mapInArrow(merge, schema).collect()  # k rows
    return {r["cluster"]: [s // r["n"] for s in json.loads(r["s"])] for r in found}


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of ``vectors`` (vec_id, v) as :func:`kept` gives them."""
    spark = vectors.sparkSession
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.withColumn("h", h).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k vectors
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    history = [[[int(x) for x in np.frombuffer(r["v"])] for r in first]]
    state, path = vectors, None
    for turn in range(rounds + 1):
        new = new_path(spark, "centroids")
        state.mapInArrow(tidy(_step(history, dims, turn == rounds)), _STATE).write.parquet(new)
        state = spark.read.schema(_STATE).parquet(new)
        if path:
            discard(spark, path)
        path = new
        if turn < rounds:
            means = _means(state, dims)
            history.append([means.get(j, c) for j, c in enumerate(history[-1])])
    per = state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # k rows
    total, most = sum(int(r["s"]) for r in per), lambda x: min(int(x), MOST)
    digest = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(history[-1])}
    facts = spark.createDataFrame([(r["cluster"], most(r["s"]), most(total), digest[r["cluster"]]) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", F.col("distance").cast("long").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(kept(table(spark, sf_dir, "embeddings")))


def _sql() -> str:
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    parts = [
        """kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS j, v AS c FROM kept QUALIFY j < 16)",
    ]
    for t in range(ROUNDS + 1):
        parts.append(f"""a{t} AS MATERIALIZED (SELECT row, vec_id, any_value(v) AS v, arg_min(j, d * 100 + j) AS j, min(d) AS d FROM
 (SELECT row, vec_id, v, j, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM kept, c{t}) GROUP BY row, vec_id)""")
        if t < ROUNDS:
            parts.append(f"""m{t} AS MATERIALIZED (SELECT j, list(m ORDER BY i) AS c FROM (SELECT j, i, {floor} AS m FROM
 (SELECT j, i, sum(v[i]) AS s, count(*) AS n FROM a{t}, range(1, 65) r(i) GROUP BY j, i)) GROUP BY j),
 c{t + 1} AS MATERIALIZED (SELECT j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (j))""")
    t = ROUNDS
    return f"""WITH {', '.join(parts)} SELECT vec_id, j AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{t} JOIN c{t} USING (j)"""


SQL = _sql()
