"""Permutation tests on a summary table (a row per subject), for any number of rows.

A permutation is a keyed bijection of the rows' numbers, so every task works out
the permuted groups of its rows by itself; no order is shuffled or collected.
Statistics of pairs are sums over tiles: two blocks of rows meet in a task, which
takes their distances once and adds them up for all permutations and groups by
two matrix products. Only those sums leave a task. Dispersions are sums over rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.results import written

#: Rows of a block; two blocks meet in a task.
BLOCK = 512
#: Numbers in the table of centres (permutations x groups x dimensions) that a task holds.
MAX_CENTRES = 20_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(rows: np.ndarray, n: int, n_perm: int, seed: int) -> np.ndarray:
    """[i, t]: where permutation t of 0 to n - 1 puts row i; column 0 is the identity.

    Four rounds that swap and mix two halves of a number's bits are a bijection of a power of 4; numbers beyond n go round again.
    """
    half = np.uint64(max(1, -(-int(n - 1).bit_length() // 2)))
    low = np.uint64((1 << int(half)) - 1)
    out = np.repeat(np.asarray(rows, np.uint64)[:, None], n_perm + 1, 1)
    key = np.broadcast_to(np.arange(n_perm + 1, dtype=np.uint64), out.shape) + (np.uint64(seed) << np.uint64(32))
    todo = np.zeros(out.shape, bool)
    todo[:, 1:] = True
    while todo.any():
        x, k = out[todo], key[todo]
        a, b = x >> half, x & low
        for turn in range(4):
            with np.errstate(over="ignore"):
                a, b = b, a ^ (mixed(b + k * np.uint64(4) + np.uint64(turn << 60)) & low)
        out[todo] = a << half | b
        todo &= out >= np.uint64(n)
    return out.astype(np.int64)


def numbered(points: DataFrame, key: str = "subject") -> tuple[DataFrame, list[int]]:
    """(``points`` with ``row``, gapless from 0 by group and key; the groups' sizes in order). A row's group is the place of its number."""
    w = Window.partitionBy("_part").orderBy("_in")
    placed = points.repartitionByRange("grp", key).sortWithinPartitions("grp", key)
    placed = written(placed.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id()), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    shift = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    out = placed.withColumn("_row", F.row_number().over(w) - 1).join(F.broadcast(shift), "_part")
    sizes = [r["n"] for r in placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).orderBy("grp").collect()]  # a row a group
    return written(out.withColumn("row", F.col("_row") + F.col("_shift")).drop("_part", "_in", "_row", "_shift"), "numbered"), sizes


def _groups(rows: np.ndarray, sizes: list[int], n_perm: int, seed: int) -> np.ndarray:
    return np.searchsorted(np.cumsum(sizes), permuted(rows, sum(sizes), n_perm, seed), "right")


def _tiles(rows: DataFrame, n: int, cols: list[str]) -> DataFrame:
    """Each row once for each tile (i <= j) of two blocks that it is in."""
    blocks = -(-n // BLOCK)
    own = F.floor(F.col("row") / BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return rows.select("row", *cols, own.alias("b"), other.alias("o")).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("o")


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), float)


def pair_sums(rows: DataFrame, sizes: list[int], value: Callable[[np.ndarray], np.ndarray], n_perm: int, seed: int) -> DataFrame:
    """(t, g, s): for each permutation and group the sum of ``value`` of the squared distances over unordered pairs inside it; g = -1: over all pairs.

    ``rows`` (row, v). Permutation 0 is the observed grouping.
    """
    groups = range(len(sizes))

    def tile(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, row, v = table.column("b").to_numpy(), table.column("row").to_numpy(), _matrix(table.column("v"))
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sq = np.maximum((v[a] ** 2).sum(1)[:, None] + (v[b] ** 2).sum(1)[None] - 2 * v[a] @ v[b].T, 0.0)
        x = value(sq)
        if i == j:
            np.fill_diagonal(x, 0.0)
            x = x / 2
        ga, gb = _groups(row[a], sizes, n_perm, seed), _groups(row[b], sizes, n_perm, seed)
        s = np.concatenate([[x.sum()], *[(x @ (gb == g) * (ga == g)).sum(0) for g in groups]])
        t = np.concatenate([[0], *[np.arange(n_perm + 1)] * len(sizes)])
        return pa.table({"t": pa.array(t, pa.int32()), "g": pa.array(np.concatenate([[-1], np.repeat(groups, n_perm + 1)]), pa.int32()), "s": pa.array(s, pa.float64())})

    parts = _tiles(rows, sum(sizes), ["v"]).groupBy("i", "j").applyInArrow(tile, "t int, g int, s double")
    return parts.groupBy("t", "g").agg(F.sum("s").alias("s"))


def _p(stats: DataFrame, name: str, n_perm: int, extra: list | None = None) -> DataFrame:
    """One row of the statistic ``f`` by ``t``: the observed one and the share of permutations that reach it, up to rounding."""
    seen = F.max(F.when(F.col("t") == 0, F.col("f")))
    own = stats.agg(seen.alias("o"), *[F.max(F.when(F.col("t") == 0, F.col(c))).alias(c) for c in extra or []])
    j = stats.where("t > 0").join(F.broadcast(own.select("o")))  # one row
    p = j.agg(F.avg((F.col("f") >= F.col("o") - 1e-12 * F.abs("o")).cast("double")).alias("p"))
    return own.join(F.broadcast(p)).select(F.lit(name).alias("test"), F.col("o").alias("f"), *(extra or []), "p", F.lit(n_perm).alias("n_perm"))


def _sized(spark, sizes: list[int]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(enumerate(sizes)), "g int, n long"))  # a row a group


def permanova_test(points: DataFrame, n_perm: int = 999, seed: int = 42, key: str = "subject") -> DataFrame:
    """(test, f, r2, p, n_perm) of ``points`` (key, grp, v) under Euclidean distances; for compositions give their log ratios."""
    rows, sizes = numbered(points.select(key, "grp", "v"), key)
    n, k = sum(sizes), len(sizes)
    sums = written(pair_sums(rows, sizes, lambda sq: sq, n_perm, seed), "permanova")
    total = F.broadcast(sums.where("g = -1").select((F.col("s") / n).alias("ss")))  # one row
    within = sums.where("g >= 0").join(_sized(points.sparkSession, sizes), "g").groupBy("t").agg(F.sum(F.col("s") / F.col("n")).alias("w")).join(total)
    f = F.when((F.col("w") > 1e-14) & F.lit(n > k > 1), ((F.col("ss") - F.col("w")) / (k - 1)) / (F.col("w") / (n - k))).otherwise(0.0)
    return _p(within.select("t", f.alias("f"), ((F.col("ss") - F.col("w")) / F.col("ss")).alias("r2")), "location", n_perm, ["r2"])


def mean_embeddings(points: DataFrame, sigma: float, features: int = 256, seed: int = 42) -> DataFrame:
    """(subject, v): each subject's mean of random Fourier features of its rows of ``points`` (subject, v).

    The distance of two means approaches the kernel mean discrepancy of the two subjects (error about 1 / sqrt(features)),
    with sums over rows in the place of sums over pairs of rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            g, x = np.array(batch.column(0).to_pylist(), dtype=object), _matrix(batch.column(1))
            rng = np.random.default_rng(seed)
            turned = x @ rng.normal(0, 1 / sigma, (x.shape[1], features)) if len(x) else np.empty((0, features))
            phi = np.sqrt(2 / features) * np.cos(turned + rng.uniform(0, 2 * np.pi, features))
            for name in set(g):
                here = g == name
                total[name] = total.get(name, 0) + np.concatenate([[here.sum()], phi[here].sum(0)])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([s.tolist() for s in total.values()], pa.list_(pa.float64()))], names=["subject", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for g, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[g] = total.get(g, 0) + np.array(s)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([(s[1:] / s[0]).tolist() for s in total.values()], pa.list_(pa.float64()))], names=["subject", "v"])

    part = points.select(F.col("subject").cast("string").alias("subject"), "v").mapInArrow(run, "subject string, s array<double>")
    return part.repartition("subject").mapInArrow(add, "subject string, v array<double>")


def kernel_test(points: DataFrame, sigma: float, n_perm: int = 499, seed: int = 42, key: str = "subject") -> DataFrame:
    """(test, f, p, n_perm): unbiased squared mean discrepancy of the two groups of ``points`` (key, grp, v); f and p are NULL unless both have two rows at least."""
    rows, sizes = numbered(points.select(key, "grp", "v"), key)
    if len(sizes) > 2:
        raise ValueError("more than two groups")
    if len(sizes) < 2 or min(sizes) < 2:
        return points.sparkSession.createDataFrame([("kernel", None, None, n_perm)], "test string, f double, p double, n_perm int")
    a, b = sizes
    sums = written(pair_sums(rows, sizes, lambda sq: np.exp(-sq / (2 * sigma * sigma)), n_perm, seed), "kernel-test")
    total = F.broadcast(sums.where("g = -1").select(F.col("s").alias("all")))  # one row
    of = lambda g: F.max(F.when(F.col("g") == g, F.col("s")))
    each = sums.where("g >= 0").groupBy("t").agg(of(0).alias("x"), of(1).alias("y")).join(total)
    f = 2 * F.col("x") / (a * (a - 1)) + 2 * F.col("y") / (b * (b - 1)) - 2 * (F.col("all") - F.col("x") - F.col("y")) / (a * b)
    return _p(each.select("t", f.alias("f")), "kernel", n_perm)


def scaled_coordinates(rows: DataFrame, n: int, dims: int, steps: int = 50, tol: float = 1e-3, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """(``rows`` with coordinates ``x``; the stress before each step): distances of ``x`` approach those of ``v`` by stress majorisation.

    A step moves each row to the mean of the places where its pairs would put it; the stress never rises.
    """
    u = [(F.shiftrightunsigned(F.xxhash64(F.lit(seed + d), "row"), 12).cast("double") + 0.5) / float(1 << 52) - 0.5 for d in range(dims)]
    now = written(rows.withColumn("x", F.array(*u)), "scaling")
    schema = pa.schema([("row", pa.int64()), ("m", pa.list_(pa.float64())), ("stress", pa.float64())])

    def tile(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, row, v, x = table.column("b").to_numpy(), table.column("row").to_numpy(), _matrix(table.column("v")), _matrix(table.column("x"))
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        apart = lambda z: np.sqrt(np.maximum((z[a] ** 2).sum(1)[:, None] + (z[b] ** 2).sum(1)[None] - 2 * z[a] @ z[b].T, 0.0))
        want, have = apart(v), apart(x)
        if i == j:
            np.fill_diagonal(want, 0.0)
            np.fill_diagonal(have, 0.0)
        ratio = np.where(have > 1e-12, want / np.maximum(have, 1e-12), 0.0)
        stress = ((want - have) ** 2).sum() / (2 if i == j else 1)
        at, move = row[a], ratio.sum(1)[:, None] * x[a] - ratio @ x[b]
        if i != j:
            at, move = np.concatenate([at, row[b]]), np.concatenate([move, ratio.sum(0)[:, None] * x[b] - ratio.T @ x[a]])
        return pa.table([pa.array(at, pa.int64()), pa.array(move.tolist(), pa.list_(pa.float64())), pa.array([stress, *[0.0] * (len(at) - 1)], pa.float64())], schema=schema)

    def over(stress: list[float]) -> bool:
        return len(stress) > 1 and stress[-2] - stress[-1] <= tol * stress[-2] or stress[-1] <= 1e-12 or len(stress) > steps

    def at_once(table: pa.Table) -> pa.Table:
        """All steps of the only tile there is: (row, coordinates, the stress before each step)."""
        row, v, x = table.column("row"), table.column("v"), table.column("x")
        here = {"i": table.column("i"), "j": table.column("j"), "b": table.column("b"), "row": row, "v": v}
        seen: list[float] = []
        while True:
            moved = tile(pa.table({**here, "x": x}))
            seen.append(float(moved.column("stress").to_numpy().sum()))
            if over(seen):
                return pa.table([row, x, pa.array([seen] * len(row), pa.list_(pa.float64()))], names=["row", "x", "stress"])
            x = pa.array((_matrix(moved.column("m")) / n).tolist(), pa.list_(pa.float64()))

    if 0 < n <= BLOCK:  # one tile: a job a step would take its time for nothing
        done = written(_tiles(now, n, ["v", "x"]).groupBy("i", "j").applyInArrow(at_once, "row long, x array<double>, stress array<double>"), "scaling")
        return now.drop("x").join(done.select("row", "x"), "row"), done.first()["stress"]
    stress: list[float] = []
    while len(stress) <= steps:
        moved = _tiles(now, n, ["v", "x"]).groupBy("i", "j").applyInArrow(tile, "row long, m array<double>, stress double")
        moved = written(moved.groupBy("row").agg(F.array(*[F.sum(F.col("m")[d]) / n for d in range(dims)]).alias("to"), F.sum("stress").alias("stress")), "scaling")
        stress.append(float(moved.agg(F.sum("stress")).first()[0] or 0.0))
        if over(stress):
            break
        now = written(now.drop("x").join(moved.select("row", F.col("to").alias("x")), "row"), "scaling")
    return now, stress


def dispersion_test(points: DataFrame, n_perm: int = 999, seed: int = 42, key: str = "subject", dims: int = 8, steps: int = 50) -> DataFrame:
    """(test, f, p, n_perm): F ratio of the distances to the groups' centres, on coordinates from stress majorisation of ``points`` (key, grp, v)."""
    rows, sizes = numbered(points.select(key, "grp", "v"), key)
    n, k, dims = sum(sizes), len(sizes), max(1, min(sum(sizes) - 1, dims))
    if (n_perm + 1) * k * dims > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} numbers for the centres of all permutations")
    at, _ = scaled_coordinates(rows, n, dims, steps, seed=seed)
    spark, schema = points.sparkSession, "g int, s binary"

    def added(make: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all rows of ``make(x, groups)``, an array [group, permutation, ...]; a group's part leaves a task as one row."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = make(_matrix(batch.column(1)), _groups(batch.column(0).to_numpy(), sizes, n_perm, seed))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], names=["g", "s"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for g, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    total[g] = total.get(g, 0) + np.frombuffer(s)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["g", "s"])

        found = {r["g"]: np.frombuffer(r["s"]) for r in at.select("row", "x").mapInArrow(run, schema).repartition("g").mapInArrow(merge, schema).collect()}  # a row a group
        return np.stack([found[g].reshape(n_perm + 1, -1) for g in range(k)])

    centre = added(lambda x, grp: np.stack([(grp == g).T.astype(float) @ x for g in range(k)])) / np.array(sizes)[:, None, None]

    def distances(x: np.ndarray, grp: np.ndarray) -> np.ndarray:
        t = np.arange(n_perm + 1)
        d = np.stack([np.linalg.norm(row[None] - centre[of, t], axis=1) for row, of in zip(x, grp, strict=True)])
        return np.stack([np.stack([(d * (grp == g)).sum(0), (d * d * (grp == g)).sum(0)], 1) for g in range(k)])

    sums = added(distances)
    mean, size = sums[:, :, 0] / np.array(sizes)[:, None], np.array(sizes)[:, None]
    between = (size * (mean - (size * mean).sum(0) / n) ** 2).sum(0)
    within = (sums[:, :, 1] - size * mean**2).sum(0)
    f = np.where(within > 1e-14, (between / max(k - 1, 1)) / (np.maximum(within, 1e-300) / max(n - k, 1)), 0.0) if n > k > 1 else np.zeros(n_perm + 1)
    return _p(spark.createDataFrame(list(enumerate(map(float, f))), "t int, f double"), "dispersion", n_perm)
