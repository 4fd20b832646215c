"""Spatially regularised spectral clustering of each subject, over all of its cells.

The affinity of two cells is a Gaussian kernel of their features and places, which for n cells is a matrix that
nobody wants to write down. It is factored as Z Z' instead: Z holds a row per cell, made from the kernel against
pivot cells. What the factor leaves out is measured on all cells (the trace of the rest), and the pivots of a
subject are doubled until that is below ``tolerance`` of the whole. Degrees, spectrum and eigenvectors then follow
from sums over all cells. Cells are dealt into blocks by (subject, hash); blocks meet their subject's pivots in a
co-grouped join, so neither a subject nor the models of all subjects are ever in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.results import written
from . import inference, mixture, scaling, selection

#: Cells of a block, and rows of it that are turned into kernel rows at once.
BLOCK, SLAB = 32_768, 4_096
#: Pivots of the first round; each later round doubles them where the rest is too large.
PIVOTS = 64
#: Different features of a block, whose pairs with another block's are counted in a task, and distances worked out at once.
PAIR_BLOCK, PAIR_SLAB = 4_096, 1 << 15
# Fixed value: bits of a distance by which one pass counts; three passes see all bits of a positive double.
PAIR_BITS = 21
# Fixed value: the bits of infinity; those above are no numbers.
INFINITE = 0x7FF0000000000000

CELLS = ["subject", "slice", "x", "y"]


def bandwidth(x: np.ndarray) -> float:
    """Median positive distance between the rows; 1 if there is none."""
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    d = d[d > 0]
    return float(np.median(d)) if len(d) else 1.0


def place_bandwidth(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Median positive distance between all pairs of places, each counted ``n`` times.

    How many pairs lie a given displacement apart is the autocorrelation of the grid of counts.
    """
    grid = np.zeros((int(np.ptp(y)) + 1, int(np.ptp(x)) + 1))
    np.add.at(grid, ((y - y.min()).astype(int), (x - x.min()).astype(int)), n)
    shape = (2 * grid.shape[0], 2 * grid.shape[1])
    pairs = np.rint(np.fft.irfft2(np.abs(np.fft.rfft2(grid, shape)) ** 2, shape))
    dy, dx = (np.minimum(np.arange(s), s - np.arange(s)) for s in shape)
    square = dy[:, None] ** 2 + dx[None] ** 2
    square, pairs = square[(pairs > 0) & (square > 0)], pairs[(pairs > 0) & (square > 0)]
    if not len(square):
        return 1.0
    order = np.argsort(square)
    below = np.cumsum(pairs[order])
    low, high = (np.sqrt(square[order][np.searchsorted(below, at, "right")]) for at in ((below[-1] - 1) // 2, below[-1] // 2))
    return float((low + high) / 2)


def pair_counts(a: np.ndarray, b: np.ndarray, prefixes: set[int], shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, pairs): how many pairs of a row of ``a`` and one of ``b`` have a positive squared distance whose bits, shifted right, are a key that begins with one of ``prefixes``.

    A row holds features and, last, how often they occur.
    """
    hists = {prefix: np.zeros(1 << PAIR_BITS) for prefix in prefixes}
    step = max(1, PAIR_SLAB // max(1, len(b)))
    for at in range(0, len(a), step):
        slab = a[at : at + step]
        square = np.zeros((len(slab), len(b)))
        for x, y in zip(slab.T[:-1], b.T[:-1], strict=True):
            d = x[:, None] - y[None]
            d *= d
            square += d
        bits, times = square.view(np.int64).ravel(), np.outer(slab[:, -1], b[:, -1]).ravel()
        for prefix, hist in hists.items():
            low = max(1, prefix << (shift + PAIR_BITS))
            here = np.flatnonzero((bits >= low) & (bits <= min((prefix + 1 << (shift + PAIR_BITS)) - 1, INFINITE)))
            np.add.at(hist, (bits[here] >> shift) - (prefix << PAIR_BITS), times[here])
    found = {prefix: np.flatnonzero(hist) for prefix, hist in hists.items()}
    return np.concatenate([at + (prefix << PAIR_BITS) for prefix, at in found.items()]), np.concatenate([hists[prefix][at] for prefix, at in found.items()])


def feature_bandwidths(points: DataFrame) -> DataFrame:
    """(subject, sf): median positive distance between the features of all pairs of a subject's cells; 1 if there is none.

    Different features are dealt into blocks with their counts, and two blocks meet in a task. Positive doubles are ordered as the
    integers of their bits: pairs are counted by the leading bits, those around the middle again by the next, until a key is a number.
    """
    rows = written(points.groupBy("subject", "v").agg(F.count(F.lit(1)).cast("double").alias("n")), "bandwidth-rows")
    sizes = rows.groupBy("subject").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("nb"))
    pack = _mapped(lambda a: np.asarray(a, float).tobytes(), "binary")
    dealt = scaling.with_stats(rows, sizes, ["subject"]).withColumn("b", F.pmod(F.xxhash64("v"), F.col("nb")).cast("int"))
    blocks = dealt.groupBy("subject", "b", "nb").agg(F.first(F.size("v")).alias("d"), F.flatten(F.collect_list(F.concat("v", F.array("n")))).alias("r"))
    blocks = written(blocks.select("subject", "b", "nb", "d", pack("r").alias("r")), "bandwidth-blocks")
    middle = sizes.select("subject", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(-1.0).alias("low_rank"), F.lit(-1.0).alias("high_rank"))
    for shift in (2 * PAIR_BITS, PAIR_BITS, 0):
        middle = written(_narrowed(blocks, middle, shift), "bandwidth-middle")
    root = _mapped(lambda bits: float(np.sqrt(np.int64(bits).view(float))), "double")
    found = middle.select("subject", ((root("low") + root("high")) / 2).alias("sf"))
    return sizes.join(found, "subject", "left").select("subject", F.coalesce("sf", F.lit(1.0)).alias("sf"))


def _narrowed(blocks: DataFrame, middle: DataFrame, shift: int) -> DataFrame:
    """``middle`` (subject, low, high, low_rank, high_rank), the keys of the two middle pairs and their ranks among the pairs of that key, by keys of the next bits."""
    names = ["low", "high", "low_rank", "high_rank"]

    def tile(d: pd.DataFrame) -> pd.DataFrame:
        one = d.iloc[0]
        a, b = (np.frombuffer(b"".join(d.r[d.b == at])).reshape(-1, one.d + 1) for at in (one.i, one.j))
        keys, pairs = pair_counts(a, b, {int(one.low), int(one.high)}, shift)
        return pd.DataFrame({"subject": one.subject, "key": keys, "pairs": pairs / 2 if one.i == one.j else pairs})  # a block meets itself from both sides

    def next_keys(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("key")
        key, pairs, out = d.key.to_numpy(), d.pairs.to_numpy(), {"subject": [d.subject.iloc[0]]}
        total = pairs.sum()
        for side, first in (("low", (total - 1) // 2), ("high", total // 2)):
            rank = d[f"{side}_rank"].iloc[0]
            rank = first if rank < 0 else rank
            here = key >> PAIR_BITS == d[side].iloc[0]
            upto = pairs[here].cumsum()
            at = np.searchsorted(upto, rank, "right")
            out |= {side: [key[here][at]], f"{side}_rank": [rank - (upto[at] - pairs[here][at])]}
        return pd.DataFrame(out)[["subject", *names]]

    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")
    tiles = scaling.with_stats(blocks, middle, ["subject"]).select("subject", "b", "d", "r", *names, other)
    tiles = tiles.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("o")
    counts = tiles.groupBy("subject", "i", "j").applyInPandas(tile, "subject string, key long, pairs double")
    counts = written(counts.groupBy("subject", "key").agg(F.sum("pairs").alias("pairs")), "bandwidth-counts")  # at most two prefixes of 2 ** PAIR_BITS keys a subject
    return scaling.with_stats(counts, middle, ["subject"]).groupBy("subject").applyInPandas(next_keys, "subject string, low long, high long, low_rank double, high_rank double")


def factor_rows(u: np.ndarray, pivots: np.ndarray) -> Iterator[np.ndarray]:
    """Rows z, slab by slab, with z z' the kernel exp(-|u - u'|^2 / 2) as far as the pivots span it."""
    square = lambda a, b: np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)
    value, vector = np.linalg.eigh(np.exp(-square(pivots, pivots) / 2))
    half = (vector / np.sqrt(np.maximum(value, 1e-9 * value[-1])))[:, value > 1e-9 * value[-1]]
    for at in range(0, len(u), SLAB):
        yield np.exp(-square(u[at : at + SLAB], pivots) / 2) @ half


def _numbers(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def _mapped(f: Callable, kind: str) -> Callable:
    """``f`` of each value of a column of small models."""
    @F.pandas_udf(kind)
    def each(s: pd.Series) -> pd.Series:
        return s.map(f)

    return each


def _added(parts: DataFrame) -> DataFrame:
    """(subject, s): the sums of the parts' equally long arrays of doubles, added one by one."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for g, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[g] = total.get(g, 0) + np.frombuffer(s)
        for g, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.string()), pa.array([s.tobytes()], pa.binary())], names=["subject", "s"])

    return parts.repartition("subject").mapInArrow(add, "subject string, s binary")


def _over_blocks(blocks: DataFrame, models: DataFrame, run: Callable[[pd.DataFrame, list[np.ndarray]], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` (cells of a block, arrays of the subject's model) for each block whose subject has a model. ``models`` (subject, n_blocks, arrays...)."""
    names = [c for c in models.columns if c not in ("subject", "n_blocks")]
    spread = models.select("subject", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("b"), *names)

    def both(cells: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(cells) or not len(model):
            return pd.DataFrame()
        return run(cells, [np.frombuffer(model[c].iloc[0]) for c in names])

    return blocks.groupBy("subject", "b").cogroup(spread.groupBy("subject", "b")).applyInPandas(both, schema)


def prepared(points: DataFrame, weight: float, seed: int) -> DataFrame:
    """Blocks of cells (subject, b, n_blocks, slice, x, y, h, u): features and places divided by their bandwidths, medians over all pairs of cells."""
    p = points.select(F.col("subject").cast("string").alias("subject"), "slice", "x", "y", "v").withColumn("h", F.xxhash64(F.lit(seed), *CELLS))
    at = p.groupBy("subject", "x", "y").agg(F.count(F.lit(1)).alias("n"))  # bounded by the scanner's grid
    place = at.groupBy("subject").applyInPandas(lambda d: pd.DataFrame({"subject": [d.subject.iloc[0]], "sp": [place_bandwidth(d.x.to_numpy(), d.y.to_numpy(), d.n.to_numpy())]}), "subject string, sp double")
    n = at.groupBy("subject").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("n_blocks"))
    scales = written(feature_bandwidths(p).join(place, "subject").join(n, "subject"), "spectral-scales")
    j = scaling.with_stats(p, scales, ["subject"])
    near = [F.col(c) * (weight**0.5) / F.col("sp") for c in ("x", "y")]
    u = F.concat(F.transform("v", lambda z: z / F.col("sf")), F.array(*near))
    return j.select("subject", F.pmod(F.col("h"), F.col("n_blocks")).cast("int").alias("b"), "n_blocks", "slice", "x", "y", "h", u.alias("u"))


def _pivots(blocks: DataFrame, pending: DataFrame, m: int) -> DataFrame:
    """(subject, n_blocks, m, pivots) of the pending subjects: the first m cells in the order of their hash, taken from the first m of each block."""
    order = Window.partitionBy("subject").orderBy("h", "slice", "x", "y")
    mine = blocks.join(F.broadcast(pending) if pending.count() <= 100_000 else pending, "subject", "left_semi")
    few = mine.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= m)
    rows = few.groupBy("subject", "n_blocks").agg(F.sort_array(F.collect_list(F.struct("h", "slice", "x", "y", "u"))).alias("p"))
    pack = _mapped(lambda a: np.asarray(a, float).tobytes(), "binary")
    return rows.select("subject", "n_blocks", F.size("p").alias("m"), pack(F.flatten(F.transform("p", lambda z: z["u"]))).alias("pivots"))


def factored(blocks: DataFrame, tolerance: float) -> DataFrame:
    """(subject, n_blocks, rest, pivots, total): pivots that leave at most ``tolerance`` of the kernel's trace out, and the sum of Z's rows."""
    dim = len(blocks.select("u").first()["u"]) if blocks.take(1) else 1

    def sums(cells: pd.DataFrame, model: list[np.ndarray]) -> pd.DataFrame:
        total, kept = 0.0, 0.0
        for z in factor_rows(_numbers(cells.u), model[0].reshape(-1, dim)):
            total, kept = total + z.sum(0), kept + float((z * z).sum())
        return pd.DataFrame({"subject": [cells.subject.iloc[0]], "s": [np.concatenate([[len(cells), kept], total]).tobytes()]})

    left_out = _mapped(lambda b: 1 - np.frombuffer(b)[1] / np.frombuffer(b)[0], "double")
    tail = _mapped(lambda b: np.frombuffer(b)[2:].tobytes(), "binary")
    size = _mapped(lambda b: int(np.frombuffer(b)[0]), "long")
    pending, done, m = blocks.select("subject").distinct(), None, PIVOTS
    while True:
        tried = written(_pivots(blocks, pending, m), "spectral-pivots")
        total = _added(_over_blocks(blocks, tried.drop("m"), sums, "subject string, s binary"))
        got = written(tried.join(total, "subject").select("subject", "n_blocks", "m", left_out("s").alias("rest"), size("s").alias("n"), "pivots", tail("s").alias("total")), "spectral-factors")
        ready = (F.col("rest") <= tolerance) | (F.col("m") >= F.col("n"))
        done = got.where(ready) if done is None else done.unionByName(got.where(ready))
        pending = got.where(~ready).select("subject")
        if pending.isEmpty():
            return done.drop("m", "n")
        m *= 2


def embedding(points: DataFrame, k: int, weight: float = 1.0, seed: int = 35, tolerance: float = 0.005) -> DataFrame:
    """(subject, slice, x, y, e): each cell's row of the k leading eigenvectors of the normalised affinity, at length 1, columns by falling eigenvalue.

    The affinity of a cell to itself counts as 0 in the degrees. ``subject`` is text.
    """
    blocks = written(prepared(points, weight, seed), "spectral-blocks")
    if blocks.isEmpty():
        return blocks.select("subject", "slice", "x", "y", F.col("u").alias("e"))
    dim = len(blocks.select("u").first()["u"])
    models = written(factored(blocks, tolerance), "spectral-models")

    def second(cells: pd.DataFrame, model: list[np.ndarray]) -> pd.DataFrame:
        c = 0.0
        for z in factor_rows(_numbers(cells.u), model[0].reshape(-1, dim)):
            c = c + (z / np.maximum(z @ model[1] - 1, 1e-10)[:, None]).T @ z
        return pd.DataFrame({"subject": [cells.subject.iloc[0]], "s": [c.tobytes()]})

    def axes(b: bytes) -> bytes:
        c = np.frombuffer(b)
        value, vector = np.linalg.eigh(c.reshape(int(round(len(c) ** 0.5)), -1))
        value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
        vector = vector * np.where(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])] < 0, -1, 1)
        return (vector / np.sqrt(np.maximum(value, 1e-12))).tobytes()

    shape = models.select("subject", "n_blocks", "pivots", "total")
    spectra = _added(_over_blocks(blocks, shape, second, "subject string, s binary")).select("subject", _mapped(axes, "binary")("s").alias("axes"))
    full = written(shape.join(spectra, "subject"), "spectral-axes")
    kind = dict(blocks.dtypes)

    def project(cells: pd.DataFrame, model: list[np.ndarray]) -> pd.DataFrame:
        pivots, total, ax = model
        rows = []
        for z in factor_rows(_numbers(cells.u), pivots.reshape(-1, dim)):
            e = (z @ ax.reshape(z.shape[1], -1)) / np.sqrt(np.maximum(z @ total - 1, 1e-10))[:, None]
            rows += list(e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-10))
        return cells[CELLS].assign(e=rows)

    return _over_blocks(blocks, full, project, f"subject string, slice {kind['slice']}, x {kind['x']}, y {kind['y']}, e array<double>")


def spectral(points: DataFrame, k: int, weight: float = 1.0, seed: int = 35, tolerance: float = 0.005) -> DataFrame:
    """``points`` (subject, slice, x, y, v) with ``label``."""
    e = written(embedding(points, k, weight, seed, tolerance), "spectral-embedding")
    found = nearest(e.select(F.col("subject").alias("g"), "slice", "x", "y", F.col("e").alias("v")), mixture.kmeans(e.select(F.col("subject").alias("g"), F.col("e").alias("v")), k, seed))
    found = found.select(F.col("g").alias("_g"), *[F.col(c).alias(f"_{c}") for c in CELLS[1:]], "label")
    same = (points["subject"].cast("string") == found["_g"]) & (points["slice"] == found["_slice"]) & (points["x"] == found["_x"]) & (points["y"] == found["_y"])
    return points.join(found, same).select(*[points[c] for c in points.columns], "label")


def nearest(points: DataFrame, centres: dict[str, tuple[np.ndarray, float]]) -> DataFrame:
    """``points`` (g, v, ...) with the number of the nearest of its group's centres."""
    shared = points.sparkSession.sparkContext.broadcast({g: c for g, (c, _) in centres.items()})  # k rows a group, at most mixture.MAX_GROUPS

    @F.pandas_udf("int")
    def label(g: pd.Series, v: pd.Series) -> pd.Series:
        x, out = _numbers(v), np.zeros(len(g), np.int32)
        for name in pd.unique(g):
            here = np.flatnonzero(g.to_numpy() == name)
            out[here] = ((x[here][:, None] - shared.value[name][None]) ** 2).sum(2).argmin(1)
        return pd.Series(out)

    return points.withColumn("label", label("g", "v"))


def choose_k(points: DataFrame, ks: list[int], weight: float = 1.0, seed: int = 35, refs: int = 5, guard: bool = False, tolerance: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """(scores (g, k, silhouette, gap, s), choice (g, elbow, gap_k, k)) per subject, from one embedding whose first k columns serve each k.

    Where the elbow of the silhouette and the gap rule differ, the gap rule decides, or the elbow with ``guard``.
    """
    e = written(embedding(points, max(ks), weight, seed, tolerance), "spectral-shared")
    scores = None
    for k in ks:  # a handful
        p = e.select(F.col("subject").alias("g"), F.slice("e", 1, k).alias("v"))
        centres = {(g, k): c for g, (c, _) in mixture.kmeans(p, k, seed).items()}
        rows = [(g, k, s) for (g, _), s in mixture.silhouettes(p, centres).items()]
        one = p.sparkSession.createDataFrame(rows, "g string, k int, silhouette double").join(inference.gap_statistic(p, [k], refs=refs).select("g", F.col("k").cast("int").alias("k"), "gap", "s"), ["g", "k"])
        scores = one if scores is None else scores.unionByName(one)
    scores = written(scores, "spectral-scores")
    return scores, selection.elbow_or_gap(scores, ["g"], guard)
