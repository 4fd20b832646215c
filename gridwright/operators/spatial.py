"""Operators on the cell grid of each (subject, slice)."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles

SLICE = ["subject", "slice"]

# Cost of a boundary between two families, either way round; none where a pair is not named.
PENALTIES = {
    ("Necrosis", "Bulk tumor"): 2.0, ("Necrosis", "Cellular/proliferative"): 5.0, ("Necrosis", "Infiltrative"): 10.0,
    ("Hypoxic/vascular", "Cellular/proliferative"): 2.0, ("Hypoxic/vascular", "Infiltrative"): 8.0, ("Bulk tumor", "Infiltrative"): 2.0,
}


def transition_penalty(a: Column, b: Column) -> Column:
    pairs = [(F.least(F.lit(x), F.lit(y)), F.greatest(F.lit(x), F.lit(y)), p) for (x, y), p in PENALTIES.items()]
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.coalesce(*[F.when((lo == x) & (hi == y), F.lit(p)) for x, y, p in pairs], F.lit(0.0))


def neighbour_pairs(cells: DataFrame, value: str = "habitat") -> DataFrame:
    """Cells with their right and lower neighbour's value: each 4-neighbour pair once.

    One equi-join on the shifted key; the key holds the coordinates, so a
    slice of any size is spread over all tasks.
    """
    key = [*SLICE, "x", "y"]
    here = cells.select(*key, F.col(value).alias("own"))
    shifts = F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))
    reach = here.select(*key, "own", F.inline(shifts)).select(*SLICE, F.col("x").alias("x0"), F.col("y").alias("y0"), "own", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    return reach.join(here.select(*key, F.col("own").alias("other")), key)


def boundaries(cells: DataFrame, value: str = "habitat") -> DataFrame:
    """Number of neighbour pairs per slice, and how many join different values."""
    p = neighbour_pairs(cells, value)
    return p.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("own") != F.col("other")).alias("n_boundary"))


def neighbours(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[cell, right / left / below / above]: the row of that neighbour, -1 where there is none; cells are all different and in (y, x) order."""
    wide = int(np.ptp(x)) + 3 if len(x) else 3
    key = (y - y.min(initial=0)).astype(np.int64) * wide + (x - x.min(initial=0)) + 1
    near = np.full((len(x), 4), -1)
    for i, step in enumerate((1, -1, wide, -wide)):
        at = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
        near[:, i] = np.where(key[at] == key + step, at, -1)
    return near


def connected(near: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The first cell of each cell's component of equal values: roots are hooked onto smaller ones and pointers halved until all agree."""
    root = np.arange(len(value))
    a = np.concatenate([np.flatnonzero(near[:, i] >= 0) for i in (0, 2)])
    b = np.concatenate([near[near[:, i] >= 0, i] for i in (0, 2)])
    a, b = a[value[a] == value[b]], b[value[a] == value[b]]
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def components(cells: DataFrame, value: str = "habitat") -> DataFrame:
    """4-connected components per slice and value: one row per component (n, first cell).

    Slices are bounded by the scanner's grid, so one task labels a whole slice.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["x", "y"]).sort_values(["y", "x"], kind="stable").reset_index(drop=True)
        top = connected(neighbours(pdf.x.to_numpy(np.int64), pdf.y.to_numpy(np.int64)), pd.factorize(pdf[value])[0])
        first, n = np.unique(top, return_counts=True)
        return pdf.iloc[first].assign(n=n)[["subject", "slice", value, "n", "x", "y"]]

    kind = dict(cells.dtypes)
    schema = f"subject {kind['subject']}, slice {kind['slice']}, {value} {kind[value]}, n long, x {kind['x']}, y {kind['y']}"
    return cells.select(*SLICE, "x", "y", value).groupBy(*SLICE).applyInPandas(run, schema)


def coherence(cells: DataFrame, value: str = "habitat", micro: int = 20) -> DataFrame:
    """Per value and slice: number of components, the largest, and the micro components with their cells."""
    c = components(cells, value)
    small = F.col("n") < micro
    return c.groupBy(*SLICE, value).agg(
        F.count(F.lit(1)).alias("n_components"), F.max("n").alias("max_size"), F.count_if(small).alias("n_micro"), F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("micro_cells"))


def squared_distances(seeds: np.ndarray) -> np.ndarray:
    """Squared distance of each place of a grid to the nearest True, first along columns, then along rows.

    One pass per column for the distance within it; then the least of distance within the column plus squared
    difference of the columns, all rows at once.
    """
    far = sum(seeds.shape)
    up = np.full(seeds.shape, far, np.int64)
    gap = np.full(seeds.shape[1], far)
    for order in (range(len(seeds)), range(len(seeds) - 1, -1, -1)):
        gap[:] = far
        for i in order:
            gap = np.where(seeds[i], 0, gap + 1)
            up[i] = np.minimum(up[i], gap)
    up = up * up
    at = np.arange(seeds.shape[1])
    out = np.empty(seeds.shape, np.int64)
    for j in at:
        out[:, j] = (up + (at - j) ** 2).min(1)
    return out


def seed_distance(cells: DataFrame, is_seed: Column) -> DataFrame:
    """Adds ``distance`` to the nearest seed of the slice (NULL without seeds) and ``d_norm``, divided by the subject's largest.

    An exact distance transform per slice in two linear passes: slices, and so
    memory, are bounded by the scanner's grid.
    """
    kind = dict(cells.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, seed = pdf.x.to_numpy(np.int64), pdf.y.to_numpy(np.int64), pdf.seed.to_numpy(bool)
        out = np.full(len(pdf), np.nan)
        if seed.any():
            col, row = x - x.min(), y - y.min()
            grid = np.zeros((row.max() + 1, col.max() + 1), bool)
            grid[row[seed], col[seed]] = True
            out = np.sqrt(squared_distances(grid))[row, col]
        return pd.DataFrame({"subject": pdf.subject, "slice": pdf.slice, "x": pdf.x, "y": pdf.y, "distance": out})

    schema = f"subject {kind['subject']}, slice {kind['slice']}, x {kind['x']}, y {kind['y']}, distance double"
    d = cells.select(*SLICE, "x", "y", is_seed.alias("seed")).groupBy(*SLICE).applyInPandas(run, schema)
    d = d.withColumn("distance", F.nanvl("distance", F.lit(None).cast("double")))
    most = d.groupBy("subject").agg(F.max("distance").alias("most"))
    return d.join(most, "subject").withColumn("d_norm", F.when(F.col("most") > 0, F.col("distance") / F.col("most")).otherwise(F.col("distance"))).drop("most")


def zone_distance(cells: DataFrame, core: list[int], value: str = "habitat") -> DataFrame:
    """Distance to the zone that several habitats form."""
    return seed_distance(cells, F.col(value).isin(*core))


def joint_distance(cells: DataFrame, necrotic: int, least_share: float = 0.05, value: str = "habitat") -> DataFrame:
    """(subject, slice, x, y, included, d_scaled): distance to the necrotic habitat, scaled by the subject's median and spread.

    0 for subjects with too little of it and for slices without any.
    """
    share = cells.groupBy("subject").agg((F.count_if(F.col(value) == necrotic) / F.count(F.lit(1)) >= least_share).alias("included"))
    d = seed_distance(cells, F.col(value) == necrotic)
    q = quantiles.median_iqr(d.where("d_norm is not null"), ["subject"], "d_norm")
    j = d.join(share, "subject").join(q.select("subject", "median", "iqr"), "subject", "left")
    scaled = F.when(F.col("included") & F.col("d_norm").isNotNull(), (F.col("d_norm") - F.col("median")) / F.greatest("iqr", F.lit(1e-8))).otherwise(0.0)
    return j.select(*SLICE, "x", "y", "included", scaled.alias("d_scaled"))


def rasterised(cells: DataFrame) -> DataFrame:
    """Row and column in the slice's bounding box."""
    box = cells.groupBy(*SLICE).agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    return cells.join(box, SLICE).withColumns({"row": F.col("y") - F.col("y0"), "col": F.col("x") - F.col("x0")}).drop("x0", "y0")


def anchors(cells: DataFrame, value: str = "habitat", least: int = 3) -> DataFrame:
    """Mean position of each value in a slice with at least ``least`` cells."""
    return cells.groupBy(*SLICE, value).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def family_penalties(families: dict[int, str]) -> dict[tuple[int, int], float]:
    """Cost of a boundary between two habitats, from their families."""
    cost = PENALTIES | {(b, a): p for (a, b), p in PENALTIES.items()}
    return {(i, j): cost.get((a, b), 0.0) for i, a in families.items() for j, b in families.items()}


def settled(x: np.ndarray, y: np.ndarray, labels: np.ndarray, proba: np.ndarray, penalty: dict[tuple[int, int], float], weight: float, sure: float, sweeps: int) -> np.ndarray:
    """Labels of a slice's cells, in (y, x) order, after the sweeps.

    A cell's upper and left neighbours lie on the diagonal before its own and the others on the one after it, so a
    whole diagonal can be visited at once and gives what visiting cell after cell gives.
    """
    labels = labels.copy()
    k = proba.shape[1]
    cost = np.zeros((k, max(k, labels.max(initial=0) + 1) + 1))  # the last column is for places without a neighbour
    for (i, j), p in penalty.items():
        if i < k and j < cost.shape[1] - 1:
            cost[i, j] = p
    near = neighbours(x, y)
    own = -np.log(np.maximum(proba, 1e-10))
    order = np.argsort(x + y, kind="stable")
    fronts = np.split(order, np.flatnonzero(np.diff((x + y)[order])) + 1)
    for _ in range(sweeps):
        changed = False
        for front in fronts:
            beside = np.where(near[front] >= 0, labels[near[front]], -1)
            here = labels[front]
            chance = np.where(here < k, proba[front, np.minimum(here, k - 1)], 0.0)
            ask = (beside >= 0).any(1) & ((chance < sure) | ((beside >= 0) & (beside != here[:, None])).any(1))
            front, beside = front[ask], beside[ask]
            best = (own[front] + weight * cost[:, beside].sum(2).T).argmin(1)
            changed |= bool((best != labels[front]).any())
            labels[front] = best
        if not changed:
            break
    return labels


def smooth(cells: DataFrame, penalty: dict[tuple[int, int], float], weight: float = 0.3, sure: float = 0.65, sweeps: int = 5) -> DataFrame:
    """Iterated conditional modes per slice on cells (subject, slice, x, y, habitat, proba): adds ``smoothed``.

    Cells whose own label is less probable than ``sure``, or that have an unlike neighbour, are visited in (y, x)
    order, in place, until a sweep changes nothing; cells without neighbours keep their label. Neighbours never
    cross slices, so slices are independent. Cells of a slice must be different.
    """
    kind = dict(cells.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable").reset_index(drop=True)
        at = [pdf[c].to_numpy(np.int64) for c in ("x", "y", "habitat")]
        return pdf[["subject", "slice", "x", "y", "habitat"]].assign(smoothed=settled(*at, np.array(pdf.proba.tolist(), float), penalty, weight, sure, sweeps))

    schema = f"subject {kind['subject']}, slice {kind['slice']}, x {kind['x']}, y {kind['y']}, habitat {kind['habitat']}, smoothed int"
    return cells.select(*SLICE, "x", "y", "habitat", "proba").groupBy(*SLICE).applyInPandas(run, schema)
