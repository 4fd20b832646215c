"""Scoring of cells that arrive as a stream, with a frozen model.

The expressions are those of the batch scorer, so a stream gives each cell
what a batch over the same cells gives; a count per subject and event-time
window follows late data up to the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import descriptors, mixture
from ..sources import results


def scaled(cells: DataFrame, params: list[str], stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds v: the parameters under frozen (centre, spread), missing ones at their centre."""
    v = [F.when(F.lit(stats[p][1]) == 0, 0.0).otherwise((F.coalesce(F.col(f"`{p}`"), F.lit(stats[p][0])) - stats[p][0]) / (stats[p][1] or 1.0)) for p in params]
    return cells.withColumn("v", F.array(*v))


def score(cells: DataFrame, params: list[str], stats: dict[str, tuple[float, float]], model: list[list[float]]) -> DataFrame:
    """Scales the parameters by frozen (centre, spread) and assigns each cell to a centroid of ``model``."""
    return descriptors.assign(scaled(cells, params, stats), model)


def score_by_atlas(cells: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """Scores cells by the stored atlas at ``path``, with its own parameters and scaling; the version is fixed when the stream starts."""
    model, params, stats = results.read_atlas(cells.sparkSession, path, version)
    return mixture.score(scaled(cells, params, stats or dict.fromkeys(params, (0.0, 1.0))), model)


def shares_by_window(scored: DataFrame, time: str, window: str = "10 minutes", lateness: str = "30 minutes") -> DataFrame:
    """Cells and mean confidence per window, subject and label; rows later than ``lateness`` are left out."""
    return scored.withWatermark(time, lateness).groupBy(F.window(time, window), "subject", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))
