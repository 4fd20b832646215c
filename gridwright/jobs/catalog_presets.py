"""Queries of the presets: every supplier is a subject, whose key says its preset and place."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from . import presets
from .catalog import query, r

_NAMES = list(presets.PRESETS)
_PRESET_SQL = ", ".join(f"({i}, '{n}', {float(radius)}, {slices})" for i, (n, (radius, slices, _, _)) in enumerate(presets.PRESETS.items()))
_SEED_SQL = ", ".join(f"('{n}', {i}, '{t}', {x}, {y}, {s}, {w})" for n, (_, _, _, seeds) in presets.PRESETS.items() for i, (t, x, y, s, w) in enumerate(seeds))
_PLACED = f"""pre AS (SELECT * FROM (VALUES {_PRESET_SQL}) AS p(i, preset, radius, slices)), seed AS (SELECT * FROM (VALUES {_SEED_SQL}) AS s(preset, place, type, sx, sy, sigma, weight)),
 who AS (SELECT s_suppkey AS subject, preset, radius, slices, 69.76 + (s_suppkey * 7919 % 1000) / 1000 * 12 - 6 AS cx, 69.76 + (s_suppkey * 104729 % 1000) / 1000 * 12 - 6 AS cy,
  s_nationkey / 25 * 0.18 AS el, (s_suppkey * 31 % 100) / 100 * {math.pi} AS angle, 42.24 + (s_suppkey * 104729 % 1000) / 1000 * 8 - 4 AS rx, 67.84 + (s_suppkey * 7919 % 1000) / 1000 * 8 - 4 AS ry FROM supplier JOIN pre ON s_suppkey % 7 = i),
 sl AS (SELECT *, greatest(sin(((slice - 1) / greatest(slices - 1, 1) * 0.8 + 0.1) * {math.pi}), {presets.LEAST_SCALE}) AS scale FROM (SELECT *, unnest(range(1, slices + 1)) AS slice FROM who)),
 grid AS (SELECT a.i AS x, b.i AS y FROM range(1, 129) a(i), range(1, 129) b(i)),
 tum AS (SELECT subject, preset, slice, x, y, radius, x - cx AS dx, y - cy AS dy FROM sl JOIN grid ON abs(x - cx) <= 40 AND abs(y - cy) <= 40
  WHERE (((x - cx) * cos(angle) + (y - cy) * sin(angle)) / (radius * (1 + el) * scale)) ** 2 + (((y - cy) * cos(angle) - (x - cx) * sin(angle)) / (radius * (1 - el) * scale)) ** 2 <= 1),
 ref AS (SELECT subject, preset, slice, x, y FROM sl JOIN grid ON (x - rx) ** 2 + (y - ry) ** 2 <= {presets.REFERENCE_RADIUS ** 2}),
 lw AS (SELECT subject, t.preset, slice, x, y, type, place, ln(weight) - ((dx - sx * radius) ** 2 + (dy - sy * radius) ** 2) / (2 * (sigma * radius) ** 2) AS l FROM tum t JOIN seed s ON s.preset = t.preset),
 ew AS (SELECT *, exp(l - max(l) OVER (PARTITION BY subject, slice, x, y)) AS e FROM lw), tw AS (SELECT subject, preset, slice, x, y, type, min(place) AS place, sum(e) AS w FROM ew GROUP BY ALL),
 dom AS (SELECT subject, preset, slice, x, y, arg_min(type, (-w, place)) AS truth, max(w) / sum(w) AS confidence FROM tw GROUP BY ALL)"""


def subjects(spark, sf_dir):
    """A subject per supplier; places follow from the key, so that SQL can say them, too."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("subject"), "s_nationkey")
    first, second = F.col("subject") * 7919 % 1000 / 1000, F.col("subject") * 104729 % 1000 / 1000
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("subject") % 7 + 1).cast("int"))
    return s.select("subject", name.alias("preset"), (F.lit(69.76) + first * 12 - 6).alias("cx"), (F.lit(69.76) + second * 12 - 6).alias("cy"), (F.col("s_nationkey") / 25 * 0.18).alias("elliptic"),
                    (F.col("subject") * 31 % 100 / 100 * math.pi).alias("angle"), (F.lit(42.24) + second * 8 - 4).alias("rx"), (F.lit(67.84) + first * 8 - 4).alias("ry"))


@query("d4_preset_truth", f"WITH {_PLACED} SELECT subject, preset, truth, count(*) AS n, {r('avg(confidence)')} AS confidence FROM dom GROUP BY ALL UNION ALL SELECT subject, preset, 'contralateral', count(*), 1.0 FROM ref GROUP BY ALL", cells=False)
def d4(spark, sf_dir):
    """Cells of each subject by planted type, the reference tissue included."""
    who = subjects(spark, sf_dir)
    both = presets.tumour_cells(who).drop("bio").unionByName(presets.reference_cells(who).drop("bio"))
    return both.groupBy("subject", "preset", "truth").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))
