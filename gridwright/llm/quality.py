"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (bytes in threes, words, pairs of
words) are fitted: one on target text, that is on labelled rows of good
quality, one on raw text, that is on all documents. A document's log weight is
the mean log ratio of its n-grams under the two, times ``SCALE``: a mean, since
the sum over a long text would drown any noise, and scaled so that the noise
(of a size of about one) reorders documents of like quality. Documents are then
resampled without replacement by Gumbel top-k: of all documents, the k with the
largest log weight (divided by a temperature) plus Gumbel noise stay. k is a
share of the documents that the caller asks for, or else the number of
documents whose log weight is above the cut that parts labelled good from
labelled poor rows best, measured on labelled rows that no model was fitted on.
A share within the good documents, or a temperature of some size, lets noise
decide among many; the query and the pipeline, which must keep clean documents,
take the cut and a temperature of 1.

Ratios are kept in steps of 2**-16 as integers, so that sums don't depend on
order. The kth largest score is found by counting 16 bits at a time; neither
documents nor scores go to the driver. Models have a fixed size and are
broadcast.

Defined results
---------------
* Null or empty text, and text without n-grams: log weight 0.
* No labelled good row: log weight 0 for all, all kept. No labelled poor row:
  nothing to cut by, all kept.
* Rows that tie with the kth are kept. Noise depends on id and seed alone, so
  repeated rows and reruns get equal results. Labels for unknown ids, null
  labels and repeated labels do no harm; an id with both labels has none.
* :func:`resample` returns whole input rows as the struct ``row``, so that
  extra columns of any name pass; text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, release, seeded_uniform, table, text_batches, tidy, whole_rows
from ._text import CHUNK, LOWER, mix, utf8, word_hashes

BUCKETS = 1 << 17
#: Labelled rows of each kind that are used, as an expected number; ``FIT_SHARE`` of them for the model, the rest for the cut.
FIT_ROWS, FIT_SHARE = 20_000, 0.8
#: Log weights are mean log ratios times this.
SCALE = 200.0
SEED = 11
_SAME = np.uint64(0x5A4E)
_STEP = 1 << 16
_EDGE, _CELL = 1000.0, 0.25


@dataclass
class Model:
    """``ratio`` in steps of 2**-16 per bucket, and the log weight that parts good from poor."""

    ratio: np.ndarray
    cut: float


def _buckets(h: np.ndarray) -> np.ndarray:
    return (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text i, buckets, lo, hi): text i + j owns the n-grams lo[j] to hi[j] - 1 of ``buckets``, in parts of bounded size."""

    def parts(n: int, at: np.ndarray, hashes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        last = np.maximum(at[1:] - n + 1, at[:-1])  # after the last n-gram of each text
        for start in range(0, int(at[-1]), CHUNK):
            stop = min(start + CHUNK, int(at[-1]) - n + 1)
            if stop <= start:
                return
            i, j = int(np.searchsorted(at, start, "right")) - 1, int(np.searchsorted(at, stop, "left"))
            lo = np.clip(at[i:j], start, stop)
            yield i, _buckets(hashes(start, stop)), lo - start, np.maximum(np.clip(last[i:j], start, stop), lo) - start

    data, at = utf8(texts)

    def three(a: int, b: int) -> np.ndarray:
        x = LOWER[data[a : b + 2]].astype(np.uint64)
        return (x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:] | np.uint64(1 << 24)

    yield from parts(3, at, three)
    w, at = word_hashes(texts)

    def two(a: int, b: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.where(w[a + 1 : b + 1] == w[a:b], _SAME, w[a:b] * np.uint64(0xD6E8FEB86659FD93) + w[a + 1 : b + 1])

    yield from parts(1, at, lambda a, b: w[a:b] ^ np.uint64(1))
    yield from parts(2, at, two)


def counts(texts: pa.Array) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for _, buckets, lo, hi in _grams(texts):
        inside = np.zeros(len(buckets) + 1, np.int8)
        np.add.at(inside, lo, 1)
        np.subtract.at(inside, hi, 1)
        out += np.bincount(buckets[np.cumsum(inside[:-1]) > 0], minlength=BUCKETS)
    return out


def log_weights(texts: pa.Array, ratio: np.ndarray) -> np.ndarray:
    total, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, buckets, lo, hi in _grams(texts):
        upto = np.zeros(len(buckets) + 1, np.int64)
        np.cumsum(ratio[buckets], out=upto[1:])
        total[i : i + len(lo)] += upto[hi] - upto[lo]
        n[i : i + len(lo)] += hi - lo
    return SCALE / _STEP * (total / np.maximum(n, 1))


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Steps of log(p target / p raw); counts are scaled to the same sum, so that an unseen n-gram weighs nothing."""
    n = min(target.sum(), raw.sum())
    p, q = target * (n / target.sum()) + 1.0, raw * (n / raw.sum()) + 1.0
    return np.round((np.log(p) - np.log(q)) * _STEP).astype(np.int32)


def best_cut(cells: dict[tuple[bool, int], int]) -> float:
    """The log weight with the least sum of (good below, poor above), as shares; the middle if several are."""
    places = sorted({c for _, c in cells})
    good, poor = (sum(n for (k, _), n in cells.items() if k is kind) for kind in (True, False))
    if not good or not poor:
        return -np.inf
    best, lost, rest = (np.inf, 0, 0), 0, poor
    for i, c in enumerate(places):
        lost += cells.get((True, c), 0)
        rest -= cells.get((False, c), 0)
        after = places[i + 1] if i + 1 < len(places) else c + 1
        best = min(best, (lost / good + rest / poor, c, after), key=lambda x: x[0])
    return _CELL * (best[1] + 1 + best[2]) / 2


def _weigh(ratio):
    @F.arrow_udf("double")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield pa.array(log_weights(texts, ratio.value))
        finally:
            release()

    return weigh


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seed: int = SEED) -> Model | None:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, target boolean); None without labelled good text."""
    spark = docs.sparkSession
    text_batches(spark)
    labels = labels.where("doc_id is not null and target is not null").groupBy("doc_id").agg(F.min("target").alias("target"), F.max("target").alias("most"))
    labels = labels.where("target = most").select("doc_id", "target")
    sizes = {r["target"]: r["count"] for r in labels.groupBy("target").count().collect()}
    if True not in sizes:
        return None
    share = F.when(F.col("target"), min(1.0, rows / sizes[True])).otherwise(min(1.0, rows / sizes.get(False, 1)))
    u = seeded_uniform(seed, F.col("doc_id"))
    chosen = materialize(labels.where(u < share).select("doc_id", "target", (u < share * FIT_SHARE).alias("fit")), "quality-labels")  # about 2 * rows ids
    texts = docs.join(F.broadcast(chosen), "doc_id", "left").where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            sums[0] += counts(batch.column(1))
            good = np.asarray(batch.column(0).fill_null(False).to_numpy(zero_copy_only=False), bool)
            if good.any():
                sums[1] += counts(batch.column(1).filter(pa.array(good)))
        yield packed(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for c in batch.column(0).to_pylist():
                sums += np.frombuffer(c, np.int64).reshape(2, BUCKETS)
        yield packed(sums)

    def packed(sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], names=["c"])

    part = texts.select((F.col("target") & F.col("fit")).alias("t"), "text").mapInArrow(tidy(count), "c binary")
    found = part.repartition(4).mapInArrow(tidy(add), "c binary").collect()  # 4 rows of a fixed size
    raw, target = sum(np.frombuffer(r["c"], np.int64).reshape(2, BUCKETS) for r in found)
    if not target.sum():
        return None
    ratio = log_ratio(target, raw)
    rest = texts.where("not fit").select("target", _weigh(spark.sparkContext.broadcast(ratio))("text").alias("w"))
    place = F.floor(F.greatest(F.lit(-_EDGE), F.least(F.lit(_EDGE), F.col("w"))) / _CELL).cast("int")
    cells = {(r["target"], r["place"]): r["count"] for r in rest.groupBy("target", place.alias("place")).count().collect()}  # a bounded number of places
    return Model(ratio, best_cut(cells))


def resample(docs: DataFrame, model: Model | None, seed: int = SEED, name: str = "quality", share: float | None = None, temperature: float = 1.0) -> DataFrame:
    """(row, log_weight, perturbed, kept) for each row of ``docs`` (doc_id, text, ...); ``share`` of them stay, or those above the cut.

    Only weights are written; where a row is read, its text is weighed once more, which takes less than a copy of all texts on disk.
    """
    return _chosen(whole_rows(docs, "doc_id", "text"), model, seed, name, "row", share=share, temperature=temperature)


def _chosen(docs: DataFrame, model: Model | None, seed: int, name: str, *cols: str, share: float | None = None, temperature: float = 1.0) -> DataFrame:
    spark = docs.sparkSession
    text_batches(spark)
    if model is None:
        zero = F.lit(0.0)
        return docs.select(*cols, zero.alias("log_weight"), zero.alias("perturbed"), F.lit(True).alias("kept"))
    weigh = _weigh(spark.sparkContext.broadcast(model.ratio))
    noise = -F.log(-F.log(seeded_uniform(seed + 1, F.col("doc_id"))))
    scored = docs.select(*cols, weigh("text").alias("log_weight"), noise.alias("noise"))
    whole = "row" in cols
    weights = materialize(scored.select("log_weight", "noise") if whole else scored, f"{name}-weights")
    perturbed = F.col("log_weight") / temperature + F.col("noise")
    k = weights.where(F.col("log_weight") >= float(model.cut)).count() if share is None else round(share * weights.count())
    least = kth_largest(weights.select(_key(perturbed).alias("key")), k)
    scored = (scored if whole else weights).withColumn("perturbed", perturbed).drop("noise")
    return scored.withColumn("kept", _key(F.col("perturbed")) >= least)


def _key(score):
    """The score in steps of 2**-20, as a long without sign."""
    return (F.floor(score * (1 << 20)) + F.lit(1 << 60)).cast("long")


def kth_largest(keys: DataFrame, k: int) -> int:
    """The kth largest of the column ``key`` (0 .. 2**62), 16 bits a round; at most 65536 counts a round go to the driver."""
    prefix = 0
    if k <= 0:
        return 1 << 62
    for shift in (48, 32, 16, 0):
        here = keys.where(F.shiftright("key", shift + 16) == prefix) if shift < 48 else keys
        found = here.groupBy(F.shiftright("key", shift).alias("p")).count().collect()
        for p, n in sorted(((r["p"], r["count"]) for r in found), reverse=True):
            if n >= k:
                prefix = p
                break
            k -= n
        else:
            return 0
    return prefix


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("target"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _chosen(docs, fit(docs, good_labels(spark, sf_dir)), SEED, "quality", "doc_id")
