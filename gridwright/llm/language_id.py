"""Language identification: multinomial naive Bayes on hashed character n-grams.

Training counts n-grams of labelled texts per language inside the tasks, so
what leaves a task is one row of counts per language, never texts. The
log-probability matrix (languages x 2**16 buckets of float32) has a fixed size
per language and is broadcast; scoring turns a batch of texts into a sparse
matrix of their n-grams' buckets and multiplies it with the broadcast one in
numpy. Log probabilities are kept in steps of 2**-16, so that sums are exact in
any order.

Defined results
---------------
* Text null, empty or without a letter: ``und`` with score 0.
* No labelled training row at all: ``und`` with score 0 for every text.
* Labels that are null are not learned; repeated rows count as often as they
  occur; ties go to the language that sorts first.
* Whole texts are read, in windows of ``_WINDOW`` characters that overlap by
  n - 1, so very long texts need no more memory than short ones.
* :func:`identify` returns whole input rows as the struct ``row``, so that
  columns of any name pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import release, seeded_uniform, table, text_batches, tidy, whole_rows
from ._text import mix

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows of a language used for training, as an expected number: of a
#: language with more, a hash of the id chooses that share.
ROWS_PER_LANGUAGE = 20_000
#: More labels than this mean that the column does not hold languages.
MAX_LANGUAGES = 2_000
_WINDOW = 1 << 15
_STEP = float(1 << 16)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, and where each begins; runs of anything but letters, and each beginning, are one blank."""
    low = [" " + t.lower() for t in texts]
    at = np.cumsum([0, *map(len, low)])
    a = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (a >= 97) & (a <= 122) | (a > 127)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[at[:-1]] = True
    return np.where(letter, a, np.uint32(32))[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def sparse_rows(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The sparse matrix of a batch (texts by buckets) in parts of bounded size: (first text i, buckets, starts).

    Text i + j has the n-grams starts[j] to starts[j + 1] - 1 of ``buckets``; ``BUCKETS`` stands for none.
    """
    a, at = _codes(texts)
    ends = np.repeat(at[1:], np.diff(at))
    for start in range(0, len(a), _WINDOW):
        stop = min(start + _WINDOW, len(a))
        w = a[start : stop + max(ORDERS) - 1].astype(np.uint64)
        room = ends[start:stop] - np.arange(start, stop)  # code points from here to the text's end
        h = np.zeros(len(w), np.uint64)
        own = np.full((stop - start, len(ORDERS)), BUCKETS, np.int32)
        for n in range(1, max(ORDERS) + 1):
            h = h[: len(w) - n + 1] * np.uint64(0x100000001B3) + w[n - 1 :]
            if n in ORDERS:
                fits = np.flatnonzero(room >= n)
                own[fits, ORDERS.index(n)] = (mix(h[fits] + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int32)
        i, j = int(np.searchsorted(at, start, "right")) - 1, int(np.searchsorted(at, stop, "left"))
        yield i, own.ravel(), (np.maximum(at[i:j], start) - start) * len(ORDERS)


def batch_counts(texts: list[str]) -> np.ndarray:
    """How often each bucket occurs in all texts."""
    out = np.zeros(BUCKETS + 1, np.int64)
    for _, buckets, _ in sparse_rows(texts):
        out += np.bincount(buckets, minlength=BUCKETS + 1)
    return out[:BUCKETS]


def log_likelihoods(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Texts by languages: prior plus the sparse rows times the matrix ``model`` (languages by buckets, prior last)."""
    by_bucket = np.ascontiguousarray(np.concatenate([model[:, :-1], np.zeros((len(model), 1), model.dtype)], 1).T)
    out = np.tile(model[:, -1].astype(np.float64), (len(texts), 1))
    for i, buckets, starts in sparse_rows(texts):
        out[i : i + len(starts)] += np.add.reduceat(by_bucket[buckets], starts, axis=0, dtype=np.float64)
    return out


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5,
        rows_per_language: int = ROWS_PER_LANGUAGE, seed: int = 1) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their matrix of log probabilities, prior in the last column."""
    train = train.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    train = train.where("l is not null and t is not null")
    sizes = train.groupBy("l").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values")
    if not sizes:
        return [], np.zeros((0, BUCKETS + 1), np.float32)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["l"], min(1.0, rows_per_language / r["count"]))])
    text_batches(train.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                sums[lang] = sums.get(lang, 0) + batch_counts(own)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()])], names=["l", "c"])

    # a task leaves one row per language; adding the rows of a language runs in blocks of tasks
    picked = train.where(seeded_uniform(seed, F.col("i")) < share[F.col("l")])
    part = picked.select("l", "t").mapInArrow(tidy(count), "l string, c binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(c, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()])], names=["l", "c"])

    rows = part.repartition(8).mapInArrow(tidy(add), "l string, c binary").collect()  # at most 8 rows per language
    langs = sorted({r["l"] for r in rows})
    docs = {r["l"]: r["count"] for r in sizes}
    counts = np.zeros((len(langs), BUCKETS))
    for r in rows:
        counts[langs.index(r["l"])] += np.frombuffer(r["c"], np.int64)
    p = counts + smoothing
    model = np.log(p / p.sum(1, keepdims=True))
    prior = np.log(np.array([docs[x] for x in langs], float) / sum(docs[x] for x in langs))
    return langs, (np.round(np.concatenate([model, prior[:, None]], 1) * _STEP) / _STEP).astype(np.float32)


def identify(df: DataFrame, langs: list[str], model: np.ndarray, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score): each whole row of ``df``, its language and the posterior of that, 0 to 1."""
    spark = df.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast((langs, model))
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, matrix = shared.value
        try:
            for batch in batches:
                texts = batch.to_pylist()
                out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
                ask = [i for i, t in enumerate(texts) if names and t and has_letter(t)]
                if ask:
                    ll = log_likelihoods([texts[i] for i in ask], matrix)
                    best = ll.argmax(1)
                    score = 1 / np.exp(ll - ll.max(1, keepdims=True)).sum(1)
                    for i, b, x in zip(ask, best.tolist(), score.tolist(), strict=True):
                        out[i] = names[b], x
                yield pa.array([{"lang_pred": p, "score": x} for p, x in out], kind)
        finally:
            release()

    rows = whole_rows(df).withColumn("p", predict(F.col(f"row.`{text_col}`")))
    return rows.select("row", F.col("p.lang_pred").alias("lang_pred"), F.col("p.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    langs, model = fit(docs.where("not held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), langs, model).select("row.doc_id", "row.held_out", "lang_pred", "score")
