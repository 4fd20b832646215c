"""Phrases whose words come together oftener than their parts suggest, per language.

Every word starts one window: itself and the two words after it within its
piece, as lead columns, padded at the piece's end. Only these longest windows
are counted. Since each place starts exactly one window, the count of a shorter
phrase is the sum over the windows that begin with it, so one ROLLUP over the
counted windows gives the counts of all words, pairs and triples, and of all
words of a language.

Windows are counted in each task, FLUSH at a time, and leave it as one
compressed block for each language and bucket, so a frequent window leaves it
once. Buckets are dealt by the first word; words that begin more windows than a
bucket should hold are dealt by the second word as well, and such pairs by the
third. A bucket adds its windows up; what is too rare to be a part of any
candidate (triples, then pairs, then words) is added up under its prefix, since
it counts for the sums of its prefixes only. The ROLLUP gets the rest.

Defined results
---------------
* Text null or empty: no words. Language null: ``und``.
* Repeated rows count again, an empty table gives an empty result, extra
  columns are ignored.
* Phrases have 2 or 3 words: the windows' length. Counts are exact, products
  are decimals of up to 38 digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, release, seeded_uniform, table, text_batches, tidy
from ._text import LOWER, mix, utf8

LEAST, INSIDE_PERCENT, TOP = 10, 50, 2000
#: Windows that a task counts at a time (below 2**21, so that three codes fit 63 bits), and those of a bucket, about.
FLUSH, BUCKET = 1_500_000, 1_000_000
#: Documents (as an expected number) from which the number of windows and the hot words and pairs are estimated: those that begin more
#: than a bucket's share of all windows, or 1 / HOT of them. It has influence on where windows are added up, not on the counts.
#: So a bucket holds about BUCKET windows, or the HOT-th part of all if that is more.
SAMPLE_ROWS, HOT = 4000, 50_000
#: Buckets of a language's phrases in which the first ones are found before they meet.
RANK_BUCKETS = 64
#: Stands for what was added up under its prefix; a word never holds a blank.
RARE = " "

# 0: part of a word, 1: parts words, 2: parts pieces
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_BITS = 21


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words of a batch, A-Z lower-cased; the text of each; whether the next one is in the same piece)."""
    data, at = utf8(texts)
    kind = _KIND[data]
    word = kind == 0
    begins = np.zeros(len(data) + 1, bool)  # of texts
    begins[at] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | begins[1:-1]
    starts = np.flatnonzero(first)
    chars = LOWER[data[word]]
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(word, out=upto[1:])
    offsets = np.append(upto[starts], len(chars))  # words without what parts them
    text = np.searchsorted(at, starts, "right") - 1
    piece = np.cumsum(kind == 2)[starts] if len(data) else starts
    goes_on = np.zeros(len(starts), bool)
    goes_on[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(chars)]), text, goes_on


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """(lang, names, windows, counts) of FLUSH words at a time: different windows as three codes of ``names``, whose last, empty one is the padding."""

    def flush() -> Iterator[tuple]:
        found = pa.concat_arrays([w for w, _, _ in held]).dictionary_encode()
        names = [*found.dictionary.to_pylist(), b""]
        goes_on = np.concatenate([g for _, _, g in held])
        langs = pa.concat_arrays([x for _, x, _ in held]).dictionary_encode()
        pad = np.int64(len(names) - 1)
        one = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        two, three = np.append(one[1:], pad), np.append(one[2:], [pad, pad])[: len(one)]
        two[~goes_on] = pad
        three[~goes_on | ~np.append(goes_on[1:], False)] = pad
        key, lang = one << 2 * _BITS | two << _BITS | three, langs.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(lang, kind="stable")
        at = np.searchsorted(lang[order], np.arange(len(langs.dictionary) + 1))
        for i, name in enumerate(langs.dictionary.to_pylist()):
            yield name, names, *np.unique(key[order[at[i] : at[i + 1]]], return_counts=True)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        langs = batch.column(0).cast(pa.string()).fill_null("und")
        words, text, goes_on = words_of(batch.column(1))
        at = 0
        while at < len(words):
            n = min(len(words) - at, FLUSH - size)
            while at + n < len(words) and n and goes_on[at + n - 1]:  # windows are whole: go back to a piece's end
                n -= 1
            if not n and not size:  # one piece of FLUSH words and more: its last two words start windows with what follows
                yield from _long(words, text, goes_on, at, langs)
                n = int(np.argmin(goes_on[at:])) + 1
            elif n:
                held.append((words.slice(at, n), langs.take(pa.array(text[at : at + n])), goes_on[at : at + n]))
            at, size = at + n, size + (n if held else 0)
            if held and (size >= FLUSH or at < len(words)):
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()
    release()


def _long(words: pa.Array, text: np.ndarray, goes_on: np.ndarray, at: int, langs: pa.Array) -> Iterator[tuple]:
    """The windows of one piece that is longer than FLUSH words."""
    end = at + int(np.argmin(goes_on[at:])) + 1
    lang = langs[int(text[at])].as_py()
    for a in range(at, end, FLUSH - 2):
        b = min(end, a + FLUSH - 2)
        found = words.slice(a, min(end, b + 2) - a).dictionary_encode()
        names = [*found.dictionary.to_pylist(), b""]
        codes = np.append(found.indices.to_numpy(zero_copy_only=False).astype(np.int64), [len(names) - 1] * 2)
        n = b - a
        yield lang, names, *np.unique(codes[:n] << 2 * _BITS | codes[1 : n + 1] << _BITS | codes[2 : n + 2], return_counts=True)


def _parts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = (1 << _BITS) - 1
    return key >> 2 * _BITS, key >> _BITS & low, key & low


def _select(docs: DataFrame, lang: str, text: str) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))


Hot = dict[str, tuple[set[bytes], set[tuple[bytes, bytes]]]]  # words and pairs by language


def dealing(rows: DataFrame, seed: int = 11) -> tuple[int, Hot]:
    """(number of buckets, hot words and pairs), from a sample of ``rows`` (lang, text)."""
    share = min(1.0, SAMPLE_ROWS / max(rows.count(), 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, key, n in _windows(batches):
            one, two, _ = _parts(key)
            for codes in (one << _BITS | len(names) - 1, one << _BITS | two):
                u, at = np.unique(codes, return_inverse=True)
                total = np.bincount(at, n).astype(np.int64)
                often = np.flatnonzero(total > 1)
                a, b = u[often] >> _BITS, u[often] & ((1 << _BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(often), pa.string()), pa.array([names[i] for i in a], pa.binary()), pa.array([names[i] for i in b], pa.binary()), pa.array(total[often], pa.int64())], names=["lang", "w1", "w2", "c"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([int(n.sum())], pa.int64())], names=["lang", "w1", "w2", "c"])

    some = rows.where(seeded_uniform(seed, F.col("text")) < share).mapInArrow(tidy(count), "lang string, w1 binary, w2 binary, c long")
    sums = materialize(some.groupBy("lang", "w1", "w2").agg(F.sum("c").alias("c")), "phrases-sample")
    seen = sums.where("w1 is null").agg(F.sum("c")).first()[0] or 0
    buckets = max(1, round(seen / share / BUCKET))
    hot: Hot = {}
    for r in sums.where("w1 is not null").where(F.col("c") * min(HOT, 2 * buckets) > seen).collect():  # at most twice 50,000, since each sums up to at most ``seen``
        of = hot.setdefault(r["lang"], (set(), set()))
        of[1].add((bytes(r["w1"]), bytes(r["w2"]))) if r["w2"] else of[0].add(bytes(r["w1"]))
    return buckets, hot


def blocks(rows: DataFrame, buckets: int, hot: Hot) -> DataFrame:
    """(lang, bucket, n, block): the counted windows of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, key, counts in _windows(batches):
            h = np.array([zlib.crc32(x) for x in names], np.uint64)
            words, pairs = hot.get(lang, (set(), set()))
            is_hot = np.array([x in words for x in names])
            code = {x: i for i, x in enumerate(names)} if pairs else {}
            hot_keys = np.array(sorted(code[a] << _BITS | code[b] for a, b in pairs if a in code and b in code), np.int64)
            one, two, three = _parts(key)
            with np.errstate(over="ignore"):
                place = mix(h[one])
                place = np.where(is_hot[one], mix(place + h[two]), place)
                place = np.where(np.isin(key >> _BITS, hot_keys), mix(place + h[three]), place)
            bucket = (place % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(at)):
                rows = order[at[b] : at[b + 1]]
                text = b"\n".join(b"\n".join(map(names.__getitem__, x[rows].tolist())) for x in (one, two, three))
                block = pa.compress(counts[rows].astype("<u4").tobytes() + text, "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([int(b)], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([4 * len(rows) + len(text)], pa.int64()), pa.array([block], pa.binary())], names=["lang", "bucket", "n", "bytes", "block"])

    return rows.mapInArrow(tidy(run), "lang string, bucket int, n long, bytes long, block binary")


def _summed(code: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of different codes, the first of each; sums of their counts), by rising code (several columns: lexicographically)."""
    order = np.lexsort(code[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(code[:, order], axis=1) != 0).any(0)
    return order[new], np.add.reduceat(counts[order], np.flatnonzero(new)) if len(order) else counts


def _prefixed(code: np.ndarray, counts: np.ndarray, least: int, rare: int, pad: int, keep: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Adds up under its prefix what is rarer than ``least``: third words, then second, then first ones. ``keep``: first words and pairs of which only a part is here."""
    hot_words, hot_pairs = keep
    for last in (2, 1, 0):
        rows, total = _summed(code[: last + 1], counts) if last < 2 else (np.arange(code.shape[1]), counts)
        start = np.append(rows, 0)
        few = (total < least) & (code[last, rows] != pad)
        if last == 1:
            few &= ~np.isin(code[0, rows] << 32 | code[1, rows], hot_pairs)
        if last == 0:
            few &= ~np.isin(code[0, rows], hot_words)
        if last == 2:
            gone = few
        else:  # rows are sorted by code here, so each prefix is a run
            gone = np.repeat(few, np.diff(np.append(start[:-1], code.shape[1])))
        code = code.copy()
        code[last, gone] = rare
        code[last + 1 :, gone] = pad
        rows, counts = _summed(code, counts)
        code = code[:, rows]
    return code, counts


def phrase_counts(docs: DataFrame, least: int = LEAST, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, w1, w2, w3, size, c): phrases of ``size`` 1 to 3 words that occur at least ``least`` times, and with size 0 all words of a language."""
    rows = _select(docs, lang, text)
    buckets, hot = dealing(rows)
    schema = pa.schema([("lang", pa.string()), ("w1", pa.string()), ("w2", pa.string()), ("w3", pa.string()), ("c", pa.int64())])

    def add(group: pa.Table) -> pa.Table:
        texts, counts = [[], [], []], []
        for n, size, block in zip(*(group.column(c).to_pylist() for c in ("n", "bytes", "block")), strict=True):
            raw = pa.decompress(block, size, "zstd", asbytes=True)
            counts.append(np.frombuffer(raw, "<u4", n).astype(np.int64))
            words = pa.array(raw[4 * n :].split(b"\n"), pa.binary())
            for i in range(3):
                texts[i].append(words.slice(i * n, n))
        n = sum(map(len, counts))
        found = pa.concat_arrays([x for t in texts for x in t]).dictionary_encode()
        names = [*dict.fromkeys([*found.dictionary.to_pylist(), b"", RARE.encode()])]
        at = {x: i for i, x in enumerate(names)}
        pad, rare = at[b""], at[RARE.encode()]
        code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(3, n)
        lang = group.column("lang")[0].as_py()
        words, pairs = hot.get(lang, (set(), set()))
        keep = np.array([at[x] for x in words if x in at], np.int64), np.array([at[a] << 32 | at[b] for a, b in pairs if a in at and b in at], np.int64)
        first, total = _summed(code, np.concatenate(counts))
        code, total = _prefixed(code[:, first], total, least, rare, pad, keep)
        names = pa.array([None if x == b"" else x.decode() for x in names], pa.string())
        return pa.table([pa.array([lang] * len(total), pa.string()), *[names.take(pa.array(c)) for c in code], pa.array(total, pa.int64())], schema=schema)

    full = blocks(rows, buckets, hot).groupBy("lang", "bucket").applyInArrow(add, "lang string, w1 string, w2 string, w3 string, c long")
    rolled = full.rollup("lang", "w1", "w2", "w3").agg(F.sum("c").alias("c"), F.grouping_id().alias("gid"))
    size = F.when(F.col("gid") == 0, 3).when(F.col("gid") == 1, 2).when(F.col("gid") == 3, 1).otherwise(0)
    real = lambda c: F.col(c).isNotNull() & (F.col(c) != RARE)
    whole = (F.col("gid") == 7) | ((F.col("c") >= least) & (((F.col("gid") == 3) & real("w1")) | ((F.col("gid") == 1) & real("w2")) | ((F.col("gid") == 0) & real("w3"))))
    return rolled.where("gid <= 7").where(whole).select("lang", "w1", "w2", "w3", size.alias("size"), "c")


def collocations(docs: DataFrame, least: int = LEAST, inside_percent: int = INSIDE_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score)."""
    counts = materialize(phrase_counts(docs, least).withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3")), "phrases")
    found = counts.where("size >= 2").withColumnRenamed("c", "a")
    longer = found.where("size = 3")
    parts = longer.select("lang", "a", F.explode(F.array(F.concat_ws(" ", "w1", "w2"), F.concat_ws(" ", "w2", "w3"))).alias("phrase"))
    inside = parts.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = found.join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < inside_percent * F.col("a")))
    cut = lambda k, first, rest: F.struct(F.lit(k).alias("k"), first.alias("first"), rest.alias("rest"))
    one, two = cut(1, F.col("w1"), F.concat_ws(" ", "w2", "w3")), cut(2, F.concat_ws(" ", "w1", "w2"), F.col("w3"))
    cuts = left.select("lang", "phrase", "a", F.inline(F.when(F.col("size") == 3, F.array(one, two)).otherwise(F.array(one))))
    part = counts.where("size in (1, 2)")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("c").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("c").alias("r")), ["lang", "rest"])
    big = lambda c: f"cast({c} as decimal(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"(1000000 * {big('a')} * {big('a')}) div ({big('l')} * {big('r')})"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS))
    near = best.withColumn("bucket", bucket).withColumn("i", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("i") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counts.where("size = 0").select("lang", F.col("c").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
 words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
 occ AS (SELECT lang, unnest(list_concat(list_transform(range(1, len(w) + 1), lambda i: w[i:i]), list_transform(range(1, len(w)), lambda i: w[i:i+1]), list_transform(range(1, len(w) - 1), lambda i: w[i:i+2]))) AS g FROM words WHERE len(w) > 0),
 f AS MATERIALIZED (SELECT lang, array_to_string(g, ' ') AS phrase, any_value(g) AS g, len(any_value(g)) AS size, count(*) AS c FROM occ GROUP BY lang, array_to_string(g, ' ') HAVING count(*) >= 10),
 n AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
 inside AS (SELECT lang, phrase, max(c) AS most FROM (SELECT lang, c, unnest([array_to_string(g[1:2], ' '), array_to_string(g[2:3], ' ')]) AS phrase FROM f WHERE size = 3) GROUP BY ALL),
 kept AS (SELECT f.* FROM f LEFT JOIN inside USING (lang, phrase) WHERE size >= 2 AND (most IS NULL OR 100 * most < 50 * c)),
 cuts AS (SELECT lang, phrase, c AS a, k, array_to_string(g[1:k], ' ') AS first, array_to_string(g[k+1:size], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
 scored AS (SELECT cuts.lang, cuts.phrase, a, k, x.c AS l, y.c AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.c AS HUGEINT) * y.c) AS BIGINT) AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.first JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.rest),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
 SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN n USING (lang) WHERE rank <= 2000"""
