"""N-gram Jaccard join by universe partition and pigeonhole, exact.

Texts are sets of hashed k-word shingles. If two sets of at most u elements
have a Jaccard similarity of at least t, they differ in at most
H = (1 - t) / (1 + t) * 2u elements. So the universe of hashes is cut into
m > H segments (m depends on the size band of the larger set), and at least
m - H segments hold the same subset in both: the hash of (band, segment,
subset) is a signature that both share.

Allocation: a segment where a set has nothing tells nothing, so it gives no
signature; m has E segments to spare, and a set with at most E empty segments
still shares a signature with all its partners. Sets with more (tail sets)
also index, among themselves, the one-deletion neighbourhoods of their subsets,
which covers segments that differ in one element. E is chosen per band by
comparing the rows that spare segments cost with those that tail sets cost. A
set that even deletions don't cover goes to a bucket of its own kind.

Signatures are pre-aggregated in each task, then sorted runs of equal ones give
links of each set to one hub: as many candidates as members, not as many as
pairs. Each set is verified against the hub it shares most with, if bitmaps leave
that possible: their difference bounds that of the sets from below, so no link
is lost. Buckets that then still hold different components are compared inside
tasks, in blocks, by the same bitmaps; in two rounds each set offers its most likely link only, which merges
most components, then all that is left is verified on the full sets.

Defined results
---------------
* Null text or no word: an empty set, linked with nothing. Fewer than k words:
  the whole sequence as one shingle. Shingles are hashed to 64 bits.
* Repeated ids: rows of one id are linked through it, also if their texts
  differ; each text meets its own partners. Id null: component null.
* Ties at the threshold link. Equal sets link whatever their number; they are
  joined once, as a class. An empty table gives an empty result.
* Other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checked, components, materialize, salted, spent, table, text_batches, tidy
from ._text import mix, shingle_hashes, word_hashes

K, PERCENT = 4, 85
BAND_RATIO = 1.5
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
#: Rounds in which each member of an unsettled bucket offers one link, before all are asked.
ROUNDS = 2
#: Pairs of one hub that one task verifies.
HUB_PAIRS = 1000
#: Signatures that a task holds before they leave it as one batch.
_CHUNK = 1 << 17
#: The bits of a signature that hold its band.
_BAND = np.uint64(255)


def sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    words, at = word_hashes(texts)
    return [np.unique(shingle_hashes(words[at[i] : at[i + 1]], k)) for i in range(len(at) - 1)]


@lru_cache(maxsize=4096)
def band_of(n: int) -> tuple[int, int, int]:
    """(number, smallest, largest size) of the band of sets with n elements."""
    number, lo = 0, 1
    while True:
        hi = max(lo, int(lo * BAND_RATIO))
        if n <= hi:
            return number, lo, hi
        number, lo = number + 1, hi + 1


@lru_cache(maxsize=4096)
def segments(lo: int, hi: int, percent: int) -> tuple[int, int]:
    """(segments m, spare ones E) of a band; m - E - 1 is the largest difference H."""
    h = (100 - percent) * 2 * hi // (100 + percent)
    if h == 0:
        return 1, 0
    best = (math.inf, 1)
    size = (lo * percent / 100 + hi) / 2
    for e in range(max(2, h)):
        m = h + 1 + e
        mean = m * math.exp(-size / m)  # empty segments of a set, about Poisson
        term, below = math.exp(-mean), 0.0
        for i in range(e + 1):
            below += term
            term *= mean / (i + 1)
        best = min(best, (m + max(0.0, 1 - below) * 2 * size, e))
        if e > 4 * mean + 8:
            break
    return h + 1 + best[1], best[1]


def bands(n: int, percent: int) -> list[tuple[int, int, int]]:
    """Bands in which a set of n elements meets partners: its own and those of larger partners."""
    out = [band_of(n)]
    while (out[-1][2] + 1) * percent <= 100 * n:
        out.append(band_of(out[-1][2] + 1))
    return out


def _subsets(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements by segment: (mixed elements, segment of each, segments that occur, their starts, their hashes)."""
    seg = (s % np.uint64(m)).astype(np.int32)
    order = np.argsort(seg, kind="stable")
    seg, mixed = seg[order], mix(s[order] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    start = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    return mixed, seg, seg[start], start, np.add.reduceat(mixed, start)


def _named(band: int, kind: int, seg: np.ndarray, content: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(content) + mix((seg.astype(np.uint64) << np.uint64(16)) + np.uint64(band * 4 + kind)))


def signatures(s: np.ndarray, band: tuple[int, int, int], percent: int) -> np.ndarray:
    """Signatures of a set in a band."""
    number, lo, hi = band
    m, spare = segments(lo, hi, percent)
    if m == 1:  # no difference is allowed; equal sets are joined as classes
        return np.zeros(0, np.uint64)
    # partners have at most ``top`` elements: fewer differences than in the band at large, so the first segments will do
    top = min(hi, 100 * len(s) // percent)
    need = (100 - percent) * (len(s) + top) // (100 + percent) + 1 + spare
    mixed, seg, has, start, content = _subsets(s, m)
    first = has < need
    if need - int(first.sum()) <= spare:
        return np.unique(_named(number, 0, has[first], content[first]))
    out = [_named(number, 0, has, content)]
    size = np.diff(np.append(start, len(s)))
    out.append(_named(number, 1, has, content))
    with np.errstate(over="ignore"):
        without = np.repeat(content, size) - mixed
    many = np.repeat(size, size) > 1
    out.append(_named(number, 1, seg[many], without[many]))
    if int((size == 1).sum()) + 2 * int((size > 1).sum()) < m - spare:
        out.append(_named(number, 2, np.zeros(1), np.zeros(1, np.uint64)))
    return np.unique(np.concatenate(out))


def sketch(s: np.ndarray) -> np.ndarray:
    """The size of a set, then a bitmap of one to two bits per element: bit i tells whether an odd number of elements hash to i.

    The number of bits in which two bitmaps of one width differ is at most the number of elements in which the sets
    differ. Unrelated sets differ in half of the bits, far more than the threshold allows; more bits would only tell
    pairs closely below it, and bitmaps are shuffled once per bucket that the set is in.
    """
    bits = max(64, 1 << (len(s) - 1).bit_length())
    count = np.bincount((mix(s ^ np.uint64(0x3C3C3C3C3C3C3C3C)) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.concatenate((np.array([len(s)], np.uint64), np.packbits((count & 1).astype(np.uint8)).view(np.uint64)))


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer words; widths are powers of two."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _rows(names: list[str], kinds: list[pa.DataType], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


_L = pa.int64()


def _prints_of(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two hashes) of each set."""
    n = np.array([len(s) for s in found], np.int64)
    with np.errstate(over="ignore"):
        a = np.array([mix(s ^ np.uint64(1)).sum(dtype=np.uint64) for s in found], np.uint64).view(np.int64)
        b = np.array([mix(s ^ np.uint64(2)).sum(dtype=np.uint64) for s in found], np.uint64).view(np.int64)
    return n, a, b


def _fingerprints(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sets(batch.column(1), k)
            yield _rows(["id", "n", "a", "b", "v"], [_L] * 4 + [pa.binary()], batch.column(0), *_prints_of(found), [sketch(s).tobytes() for s in found])

    return docs.select("id", "text").mapInArrow(tidy(run), "id long, n long, a long, b long, v binary")


def _signature_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, a, b, sig): b null: set ``a`` has the signature ``key``; else a and b share ``sig``, found inside one task.

    The last 8 bits of a signature are its band's number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0
        for batch in batches:
            for id_, s in zip(batch.column(0).to_pylist(), sets(batch.column(1), k), strict=True):
                if len(s) and id_ is not None:
                    for band in bands(len(s), percent):
                        sig = signatures(s, band, percent)
                        held.append((sig, id_, band[0]))
                        size += len(sig)
                    if size > _CHUNK:  # within a batch too, whose texts may have many times as many signatures
                        yield combined(held)
                        held, size = [], 0
        if size:
            yield combined(held)

    def combined(held: list) -> pa.RecordBatch:
        n = [len(x[0]) for x in held]
        band = np.repeat(np.array([x[2] for x in held], np.uint64), n)
        sig, ids = np.concatenate([x[0] for x in held]) & ~_BAND | band, np.repeat([x[1] for x in held], n)
        order = np.lexsort((ids, sig))
        sig, ids = sig[order], ids[order]
        new = np.concatenate(([True], sig[1:] != sig[:-1]))
        first = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        keep = new | (ids != first)
        sig, ids, new, first = sig[keep], ids[keep], new[keep], first[keep]
        key = np.where(new, sig, mix(ids.astype(np.uint64)))
        return _rows(["key", "a", "b", "sig"], [_L] * 4, key.view(np.int64), first, pa.array(ids, _L, mask=new), pa.array(sig.view(np.int64), _L, mask=new))

    return docs.select("id", "text").mapInArrow(tidy(run), "key long, a long, b long, sig long")


def _hub_links(rows: DataFrame) -> DataFrame:
    """(sig, band, a, b): a tree over the sets of each signature that two sets have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, None

        def out(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return _rows(["sig", "band", "a", "b"], [_L, pa.int32(), _L, _L], sig, (sig.view(np.uint64) & _BAND).astype(np.int32), a, b)

        for batch in batches:
            pair = np.asarray(batch.column(2).is_valid())
            if pair.any():
                done = batch.filter(pa.array(pair))
                yield out(*(np.asarray(done.column(i)) for i in (3, 1, 2)))
            sig, ids = (np.asarray(batch.column(i))[~pair] for i in (0, 1))
            if not len(sig):
                continue
            new = np.concatenate(([sig[0] != last], sig[1:] != sig[:-1]))
            heads = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            first = np.where(run_of >= 0, ids[heads][run_of] if len(heads) else 0, hub if hub is not None else 0)
            last, hub = sig[-1], first[-1]
            keep = ids != first
            yield out(sig[keep], first[keep], ids[keep])

    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "a")
    return sorted_rows.mapInArrow(tidy(run), "sig long, band int, a long, b long")


def _cut(rows: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """``rows`` with the number of blocks of their key (``blocks``, written); only keys of several blocks are looked up."""
    return salted(rows, blocks.where("blocks > 1"), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def _met(rows: DataFrame, pairs: DataFrame, read: Callable[[pa.Array], list], link: Callable, name: str, most: bool = False) -> DataFrame:
    """Those of ``pairs`` (a, b) for which ``link`` holds between what ``read`` makes of their ``rows`` (id, value).

    Values of the ids in pairs are shuffled once per pair, a hub's once per block. ``most``: the pairs are about as
    many as ``rows``, so that a sort-merge join takes them to their values at every size.
    """
    blocks = materialize(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("blocks")), f"{name}-hubs")
    right = _cut(pairs, blocks, "a").select(F.col("b").alias("id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"))
    left = blocks.select(F.col("a").alias("id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"))
    roles = materialize(right.unionByName(left), f"{name}-roles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            a, b = [], []
            hubs, roles_, ids = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for h, role, id_, x in zip(hubs, roles_, ids, read(batch.column(4)), strict=True):
                if role == 0:
                    hub, own = h, x
                elif h == hub and link(own, x):
                    a.append(h)
                    b.append(id_)
            yield _rows(["a", "b"], [_L, _L], a, b)

    values = rows.join(roles.hint("merge") if most else checked(roles), "id").repartition("hub", "block").sortWithinPartitions("hub", "block", "role")
    return values.select("hub", "block", "role", "id", "value").mapInArrow(tidy(run), "a long, b long").distinct()


def _possible(sketches: DataFrame, pairs: DataFrame, percent: int, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that size and bitmap leave possible."""

    def link(x: np.ndarray, y: np.ndarray) -> bool:
        n, m = int(x[0]), int(y[0])
        words = min(len(x), len(y)) - 1
        apart = int(np.bitwise_count(folded(x[1:], words) ^ folded(y[1:], words)).sum(dtype=np.int64))
        return 100 * min(n, m) >= percent * max(n, m) and (100 + percent) * apart <= (100 - percent) * (n + m)

    def read(values: pa.Array) -> list[np.ndarray]:
        return [np.frombuffer(v, np.uint64) for v in values.to_pylist()]

    return _met(sketches.select("id", F.col("v").alias("value")), pairs, read, link, name, most=True)


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that link."""

    def link(x: np.ndarray, y: np.ndarray) -> bool:
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    return _met(docs.select("id", F.col("text").alias("value")), pairs, lambda values: sets(values, k), link, name)


def _open_pairs(members: DataFrame, sketches: DataFrame, percent: int, one: bool, name: str) -> DataFrame:
    """(sig, a, b): members of a bucket with different labels that size and bitmap leave possible.

    ``one``: of each member's pairs in a block only the most alike.
    """
    blocks = materialize(members.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), f"{name}-blocks")
    rows = _cut(members, blocks, "sig").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.select("sig", "id", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("sig", "id", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def flush() -> pa.RecordBatch:
            m = np.array([x[:4] for x in held], np.int64)
            words = min(len(x[4]) for x in held)
            v = np.stack([folded(x[4], words) for x in held])
            a, b = [], []
            for r in range(len(held) - 1):
                rest = m[r + 1 :]
                ok = (rest[:, 1] != m[r, 1]) & (100 * np.minimum(rest[:, 2], m[r, 2]) >= percent * np.maximum(rest[:, 2], m[r, 2]))
                if at[1] != at[2]:
                    ok &= rest[:, 3] != m[r, 3]
                hit = np.flatnonzero(ok) + r + 1
                if len(hit):
                    apart = np.bitwise_count(v[hit] ^ v[r]).sum(1, dtype=np.int64)
                    spare = (100 - percent) * (m[hit, 2] + m[r, 2]) // (100 + percent) - apart
                    if one:
                        hit = hit[[int(spare.argmax())]] if spare.max() >= 0 else hit[:0]
                    else:
                        hit = hit[spare >= 0]
                    a += [m[r, 0]] * len(hit)
                    b += m[hit, 0].tolist()
            low, high = np.minimum(a, b), np.maximum(a, b)
            return _rows(["sig", "a", "b"], [_L] * 3, np.full(len(a), at[0]), low.astype(np.int64), high.astype(np.int64))

        for batch in batches:
            for sig, i, j, id_, label, own, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (sig, i, j) != at:
                    if len(held) > 1:
                        yield flush()
                    held, at = [], (sig, i, j)
                v = np.frombuffer(v, np.uint64)
                held.append((id_, label, int(v[0]), own, v[1:]))
        if len(held) > 1:
            yield flush()

    full = rows.join(sketches, "id").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "id")
    return full.select("sig", "i", "j", "id", "label", "own", "v").mapInArrow(tidy(run), "sig long, a long, b long")


def _unsettled(members: DataFrame, name: str) -> DataFrame:
    """Members of the buckets that hold more than one label."""
    open_ = members.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
    return salted(members, materialize(open_, f"{name}-unsettled"), "sig", "left_semi")


def _relabelled(members: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``members`` with labels merged along ``links`` (a, b) between labels."""
    merged = materialize(components(links, name).select(F.col("id").alias("label"), "component"), f"{name}-merged")
    return salted(members, merged, "label", "left").select("sig", "band", "id", F.coalesce("component", "label").alias("label"))


def _free_ids(classes: DataFrame, taken: DataFrame, name: str) -> DataFrame:
    """``classes`` (n, a, b) with a node each that no other class and no id of ``taken`` has."""
    salt = 0
    while True:
        free = materialize(classes.select("*", F.xxhash64(F.lit(salt), "n", "a", "b").alias("node")), f"{name}-free")
        if not free.join(taken.select(F.col("id").alias("node")), "node", "left_semi").head(1) and not free.groupBy("node").count().where("count > 1").head(1):
            return free
        salt += 1


def _texts_of(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(id, text): a text of each of ``classes`` (n, a, b, node), under its node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(["n", "a", "b", "text"], [_L] * 3 + [pa.string()], *_prints_of(sets(batch.column(1), k)), batch.column(1))

    texts = docs.select("id", "text").mapInArrow(tidy(run), "n long, a long, b long, text string")
    return texts.join(checked(classes), ["n", "a", "b"]).groupBy(F.col("node").alias("id")).agg(F.min("text").alias("text"))


def similar(docs: DataFrame, k: int = K, percent: int = PERCENT, name: str = "ngram") -> DataFrame:
    """``docs`` (id, text): returns (id, n_shingles, component_id) for each row."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("id").cast("long").alias("id"), "text")
    prints = materialize(_fingerprints(docs, k), f"{name}-prints")
    key = ["n", "a", "b"]
    fit = prints.where("n > 0 and id is not null")
    # a class is a node, named by the smallest of its ids that have no other class; where there is none, by a number that is no id
    ends = fit.groupBy("id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in key for f in (F.min, F.max)])
    several = materialize(ends.where(" or ".join(f"min_{c} <> max_{c}" for c in key)).select("id"), f"{name}-several")
    mixed = bool(several.head(1))
    if mixed:
        fit = fit.join(checked(several.withColumn("several", F.lit(True))), "id", "left")
    own = F.when(F.col("several").isNull(), F.col("id")) if mixed else F.col("id")
    classes = materialize(fit.groupBy(*key).agg(F.min(own).alias("node"), F.count(F.lit(1)).alias("rows")), f"{name}-classes")
    if mixed:
        free = _free_ids(classes.where("node is null").select(*key), prints, name)
        classes = classes.where("node is not null").select(*key, "node").unionByName(free)
    else:
        classes = classes.where("rows > 1").select(*key, "node")
    copies = materialize(fit.join(classes, key).where("id <> node").select("id", "node").distinct(), f"{name}-copies")
    # an id's rows without a word must not stand for those with words
    worded = F.col("id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    unique = docs.where(worded).join(checked(copies.select("id")), "id", "left_anti")
    if mixed:
        unique = materialize(unique.unionByName(_texts_of(docs.join(checked(several), "id", "left_semi"), free, k)), f"{name}-texts")
    links = materialize(_hub_links(_signature_rows(unique, k, percent)), f"{name}-links")
    counted = links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    best = counted.groupBy("b").agg(F.max_by("a", F.struct(F.col("shared"), -F.col("a"))).alias("a"))
    # an id in links has one class only, so that all its rows with words have one sketch
    sketches = fit.select("id", "v")
    if mixed:
        sketches = sketches.unionByName(fit.join(checked(free), key).select(F.col("node").alias("id"), "v"))
    sketches = materialize(sketches.groupBy("id").agg(F.max("v").alias("v")), f"{name}-sketches")
    likely = materialize(_possible(sketches, materialize(best.select("a", "b"), f"{name}-best"), percent, name), f"{name}-likely")
    proven = materialize(_verified(unique, likely, k, percent, name), f"{name}-proven")
    label = materialize(components(proven, f"{name}-parts"), f"{name}-labels")
    # buckets in which more than one component is left
    la, lb = label.select(F.col("id").alias("a"), F.col("component").alias("ca")), label.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    labelled = salted(salted(links, la, "a", "left"), lb, "b", "left").select("sig", "band", "a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    labelled = materialize(labelled, f"{name}-labelled")
    spent(links)
    unsettled = materialize(labelled.where("ca <> cb").select("sig").distinct(), f"{name}-unsettled")
    there = salted(labelled, unsettled, "sig", "left_semi")
    both = F.array(*[F.struct(F.col(i).alias("id"), F.col(c).alias("label")) for i, c in (("a", "ca"), ("b", "cb"))])
    members = materialize(there.select("sig", "band", F.inline(both)).distinct(), f"{name}-members")
    spent(labelled)
    # as in Boruvka's algorithm each member first offers its most likely link; buckets without one are done
    for round_ in range(ROUNDS + 1):
        pairs = materialize(_open_pairs(members, sketches, percent, round_ < ROUNDS, name), f"{name}-open")
        new = materialize(_verified(unique, materialize(pairs.select("a", "b").distinct(), f"{name}-asked"), k, percent, name), f"{name}-new")
        proven = proven.unionByName(new)
        if round_ == ROUNDS:
            break
        own = members.select("id", "label").distinct()
        between = new.join(own.withColumnsRenamed({"id": "a", "label": "x"}), "a").join(own.withColumnsRenamed({"id": "b", "label": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        left = salted(members, materialize(pairs.select("sig").distinct(), f"{name}-still"), "sig", "left_semi")
        left = materialize(_relabelled(left, materialize(between, f"{name}-between"), f"{name}-round"), f"{name}-relabelled")
        members = materialize(_unsettled(left, name), f"{name}-members")
        if not members.head(1):
            break
    spent(sketches)
    # copies and repeated ids join through their classes
    all_links = proven.unionByName(copies.select(F.col("node").alias("a"), F.col("id").alias("b")))
    groups = materialize(components(all_links, f"{name}-groups"), f"{name}-named")
    if mixed:  # a component is named by its smallest id, whatever its nodes
        ids = groups.join(free.select(F.col("node").alias("id")), "id", "left_anti")
        groups = ids.join(ids.groupBy("component").agg(F.min("id").alias("least")), "component").select("id", F.col("least").alias("component"))
    out = prints.join(groups.select("id", "component"), "id", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return similar(docs).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 85 * (na + nb - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) r ON r.id = s.doc_id
"""
