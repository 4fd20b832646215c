"""Removal of repeated 100-byte strings by sorted, front-coded suffix runs.

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier:
in a document with a smaller id, or earlier in the same one.

Sorting the suffixes at all positions would exchange many times the input, so
only anchors take part: in every LENGTH-byte window the first position of the
least hash of a ``GRAM``-byte string. Equal windows have equal anchors, at the
same place. An anchor stands for the run of windows that choose it.

1. Anchors are exchanged as (hash of the gram, hash of the run's bytes). All
   but the first of equal runs are repeats, whole. Equal runs inside a task
   are settled before the exchange. Grams with one run only are done.
2. What is left are grams with different runs, where a repeat begins or ends.
   Tasks sort the suffixes at these anchors and exchange them as sorted runs,
   front-coded (each suffix without the prefix it shares with the one before).
   A loser tree merges the runs of a range; its players carry the length of
   the prefix shared with the last winner, so no known prefix is compared
   again. Neighbours with a common gram form a group. How many bytes neighbours
   share is known from the merge and tells which windows agree from the anchor
   on; only the bytes before the anchor are looked at.
3. Grams with more than ``HOT`` different runs (the edge of a passage that many
   documents share) are not gathered: their windows are dealt out by hash.

Texts meet their anchors and spans in sort-merge joins at every size: what they meet grows with the documents, so
that beyond some size no broadcast is left, and work measured on small tables holds for large ones.

Equal texts are settled before all this: of 100 bytes or more, all but the
first go whole.

Defined results
---------------
* Null or empty text: no bytes; shorter texts than LENGTH stay whole.
* Ids that are null come last. Rows with one id and different texts are
  ordered by a hash of the text; of rows repeated as a whole, one is judged
  as usual and the others are copies of it.
* Matches never cross documents; texts may have any length. An empty table
  gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import checked, materialize, release, table, text_batches, tidy
from ._text import _grown, mix, utf8

LENGTH, GRAM = 100, 32
#: Windows of a text that are hashed at a time.
CHUNK = 1 << 17
#: Different runs of one gram that are merged in one task at most.
HOT = 4096
#: Suffixes that one merging task gets on average.
MERGE = 40_000
_BATCH = 1 << 19
_LAST_ID = (1 << 63) - 1
_L = pa.int64()


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram hash, run hash, anchor, first window, last window) arrays over the whole text, in parts."""
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, CHUNK):
        b = data[at : at + CHUNK + length - 1]
        up, down = _grown(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
            h = mix((total[gram:] - total[:-gram]) * down[: len(b) - gram + 1])
        bits = np.uint64((CHUNK + length).bit_length())
        v = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(v) // width)
        grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        grid[: len(v)] = v
        grid = grid.reshape(rows, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(b) - length + 1
        q = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        last = np.append(first[1:] - 1, n - 1)
        q = q[first]
        with np.errstate(over="ignore"):
            whole = mix((total[last + length] - total[first]) * down[first])
            shape = mix(((q - first).astype(np.uint64) << np.uint64(8)) + (q - last).astype(np.uint64) + np.uint64(7))
            yield h[q], mix(whole + shape), q + at, first + at, last + at


def _rows(names: list[str], kinds: list[pa.DataType], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


_ANCHOR = ["key", "settled", "run", "d", "e", "pos", "reach"]
_ANCHOR_T = "key long, settled boolean, run long, d long, e long, pos long, reach int"


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """Anchors of all texts, their gram as ``key``. ``reach``: 256 * (anchor - first window) + anchor - last window.

    Those that repeat an earlier one of the same task are settled: a row for each stretch of windows that follow each
    other, from ``pos`` to ``pos`` + ``reach``.
    """
    kinds = [_L, pa.bool_(), _L, _L, _L, _L, pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            d, e = (np.asarray(batch.column(i)) for i in (0, 1))
            data, at = utf8(batch.column(2))
            for i in range(batch.num_rows):
                for g, r, q, first, last in anchors(data[at[i] : at[i + 1]]):
                    held.append((g, r, np.full(len(q), d[i]), np.full(len(q), e[i]), q, ((q - first) << 8) + q - last))
                    size += len(q)
            if size > _BATCH:
                yield settle(held)
                held, size = [], 0
        if size:
            yield settle(held)

    def settle(held: list[tuple]) -> pa.RecordBatch:
        g, r, d, e, q, reach = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((q, e, d, r))
        g, r, d, e, q, reach = (x[order] for x in (g, r, d, e, q, reach))
        again = np.concatenate(([False], r[1:] == r[:-1]))
        sd, se, first, more = _stretches(*(x[again] for x in (d, e, q, reach)))
        g, r, d, e, q, reach = (x[~again] for x in (g, r, d, e, q, reach))
        done = np.repeat((False, True), (len(d), len(sd)))
        key, run = np.concatenate((g, mix(sd.view(np.uint64)))), np.concatenate((r, np.zeros(len(sd), np.uint64)))
        rest = (np.concatenate(x) for x in ((d, sd), (e, se), (q, first)))
        return _rows(_ANCHOR, kinds, key.view(np.int64), done, run.view(np.int64), *rest, np.concatenate((reach, more)).astype(np.int32))

    return docs.select("d", "e", "text").mapInArrow(tidy(run), _ANCHOR_T)


def _stretches(d: np.ndarray, e: np.ndarray, pos: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, ...]:
    """(d, e, first window, number of windows after it) of each stretch of windows that follow each other, of anchors."""
    first, last = pos - (reach >> 8), pos - (reach & 255)
    order = np.lexsort((first, e, d))
    d, e, first, last = (x[order] for x in (d, e, first, last))
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (e[1:] != e[:-1]) | (first[1:] > last[:-1] + 1)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(d))[: len(start)] - 1
    return d[start], e[start], first[start], last[end] - first[start]


def _settled(rows: DataFrame) -> DataFrame:
    """(open, gram, d, e, pos, reach): the first of each run of grams with several runs, as open ones; and repeats.

    Of repeats ``pos`` is the first window and ``reach`` the number of those after it; they need no gram.
    """
    names, kinds = ["open", "gram", "d", "e", "pos", "reach"], [pa.bool_(), _L, _L, _L, _L, pa.int32()]

    def out(is_open: bool, cols: list[np.ndarray]) -> pa.RecordBatch:
        return _rows(names, kinds, np.full(len(cols[0]), is_open), *cols[:4], cols[4].astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_at = run_at = None
        waiting, several = None, False  # the only run so far of the gram at hand; whether it has more
        for batch in batches:
            done = batch.column(1).to_numpy(zero_copy_only=False)
            c = [np.asarray(batch.column(i)) for i in (0, 2, 3, 4, 5, 6)]
            if done.any():
                yield out(False, [np.zeros(int(done.sum()), np.int64), *(x[done] for x in c[2:])])
            g, r, d, e, q, reach = (x[~done] for x in c)
            if not len(g):
                continue
            new = np.concatenate(([gram_at != g[0] or run_at != r[0]], (g[1:] != g[:-1]) | (r[1:] != r[:-1])))
            if not new.all():
                most, least = reach[~new] >> 8, reach[~new] & 255
                yield out(False, [np.zeros(len(most), np.int64), d[~new], e[~new], q[~new] - most, most - least])
            run_at = r[-1]
            f = [x[new] for x in (g, d, e, q, reach)]
            if not len(f[0]):
                continue
            if waiting is not None:
                f = [np.concatenate((w, x)) for w, x in zip(waiting, f, strict=True)]
            grams, start, count = np.unique(f[0], return_index=True, return_counts=True)
            open_ = np.repeat(False, len(f[0]))
            many = dict(zip(grams.tolist(), count.tolist(), strict=True))
            for gram in (gram_at,):
                if several and gram in many:
                    many[gram] += 1
            size = np.array([many[x] for x in f[0].tolist()])
            open_ = size > 1
            tail = f[0] == g[-1]
            if open_.any():
                yield out(True, [x[open_] for x in f])
            several = bool(open_[-1])
            waiting = None if several else [x[tail] for x in f]
            gram_at = g[-1]

    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "run", "d", "e", "pos")
    return sorted_rows.select(*_ANCHOR).mapInArrow(tidy(run), "open boolean, gram long, d long, e long, pos long, reach int")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes needn't be compared."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (shared prefix with the one before, suffix, ...); yields (shared, item).

    Each player holds the prefix that its item shares with the last winner.
    Of two players the one with the longer prefix is the smaller; only where
    they are equal are bytes compared, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.head: list[tuple | None] = [None] * self.size
        self.shared = [0] * self.size
        self.loser = [-1] * self.size
        for i, run in enumerate(runs):
            self.head[i] = next(run, None)
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of a and b; the loser stays at the node, with the prefix it shares with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            win, lose = (b, a) if x is None else (a, b)
        elif self.shared[a] != self.shared[b]:
            win, lose = (a, b) if self.shared[a] > self.shared[b] else (b, a)
        else:
            n = common_prefix(x[1], y[1], self.shared[a])
            win, lose = (a, b) if x[1][n : n + 1] <= y[1][n : n + 1] else (b, a)
            self.shared[lose] = n
        self.loser[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        while (item := self.head[self.winner]) is not None:
            at = self.winner
            yield self.shared[at], item
            self.head[at] = follow = next(self.runs[at], None)
            self.shared[at] = follow[0] if follow else 0
            node = (at + self.size) // 2
            while node:
                at = self._play(node, at, self.loser[node])
                node //= 2
            self.winner = at


_RUN = ["part", "fixed", "shared", "sizes", "tails", "lefts"]
_RUN_T = "part int, fixed binary, shared binary, sizes binary, tails binary, lefts binary"


def front_coded(items: list[tuple[bytes, bytes, int, int, int, int, int]]) -> tuple[bytes, ...]:
    """Columns of a sorted run of (suffix, left, d, e, anchor, most left, least left)."""
    shared, before = bytearray(), b""
    tails, lefts, sizes = [], [], bytearray()
    for suffix, left, *_ in items:
        n = common_prefix(before, suffix)
        shared.append(n)
        sizes += bytes((len(suffix) - n, len(left)))
        tails.append(suffix[n:])
        lefts.append(left)
        before = suffix
    fixed = np.array([x[2:] for x in items], np.int64)
    return fixed.tobytes(), bytes(shared), bytes(sizes), b"".join(tails), b"".join(lefts)


def decoded(fixed: bytes, shared: bytes, sizes: bytes, tails: bytes, lefts: bytes) -> Iterator[tuple]:
    """(shared with the one before, suffix, left, d, e, anchor, most left, least left) in order."""
    rows = np.frombuffer(fixed, np.int64).reshape(-1, 5).tolist()
    suffix, t, f = b"", 0, 0
    for i, row in enumerate(rows):
        n, m = sizes[2 * i], sizes[2 * i + 1]
        suffix = suffix[: shared[i]] + tails[t : t + n]
        yield (shared[i], suffix, lefts[f : f + m], *row)
        t, f = t + n, f + m


def _group_spans(group: list[tuple], shared: list[int], length: int) -> Iterator[tuple[int, int, int, int]]:
    """Spans (d, e, start, end) of the windows of a gram's runs that occur in an earlier run.

    ``group`` is sorted by suffix, and item i shares shared[i] bytes with the one before. The windows that begin b
    bytes before the anchor agree from the anchor on among neighbours that share length - b bytes, which the merge
    has found out; only what is left of the anchor is looked at.
    """
    hits: dict[int, list[int]] = {}

    def close(same: dict[bytes, list[int]]) -> None:
        for items in same.values():
            if len(items) > 1:
                first = min(items, key=lambda i: group[i][3:6])
                for i in items:
                    if i != first:
                        hits.setdefault(i, []).append(b)

    for b in range(max(x[6] for x in group), min(x[7] for x in group) - 1, -1):
        need = length - b
        same: dict[bytes, list[int]] = {}
        for i, (_, _, left, _, _, _, most, least) in enumerate(group):
            if shared[i] < need and same:
                close(same)
                same = {}
            if least <= b <= most:
                same.setdefault(left[most - b :], []).append(i)
        close(same)
    for i, backs in hits.items():  # backs fall: windows of one item that touch become one span
        d, e, q = group[i][3:6]
        start, end = q - backs[0], q - backs[0] + length
        for b in backs[1:]:
            if q - b > end:
                yield d, e, start, end
                start = q - b
            end = q - b + length
        yield d, e, start, end


def _run_rows(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """Front-coded sorted runs of the suffixes at the anchors of ``chosen`` (d, e, at: array of (part, pos, reach))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size = 0
        for batch in batches:
            for d, e, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for x in at:
                    q, most, least = x["pos"], x["reach"] >> 8, x["reach"] & 255
                    held.setdefault(x["part"], []).append((data[q : q - least + length], data[q - most : q], d, e, q, most, least))
                    size += 1
            if size > _BATCH // 4:
                yield coded(held)
                held, size = {}, 0
        if size:
            yield coded(held)

    def coded(held: dict[int, list[tuple]]) -> pa.RecordBatch:
        runs = [(part, *front_coded(sorted(items, key=lambda x: x[0]))) for part, items in held.items()]
        return _rows(_RUN, [pa.int32(), *[pa.binary()] * 5], *zip(*runs, strict=True))

    return docs.join(chosen.hint("merge"), ["d", "e"]).select("d", "e", "at", "text").mapInArrow(tidy(run), _RUN_T)


def _merged_spans(runs: DataFrame, length: int, gram: int) -> DataFrame:
    def merge(t: pa.Table) -> pa.Table:
        players = [decoded(*cols) for cols in zip(*(t.column(c).to_pylist() for c in _RUN[1:]), strict=True)]
        spans: list[tuple[int, int, int, int]] = []
        group: list[tuple] = []
        known: list[int] = []
        for shared, item in LoserTree(players):
            if shared < gram and group:
                if len(group) > 1:
                    spans += _group_spans(group, known, length)
                group, known = [], []
            group.append(item)
            known.append(shared)
        if len(group) > 1:
            spans += _group_spans(group, known, length)
        release()
        cols = list(zip(*spans, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(c, _L) for n, c in zip(("d", "e", "start", "end"), cols, strict=True)})

    return runs.groupBy("part").applyInArrow(merge, "d long, e long, start long, end long")


def _hot_spans(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """Spans of the repeated windows at the anchors of ``chosen``, each window dealt by its hash."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[bytes, tuple] = {}
            rows: list[tuple] = []
            for d, e, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for x in at:
                    for p in range(x["pos"] - (x["reach"] >> 8), x["pos"] - (x["reach"] & 255) + 1):
                        w = hashlib.blake2b(data[p : p + length], digest_size=16).digest()
                        new = (d, e, p)
                        old = first.setdefault(w, new)
                        if new < old:
                            first[w], new = new, old
                        if new is not first[w] and new != first[w]:
                            rows.append((None, *new))  # an earlier one is in this batch
            rows += [(w, *x) for w, x in first.items()]
            yield _rows(["w", "d", "e", "p"], [pa.binary(), _L, _L, _L], *(zip(*rows, strict=True) if rows else [[]] * 4))

    found = materialize(docs.join(chosen.hint("merge"), ["d", "e"]).select("d", "e", "at", "text").mapInArrow(tidy(windows), "w binary, d long, e long, p long"), "suffix-windows")
    place = F.struct("d", "e", "p")
    least = found.where("w is not null").groupBy("w").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = found.join(least, "w").where(place > F.col("least")).select("d", "e", "p")
    return later.unionByName(found.where("w is null").select("d", "e", "p")).select("d", "e", F.col("p").alias("start"), (F.col("p") + length).alias("end"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with d, e and text: the order of documents is that of (d, e)."""
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID))
    docs = docs.withColumns({"d": d, "text": F.coalesce(F.col(text_col), F.lit(""))})
    n = docs.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.withColumn("e", F.lit(0).cast("long") if not n.head(1) else F.xxhash64("text"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, name: str = "suffix") -> DataFrame:
    """(d, e, starts, ends): the maximal removed runs of each text of ``docs`` (d, e, text) that has any."""
    text_batches(docs.sparkSession)
    docs = docs.select("d", "e", "text")
    sizes = docs.where(F.octet_length("text") >= length).select("d", "e", F.octet_length("text").cast("long").alias("n"), F.md5("text").alias("key"))
    sizes = materialize(sizes, f"{name}-sizes")
    first = sizes.groupBy("key").agg(F.min(F.struct("d", "e")).alias("first"), F.count(F.lit(1)).alias("rows"))
    several = materialize(first.where("rows > 1").select("key", "first.d", "first.e").withColumnsRenamed({"d": "fd", "e": "fe"}), f"{name}-texts")
    copies = materialize(sizes.join(several, "key").where("d <> fd or e <> fe").select("d", "e", "n").distinct(), f"{name}-copies")
    others = docs.where(F.octet_length("text") >= length).join(checked(copies.select("d", "e")), ["d", "e"], "left_anti").dropDuplicates(["d", "e"]) if _repeats(sizes) else docs.where(
        F.octet_length("text") >= length).join(checked(copies.select("d", "e")), ["d", "e"], "left_anti")
    found = materialize(_settled(_anchor_rows(others)), f"{name}-anchors")
    spans = found.where("not open").select("d", "e", F.col("pos").alias("start"), (F.col("pos") + F.col("reach") + length).alias("end"))
    is_open = found.where("open")
    hot = materialize(is_open.groupBy("gram").count().where(F.col("count") > HOT).select("gram"), f"{name}-hot")
    parts = max(1, -(-is_open.count() // MERGE))
    usual = is_open.join(checked(hot), "gram", "left_anti").groupBy("d", "e").agg(
        F.collect_list(F.struct(F.pmod("gram", F.lit(parts)).cast("int").alias("part"), "pos", "reach")).alias("at"))
    usual = materialize(usual, f"{name}-open")
    merged = _merged_spans(_run_rows(others, usual, length), length, gram)
    spans = spans.unionByName(materialize(merged, f"{name}-merged"))
    if hot.head(1):
        wide = materialize(is_open.join(checked(hot), "gram", "left_semi").groupBy("d", "e").agg(F.collect_list(F.struct("pos", "reach")).alias("at")), f"{name}-wide")
        spans = spans.unionByName(_hot_spans(others, wide, length))
    spans = spans.unionByName(copies.select("d", "e", F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for at in batch.column(2).to_pylist():
                a = np.array(sorted((x["start"], x["end"]) for x in at), np.int64)
                reach = np.maximum.accumulate(a[:, 1])
                new = np.concatenate(([True], a[1:, 0] > reach[:-1]))
                starts.append(a[new, 0].tolist())
                ends.append(reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)].tolist())
            yield _rows(["d", "e", "starts", "ends"], [_L, _L, pa.list_(_L), pa.list_(_L)], batch.column(0), batch.column(1), starts, ends)

    by_doc = spans.groupBy("d", "e").agg(F.collect_list(F.struct("start", "end")).alias("at"))
    return materialize(by_doc.mapInArrow(tidy(union), "d long, e long, starts array<long>, ends array<long>"), f"{name}-spans")


def _repeats(sizes: DataFrame) -> bool:
    return bool(sizes.groupBy("d", "e").count().where("count > 1").head(1))


def kept_bytes(data: bytes, starts: list[int] | None, ends: list[int] | None) -> bytes:
    if starts is None or not len(starts):
        return data
    return b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)], strict=True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = repeated_spans(docs)
    joined = docs.join(spans.hint("merge"), ["d", "e"], "left").select("doc_id", "d", "e", "text", "starts", "ends")
    names = ["doc_id", "d", "e", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, ends in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                data = text.encode()
                kept = kept_bytes(data, starts, ends)
                rows.append((len(data), len(data) - len(kept), len(starts or ()), hashlib.sha256(kept).hexdigest()))
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield _rows(names, [_L] * 6 + [pa.string()], *batch.columns[:3], *cols)

    out = joined.mapInArrow(tidy(digest), "doc_id long, d long, e long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return again_removed(out, docs).drop("d", "e")


def again_removed(out: DataFrame, docs: DataFrame) -> DataFrame:
    """Of rows with the same id and text, all but one lose their text if it has LENGTH bytes."""
    twice = docs.groupBy("d", "e").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "e")
    if not twice.head(1):
        return out
    twice = materialize(twice, "suffix-twice")
    rest = out.join(checked(twice), ["d", "e"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("d", "e").orderBy("n_bytes"))
    copy = (F.col("nth") > 1) & (F.col("n_bytes") >= LENGTH)
    same = out.join(checked(twice), ["d", "e"], "left_semi").withColumn("nth", nth).withColumns({
        "n_removed": F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")), "n_spans": F.when(copy, F.lit(1)).otherwise(F.col("n_spans")),
        "kept_sha256": F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256"))}).drop("nth")
    return rest.unionByName(same)
