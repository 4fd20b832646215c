"""Best-fit packing of tokenized documents into sequences of fixed length.

Only the number of pieces of each length decides how sequences are filled, and
there are at most ``capacity`` lengths. So the plan is made on that histogram
(never on documents), as patterns: the lengths in a sequence and how many
sequences look so. Pieces above a third of the capacity go at most two to a
sequence, matched greedily, each with the largest partner that fits; smaller
pieces, longest first, then go to the fullest sequence with room. The number
of patterns is bounded by a small multiple of ``capacity``. Pieces find their
places by their rank within their length, computed in blocks.

A document over the capacity is cut into full pieces, the first one being the
shorter remainder; no other document is cut.

Defined results
---------------
* Text null or empty: the closing id alone, one piece of length 1.
* Repeated rows are packed as often as they occur, an empty table gives an
  empty result, and extra columns are ignored.
* A text is tokenized whole, whatever its length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, ranked, table, text_batches, tidy

CAPACITY, END_ID = 2048, 0
#: Texts with other characters than these are encoded by the slower of the
#: two libraries, so that both agree on what a letter or a blank is.
_PLAIN = re.compile(r"[^\x00-\x7f¡-¬®-Ƞ‐-‧€]")
_SPECIAL = "<|endoftext|>"
_encoders: dict[tuple[str, str], tuple] = {}


def default_tokenizer() -> tuple[str, str]:
    """Files of one vocabulary, for the libraries ``tokenizers`` and ``tiktoken``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(files: tuple[str, str]):
    """A function from a text to its ids, the same as the first file's tokenizer gives."""
    if files not in _encoders:
        import base64
        import os

        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(files[1], "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[files] = fast, []
    fast, slow = _encoders[files]

    def encode(text: str) -> np.ndarray:
        if _PLAIN.search(text) or _SPECIAL in text:
            if not slow:  # loaded where it is needed only, as it holds much memory
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(files[0]))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)

    return encode


def pieces(docs: DataFrame, files: tuple[str, str] | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, copy, piece, start, length, ids_crc32) of every document; ``copy`` tells repeated rows apart."""
    text_batches(docs.sparkSession)
    files = files or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(files)
        try:
            yield from cut_with(encode, batches)
        finally:
            _encoders.clear()  # so that an idle worker doesn't keep them beside the next stage

    def cut_with(encode, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, copy, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or capacity
                at = [0, *range(first, len(ids) + 1, capacity)]
                for p in range(len(at) - 1):
                    rows.append((doc, copy, p, at[p], at[p + 1] - at[p], zlib.crc32(ids[at[p] : at[p + 1]].tobytes())))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "copy", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.monotonically_increasing_id().alias("c"), F.col(text_col).alias("t"))
    return rows.mapInArrow(tidy(cut), "doc_id long, copy long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, times in a sequence), ...], number of sequences)."""
    left = {s: n for s, n in counts.items() if n}
    large = sorted(s for s in left if 3 * s > capacity)
    bins: dict[int, list[tuple[tuple, int]]] = defaultdict(list)  # by room: (content, sequences)

    def put(room: int, content: tuple, n: int) -> None:
        if n:
            bins[room].append((content, n))

    while large:
        s = large[-1]
        if not left[s]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - s) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at < 0:
            put(capacity - s, ((s, 1),), left[s])
            left[s] = 0
        elif large[at] == s:
            put(capacity - 2 * s, ((s, 2),), left[s] // 2)
            if left[s] % 2:
                left[s] = 1
                at = bisect.bisect_left(large, s) - 1
                while at >= 0 and not left[large[at]]:
                    at -= 1
                if at >= 0:
                    put(capacity - s - large[at], ((s, 1), (large[at], 1)), 1)
                    left[large[at]] -= 1
                else:
                    put(capacity - s, ((s, 1),), 1)
            left[s] = 0
        else:
            t = large[at]
            n = min(left[s], left[t])
            put(capacity - s - t, ((s, 1), (t, 1)), n)
            left[s] -= n
            left[t] -= n
    rooms = sorted(bins)
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):  # open new sequences and fill them with this length
                per = capacity // s
                full, rest = divmod(left[s], per)
                fresh = [(capacity - per * s, ((s, per),), full), (capacity - rest * s, ((s, rest),), int(rest > 0))]
                left[s] = 0
            else:
                room = rooms[at]
                content, n = bins[room].pop()
                if not bins[room]:
                    rooms.pop(at)
                per = room // s
                full = min(n, left[s] // per)
                rest = min(left[s] - full * per, per - 1) if full < n else 0
                fresh = [(room - per * s, (*content, (s, per)), full), (room - rest * s, (*content, (s, rest)), int(rest > 0)), (room, content, n - full - (rest > 0))]
                left[s] -= full * per + rest
            for room, content, n in fresh:
                if n:
                    if not bins.get(room):
                        bisect.insort(rooms, room)
                    bins[room].append((content, n))
    return [(list(content), n) for same in bins.values() for content, n in same]


def pack(parts: DataFrame, capacity: int = CAPACITY, name: str = "pack") -> DataFrame:
    """``parts`` (length, doc_id, copy, piece, ...) with ``sequence_id`` and ``offset``. Reads ``parts`` twice."""
    counts = {int(r["length"]): r["count"] for r in parts.groupBy("length").count().collect()}  # at most capacity rows
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # length: first rank, times, first sequence, offset
    given: dict[int, int] = defaultdict(int)
    sequence = 0
    for content, n in plan(counts, capacity):
        offset = 0
        for s, times in content:
            runs[s].append((given[s], times, sequence, offset))
            given[s] += times * n
            offset += s * times
        sequence += n
    spark = parts.sparkSession
    rows = [(s, list(zip(*r, strict=True))) for s, r in runs.items()]
    # ranks of a length are cut into runs; the run of a rank is found inside an Arrow batch
    shared = spark.sparkContext.broadcast({s: [np.array(c, np.int64) for c in x] for s, x in rows})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        length, rank = length.to_numpy(), rank.to_numpy()
        for s in np.unique(length):
            first, times, start, offset = shared.value[int(s)]
            here = np.flatnonzero(length == s)
            run = np.searchsorted(first, rank[here], "right") - 1
            k = rank[here] - first[run]
            seq[here] = start[run] + k // times[run]
            off[here] = offset[run] + s * (k % times[run])
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    out = ranked(parts, "length", ["doc_id", "copy", "piece"], name)
    return out.withColumn("_p", place("length", "rank")).select(*parts.columns, F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.offset").alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = materialize(pieces(table(spark, sf_dir, "documents")), "pack-pieces")
    return pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
