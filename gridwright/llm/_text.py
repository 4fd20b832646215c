"""Words and their 64-bit hashes, straight from the UTF-8 bytes of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: An odd multiplier, so that it has an inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


#: Bytes that are hashed at a time.
CHUNK = 1 << 17
_up = _powers(_P, CHUNK + 4096)
_down = _powers(_P_INV, CHUNK + 4096)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for ``n`` places; longer tables than the usual ones (one very long word) are not kept."""
    return (_up, _down) if n <= len(_up) else (_powers(_P, n), _powers(_P_INV, n))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the batch and the offsets of its texts (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


#: Bytes that part words: blank and 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of the batch, first word of each text and the total).

    Words are the maximal runs of bytes other than blank and 9 to 13, after
    A-Z are lower-cased. A word's hash depends on its bytes alone. Long texts
    are hashed from the same prefix sums; no text is cut.
    """
    data, at = utf8(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    space = IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    inner = at[(at > 0) & (at < n)]
    first[inner] = True
    start = ~space
    start[1:] &= space[:-1] | first[1:n]
    end = np.zeros(n + 1, bool)
    end[1:n] = ~space[:-1] & (space[1:] | first[1:n])
    end[n] = not space[-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        base = s[i]
        j = max(i + 1, int(np.searchsorted(e, base + CHUNK, "right")))
        part = data[base : e[j - 1]]
        up, down = _grown(len(part) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((LOWER[part].astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
            out[i:j] = (total[e[i:j] - base] - total[s[i:j] - base]) * down[s[i:j] - base]
        i = j
    return mix(out), np.searchsorted(s, at)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words of one text; the whole text if shorter.

    A shorter text's hash also depends on its number of words.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    take = min(n, k)
    out = np.full(n - take + 1, take, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(take):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[i : n - take + 1 + i])
    return out
