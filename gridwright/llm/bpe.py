"""Streaming byte-pair encoding with bounded lookahead, and incremental decoding.

The encoding of a word's prefix has a unique last token: the one whose border
with the encoding before it no merge would cross. So a transducer reads symbols
from left to right and keeps that token for each place. All encodings that a
longer word can have continue one of those of the last few places; what these
have in common is stable and leaves the transducer at once. How far back it can
lie is bounded by a number that follows from the merge list (:attr:`Model.lookahead`),
so memory is constant however long a word is. Words that come again are taken
from a bounded memo of the transducer's own results.

Decoding goes token by token through a state machine that turns bytes into text
and holds at most the three bytes of an unfinished character.

Texts are read in slices; no slice, word or document is cut, and the slices'
ends have no influence on the tokens.

Defined results
---------------
* Text null or empty: no tokens; the digests are those of no bytes.
* Strings of special tokens in a text are those tokens, as with the library.
* Repeated rows give repeated results, an empty table an empty result; extra
  columns are ignored.
* A merge list is refused if a merge uses a token that a later merge makes, or
  if two merges make one token: prefixes then have no unique encoding.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, text_batches, tidy

#: Characters that are read at a time, symbols of a word from which it is streamed, and words in the memo.
SLICE, LONG, MEMO = 1 << 16, 64, 300_000
_NEVER = 1 << 60


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Model:
    """A merge list with what the transducer needs: tokens by text, births, parts, and the lookahead."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.end = end
        self.text: dict[int, str] = {i: s for s, i in vocab.items()}
        self.birth: dict[int, int] = dict.fromkeys(vocab.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            made, a, b = vocab[a + b], vocab[a], vocab[b]
            if made in self.parts:
                raise ValueError(f"two merges make {self.text[made]!r}")
            self.birth[made], self.parts[made], self.rank[a, b] = r, (a, b), r
        late = next((r for made, r in self.birth.items() if r >= 0 and max(self.birth[x] for x in self.parts[made]) > r), None)
        if late is not None:
            raise ValueError(f"merge {late} uses a token that a later one makes")
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for i, s in self.text.items():
            if self._own(i):
                (self.final if s.endswith(end) else self.inner)[s.removesuffix(end)] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        self._prefixes = {s[:i]: -1 for s in [*self.inner, *self.final] for i in range(1, len(s))} | self.inner
        self._fits: dict[int, bool] = {}
        self._lookahead = 0

    def _own(self, token: int) -> bool:
        """Whether a token's text is encoded as the token: no merge crosses one of its inner borders earlier."""
        todo = [token]
        while todo:
            t = todo.pop()
            if t in self.parts:
                a, b = self.parts[t]
                if not self._uncrossed(a, b, self.birth[t]):
                    return False
                todo += [a, b]
        return True

    def _uncrossed(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether no merge before ``until`` crosses the border between a and b.

        Goes back in time: the two tokens at the border meet from the later of their births up to where one of them
        was merged away from the border. Of equal merges the left one comes first.
        """
        rank, birth, parts = self.rank, self.birth, self.parts
        left_until = right_until = until
        if until != _NEVER:
            right_until -= 1
        while True:
            r = rank.get((a, b))
            if r is not None and r < left_until and r <= right_until:
                return False
            if birth[a] > birth[b]:
                left_until, a = birth[a], parts[a][1]
            elif birth[b] >= 0:
                right_until, b = birth[b], parts[b][0]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """Whether b can follow a in an encoding."""
        pair = a << 32 | b
        found = self._fits.get(pair)
        if found is None:
            if len(self._fits) > 2 * MEMO:
                self._fits.clear()
            found = self._fits[pair] = self._uncrossed(a, b)
        return found

    @property
    def lookahead(self) -> int:
        """Symbols behind a place that decide whether it is a border, at most.

        What is not known yet can only move to the left by merges, in the order of the list: a merge (u, v) at a place
        depends on what lies inside or at the end of v. For that, an earlier merge must have depended on something
        further right, at a place where its left part u' ends inside or at the end of v. So the bound is the longest
        chain of merges in which each one's u' is a node of the next one's v, counted in symbols of v.
        """
        if not self._lookahead:
            length = {t: len(s.removesuffix(self.end)) for t, s in self.text.items()}
            reach: dict[int, int] = {}  # by left part: the farthest so far
            for (u, v), _ in sorted(self.rank.items(), key=lambda x: x[1]):
                far, todo = length[v], [(v, 0)]
                while todo:
                    t, at = todo.pop()
                    if t in reach:
                        far = max(far, reach[t] + at + length[t])
                    if t in self.parts:
                        a, b = self.parts[t]
                        todo += [(a, at), (b, at + length[a])]
                reach[u] = max(reach.get(u, 0), far)
            self._lookahead = max(reach.values(), default=0) + 1  # the last symbol of a word is another one
        return self._lookahead

    def word(self, s: str) -> list[int]:
        """Tokens of a short word, longest first along borders that fit.

        Any such way to a place is the encoding up to there, so no place is visited twice.
        """
        final, prefixes, fits, n = self.final.get, self._prefixes.get, self.fits, len(s)
        path: list[int] = []
        open_: list[list[tuple[int, int]]] = []  # of each place on the way the (end, token) not yet tried, the longest last
        seen: set[int] = set()
        p, before = 0, -1
        while True:
            t = final(s[p:])
            if t is not None and (before < 0 or fits(before, t)):
                path.append(t)
                return path
            options = []
            for i in range(p + 1, n):
                t = prefixes(s[p:i])
                if t is None:
                    break
                if t >= 0:
                    options.append((i, t))
            open_.append(options)
            while True:
                if not options:
                    open_.pop()
                    path.pop()
                    options, before = open_[-1], path[-1] if path else -1
                    continue
                p, t = options.pop()
                if p not in seen and (before < 0 or fits(before, t)):
                    break
            path.append(t)
            before = t
            seen.add(p)


class Transducer:
    """One word, symbols in, stable tokens out."""

    def __init__(self, model: Model):
        self.model, self.before, self.held = model, -1, ""
        self.seen, self.last, self.start = "", [-1], [-1]  # symbols not yet given out, and of each place the last token and its start
        self.peak = 0

    def _read(self, s: str, ends: bool) -> None:
        m, at = self.model, len(self.seen)
        self.seen += s
        for i in range(at + 1, len(self.seen) + 1):
            tokens = m.final if ends and i == len(self.seen) else m.inner
            for p in range(max(0, i - m.longest), i):
                t = tokens.get(self.seen[p:i])
                before = self.last[p] if p else self.before
                if t is not None and (before < 0 or m.fits(before, t)):
                    self.last.append(t)
                    self.start.append(p)
                    break
        self.peak = max(self.peak, len(self.seen))

    def _path(self, i: int) -> list[int]:
        out = []
        while i > 0:
            out.append(self.last[i])
            i = self.start[i]
        return out[::-1]

    def _stable(self) -> list[int]:
        """Gives out what the encodings of the last places have in common."""
        n = len(self.seen)
        front = set(range(max(0, n - self.model.longest + 1), n + 1))
        while len(front) > 1:
            i = max(front)
            front.discard(i)
            front.add(self.start[i])
        at = front.pop()
        if at <= 0:
            return []
        out, self.before = self._path(at), self.last[at]
        self.seen = self.seen[at:]
        self.last, self.start = [-1, *self.last[at + 1 :]], [-1, *[max(p - at, 0) for p in self.start[at + 1 :]]]
        return out

    def feed(self, s: str) -> Iterator[int]:
        """Tokens that no continuation of the word can change any more."""
        s = self.held + s
        self.held, s = s[-1:], s[:-1]  # the last symbol may be the word's last
        for i in range(0, len(s), 4 * LONG):
            self._read(s[i : i + 4 * LONG], False)
            yield from self._stable()

    def finish(self) -> list[int]:
        if not self.held:
            return []
        self._read(self.held, True)
        return self._path(len(self.seen))


class Tokenizer:
    """Encodes and decodes as the library does with a file of this kind."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in pre]
        if model["type"] != "BPE" or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] or model["unk_token"] or model["dropout"]:
            raise ValueError(f"{file}: another kind of tokenizer")
        self.model = Model(model["vocab"], [tuple(x) for x in model["merges"]], model["end_of_word_suffix"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._split = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True)))
        pattern = pre[0]["pattern"]["Regex"]
        self._pieces = regex.compile(pattern)
        self._ascii = re.compile(pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r "), re.ASCII)
        self._letters = byte_letters()
        self._level = {b: c for b, c in enumerate(self._letters) if chr(b) != c}
        self._memo = _Memo(self)
        self._file, self._known, self._odd, self._library = file, set(map(chr, range(128))), {}, None

    # --- from text to words ---

    def _learn(self, c: str) -> None:
        """How the library takes a character; one that this Python's Unicode doesn't know yet gets a stand-in of its class."""
        if self._library is None:
            from tokenizers import Tokenizer as Library

            self._library = Library.from_file(self._file)
        lib, low = self._library, c.replace("Σ", "σ").lower()
        theirs = lib.normalizer.normalize_str(c)
        parts = [x for x, _ in lib.pre_tokenizer.pre_tokenize_str(f"q{theirs}")]
        own = ["".join(self._letters[b] for b in x.encode()) for x in self._pieces.findall(f"q{low}")]
        if parts != own and len(theirs) == 1:
            self._odd[c] = theirs, "q" if len(parts) == 1 else "#"
        self._known.add(c)

    def _words(self, s: str) -> list[str]:
        """Words of a normalised slice."""
        if s.isascii():
            return self._ascii.findall(s)
        if self._odd and not self._odd.keys().isdisjoint(s):
            stand = s.translate({ord(c): x for c, (_, x) in self._odd.items()})
            real = s.translate({ord(c): x for c, (x, _) in self._odd.items()})
            return [real[m.start() : m.end()] for m in self._pieces.finditer(stand)]
        return self._pieces.findall(s)

    def _normal(self, s: str) -> str:
        if s.isascii():
            return s.lower()
        s = unicodedata.normalize("NFC", s)
        if not self._known.issuperset(s):
            for c in set(s) - self._known:
                self._learn(c)
        return s.replace("Σ", "σ").lower()

    @staticmethod
    def _cut(text: str, at: int, end: int) -> tuple[int, bool]:
        """Where a slice from ``at`` may end, and whether no word can go on there: behind a blank, else before a character that joins nothing before it."""
        stop = at + SLICE
        if stop >= end:
            return end, True
        blank = max(text.rfind(" ", at, stop), text.rfind("\n", at, stop))
        if blank >= at:
            return blank + 1, True
        back = stop
        while back > at:
            c = text[back]
            if c.isascii() or unicodedata.category(c) in ("Lu", "Ll", "Lo", "So", "Nd") and not unicodedata.combining(c) and not "ᅠ" <= c <= "ᇿ":
                return back, False
            back -= 1
        while stop < end and not text[stop].isascii():
            stop += 1
        return stop, stop == end

    def _segment(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """Packed ids of text[at:end], slice by slice."""
        carry, run = "", None  # the beginning of a word that the next slice goes on with; a long word that is still open
        while at < end:
            stop, whole = self._cut(text, at, end)
            s = self._normal(text[at:stop])
            at = stop
            if run:
                letters, transducer = run
                n = len(s)
                m = (regex.match(r"\p{L}*", s) if letters else regex.match(r"[^\s\p{L}\p{N}]*", s)).end()
                yield _packed(transducer.feed(self._symbols(s[:m])))
                if m == n and not whole:
                    continue
                yield _packed(transducer.finish())
                s, run = s[m:], None
            s, carry = carry + s, ""
            words = self._words(s)
            if words and not whole and s.endswith(words[-1]):
                last = words.pop()
                if len(last) > LONG:
                    transducer = Transducer(self.model)
                    run = bool(regex.match(r"\p{L}", last)), transducer
                elif words and words[-1] == "'" and s.endswith("'" + last):
                    carry = words.pop() + last
                else:
                    carry = last
            yield b"".join(map(self._memo.__getitem__, words))
            if run:
                yield _packed(transducer.feed(self._symbols(last)))
        if carry:
            yield b"".join(map(self._memo.__getitem__, self._words(carry)))
        if run:
            yield _packed(run[1].finish())

    def _symbols(self, word: str) -> str:
        return word.encode("utf-8", "replace").decode("latin-1").translate(self._level)

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as packed little-endian 32-bit integers, in slices."""
        at = 0
        for m in self._split.finditer(text):
            yield from self._segment(text, at, m.start())
            yield _packed([self.special[m[0]]])
            at = m.end()
        yield from self._segment(text, at, len(text))

    # --- from ids to text ---

    def decoder(self, plain: bool = False) -> Decoder:
        return Decoder(self, plain)


def _packed(ids) -> bytes:
    return np.fromiter(ids, "<u4").tobytes()


class _Memo(dict):
    """Packed ids by word; emptied when full."""

    def __init__(self, tokenizer: Tokenizer):
        self.of = tokenizer

    def __missing__(self, word: str) -> bytes:
        symbols = self.of._symbols(word)
        if len(symbols) > LONG:
            transducer = Transducer(self.of.model)
            return _packed([*transducer.feed(symbols), *transducer.finish()])
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = _packed(self.of.model.word(symbols))
        return found


class Decoder:
    """Ids in, text out. As the library: the tokens' texts, parted by blanks; ``plain``: the bytes that they stand for, a blank at the end of a word."""

    def __init__(self, tokenizer: Tokenizer, plain: bool):
        end, text = tokenizer.model.end, tokenizer.model.text | {i: s for s, i in tokenizer.special.items()}
        if plain:
            byte = {c: b for b, c in enumerate(tokenizer._letters)}
            special = set(tokenizer.special.values())
            self._bytes = {i: s.encode() if i in special else bytes(byte[c] for c in s.removesuffix(end)) + b" " * s.endswith(end) for i, s in text.items()}
        else:
            self._bytes = {i: b" " + s.encode() for i, s in text.items()}
        self._state, self._skip = codecs.getincrementaldecoder("utf-8")("replace"), not plain

    def feed(self, ids: bytes) -> str:
        out = b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self._skip and out:  # the blank before the first token
            out, self._skip = out[1:], False
        return self._state.decode(out)

    def finish(self) -> str:
        return self._state.decode(b"", True)

    def restart(self) -> Decoder:
        self._state.reset()
        self._skip = True
        return self


_loaded: dict[str, tuple[Tokenizer, Decoder]] = {}


def digests(docs: DataFrame, file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    text_batches(docs.sparkSession)
    file = file or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if file not in _loaded:
            tokenizer = Tokenizer(file)
            _loaded[file] = tokenizer, tokenizer.decoder()
        tokenizer, decoder = _loaded[file]
        for batch in batches:
            out: list[tuple[int, str, str]] = []
            for text in batch.column(1).to_pylist():
                n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
                decoder.restart()
                for part in tokenizer.encode(text or ""):
                    n += len(part) // 4
                    ids.update(part)
                    decoded.update(decoder.feed(part).encode())
                decoded.update(decoder.finish().encode())
                out.append((n, ids.hexdigest(), decoded.hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
