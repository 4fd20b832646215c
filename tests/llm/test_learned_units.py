"""Centroids, phrases and tokens against brute force, SQL and the tokenizers library, with odd rows."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.llm import bpe, centroids, collocations

from .test_operators import DOCS, odd_documents

VECTORS = "vec_id long, embedding array<float>, label int"
#: Names of extra columns that clash with those inside.
CLASH = ("row", "c", "cluster", "v", "a.b", "w1", "salt")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- centroids ---------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims, scale=64, seed=1):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x):
            kept.append((i, [math.floor(scale * float(np.float32(c))) for c in x]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()))[:k]
    cs = [v for _, v in first]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs)) for _, v in kept]
        if turn < rounds:
            for j in range(len(cs)):
                own = [v for (_, v), (_, n) in zip(kept, near) if n == j]
                if own:
                    cs[j] = [sum(x) // len(own) for x in zip(*own)]
    inertia = Counter()
    for d, j in near:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    most = lambda x: min(x, (1 << 63) - 1)
    return sorted(((i, j, most(d), most(inertia[j]), most(sum(inertia.values())), sha[j]) for (i, _), (d, j) in zip(kept, near)), key=repr)


def vectors(n, dims, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dims))
    return [(i, [float(c) for c in (centre[rng.integers(5)] + spread * rng.normal(size=dims)).astype(np.float32)], 0) for i in range(n)]


def odd_vectors(dims):
    rows = vectors(150, dims, 4)
    rows += [(200, None, 1), (201, [], 1), (202, [0.5] * (dims - 1), 1), (203, [None] + [0.5] * (dims - 1), 1), (204, [math.nan] * dims, 1), (205, [math.inf] * dims, 1), (206, [0.0] * dims, 1)]
    return rows + [(207, rows[3][1], None), rows[5], rows[5], (208, [-0.0] * dims, 2)]


@pytest.mark.parametrize("rounds", [0, 3])
def test_clusters_equal_brute_force(spark, rounds):
    rows = odd_vectors(6)
    df = spark.createDataFrame(rows, VECTORS).repartition(4).withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})
    got = rows_of(centroids.cluster(centroids.kept(df, dims=6), k=7, rounds=rounds, dims=6))
    assert got == brute_clusters([r[:2] for r in rows], 7, rounds, 6)


def test_few_vectors_no_vectors_and_huge_components(spark):
    few = vectors(3, 4, 1)
    got = rows_of(centroids.cluster(centroids.kept(spark.createDataFrame(few, VECTORS), dims=4), dims=4))
    assert got == brute_clusters([r[:2] for r in few], 16, 3, 4)
    none = centroids.cluster(centroids.kept(spark.createDataFrame([], VECTORS)))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    huge = vectors(20, 4, 2) + [(30, [3e38, -3e38, 1.0, 0.0], 0), (31, [3e38, -3e38, 1.0, 0.0], 0), (32, [1e7, 2e7, 3e7, -1e7], 0)]
    got = rows_of(centroids.cluster(centroids.kept(spark.createDataFrame(huge, VECTORS), dims=4), k=3, dims=4))
    assert got == brute_clusters([r[:2] for r in huge], 3, 3, 4)


def test_bounds_leave_most_vectors_alone_and_change_nothing():
    rng = np.random.default_rng(3)
    v = np.floor(64 * (rng.normal(size=(8, 12))[rng.integers(8, size=2000)] + 0.05 * rng.normal(size=(2000, 12))))
    history, state, taken = [[[int(c) for c in x] for x in v[:16]]], None, []
    for _ in range(6):
        state = centroids.assign(v, state, history)
        taken.append(state[-1])
        d = ((v[:, None] - np.array(history[-1])[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        state = state[:-1]
        history.append([[int(c) for c in np.floor(v[state[0] == j].mean(0))] if (state[0] == j).any() else c for j, c in enumerate(history[-1])])
    assert taken[0] == 2000 * 16 and sum(taken[2:]) < 0.3 * 4 * taken[0]


def test_displacement_since_the_measure_is_not_summed():
    there_and_back = [[[0, 0]], [[30, 40]], [[0, 0]]]
    assert centroids.drifts(there_and_back)[0, 0] == 0 and centroids.drifts(there_and_back)[1, 0] == pytest.approx(50)


# --- phrases -----------------------------------------------------------------


def brute_phrases(rows, least=10, top=2000):
    import re

    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = []
    for lang in sorted(n):
        cand = {g: c for (of, g), c in f.items() if of == lang and len(g) > 1 and c >= least}
        inside = Counter()
        for g, c in cand.items():
            if len(g) == 3:
                for h in (g[:2], g[1:]):
                    inside[h] = max(inside[h], c)
        scored = []
        for g, a in cand.items():
            if not (g in inside and 100 * inside[g] >= 50 * a):
                score, k, l, r = min((Fraction(1000000 * a * a, f[lang, g[:k]] * f[lang, g[k:]]).__floor__(), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def phrase_rows():
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma", "délta", "日本", "x", "|", "the"]
    rows = []
    for i in range(300):
        parts = [rng.choice([["new", "york", "city"], ["New", "York"], ["hot", "pair", rng.choice(words)], [rng.choice(words)], ["|", "|", "|"]]) for _ in range(rng.randint(0, 25))]
        text = "".join(" ".join(p) + rng.choice([" ", "  ", "\t", ". ", "\n", "; ", "　", "!?"]) for p in parts)
        rows.append((rng.choice(["en", "de", None]), text))
    return rows + [(None, None), ("en", ""), ("en", " \t\n"), ("zz", "one two"), ("en", "word " * 20000), ("", "a b " * 30), ("en", "..!!"), ("und", "new york city")]


@pytest.mark.parametrize("least,top", [(10, 2000), (3, 7)])
def test_phrases_equal_brute_force(spark, least, top):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})
    assert rows_of(collocations.collocations(df, least=least, top=top)) == brute_phrases(rows, least, top)


@pytest.mark.parametrize("flush,bucket", [(50, 40), (7, 1_000_000), (1_000_000, 300)])
def test_tasks_and_buckets_have_no_influence(spark, monkeypatch, flush, bucket):
    monkeypatch.setattr(collocations, "FLUSH", flush)
    monkeypatch.setattr(collocations, "BUCKET", bucket)
    rows = phrase_rows()[:120] + [("en", f"hot pair {'abcdefgh'[i % 8]}") for i in range(200)] + [("en", " ".join("abcab"[i % 5] for i in range(500)))]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    batches = [b for b in df.toArrow().to_batches()]
    assert sum(int(n.sum()) for *_, n in collocations._windows(iter(batches))) == sum(r[2] for r in {(r[0], r[6], r[6]) for r in brute_phrases(rows, 1, 1)})
    buckets, hot = collocations.dealing(df.select("lang", "text"))
    assert bucket == 1_000_000 or (b"hot" in hot["en"][0] and (b"hot", b"pair") in hot["en"][1] and buckets > 10)
    assert rows_of(collocations.collocations(df)) == brute_phrases(rows)


def test_phrases_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


# --- tokens ------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(bpe.default_tokenizer())


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(bpe.default_tokenizer())


def ids(tokenizer, text):
    return np.frombuffer(b"".join(tokenizer.encode(text)), "<u4").tolist()


def odd_texts():
    rng = random.Random(2)
    kinds = ["abcdefghij", "ab", "aeiounrst", "'rstveldm!", "äöüß…日本🙂́e", "a", "ha", "abc 's\n\t", "<|endoftext|>", "가각각가", "ΣΑς İǅ", "\x00\x1c\x85　  "]
    texts = ["", "Hello  World's don't 123 <|endoftext|>x <|startoftext|>", "we're I'LL '' 'r 'lll o're've", "\U00010940x՘y Ƛ", "ﬁ é Å", "<|ENDOFTEXT|> <|endoftext|><|endoftext|>"]
    return texts + ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.choice([3, 20, 150, 600]))) for _ in range(800)]


def test_tokens_equal_the_library(own, library):
    for text in odd_texts():
        theirs = library.encode(text, add_special_tokens=False).ids
        assert ids(own, text) == theirs, text
        decoder = own.decoder()
        packed = np.array(theirs, "<u4").tobytes()
        assert decoder.feed(packed) + decoder.finish() == library.decode(theirs, skip_special_tokens=False)
        decoder.restart()  # split anywhere
        assert "".join(decoder.feed(packed[i : i + 4]) for i in range(0, len(packed), 4)) == library.decode(theirs, skip_special_tokens=False)


def test_long_words_stream_with_bounded_memory(own, library):
    rng = random.Random(4)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(60_000))
    for text in (word, "a" * 150_000, "!'" * 70_000, "日本語" * 40_000, "́" * 70_000 + "x", ("ab" * 35_000 + "'s ") * 2, "é" * 70_000, "x" * 65_535 + "'re x", "y" * 65_530 + " '" + "ve" * 40_000):
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids
    for w in (word, "a" * 60_000):
        t = bpe.Transducer(own.model)
        out = [*t.feed(w[:1000]), *t.feed(w[1000:]), *t.finish()]
        assert out == library.encode(w, add_special_tokens=False).ids
        assert t.peak <= own.model.lookahead + 2 * own.model.longest + 8 * bpe.LONG


def test_slices_have_no_influence(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 7)
    for text in odd_texts()[:400]:
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids, text


def test_plain_decoding_gives_the_words_back(own):
    decoder = own.decoder(plain=True)
    packed = b"".join(own.encode("Größe  日本🙂 don't 42<|endoftext|>é"))
    assert "".join(decoder.feed(packed[i : i + 4]) for i in range(0, len(packed), 4)) + decoder.finish() == "größe 日本 🙂 don 't 4 2 <|endoftext|>é "
    decoder.restart()
    assert decoder.feed(packed[:4]).isascii()


def brute_bpe(symbols, merges):
    word = list(symbols)
    for a, b in merges:
        i, out = 0, []
        while i < len(word):
            if i + 1 < len(word) and (word[i], word[i + 1]) == (a, b):
                out.append(a + b)
                i += 2
            else:
                out.append(word[i])
                i += 1
        word = out
    return word


def test_random_merge_lists_and_their_lookahead():
    rng = random.Random(6)
    for _ in range(40):
        tokens, merges = ["a", "b", "c", "a$", "b$", "c$"], []
        while len(merges) < 25:
            a, b = rng.choice([t for t in tokens if not t.endswith("$")]), rng.choice(tokens)
            if a + b not in tokens and len(a + b) < 12:
                tokens.append(a + b)
                merges.append((a, b))
        model = bpe.Model({t: i for i, t in enumerate(tokens)}, merges, "$")
        for _ in range(60):
            w = "".join(rng.choice("abc" if rng.random() < 0.5 else "ab") for _ in range(rng.randint(1, 120)))
            want = brute_bpe([*w[:-1], w[-1] + "$"], merges)
            assert [tokens[i] for i in model.word(w)] == want
            t, given = bpe.Transducer(model), []
            for i, c in enumerate(w):
                given += t.feed(c)
                assert [tokens[x] for x in given] == want[: len(given)]
                assert i + 1 - sum(len(tokens[x]) for x in given) <= model.lookahead + 2 * model.longest + 1
            assert [tokens[i] for i in given + t.finish()] == want


def test_unfit_merge_lists_are_refused():
    with pytest.raises(ValueError):
        bpe.Model({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")], "$")
    with pytest.raises(ValueError):
        bpe.Model({"a": 0, "aa": 1, "aaa": 2}, [("a", "a"), ("aa", "a"), ("a", "aa")], "$")


def test_token_digests_of_odd_documents(spark, library):
    rows = odd_documents()
    got = rows_of(bpe.digests(spark.createDataFrame(rows, DOCS).repartition(5).withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})))
    want = []
    for i, text, *_ in rows:
        e = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.digests(spark.createDataFrame([], DOCS)).count() == 0


# --- queries -----------------------------------------------------------------


@pytest.mark.parametrize("query,sql", [(centroids.query, centroids.SQL), (collocations.query, collocations.SQL)])
def test_query_equals_sql(spark, query, sql):
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    theirs = con.execute(sql).df()
    mine = query(spark, sf).toPandas()[list(theirs.columns)]
    cols = list(theirs.columns)
    assert mine.dtypes.equals(theirs.dtypes)
    assert mine.sort_values(cols).reset_index(drop=True).equals(theirs.sort_values(cols).reset_index(drop=True))


def test_token_query(spark, library):
    got = {r.doc_id: r for r in bpe.query(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        e = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(e) and got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
