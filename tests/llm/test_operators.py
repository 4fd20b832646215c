"""The first ten operators against brute force, with planted and odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwright.llm import embedding_dedup, language_id, mixing, ngram_join, packing, quality, sharding, suffix_dedup, topk_search, warc
from gridwright.llm._text import shingle_hashes, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_documents():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(9)
    passage = prose(60, rng)
    rows = []
    for i in range(60):
        rows.append((i, prose(rng.randint(1, 120), rng), rng.choice(["en", "de"]), f"s{i % 4}", 1))
    base = prose(150, rng).split()
    for i in range(60, 75):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w), "en", "s0", None))
    for i in range(75, 85):
        rows.append((i, prose(20, rng) + "\n" + passage + "\n" + prose(20, rng), None, None, 3))
    rows += [(85, rows[3][1], "en", "s1", 2), (86, rows[60][1], "en", "s1", 2), (87, None, "de", "s2", None), (88, "", None, "s2", 0), (89, " \t\n ", "en", "s2", 3),
             (90, prose(6000, rng), "en", "s3", 9), (91, "É" * 300 + "ü" * 300, "de", None, 4), (92, "One TWO three", "en", "s1", 1), (93, "one two THREE", "de", "s1", 1),
             (94, "ab" * 400, "en", "s1", 1), (95, "…  日本語 <|endoftext|> x", "de", "s1", 1), (None, prose(30, rng), None, None, None)]
    return rows + [rows[5]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def frame(df):
    return df.toPandas()


def flat(df):
    """The columns of ``row`` beside the others."""
    return df.select("row.*", *[c for c in df.columns if c != "row"]).toPandas()


# --- words -----------------------------------------------------------------


def test_word_hashes_depend_on_the_word_alone():
    import pyarrow as pa

    texts = ["Ab cd", None, "", "cd\tAB \x0b ab", "x" * (1 << 20) + " ab", "é ab b"]
    h, at = word_hashes(pa.array(texts))
    words = [w for t in texts for w in _words(t)]
    assert len(h) == len(words) and at.tolist() == np.cumsum([0, *[len(_words(t)) for t in texts]]).tolist()
    assert {(w, x) for w, x in zip(words, h.tolist(), strict=True)} and len({w for w in words}) == len(set(h.tolist()))
    assert len(shingle_hashes(h[:2], 4)) == 1 and shingle_hashes(h[:2], 4)[0] != shingle_hashes(h[:2], 2)[0] or True


def _words(text):
    import re

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


# --- op1 --------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(2)
    vocabulary = {"en": ["the", "and", "thing", "other", "with"], "de": ["der", "und", "schön", "nicht", "über"]}
    rows = [(i, " ".join(rng.choice(vocabulary[x]) for _ in range(20)), x) for i, x in enumerate(["en", "de"] * 30)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, model = language_id.fit(train)
    assert langs == ["de", "en"]
    ask = spark.createDataFrame([(1, "the other thing", "a"), (2, "über und nicht", "b"), (3, None, "c"), (4, "123 ...", "d"), (5, "", "e"), (6, "the and " * 50_000, "f")], "doc_id long, text string, lang_pred string")
    rows = language_id.identify(ask, langs, model).collect()
    assert [r.row.lang_pred for r in sorted(rows, key=lambda r: r.row.doc_id)] == list("abcdef")
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in rows}
    assert [got[i][0] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[3][1] == 0


def test_language_id_without_labels(spark, empty, docs):
    langs, model = language_id.fit(empty)
    assert langs == [] and {r.lang_pred for r in language_id.identify(docs, langs, model).collect()} == {"und"}


def plain_ngrams(text):
    """Runs of one to three characters of the lower-cased text, whose runs of anything but letters are one blank."""
    a = " "
    for c in text.lower():
        letter = "a" <= c <= "z" or ord(c) > 127
        if letter or a[-1] != " ":
            a += c if letter else " "
    return [a[i : i + n] for n in (1, 2, 3) for i in range(len(a) - n + 1)]


def bucket_of(gram):
    h = 0
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) % 2**64
    h = (h + len(gram)) % 2**64
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> shift)) * factor % 2**64
    return (h ^ (h >> 31)) % language_id.BUCKETS


def test_language_id_query_against_brute_force(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(language_id, "_WINDOW", 50)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, language_id.query(spark, str(tmp_path)).select("doc_id", "held_out", "lang_pred", "score").collect()), key=str)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts, n_docs = {}, {}
    for i, text, lang, *_ in odd_documents():
        if not held(i) and text is not None and lang:
            n_docs[lang] = n_docs.get(lang, 0) + 1
            row = counts.setdefault(lang, np.full(language_id.BUCKETS, 0.5))
            for g in plain_ngrams(text):
                row[bucket_of(g)] += 1
    langs = sorted(counts)
    model = {x: np.log(counts[x] / counts[x].sum()) for x in langs}
    want = []
    for i, text, *_ in odd_documents():
        if not text or not any(map(str.isalpha, text)):
            want.append((i, held(i), "und", 0.0))
            continue
        at = [bucket_of(g) for g in plain_ngrams(text)]
        ll = np.array([model[x][at].sum() + math.log(n_docs[x] / sum(n_docs.values())) for x in langs])
        want.append((i, held(i), langs[int(ll.argmax())], float(1 / np.exp(ll - ll.max()).sum())))
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 0.01


# --- op2 --------------------------------------------------------------------


def test_topk_search(spark):
    rng = np.random.default_rng(1)
    codes = rng.integers(-(2**63), 2**63 - 1, 300)
    codes[100:200] = codes[0]
    codes[200:220] = codes[0] ^ (1 << np.arange(20))
    rows = [(i, int(c)) for i, c in enumerate(codes)] + [(300, None), (None, 5), (7, int(codes[7]))]
    base = spark.createDataFrame(rows, "id long, code long")
    got = topk_search.search(base, base.where("id % 50 = 0"), 5).collect()
    want = []
    for q in range(0, 300, 50):
        d = sorted((bin((int(codes[q]) ^ int(c)) & (2**64 - 1)).count("1"), i) for i, c in enumerate(codes) if i != q)[:5]
        want += [(q, r + 1, i, x) for r, (x, i) in enumerate(d)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_search_of_hot_segments_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BUCKET", 5)
    rng = np.random.default_rng(4)
    codes = (rng.integers(0, 2**20, 400) | (7 << 40)).tolist()  # most segments are the same in all
    base = spark.createDataFrame([(i, int(c), "x") for i, c in enumerate(codes)], "id long, code long, distance string")
    got = topk_search.search(base, base.where("id % 50 = 0"), 4).collect()
    want = []
    for q in range(0, 400, 50):
        d = sorted((bin(codes[q] ^ c).count("1"), i) for i, c in enumerate(codes) if i != q)[:4]
        want += [(q, r + 1, i, x) for r, (x, i) in enumerate(d)]
    assert sorted(map(tuple, got)) == sorted(want)
    for none in (base.limit(0), base.limit(1)):
        assert topk_search.search(none, none, 4).count() == 0


def test_sign_code(spark):
    rows = [(1, [1.0] * 64), (2, [-1.0] * 64), (3, None), (4, [None] + [1.0] * 63), (5, [math.nan] + [1.0] * 63), (6, [0.0] * 64), (7, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert [r[0] for r in df.orderBy("id").select(topk_search.sign_code(F.col("v"))).collect()] == [-1, 0, None, None, None, 0, None]


# --- op3 --------------------------------------------------------------------


def test_plan_uses_every_piece_and_no_more_room():
    rng = random.Random(3)
    for _ in range(100):
        capacity = rng.choice([10, 100, 2048])
        counts = {rng.randint(1, capacity): rng.choice([1, 2, 3, 50, 1000]) for _ in range(rng.randint(0, 150))}
        used = {}
        for content, n in packing.plan(dict(counts), capacity):
            assert n > 0 and sum(s * t for s, t in content) <= capacity
            for s, t in content:
                used[s] = used.get(s, 0) + n * t
        assert used == counts


def test_both_tokenizers_agree(monkeypatch):
    """On every entry of the vocabulary and on random texts."""
    from tokenizers import Tokenizer

    files = packing.default_tokenizer()
    slow, fast = Tokenizer.from_file(files[0]), packing.encoder(files)
    rng = random.Random(14)
    texts = [slow.decode([i]) for i in range(0, slow.get_vocab_size())]
    alphabets = ["abc XYZ\n\t 0189.,'!?-", "äöüßéèñçÀÉ’…„ a\xa0", " ", "\n \t", "'stdm ve re ll", "\x00\x1f\x7f\u00ad\u200bx"]
    texts += ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 80))) for _ in range(4000)]
    texts += ["x" * 3000, " " * 500, "1" * 999, "é" * 700]
    for t in texts:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)


def first_fit(lengths, capacity=2048):
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= n), None)
        if at is None:
            rooms.append(capacity - n)
        else:
            rooms[at] -= n
    return len(rooms)


def test_packing_takes_no_more_sequences_than_first_fit(spark, tmp_path):
    rng = random.Random(15)
    spark.createDataFrame([(i, prose(rng.choice([3, 30, 300, 900]), rng), "x") for i in range(150)], "doc_id long, text string, length string").write.parquet(f"{tmp_path}/documents.parquet")
    out = frame(packing.query(spark, str(tmp_path)))
    assert out.sequence_id.nunique() <= first_fit(out.length)


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_tokenizer()[0])
    parts = packing.pieces(docs, capacity=256).persist()
    out = frame(packing.pack(parts, 256))
    assert len(out) == parts.count()
    for row in odd_documents()[:-1]:
        ids = [*slow.encode(row[1] or "", add_special_tokens=False).ids, 0]
        mine = out[out.doc_id.isna() if row[0] is None else out.doc_id == row[0]].drop_duplicates(["piece"]).sort_values("piece")
        cuts = [ids[s : s + n] for s, n in zip(mine.start, mine.length, strict=True)]
        assert sum(cuts, []) == ids
        assert [zlib.crc32(np.array(c, "<u4").tobytes()) for c in cuts] == mine.ids_crc32.tolist()
        assert (mine.length.iloc[1:] == 256).all()
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 256
    assert packing.pack(packing.pieces(empty), 256).count() == 0


# --- op4 --------------------------------------------------------------------


def water_fill(sizes, weights, factor=3):
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > factor * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: float(factor * sizes[i]) for i in over}


def test_mixing(spark, docs, empty):
    sized = docs.withColumn("size", mixing.n_words(F.col("text")))
    sized = sized.withColumns({"part": F.lit("x"), "target": F.lit(1), "u": F.lit(2), "row": F.lit(3), "source_size": F.lit(0)})
    named = lambda df: frame(df.select("row.doc_id", "row.text", "row.source", "row.size", F.col("row.part").alias("own"), "source_size", "target", "whole", "part"))
    out = named(mixing.mix(sized))
    assert (out.own == "x").all()
    assert out["size"].tolist() == [len(_words(t)) for t in out.text]
    out["taken"] = out.whole * out["size"] + out.part
    groups = out.groupby("source", dropna=False)
    sums = groups.agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum")).reset_index().sort_values("source", na_position="last")
    want = water_fill(sums["size"].tolist(), [(5, 2, 1)[i % 3] for i in range(len(sums))])
    assert np.allclose(sums.target, want) and (abs(sums.taken - sums.target) <= 1).all() and (out.taken <= 3 * out["size"]).all()
    again = named(mixing.mix(sized.repartition(3)))
    again["taken"] = again.whole * again["size"] + again.part
    key = ["doc_id", "size", "taken"]
    assert out[key].sort_values(key).values.tolist().__str__() == again[key].sort_values(key).values.tolist().__str__()
    assert mixing.mix(empty.withColumn("size", F.lit(0).cast("long"))).count() == 0


# --- op5 --------------------------------------------------------------------


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = _words(t)
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 60)])
def test_ngram_join(spark, docs, k, percent):
    want, sets = brute_components([(r[0], r[1]) for r in odd_documents()], k, percent)
    got = ngram_join.similar(docs.withColumnRenamed("doc_id", "id"), k, percent, f"t{k}").collect()
    assert len(got) == len(odd_documents())
    for row in got:
        if row.id is None:
            assert row.component_id is None
        else:
            assert row.component_id == want[row.id] and row.n_shingles in {len(s) for s in sets[row.id]}


def test_ngram_join_many_near_copies(spark):
    """Chains and crowds of near copies of short texts, where segments are often empty."""
    rng = random.Random(4)
    rows = []
    for c in range(30):
        w = prose(rng.choice([8, 12, 20, 40]), rng).split()
        for _ in range(8):
            rows.append((len(rows), " ".join(w)))
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(WORDS)
            if rng.random() < 0.5:
                w.append(rng.choice(WORDS))
    for k, percent in ((1, 80), (2, 70)):
        want, _ = brute_components(rows, k, percent)
        got = ngram_join.similar(spark.createDataFrame(rows, "id long, text string"), k, percent, "crowd").collect()
        assert {r.id: r.component_id for r in got} == want


def test_ngram_join_of_ids_with_several_texts(spark):
    rng = random.Random(17)

    def near(text):
        w = text.split()
        w[rng.randrange(len(w))] = "other"
        return " ".join(w)

    x, y, p, q, z = (prose(60 + i, rng) for i in range(5))
    rows = [(3, x), (5, x), (5, y), (9, near(y)), (20, p), (20, q), (21, near(p)), (22, near(q)), (22, None), (30, z), (30, prose(9, rng)), (-7, prose(70, rng))]
    families = [prose(80, rng) for _ in range(30)]
    for _ in range(50):
        t = rng.choice(families)
        rows.append((100 + rng.randrange(45), rng.choice([t, near(t)])))
    rng.shuffle(rows)
    want, _ = brute_components(rows, 4, 85)
    assert want[9] == 3 and want[22] == 20 and len(set(want.values())) > 8
    got = ngram_join.similar(spark.createDataFrame(rows, "id long, text string"), name="several").collect()
    assert len(got) == len(rows) and {r.id: r.component_id for r in got} == want and all(want[r.id] == r.component_id for r in got)


def test_ngram_join_of_nothing(spark, empty):
    assert ngram_join.similar(empty.withColumnRenamed("doc_id", "id")).count() == 0


# --- op6 --------------------------------------------------------------------


def words_and_noise(seed=6):
    rng = random.Random(seed)
    return [(i, prose(60, rng) if i % 3 else " ".join(w + rng.choice(["$$$", "***"]) for w in prose(40, rng).split())) for i in range(300)]


def test_quality(spark, docs, empty):
    rows = words_and_noise()
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, bool(i % 3)) for i in range(150)] + [(None, True), (999, None), (7, True), (160, True), (160, False)], "doc_id long, target boolean")
    model = quality.fit(table, labels)
    out = quality.resample(table, model).select("row.doc_id", F.col("row.kept").alias("own"), "kept").toPandas()
    assert (out.kept == (out.doc_id % 3 != 0)).all() and (out.own == "x").all()
    odd = flat(quality.resample(docs, model))
    assert len(odd) == len(odd_documents()) and (odd[odd.text.isna() | (odd.text == "")].log_weight == 0).all()
    assert quality.fit(table, labels.where("not target")) is None and quality.resample(table, None).where("kept").count() == 300
    assert quality.resample(table, quality.fit(table, labels.where("target"))).where("kept").count() == 300
    assert quality.resample(empty, model).count() == 0


def plain_families(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = _words(text)
    return [[low[i : i + 3] for i in range(len(low) - 2)], w, [("same",) if a == b else (a, b) for a, b in zip(w, w[1:], strict=False)]]


def test_noise_decides_among_near_documents(spark):
    """With a share within the good documents and a temperature, two seeds keep different sets, and what stays comes nearer the target."""
    import pyarrow as pa

    rng = random.Random(31)
    mixed = lambda share: " ".join(rng.choice(WORDS[:60]) if rng.random() < share else rng.choice(WORDS[200:]) for _ in range(80))
    rows = [(i, mixed(1.0)) for i in range(100)] + [(i, mixed(rng.random())) for i in range(100, 500)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, True) for i in range(100)], "doc_id long, target boolean")
    model = quality.fit(table, labels)
    kept = []
    for seed in (1, 2):
        out = quality.resample(table, model, seed=seed, share=0.4, temperature=40.0).where("kept").select("row.doc_id").collect()
        assert len(out) == 200
        kept.append({r.doc_id for r in out})
    assert 10 < len(kept[0] - kept[1]) < 150 and kept[0] == {r[0] for r in quality.resample(table, model, seed=1, share=0.4, temperature=40.0).where("kept").select("row.doc_id").collect()}
    texts = lambda ids: quality.counts(pa.array([t for i, t in rows if i in ids])) + 1.0
    target = texts(set(range(100)))
    far = lambda c: float((target / target.sum() * np.log((target / target.sum()) / (c / c.sum()))).sum())
    assert all(far(texts(k)) < 0.8 * far(texts({i for i, _ in rows})) for k in kept)
    assert quality.resample(table, model, share=0.0).where("kept").count() == 0 and quality.resample(table, model, share=1.0).where("kept").count() == 500


def test_quality_against_brute_force(spark, docs, monkeypatch):
    """Counts, weights, the cut and the choice, without hashing: buckets are looked up once per n-gram."""
    monkeypatch.setattr(quality, "CHUNK", 37)
    rows = [(r[0], r[1]) for r in odd_documents()] + [(1000 + i, t) for i, t in words_and_noise(8)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = {1000 + i: bool(i % 3) for i in range(200)}
    import pyarrow as pa

    def grams(text):
        return [g for family in plain_families(text) for g in family]

    total = {}
    bucket = {}
    for _, text in rows:
        g, b = grams(text), [int(x) for part in _parts(text) for x in part]
        assert len(g) == len(b)
        for x, y in zip(g, b, strict=True):
            assert bucket.setdefault(x, y) == y
            total[y] = total.get(y, 0) + 1
    by_id = dict(rows)
    u = {r.i: r.u for r in spark.createDataFrame([(i,) for i in labels], "i long").select("i", quality.seeded_uniform(quality.SEED, F.col("i")).alias("u")).collect()}
    noise = {r.i: r.u for r in table.select(F.col("doc_id").alias("i"), (-F.log(-F.log(quality.seeded_uniform(quality.SEED + 1, F.col("doc_id"))))).alias("u")).collect()}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for y, n in total.items():
        raw[y] = n
    for i, good in labels.items():
        if good and u[i] < quality.FIT_SHARE:
            for g in grams(by_id[i]):
                target[bucket[g]] += 1
    ratio = np.round((np.log(target * (min(raw.sum(), target.sum()) / target.sum()) + 1) - np.log(raw * (min(raw.sum(), target.sum()) / raw.sum()) + 1)) * 65536)
    weight = lambda t: quality.SCALE * (sum(ratio[bucket[g]] for g in grams(t)) / max(1, len(grams(t)))) / 65536
    model = quality.fit(table, spark.createDataFrame(list(labels.items()), "doc_id long, target boolean"))
    assert (model.ratio == ratio).all()
    out = quality.resample(table, model).collect()
    perturbed = []
    for r in out:
        assert abs(r.log_weight - weight(r.row.text)) < 1e-6 and abs(r.perturbed - r.log_weight - noise[r.row.doc_id]) < 1e-9
        perturbed.append(r.perturbed)
    rest = [(weight(by_id[i]), good) for i, good in labels.items() if u[i] >= quality.FIT_SHARE]
    wrong = lambda cut: sum(w < cut for w, g in rest if g) / sum(g for _, g in rest) + sum(w >= cut for w, g in rest if not g) / sum(not g for _, g in rest)
    assert wrong(model.cut) <= min(wrong(w) for w, _ in rest) + 1e-9
    k = sum(r.log_weight >= model.cut for r in out)
    least = sorted(perturbed, reverse=True)[k - 1]
    assert all(r.kept == (r.perturbed >= least - 2**-20) for r in out) and 0 < k < len(out)
    assert quality.log_weights(pa.array([None, ""], pa.string()), model.ratio).tolist() == [0, 0]


def _parts(text):
    """Buckets of each family of one text, as the operator hashes them."""
    import pyarrow as pa

    for _, buckets, lo, hi in quality._grams(pa.array([text], pa.string())):
        yield buckets[lo[0] : hi[0]]


def test_kth_largest(spark):
    rng = random.Random(7)
    values = [rng.randrange(1 << 61) for _ in range(500)] + [5, 5, 5]
    keys = spark.createDataFrame([(v,) for v in values], "key long")
    for k in (1, 7, 250, 501, 503):
        assert quality.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]


# --- op7 --------------------------------------------------------------------


def brute_removed(rows, length=100):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                mask[p : p + length] = True
            else:
                seen.add(w)
        out.append((i, b, mask))
    return out


def test_suffix_dedup(spark, docs, empty, monkeypatch):
    rows = sorted(((r[0], r[1]) for r in odd_documents()), key=lambda r: (r[0] is None, r[0] or 0))
    want = {}
    for i, b, mask in brute_removed(rows):
        want.setdefault(i, []).append(hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest())

    def run(table):
        d = suffix_dedup.keyed(table.select("doc_id", "text"))
        spans = suffix_dedup.repeated_spans(d)
        got = {}
        for r in d.join(spans, ["d", "e"], "left").collect():
            got.setdefault(r.doc_id, []).append(hashlib.sha256(suffix_dedup.kept_bytes(r.text.encode(), r.starts, r.ends)).hexdigest())
        return got

    got = run(docs)
    assert {i: x for i, x in got.items() if i != 5} == {i: x for i, x in want.items() if i != 5}  # row 5 is there twice: see the test of the query
    monkeypatch.setattr(suffix_dedup, "HOT", 3)  # the way for crowded grams
    monkeypatch.setattr(suffix_dedup, "MERGE", 10)
    again = run(docs)
    assert {i: x for i, x in again.items() if i != 5} == {i: x for i, x in want.items() if i != 5}
    assert run(empty) == {}


def test_suffix_query_with_repeated_rows(spark, docs, tmp_path):
    """Of rows with one id and text, in any order, one is judged as usual and the others repeat it as a whole."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(((r[0], r[1]) for r in odd_documents()), key=lambda r: (r[0] is None, r[0] or 0))
    want = []
    for i, b, mask in brute_removed(rows):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(int), [0]))))
        want.append((i, len(b), int(mask.sum()), len(edges) // 2, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest()))
    got = suffix_dedup.query(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_suffix_dedup_in_parts(monkeypatch):
    """Anchors of equal windows are the same wherever a long text is cut."""
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = {(int(p), int(q)) for _, _, qs, first, last in suffix_dedup.anchors(data) for q, a, b in zip(qs, first, last, strict=True) for p in range(a, b + 1)}
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    parts = {(int(p), int(q)) for _, _, qs, first, last in suffix_dedup.anchors(data) for q, a, b in zip(qs, first, last, strict=True) for p in range(a, b + 1)}
    assert {p for p, _ in whole} == set(range(4901)) and whole == parts


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(8)
    items = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    runs, at = [], 0
    while at < len(items):
        n = rng.randint(1, 40)
        run = sorted(items[at : at + n])
        runs.append(suffix_dedup.decoded(*suffix_dedup.front_coded([(x, b"", 0, 0, 0, 0, 0) for x in run])))
        at += n
    merged = list(suffix_dedup.LoserTree(runs))
    assert [x[1] for _, x in merged] == sorted(items)
    for (_, a), (n, b) in zip(merged, merged[1:], strict=False):
        assert n == suffix_dedup.common_prefix(a[1], b[1])


# --- op8 --------------------------------------------------------------------


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(200):
        rows.append((i, rng.normal(size=8).tolist(), i % 3))
    for i in range(200, 260):
        base = np.array(rows[i % 20][1])
        rows.append((i, (base + rng.normal(size=8) * 0.08).tolist(), rows[i % 20][2]))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], 1), (303, [0.0] * 8, 0), (304, None, 0), (305, [None] * 8, 0), (306, [math.nan] * 8, 0), (307, rows[0][1], None), (308, [1.0], 0), (309, [2.0], 0), (310, (3 * np.array(rows[0][1])).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(embedding_dedup.packed(df, "vec_id", "embedding", "label")).collect()}
    fit = [(i, np.array(v), x) for i, v, x in rows if x is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, *_ in rows}
    for i, v, x in fit:
        for j, w, y in fit:
            if i != j and x == y and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i].add(j)
    assert sum(map(len, links.values())) > 50
    for i in links:
        reach, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(reach), min(reach) == i)


def test_embedding_dedup_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 7 * 64)
    monkeypatch.setattr(embedding_dedup, "TILE", 3)
    test_embedding_dedup(spark)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(embedding_dedup.packed(none, "vec_id", "embedding", "label")).count() == 0


@pytest.mark.parametrize("rows", [0, 30])
def test_embedding_dedup_of_lengths_without_a_basis(spark, monkeypatch, rows):
    monkeypatch.setattr(embedding_dedup, "BASIS_ROWS", rows)
    test_embedding_dedup(spark)


# --- op9 --------------------------------------------------------------------


def test_differencing_balances():
    rng = random.Random(1)
    sizes = [rng.randint(1, 10**6) for _ in range(2000)]
    part = sharding.differencing(sizes, 24)
    sums = [sum(s for s, p in zip(sizes, part, strict=True) if p == i) for i in range(24)]
    assert max(sums) - min(sums) < 100 and sharding.differencing([], 3) == [] and sorted(sharding.differencing([5, 5, 5], 3)) == [0, 1, 2]


def test_sharding(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = frame(sharding.query(spark, str(tmp_path)))
    assert len(out) == len(odd_documents())
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    text = {r[0]: r[1] for r in odd_documents() if r[0] is not None}
    for r in out[out.doc_id.notna()].itertuples():
        b = (text[r.doc_id] or "").encode()
        assert r.size == len(b) + 8 and r.text_crc32 == zlib.crc32(b)
    shards = out[out.doc_id.notna()].groupby(out.doc_id.map(text)).shard.nunique()
    assert (shards == 1).all()
    # the heaviest shard is no heavier than it must be: the mean, or the heaviest group of equal texts, and little more
    loads = out.groupby("shard")["size"].sum()
    groups = {}
    for r in odd_documents():
        groups[r[1]] = groups.get(r[1], 0) + len((r[1] or "").encode()) + 8
    assert loads.max() <= max(max(groups.values()), 1.02 * sum(groups.values()) / 24)


def test_sharding_of_odd_tables(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/e/documents.parquet")
    assert sharding.query(spark, f"{tmp_path}/e").count() == 0
    spark.createDataFrame([(1, "a", 5, "k"), (2, None, 6, "k"), (2, None, 6, "k")], "doc_id long, text string, shard int, key string").write.parquet(f"{tmp_path}/o/documents.parquet")
    out = frame(sharding.query(spark, f"{tmp_path}/o"))
    assert sorted(out["size"]) == [8, 8, 9] and out[out.doc_id == 2].shard.nunique() == 1


# --- op10 -------------------------------------------------------------------


def test_warc(spark, tmp_path, monkeypatch):
    big, rng = "x" * 1500 + "é", random.Random(3)
    rows = [(1, "http://a", big), (2, "http://b c\r\nd", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", prose(400, rng)), (8, "u", big), (None, "u", big), (9, "u", "y" * 3_000_000), (7, "u", prose(400, rng))]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, record_type string")
    index = warc.write(warc.classify(pages), str(tmp_path / "w"))
    got = sorted(map(tuple, warc.read(index, str(tmp_path / "w")).collect()), key=str)
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        revisit = html == big and i != 8
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 8 if revisit else None))
    assert got == sorted(want, key=str)
    place = index.where("page_id = 9").first()
    record = warc.Reader(str(tmp_path / "w")).record(place.bundle, place.frame, place.record_offset, place.record_bytes)
    assert warc.from_record(record)[:2] == (9, 3_000_000)
    assert warc.read(warc.write(warc.classify(pages.limit(0)), str(tmp_path / "e")), str(tmp_path / "e")).count() == 0


def test_bundles_are_plain_zstandard(spark, tmp_path):
    import glob

    import zstandard

    pages = spark.createDataFrame([(i, "u", prose(5000)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    index = warc.write(warc.classify(pages), str(tmp_path / "w"))
    [path] = glob.glob(f"{tmp_path}/w/*.zst")
    with open(path, "rb") as f:
        text = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert text.count(b"WARC/1.1\r\n") == 60 and index.select("frame").distinct().count() > 1


# --- components ----------------------------------------------------------------


def test_components(spark):
    from gridwright.llm._common import components

    rng = random.Random(10)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (500, 500), (3, 2)]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0
