"""Stages of the corpus pipeline on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline
from .test_operators import DOCS, _words, brute_components, brute_removed, odd_documents, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    rng = random.Random(12)
    rows = odd_documents() + [(200 + i, " ".join(w + "$$$" for w in prose(40, rng).split()), "en", "s0", 1) for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 1, i) for i, r in enumerate(rows)], DOCS + ", row string, kept int, `a.b` int")
    df.write.parquet(f"{top}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows if r[0] is not None and r[0] < 60] + [(200 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, corpus).persist()
        seen[name] = (before.toPandas(), docs.toPandas())
        if name != "best-fit packing":
            assert docs.columns == before.columns
    before, after = seen["quality classifier"]
    assert not set(range(200, 240)) & set(after.doc_id.dropna()) and set(range(60)) <= set(after.doc_id.dropna())
    before, after = seen["n-gram Jaccard join"]
    want, _ = brute_components(list(zip(before.doc_id.astype(object).where(before.doc_id.notna(), None), before.text, strict=True)), 5, 80)
    assert sorted(after.doc_id.dropna()) == sorted({i for i, c in want.items() if i == c})
    before, after = seen["suffix-array dedup"]
    removed = {i: bytes(x for x, m in zip(b, mask, strict=True) if not m).decode(errors="ignore") for i, b, mask in brute_removed(sorted(zip(before.doc_id.fillna(10**9), before.text, strict=True)))}
    got = dict(zip(after.doc_id.fillna(10**9), after.text, strict=True))
    assert all(got[i] == t or (not t and not got[i]) for i, t in removed.items() if i in got) and all(not t for i, t in removed.items() if i not in got)
    before, after = seen["mixing sources to target weights"]
    words = lambda f: f.groupby(f.source.fillna("~")).text.apply(lambda s: sum(len(_words(t)) for t in s))
    assert (words(after) <= 3 * words(before)[words(after).index]).all()
    before, after = seen["best-fit packing"]
    assert set(after.doc_id.dropna()) == set(before.doc_id.dropna()) and (after.groupby("sequence_id").length.sum() <= 2048).all()


def test_empty_corpus(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
        assert docs.count() == 0


def test_mixing_keeps_texts_whole(spark):
    rng = random.Random(21)
    rows = [(i, prose(rng.randint(1, 40), rng), "en", f"s{i % 5}", 1) for i in range(60)]
    rows += [(60, prose(5000, rng), "en", "s0", 1), (61, prose(900, rng), "en", "t0", 1), (62, prose(700, rng), "en", "t1", 1), (63, prose(800, rng), "en", "t2", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.mixing_stage(spark, docs, "").toPandas()
    text = {r[0]: r[1] for r in rows}
    assert all(text[i] == t for i, t in zip(got.doc_id, got.text, strict=True)) and (got.n_chars == 1).all()
    assert got.groupby("doc_id").size().max() <= 3
    sizes = {r[0]: len(_words(r[1])) for r in rows}
    plan = corpus_pipeline.mixing.mix(spark.createDataFrame([(r[0], r[3], sizes[r[0]]) for r in rows], "doc_id long, source string, size long")).select("row.*", "target", "whole", "part").toPandas()
    assert ((plan.part > 0) & (plan.part < plan["size"])).sum() > 2
    for source, p in plan.groupby("source"):
        edge = p[(p.part > 0) & (p.part < p["size"])]["size"].max()
        taken = sum(sizes[i] for i in got.doc_id[got.source == source])
        assert abs(taken - round(p.target.iloc[0])) <= (0 if edge != edge else edge / 2)


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).count() > 50
