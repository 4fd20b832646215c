"""Batches and broadcasts stay small, whatever the input."""

import numpy as np
import pyarrow as pa
import pyarrow.compute

from gridwright.llm import _common, ngram_join, quality, suffix_dedup


class _Mapped:
    """Keeps the function that a query gives to ``mapInArrow``."""

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        return f


def test_signatures_leave_a_task_in_bounded_batches(monkeypatch):
    """A batch of texts can have many times as many signatures as fit one batch."""
    monkeypatch.setattr(ngram_join, "_CHUNK", 1000)
    texts = [" ".join(f"{i}x{j}" for j in range(60)) for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts)], names=["id", "text"])
    sizes = [b.num_rows for b in ngram_join._signature_rows(_Mapped(), 5, 80)(iter([batch]))]
    assert len(sizes) > 2 and max(sizes) < 3000


def test_large_tables_of_ids_are_not_broadcast(spark):
    ids = _common.materialize(spark.range(250_000), "many-ids")
    plan = spark.range(10).join(_common.checked(ids), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan


def test_signatures_cross_the_shuffle_once():
    """A row that only names its signature has it as the key, and no second time."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([" ".join(f"{i}x{j}" for j in range(60)) for i in range(2)])], names=["id", "text"])
    for out in ngram_join._signature_rows(_Mapped(), 5, 80)(iter([batch])):
        one = out.column("b").is_null()
        assert out.num_columns == 4 and one.to_pylist() == out.column("sig").is_null().to_pylist() and any(one.to_pylist())


def test_repeats_inside_a_task_cross_the_shuffle_as_stretches():
    """A copy of a text of many anchors is one row, not one for each anchor."""
    text = "".join(f"word{i * i} " for i in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([0, 0], pa.int64()), pa.array([text, text + "end"])], names=["d", "e", "text"])
    out = pa.Table.from_batches(list(suffix_dedup._anchor_rows(_Mapped())(iter([batch])))).filter(pa.compute.field("settled")).to_pylist()
    assert len(out) == 1 and out[0]["d"] == 2 and out[0]["pos"] == 0 and len(text) - 250 < out[0]["reach"] <= len(text) - 100


def test_whole_rows_are_not_copied_to_weigh_them(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} " * 5, i % 2 == 0) for i in range(40)], "doc_id long, text string, target boolean")
    model = quality.fit(docs.select("doc_id", "text"), docs.select("doc_id", "target"))
    seen = []
    monkeypatch.setattr(quality, "materialize", lambda df, name: seen.append(df.columns) or _common.materialize(df, name))
    assert quality.resample(docs, model).columns[0] == "row" and seen == [["log_weight", "noise"]]


def test_only_hot_keys_are_repeated(spark, monkeypatch):
    monkeypatch.setattr(_common, "BROADCAST_IDS", 0)
    monkeypatch.setattr(_common, "KEY_ROWS", 10)
    written = []
    materialize = _common.materialize
    monkeypatch.setattr(_common, "materialize", lambda df, name: written.append(materialize(df, name)) or written[-1])
    big = spark.createDataFrame([(1, i) for i in range(35)] + [(i, i) for i in range(2, 20)], "k long, x long")
    small = spark.createDataFrame([(i, 10 * i) for i in range(10)], "k long, y long")
    want = {(k, x): 10 * k if k < 10 else None for k, x in big.collect()}
    assert {(r.k, r.x): r.y for r in _common.salted(big, small, "k", "left").collect()} == want
    assert _common.salted(big, small, "k").count() == 43 and _common.salted(big, small, "k", "left_semi").count() == 43
    assert [tuple(r) for r in written[0].collect()] == [(1, 4)]


def test_texts_of_pairs_that_cannot_link_are_not_shuffled(spark):
    """Sketches have at most two bits per element; they drop unrelated pairs and no pair that links."""
    rng = np.random.default_rng(7)
    found = []
    for n in (1, 9, 60, 130, 700):
        s = rng.integers(1, 1 << 62, 2 * n + n // 2, dtype=np.uint64)
        found += [s[:n], s[n // 12 : n + n // 12], s[n // 2 : n + n // 2], s[n : n + n + n // 4]]
    rows = [(i, bytearray(ngram_join.sketch(s).tobytes())) for i, s in enumerate(found)]
    assert all(8 * len(v) <= 64 + max(64, 2 * len(s)) for (_, v), s in zip(rows, found, strict=True))
    pairs = [(i, j) for i in range(len(found)) for j in range(i + 1, len(found))]
    kept = ngram_join._possible(spark.createDataFrame(rows, "id long, v binary"), spark.createDataFrame(pairs, "a long, b long"), 80, "possible")
    kept = {(r.a, r.b) for r in kept.collect()}
    alike = {(a, b): len(np.intersect1d(found[a], found[b])) / len(np.union1d(found[a], found[b])) for a, b in pairs}
    assert {p for p, x in alike.items() if x >= 0.8} <= kept and not {p for p, x in alike.items() if x < 0.4 and len(found[p[0]]) > 50} & kept
