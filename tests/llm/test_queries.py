"""Queries of operators 4, 9 and 10 as they are registered, against brute force."""

import hashlib

import numpy as np

from gridwright.llm import mixing, sharding, warc

from .test_operators import DOCS, _words, frame, odd_documents, water_fill


def test_mixing_query(spark, tmp_path):
    rows = odd_documents()
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = frame(mixing.query(spark, str(tmp_path)))
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(_words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s))
    want = dict(zip(order, water_fill([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    assert sorted(zip(out.doc_id.fillna(-1), out["size"])) == sorted((-1 if r[0] is None else r[0], len(_words(r[1]))) for r in rows)
    assert (out.taken >= 0).all() and (out.taken <= 3 * out["size"]).all()
    # a source shows by its size and target; sources that share both share the sum
    for (total, target), mine in out.groupby(["source_size", "target"]):
        same = [s for s in order if size[s] == total and np.isclose(want[s], target)]
        assert same and abs(mine.taken.sum() - len(same) * target) <= len(same)
    again = frame(mixing.query(spark, str(tmp_path)))
    assert again.fillna(-1).sort_values(list(again.columns)).values.tolist() == out.fillna(-1).sort_values(list(out.columns)).values.tolist()


def differenced(sizes, k):
    """Loads after differencing by its definition: the two partial partitions of largest spread, oppositely ordered, until one is left."""
    parts = [sorted([0] * (k - 1) + [s]) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b, parts = parts[0], parts[1], parts[2:]
        both = sorted(x + y for x, y in zip(a, reversed(b), strict=True))
        parts.append(both)
    return parts[0] if parts else [0] * k


def test_differencing_against_its_definition():
    rng = np.random.default_rng(6)
    for k in (2, 3, 7):
        for n in (1, 2, 9, 60):
            sizes = [int(2**30 * x) for x in rng.random(n)]  # hardly any ties, which would leave a choice
            part = sharding.differencing(sizes, k)
            loads = sorted(sum(s for s, p in zip(sizes, part, strict=True) if p == i) for i in range(k))
            want = differenced(sizes, k)
            assert loads == want


def test_sharding_query_places_groups_by_differencing(spark, tmp_path):
    rows = odd_documents()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = frame(sharding.query(spark, str(tmp_path)))
    groups = {}
    for r in rows:
        groups[r[1]] = groups.get(r[1], 0) + len((r[1] or "").encode()) + 8
    total = sum(groups.values())
    heavy = [v for v in groups.values() if v > total / (sharding.HEAVY_PER_SHARD * sharding.SHARDS)]
    loads = out.groupby("shard")["size"].sum().reindex(range(sharding.SHARDS), fill_value=0)
    # light groups make bundles by hash, so only what differencing does with the heavy ones is fixed: the light ones fill up
    spare = total - sum(heavy)
    assert loads.sum() == total and loads.max() <= max(differenced(heavy, sharding.SHARDS)) + spare


def test_warc_query(spark, tmp_path):
    big, other = "<p>" + "ab é " * 400, "<p>" + "cd " * 500
    rows = [(1, "u", big), (2, "u", big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (9, "u", other), (7, None, other), (8, "u", other), (10, "u", other[:-1])]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    body = {i: (h or "").encode() for i, _, h in rows}
    last = {b: max(i for i, x in body.items() if x == b) for b in body.values() if len(b) >= 1000}
    want = [(i, len(b), hashlib.sha1(b).hexdigest(), *(("revisit", last[b]) if last.get(b, i) != i else ("response", None))) for i, b in body.items()]
    got = warc.query(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(want)
