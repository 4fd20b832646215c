"""Mixtures, smoothing, streaming and file scans against small brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.jobs import synthetic
from gridwright.operators import metrics, mixture, pairs, quantiles, scaling, selection, spatial
from gridwright.sources import roi
from gridwright.streaming import score


@pytest.fixture(scope="module")
def grown(spark):
    a = synthetic.Habitat(-0.4, 0.0, 0.3, 1.0, {"T2": 80.0, "DTI-MD": 1.5}, {"T2": 4.0, "DTI-MD": 0.05})
    b = synthetic.Habitat(0.4, 0.0, 0.3, 1.0, {"T2": 40.0, "DTI-MD": 0.6}, {"T2": 4.0, "DTI-MD": 0.05})
    return synthetic.cohort(spark, {"m1": ([a, b], 14, 2), "m2": ([a, b], 18, 3)}).persist()


def test_generator_repeats(spark, grown):
    assert grown.agg(F.bit_xor(F.xxhash64(*grown.columns))).first() == grown.repartition(7).agg(F.bit_xor(F.xxhash64(*grown.columns))).first()
    assert grown.select("truth").distinct().count() == 2


def test_presets_plant_their_habitats(spark):
    from gridwright.jobs import presets

    who = presets.placed(spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(presets.PRESETS)], "subject string, preset string"))
    cells = presets.long_cells(who).persist()
    assert cells.agg(F.bit_xor(F.xxhash64(*cells.columns))).first() == presets.long_cells(who.repartition(3)).agg(F.bit_xor(F.xxhash64(*cells.columns))).first()
    one = cells.where("param = 'T2' and roi = 'ALL'").groupBy("preset", "truth").count().collect()
    share = {(r.preset, r.truth): r["count"] / sum(q["count"] for q in one if q.preset == r.preset) for r in one}
    assert {p: {t for q, t in share if q == p} for p in presets.PRESETS} == {p: {s[0] for s in seeds} for p, (_, _, _, seeds) in presets.PRESETS.items()}
    assert share["uniform", "proliferative"] == 1 and abs(share["two_habitats", "necrotic"] - 0.5) < 0.03 and share["necrotic_dominant", "necrotic"] > 0.5 and share["three_habitats", "necrotic"] < share["three_habitats", "hypoxic"]
    assert cells.where("value < 0 or (param = 'DTI-FA' and value > 1) or confidence > 1 + 1e-9").isEmpty() and set(presets.PARAMETERS) == {r.param for r in cells.select("param").distinct().collect()}
    means = {r.truth: r.m for r in cells.where("preset = 'two_habitats' and param = 'T2'").groupBy("truth").agg(F.avg("value").alias("m")).collect()}
    assert all(abs(means[t] - presets.BIOLOGY[t][-1][0]) < 2 for t in ("necrotic", "proliferative", "contralateral"))


def test_mixture_finds_the_habitats(spark, grown):
    scaled = scaling.robust(grown).drop("value").withColumnRenamed("scaled", "value")
    points = pairs.vectors(scaled, ["subject", "slice", "x", "y", "truth"], ["T2", "DTI-MD"], "value").withColumn("g", F.col("subject")).persist()
    models = mixture.fit(points, 2)
    out = mixture.predict(points, models)
    ari = metrics.agreement(metrics.counts(out, "truth", "label", ["subject"]), ["subject"]).collect()
    assert len(ari) == 2 and all(r.ari > 0.5 for r in ari)
    assert all(np.isclose(sum(r.proba), 1) for r in out.select("proba").limit(50).collect())
    few, many = mixture.fit(points, 2, steps=3), mixture.fit(points, 2, steps=10)
    assert all(many[g].log_likelihood >= few[g].log_likelihood - 1e-6 for g in few)
    chosen = selection.best_k(mixture.choose_k(points, [1, 2, 3]), ["g"], "bic").collect()
    assert all(r.k >= 2 for r in chosen)
    km = mixture.kmeans(points, 2)
    assert all(len(c) == 2 and cost > 0 for c, cost in km.values())


def test_quantiles_of_large_and_small_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    values = {0: rng.normal(size=5000), 1: np.repeat([1.0, 2.0], [4000, 1000]), 2: np.array([3.0]), 3: np.array([2.0, 5.0])}
    df = spark.createDataFrame([(g, float(x)) for g, v in values.items() for x in v] + [(0, None), (0, float("nan")), (4, None)], "g int, v double")
    for small in (20_000, 0):
        monkeypatch.setattr(quantiles, "SMALL", small)
        got = {r.g: r for r in quantiles.quantiles(df.where("g < 2 or 1 = 1" if small else "g < 2"), ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.75, "d": 0.0, "e": 1.0}).collect()}
        for g, v in values.items():
            if g in got:
                assert np.allclose([got[g][c] for c in "abcde"], np.quantile(v, [0.1, 0.5, 0.75, 0, 1])) and got[g].n == len(v)
        assert 0 in got and 1 in got and 4 not in got


@pytest.mark.parametrize("broadcast", [True, False])
def test_one_large_group_is_never_shuffled_by_its_key(spark, monkeypatch, broadcast):
    """A million values of one group, brackets narrowed several times; with automatic broadcast off."""
    monkeypatch.setattr(quantiles, "INSIDE", 1500)
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", 100 if broadcast else 0)
    monkeypatch.setattr(scaling, "BROADCAST_ROWS", 100 if broadcast else 0)
    n = 1_000_000 if broadcast else 60_000
    df = spark.range(n).select(F.when(F.col("id") >= 0, "s").alias("subject"), F.when(F.col("id") >= 0, "p").alias("param"), F.lit("ALL").alias("roi"), (F.xxhash64("id") % 1_000_003 / 7).alias("value"))
    want = np.array([r[0] for r in df.select("value").collect()])
    got = quantiles.quantiles(df, ["subject", "param"], "value", {"a": 0.25, "b": 0.5, "c": 0.999}).first()
    assert np.allclose([got.a, got.b, got.c], np.quantile(want, [0.25, 0.5, 0.999])) and got.n == n
    scaled = scaling.robust(df)
    assert scaled.count() == n
    if broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = scaling.robust(df)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_smoothing_moves_a_lone_unsure_cell(spark):
    rows = [("s", 1, x, y, 1 if (x, y) == (2, 2) else 0, [0.45, 0.55] if (x, y) == (2, 2) else [0.9, 0.1]) for x in range(5) for y in range(5)]
    df = spark.createDataFrame(rows, "subject string, slice int, x int, y int, habitat int, proba array<double>")
    out = spatial.smooth(df, {(1, 0): 1.0, (0, 1): 1.0}).collect()
    assert {r.smoothed for r in out} == {0} and len(out) == 25


def test_smoothing_by_diagonals_equals_cell_after_cell():
    rng = np.random.default_rng(11)
    for case in range(12):
        k, there = 4, rng.random((9, 8)) < (0.8 if case % 2 else 1.0)
        y, x = (a.astype(np.int64) for a in np.nonzero(there))
        proba, lab = rng.dirichlet(np.ones(k), len(x)), rng.integers(0, k, len(x))
        penalty = {(i, j): float(rng.integers(0, 8)) for i in range(k) for j in range(k)}
        at, want = {(a, b): i for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))}, lab.tolist()
        for _ in range(5):
            before = list(want)
            for (a, b), i in at.items():
                near = [want[j] for j in (at.get((a + 1, b)), at.get((a - 1, b)), at.get((a, b + 1)), at.get((a, b - 1))) if j is not None]
                if near and (proba[i, want[i]] < 0.65 or any(z != want[i] for z in near)):
                    want[i] = int(np.argmin([-np.log(proba[i, c]) + 0.3 * sum(penalty[c, z] for z in near) for c in range(k)]))
            if before == want:
                break
        assert spatial.settled(x, y, lab, proba, penalty, 0.3, 0.65, 5).tolist() == want


def test_components_equal_flood_fill():
    rng = np.random.default_rng(12)
    for size in (1, 5, 30):
        there = rng.random((size, size + 2)) < 0.9
        there[0, 0] = True
        y, x = (a.astype(np.int64) for a in np.nonzero(there))
        value = rng.integers(0, 2, len(x))
        at, want = {(a, b): i for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))}, [-1] * len(x)
        for start in range(len(x)):
            todo = [start] if want[start] < 0 else []
            while todo:
                i = todo.pop()
                want[i] = start
                todo += [j for d, e in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (j := at.get((x[i] + d, y[i] + e))) is not None and want[j] < 0 and value[j] == value[i]]
        assert spatial.connected(spatial.neighbours(x, y), value).tolist() == want


def test_roi_files(spark, tmp_path):
    for subject, param, shift in (("m1", "T2", 0), ("m1", "T2star", 1), ("m2", "T2", 2)):
        d = tmp_path / subject
        d.mkdir(exist_ok=True)
        lines = ["Roi_ID,Roi_Name,Slice,X,Y,Value"] + [f"4,ALL,1,{x},1,{x + shift}" for x in range(3 - shift)] + ["3,CL,1,9,9,NaN"]
        (d / f"sub-{subject}_{param}_roi_data.csv").write_text("\n".join(lines))
    long = roi.read_roi_csv(spark, f"{tmp_path}/*/*.csv")
    assert {(r.subject, r.param) for r in long.select("subject", "param").distinct().collect()} == {("m1", "T2"), ("m1", "T2star"), ("m2", "T2")}
    wide = {(r.subject, r.x): (r.T2, r.T2star) for r in roi.pivot_cells(long, ["T2", "T2star"], "T2").collect()}
    assert wide == {("m1", 0): (0.0, 1.0), ("m1", 1): (1.0, 2.0), ("m1", 2): (2.0, None), ("m2", 0): (2.0, None)}
    assert long.where("roi = 'CL' and value is not null").count() == 0


def test_stream_equals_batch(spark, grown, tmp_path):
    cells = roi.pivot_cells(grown, ["T2", "DTI-MD"], "T2").withColumn("at", F.timestamp_seconds(F.col("x") * 60))
    cells.repartition(3).write.parquet(str(tmp_path / "in"))
    stats, model = {"T2": (60.0, 20.0), "DTI-MD": (1.0, 0.5)}, [[1.0, 1.0], [-1.0, -1.0]]
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = score.score(stream, ["T2", "DTI-MD"], stats, model).select("subject", "slice", "x", "y", "label").writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    batch = score.score(cells, ["T2", "DTI-MD"], stats, model).select("subject", "slice", "x", "y", "label")
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, batch.collect()))
    windows = score.shares_by_window(score.score(cells, ["T2", "DTI-MD"], stats, model), "at")
    assert windows.agg(F.sum("n")).first()[0] == cells.count()


def test_permutations_are_bijections_and_uniform():
    from gridwright.operators import permutations

    for n in (2, 7, 33, 1000):
        p = permutations.permuted(np.arange(n), n, 50, 3)
        assert (p[:, 0] == np.arange(n)).all() and all(len(set(p[:, t])) == n for t in range(51))
        assert (p == np.vstack([permutations.permuted(np.array([i]), n, 50, 3) for i in range(n)])).all()
    first = permutations.permuted(np.arange(4), 4, 4000, 1)[0, 1:]
    assert np.abs(np.bincount(first) / 4000 - 0.25).max() < 0.04


def numpy_statistics(v, grp):
    """(location F, squared mean discrepancy at bandwidth 1) by plain loops over groups."""
    sq = ((v[:, None] - v[None]) ** 2).sum(2)
    n, kinds = len(v), np.unique(grp)
    within = sum(sq[np.ix_(grp == g, grp == g)].sum() / (2 * (grp == g).sum()) for g in kinds)
    total = sq.sum() / (2 * n)
    k = np.exp(-sq / 2)
    np.fill_diagonal(k, 0)
    a, b = grp == kinds[0], grp == kinds[-1]
    return ((total - within) / (len(kinds) - 1)) / (within / (n - len(kinds))), k[np.ix_(a, a)].sum() / (a.sum() * (a.sum() - 1)) + k[np.ix_(b, b)].sum() / (b.sum() * (b.sum() - 1)) - 2 * k[np.ix_(a, b)].mean()


@pytest.mark.parametrize("block,gap", [(512, 0.0), (16, 0.6)])
def test_permutation_tests_equal_numpy(spark, monkeypatch, block, gap):
    from gridwright.operators import permutations

    monkeypatch.setattr(permutations, "BLOCK", block)
    rng = np.random.default_rng(4)
    grp = np.array([0] * 17 + [1] * 24)
    v = rng.normal(size=(41, 3)) + gap * grp[:, None]
    points = spark.createDataFrame([(i, int(g), x.tolist()) for i, (g, x) in enumerate(zip(grp, v))], "subject int, grp int, v array<double>")
    null = np.array([numpy_statistics(v, rng.permutation(grp)) for _ in range(2000)])
    for found, i in ((permutations.permanova_test(points, 400).first(), 0), (permutations.kernel_test(points, 1.0, 400).first(), 1)):
        want = numpy_statistics(v, grp)[i]
        assert np.isclose(found.f, want)
        p = (null[:, i] >= want).mean()
        assert abs(found.p - p) <= 4 * np.sqrt(max(p * (1 - p), 0.002) / 400) + 1e-9


def test_dispersions_and_the_stress_that_never_rises(spark, monkeypatch):
    from gridwright.operators import permutations

    rng = np.random.default_rng(5)
    grp = np.array([0] * 20 + [1] * 20)
    v = rng.normal(size=(40, 2)) * np.where(grp == 0, 0.2, 2.0)[:, None]
    points = spark.createDataFrame([(i, int(g), x.tolist()) for i, (g, x) in enumerate(zip(grp, v))], "subject int, grp int, v array<double>")
    rows, sizes = permutations.numbered(points)
    assert sizes == [20, 20] and sorted(r.row for r in rows.collect()) == list(range(40))
    monkeypatch.setattr(permutations, "BLOCK", 16)
    at, stress = permutations.scaled_coordinates(rows, 40, 2, steps=25, tol=0.0)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(stress, stress[1:])) and stress[-1] < 0.2 * stress[0]
    x = np.array([r.x for r in at.orderBy("row").collect()])
    want = np.array([r.v for r in at.orderBy("row").collect()])
    far = lambda z: np.linalg.norm(z[:, None] - z[None], axis=2)
    assert np.isclose(((far(x) - far(want)) ** 2).sum() / 2, stress[-1])
    found = permutations.dispersion_test(points, 99, dims=2, steps=25).first()
    d = np.concatenate([np.linalg.norm(x[grp == g] - x[grp == g].mean(0), axis=1) for g in (0, 1)])
    m = np.array([d[:20].mean(), d[20:].mean()])
    assert found.p <= 0.02 and found.f > 10 and (20 * (m - d.mean()) ** 2).sum() > 0


def test_the_steps_of_one_tile_take_one_job(spark, monkeypatch):
    """Up to BLOCK rows all steps are made where the only tile is; the coordinates are those of many tiles."""
    from gridwright.operators import permutations

    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(20, 3)))], "row long, v array<double>")
    wrote, write = [], permutations.written
    monkeypatch.setattr(permutations, "written", lambda df, name: wrote.append(name) or write(df, name))
    at, stress = permutations.scaled_coordinates(rows, 20, 2, steps=4, tol=0.0)
    assert len(wrote) == 2
    monkeypatch.setattr(permutations, "BLOCK", 8)
    tiled, slow = permutations.scaled_coordinates(rows, 20, 2, steps=4, tol=0.0)
    same = lambda t: [r.x for r in t.orderBy("row").collect()]
    assert len(stress) == 5 and np.allclose(stress, slow) and np.allclose(same(at), same(tiled))


def test_permutation_tests_of_many_subjects(spark):
    """More rows than any matrix of pairs in the driver could hold comfortably; the location test takes 45 million pairs in tiles."""
    from gridwright.operators import permutations

    many = spark.range(9_500).select(F.col("id").alias("subject"), (F.col("id") % 2).alias("grp"), F.array((F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).cast("double"), (F.col("id") % 2 * 0.05).cast("double")).alias("v"))
    found = permutations.permanova_test(many, 19).first()
    assert found.p == 0.0 and found.f > 10


def test_mutual_information_equals_brute_force(spark):
    from math import comb, log

    from gridwright.operators import metrics

    rng = np.random.default_rng(7)
    rows = [(s, int(t), int(t) if rng.random() < 0.6 else int(rng.integers(4))) for s in (0, 1) for t in rng.integers(3, size=60 + 25 * s)] + [(2, 1, 1), (2, 1, 1), (3, 0, 0), (3, 1, 0)]
    df = spark.createDataFrame(rows, "s int, t int, p int")

    def brute(pairs_):
        n, ts, ps = len(pairs_), [t for t, _ in pairs_], [p for _, p in pairs_]
        count = lambda xs: {x: xs.count(x) for x in set(xs)}
        ct, cp, cb = count(ts), count(ps), count(pairs_)
        mi = sum(c / n * log(c * n / (ct[t] * cp[p])) for (t, p), c in cb.items())
        h = lambda c: -sum(x / n * log(x / n) for x in c.values())
        emi = sum(x / n * log(n * x / (a * b)) * comb(a, x) * comb(n - a, b - x) / comb(n, b) for a in ct.values() for b in cp.values() for x in range(max(1, a + b - n), min(a, b) + 1))
        room = (h(ct) + h(cp)) / 2 - emi
        return mi, emi, 1.0 if len(ct) == len(cp) == 1 or abs(room) < 1e-15 else (mi - emi) / room

    got = {r.s: r for r in metrics.mutual_information(metrics.counts(df, "t", "p", ["s"]), ["s"]).collect()}
    for s in (0, 1, 2, 3):
        assert np.allclose([got[s].mi, got[s].emi, got[s].ami], brute([(t, p) for x, t, p in rows if x == s]), atol=1e-9)
    whole = metrics.evaluation(df, "t", "p").first()
    assert np.isclose(whole.ami, brute([(t, p) for _, t, p in rows])[2]) and whole.n == len(rows)
    large = spark.createDataFrame([(0, 0, 400_000_000), (0, 1, 100_000_000), (1, 0, 100_000_000), (1, 1, 400_000_000)], "t int, p int, n long")
    r = metrics.mutual_information(large).first()
    assert np.isclose(r.emi, 1 / (2 * 1e9), rtol=1e-3) and 0.27 < r.ami < 0.29


def test_uncertain_rows_are_left_out(spark):
    from gridwright.operators import metrics

    df = spark.createDataFrame([(0, 0, 0.9), (1, 1, 0.8), (0, 1, 0.1), (1, 1, None)], "t int, p int, c double")
    assert metrics.evaluation(df, "t", "p", confidence="c", least=0.5).first().accuracy == 1.0
    best = metrics.best_per_metric(spark.createDataFrame([("a", 0.5, 0.2), ("b", 0.5, 0.3)], "name string, ari double, ami double"), "name", ["ari", "ami"])
    assert {(r.metric, r.best, r.n_ties) for r in best.collect()} == {("ari", "a", 2), ("ami", "b", 1)}


def test_bootstrap_and_gap(spark):
    from gridwright.operators import inference

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.1, (150, 2)), rng.normal(3, 0.1, (150, 2))])
    points = spark.createDataFrame([("a", i, r.tolist()) for i, r in enumerate(x)], "g string, i int, v array<double>").persist()
    found = inference.bootstrap_means(points, ["i"], 100).collect()
    assert sorted(map(tuple, found)) == close_to(sorted(map(tuple, inference.bootstrap_means(points.repartition(5), ["i"], 100).collect())))
    for r in found:
        assert r.lo < r.mean < r.hi and np.isclose(r["mean"], x[:, r.i].mean()) and r.hi - r.lo < 1
    gap = inference.gap_statistic(points, [1, 2, 3], refs=2)
    assert selection.gap_rule(gap, ["g"]).first().k == 2


def close_to(rows):
    return [tuple(pytest.approx(x) if isinstance(x, float) else x for x in r) for r in rows]


@pytest.mark.parametrize("sizes,want", [
    ({3: [(90, "Bulk tumor"), (6, "Necrosis"), (4, "Cellular/proliferative")]}, 2), ({3: [(90, "Bulk tumor"), (6, "Cellular/proliferative"), (4, "Necrosis")]}, 3),
    ({3: [(60, "Bulk tumor"), (25, "Necrosis"), (15, "Cellular/proliferative")]}, 3), ({3: [(90, "Bulk tumor"), (6, "Hypoxic/vascular"), (4, "Cellular/proliferative")]}, 2),
])
def test_size_guard_spares_protected_labels(spark, sizes, want):
    from gridwright.operators import passes

    rows = [("s", 3, k, i, n, label) for k, all_ in (sizes | {2: [(96, "Bulk tumor"), (4, "Cellular/proliferative")]}).items() for i, (n, label) in enumerate(all_)]
    df = spark.createDataFrame(rows, "subject string, start int, k int, cluster int, n long, label string")
    assert passes.size_guarded(df, ["subject"], "start").first().k == want


def test_greedy_match_takes_the_best_free_one(spark):
    from gridwright.operators import comparison

    rng = np.random.default_rng(3)
    rows = [(g, a, b, float(np.round(rng.random(), 6))) for g in range(40) for a in range(5) for b in range(4)]
    want = []
    for g in range(40):
        free = set(range(4))
        for a in range(5):
            best = max(((s, -b) for h, x, b, s in rows if h == g and x == a and b in free and s > 0.65), default=None)
            if best:
                want.append((g, a, -best[1], best[0]))
                free.remove(-best[1])
    got = comparison.greedy_match(spark.createDataFrame(rows, "g int, a int, b int, s double"), ["g"], "a", "b", "s")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_distance_transform_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(20):
        seeds = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < 0.15
        if seeds.any():
            at = np.argwhere(seeds)
            want = [[((at - (i, j)) ** 2).sum(1).min() for j in range(seeds.shape[1])] for i in range(seeds.shape[0])]
            assert (spatial.squared_distances(seeds) == np.array(want)).all()


def test_broken_meta_gives_no_rows(spark, tmp_path):
    from gridwright.sources import results

    (tmp_path / "a.json").write_text('{"subject": 1, "scaling_info": {"T2": {"median": 1.0, "iqr": 2.0}}}\n{"subject": 2, "scaling')
    assert [(r.subject, r.param, r.median, r.ref_n) for r in results.read_meta(spark, str(tmp_path)).collect()] == [(1, "T2", 1.0, None)]


def test_modes_find_the_two_habitats(spark, grown):
    from gridwright.jobs import modes

    cfg = modes.Config(ks=(2, 3), restarts=1, steps=15)
    truth = grown.where("param = 'T2'").select("subject", "slice", "x", "y", "truth")
    for found in (modes.classic(grown, ["T2", "DTI-MD"], cfg), modes.joint(grown, ["T2", "DTI-MD"], cfg)):
        both = found.join(truth, ["subject", "slice", "x", "y"])
        assert both.count() == truth.count()
        hom = metrics.agreement(metrics.counts(both, "truth", "habitat", ["subject"]), ["subject"]).collect()
        assert all(r.homogeneity > 0.4 for r in hom)
    cells = modes.discovered_cells(grown, ["T2", "DTI-MD"], cfg)
    assert cells.count() == truth.count() and cells.select("subject").distinct().count() == 2
    assert all(0 < r.rate <= 1 for r in cells.select("rate").distinct().collect() if r.rate is not None)
    each = cells.groupBy("subject", "habitat").agg(F.count_distinct("meta").alias("k"), F.count("meta").alias("n"), F.count(F.lit(1)).alias("all")).collect()
    assert all(r.k <= 1 and r.n in (0, r["all"]) and (r["all"] < cfg.least_cells) == (r.n == 0) for r in each)


def planted(spark, necrotic=True):
    """Two subjects, two slices: a small core with high T2 and MD in the first slice, tissue of two kinds around it."""
    rng = np.random.default_rng(8)
    rows = []
    for s in ("a", "b"):
        for z in (1, 2):
            for x in range(14):
                for y in range(14):
                    core = z == 1 and (x - 7) ** 2 + (y - 7) ** 2 <= 9 and necrotic
                    t2, md = (30.0, 30.0) if core else (10.0, 10.0) if x < 7 else (8.0, 12.0)
                    for p, m in (("T2", t2), ("DTI-MD", md)):
                        rows.append((s, "ALL", z, x, y, p, float(m + rng.normal(0, 0.5))))
    return spark.createDataFrame(rows, "subject string, roi string, slice int, x int, y int, param string, value double")


def test_distances_of_a_first_clustering_feed_the_second(spark):
    from gridwright.jobs import modes

    params, cfg = ["T2", "DTI-MD"], modes.Config(ks=(2, 3), restarts=1, steps=15, per_subject=200)
    found = modes.joint(planted(spark), params, cfg).toPandas()
    assert len(found) == 2 * 2 * 196 and (found.v.map(len) == 3).all() and found.included.all()
    core = found[(found.slice == 1) & ((found.x - 7) ** 2 + (found.y - 7) ** 2 <= 9)]
    seed = core.habitat_1.mode()[0]
    assert (core.habitat_1 == seed).all() and found.d_scaled.where(found.slice == 2, 0).abs().max() == 0  # no seed there
    for _, one in found.groupby("subject"):  # the column against a plain distance to the first pass's habitat
        here = one[one.slice == 1]
        seeds = here[here.habitat_1 == seed][["x", "y"]].to_numpy()
        d = np.sqrt(((here[["x", "y"]].to_numpy()[:, None] - seeds[None]) ** 2).sum(2)).min(1)
        d = d / d.max()
        iqr = np.quantile(d, 0.75) - np.quantile(d, 0.25)
        assert np.allclose(here.d_scaled, (d - np.median(d)) / max(iqr, 1e-8)) and np.allclose(here.v.map(lambda v: v[2]), 0.3 * here.d_scaled)
    plain = modes.joint(planted(spark, necrotic=False), params, modes.Config(ks=(2,), restarts=1, steps=15, per_subject=200)).toPandas()
    assert not plain.included.any() and plain.d_scaled.isna().all() and (plain.habitat == plain.habitat_1).all()


def test_prepared_features_have_the_distance_where_necrosis_is_clear(spark):
    from gridwright.jobs import modes

    params, cfg = ["T2", "DTI-MD"], modes.Config(ks=(2, 3), restarts=1, steps=15)
    rows = planted(spark).where("subject = 'a'").unionByName(planted(spark, necrotic=False).where("subject = 'b'"))
    p = modes.prepared(modes.scaled_points(rows, params), params, cfg).toPandas()
    a, b = p[p.subject == "a"], p[p.subject == "b"]
    assert a.necrotic.all() and (a.v.map(len) == 3).all()
    filled = a[a.slice == 2]
    assert filled.d.isna().all() and np.allclose(filled.v.map(lambda v: v[2]), a.d.mean()) and np.allclose(a[a.slice == 1].v.map(lambda v: v[2]), a[a.slice == 1].d)
    assert not b.necrotic.any() and (b.v.map(len) == 2).all() and b.d.notna().any()  # a proxy keeps the distances


def test_small_clusters_stay_only_if_their_label_protects_them(spark):
    from gridwright.jobs import modes
    from gridwright.operators.mixture import Mixture

    rows = [("n", [3.0, 3.0])] * 3 + [("n", [0.0, 0.0])] * 97 + [("c", [-3.0, -3.0])] * 3 + [("c", [0.0, 0.0])] * 97
    points = spark.createDataFrame(rows, "g string, v array<double>")
    one = lambda m: Mixture(np.full(len(m), 1 / len(m)), np.array(m, float), np.stack([np.eye(2) * 0.1] * len(m)))
    models = {("n", 2): one([[0, 0], [1, 1]]), ("n", 3): one([[0, 0], [3, 3], [9, 9]]), ("c", 2): one([[0, 0], [1, 1]]), ("c", 3): one([[0, 0], [-3, -3], [9, 9]])}
    labels = {(r.g, r.k, r.cluster): (r.n, r.label) for r in modes.solutions(points, models, ["T2", "DTI-MD"]).collect()}
    assert labels["n", 3, 1] == (3, "Necrosis") and labels["c", 3, 1][0] == 3 and labels["c", 3, 1][1] != "Necrosis"
    best = {"n": 3, "c": 3}
    assert modes.size_guarded_k(points, models, best, ["T2", "DTI-MD"], 0.05, protect=True) == {"n": 3, "c": 2}
    assert modes.size_guarded_k(points, models, best, ["T2", "DTI-MD"], 0.05, protect=False) == {"n": 2, "c": 2}


def test_principal_axes_equal_numpy(spark):
    from gridwright.operators import projection

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 5
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>")
    found = projection.axes(df, 3)
    value, vector = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(found.variances, value[::-1][:3]) and np.isclose(found.total, value.sum())
    assert np.allclose(np.abs(found.vectors), np.abs(vector[:, ::-1].T[:3])) and all(v[np.abs(v).argmax()] > 0 for v in found.vectors)
    pc = np.array([r.pc for r in projection.project(df, found).orderBy("i").collect()])
    assert np.allclose(pc, (x - x.mean(0)) @ found.vectors.T) and np.isclose(sum(r.share for r in projection.explained(found).collect()), value[1:].sum() / value.sum())
    assert projection.axes(df.limit(0), 2).total == 0.0


def dense_labels(v, x, y, k, sf=None):
    """Labels from the whole affinity matrix of one subject."""
    from gridwright.operators import spectral

    d = ((v[:, None] - v[None]) ** 2).sum(2)
    c = np.column_stack([x, y]).astype(float)
    at = ((c[:, None] - c[None]) ** 2).sum(2)
    w = np.exp(-d / (2 * sf**2) - at / (2 * np.median(np.sqrt(at[at > 0])) ** 2))
    np.fill_diagonal(w, 0)
    deg = np.sqrt(w.sum(1))
    value, vector = np.linalg.eigh(w / deg[:, None] / deg[None])
    e = vector[:, ::-1][:, :k]
    return e / np.linalg.norm(e, axis=1, keepdims=True)


def rand_index(a, b):
    t = np.array([[((a == i) & (b == j)).sum() for j in np.unique(b)] for i in np.unique(a)], float)
    pairs = lambda n: (n * (n - 1) / 2).sum()
    both, rows, cols, n = pairs(t), pairs(t.sum(1)), pairs(t.sum(0)), pairs(np.array([t.sum()]))
    return (both - rows * cols / n) / ((rows + cols) / 2 - rows * cols / n)


def test_place_bandwidth_counts_all_pairs():
    from gridwright.operators import spectral

    rng = np.random.default_rng(3)
    for size in (2, 7, 60):
        x, y = rng.integers(5, 20, size), rng.integers(1, 12, size)
        n = rng.integers(1, 4, size)
        at, first = np.unique(np.column_stack([x, y]), axis=0, return_index=True)
        n = n[first]
        full = np.repeat(at, n, 0).astype(float)
        assert np.isclose(spectral.place_bandwidth(at[:, 0], at[:, 1], n), spectral.bandwidth(full))
    assert spectral.place_bandwidth(np.array([3]), np.array([4]), np.array([9])) == 1.0


def test_feature_bandwidth_counts_all_pairs(spark, monkeypatch):
    from gridwright.operators import spectral

    monkeypatch.setattr(spectral, "PAIR_BLOCK", 100)  # several blocks a subject
    rng = np.random.default_rng(4)
    wide = np.vstack([rng.normal(size=(701, 3)), 50 * rng.normal(size=(500, 3))])
    few = rng.integers(0, 4, (900, 3)) * 0.1
    x = {"wide": wide, "even": wide[300:900], "few": few, "two": wide[:2], "same": np.ones((600, 3)), "one": wide[:1], "far": np.array([[0.0] * 3, [1e-160] * 3, [1e150] * 3, [3.0] * 3])}
    rows = [(g, 1, i % 40, i // 40, v.tolist()) for g, vs in x.items() for i, v in enumerate(vs)]
    points = spark.createDataFrame(rows, "subject string, slice int, x int, y int, v array<double>").repartition(5)
    found = {r.subject: r.sf for r in spectral.feature_bandwidths(points).collect()}
    assert found == {g: pytest.approx(spectral.bandwidth(vs), rel=1e-15) for g, vs in x.items()}
    assert found["same"] == found["one"] == 1.0
    assert not spectral.pair_counts(np.empty((0, 4)), np.ones((2, 4)), {0}, 42)[0].size and not spectral.pair_counts(np.ones((2, 4)), np.empty((0, 4)), {0}, 42)[0].size


def test_prepared_features_are_scaled_by_all_pairs(spark):
    from gridwright.operators import spectral

    rng = np.random.default_rng(4)
    v = np.vstack([rng.normal(size=(701, 3)), 50 * rng.normal(size=(500, 3))])
    points = spark.createDataFrame([("a", 1, i % 40, i // 40, row.tolist()) for i, row in enumerate(v)], "subject string, slice int, x int, y int, v array<double>")
    u = spectral.prepared(points, 1.0, 35).orderBy("y", "x").limit(2).collect()
    assert np.isclose(np.linalg.norm(v[1] - v[0]) / np.linalg.norm(np.subtract(u[1].u, u[0].u)[:3]), spectral.bandwidth(v))


def test_spectral_clusters_equal_those_of_the_whole_matrix(spark, grown, monkeypatch):
    from gridwright.jobs import modes
    from gridwright.operators import spectral

    monkeypatch.setattr(spectral, "BLOCK", 700)  # several blocks a subject
    points = modes.scaled_points(grown, ["T2", "DTI-MD"])
    truth = grown.where("param = 'T2'").select("subject", "slice", "x", "y", "truth")
    out = spectral.spectral(points, 2).join(truth, ["subject", "slice", "x", "y"]).toPandas()
    assert len(out) == truth.count()
    blocks = spectral.prepared(points, 1.0, 35).toPandas()
    e = spectral.embedding(points, 2).toPandas()
    for name, mine in out.groupby("subject"):
        mine = mine.sort_values(["slice", "x", "y"])
        u = np.array(blocks[blocks.subject == name].sort_values(["slice", "x", "y"]).u.tolist())
        v = np.array(mine.v.tolist(), float)
        whole = dense_labels(v, mine.x.to_numpy(), mine.y.to_numpy(), 2, sf=np.linalg.norm(v[1] - v[0]) / np.linalg.norm((u[1] - u[0])[:-2]))
        near = np.array(e[e.subject == name].sort_values(["slice", "x", "y"]).e.tolist())
        inner = np.linalg.svd(np.linalg.qr(whole)[0].T @ np.linalg.qr(near)[0])[1]
        assert inner.min() > 0.99  # the same plane of eigenvectors
        cut = (whole - whole.mean(0)) @ np.linalg.svd(whole - whole.mean(0), full_matrices=False)[2][0] > 0
        assert rand_index(cut, mine.label.to_numpy()) > 0.9
        assert rand_index(mine.truth.to_numpy(), mine.label.to_numpy()) > 0.4


def test_spectral_k_from_one_embedding(spark, grown):
    from gridwright.jobs import modes
    from gridwright.operators import spectral

    points = modes.scaled_points(grown, ["T2", "DTI-MD"])
    scores, chosen = spectral.choose_k(points, [2, 3, 4], refs=2, tolerance=0.05)
    assert scores.count() == 6 and {r.k for r in chosen.collect()} <= {2, 3, 4}
    assert all(r.k == r.gap_k for r in chosen.collect())
    assert spectral.embedding(points.limit(0), 2).count() == 0


def test_silhouettes_over_all_rows_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(m, 1, (30, 3)) for m in (0, 3, 6)])
    df = spark.createDataFrame([("a", row.tolist()) for row in x], "g string, v array<double>").repartition(5)
    centres = np.array([[0.0] * 3, [3.0] * 3, [6.0] * 3])
    near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = []
    for i in range(len(x)):
        own = d[i][(near == near[i]) & (np.arange(len(x)) != i)].mean()
        other = min(d[i][near == c].mean() for c in range(3) if c != near[i])
        want.append((other - own) / max(own, other))
    found = mixture.silhouettes(df, {("a", 3): centres, ("a", 1): centres[:1]})
    assert np.isclose(found["a", 3], np.mean(want)) and found["a", 1] == -1.0


def test_assignment_is_optimal():
    from itertools import permutations

    from gridwright.jobs import atlas

    rng = np.random.default_rng(2)
    for k in (1, 2, 4, 5):
        a, b = rng.normal(size=(k, 3)), rng.normal(size=(k, 3))
        least = min(sum(np.linalg.norm(a[i] - b[j]) for i, j in enumerate(p)) for p in permutations(range(k)))
        assert np.linalg.norm(a - atlas.aligned(a, b), axis=1).sum() == pytest.approx(least)
    assert atlas.aligned(np.zeros((3, 2)), np.ones((1, 2))).shape == (3, 2)


def test_balanced_sample_has_equally_many_cells(spark, grown):
    from gridwright.jobs import modes

    points = modes.scaled_points(grown, ["T2", "DTI-MD"])
    sizes = {r["subject"]: r["count"] for r in points.groupBy("subject").count().collect()}
    n = (min(sizes.values()) + max(sizes.values())) // 2  # one subject has fewer
    got = modes.balanced_sample(points, n, 1)
    assert got.columns == points.columns and {r["count"] for r in got.groupBy("subject").count().collect()} == {n}
    assert got.join(points, points.columns, "left_anti").count() == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, modes.balanced_sample(points.repartition(5), n, 1).collect()))


def test_atlas_of_two_habitats_is_stable(spark, grown):
    from gridwright.jobs import atlas, modes

    cfg = atlas.Config(ks=(2, 3, 4), restarts=1, steps=20, per_subject=200, resamples=3)
    model, scores, sample = atlas.fit(modes.scaled_points(grown, ["T2", "DTI-MD"]), cfg)
    assert {r.k for r in scores.collect()} == {2, 3, 4} and all(r.icl >= r.bic and -1 <= r.silhouette <= 1 for r in scores.collect())
    assert {r["count"] for r in sample.groupBy("subject").count().collect()} == {200}
    shifts = atlas.stability(sample, model, cfg).collect()
    assert [r.habitat for r in shifts] == list(range(len(model.means))) and all(0 <= r.mean_shift <= r.max_shift for r in shifts)
    drawn = atlas.resampled(sample, 5, 1).groupBy("g").count().collect()
    assert len(drawn) == 5 and {r["count"] for r in drawn} == {400}  # two subjects a resample


def test_stored_atlas_scores_batch_and_stream_alike(spark, grown, tmp_path):
    from gridwright.sources import results

    cells = roi.pivot_cells(grown, ["T2", "DTI-MD"], "T2").withColumn("g", F.lit("all"))
    stats = {"T2": (60.0, 20.0), "DTI-MD": (1.0, 0.5)}
    points = score.scaled(cells, ["T2", "DTI-MD"], stats).persist()
    model = mixture.fit(points, 2)["all"]
    path = str(tmp_path / "atlas")
    assert results.write_atlas(spark, model, ["T2", "DTI-MD"], path, stats) == 1
    other = mixture.Mixture(model.weights[::-1], model.means[::-1], model.covs[::-1])
    assert results.write_atlas(spark, other, ["T2", "DTI-MD"], path) == 2
    back, params, scale = results.read_atlas(spark, path, 1)
    assert np.array_equal(back.means, model.means) and np.array_equal(back.covs, model.covs) and params == ["T2", "DTI-MD"] and scale == stats
    assert np.array_equal(results.read_atlas(spark, path)[0].means, other.means) and results.read_atlas(spark, path)[2] is None
    with pytest.raises(ValueError):
        results.read_atlas(spark, path, 9)
    batch = score.score_by_atlas(cells, path, 1)
    rows = batch.select("v", "proba", "label", "confidence").collect()
    want, _ = model.posteriors(np.array([r.v for r in rows]))
    assert np.allclose([r.proba for r in rows], want) and [r.label for r in rows] == want.argmax(1).tolist()
    cells.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = score.score_by_atlas(stream, path, 1).select("subject", "slice", "x", "y", "label").writeStream.format("memory").queryName("by_atlas").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("by_atlas").collect())) == sorted(map(tuple, batch.select("subject", "slice", "x", "y", "label").collect()))


def test_mean_embeddings_approach_the_kernel_discrepancy(spark):
    from gridwright.operators import permutations

    rng = np.random.default_rng(2)
    x = {"a": rng.normal(0, 1, (60, 2)), "b": rng.normal(1, 1, (50, 2))}
    df = spark.createDataFrame([(g, v.tolist()) for g, rows in x.items() for v in rows], "subject string, v array<double>").repartition(5)
    e = {r.subject: np.array(r.v) for r in permutations.mean_embeddings(df, 1.3, 4096).collect()}
    k = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(2) / (2 * 1.3**2)).mean()
    assert abs(((e["a"] - e["b"]) ** 2).sum() - (k(x["a"], x["a"]) + k(x["b"], x["b"]) - 2 * k(x["a"], x["b"]))) < 0.03


def test_atlas_tells_planted_groups_apart(spark, tmp_path):
    from gridwright.jobs import atlas
    from gridwright.sources import results

    rng = np.random.default_rng(8)
    rows = []
    for s in range(12):  # even subjects hold mostly the first habitat, odd ones the second
        first = rng.random(150) < (0.75 if s % 2 == 0 else 0.25) + rng.uniform(-0.08, 0.08)
        v = np.where(first[:, None], rng.normal(-2, 0.5, (150, 2)), rng.normal(2, 0.5, (150, 2)))
        rows += [(s, 1, i % 15, i // 15, a.tolist()) for i, a in enumerate(v)]
    points = spark.createDataFrame(rows, "subject int, slice int, x int, y int, v array<double>")
    groups = spark.createDataFrame([(s, s % 2) for s in range(12)], "subject int, grp int")
    cfg = atlas.Config(ks=(2, 3), restarts=1, steps=15, per_subject=100, resamples=3)
    verdicts, found = atlas.run(points, groups, ["t2", "md"], str(tmp_path / "atlas"), cfg, n_perm=199)
    v = {(r.step, r.test, r.habitat): r for r in verdicts.collect()}
    for key in (("composition", "location", None), ("cells", "location", None), ("composition", "dirichlet", None)):
        assert v[key].verdict == "different" and v[key].p < 0.05
    assert v["composition", "spread", None].verdict == "no difference shown" and ("choice", "icl", None) in v
    k = len(results.read_atlas(spark, str(tmp_path / "atlas"))[0].means)
    assert sum(s == "habitats" for s, _, _ in v) == sum(s == "stability" for s, _, _ in v) == k and found.count() == 12 * k


def test_dirichlet_regression_finds_the_concentrations(spark):
    from gridwright.operators import composition

    rng = np.random.default_rng(0)
    alpha = np.array([[2.0, 3.0, 5.0], [6.0, 3.0, 1.0]])
    rows = [(g, [float(x) for x in v]) for g in (0, 1) for v in rng.dirichlet(alpha[g], 1500)]
    df = spark.createDataFrame([*rows, (None, [0.2, 0.3, 0.5]), (1, None)], "grp int, v array<double>")
    found = composition.dirichlet(df, 3)
    assert np.exp(np.array([[1, 1], [1, 0]]) @ found.coefficients) == pytest.approx(alpha, rel=0.12)
    assert found.degrees == 3 and found.p < 1e-6
    same = composition.dirichlet(spark.createDataFrame([(i % 2, v) for i, (_, v) in enumerate(rows)], "grp int, v array<double>"), 3)
    assert same.p > 0.001
    for x, df_, p in ((3.841458820694124, 1, 0.05), (9.487729036781154, 4, 0.05), (11.070497693516351, 5, 0.05), (0.0, 3, 1.0)):
        assert composition.chi2_tail(x, df_) == pytest.approx(p)
    with pytest.raises(ValueError):
        composition.dirichlet(df.where("false"), 3)


def test_hierarchy_splits_a_core_and_leaves_one_blob_alone(spark):
    from gridwright.jobs import hierarchy

    rng = np.random.default_rng(4)
    blobs = {"m1": [(3.0, 3.0), (3.0, 5.0), (-1.0, -1.0), (-1.0, -3.0)], "m2": [(0.0, 0.0)]}
    rows = [(g, i * 1000 + j, i, [float(a + rng.normal(0, 0.2)), float(b + rng.normal(0, 0.2)), 0.0001 * float(rng.normal())]) for g, all_ in blobs.items() for i, (a, b) in enumerate(all_) for j in range(150)]
    df = spark.createDataFrame(rows, "g string, i int, blob int, v array<double>")
    out = hierarchy.segment(df, ["t2", "md", "mtr"], restarts=2)
    got = out.groupBy("zone", "blob").agg(F.count(F.lit(1)).alias("n"), F.collect_set("habitat").alias("h")).collect()
    assert {r["g"] for r in out.select("g").distinct().collect()} == {"m1"} and out.count() == 600
    assert {(r.zone, r.blob, r.n) for r in got} == {("core", 0, 150), ("core", 1, 150), ("periphery", 2, 150), ("periphery", 3, 150)}
    core = {h for r in got if r.zone == "core" for h in r.h}
    rest = {h for r in got if r.zone == "periphery" for h in r.h}
    assert core == set(range(len(core))) and rest == set(range(len(core), len(core) + len(rest))) and len(core) >= 2
    idx = {r.g: r.idx for r in hierarchy.telling_components(df).collect()}
    assert idx == {"m1": [0, 1], "m2": [0, 1]}


def test_sub_habitats_split_what_differs_within_subjects(spark):
    from gridwright.jobs import hierarchy

    rng = np.random.default_rng(6)
    rows = [(h, s, [float(rng.normal(10 * s + (4.0 if h == 0 and j % 2 else 0.0), 0.3)), float(rng.normal(0, 0.3))], j % 2) for h, n in ((0, 200), (1, 200), (2, 20)) for s in (0, 1) for j in range(n)]
    df = spark.createDataFrame(rows, "habitat int, subject int, v array<double>, part int")
    out = hierarchy.sub_habitats(df, restarts=2)
    assert out.count() == 800 and sorted(out.columns) == sorted([*df.columns, "sub"])
    parts = {(r.habitat, r.part): r.s for r in out.groupBy("habitat", "part").agg(F.collect_set("sub").alias("s")).collect()}
    assert parts[0, 0] != parts[0, 1] and len(parts[0, 0]) == len(parts[0, 1]) == 1
    assert parts[1, 0] == parts[1, 1] == [0]


def test_suffixes_go_from_the_end(spark):
    from gridwright.functions import labels as L

    cases = {"Necrosis (cystic)": "Necrosis (cystic)", "Bulk tumor (atypical)": None, "X (a) (b)": "X", "X (a)(b) +": "X", "X (a (b)": "X", "X ()": "X ()", "X (a) y": "X (a) y", "(a)": "", "X+": "X", "X (1) (2) (3) (4) (5)": "X (1)", "": "", "a) (b)": "a)"}
    got = {r.l: r.s for r in spark.createDataFrame([(c,) for c in cases], "l string").select("l", L.without_suffixes(F.col("l")).alias("s")).collect()}
    assert all(got[c] == want for c, want in cases.items() if want is not None), got


def test_rules_for_k_follow_their_guards(spark):
    rows = [("a", 2, 10.0, 0.1, 0.5, 0.01), ("a", 3, 5.0, 0.6, 0.4, 0.01), ("a", 4, 7.0, 0.55, 0.9, 0.01), ("a", 5, 9.0, 0.5, 0.1, 0.01)]
    s = spark.createDataFrame(rows, "g string, k int, bic double, silhouette double, gap double, s double")
    assert selection.elbow_or_gap(s, ["g"]).select("elbow", "gap_k", "k").first() == (3, 2, 2) and selection.elbow_or_gap(s, ["g"], guard=True).first().k == 3
    low = s.withColumn("bic", -F.col("bic"))  # the least criterion at k = 2, whose silhouette is 0.1
    assert selection.criterion_or_elbow(low, ["g"]).first().k == 2 and selection.criterion_or_elbow(low, ["g"], 0.25).first().k == 3 and selection.criterion_or_elbow(s, ["g"], 0.25).first().k == 3


def test_methods_share_one_way_in(spark, grown):
    from gridwright.jobs import methods, modes
    from gridwright.sources.results import written

    points = written(modes.scaled_points(grown, ["T2", "DTI-MD"]), "test-methods")
    truth = grown.where("roi = 'ALL' and param = 'T2'").select("subject", "slice", "x", "y", "truth")
    for m in ("gmm", "kmeans"):
        choice, models = methods.choose_k(points, m, [2, 3], refs=2)
        k = {r.g: r.k for r in choice.collect()}
        assert set(k) == {"m1", "m2"} and set(k.values()) <= {2, 3} and set(models) == {(g, n) for g in k for n in (2, 3)}
        again = methods.cluster(points, m, k, models)
        assert again.columns == [*points.columns, "label"] and again.count() == points.count()
    for m in methods.METHODS:
        found = methods.cluster(points, m, {"m1": 2, "m2": 2}).join(truth, ["subject", "slice", "x", "y"]).groupBy("subject", "label", "truth").count().collect()
        pure = sum(max(r["count"] for r in found if (r.subject, r.label) == key) for key in {(r.subject, r.label) for r in found})
        assert pure > 0.95 * points.count(), m
    assert {r.subject for r in methods.cluster(points, "kmeans", {"m2": 2}).select("subject").distinct().collect()} == {"m2"}
    for call in (lambda: methods.choose_k(points, "other", [2]), lambda: methods.cluster(points, "other", 2)):
        with pytest.raises(ValueError, match="unknown method"):
            call()


def test_instances_equal_brute_force(spark):
    from gridwright.jobs import methods

    rng = np.random.default_rng(3)
    raw = {s: rng.normal((60, 1), (9, 0.2), (80, 2)) for s in "ab"}
    ref = {s: rng.normal((50, 0.8), (4, 0.1), (9, 2)) for s in "ab"}
    params = ["T2", "DTI-MD"]
    long = [(s, 1, i, roi_, p, float(x[i, j])) for roi_, of in (("ALL", raw), ("CL", ref)) for s, x in of.items() for i in range(len(x)) for j, p in enumerate(params)]
    long = spark.createDataFrame(long, "subject string, slice int, x int, roi string, param string, value double")
    scaled = {s: (x - np.median(x, 0)) / (np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)) for s, x in raw.items()}
    h = {s: (x[:, 0] > 1).astype(int) for s, x in scaled.items()}
    cells = spark.createDataFrame([(s, m, int(h[s][i]), [float(a) for a in x[i]]) for s, x in scaled.items() for m in ("gmm", "kmeans") for i in range(len(x))], "subject string, method string, habitat int, v array<double>")
    got = methods.instances(cells, long, params).collect()
    assert len(got) == 8
    for r in got:
        x, own = scaled[r.subject], h[r.subject] == r.cluster
        grand = x.mean(0)
        between = sum((h[r.subject] == c).sum() * (x[h[r.subject] == c].mean(0) - grand) ** 2 for c in (0, 1))
        eta = (between / ((x - grand) ** 2).sum(0)).mean()
        sd = ref[r.subject].std(0, ddof=1)
        z = (raw[r.subject][own].mean(0) - np.median(ref[r.subject], 0)) / sd
        assert np.allclose(r.v, x[own].mean(0)) and np.allclose(r.z, z) and np.isclose(r.eta2, eta) and np.isclose(r.proportion, own.mean())
        assert r.low_conf == (own.sum() < 30 or eta < 0.10) and r.weight == (0.5 if r.low_conf else 1.0)


def test_comparison_by_group_equals_the_groups_alone(spark):
    from gridwright.operators import comparison

    rng = np.random.default_rng(8)
    rows = [(g, s, c, "AB"[c % 2], rng.normal(2 * (c % 2), 1, 3).tolist(), rng.normal(1, 1, 3).tolist(), 0.25, 0.3, 1.0, False) for g in ("s1", "s2") for s in ("gmm", "kmeans", "srsc") for c in range(4) if (g, s) != ("s2", "srsc")]
    i = spark.createDataFrame(rows, "subject string, source string, cluster int, label string, v array<double>, z array<double>, proportion double, eta2 double, weight double, low_conf boolean")
    both = comparison.compare(i, by=["subject"])
    for g, n in (("s1", 3), ("s2", 2)):
        alone = comparison.compare(i.where(F.col("subject") == g).drop("subject"))
        want = {r.label: close_to([r])[0] for r in alone.collect()}
        found = {r.label: tuple(r) for r in both.where(F.col("subject") == g).select(alone.columns).collect()}
        assert found == want and all(r.n_sources_total == n for r in both.where(F.col("subject") == g).collect())
