"""Recognition, images and sources on scenes of known truth."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquill.functions import kernels
from sparquill.functions import patterns as patterns_of
from sparquill.functions.columns import parse_cell
from sparquill.operators import fits, ranking, recognition
from sparquill.operators.geometry import grouped
from sparquill.operators.scoring import greedy_recovery
from sparquill.sources import images, results
from sparquill.streaming import events
from tests import synthetic


def patterns():
    rng = np.random.default_rng(4)
    return {f"p{i}": rng.uniform(0, 200, (int(n), 2)) for i, n in enumerate((9, 11, 8, 12, 10, 9))}


def as_catalog(spark, own):
    return spark.createDataFrame([(n, k, float(x), float(y)) for n, xy in own.items() for k, (x, y) in enumerate(xy)], "name string, node int, x double, y double")


def test_recognises_synthetic_scenes(spark):
    own = patterns()
    cand = synthetic.scenes(spark, 17, 6, own, hit=0.9, error=1.5).cache()
    assert cand.repartition(5).exceptAll(synthetic.scenes(spark, 17, 6, own, hit=0.9, error=1.5)).count() == 0
    truth = {s: synthetic.scene_rows(17, s, own, hit=0.9, error=1.5)[0] for s in range(6)}
    found = recognition.hypotheses(cand, as_catalog(spark, own), cap=18000).cache()
    best = {r.scene: r.name for r in recognition.winners(found).collect()}
    assert sum(best.get(s) == n for s, n in truth.items()) >= 5
    done = recognition.finalise(cand, {"refined": (recognition.live(cand, 0.5), found)}, threshold=0.5).collect()
    assert len(done) == cand.select("scene", "query").distinct().count()
    assert sum(r.member or 0 for r in done) >= 5 * 5
    second = {r.scene: r.name for r in recognition.winners(recognition.two_pass(cand, as_catalog(spark, own), cap=18000)).collect()}
    assert sum(second.get(s) == n for s, n in truth.items()) >= 5


def test_no_evidence(spark):
    cand = spark.createDataFrame([(1, 1, 0, 10.0, 10.0, 0.9), (1, 2, 0, 500.0, 500.0, 0.9)], synthetic.CANDIDATES)
    found = recognition.hypotheses(cand, as_catalog(spark, patterns()))
    assert found.count() == 0
    assert {(r.name, r.member) for r in recognition.finalise(cand, {"refined": (cand, found)}).collect()} == {("unknown", 0)}
    assert not any(r.present for r in recognition.finalise(cand, {"refined": (recognition.live(cand, 0.72), found)}).collect())


def test_anchor_groups(spark):
    df = spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate((0.0, 1.0, 2.9, 5.0, 10.0))], "scene int, id long, x double, y double")
    assert sorted((r.id, r.anchor) for r in grouped(df, 3.0).collect()) == list(enumerate([0, 0, 0, 3, 4]))


def test_recovery_is_greedy(spark):
    truth = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 25.0, 0.0)], "scene int, id long, x double, y double")
    found = spark.createDataFrame([(1, 0, 10.0, 0.0), (1, 1, -11.0, 0.0)], "scene int, id long, x double, y double")
    assert greedy_recovery(truth, found, ["scene"]).first().recovery == pytest.approx(0.5)


def test_cells(spark):
    df = spark.createDataFrame([("(1.5, 2, 1)",), ("-1",), ("(1,2)",)], "c string")
    got = [r.p for r in df.where("c <> '(1,2)'").select(parse_cell(F.col("c")).alias("p")).collect()]
    assert (got[0].x, got[0].y, got[0].member, got[1]) == (1.5, 2.0, 1, None)
    with pytest.raises(Exception, match="no cell"):
        df.select(parse_cell(F.col("c")).alias("p")).collect()


def test_patch_is_found_in_its_sky(spark, tmp_path):
    rng = np.random.default_rng(2)
    sky = kernels.blur(rng.normal(size=(160, 160)), 2.5)
    sky = 255 * (sky - sky.min()) / np.ptp(sky)
    folder = tmp_path / "scene1" / "patches"
    folder.mkdir(parents=True)
    images.write_png(str(tmp_path / "scene1" / "a_image.png"), np.rint(sky))
    places = {1: (80.0, 70.0, 30.0, 1.15), 2: (60.0, 90.0, 200.0, 1.0)}
    for q, (x, y, angle, scale) in places.items():
        images.write_png(str(folder / f"patch_{q:02}.png"), np.clip(np.rint(synthetic.degraded(sky, x, y, angle, scale, gain=0.8, offset=12)), 0, 255))
    scene, patch = images.scenes(spark, str(tmp_path), 160), images.patches(spark, str(tmp_path))
    assert patch.count() == 2 and images.inventory(spark, str(tmp_path / "scene1" / "*.png")).count() == 1
    first = {r.query: r for r in images.candidates(scene, patch, adaptive=True, budget=300).where("pos = 0").collect()}
    for q, (x, y, *_rest) in places.items():
        assert np.hypot(first[q].x - x, first[q].y - y) < 2
    aux = images.auxiliary(scene).first()
    assert (aux.height, aux.width, len(aux.image)) == (160, 160, 160 * 160 * 4)
    found = images.candidates(scene, patch, adaptive=True, budget=300, dense=True)
    catalog = spark.createDataFrame([("c", k, float(x), float(y)) for k, (x, y) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1)))], "name string, node int, x double, y double")
    assert recognition.hypotheses(found, catalog).count() == 0  # scenes by name; two queries make no fit
    with pytest.raises(Exception, match="wrong size"):
        images.scenes(spark, str(tmp_path), 100).collect()


def test_diagrams(spark, tmp_path):
    a = np.zeros((40, 60, 4), np.uint8)
    a[..., 3] = 255
    for x, y in ((10, 8), (30, 20), (50, 33)):
        a[y - 1 : y + 2, x - 1 : x + 2, :3] = 255
    a[5, 5, :3] = 255  # one pixel is no mark
    a[25:27, 40:50, 1] = 255  # nor is a green line
    images.write_png(str(tmp_path / "cross_pattern.png"), a)
    got = sorted((r.name, r.x, r.y) for r in images.catalog(spark, str(tmp_path)).collect())
    assert got == [("cross", 10.0, 8.0), ("cross", 30.0, 20.0), ("cross", 50.0, 33.0)]


def test_degraded_identity_and_footprint():
    sky = np.add.outer(np.arange(128.0), 2 * np.arange(128.0))
    assert np.allclose(synthetic.degraded(sky, 55.5, 45.5, 0, 1), sky[30:62, 40:72])
    with pytest.raises(ValueError):
        synthetic.degraded(sky, 5, 5, 0, 1)


def test_kernels():
    i = np.zeros((21, 21))
    i[10, 10] = 1
    assert kernels.blur(i, 1.5).sum() == pytest.approx(1) and np.allclose(kernels.blur(np.ones((9, 9)), 2), 1)
    rng = np.random.default_rng(0)
    sky, part = rng.normal(size=(50, 60)), None
    part = sky[12:22, 31:41]
    m = kernels.correlation_map(sky, part)
    assert m.shape == (41, 51) and np.unravel_index(m.argmax(), m.shape) == (12, 31) and m.max() == pytest.approx(1)
    assert [p[:2] for p in kernels.suppressed_peaks(m, 1, 5)] == [(31, 12)]
    mask = np.zeros((12, 12), bool)
    mask[1:3, 1:3] = mask[5, 2:9] = mask[6, 9] = mask[10, 10] = True
    n = kernels.components(mask)
    assert n.max() == 3 and n[5, 2] == n[6, 9] != n[10, 10]
    assert all(-1.001 <= f(sky[:32, :32], sky[5:37, 5:37]) <= 1.001 for f in kernels.SCORERS.values())


def test_submission_round_trip(spark, tmp_path):
    sample = spark.createDataFrame([("s1", 2, "-1", "-1", "-1", "x"), ("s2", 3, "-1", "-1", "-1", "x")], "Id string, n_patches int, patch_03 string, patch_01 string, patch_02 string, constellation string")
    rows = [("s1", 1, 10.12345, 20.0, 1, "a"), ("s1", 2, None, None, None, "a"), ("s2", 1, None, None, None, "b"), ("s2", 2, 5.0, 6.0, 0, "b"), ("s2", 3, 7.0, 8.0, 1, "b")]
    own = spark.createDataFrame(rows, "scene string, query int, x double, y double, member int, name string")
    wide = results.submission(own, sample)
    assert wide.columns == sample.columns
    results.write_csv(wide, str(tmp_path / "out"))
    back = {(r.scene, r.query): (r.x, r.y, r.member, r.constellation) for r in results.read_truth(spark, str(tmp_path / "out")).collect()}
    assert back == {("s1", 1): (10.123, 20.0, 1, "a"), ("s1", 2): (None, None, None, "a"), ("s2", 1): (None, None, None, "b"), ("s2", 2): (5.0, 6.0, 0, "b"), ("s2", 3): (7.0, 8.0, 1, "b")}
    with pytest.raises(Exception, match="one table only"):
        results.submission(own.where("scene = 's1'"), sample).collect()


def test_caches_and_manifests(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert results.cached(spark, str(tmp_path), {"a": 1}, make).count() == 3
    assert len(calls) == 1
    m = results.Manifest(str(tmp_path / "m.json"), {"k": 2})
    assert '"running"' in (tmp_path / "m.json").read_text()
    m.complete({"score": 0.5})
    assert '"complete"' in (tmp_path / "m.json").read_text()
    with pytest.raises(ValueError):
        m.complete({"score": float("nan")})
    assert results.pending(spark.range(5), spark.range(2), ["id"]).count() == 3
    split = spark.createDataFrame([("confirmation",)], "split string")
    with pytest.raises(PermissionError):
        results.guarded(split, "confirmation")
    assert results.guarded(split, "confirmation", True, str(tmp_path / "access.jsonl")).count() == 1
    assert (tmp_path / "access.jsonl").read_text().count("confirmation") == 1
    results.write_scene_json(spark.range(2).withColumn("scene", F.lit("s")), str(tmp_path / "j"))
    assert results.read_scene_json(spark, str(tmp_path / "j"), "id long, scene string").count() == 2


def test_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "in"))
    q = events.windowed(events.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("got").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("got").agg(F.sum("n")).first()[0] == spark.read.parquet(str(tmp_path / "in")).count()


def test_queries_try_all_seeds_of_the_default_cap(spark, monkeypatch):
    from sparquill.plans import recognition_plans

    budgets = []
    real = recognition._fitted
    monkeypatch.setattr(recognition, "_fitted", lambda *a: budgets.append(a[-1].cap) or real(*a))
    for query in (recognition_plans.c5, recognition_plans.c9, recognition_plans.g8):
        query(spark, "/root/testdata/sf0.001")
    assert budgets == [80_000] * 4


# Patterns against plain loops --------------------------------------------------------------------------------------


def slow_triangles(points):
    out = {}
    for ids in itertools.combinations(range(len(points)), 3):
        sides = sorted((np.linalg.norm(points[b] - points[c]), k, a) for k, (a, b, c) in enumerate((ids, (ids[1], ids[0], ids[2]), (ids[2], ids[0], ids[1]))))
        area = abs(np.linalg.det(np.c_[points[list(ids)], np.ones(3)]))
        if sides[0][0] > 1e-5 and area > 0.02 * sides[2][0] ** 2:
            out[tuple(s[2] for s in sides)] = (sides[0][0] / sides[2][0], sides[1][0] / sides[2][0])
    return out


def slow_quads(points):
    out = {}
    for ids in itertools.combinations(range(len(points)), 4):
        area = [(-1) ** i * np.linalg.det(np.c_[points[[j for j in ids if j != own]], np.ones(3)]) for i, own in enumerate(ids)]
        total = sum(map(abs, area))
        sign = 1 if max(area, key=abs) > 0 else -1
        shares = sorted((sign * a / total, own) for a, own in zip(area, ids, strict=True))
        if min(abs(a) for a, _ in shares) > 0.015 and min(b[0] - a[0] for a, b in itertools.pairwise(shares)) > 0.002:
            out[tuple(own for _, own in shares)] = tuple(a for a, _ in shares)
    return out


def test_invariants_against_loops():
    rng = np.random.default_rng(3)
    points = rng.uniform(0, 100, (9, 2))
    points[8] = (points[0] + points[1]) / 2
    for fast, slow in ((patterns_of.ordered_triangles, slow_triangles), (patterns_of.affine_quads, slow_quads)):
        ids, form = fast(points)
        want = slow(points)
        assert {tuple(i) for i in ids.tolist()} == set(want)
        assert all(np.allclose(f, want[tuple(i)]) for i, f in zip(ids.tolist(), form, strict=True))
    turned = points @ rng.normal(size=(2, 2)) * 3 + 7
    (a, u), (b, v) = patterns_of.affine_quads(points), patterns_of.affine_quads(turned)
    assert (a == b).all() and np.allclose(u, v, atol=1e-8)
    which, row, d = patterns_of.nearest_rows(u[:20], patterns_of.Table(v[5:], 20), 4)
    every = np.linalg.norm(u[:20, None] - v[5:], axis=2)
    assert np.allclose(np.sort(every, axis=1)[:, :4].ravel(), np.concatenate([np.sort(d[which == i]) for i in range(20)])) and (np.diff(d) >= 0).all()


def slow_pairs(d, groups, reach):
    found, nodes, used = [], set(), set()
    for gap, i, j in sorted((d[i, j], i, j) for i in range(d.shape[0]) for j in range(d.shape[1]) if d[i, j] < reach):
        if i not in nodes and groups[j] not in used:
            nodes.add(i)
            used.add(groups[j])
            found.append((i, j, gap))
    return found


def slow_fit(nodes, scene, budget, o):
    """The best score of a class, one seed at a time; the seeds are all of both kinds where the budget allows."""
    unit = (nodes - nodes.mean(axis=0)) / np.ptp(nodes, axis=0)
    one = lambda m: np.c_[unit, np.ones(len(unit))] @ m
    best = (-1e9, 0)
    for make, k in ((slow_quads, 4), (slow_triangles, 20)):
        table = make(scene.seeds)
        for own, form in make(unit).items():
            for other in sorted(table, key=lambda t: np.linalg.norm(np.subtract(table[t], form)))[:k]:
                m = np.linalg.lstsq(np.c_[unit[list(own)], np.ones(len(own))], scene.seeds[list(other)], rcond=None)[0]
                ok = lambda m: (s := np.linalg.svd(m[:2], compute_uv=False))[1] >= 50 and s[0] <= 6000 and s[0] <= 8 * s[1]
                if not ok(m):
                    continue
                gap = lambda m: np.linalg.norm(one(m)[:, None] - scene.points, axis=2)
                pairs = slow_pairs(gap(m), scene.groups, max(24, o.tolerance))
                for _ in range(3 if len(pairs) >= 4 else 0):
                    i, j = [p[0] for p in pairs], [p[1] for p in pairs]
                    new = np.linalg.lstsq(np.c_[unit[i], np.ones(len(i))], scene.points[j], rcond=None)[0]
                    if not ok(new):
                        break
                    m, pairs = new, slow_pairs(gap(new), scene.groups, o.tolerance)
                    if len(pairs) < 4:
                        break
                if len(pairs) >= 4:
                    p = min(0.8, len(set(scene.groups)) * np.pi * o.tolerance**2 / 9e6)
                    n = max(len(unit) - 3, 1)
                    tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(len(pairs) - 3, n + 1))
                    a, b = m[0], m[1]
                    score = -math.log10(tail) - 0.5 * np.mean([g for *_, g in pairs]) / o.tolerance - o.shear_penalty * abs(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b))
                    best = max(best, (score, len(pairs)))
    return best


def test_fits_against_loops():
    rng = np.random.default_rng(8)
    o = patterns_of.Options()
    seen = 0
    for turn in range(6):
        nodes = rng.uniform(0, 100, (int(rng.integers(4, 7)), 2))
        there = synthetic.place(nodes, rng) + rng.normal(0, 4, nodes.shape)
        points = np.concatenate([there, rng.uniform(0, 3000, (12, 2)), there[:3] + rng.normal(0, 20, (3, 2))])
        groups = np.concatenate([np.arange(len(there) + 12), np.arange(3)])
        scene = patterns_of.Scene(points, groups, np.ones(len(points)), np.zeros(len(points), int), points[: len(there) + 5])
        got = patterns_of.best_fit(nodes, scene, 10_000, o)
        want = slow_fit(nodes, scene, 10_000, o)
        assert (got["score"], got["support"]) == (pytest.approx(want[0], abs=1e-6), want[1]), turn
        seen += got["support"] > 0
    assert seen >= 4


def test_map_and_pairs_change_together():
    """A fit that its refit leaves with too few pairs is dropped; one whose first refit is no usable map keeps the first pairs."""
    rng = np.random.default_rng(1)
    o = patterns_of.Options(tolerance=1.0)
    unit = rng.uniform(-0.5, 0.5, (5, 2))
    m = np.array([[[1000.0, 0.0], [0.0, 1000.0], [1500.0, 1500.0]]])
    points = patterns_of.mapped(unit, m)[0] + rng.uniform(-20, 20, (5, 2)) / 1.5
    scene = patterns_of.Scene(points, np.arange(5), np.ones(5), np.zeros(5, int), points)
    assert patterns_of._settled(unit, scene, m.copy(), "affine", o) is None
    line = np.column_stack([np.linspace(-0.5, 0.5, 5), np.zeros(5)])
    points = patterns_of.mapped(line, m)[0]
    scene = patterns_of.Scene(points, np.arange(5), np.ones(5), np.zeros(5, int), points)
    kept = patterns_of._settled(line, scene, m.copy(), "affine", o)
    assert kept["support"] == 5 and np.allclose(kept["matrix"], m.ravel())


def test_options_of_the_recogniser(spark):
    own = patterns()
    cand = synthetic.scenes(spark, 5, 2, own, hit=0.8, error=1.5).cache()
    nodes = as_catalog(spark, own | {"pair": np.array([[0.0, 0.0], [1.0, 1.0]])})
    base = {(r.scene, r.name): r for r in recognition.hypotheses(cand, nodes, cap=14_000).collect()}
    assert len(base) == 2 * 7 and base[0, "pair"].reason == "pair-only ambiguity" and base[0, "pair"].score == -1e9
    truth = {s: synthetic.scene_rows(5, s, own, hit=0.8, error=1.5)[0] for s in range(2)}
    for options in ({"score_mode": "likelihood", "size_penalty": 1.0}, {"models": ("affine", "similarity")}, {"quad_share": 0.6}, {"null_mode": "pool_decorrelate"}, {"appearance_weight": 1.0, "rank_weight": 0.1}, {"pool_by": "calib"}):
        best = {r.scene: r.name for r in recognition.winners(recognition.hypotheses(cand, nodes, cap=14_000, **options)).collect()}
        assert best == truth, options
    bright = np.full((3000, 3000), 0.9, np.float32)
    aux = spark.createDataFrame([(0, 3000, 3000, bright.tobytes())], "scene int, height int, width int, image binary")
    lit = {(r.scene, r.name): r for r in recognition.hypotheses(cand, nodes, cap=14_000, auxiliary=aux).collect()}
    assert all(r.auxiliary <= 0.9 + 1e-6 for r in lit.values() if r.auxiliary is not None) and any(r.auxiliary > 0.5 for (s, _), r in lit.items() if s == 0 and r.auxiliary is not None)
    assert all(lit[k].score == base[k].score for k in base if k[0] == 1)
    assert {r.scene: r.name for r in recognition.winners(recognition.legacy(cand, nodes, cap=14_000)).collect()} == truth
    assert recognition.members_by_group(cand, recognition.legacy(cand, nodes, cap=14_000)).count() >= 8


def test_catalog_goes_in_blocks(spark, monkeypatch):
    own = patterns()
    cand = synthetic.scenes(spark, 5, 1, own, hit=0.9, error=1.5).cache()
    key = lambda df: sorted((r.name, r.score, r.support) for r in df.collect())
    whole = key(recognition.hypotheses(cand, as_catalog(spark, own), cap=6000))
    monkeypatch.setattr(recognition, "BLOCK", 15)
    assert key(recognition.hypotheses(cand, as_catalog(spark, own), cap=6000)) == whole


def scene_of(points, groups, scores, ranks, seeds):
    return patterns_of.Scene(np.array(points), np.array(groups), np.array(scores), np.array(ranks), np.array(seeds))


@pytest.mark.parametrize("budget, options", [(150, {"quad_share": 0.5, "null_mode": "pool", "appearance_weight": 1.0, "rank_weight": 0.1}), (5000, {"models": ("affine", "similarity"), "score_mode": "likelihood"}), (5000, {"checked": False, "refits": 2, "tolerance": 24.0})])
def test_table_of_seeds_equals_the_fits_of_arrays(spark, budget, options):
    """Every class of every scene: score, support, counts and reason."""
    rng = np.random.default_rng(12)
    own = {f"p{i}": rng.uniform(0, 200, (n, 2)) for i, n in enumerate((7, 6, 5, 4, 3, 2, 6))} | {"line": np.column_stack([np.arange(5.0), np.zeros(5)])}
    pool, making, scenes = [], [], {}
    for scene in range(3):
        there = synthetic.place(own["p0" if scene else "p1"], rng)
        there = there + rng.normal(0, 3, there.shape)
        points = np.concatenate([there, rng.uniform(0, 3000, (9, 2)), there[:2] + rng.normal(0, 12, (2, 2))])
        groups = np.concatenate([np.arange(len(there) + 9), np.arange(2)])
        scores, ranks = rng.uniform(0.3, 1, len(points)).round(3), np.concatenate([np.zeros(len(there) + 9, int), [1, 1]])
        pool += [(scene, int(g), float(x), float(y), float(s), int(r)) for (x, y), g, s, r in zip(points, groups, scores, ranks)]
        making += [(scene, i, float(x), float(y)) for i, (x, y) in enumerate(points[: len(there) + 4])]
        scenes[scene] = scene_of(points, groups, scores, ranks, points[: len(there) + 4])
    pool = spark.createDataFrame(pool, "scene int, grp long, x double, y double, score double, rank long")
    making = spark.createDataFrame(making, "scene int, id int, x double, y double")
    o, like = fits.Options(**options), patterns_of.Options(**options)
    got = {(r.scene, r.name): r for r in fits.fitted(pool, making, as_catalog(spark, own), budget, o).collect()}
    assert len(got) == len(scenes) * len(own)
    supported = 0
    for (scene, name), r in got.items():
        want = patterns_of.best_fit(own[name], scenes[scene], budget, like)
        assert (r.support, r.nodes, r.attempted, r.accepted, r.reason) == (want["support"], want["nodes"], want["attempted"], want["accepted"], want.get("reason")), (scene, name)
        assert r.score == pytest.approx(want["score"], abs=1e-6), (scene, name)
        supported += r.support > 0
        if r.support:
            assert np.allclose(r.matrix, want["matrix"], rtol=1e-6, atol=1e-6) and r.model == want["model"]
            assert [(p.node, p.grp) for p in r.pairs] == [p[:2] for p in want["pairs"]]
    assert supported >= 3


def test_pool_and_eligibility(spark):
    rows = [(1, 1, p, x, x, s) for p, (x, s) in enumerate(((10.0, 0.9), (500.0, 0.4), (600.0, 0.3)))] + [(1, 2, p, x, x, s) for p, (x, s) in enumerate(((20.0, 0.9), (700.0, 0.89), (800.0, 0.88)))]
    cand = spark.createDataFrame(rows, synthetic.CANDIDATES)
    pooled = lambda c, **k: {q: [r.pos for r in ranking.pool(c, 8, 0.03, 0.15, **k).where(f"query = {q}").orderBy("rank").collect()] for q in (1, 2)}
    assert pooled(cand) == {1: [0], 2: [0, 1, 2]}
    near = spark.createDataFrame([(1, 500.0, 482.0)], "scene int, x double, y double")
    marked = recognition.mark_eligible(cand, near, 18.0)
    assert [(r.query, r.pos) for r in marked.where("eligible").collect()] == [(1, 1)]
    assert pooled(marked) == {1: [1, 0], 2: [0, 1, 2]}  # eligible first, and one more
    again = cand.withColumn("rank_score", F.col("x"))
    assert pooled(again) == {1: [2], 2: [2, 1, 0]} and pooled(again, pool_by="calib") == {1: [0], 2: [2, 1, 0]}


def test_pool_scores_agree_with_verification():
    image = kernels.blur(np.random.default_rng(6).normal(size=(160, 160)), 2.5)
    patch = synthetic.degraded(image, 80, 70, 30, 1.15)
    at = np.array([[80.0, 70.0], [60.0, 90.0], [100.0, 60.0], [81.0, 70.0]])
    whole, split = kernels.pool_scores(image, patch, at), kernels.pool_scores(image, patch, at, channels=True)
    assert whole[:, 0].argmax() == 0 and split[:, 0].argmax() == 0 and whole[0, 0] > 0.9 and (split[:, 0] <= 1).all()
    assert whole[0, 0] >= whole[3, 0] and len(whole) == len(at)  # nothing is suppressed


def test_exhaustive_fit():
    rng = np.random.default_rng(7)
    nodes = rng.uniform(0, 100, (5, 2))
    unit = (nodes - nodes.mean(axis=0)) / np.ptp(nodes, axis=0)
    points = unit @ [[700.0, 200.0], [-150.0, 650.0]] + 1500 + rng.normal(0, 3, (5, 2))
    for model, most in (("affine", 6), ("similarity", 400)):
        got = patterns_of.exhaustive_fit(nodes, points, model, tolerance=60.0 if model == "affine" else 400.0)
        assert got["support"] >= 4 and got["mean_residual"] < most
    best = patterns_of.exhaustive_fit(nodes, points)
    assert best["support"] == 5 and sorted(best["pairs"]) == [(i, i) for i in range(5)]
    assert patterns_of.exhaustive_fit(nodes, rng.uniform(0, 3000, (3, 2))) is None


def test_pairs_near_by_are_matched_as_all_pairs_are():
    """Matching over the pairs that cells bring equals matching over the whole table of distances, ties and several points of a group included, and looks at no more than what lies near."""
    rng = np.random.default_rng(21)
    points = np.round(rng.random((4000, 2)) * 1200)
    scene = patterns_of.Scene(points, np.sort(rng.integers(0, 1500, 4000)), np.ones(4000), np.zeros(4000, int), points[:5])
    where = np.concatenate([np.round(rng.random((30, 9, 2)) * 1300 - 50), np.full((1, 9, 2), 1e9)])
    for far in (24.0, 18.0):
        row, point, square = scene.near(where.reshape(-1, 2), far, 24.0)
        d = ((where[:, :, None] - scene.points) ** 2).sum(axis=3)
        assert len(row) == (d < far * far).sum() and np.array_equal(square, d.reshape(-1, 4000)[row, point])
        want = patterns_of.one_to_one(d.copy(), scene.starts, far * far)
        got = np.full(where.shape[:2], -1)
        place, own = patterns_of.matched_once(row, point, square, 9, scene.number)
        got.ravel()[place] = scene.number[own]
        assert np.array_equal(got, want) and (want >= 0).sum() > 100
        assert np.array_equal(d.reshape(-1, 4000)[place, own], np.where(scene.number == got.ravel()[place][:, None], d.reshape(-1, 4000)[place], np.inf).min(axis=1))


@pytest.mark.parametrize("dims", [2, 4])
def test_the_first_shapes_of_all(dims):
    rng = np.random.default_rng(22)
    rows, wanted = np.round(rng.random((3000, dims)), 2), np.round(rng.random((90, dims)) * 1.2 - 0.1, 2)
    table = patterns_of.Table(rows)
    d = np.sqrt(((wanted[:, None] - rows) ** 2).sum(axis=2))
    best = np.argsort(d, axis=1, kind="stable")[:, :5]
    which, row = np.repeat(np.arange(90), 5), best.ravel()
    order = np.lexsort((row, which, d[which, row]))
    for most in (None, 1, 7, 300):
        got = patterns_of.nearest_rows(wanted, table, 5, most)
        assert np.array_equal(got[0], which[order][:most]) and np.array_equal(got[1], row[order][:most]) and np.array_equal(got[2], d[which, row][order][:most])


def test_classes_are_fitted_together():
    """Many classes give what each gives alone, of any number of nodes, and go through the steps together: the pool is looked at a few times, not for each class."""
    rng = np.random.default_rng(23)
    n = 1500
    scene = patterns_of.Scene(rng.uniform(0, 3000, (n, 2)), np.sort(rng.integers(0, 700, n)), rng.random(n), rng.integers(0, 4, n), rng.uniform(0, 3000, (12, 2)))
    own = [rng.uniform(0, 3000, (int(k), 2)) for k in rng.choice([9, 9, 9, 2, 3, 6], 60)] + [np.zeros((9, 2)), np.column_stack([np.arange(9.0), np.zeros(9)])]
    for budget, options in ((3, {}), (50, {"quad_share": 0.5, "checked": False, "null_mode": "pool", "tolerance": 24.0}), (0, {})):
        o = patterns_of.Options(**options)
        alone = [patterns_of.best_fit(nodes, scene, budget, o) for nodes in own]
        looks, near = [], patterns_of.Scene.near
        scene.near = lambda *a: looks.append(1) or near(scene, *a)  # noqa: B023
        assert patterns_of.best_fits(own, scene, budget, o) == alone
        del scene.near
        assert len(looks) <= 3 * 2 * 4 * 2 and (not budget or any(h["support"] for h in alone))


def test_anchors_are_made_once(spark, monkeypatch):
    from sparquill.plans import recognition_plans

    made, real = [], recognition.anchors_of
    for module in (recognition, recognition_plans):
        monkeypatch.setattr(module, "anchors_of", lambda cand: made.append(1) or real(cand), raising=False)
    monkeypatch.setattr(recognition, "_fitted", lambda dealt, *a: spark.createDataFrame([], recognition.schema(dealt)))
    for query, candidates in ((recognition_plans.c6, 1), (recognition_plans.c8, 2), (recognition_plans.c9, 1), (recognition_plans.g8, 1)):
        made.clear()
        query(spark, "/root/testdata/sf0.001")
        assert len(made) == candidates


def test_a_crowded_pool_costs_some_points_a_place(monkeypatch):
    """The fits equal those from all pairs within reach, ties and several points of a group included, and few of these pairs are looked at."""
    rng = np.random.default_rng(11)
    points = np.concatenate([np.rint(rng.normal(1500, 120, (6000, 2)) * 2) / 2, rng.uniform(0, 3000, (400, 2))])
    scene = patterns_of.Scene(points, rng.integers(0, 2500, len(points)), rng.uniform(0, 1, len(points)), rng.integers(0, 4, len(points)), points[:12])
    at = np.concatenate([points[::7] + rng.choice([0.0, 0.25, 30.0], (915, 1)), [[-1e6, 9e9]]])
    between = ((at[:, None] - scene.points) ** 2).sum(axis=2)
    for far in (18.0, 24.0):
        assert (scene.nearest(at, far, 24.0) == np.where(between.min(axis=1) < far * far, between.argmin(axis=1), -1)).all()
    unit = np.stack([rng.uniform(-0.5, 0.5, (9, 2)) for _ in range(40)])
    maps = np.array([[[rng.uniform(60, 300), 20.0], [-20.0, rng.uniform(60, 300)], rng.uniform(1300, 1700, 2)] for _ in range(40)])
    seen, near = [], patterns_of.Scene.near
    monkeypatch.setattr(patterns_of.Scene, "near", lambda self, at, *rest: seen.append((len(at), len((got := near(self, at, *rest))[0]))) or got)
    found = dict(patterns_of._settled_by_pattern(unit, np.arange(40), scene, maps.copy(), "affine", patterns_of.Options(refits=0)))
    placed = patterns_of.mapped(unit, maps)
    pairs = sum(n for _, n in seen)
    for i in range(40):
        d = ((placed[i][:, None] - scene.points) ** 2).sum(axis=2)[None]
        taken = patterns_of.one_to_one(d, scene.starts, 24.0**2)[0]
        assert [(p[0], p[1]) for p in found[i]["pairs"]] == [(k, scene.groups[scene.starts[g]]) for k, g in enumerate(taken) if g >= 0]
    assert pairs < 12 * 40 * 9  # within reach are some forty a place


def test_seeds_without_a_usable_map_give_no_fit():
    """Of seeds whose maps are all unusable nothing is left to assign, which is no error."""
    rng = np.random.default_rng(5)
    scene = patterns_of.Scene(rng.uniform(0, 3000, (20, 2)), np.arange(20), np.ones(20), np.zeros(20, int), rng.uniform(0, 10, (8, 2)))
    for quad_share in (0.0, 0.5):
        got = patterns_of.best_fit(rng.uniform(0, 100, (6, 2)), scene, 50, patterns_of.Options(quad_share=quad_share))
        assert got["attempted"] == 50 and got["accepted"] == 0 and got["reason"] == "no verified fit"


@pytest.mark.parametrize("corners, k", [(3, 20), (4, 4)])
def test_nearest_shapes_are_those_of_all(corners, k, monkeypatch):
    """Shapes made in steps, by one task or several, bring the nearest of all shapes of all points, ties included."""
    from sparquill.functions import shapes

    monkeypatch.setattr(shapes, "START", {3: 12, 4: 8})
    rng = np.random.default_rng(31)
    make = patterns_of.affine_quads if corners == 4 else patterns_of.ordered_triangles
    for points in (rng.uniform(0, 3000, (60, 2)), np.round(rng.uniform(0, 9, (40, 2))) * 300, np.column_stack([np.arange(30.0), np.zeros(30)]), rng.uniform(0, 3000, (corners, 2))):
        wanted = np.concatenate([make(rng.uniform(0, 1, (9, 2)))[1], make(np.round(rng.uniform(0, 4, (9, 2))))[1]])
        ids, form = make(points)
        which, row, d = patterns_of.nearest_rows(wanted, patterns_of.Table(form), k)
        order = np.lexsort((row, d, which))
        want = which[order], ids[row[order]], d[order]
        assert all(np.array_equal(a, b) for a, b in zip(shapes.nearest_shapes(wanted, points, k, corners), want, strict=True))
        parts = [np.concatenate(c) for c in zip(*(shapes.nearest_shapes(wanted, points, k, corners, i, 3) for i in range(3)), strict=True)]
        order = np.lexsort((*np.sort(parts[1], axis=1).T[::-1], parts[2], parts[0]))
        order = order[np.arange(len(order)) - np.searchsorted(parts[0][order], parts[0][order]) < k]
        assert all(np.array_equal(a[order], b) for a, b in zip(parts, want, strict=True))


def test_all_points_make_seeds_and_all_seeds_are_tried(spark):
    """A scene of more than 56 points and a catalog of whose seeds a cap of 50 leaves few: the fits are those of all seeds of all points."""
    rng = np.random.default_rng(32)
    own = {f"p{i}": rng.uniform(0, 200, (n, 2)) for i, n in enumerate((6, 5, 7, 2))}
    there = synthetic.place(own["p0"], rng) + rng.normal(0, 1, own["p0"].shape)
    points = np.concatenate([rng.uniform(0, 3000, (58, 2)), there])  # the pattern's points score least
    rows = [(0, i, 0, float(x), float(y), 0.9 - 0.001 * i) for i, (x, y) in enumerate(points)]
    cand = spark.createDataFrame(rows, "scene int, query int, pos int, x double, y double, score double")
    found = {r.name: r for r in recognition.hypotheses(cand, as_catalog(spark, own), cap=50).collect()}
    groups = np.array([r.grp for r in recognition.anchors_of(cand).orderBy("id").collect()])
    scene = patterns_of.Scene(points, groups, np.array([r[5] for r in rows]), np.zeros(len(points), int), points)
    want = dict(zip(own, patterns_of.best_fits(list(own.values()), scene, 10**7, patterns_of.Options()), strict=True))
    for name, w in want.items():
        got = found[name]
        assert (got.score, got.support, got.attempted, got.accepted, got.reason) == (pytest.approx(w["score"], abs=1e-9), w["support"], w["attempted"], w["accepted"], w.get("reason")), name
    assert found["p0"].support == 6 and found["p0"].attempted > 50


def test_neighbours_of_shapes_take_all_points_and_store_no_shapes(spark, tmp_path, monkeypatch):
    """Scenes of more than 56 points, in one task a block and in several: as SQL over all triangles, and over the quads of the 56 best; no shape is a row before it is a neighbour."""
    import duckdb

    from sparquill.operators import shapes
    from sparquill.plans import geometry_plans

    rng = np.random.default_rng(33)
    rows = [(i, i % 2 * 10, [float(v) for v in np.round(rng.uniform(-0.5, 0.5, 3), 2)]) for i in range(126)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for chunk in (shapes.CHUNK, 4000):
        monkeypatch.setattr(shapes, "CHUNK", chunk)
        for query, sql in ((geometry_plans.j5, geometry_plans.J5_SQL), (geometry_plans.j6, geometry_plans.J6_SQL)):
            df = query(spark, str(tmp_path))
            assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
            found, columns = df.toArrow(), ", ".join(df.columns)
            con.sql(f"CREATE OR REPLACE TEMP TABLE want AS SELECT {columns} FROM ({sql})")
            con.sql(f"CREATE OR REPLACE TEMP TABLE got AS SELECT {columns} FROM found")
            assert con.sql("SELECT (SELECT count(*) FROM got) - (SELECT count(*) FROM want), (SELECT count(*) FROM (FROM got EXCEPT ALL FROM want)), (SELECT count(*) FROM (SELECT a_order, k, d FROM got EXCEPT ALL SELECT a_order, k, d FROM want))").fetchall() == [(0, 0, 0)], (chunk, query)
