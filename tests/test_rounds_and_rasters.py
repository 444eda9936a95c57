"""Rounds, rasters, nearest rows, table functions and the record source against loops and brute force."""

import itertools
import json
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquill.functions import grids
from sparquill.operators import analysis, geometry, nearest, raster, rounds, scoring, slopes
from sparquill.operators.nearest import nearest_rows
from sparquill.plans import raster_plans
from sparquill.sources import records


def test_one_to_one_equals_going_one_by_one(spark):
    rng = random.Random(1)
    rows = [(s, i, j, rng.choice([0.5, 1.0, 1.5, rng.random()])) for s in range(3) for i in range(14) for j in range(12) if rng.random() < 0.5]
    got = sorted(tuple(r) for r in rounds.one_to_one(spark.createDataFrame(rows, "s int, l int, r int, d double"), ["s"], "l", "r").collect())
    want = []
    for s in range(3):
        left, right = set(), set()
        for d, i, j in sorted((d, i, j) for t, i, j, d in rows if t == s):
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                want.append((s, i, j, d))
    assert got == sorted(want)
    assert rounds.one_to_one(spark.createDataFrame([], "s int, l int, r int, d double"), ["s"], "l", "r").collect() == []


def test_first_kept_equals_going_in_order(spark):
    rng = random.Random(2)
    conflicts = [(s, i, j) for s in range(2) for i, j in itertools.combinations(range(30), 2) if rng.random() < 0.1]
    rows = [(s, i) for s in range(2) for i in range(30)]
    got = {tuple(r) for r in rounds.first_kept(spark.createDataFrame(rows, "s int, id int"), ["s"], spark.createDataFrame(conflicts, "s int, first int, second int")).collect()}
    want = set()
    for s, j in rows:
        if not any((s, i) in want for t, i, k in conflicts if t == s and k == j):
            want.add((s, j))
    assert got == want


def test_connected(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7)]
    nodes = list(range(400))
    root = dict(zip(nodes, nodes))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in rounds.connected(spark.createDataFrame([(n,) for n in nodes], "id int"), spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: find(n) for n in nodes}


def as_pixels(spark, *images):
    return spark.createDataFrame([(k, x, y, float(i[y, x])) for k, i in enumerate(images) for y in range(i.shape[0]) for x in range(i.shape[1])], "image int, x long, y long, v double")


@pytest.fixture(params=[512, 7])
def tiled(request, monkeypatch):
    monkeypatch.setattr(raster, "TILE", request.param)


def test_sliding_maxima_and_peaks(spark, tiled):
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 30, (23, 31)).astype(float), np.zeros((9, 12))]
    pixels = as_pixels(spark, *images)
    got = {(r.image, r.x, r.y): r.most for r in raster.sliding_max(pixels, 3).collect()}
    for k, i in enumerate(images):
        for y in range(i.shape[0]):
            for x in range(i.shape[1]):
                assert got[k, x, y] == i[max(0, y - 3) : y + 4, max(0, x - 3) : x + 4].max()
    got = sorted((r.image, r["rank"], r.x, r.y, r.v) for r in raster.peaks(pixels, 2, 12).collect())
    want = []
    for k, i in enumerate(images):
        left = i.copy()
        for n in range(12):
            if not np.isfinite(left).any():
                break
            y, x = np.unravel_index(left.argmax(), left.shape)
            want.append((k, n + 1, int(x), int(y), float(i[y, x])))
            left[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3] = -np.inf
    assert got == want


def test_components_of_pixels(spark, tiled):
    rng = np.random.default_rng(5)
    spiral = np.zeros((15, 15))
    spiral[::2] = 1
    spiral[1::4, -1] = spiral[3::4, 0] = 1  # one long snake
    images = [(rng.random((25, 33)) < 0.35).astype(float), spiral, np.zeros((4, 4))]
    got = sorted((r.image, r.y, r.x, r.area, round(r.cx, 9), round(r.cy, 9)) for r in raster.components(as_pixels(spark, *images), F.col("v") > 0.5).collect())
    want = []
    for k, i in enumerate(images):
        left = {(y, x) for y, x in zip(*np.nonzero(i))}
        while left:
            todo = [min(left)]
            own = set(todo)
            while todo:
                y, x = todo.pop()
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left - own
                own |= near
                todo += near
            left -= own
            if len(own) >= 2:
                y, x = min(own)
                want.append((k, int(y), int(x), len(own), round(float(np.mean([p[1] for p in own])), 9), round(float(np.mean([p[0] for p in own])), 9)))
    assert got == sorted(want) and (1, 0, 0, int(spiral.sum())) in {g[:4] for g in got}


def test_correlation_scan(spark):
    rng = np.random.default_rng(6)
    images = [rng.normal(size=(12, 15)), np.full((6, 6), 2.0)]
    part = images[0][4:7, 5:9]
    template = spark.createDataFrame([(k, i, j, float(part[j, i])) for k in (0, 1) for j in range(3) for i in range(4)], "image int, i int, j int, t double")
    got = {(r.image, r.x, r.y): r.score for r in raster.correlation_scan(as_pixels(spark, *images), template, 4, 3).collect()}
    for y in range(10):
        for x in range(12):
            box = images[0][y : y + 3, x : x + 4]
            assert got[0, x, y] == pytest.approx(np.corrcoef(box.ravel(), part.ravel())[0, 1], abs=1e-9)
    assert got[0, 5, 4] == pytest.approx(1) and all(v == 0 for (k, _, _), v in got.items() if k) and len(got) == 120 + 12


@pytest.mark.parametrize("dims, k", [(2, 5), (4, 3), (1, 4)])
def test_nearest_rows_equal_brute_force(spark, dims, k):
    rng = np.random.default_rng(7)
    b = np.concatenate([rng.random((150, dims)), 0.3 + rng.normal(0, 0.002, (150, dims)), np.repeat(rng.random((1, dims)), 60, axis=0), [[9.0] * dims]])
    a = np.concatenate([rng.random((40, dims)) * 1.3 - 0.1, b[:10], b[-70:-55], [[-5.0] * dims]])
    names = [f"q{i}" for i in range(dims)]
    schema = "scene string, id long, " + ", ".join(f"{n} double" for n in names)
    rows = lambda m, scenes: [(s, i, *map(float, r)) for s in scenes for i, r in enumerate(m)]
    found = nearest_rows(spark.createDataFrame([*rows(a, "xy"), ("x", 999, *[None] * dims)], schema), spark.createDataFrame(rows(b, "x") + rows(b[:2], "y"), schema), names, k, keys=("scene",))
    got = sorted((r.scene, r.a_id, r.k, r.b_id) for r in found.collect())
    want = []
    for s, other in (("x", b), ("y", b[:2])):
        for i, p in enumerate(a):
            d = np.round(np.sqrt(((other - p) ** 2).sum(axis=1)), 9)
            want += [(s, i, n + 1, int(j)) for n, j in enumerate(np.lexsort((np.arange(len(other)), d))[:k])]
    assert got == sorted(want)
    assert nearest_rows(found.select(F.col("a_id").alias("id"), F.col("d").alias("q")), found.where("false").select(F.col("b_id").alias("id"), F.col("d").alias("q")), ["q"], 2).collect() == []


def test_nearest_rows_take_more_tasks_as_rows_grow(spark, monkeypatch):
    """What a task holds does not grow with the rows: twice as many are dealt to as many tasks more, also where most look at the same few wide cubes."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(nearest, "ROWS", 100, raising=False)
    tasks = []
    for n in (150, 600):
        b = np.concatenate([rng.random((n - 3, 2)) * 0.01, [[9.0, 9.0], [-9.0, 9.0], [9.0, -9.0]]])
        a = np.concatenate([rng.random((n // 2, 2)) * 0.01, rng.random((n // 2, 2)) * 18 - 9])
        frame = lambda m: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "id long, u double, v double")
        found = nearest_rows(frame(a), frame(b), ["u", "v"], 4)
        d = np.round(np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)), 9)
        assert sorted((r.a_id, r.k, r.b_id) for r in found.collect()) == [(i, n + 1, int(j)) for i in range(len(a)) for n, j in enumerate(np.lexsort((np.arange(len(b)), d[i]))[:4])]
        tasks.append(found.rdd.getNumPartitions())
    assert tasks[0] > 4 and tasks[1] >= 3 * tasks[0]


def test_running_sums_shares_and_lines(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), i, float(rng.randrange(50)), i % 3 == 0) for i in range(500)] + [(None, 900, 1.0, True), (None, 901, 0.5, False)]
    df = spark.createDataFrame(rows, "kind string, id int, v double, s boolean").repartition(6)
    got = {r.id: r.share for r in analysis.share_below(df, ["kind"], "v", F.col("s")).collect()}
    for kind, i, v, _ in rows:
        ref = [w for k, _, w, s in rows if k == kind and s]
        assert got[i] == pytest.approx(sum(w < v for w in ref) / len(ref))
    breaks = [("a", 10.0, 1.0), ("a", 20.0, 5.0), ("a", 20.5, 0.0), ("b", 30.0, 2.0), ("a", None, 3.0)]
    line = analysis.interpolated(df.select("kind", "id", "v"), spark.createDataFrame(breaks, "kind string, v double, y double"), ["kind"], "v", "y")
    for r in line.collect():
        want = np.interp(r.v, [10, 20, 20.5], [1, 5, 0]) if r.kind == "a" else 2.0 if r.kind == "b" else None
        assert r.interpolated == (want if want is None else pytest.approx(want))
    assert line.count() == len(rows)


def test_fits_of_points_on_a_line_or_in_a_place(spark):
    rng = np.random.default_rng(9)
    groups = {
        "line": (np.outer(np.arange(6.0), [2.0, 1.0]) + [3, -7], rng.normal(size=(6, 2)) * 9), "place": (np.full((4, 2), 2.5), rng.normal(size=(4, 2))), "upright": (np.column_stack([np.full(5, 4.0), np.arange(5.0)]), rng.normal(size=(5, 2))),
        "plane": (rng.normal(size=(7, 2)), rng.normal(size=(7, 2))), "two": (np.array([[0.0, 0.0], [3.0, 4.0]]), np.array([[1.0, 1.0], [2.0, 9.0]])), "zero": (np.zeros((3, 2)), rng.normal(size=(3, 2))),
    }
    rows = [(name, *map(float, s), *map(float, t)) for name, (src, dst) in groups.items() for s, t in zip(src, dst)]
    got = {r.g: r for r in geometry.affine_fit(spark.createDataFrame(rows, "g string, sx double, sy double, tx double, ty double"), ["g"]).collect()}
    for name, (src, dst) in groups.items():
        m = np.linalg.lstsq(np.c_[src, np.ones(len(src))], dst, rcond=None)[0]
        r = got[name]
        assert np.allclose([[r.a, r.c], [r.b, r.d], [r.e, r.f]], m, atol=1e-8), name


def test_table_functions(spark):
    rows = spark.createDataFrame([(k, i, 3) for k in ("a", "b") for i in (5, 1, 3, 8, None)[: 5 if k == "a" else 2]], "key string, id long, size int")
    got = sorted((r.key, tuple(r.ids)) for r in grids.combinations(rows).collect())
    assert got == [("a", c) for c in itertools.combinations((1, 3, 5, 8), 3)]
    bank = grids.bank(rows.select("key").distinct()).collect()
    assert len(bank) == 240 and {r.scale for r in bank if r.pose == 0} == {1.0} and len({(r.key, r.scale, r.angle) for r in bank}) == 240


def test_record_source(spark, tmp_path):
    records.register(spark)
    path = str(tmp_path / "out")
    df = spark.range(50).selectExpr("id", "concat('n', id) AS name", "CASE WHEN id % 7 = 0 THEN NULL ELSE id / 4 END AS v", "struct(id AS a, array(id) AS b) AS s").repartition(4)
    df.write.format("records").option("path", path).mode("append").save()
    back = spark.read.format("records").option("path", path).load()
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert back.rdd.getNumPartitions() == 4
    state = json.load(open(f"{path}/_manifest.json"))
    assert state["status"] == "complete" and state["rows"] == 50 and sorted(os.listdir(path)) == sorted(["_manifest.json", "_waiting", *(f["name"] for f in state["files"])])
    # a write of which a task fails leaves nothing behind, and readers see the old rows
    bad = df.withColumn("v", F.when(F.col("id") == 33, float("nan")).otherwise(F.col("v")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="NaN"):
            bad.write.format("records").option("path", path).mode(mode).save()
        assert json.load(open(f"{path}/_manifest.json")) == state and os.listdir(f"{path}/_waiting") == [] and spark.read.format("records").option("path", path).load().count() == 50
    df.limit(3).write.format("records").option("path", path).mode("append").save()
    assert spark.read.format("records").option("path", path).load().count() == 53
    df.limit(5).write.format("records").option("path", path).mode("overwrite").save()
    assert spark.read.format("records").option("path", path).load().count() == 5 and len(os.listdir(path)) == 2 + len(json.load(open(f"{path}/_manifest.json"))["files"])
    # a file that changed is refused
    name = json.load(open(f"{path}/_manifest.json"))["files"][0]["name"]
    open(f"{path}/{name}", "a").write("{}\n")
    with pytest.raises(Exception, match="not what was committed"):
        spark.read.format("records").option("path", path).load().collect()
    with pytest.raises(Exception, match="nothing was committed"):
        spark.read.format("records").option("path", str(tmp_path / "none")).load()


def test_record_source_as_csv(spark, tmp_path):
    records.register(spark)
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([("s1", "(1,2,0)", None), ("s,2", None, "x\"y")], "Id string, patch_02 string, patch_01 string")
    df.write.format("records").option("path", path).option("form", "csv").option("columns", "Id,patch_01,patch_02").option("empty", "-1").mode("append").save()
    back = spark.read.format("records").option("path", path).option("empty", "-1").load()
    assert back.columns == ["Id", "patch_01", "patch_02"]
    assert sorted(map(tuple, back.collect())) == [("s,2", "x\"y", None), ("s1", None, "(1,2,0)")]


def test_lines_are_read_in_one_pass_each_way(spark):
    """A frame that ends with its partition is computed anew for every row: the square of a range's rows."""
    rows = spark.range(1000).selectExpr("'a' AS kind", "id", "cast(id AS double) AS v")
    line = analysis.interpolated(rows.select("kind", "id"), rows.where("id % 41 = 7").select("kind", "id", F.col("v").alias("y")), ["kind"], "id", "y")
    assert "unboundedfollowing" not in line._jdf.queryExecution().toString().lower()
    assert {r.id: r.interpolated for r in line.collect()} == {i: pytest.approx(min(max(float(i), 7.0), 991.0)) for i in range(1000)}


@pytest.mark.parametrize("held", [7, 2048])
def test_theil_sen_equals_all_pairs(spark, monkeypatch, held):
    """Groups of an even and an odd number of pairs, equal slopes, equal x, nulls; one without pairs and one of under six rows."""
    monkeypatch.setattr(slopes, "HELD", held)
    monkeypatch.setattr(slopes, "SLICE", 3)
    rng = random.Random(12)
    rows = [("odd", i, rng.random(), rng.random()) for i in range(43)] + [("even", i, float(rng.randrange(6)), float(rng.randrange(-9, 9))) for i in range(40)]
    rows += [("upright", i, 1.0, float(i)) for i in range(8)] + [("few", i, float(i), 0.0) for i in range(5)] + [("odd", 99, None, 1.0)]
    got = {r.g: r for r in slopes.theil_sen(spark.createDataFrame(rows, "g string, id int, x double, y double"), ["g"]).collect()}
    assert set(got) == {"odd", "even"}
    for g, r in got.items():
        own = [(x, y) for k, _, x, y in rows if k == g and x is not None]
        slope = np.median([(d - b) / (c - a) for (a, b), (c, d) in itertools.combinations(own, 2) if a != c])
        assert r.slope == pytest.approx(slope, abs=1e-12) and r.intercept == pytest.approx(np.median([y - slope * x for x, y in own])) and r.n == sum(k == g for k, *_ in rows)


def test_theil_sen_gathers_no_slopes(spark):
    """No aggregate over the pairs keeps their values: what is counted are digits."""
    rows = spark.range(60).selectExpr("1 AS g", "id", "cast(id AS double) AS x", "cast(id * id % 37 AS double) AS y")
    assert "median" not in slopes.theil_sen(rows, ["g"])._jdf.queryExecution().toString().lower()


def test_points_in_one_place_are_matched_at_once(spark, monkeypatch):
    """Crowded places on a lattice, where many distances are equal: the pairs are those of going one by one, and rounds do not follow the number of points in a place."""
    rng = random.Random(13)
    points = lambda first: [(s, first + 2 * i, float(rng.randrange(5) * 3), float(rng.randrange(4) * 4)) for s in (1, 2) for i in rng.sample(range(60), 40)]
    left, right = points(0), points(1)
    schema = "scene int, id long, x double, y double"
    got = sorted(tuple(r) for r in geometry.assigned(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["scene"], 6.0).collect())
    want = []
    for s in (1, 2):
        used: set = set()
        for d, i, j in sorted((float(np.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2)), a[1], b[1]) for a in left for b in right if a[0] == b[0] == s):
            if d < 6 and not used & {i, j}:
                used |= {i, j}
                want.append((s, i, j, d))
    assert got == sorted(want)
    calls = []
    monkeypatch.setattr(rounds, "checkpointed", lambda df, keep=rounds.checkpointed: calls.append(1) or keep(df))
    crowd = spark.range(3000).selectExpr("1 AS scene", "id", "cast(id % 2 * 100 AS double) AS x", "0.0 AS y")
    r = scoring.greedy_recovery(crowd, crowd.withColumn("x", F.col("x") + 5), ["scene"]).collect()
    assert [(x.n_figure, x.recovery) for x in r] == [(3000, 1.0)] and len(calls) < 8


def test_quantiles_leave_large_groups_where_they_are(spark):
    """The bounds of a few groups are sent to the rows; these are not shuffled by their group, which would put a large one into one task."""
    from sparquill.operators.analysis import exact_quantiles

    rows = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 777).cast("double").alias("v"))
    found = exact_quantiles(rows, ["g"], "v", {"p50": 0.5})
    assert {r.g: r.p50 for r in found.collect()} == {g: float(np.quantile([i % 777 for i in range(g, 20_000, 2)], 0.5)) for g in (0, 1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_nearest_vectors_hold_few_queries_at_once(spark, monkeypatch):
    """Slices of a task's queries, and variants that a slice must keep together, change no row."""
    from sparquill.operators import analysis

    rng = np.random.default_rng(6)
    own = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-3, 4, (150, 6)))], "vec_id long, embedding array<double>")
    asked = own.where("vec_id < 40").select((F.col("vec_id") % 17).alias("query"), "embedding")
    v = {r.vec_id: np.array(r.embedding) for r in own.collect()}
    want = set()
    for query in range(17):
        score = {i: max(v[j] @ x for j in range(40) if j % 17 == query) for i, x in v.items()}
        want |= {(query, n + 1, i) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5])}
    for at_once in (64, 3):
        monkeypatch.setattr(analysis, "AT_ONCE", at_once)
        assert {(r.query, r.rank, r.id) for r in analysis.nearest_vectors(own, asked, 5).collect()} == want


def test_the_stage_trace_suppresses_once(spark, monkeypatch):
    from sparquill.plans import scoring_plans

    calls, real = [], scoring_plans.suppressed
    monkeypatch.setattr(scoring_plans, "suppressed", lambda *a: calls.append(a) or real(*a))
    scoring_plans.c18(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_peaks_look_at_the_raster_once(spark, monkeypatch):
    """Equal values, ramps, whose greatest pixels are few, flat, null and NaN pixels, keys that are null: the peaks of going one by one, from one pass over the raster."""
    rng = np.random.default_rng(31)
    images = {1: rng.integers(0, 4, (9, 11)).astype(float), 2: np.add.outer(np.arange(9.0), np.arange(11.0)), 3: np.zeros((9, 11)), None: rng.random((9, 11))}
    images[1][2, 3] = images[None][4, 4] = np.nan
    rows = [(k, x, y, None if (x, y) == (5, 5) else float(v[y, x])) for k, v in images.items() for y in range(9) for x in range(11)]
    passes, own = [], raster.sliding_max
    monkeypatch.setattr(raster, "sliding_max", lambda *args, **more: passes.append(1) or own(*args, **more))
    got = sorted((str(r.image), r["rank"], r.x, r.y, r.v) for r in raster.peaks(spark.createDataFrame(rows, "image long, x long, y long, v double"), 2, 4).collect())
    want = []
    for k in images:
        left = sorted((-v, y, x) for i, x, y, v in rows if i == k and v is not None and v == v)
        for rank in range(1, 5):
            if left:
                v, y, x = left[0]
                want.append((str(k), rank, x, y, -v))
                left = [p for p in left if abs(p[1] - y) > 2 or abs(p[2] - x) > 2]
    assert got == sorted(want) and len(passes) == 1


def test_samples_of_a_picture_stay_where_they_are(spark, tmp_path):
    """No shuffle is by pose: a picture's samples, many times its pixels, are summed and compared in the task that has its pixels."""
    rng = np.random.default_rng(32)
    vectors = [(i, i % 3, [float(v) for v in rng.random(64)]) for i in range(12)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = raster_plans.k10(spark, str(tmp_path))
    assert found.count() == 12
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(vec_id" in plan or "hashpartitioning(picture" in plan
    assert not re.search(r"hashpartitioning\(picture#\d+L?, (label#\d+, )?pose", plan)
