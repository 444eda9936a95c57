"""Fits of a catalog's patterns to scenes as a table of seeds.

A seed is a pattern's triangle or quad on one of the scene's nearest in shape. Its map is a column expression; its pairs are a range join of the mapped nodes with the
scene's pool, made one to one in rounds; its refits are grouped sums over the pairs. All seeds of all scenes and classes go through a step together, and
those that are settled leave. Nothing is gathered by scene or class but the pairs of the fit that wins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hypothesis_score, shear, singular_values, surprise, valid_transform
from ..functions.patterns import NOTHING, Options
from ..sources.tables import checkpointed
from .geometry import affine_fit, best_similarity, normalised, quads, triangles
from .nearest import nearest_rows
from .rounds import one_to_one
from .scoring import range_pairs

#: Scene triangles and quads met by each of a pattern's, the reach of the first assignment.
TRIANGLES_MET, QUADS_MET, FIRST_REACH = 20, 4, 24.0
SMALL_POOL = 200_000  # points that may be broadcast
MAP = list("abcdef")


def _total(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0])


def seed_map(model: str, own: list[tuple[Column, Column]], there: list[tuple[Column, Column]]) -> dict[str, Column]:
    """The least-squares map of a few places onto others as columns a to f (u = a x + b y + e, v = c x + d y + f); null where the places lie on a line, or in one for a similarity."""
    n = len(own)
    mean = lambda pts, i: _total([p[i] for p in pts]) / n
    mx, my, mu, mv = mean(own, 0), mean(own, 1), mean(there, 0), mean(there, 1)
    s, t = [(x - mx, y - my) for x, y in own], [(u - mu, v - mv) for u, v in there]
    cov = lambda p, i, q, j: _total([a[i] * b[j] for a, b in zip(p, q, strict=True)])
    xx, xy, yy = cov(s, 0, s, 0), cov(s, 0, s, 1), cov(s, 1, s, 1)
    ux, uy, vx, vy = cov(s, 0, t, 0), cov(s, 1, t, 0), cov(s, 0, t, 1), cov(s, 1, t, 1)
    if model == "affine":
        det = xx * yy - xy * xy
        det = F.when(F.abs(det) > 1e-12, det)
        a, b, c, d = (ux * yy - uy * xy) / det, (uy * xx - ux * xy) / det, (vx * yy - vy * xy) / det, (vy * xx - vx * xy) / det
    else:
        spread = F.when(xx + yy > 1e-12, xx + yy)
        plain, mirrored = ((ux + vy) / spread, (vx - uy) / spread), ((-ux + vy) / spread, (-vx - uy) / spread)
        # what is left is the targets' spread less the square of what is explained
        turned = (ux + vy) * (ux + vy) + (vx - uy) * (vx - uy) >= (vy - ux) * (vy - ux) + (vx + uy) * (vx + uy)
        a, c = F.when(turned, plain[0]).otherwise(-mirrored[0]), F.when(turned, plain[1]).otherwise(-mirrored[1])
        b, d = F.when(turned, -plain[1]).otherwise(-mirrored[1]), F.when(turned, plain[0]).otherwise(mirrored[0])
    return {"a": a, "b": b, "c": c, "d": d, "e": mu - a * mx - b * my, "f": mv - c * mx - d * my}


def refit(pairs: DataFrame, model: str) -> DataFrame:
    """(seed, a to f): the map that each seed's pairs (sx, sy, tx, ty) give."""
    if model == "affine":
        return affine_fit(pairs, ["seed"]).select("seed", *MAP)
    m = best_similarity(pairs, ["seed"])
    side = F.when(F.col("mirrored"), -1.0).otherwise(1.0)
    return m.select("seed", (side * F.col("c")).alias("a"), (-F.col("s")).alias("b"), (side * F.col("s")).alias("c"), F.col("c").alias("d"), "e", "f")


def usable(checked: bool = True) -> Column:
    """Whether a row's map is neither tiny, huge nor very uneven; unchecked, whether it is a map of the plane at all."""
    m = [F.col(c) for c in "acbd"]
    return F.coalesce(valid_transform(*m) if checked else singular_values(*m)[1] > 1e-6, F.lit(False))


def _shapes(points: DataFrame, kind: str, as_id: str) -> DataFrame:
    """(scene, as_id, dims): triangles or quads of points (scene, id, x, y) with a struct of their vertices as id."""
    made, n, dims = (triangles(points), 3, ["u", "v"]) if kind == "triangle" else (quads(points), 4, [f"q{i}" for i in range(4)])
    return made.select("scene", F.struct(*(f"id{i}" for i in range(n))).alias(as_id), *dims)


def _seeds(kind: str, own: DataFrame, scene: DataFrame, classes: DataFrame) -> DataFrame:
    """(scene, name, kind, own, there, ord): each pattern shape on the scene shapes nearest to it, in order of distance. ``classes``: (scene, name) that are tried."""
    dims, k = (["u", "v"], TRIANGLES_MET) if kind == "triangle" else ([f"q{i}" for i in range(4)], QUADS_MET)
    a = own.withColumnRenamed("scene", "name").join(classes, "name").select("scene", F.struct("name", "shape").alias("id"), *dims)
    met = nearest_rows(a, scene.withColumnRenamed("shape", "id"), dims, k, keys=("scene",))
    order = Window.partitionBy("scene", "a_id.name").orderBy(F.round("d", 9), "a_id", "b_id")
    return met.select("scene", F.col("a_id.name").alias("name"), F.lit(kind).alias("kind"), F.col("a_id.shape").alias("own"), F.col("b_id").alias("there"), F.row_number().over(order).alias("ord"))


def fitted(pool: DataFrame, making: DataFrame, catalog: DataFrame, budget: int, o: Options, auxiliary: DataFrame | None = None) -> DataFrame:
    """One row a scene and class: the best fit, or why there is none. Columns as in ``recognition.hypotheses``.

    ``pool``: (scene, grp, x, y, score, rank); ``making``: (scene, id, x, y), the capped points that make seeds; ``catalog``: (name, node, x, y), node from 0;
    ``auxiliary``: (scene, x, y, v), a map's pixels. Scenes of under three making points, or without a pool, have no rows. Equal scores go by model, quads before triangles, then nearness of shape.
    """
    enough = making.groupBy("scene").agg(F.count("*").alias("n")).where("n >= 3").select("scene").join(pool.select("scene").distinct(), "scene")
    pool = checkpointed(pool.join(enough, "scene", "left_semi"))
    making = checkpointed(making.join(enough, "scene", "left_semi"))
    unit = checkpointed(normalised(catalog, ["name"]).select("name", "node", F.col("nx").alias("sx"), F.col("ny").alias("sy")))
    sizes = unit.groupBy("name").agg(F.count("*").cast("int").alias("nodes"))
    scenes = pool.groupBy("scene").agg(F.count("*").alias("n_points"), F.count_distinct("grp").alias("n_groups"))
    classes = checkpointed(scenes.crossJoin(sizes))  # every class is tried in every scene; both are one row each
    tried = classes.where("nodes >= 3").select("scene", "name")
    shape_points = unit.select(F.col("name").alias("scene"), F.col("node").alias("id"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    own, scene_own = ({k: _shapes(df, k, "shape") for k in ("triangle", "quad")} for df in (shape_points, making))
    # how many triangles a class could seed says whether its quads are wanted
    counts = lambda df, name: df.groupBy("scene").agg(F.count("*").alias(name))
    there = counts(scene_own["triangle"], "n_there")
    every = tried.join(counts(own["triangle"], "n_own").withColumnRenamed("scene", "name"), "name", "left").join(there, "scene", "left").select(
        "scene", "name", (F.coalesce("n_own", F.lit(0)) * F.least(F.coalesce("n_there", F.lit(0)), F.lit(TRIANGLES_MET))).alias("every"))
    every = checkpointed(every)
    wants_quads = (every if o.quad_share else every.where(F.col("every") < budget)).select("scene", "name")
    quad_seeds = checkpointed(_seeds("quad", own["quad"], scene_own["quad"], wants_quads)) if not wants_quads.isEmpty() else None
    limits = every.withColumn("n_quads", F.lit(0))
    if quad_seeds is not None:
        n = quad_seeds.groupBy("scene", "name").agg(F.count("*").alias("n_quads"))
        limits = every.join(n, ["scene", "name"], "left").withColumn("n_quads", F.coalesce("n_quads", F.lit(0)))
    share = F.least("n_quads", F.floor(F.lit(budget * o.quad_share)))
    limits = limits.withColumn("quads", F.least(F.col("n_quads"), F.lit(budget) - F.least(F.col("every"), F.lit(budget) - share)))
    limits = limits.select(F.col("scene").alias("of"), F.col("name").alias("of_name"), "quads")
    within = lambda seeds, most: seeds.join(limits, (F.col("scene") == F.col("of")) & (F.col("name") == F.col("of_name"))).where(F.col("ord") <= most).drop("of", "of_name", "quads")
    corner = lambda n: lambda s: s.select("scene", "name", "kind", "ord", *(F.col(f"own.id{i}").alias(f"n{i}") for i in range(n)), *(F.col(f"there.id{i}").alias(f"p{i}") for i in range(n)))
    parts = [(corner(3)(within(_seeds("triangle", own["triangle"], scene_own["triangle"], tried), budget - F.col("quads"))), 3)]
    if quad_seeds is not None:
        parts.append((corner(4)(within(quad_seeds, F.col("quads"))), 4))
    # a class's nodes and a scene's making points as arrays: at most as many as the budget of points and the pattern have
    at = lambda df, key, i, x, y: df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(i, F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))).alias(f"at_{key}"))
    nodes_at, points_at = at(unit, "name", "node", "sx", "sy"), at(making, "scene", "id", "x", "y")
    maps = None
    for seeds, n in parts:
        placed = seeds.join(nodes_at, "name").join(points_at, "scene")
        place = lambda m, c: (F.col(m)[F.col(c)]["x"], F.col(m)[F.col(c)]["y"])
        corners = placed.select("scene", "name", "kind", "ord", *(v.alias(f"{m}{k}{i}") for i in range(n) for m, (x, y) in (("s", place("at_name", f"n{i}")), ("t", place("at_scene", f"p{i}"))) for k, v in (("x", x), ("y", y))))
        for j, model in enumerate(o.models):
            pts = lambda m: [(F.col(f"{m}x{i}"), F.col(f"{m}y{i}")) for i in range(n)]  # noqa: B023, E731
            made = corners.withColumns(seed_map(model, pts("s"), pts("t"))).select("scene", "name", F.lit(j).alias("model"), F.when(F.col("kind") == "quad", 0).otherwise(1).alias("kind"), "ord", *MAP)
            maps = made if maps is None else maps.unionByName(made)
    maps = checkpointed(maps.withColumn("seed", F.monotonically_increasing_id())).withColumn("good", usable())
    tally = maps.groupBy("scene", "name").agg((F.count("*") / len(o.models)).cast("int").alias("attempted"), F.count_if("good").cast("int").alias("accepted"))
    maps = maps.where("good").drop("good")

    small = pool.count() <= SMALL_POOL
    points = pool.select("scene", "grp", "x", "y", "score", "rank")

    def assigned(rows: DataFrame, reach: float) -> DataFrame:
        """(seed, node, grp, d, tx, ty, score, rank): the one-to-one pairs of each map's nodes with the pool's groups within ``reach``; seeds that cannot have enough are left out."""
        placed = rows.join(unit, "name").select("scene", "seed", "node", (F.col("a") * F.col("sx") + F.col("b") * F.col("sy") + F.col("e")).alias("x"), (F.col("c") * F.col("sx") + F.col("d") * F.col("sy") + F.col("f")).alias("y"))
        near = range_pairs(points, placed, ["scene"], reach, small=small)
        near = near.groupBy(F.col("r_seed").alias("seed"), F.col("r_node").alias("node"), F.col("l_grp").alias("grp")).agg(F.min(F.struct("d", F.col("l_rank").alias("rank"), F.col("l_x").alias("tx"), F.col("l_y").alias("ty"), F.col("l_score").alias("score"))).alias("m")).select("seed", "node", "grp", "m.*")
        near = checkpointed(near)
        hopeful = near.groupBy("seed").agg(F.count_distinct("node").alias("n")).where(F.col("n") >= o.least).select("seed")
        near = near.join(hopeful, "seed", "left_semi")
        return checkpointed(near.join(one_to_one(near, ["seed"], "node", "grp").select("seed", "node", "grp"), ["seed", "node", "grp"], "left_semi"))

    pairs = assigned(maps, max(o.tolerance, FIRST_REACH))
    of_pairs = lambda p: p.groupBy("seed").agg(F.count("*").alias("support"))
    going = of_pairs(pairs).where(F.col("support") >= o.least).select("seed")
    maps = checkpointed(maps.join(going, "seed", "left_semi"))
    pairs = pairs.join(going, "seed", "left_semi")
    active = maps.select("seed")
    for _ in range(o.refits):
        if active.isEmpty():
            break
        new = None
        for j, model in enumerate(o.models):
            own_pairs = pairs.join(active, "seed", "left_semi").join(maps.where(F.col("model") == j).select("seed", "name"), "seed").join(unit, ["name", "node"])
            made = refit(own_pairs, model)
            new = made if new is None else new.unionByName(made)
        new = checkpointed(new)  # before the filter, which the optimizer would rewrite in terms of the sums, over and over
        new = checkpointed(new.where(usable(o.checked)).join(maps.select("seed", "scene", "name", "model", "kind", "ord"), "seed"))
        fresh = assigned(new, o.tolerance)
        # a refit that is no usable map leaves the old map and pairs; one that is brings pairs of its own, of which too few end the fit
        maps = checkpointed(maps.join(new.select("seed"), "seed", "left_anti").unionByName(new.select(*maps.columns)))
        pairs = checkpointed(pairs.join(new.select("seed"), "seed", "left_anti").unionByName(fresh.select(*pairs.columns)))
        active = checkpointed(of_pairs(fresh).where(F.col("support") >= o.least).select("seed"))
    return _scored(classes, maps, pairs, unit, tally, budget, o, auxiliary)


def _scored(classes: DataFrame, maps: DataFrame, pairs: DataFrame, unit: DataFrame, tally: DataFrame, budget: int, o: Options, auxiliary: DataFrame | None) -> DataFrame:
    gain = math.log(o.tolerance**2 / (2 * o.sigma**2)) - F.col("d") * F.col("d") / (2 * o.sigma**2)
    sums = pairs.groupBy("seed").agg(
        F.count("*").cast("int").alias("support"), F.avg("d").alias("mean_residual"), F.avg("score").alias("appearance"), F.avg(F.col("rank").cast("double")).alias("rank_cost"), F.sum(gain).alias("gain"),
    ).where(F.col("support") >= o.least)
    fits = maps.join(sums, "seed").join(classes, ["scene", "name"]).withColumn("shear", F.coalesce(shear(*(F.col(c) for c in "acbd")), F.lit(0.0)))
    if o.score_mode == "likelihood":
        score = F.col("gain") - o.size_penalty * F.col("nodes")
    else:
        density = F.col("n_points" if o.null_mode.startswith("pool") else "n_groups")
        score = surprise(F.col("support"), F.col("nodes"), density, o.tolerance, o.least)
    residual = F.lit(0.0) if o.score_mode == "likelihood" else F.col("mean_residual")
    similar = F.col("model").isin([j for j, model in enumerate(o.models) if model == "similarity"])
    score = hypothesis_score(score, residual, F.col("shear"), F.col("appearance"), F.col("rank_cost"), similar, o.tolerance, o.shear_penalty, o.appearance_weight, o.rank_weight)
    where = lambda rows: rows.join(unit, "name").select("seed", "scene", "node", "sx", "sy", (F.col("a") * F.col("sx") + F.col("b") * F.col("sy") + F.col("e")).alias("x"), (F.col("c") * F.col("sx") + F.col("d") * F.col("sy") + F.col("f")).alias("y"))
    fits = checkpointed(fits.withColumn("score", score))
    fits = fits.withColumn("auxiliary", F.lit(0.5))
    if auxiliary is not None:
        # the mean of the map at the nodes without a partner: nothing outside, a half where every node has one; scenes without a map keep a half and their score
        lone = where(fits).join(pairs.select("seed", "node"), ["seed", "node"], "left_anti")
        pixels = auxiliary.select("scene", F.col("x").cast("long").alias("px"), F.col("y").cast("long").alias("py"), F.col("v").cast("double").alias("v"))
        floor = lambda c: F.when(F.col(c) >= 0, F.floor(c)).otherwise(-1)
        lone = lone.withColumns({"px": floor("x"), "py": floor("y")}).join(pixels, ["scene", "px", "py"], "left")
        seen = lone.groupBy("seed").agg(F.avg(F.coalesce("v", F.lit(0.0))).alias("evidence"))
        mapped = auxiliary.select("scene").distinct().withColumn("has_map", F.lit(True))
        fits = fits.join(seen, "seed", "left").join(mapped, "scene", "left").withColumn("auxiliary", F.when(F.col("has_map"), F.coalesce("evidence", F.lit(0.5))).otherwise(0.5)).drop("evidence", "has_map")
        fits = fits.withColumn("score", F.col("score") + o.aux_weight * (F.col("auxiliary") - 0.5))
    # scores are compared to nine digits, so that sums in another order do not decide
    order = Window.partitionBy("scene", "name").orderBy(F.desc(F.round("score", 9)), "model", "kind", "ord")
    best = checkpointed(fits.withColumn("k", F.row_number().over(order)).where("k = 1"))
    # arrays of the winners alone, as long as their patterns
    node = lambda x, y: F.sort_array(F.collect_list(F.struct(F.col("node").cast("int").alias("node"), F.col(x).alias("x"), F.col(y).alias("y"))))
    shown = where(best).groupBy("seed").agg(node("x", "y").alias("placed"), node("sx", "sy").alias("template"))
    own = pairs.join(best.select("seed"), "seed", "left_semi").groupBy("seed").agg(F.sort_array(F.collect_list(F.struct(F.col("node").cast("int").alias("node"), F.col("grp").cast("long").alias("grp"), F.col("tx").alias("x"), F.col("ty").alias("y"), "d"))).alias("pairs"))
    names = F.element_at(F.array(*map(F.lit, o.models)), F.col("model") + 1)
    won = best.join(shown, "seed").join(own, "seed").select(
        "scene", "name", "score", "support", names.alias("model"), "mean_residual", "shear", (F.col("support") / F.col("nodes")).alias("coverage"), "auxiliary", "appearance", "rank_cost",
        F.array(*(F.col(c) for c in "acbdef")).alias("matrix"), "template", "placed", "pairs",
    )
    rows = classes.select("scene", "name", "nodes").join(tally, ["scene", "name"], "left").join(won, ["scene", "name"], "left")
    attempted = F.coalesce("attempted", F.lit(0))
    reason = F.when(F.col("nodes") < 3, "pair-only ambiguity").when(attempted == 0, "no seeds").when(F.col("support").isNull(), "no verified fit")
    empty = lambda c: F.coalesce(c, F.array().cast(won.schema[c].dataType))
    return rows.select(
        "scene", "name", F.coalesce("score", F.lit(NOTHING)).alias("score"), F.coalesce("support", F.lit(0)).alias("support"), "nodes", reason.alias("reason"), "model", "mean_residual", "shear", "coverage", "auxiliary", "appearance", "rank_cost",
        attempted.alias("attempted"), F.coalesce("accepted", F.lit(0)).alias("accepted"), F.when(attempted > 0, attempted >= budget).alias("cap_hit"), "matrix", empty("template").alias("template"), empty("placed").alias("placed"), empty("pairs").alias("pairs"),
    )
