"""Point patterns: groups, triangles, quads, transforms and assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance
from ..sources.tables import checkpointed
from .rounds import first_kept
from .scoring import matched_points, range_pairs

SPREAD = 32  # keys that a scene's combinations are spread over


def grouped(points: DataFrame, radius: float) -> DataFrame:
    """(scene, id, anchor): each point of a scene, in order of id, joins the nearest earlier anchor within ``radius`` (strictly), ties by id, or becomes one.

    Anchors do not move, so the relation is not transitive. Which points are anchors is settled in rounds over the pairs within the radius.
    """
    own = points.select("scene", "id", "x", "y")
    near = checkpointed(range_pairs(own, own, ["scene"], radius).where("l_id < r_id").select("scene", F.col("l_id").alias("first"), F.col("r_id").alias("second"), "d"))
    heads = first_kept(own, ["scene"], near)
    joined = near.join(heads.withColumnRenamed("id", "first"), ["scene", "first"], "left_semi").join(heads.withColumnRenamed("id", "second"), ["scene", "second"], "left_anti")
    members = joined.groupBy("scene", "second").agg(F.min(F.struct("d", "first")).alias("m")).select("scene", F.col("second").alias("id"), F.col("m.first").alias("anchor"))
    return members.unionByName(heads.withColumn("anchor", F.col("id")))


def capped(points: DataFrame, cap: int, by: str, descending: bool = False) -> DataFrame:
    """The ``cap`` first points of each scene by a column, ties by id: what the combinations below are made of."""
    w = Window.partitionBy("scene").orderBy(F.desc(by) if descending else F.asc(by), "id")
    return points.withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap).drop("k")


def combinations(points: DataFrame, k: int, spread: int = SPREAD) -> DataFrame:
    """All k of a scene's points in order of id, as columns aid, ax, ay, bid, ... A scene is spread over ``spread`` keys by its first points; the others are
    copied to each key, and stay points until the joins make combinations of them."""
    named = lambda c: points.select("scene", *(F.col(x).alias(f"{c}{x}") for x in ("id", "x", "y")))
    parts = max(spread, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = named("a").withColumn("salt", F.pmod(F.xxhash64("aid"), F.lit(spread)).cast("int")).repartition(parts, "scene", "salt")
    for last, c in zip("abcd", "bcd"[: k - 1], strict=False):
        copies = named(c).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        rows = rows.join(copies, ["scene", "salt"]).where(F.col(f"{last}id") < F.col(f"{c}id"))
    return rows.drop("salt")


def triangles(points: DataFrame) -> DataFrame:
    """(scene, ids, u, v): triangles with the vertices in the order of the opposite edges, and the ratios of the two shorter edges
    to the longest. Degenerate ones are left out: a shortest edge up to 1e-5, or an area's double up to .02 of the longest
    edge's square. Points must be capped: a scene of n makes n^3/6 of them."""
    three = combinations(points, 3)
    d = lambda p, q: distance(F.col(f"{p}x"), F.col(f"{p}y"), F.col(f"{q}x"), F.col(f"{q}y"))
    edges = F.array_sort(F.array(*(F.struct(d(p, q).alias("d"), F.lit(i).alias("i"), F.col(f"{o}id").alias("id")) for i, (o, p, q) in enumerate(("abc", "bca", "cab")))))
    cross = F.abs((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax")))
    # as a generated column the edges are computed once; a filter on a plain one would be pushed down with its expression
    made = three.select("scene", F.explode(F.array(F.struct(edges.alias("e"), cross.alias("cross")))).alias("m")).select("scene", "m.e", "m.cross")
    made = made.where((F.col("e")[0]["d"] > 1e-5) & (F.col("cross") > 0.02 * F.col("e")[2]["d"] * F.col("e")[2]["d"]))
    longest = F.col("e")[2]["d"]
    return made.select("scene", *(F.col("e")[i]["id"].alias(f"id{i}") for i in range(3)), (F.col("e")[0]["d"] / longest).alias("u"), (F.col("e")[1]["d"] / longest).alias("v"))


def quads(points: DataFrame) -> DataFrame:
    """(scene, ids, q): four points with the sorted shares of the areas that each three of them span, signs alternating so
    that an affine map keeps them, fixed by the largest. Degenerate ones are left out: a share up to .015 or two shares within .002."""
    four = combinations(points, 4)

    def area(p: str, q: str, r: str) -> Column:
        g = F.col
        return (g(f"{q}x") - g(f"{p}x")) * (g(f"{r}y") - g(f"{p}y")) - (g(f"{q}y") - g(f"{p}y")) * (g(f"{r}x") - g(f"{p}x"))

    signed = [area("b", "c", "d"), -area("a", "c", "d"), area("a", "b", "d"), -area("a", "b", "c")]
    # plain columns in steps, each computed once a row and none in a lambda, which would leave generated code
    step = four.select("scene", *(F.col(f"{p}id") for p in "abcd"), *(s.alias(f"s{i}") for i, s in enumerate(signed)))
    size = [F.abs(f"s{i}") for i in range(4)]
    most = F.greatest(*size)
    sign = F.when(size[0] == most, F.signum("s0")).when(size[1] == most, F.signum("s1")).when(size[2] == most, F.signum("s2")).otherwise(F.signum("s3"))
    scale = sign / F.nullif(size[0] + size[1] + size[2] + size[3], F.lit(0.0))
    pair = F.array_sort(F.array(*(F.struct((F.col(f"s{i}") * scale).alias("q"), F.col(f"{p}id").alias("id")) for i, p in enumerate("abcd"))))
    rows = step.select("scene", F.explode(F.array(F.struct(pair.alias("q")))).alias("m")).select("scene", F.col("m.q").alias("q")).select("scene", *(F.col("q")[i]["q"].alias(f"q{i}") for i in range(4)), *(F.col("q")[i]["id"].alias(f"id{i}") for i in range(4)))
    least = F.least(*(F.abs(f"q{i}") for i in range(4)))
    gap = F.least(*(F.col(f"q{i + 1}") - F.col(f"q{i}") for i in range(3)))
    return rows.where((least > 0.015) & (gap > 0.002)).select("scene", *(f"id{i}" for i in range(4)), *(f"q{i}" for i in range(4)))


def assigned(nodes: DataFrame, pool: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, i, j, d): nodes met with pool points nearer than ``tolerance``, one to one, nearest first."""
    pairs = matched_points(nodes, pool, keys, tolerance)
    return pairs.select(*keys, F.col("l_id").alias("i"), F.col("r_id").alias("j"), "d")


def affine_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares affine map of (sx, sy) to (tx, ty) for each group, from sums alone. Where the sources lie on a line or in a place, many maps fit as well;
    it is the one of least norm (of all six numbers), as from the pseudo-inverse.

    On a line through the mean m with unit direction u, every best map takes u (the eigenvector of the sources' covariance) to g = cov(u, t) / var and m to the targets' mean; what is free is
    what the perpendicular w goes to, and the shift with it. The least norm has w go to p (mean - g (u . m)) / (1 + p^2), where p = w . m; the same
    with both directions free in a place. Singular is a determinant of up to 1e-12 of the squared spread.
    """
    names = ("sx", "sy", "tx", "ty")
    mean = {f"m_{c}": F.avg(c) for c in names}
    sums = pairs.groupBy(*keys).agg(F.count("*").alias("n"), *(v.alias(k) for k, v in mean.items()), *(F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in (("sx", "sx"), ("sx", "sy"), ("sy", "sy"), ("sx", "tx"), ("sy", "tx"), ("sx", "ty"), ("sy", "ty"))))
    g = F.col
    det, spread = g("sx_sx") * g("sy_sy") - g("sx_sy") * g("sx_sy"), g("sx_sx") + g("sy_sy")
    scale = g("m_sx") * g("m_sx") + g("m_sy") * g("m_sy")
    kind = F.when(spread <= 1e-24 * scale + 1e-300, "place").when(det <= 1e-12 * spread * spread, "line").otherwise("plane")
    # unit direction of the greater eigenvalue, from half the angle of the covariance
    turn = F.atan2(2 * g("sx_sy"), g("sx_sx") - g("sy_sy")) / 2
    rows = sums.withColumns({"__kind": kind, "__det": det, "__ux": F.cos(turn), "__uy": F.sin(turn)})
    var = g("__ux") * g("__ux") * g("sx_sx") + 2 * g("__ux") * g("__uy") * g("sx_sy") + g("__uy") * g("__uy") * g("sy_sy")
    along, aside = g("__ux") * g("m_sx") + g("__uy") * g("m_sy"), -g("__uy") * g("m_sx") + g("__ux") * g("m_sy")

    def solve(t: str) -> tuple[Column, Column]:
        gain = (g("__ux") * g(f"sx_{t}") + g("__uy") * g(f"sy_{t}")) / var
        free = aside * (g(f"m_{t}") - gain * along) / (1 + aside * aside)
        share = g(f"m_{t}") / (1 + scale)
        plane = (g(f"sx_{t}") * g("sy_sy") - g(f"sy_{t}") * g("sx_sy")) / g("__det"), (g(f"sy_{t}") * g("sx_sx") - g(f"sx_{t}") * g("sx_sy")) / g("__det")
        line = gain * g("__ux") - free * g("__uy"), gain * g("__uy") + free * g("__ux")
        place = share * g("m_sx"), share * g("m_sy")
        return tuple(F.when(g("__kind") == "plane", p).when(g("__kind") == "line", q).otherwise(r) for p, q, r in zip(plane, line, place, strict=True))

    (a, b), (c, d) = solve("tx"), solve("ty")
    out = rows.select(*keys, "n", *mean, a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    return out.select(*keys, "n", "a", "b", "c", "d", (g("m_tx") - g("a") * g("m_sx") - g("b") * g("m_sy")).alias("e"), (g("m_ty") - g("c") * g("m_sx") - g("d") * g("m_sy")).alias("f"))


def similarity_fit(pairs: DataFrame, keys: list[str], mirrored: bool = False) -> DataFrame:
    """Least-squares rotation and scale (c, s), and shift (e, f), of each group, and the squares ``left``; of mirrored sources (-sx) if asked."""
    p = pairs.withColumn("sx", -F.col("sx")) if mirrored else pairs
    cov = lambda a, b: F.covar_pop(a, b)
    spread = cov("sx", "sx") + cov("sy", "sy")
    along, across = cov("sx", "tx") + cov("sy", "ty"), cov("sx", "ty") - cov("sy", "tx")
    left = cov("tx", "tx") + cov("ty", "ty") - (along * along + across * across) / F.nullif(spread, F.lit(0.0))
    out = p.groupBy(*keys).agg(F.count("*").alias("n"), (along / F.nullif(spread, F.lit(0.0))).alias("c"), (across / F.nullif(spread, F.lit(0.0))).alias("s"), left.alias("left"), *(F.avg(x).alias(f"m_{x}") for x in ("sx", "sy", "tx", "ty")))
    g = F.col
    return out.select(*keys, "n", "c", "s", "left", (g("m_tx") - g("c") * g("m_sx") + g("s") * g("m_sy")).alias("e"), (g("m_ty") - g("s") * g("m_sx") - g("c") * g("m_sy")).alias("f"))


def best_similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The similarity of each group that leaves less, of the sources or of their mirror image; of equals, to a millionth, the plain one."""
    both = similarity_fit(pairs, keys).withColumn("mirrored", F.lit(False)).unionByName(similarity_fit(pairs, keys, True).withColumn("mirrored", F.lit(True)))
    order = Window.partitionBy(*keys).orderBy(F.round("left", 6), "mirrored")
    return both.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def three_point_affine(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The affine map through three pairs, by Cramer's rule: what ``affine_fit`` gives where each group has three."""
    return affine_fit(pairs, keys).where("n = 3")


def normalised(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points less their group's mean, each axis divided by its own range (1e-6 at least). A group's figures come from partial sums, so a large group is no large task."""
    axes = ("x", "y")
    figures = points.groupBy(*keys).agg(*(F.avg(c).alias(f"m_{c}") for c in axes), *(F.greatest(F.lit(1e-6), F.max(c) - F.min(c)).alias(f"r_{c}") for c in axes))
    rows = points.join(figures, keys).withColumns({f"n{c}": (F.col(c) - F.col(f"m_{c}")) / F.col(f"r_{c}") for c in axes})
    return rows.drop(*(f"{k}_{c}" for k in "mr" for c in axes))
