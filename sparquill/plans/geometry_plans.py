"""Queries on point patterns and joins."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import binomial_tail, boxes_overlap, distance, dot, hypothesis_score, keyed_uniform, likelihood, mean_centred, shear, singular_values, surprise, trimmed_mean, valid_transform
from ..functions.grids import bank
from ..functions.grids import combinations as combinations_of
from ..operators import relocation
from ..operators.analysis import exact_quantiles, nearest_vectors
from ..operators.geometry import affine_fit, assigned, best_similarity, capped, grouped, normalised, quads, three_point_affine, triangles
from ..operators.ranking import QUERY
from ..operators.scoring import range_pairs
from ..operators.shapes import shape_neighbours
from ..operators.slopes import theil_sen
from ..sources.tables import CAND, PTS, candidates, load, points

R = lambda c, n=6: F.round(c, n)
DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))"


#: Vectors kept of each query's search.
RETRIEVED = 1000


def j1(spark, sf):
    """The thousand vectors nearest to each query, by the best of its three variants: the vector, turned by one place and by two."""
    e = load(spark, sf, "embeddings").select("vec_id", "embedding")
    turned = lambda n: F.concat(F.slice("embedding", n + 1, 64), F.slice("embedding", 1, n)) if n else F.col("embedding")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.explode(F.array(*(turned(n) for n in range(3)))).alias("embedding"))
    return nearest_vectors(e, q, RETRIEVED)


J1_SQL = f"""WITH q AS (SELECT vec_id AS query, unnest([embedding, list_concat(embedding[2:], embedding[1:1]), list_concat(embedding[3:], embedding[1:2])]) AS v FROM embeddings WHERE vec_id % 50 = 0),
 s AS (SELECT query, vec_id AS id, max(round(list_sum(list_transform(list_zip(v, embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 9)) AS score FROM q, embeddings GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT query, rank, id, score FROM k WHERE rank <= {RETRIEVED}"""


def j4(spark, sf):
    p = points(spark, sf)
    return assigned(p.where("id % 3 = 0"), p.where("id % 3 <> 0"), ["scene"], 24.0).select("scene", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), R(F.col("d")).alias("d"))


J4_SQL = f"""WITH RECURSIVE {PTS}, pairs AS (SELECT a.scene, {DIST} AS d, a.id AS i, b.id AS j FROM pts a JOIN pts b ON a.scene = b.scene AND a.id % 3 = 0 AND b.id % 3 <> 0
 AND abs(a.x-b.x) < 24 AND abs(a.y-b.y) < 24), near AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY d, i, j) AS k FROM pairs WHERE d < 24),
 go AS (SELECT scene, 0 AS k, CAST([] AS STRUCT(i BIGINT, j BIGINT, d DOUBLE)[]) AS kept FROM (SELECT DISTINCT scene FROM pts)
 UNION ALL SELECT g.scene, g.k + 1, CASE WHEN len(list_filter(kept, lambda q: q.i = n.i OR q.j = n.j)) > 0 THEN kept ELSE list_append(kept, {{'i': n.i, 'j': n.j, 'd': n.d}}) END
 FROM go g JOIN near n ON g.scene = n.scene AND n.k = g.k + 1), f AS (SELECT scene, arg_max(kept, k) AS kept FROM go GROUP BY scene), u AS (SELECT scene, unnest(kept) AS q FROM f)
SELECT scene, q.i AS i, q.j AS j, round(q.d, 6) AS d FROM u"""


def j8(spark, sf):
    return grouped(points(spark, sf), 60.0)


J8_SQL = f"""WITH RECURSIVE {PTS}, o AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY id) AS k FROM pts),
 go AS (SELECT scene, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[]) AS anchors, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS anchor FROM (SELECT DISTINCT scene FROM pts)
 UNION ALL SELECT scene, k, CASE WHEN near IS NULL THEN list_append(anchors, {{'id': pid, 'x': x, 'y': y}}) ELSE anchors END, pid, coalesce(near, pid) FROM (
 SELECT g.scene, o.k, anchors, o.id AS pid, o.x, o.y, list_sort(list_filter(list_transform(anchors, lambda q: {{'d': sqrt((q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y)), 'id': q.id}}), lambda q: q.d < 60.0))[1].id AS near
 FROM go g JOIN o ON g.scene = o.scene AND o.k = g.k + 1))
SELECT scene, id, anchor FROM go WHERE id IS NOT NULL"""


def j9(spark, sf):
    p = points(spark, sf)
    near = range_pairs(p.where("id % 5 <> 0"), p.where("id % 5 = 0").select("scene", "x", "y"), ["scene"], 80.0, strict=False)
    return near.select("scene", F.col("l_id").alias("id")).distinct()


def j10(spark, sf):
    p = points(spark, sf)
    own = p.where("id % 5 <> 0")
    near = range_pairs(own, p.where("id % 5 = 0").select("scene", "x", "y"), ["scene"], 18.0).select("scene", F.col("l_id").alias("id")).distinct().withColumn("m", F.lit(1))
    return own.join(near, ["scene", "id"], "left").select("scene", "id", F.coalesce("m", F.lit(0)).alias("member"))


def j11(spark, sf):
    p = points(spark, sf)
    near = range_pairs(p.where("id % 7 = 0"), p.where("id % 7 <> 0"), ["scene"], 50.0, strict=False)
    return near.groupBy("scene", F.col("l_id").alias("id")).agg(F.min(F.struct("d", "r_id")).alias("m")).select("scene", "id", F.col("m.r_id").alias("nearest"), R(F.col("m.d")).alias("d"))


def k28(spark, sf):
    """The best coarse score within 100 pixels of each refined candidate of its scene, 0 without."""
    c = candidates(spark, sf).select("scene", "id", "x", "y", "score")
    own = c.where("id % 2 = 0")
    near = range_pairs(own, c.where("id % 2 = 1").select("scene", "x", "y", "score"), ["scene"], 100.0).groupBy("scene", F.col("l_id").alias("id")).agg(F.max("r_score").alias("s"))
    return own.join(near, ["scene", "id"], "left").select("id", R(F.coalesce("s", F.lit(0.0))).alias("consensus"))


def j12(spark, sf):
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), R(F.sum("o_totalprice"), 2).alias("total"))


def j14(spark, sf):
    c = candidates(spark, sf)
    near = c.where("abs(x - 1500) <= 400 AND abs(y - 1500) <= 400").select(*QUERY).distinct()
    return c.select(*QUERY).distinct().join(near.withColumn("m", F.lit(1)), QUERY, "left").select(*QUERY, F.coalesce("m", F.lit(0)).alias("covered"))


def j15(spark, sf):
    scenes = points(spark, sf).groupBy("scene").agg(F.count("*").alias("n"))
    classes = load(spark, sf, "nation").select(F.col("n_name").alias("name"))  # a catalog of fixed size
    return scenes.crossJoin(F.broadcast(classes)).select("scene", "name", "n")


#: Points of a scene that make triangles and quads, the best by score (the budget of seed generation), but in the neighbours of triangles, whose scenes have all; neighbours of a pattern's triangle and of its quad.
BUDGET, TRIANGLE_K, QUAD_K = 56, 20, 4


def strongest(spark, sf):
    return capped(points(spark, sf, scored=True), BUDGET, "score", descending=True)


def tri(spark, sf):
    return triangles(strongest(spark, sf))


def g1(spark, sf):
    return tri(spark, sf).select("scene", "id0", "id1", "id2", R(F.col("u")).alias("u"), R(F.col("v")).alias("v"))


CAPPED = f"{PTS}, cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY score DESC, id) AS k FROM pts) WHERE k <= {BUDGET})"
TRI = f"""{CAPPED}, t AS (SELECT a.scene, abs((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x)) AS area, list_sort([{{'d': sqrt((b.x-c.x)**2+(b.y-c.y)**2), 'i': 0, 'id': a.id}},
 {{'d': sqrt((c.x-a.x)**2+(c.y-a.y)**2), 'i': 1, 'id': b.id}}, {{'d': sqrt((a.x-b.x)**2+(a.y-b.y)**2), 'i': 2, 'id': c.id}}]) AS e
 FROM cp a JOIN cp b ON a.scene = b.scene AND a.id < b.id JOIN cp c ON b.scene = c.scene AND b.id < c.id),
 tri AS (SELECT scene, e[1].id AS id0, e[2].id AS id1, e[3].id AS id2, e[1].d / e[3].d AS u, e[2].d / e[3].d AS v FROM t WHERE e[1].d > 1e-5 AND area > 0.02 * e[3].d * e[3].d)"""


def g2(spark, sf):
    q = quads(strongest(spark, sf))
    return q.select("scene", *(f"id{i}" for i in range(4)), *(R(F.col(f"q{i}")).alias(f"q{i}") for i in range(4)))


def area_sql(p, q, r):
    return f"(({q}.x-{p}.x)*({r}.y-{p}.y)-({q}.y-{p}.y)*({r}.x-{p}.x))"


G2_SQL = f"""WITH {CAPPED}, f AS (SELECT a.scene, a.id AS ia, b.id AS ib, c.id AS ic, d.id AS id, [{area_sql('b','c','d')}, -{area_sql('a','c','d')}, {area_sql('a','b','d')}, -{area_sql('a','b','c')}] AS s
 FROM cp a JOIN cp b ON a.scene = b.scene AND a.id < b.id JOIN cp c ON b.scene = c.scene AND b.id < c.id JOIN cp d ON c.scene = d.scene AND c.id < d.id),
 g AS (SELECT *, list_sum(list_transform(s, lambda x: abs(x))) AS total, list_filter(s, lambda x: abs(x) = list_max(list_transform(s, lambda y: abs(y))))[1] AS big FROM f),
 h AS (SELECT scene, list_sort([{{'q': s[1]*sign(big)/total, 'id': ia}}, {{'q': s[2]*sign(big)/total, 'id': ib}}, {{'q': s[3]*sign(big)/total, 'id': ic}}, {{'q': s[4]*sign(big)/total, 'id': id}}]) AS q FROM g WHERE total > 0)
SELECT scene, {', '.join(f'q[{i+1}].id AS id{i}, round(q[{i+1}].q, 6) AS q{i}' for i in range(4))} FROM h
 WHERE least({', '.join(f'abs(q[{i}].q)' for i in range(1, 5))}) > 0.015 AND least({', '.join(f'q[{i+1}].q - q[{i}].q' for i in range(1, 4))}) > 0.002"""


PATTERNS = f"{PTS}, cp AS (SELECT 'class-' || scene || '-' || (k // 9) AS scene, k % 9 AS id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY id) - 1 AS k FROM pts))"
UNROUNDED = G2_SQL.replace("round(", "(").replace(", 6)", ")")


def nearest_sql(a, b, dims, k, widths):
    """The k nearest in SQL: rows with k others within a width are done, by cells of two axes; for the next width the rest is left, and at last all pairs."""
    d = "sqrt(" + " + ".join(f"(x.{c}-y.{c})**2" for c in dims) + ")"
    p, q = dims[0], dims[-1]
    out = [f"t0 AS ({a})", f"b AS ({b})"]
    for i, w in enumerate(widths):
        out += [
            f"m{i} AS (SELECT x.o AS a_order, y.o AS b_order, {d} AS d FROM (SELECT t.*, floor({p} / {w}) + i AS c0, floor({q} / {w}) + j AS c1 FROM t{i} t, range(-1, 2) g(i), range(-1, 2) h(j)) x JOIN (SELECT *, floor({p} / {w}) AS c0, floor({q} / {w}) AS c1 FROM b) y ON x.c0 = y.c0 AND x.c1 = y.c1 WHERE {d} < {w})",
            f"n{i} AS (SELECT a_order FROM m{i} GROUP BY 1 HAVING count(*) >= {k})",
            f"t{i + 1} AS (SELECT * FROM t{i} WHERE o NOT IN (FROM n{i}))",
        ]
    last = len(widths)
    every = " UNION ALL ".join(f"SELECT m.* FROM m{i} m SEMI JOIN n{i} USING (a_order)" for i in range(last)) + f" UNION ALL SELECT x.o, y.o, {d} FROM t{last} x, b y"
    return "WITH " + ", ".join(out) + f", k AS (SELECT *, row_number() OVER (PARTITION BY a_order ORDER BY round(d, 9), b_order) AS k FROM ({every})) SELECT a_order, b_order, k, round(d, 6) AS d FROM k WHERE k <= {k}"


TRI_ROWS = "SELECT concat_ws('-', scene, id0, id1, id2) AS o, u, v FROM ("
EVERY = f"{PTS}, cp AS (SELECT * FROM pts)"
J5_SQL = nearest_sql(f"{TRI_ROWS}WITH {TRI.replace(CAPPED, PATTERNS)} SELECT * FROM tri)", f"{TRI_ROWS}WITH {TRI.replace(CAPPED, EVERY)} SELECT * FROM tri)", ("u", "v"), TRIANGLE_K, (0.006, 0.05))
QUAD_ROWS = "SELECT concat_ws('-', scene, id0, id1, id2, id3) AS o, q0, q1, q2, q3 FROM ("
J6_SQL = nearest_sql(f"{QUAD_ROWS}{UNROUNDED.replace(CAPPED, PATTERNS)})", f"{QUAD_ROWS}{UNROUNDED})", ("q0", "q1", "q2", "q3"), QUAD_K, (0.0015, 0.006, 0.03))


def patterns(spark, sf):
    """A scene's points as patterns, nine by nine."""
    p = points(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("scene").orderBy("id")) - 1)
    return p.select(F.concat_ws("-", F.lit("class"), "scene", F.floor(F.col("k") / 9)).alias("scene"), (F.col("k") % 9).alias("id"), "x", "y")


def j5(spark, sf):
    """The twenty triangles of the scenes nearest to each triangle of every pattern in the plane of their ratios, however far, of all points of the scenes."""
    return shape_neighbours(patterns(spark, sf), points(spark, sf), 3, TRIANGLE_K).withColumn("d", R(F.col("d")))


def j6(spark, sf):
    """The four quads of the scenes nearest to each quad of every pattern, however far."""
    return shape_neighbours(patterns(spark, sf), strongest(spark, sf), 4, QUAD_K).withColumn("d", R(F.col("d")))


def pairs(spark, sf):
    """Pairs of a scene's points with those that a known map and a small error give."""
    p = points(spark, sf)
    e = (F.col("id") % 7 - 3).cast("double")
    return p.select("scene", "id", F.col("x").alias("sx"), F.col("y").alias("sy"), (1.2 * F.col("x") - 0.3 * F.col("y") + 40 + e).alias("tx"), (0.4 * F.col("x") + 0.9 * F.col("y") - 15 - e).alias("ty"))


PAIRS = f"{PTS}, pr AS (SELECT scene, id, x AS sx, y AS sy, 1.2 * x - 0.3 * y + 40 + (id % 7 - 3) AS tx, 0.4 * x + 0.9 * y - 15 - (id % 7 - 3) AS ty FROM pts)"
SUMS = "sm AS (SELECT scene, count(*) AS n, avg(sx) AS mx, avg(sy) AS my, avg(tx) AS mu, avg(ty) AS mv, " + ", ".join(f"covar_pop({a}, {b}) AS {a}_{b}" for a, b in (("sx", "sx"), ("sx", "sy"), ("sy", "sy"), ("sx", "tx"), ("sy", "tx"), ("sx", "ty"), ("sy", "ty"))) + " FROM {src} GROUP BY scene)"
FIT = "ft AS (SELECT scene, n, mx, my, mu, mv, (sx_tx*sy_sy-sy_tx*sx_sy)/(sx_sx*sy_sy-sx_sy*sx_sy) AS a, (sy_tx*sx_sx-sx_tx*sx_sy)/(sx_sx*sy_sy-sx_sy*sx_sy) AS b, (sx_ty*sy_sy-sy_ty*sx_sy)/(sx_sx*sy_sy-sx_sy*sx_sy) AS c, (sy_ty*sx_sx-sx_ty*sx_sy)/(sx_sx*sy_sy-sx_sy*sx_sy) AS d FROM sm)"
FIT_OUT = "SELECT scene, n, round(a, 5) AS a, round(b, 5) AS b, round(c, 5) AS c, round(d, 5) AS d, round(mu - a*mx - b*my, 3) AS e, round(mv - c*mx - d*my, 3) AS f FROM ft"


A15_SQL = f"""WITH {PAIRS}, ps AS (SELECT scene, CASE WHEN scene % 2 = 0 THEN sx ELSE -sx END AS sx, sy, tx, ty FROM pr), two AS (SELECT *, 0 AS mirrored FROM ps UNION ALL SELECT scene, -sx, sy, tx, ty, 1 FROM ps),
 m AS (SELECT scene, mirrored, covar_pop(sx, sx) + covar_pop(sy, sy) AS spread, covar_pop(sx, tx) + covar_pop(sy, ty) AS a, covar_pop(sx, ty) - covar_pop(sy, tx) AS b, covar_pop(tx, tx) + covar_pop(ty, ty) AS t, avg(sx) AS mx, avg(sy) AS my, avg(tx) AS mu, avg(ty) AS mv FROM two GROUP BY ALL),
 f AS (SELECT *, a / spread AS c, b / spread AS s, row_number() OVER (PARTITION BY scene ORDER BY round(t - (a * a + b * b) / spread, 6), mirrored) AS k FROM m)
SELECT scene, mirrored, round(c, 5) AS c, round(s, 5) AS s, round(mu - c*mx + s*my, 3) AS e, round(mv - s*mx - c*my, 3) AS f FROM f WHERE k = 1"""


def rounded_fit(f):
    return f.select("scene", "n", *(R(F.col(c), 5).alias(c) for c in "abcd"), *(R(F.col(c), 3).alias(c) for c in "ef"))


def a13(spark, sf):
    return rounded_fit(affine_fit(pairs(spark, sf), ["scene"]))


def a14(spark, sf):
    w = Window.partitionBy("scene").orderBy("id")
    return rounded_fit(three_point_affine(pairs(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 3"), ["scene"]))


def a15(spark, sf):
    """The similarity of each scene's pairs, plain or mirrored, whichever leaves less; every other scene's pairs are a mirror image."""
    f = best_similarity(pairs(spark, sf).withColumn("sx", F.when(F.col("scene") % 2 == 0, F.col("sx")).otherwise(-F.col("sx"))), ["scene"])
    return f.select("scene", F.col("mirrored").cast("int").alias("mirrored"), R(F.col("c"), 5).alias("c"), R(F.col("s"), 5).alias("s"), R(F.col("e"), 3).alias("e"), R(F.col("f"), 3).alias("f"))


def p8(spark, sf):
    m = [F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")]
    big = (m[0] * 40, m[1] * 1000, m[2] * 1000, m[3] / 100)
    large, small = singular_values(*big)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R(large, 4).alias("large"), R(small, 4).alias("small"), valid_transform(*big).cast("int").alias("valid"), R(F.coalesce(shear(*big), F.lit(-1.0))).alias("shear"))


P8_SQL = """WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity * 40 AS a, l_discount * 1000 AS b, l_tax * 1000 AS c, l_extendedprice / 100 AS d FROM lineitem),
 s AS (SELECT *, sqrt((a*a+b*b+c*c+d*d + sqrt(greatest(0.0, (a*a+b*b+c*c+d*d)**2 - 4*abs(a*d-b*c)**2))) / 2) AS l FROM m), v AS (SELECT *, CASE WHEN l > 0 THEN abs(a*d-b*c) / l ELSE 0.0 END AS k FROM s)
SELECT l_orderkey, l_linenumber, round(l, 4) AS large, round(k, 4) AS small, CAST(k >= 50 AND l <= 6000 AND l <= 8 * k AS INT) AS valid,
 round(CASE WHEN a*a+b*b = 0 OR c*c+d*d = 0 THEN -1.0 ELSE abs(a*c+b*d) / (sqrt(a*a+b*b) * sqrt(c*c+d*d)) END, 6) AS shear FROM v"""


def a16(spark, sf):
    """Surprise, tail and the whole score of fits whose figures the parts give."""
    p = load(spark, sf, "part").select("p_partkey", (F.col("p_size") % 15 + 5).alias("nodes"), (F.col("p_partkey") % 12 + 4).alias("support"), (F.col("p_size") + 20).alias("density"), *(v.alias(k) for k, v in FIGURES(F.col("p_partkey"), F.col("p_size"))))
    p = p.where("support <= nodes")
    own = surprise(F.col("support"), F.col("nodes"), F.col("density"), 24.0)
    score = hypothesis_score(own, F.col("residual"), F.col("shear"), F.col("appearance"), F.col("cost"), F.col("similar") == 1, 24.0, 2.0, 1.0, 0.1)
    return p.select("p_partkey", R(own).alias("surprise"), R(binomial_tail(F.col("support") - 4, F.col("nodes"), F.lit(0.2)), 9).alias("tail"), R(score).alias("score"))


FIGURES = lambda key, size: (("residual", key % 17 / 2), ("shear", size % 10 / 20), ("appearance", key % 31 / 31), ("cost", (key % 5).cast("double")), ("similar", (key % 3 == 0).cast("int")))
A16_SQL = """WITH p AS (SELECT p_partkey, p_size % 15 + 5 AS nodes, p_partkey % 12 + 4 AS support, p_size + 20 AS density, p_partkey % 17 / 2.0 AS residual, p_size % 10 / 20.0 AS shear, p_partkey % 31 / 31.0 AS appearance, p_partkey % 5 AS cost, p_partkey % 3 = 0 AS alike FROM part WHERE p_partkey % 12 + 4 <= p_size % 15 + 5),
 q AS (SELECT *, greatest(nodes - 3, 1) AS n, least(0.8, density * pi() * 24.0 * 24.0 / 9e6) AS pr FROM p),
 b AS (SELECT *, list_sum(list_transform(range(support - 3, n + 1), lambda i: exp(lgamma(n+1) - lgamma(i+1) - lgamma(n-i+1) + i*ln(pr) + (n-i)*ln(1-pr)))) AS t1,
 list_sum(list_transform(range(support - 3, nodes + 1), lambda i: exp(lgamma(nodes+1) - lgamma(i+1) - lgamma(nodes-i+1) + i*ln(0.2) + (nodes-i)*ln(0.8)))) AS t2 FROM q)
SELECT p_partkey, round(-log10(t1), 6) AS surprise, round(coalesce(t2, 0.0), 9) AS tail, round(-log10(t1) - 0.5 * residual / 24.0 + CASE WHEN alike THEN 0.35 ELSE 0.0 END - 2 * shear + appearance - 0.1 * cost, 6) AS score FROM b"""


def a17(spark, sf):
    r = candidates(spark, sf).groupBy(*QUERY).agg(F.array_sort(F.collect_list(F.col("x") / 100)).alias("r"))
    return r.select(*QUERY, R(likelihood(F.col("r"), 24.0, 8.0) - 0.5 * F.size("r"), 5).alias("score"), R(trimmed_mean(F.col("r"), 0.2)).alias("trimmed"))


def a21(spark, sf):
    return theil_sen(points(spark, sf), ["scene"]).select("scene", "n", R(F.col("slope")).alias("slope"), R(F.col("intercept"), 4).alias("intercept"))


def g3(spark, sf):
    return normalised(points(spark, sf), ["scene"]).select("scene", "id", R(F.col("nx")).alias("nx"), R(F.col("ny")).alias("ny"))


def g4(spark, sf):
    """Residuals of each pair under its scene's fit."""
    p = pairs(spark, sf)
    f = affine_fit(p, ["scene"]).select("scene", *"abcdef")
    g = F.col
    u, v = g("a") * g("sx") + g("b") * g("sy") + g("e"), g("c") * g("sx") + g("d") * g("sy") + g("f")
    return p.join(f, "scene").select("scene", "id", R(distance(u, v, g("tx"), g("ty")), 4).alias("residual"))


def g7(spark, sf):
    """Every point of a group takes its anchor's place."""
    p = points(spark, sf)
    a = p.select("scene", F.col("id").alias("anchor"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    return grouped(p, 60.0).join(a, ["scene", "anchor"]).groupBy("scene", "anchor").agg(F.count("*").alias("members"), R(F.first("ax"), 4).alias("x"), R(F.first("ay"), 4).alias("y"))


def moves(spark, sf):
    """Moves of each point to the place that its known map gives, with its group of eleven and its node."""
    p = pairs(spark, sf).withColumn("grp", F.col("id") % 11)
    return p.select("scene", F.col("id").alias("query"), "grp", F.col("id").alias("node"), F.when(F.col("id") % 4 == 0, F.col("tx") + 0.25).otherwise(F.col("tx") + F.col("id") % 40).alias("x"), F.col("ty").alias("y"), (F.col("tx") + F.col("id") % 13 * 2).alias("nx"), F.col("ty").alias("ny"))


def guard_scores(spark, sf):
    """An independent score at each move's two ends; every ninth proposed end has no candidate near."""
    m = moves(spark, sf)
    own = m.select("scene", "query", "x", "y", (F.col("query") % 10 / 10).alias("score"))
    return own.unionByName(m.select("scene", "query", F.when(F.col("query") % 9 == 0, F.col("nx") + 500).otherwise(F.col("nx") + 0.75).alias("x"), F.col("ny").alias("y"), (F.col("query") % 7 / 7).alias("score")))


def held_pairs(spark, sf):
    return pairs(spark, sf).select("scene", (F.col("id") % 11).alias("grp"), F.col("id").alias("node"), "sx", "sy", "tx", "ty")


def c11(spark, sf):
    """What each guard says of each move: accept all, an independent score, the fit without the move's own group, both."""
    m = moves(spark, sf)
    score, held = relocation.independent_appearance(m, guard_scores(spark, sf), 0.1), relocation.held_out_support(m, held_pairs(spark, sf))
    kinds = {"accept-all": relocation.accept_all(m), "independent": score, "held-out": held, "all-of": relocation.all_of(score, held)}
    rows = [relocation.guarded(m, g).select(F.lit(k).alias("guard"), "scene", "query", F.col("accepted").cast("int").alias("accepted"), "reason") for k, g in kinds.items()]
    return reduce(DataFrame.unionByName, rows)


HELD = SUMS.format(src="hp").replace("scene, count", "scene, held, count").replace("GROUP BY scene", "GROUP BY scene, held")
C11_SQL = f"""WITH {PAIRS}, g AS (SELECT DISTINCT scene, id % 11 AS held FROM pr), hp AS (SELECT pr.*, held FROM pr JOIN g ON pr.scene = g.scene AND id % 11 <> held), {HELD}, {FIT.replace('SELECT scene, n', 'SELECT scene, held, n')},
 mv AS (SELECT scene, id AS query, id % 11 AS grp, CASE WHEN id % 4 = 0 THEN tx + 0.25 ELSE tx + id % 40 END AS x, ty AS y, tx + id % 13 * 2 AS nx, sx, sy FROM pr),
 e AS (SELECT mv.scene, query, abs(x - nx) < 0.5 AS same, n, sqrt((a*sx+b*sy+mu-a*mx-b*my-nx)**2 + (c*sx+d*sy+mv-c*mx-d*my-y)**2) AS far,
  query % 10 / 10.0 AS own, CASE WHEN abs(x - nx) < CASE WHEN query % 9 = 0 THEN 1.5 ELSE 0.75 END THEN query % 10 / 10.0 WHEN query % 9 <> 0 THEN query % 7 / 7.0 END AS new FROM mv LEFT JOIN ft ON mv.scene = ft.scene AND grp = held),
 r AS (SELECT *, CASE WHEN new IS NULL THEN 'unmatched-candidate' WHEN new >= own + 0.1 THEN 'independent' ELSE 'independent-lower' END AS i, CASE WHEN coalesce(n, 0) < 4 THEN 'few-correspondences' WHEN far IS NULL THEN 'refit-failed' WHEN far <= 18 THEN 'held-out' ELSE 'held-out-far' END AS h FROM e),
 u AS (SELECT scene, query, same, 'accept-all' AS guard, true AS ok, 'baseline' AS reason FROM r UNION ALL SELECT scene, query, same, 'independent', i = 'independent', i FROM r UNION ALL SELECT scene, query, same, 'held-out', h = 'held-out', h FROM r
  UNION ALL SELECT scene, query, same, 'all-of', i = 'independent' AND h = 'held-out', CASE WHEN i <> 'independent' THEN i WHEN h <> 'held-out' THEN h ELSE 'all guards accept' END FROM r)
SELECT guard, scene, query, CAST(same OR ok AS INT) AS accepted, CASE WHEN same THEN 'no move' ELSE reason END AS reason FROM u"""


def k11(spark, sf):
    """The poses that read a disc's samples only inside a patch of 32, for every brand: discs of 12 pixels, and as wide as the scale admits up to the brand's own greatest size.
    The table function makes each brand's bank beside its rows. An edge is met to a millionth of a pixel."""
    brands = load(spark, sf, "part").groupBy(F.col("p_brand").alias("key")).agg(F.max("p_size").alias("most"))
    b = bank(brands.select("key")).join(brands, "key").withColumn("policy", F.explode(F.array(F.lit("fixed"), F.lit("adaptive"))))
    radius = F.when(F.col("policy") == "fixed", 12).otherwise(F.least(F.col("most"), F.greatest(F.lit(6), F.floor(15.2 * F.col("scale"))))).cast("int")
    steps = F.sequence(-radius, radius, F.lit(2))
    disc = F.filter(F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct(i.alias("i"), j.alias("j"))))), lambda c: c["i"] * c["i"] + c["j"] * c["j"] <= radius * radius)
    t = F.radians(F.col("angle").cast("double"))
    at = lambda c: F.struct((15.5 + (c["i"] * F.cos(t) - c["j"] * F.sin(t)) / F.col("scale")).alias("x"), (15.5 + (c["i"] * F.sin(t) + c["j"] * F.cos(t)) / F.col("scale")).alias("y"))
    inside = F.forall(F.transform(disc, at), lambda p: p["x"].between(-1e-6, 31 + 1e-6) & p["y"].between(-1e-6, 31 + 1e-6))
    return b.where(inside).select(F.col("key").alias("brand"), "policy", "scale", F.col("angle").cast("long").alias("angle"))


def k13(spark, sf):
    """Disc samples, by a stride of two, of every radius that the parts' sizes give."""
    r = load(spark, sf, "part").select((F.col("p_size") % 7 + 6).cast("long").alias("radius")).distinct()
    grid = r.select("radius", F.explode(F.sequence(-F.col("radius"), F.col("radius"), F.lit(2))).alias("i")).select("radius", "i", F.explode(F.sequence(-F.col("radius"), F.col("radius"), F.lit(2))).alias("j"))
    return grid.where("i * i + j * j <= radius * radius").select("radius", "i", "j")


def u2(spark, sf):
    """The threes of every label's six strongest points, made by the table function."""
    six = capped(points(spark, sf, scored=True), 6, "score", descending=True)
    return combinations_of(six.select(F.col("scene").cast("string").alias("key"), "id", F.lit(3).alias("size"))).select(F.col("key").alias("scene"), *(F.col("ids")[i].alias(f"id{i}") for i in range(3)))


def u1(spark, sf):
    """Draws that depend on a part's key and a seed alone: a uniform and a normal one."""
    u = lambda k: keyed_uniform(7, F.lit(k), F.col("p_partkey"))
    return load(spark, sf, "part").select("p_partkey", R(u("a"), 9).alias("uniform"), R(F.sqrt(-2 * F.log(1 - u("b"))) * F.cos(2 * F.pi() * u("c"))).alias("normal"))


def k12(spark, sf):
    s = F.col("l_discount") * 10 + 0.3
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.greatest(F.lit(6), F.floor(15.2 * s)).cast("long").alias("radius"))


def k3(spark, sf):
    e = load(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = e.select("vec_id", "v", mean_centred(F.col("v")).alias("u"))
    return n.select("vec_id", R(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), R(dot(F.col("u"), F.col("v"))).alias("with_raw"), R(F.array_max("u")).alias("peak"))


def k17(spark, sf):
    """Statistics of each vector as an 8 x 8 picture: mean, spread, peak, share over .2, centre against rim, spread about the row's mean."""
    e = load(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "p")).select("vec_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.col("p").cast("double").alias("p"))
    middle = F.col("x").between(2, 5) & F.col("y").between(2, 5)
    rows = e.groupBy("vec_id", "y").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"), F.max("p").alias("m"), F.count_if(F.col("p") > 0.2).alias("over"), F.sum(F.when(middle, F.col("p"))).alias("c"))
    n = F.count("*") * 8
    c, s = F.sum(F.coalesce("c", F.lit(0.0))), F.sum("s")
    return rows.groupBy("vec_id").agg(
        R(s / n).alias("mean"), R(F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / n - (s / n) * (s / n)))).alias("std"), R(F.max("m")).alias("max"), R(F.sum("over") / n).alias("saturated"),
        R(c / 16 - (s - c) / 48).alias("contrast"), R(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("q") - F.col("s") * F.col("s") / 8) / n))).alias("highpass"),
    )


def k18(spark, sf):
    """Of each label's values the median, the spread of those below the 80th percentile, the 99.9th and the number over .3."""
    e = load(spark, sf, "embeddings").select("label", F.explode("embedding").alias("p")).select("label", F.col("p").cast("double").alias("p"))
    q = exact_quantiles(e, ["label"], "p", {"background": 0.5, "p80": 0.8, "p999": 0.999})
    low = F.when(F.col("p") < F.col("p80"), F.col("p"))
    stars = e.join(q, "label").groupBy("label", "background", "p999").agg(F.count_if(F.col("p") > 0.3).alias("stars"), R(F.stddev_pop(low)).alias("noise"))
    return stars.select("label", R(F.col("background")).alias("background"), R(F.col("p999")).alias("p999"), "stars", "noise")


def against_first(spark, sf):
    """(vec_id, label, p, s, r): the pixels of each vector as an 8 x 8 picture beside those of its label's first one, and their distance from the middle."""
    e = load(spark, sf, "embeddings").where("label IS NOT NULL").select("vec_id", "label", F.posexplode("embedding").alias("i", "p")).withColumn("p", F.col("p").cast("double"))
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(e, ["label", "vec_id"]).select("label", "i", F.col("p").alias("s"))
    return e.join(first, ["label", "i"]).withColumn("r", F.hypot(F.col("i") % 8 - 3.5, F.floor(F.col("i") / 8) - 3.5))


MASKS = {"full": (-1.0, 9.0), "disc": (-1.0, 3.5), "centre": (-1.0, 1.5), "annulus": (1.5, 3.5)}


def k20(spark, sf):
    """Correlation of each picture with its label's first one under four masks."""
    p, s, r = F.col("p"), F.col("s"), F.col("r")
    sums = {f"{m}_{k}": F.sum(F.when((r > lo) & (r <= hi), v)) for m, (lo, hi) in MASKS.items() for k, v in (("n", F.lit(1.0)), ("p", p), ("s", s), ("pp", p * p), ("ss", s * s), ("ps", p * s))}
    g = lambda m, k: F.col(f"{m}_{k}")
    cov = lambda m, a, b: g(m, a + b) - g(m, a) * g(m, b) / g(m, "n")
    score = lambda m: cov(m, "p", "s") / F.greatest(F.lit(1e-6), F.sqrt(F.greatest(F.lit(0.0), cov(m, "p", "p")))) / F.greatest(F.lit(1e-6), F.sqrt(F.greatest(F.lit(0.0), cov(m, "s", "s"))))
    return against_first(spark, sf).groupBy("vec_id").agg(*(v.alias(k) for k, v in sums.items())).select("vec_id", *(R(score(m)).alias(m) for m in MASKS))


def k22(spark, sf):
    """Photometric agreement of each picture with its label's first one: gain and offset fitted over the disc, the mean of the four fifths of least residuals against the picture's mean deviation."""
    own = Window.partitionBy("vec_id")  # a picture's pixels
    rows = against_first(spark, sf).where("r <= 3.5").withColumns({"p": F.col("p") - F.avg("p").over(own), "s": F.col("s") - F.avg("s").over(own)})
    gain = F.sum(F.col("s") * F.col("p")).over(own) / F.greatest(F.lit(1e-9), F.sum(F.col("s") * F.col("s")).over(own))
    rows = rows.withColumn("left", F.abs(gain * F.col("s") - F.col("p")))
    rows = rows.withColumns({"k": F.row_number().over(own.orderBy("left")), "n": F.count("*").over(own)})
    kept = F.avg(F.when(F.col("k") <= F.round(F.col("n") * 0.8), F.col("left")))
    return rows.groupBy("vec_id").agg(R(1 - kept / F.greatest(F.lit(1e-6), F.avg(F.abs("p")))).alias("agreement"))


FIRST_SQL = "pic AS (SELECT vec_id, label, i, CAST(embedding[i + 1] AS DOUBLE) AS p FROM embeddings, range(64) r(i)), af AS (SELECT a.vec_id, a.p, b.p AS s, sqrt((a.i % 8 - 3.5)**2 + (a.i // 8 - 3.5)**2) AS r FROM pic a JOIN pic b ON a.label = b.label AND a.i = b.i JOIN (SELECT label, min(vec_id) AS v FROM pic GROUP BY label) f ON b.label = f.label AND b.vec_id = f.v)"
K20_SQL = f"WITH {FIRST_SQL} SELECT vec_id, " + ", ".join(f"round(covar_pop(p, s) FILTER (r > {lo} AND r <= {hi}) / (stddev_pop(p) FILTER (r > {lo} AND r <= {hi}) * stddev_pop(s) FILTER (r > {lo} AND r <= {hi})), 6) AS {m}" for m, (lo, hi) in MASKS.items()) + " FROM af GROUP BY vec_id"
K22_SQL = f"""WITH {FIRST_SQL}, c AS (SELECT vec_id, p - avg(p) OVER w AS p, s - avg(s) OVER w AS s FROM af WHERE r <= 3.5 WINDOW w AS (PARTITION BY vec_id)),
 d AS (SELECT vec_id, p, abs(sum(s * p) OVER w / greatest(1e-9, sum(s * s) OVER w) * s - p) AS l FROM c WINDOW w AS (PARTITION BY vec_id)), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY l) AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM d)
SELECT vec_id, round(1 - avg(l) FILTER (k <= round(n * 0.8)) / greatest(1e-6, avg(abs(p))), 6) AS agreement FROM k GROUP BY vec_id"""


def p16(spark, sf):
    """Pairs of a scene's boxes of 300 pixels that overlap: their corners are nearer than the diagonal."""
    p = points(spark, sf)
    near = range_pairs(p, p, ["scene"], 425.0).where("l_id < r_id")
    box = lambda a: (F.col(f"{a}_x"), F.col(f"{a}_y"), F.col(f"{a}_x") + 300, F.col(f"{a}_y") + 300)
    return near.where(boxes_overlap(box("l"), box("r"))).select(F.col("l_id").alias("aid"), F.col("r_id").alias("bid"))


def regions(spark, sf):
    """The 3 x 3 regions of each source image with the split that each falls to."""
    i = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("image"))
    cell = i.select("image", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row")).select("image", "row", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("col"))
    split = F.element_at(F.array(*(F.lit(s) for s in ("development", "calibration", "confirmation"))), ((F.col("image") + F.col("row") + F.col("col")) % 3 + 1).cast("int"))
    return cell.select("image", "row", "col", (F.col("col") * 1000 + 96).alias("x0"), (F.col("row") * 1000 + 96).alias("y0"), split.alias("split"))


UNIT = "(CASE WHEN {0} IS NULL THEN NULL ELSE list_transform({0}, lambda q: (q - list_avg({0})) / greatest(1e-6, sqrt(list_sum(list_transform({0}, lambda z: (z - list_avg({0})) ** 2))))) END)"
VEC = "ev AS (SELECT label, vec_id, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS v FROM embeddings)"
NEAR = "abs(a.x-b.x) <= {r} AND abs(a.y-b.y) <= {r} AND " + DIST + " {op} {r}"
QUERIES = {
    "j1_nearest_vectors": (j1, J1_SQL),
    "j4_assignment": (j4, J4_SQL),
    "j5_triangle_neighbours": (j5, J5_SQL),
    "j6_quad_neighbours": (j6, J6_SQL),
    "j8_anchor_groups": (j8, J8_SQL),
    "j9_eligible": (j9, f"WITH {PTS} SELECT DISTINCT a.scene, a.id FROM pts a JOIN pts b ON a.scene = b.scene AND a.id % 5 <> 0 AND b.id % 5 = 0 AND " + NEAR.format(r=80, op="<=")),
    "j10_membership": (j10, f"WITH {PTS} SELECT a.scene, a.id, CAST(EXISTS (SELECT 1 FROM pts b WHERE a.scene = b.scene AND b.id % 5 = 0 AND {DIST} < 18) AS INT) AS member FROM pts a WHERE a.id % 5 <> 0"),
    "j11_nearest": (j11, f"WITH {PTS}, m AS (SELECT a.scene, a.id, b.id AS nearest, {DIST} AS d FROM pts a JOIN pts b ON a.scene = b.scene AND a.id % 7 = 0 AND b.id % 7 <> 0) SELECT scene, id, nearest, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY scene, id ORDER BY d, nearest) AS k FROM m WHERE d <= 50) WHERE k = 1"),
    "j12_truth_join": (j12, "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "j14_neighbourhood": (j14, f"WITH {CAND} SELECT scene, query, max(CAST(abs(x - 1500) <= 400 AND abs(y - 1500) <= 400 AS INT)) AS covered FROM cand GROUP BY ALL"),
    "j15_scene_class": (j15, f"WITH {PTS} SELECT scene, n_name AS name, n FROM (SELECT scene, count(*) AS n FROM pts GROUP BY scene), nation"),
    "k28_j13_consensus": (k28, f"WITH {CAND} SELECT a.id, round(coalesce(max(b.score), 0.0), 6) AS consensus FROM cand a LEFT JOIN cand b ON a.scene = b.scene AND b.id % 2 = 1 AND {DIST} < 100 WHERE a.id % 2 = 0 GROUP BY a.id"),
    "g1_j7_p9_triangles": (g1, f"WITH {TRI} SELECT scene, id0, id1, id2, round(u, 6) AS u, round(v, 6) AS v FROM tri"),
    "g2_p10_quads": (g2, G2_SQL),
    "a13_affine_fit": (a13, f"WITH {PAIRS}, {SUMS.format(src='pr')}, {FIT} {FIT_OUT}"),
    "a14_three_point_fit": (a14, f"WITH {PAIRS}, p3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY id) AS k FROM pr) WHERE k <= 3), {SUMS.format(src='p3')}, {FIT} {FIT_OUT} WHERE n = 3"),
    "a15_similarity_fit": (a15, A15_SQL),
    "a16_binomial_score": (a16, A16_SQL),
    "a17_k22_likelihood": (a17, f"WITH {CAND}, r AS (SELECT scene, query, list_sort(list(x / 100)) AS r FROM cand GROUP BY ALL) SELECT scene, query, round(list_sum(list_transform(r, lambda q: ln(24.0*24.0/(2*8.0*8.0)) - q*q/(2*8.0*8.0))) - 0.5*len(r), 5) AS score, round(list_avg(r[1:greatest(1, CAST(floor(len(r)*0.8) AS INT))]), 6) AS trimmed FROM r"),
    "a19_p8_transform_checks": (p8, P8_SQL),
    "a21_theil_sen": (a21, f"WITH {PTS}, f AS (SELECT * FROM pts), s AS (SELECT a.scene, median((b.y-a.y)/(b.x-a.x)) AS slope FROM f a JOIN f b ON a.scene = b.scene AND a.id < b.id AND a.x <> b.x GROUP BY a.scene) SELECT f.scene, count(*) AS n, round(any_value(slope), 6) AS slope, round(median(y - slope*x), 4) AS intercept FROM f JOIN s ON f.scene = s.scene GROUP BY f.scene HAVING count(*) >= 6"),
    "g3_normalised": (g3, f"WITH {PTS} SELECT scene, id, round((x - avg(x) OVER w) / greatest(1e-6, max(x) OVER w - min(x) OVER w), 6) AS nx, round((y - avg(y) OVER w) / greatest(1e-6, max(y) OVER w - min(y) OVER w), 6) AS ny FROM pts WINDOW w AS (PARTITION BY scene)"),
    "g4_residuals": (g4, f"WITH {PAIRS}, {SUMS.format(src='pr')}, {FIT} SELECT pr.scene, id, round(sqrt((a*sx+b*sy+mu-a*mx-b*my-tx)**2 + (c*sx+d*sy+mv-c*mx-d*my-ty)**2), 4) AS residual FROM pr JOIN ft ON pr.scene = ft.scene"),
    "g7_relocation": (g7, J8_SQL.replace("SELECT scene, id, anchor FROM go WHERE id IS NOT NULL", "SELECT g.scene, anchor, count(*) AS members, round(any_value(p.x), 4) AS x, round(any_value(p.y), 4) AS y FROM go g JOIN pts p ON g.anchor = p.id WHERE g.id IS NOT NULL GROUP BY g.scene, anchor")),
    "c11_relocation_guards": (c11, C11_SQL),
    "k3_normalise": (k3, f"WITH {VEC}, u AS (SELECT vec_id, v, {UNIT.format('v')} AS u FROM ev) SELECT vec_id, round(list_sum(u), 6) + 0.0 AS total, round(list_sum(list_transform(list_zip(u, v), lambda z: z[1]*z[2])), 6) AS with_raw, round(list_max(u), 6) AS peak FROM u"),
    "k11_p7_pose_bank": (k11, "WITH br AS (SELECT p_brand AS brand, max(p_size) AS most FROM part GROUP BY p_brand), b AS (SELECT unnest([0.75, 0.87, 1.0, 1.15, 1.33]::DOUBLE[]) AS scale), c AS (SELECT brand, policy, scale, a * 15 AS angle, radians(a * 15.0) AS t, CASE policy WHEN 'fixed' THEN 12 ELSE least(most, greatest(6, CAST(floor(15.2 * scale) AS INT))) END AS r FROM br, b, range(24) q(a), (VALUES ('fixed'), ('adaptive')) p(policy)), d AS (SELECT brand, policy, scale, angle, 15.5 + ((2*m-r)*cos(t) - (2*n-r)*sin(t)) / scale AS x, 15.5 + ((2*m-r)*sin(t) + (2*n-r)*cos(t)) / scale AS y FROM c, range(41) u(m), range(41) v(n) WHERE 2*m-r <= r AND 2*n-r <= r AND (2*m-r)**2 + (2*n-r)**2 <= r*r) SELECT brand, policy, scale, angle FROM d GROUP BY ALL HAVING min(x) >= -1e-6 AND max(x) <= 31 + 1e-6 AND min(y) >= -1e-6 AND max(y) <= 31 + 1e-6"),
    "k12_radius": (k12, "SELECT l_orderkey, l_linenumber, CAST(greatest(6, floor(15.2 * (l_discount * 10 + 0.3))) AS BIGINT) AS radius FROM lineitem"),
    "k13_disc": (k13, "SELECT radius, i, j FROM (SELECT DISTINCT CAST(p_size % 7 + 6 AS BIGINT) AS radius FROM part) r, LATERAL (SELECT unnest(range(-radius, radius + 1, 2)) AS i), LATERAL (SELECT unnest(range(-radius, radius + 1, 2)) AS j) WHERE i*i + j*j <= radius*radius"),
    "k17_patch_statistics": (k17, "WITH p AS (SELECT vec_id, CAST(embedding[i + 1] AS DOUBLE) AS p, i % 8 AS x, i // 8 AS y FROM embeddings, range(64) r(i)), q AS (SELECT *, p - avg(p) OVER (PARTITION BY vec_id, y) AS h, x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 AS c FROM p) SELECT vec_id, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std, round(max(p), 6) AS max, round(avg(CASE WHEN p > 0.2 THEN 1.0 ELSE 0.0 END), 6) AS saturated, round(avg(p) FILTER (c) - avg(p) FILTER (NOT c), 6) AS contrast, round(sqrt(avg(h * h)), 6) AS highpass FROM q GROUP BY vec_id"),
    "k18_scene_statistics": (k18, "WITH p AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS p FROM embeddings), q AS (SELECT label, quantile_cont(p, 0.8) AS p80 FROM p GROUP BY label) SELECT label, round(quantile_cont(p, 0.5), 6) AS background, round(quantile_cont(p, 0.999), 6) AS p999, count(*) FILTER (p > 0.3) AS stars, round(stddev_pop(p) FILTER (p < p80), 6) AS noise FROM p JOIN q USING (label) GROUP BY label"),
    "k20_masked_ncc": (k20, K20_SQL),
    "k22_photometric_agreement": (k22, K22_SQL),
    "u1_keyed_draws": (u1, "WITH d AS (SELECT p_partkey, " + ", ".join(f"CAST('0x' || substr(sha256('7|{k}|' || p_partkey), 1, 13) AS BIGINT) / 4503599627370496.0 AS {k}" for k in "abc") + " FROM part) SELECT p_partkey, round(a, 9) AS uniform, round(sqrt(-2 * ln(1 - b)) * cos(2 * pi() * c), 6) AS normal FROM d"),
    "u2_combinations": (u2, f"WITH {PTS}, t AS (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY scene ORDER BY score DESC, id) <= 6) SELECT CAST(a.scene AS VARCHAR) AS scene, a.id AS id0, b.id AS id1, c.id AS id2 FROM t a JOIN t b ON a.scene = b.scene AND a.id < b.id JOIN t c ON b.scene = c.scene AND b.id < c.id"),
    "p16_box_overlap": (p16, f"WITH {PTS} SELECT a.id AS aid, b.id AS bid FROM pts a JOIN pts b ON a.scene = b.scene AND a.id < b.id AND a.x < b.x + 300 AND b.x < a.x + 300 AND a.y < b.y + 300 AND b.y < a.y + 300"),
    "source_regions": (regions, "SELECT s_suppkey AS image, CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(c * 1000 + 96 AS INT) AS x0, CAST(r * 1000 + 96 AS INT) AS y0, ['development', 'calibration', 'confirmation'][(s_suppkey + r + c) % 3 + 1] AS split FROM supplier, range(3) a(r), range(3) b(c)"),
}
