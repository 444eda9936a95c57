"""Queries on pictures as rows of pixels. A vector is a picture of 8 x 8 pixels; 256 vectors of consecutive ids are the tiles of an image of 128 x 128."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.grids import bank, fourier_samples
from ..operators.analysis import share_below
from ..operators.raster import best_pose, components, correlation_scan, corners, harmonics, local_maxima, peaks, sampled, sliding_max
from ..sources.tables import load

R = lambda c, n=6: F.round(c, n)
SIDE, TILES = 8, 16
REACH = 2


def pictures(spark, sf):
    """(picture, label, px, v)"""
    return as_pixels(load(spark, sf, "embeddings"))


def as_pixels(e):
    return e.select(F.col("vec_id").alias("picture"), "label", F.posexplode("embedding").alias("px", "p")).select("picture", "label", "px", F.col("p").cast("double").alias("v"))


def mosaic(spark, sf):
    """(image, x, y, v)"""
    tile = F.col("picture") % (TILES * TILES)
    return pictures(spark, sf).select(
        F.floor(F.col("picture") / (TILES * TILES)).alias("image"), (tile % TILES * SIDE + F.col("px") % SIDE).cast("long").alias("x"),
        (F.floor(tile / TILES) * SIDE + F.floor(F.col("px") / SIDE)).cast("long").alias("y"), "v",
    )


PICTURES = "pic AS (SELECT vec_id AS picture, label, i AS px, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i))"
MOSAIC = f"{PICTURES}, px AS (SELECT picture // {TILES * TILES} AS image, picture % {TILES * TILES} % {TILES} * {SIDE} + px % {SIDE} AS x, picture % {TILES * TILES} // {TILES} * {SIDE} + px // {SIDE} AS y, v FROM pic)"


def sliding_sql(reach, value="v", name="most", source="px"):
    frame = f"RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING"
    return f"row_max AS (SELECT *, max({value}) OVER (PARTITION BY image, y ORDER BY x {frame}) AS in_row FROM {source}), square AS (SELECT *, max(in_row) OVER (PARTITION BY image, x ORDER BY y {frame}) AS {name} FROM row_max)"


def k9(spark, sf):
    """Pixels over .15 that are the greatest of the five by five about them."""
    return local_maxima(mosaic(spark, sf), REACH, 0.15).select("image", "x", "y", R(F.col("v")).alias("v"))


K9_SQL = f"WITH {MOSAIC}, {sliding_sql(REACH)} SELECT image, x, y, round(v, 6) AS v FROM square WHERE v = most AND v > 0.15"


def k16(spark, sf):
    """Every pixel's greatest neighbour within twelve pixels, as the share of every tenth pixel's that lie below it."""
    near = sliding_max(mosaic(spark, sf), 12).withColumn("sampled", (F.col("y") * SIDE * TILES + F.col("x")) % 10 == 0)
    return share_below(near, ["image"], "most", F.col("sampled")).select("image", "x", "y", R(F.col("share")).alias("share"))


K16_SQL = f"""WITH {MOSAIC}, {sliding_sql(12)}, ref AS (SELECT image, most, count(*) FILTER ((y * {SIDE * TILES} + x) % 10 = 0) AS r FROM square GROUP BY ALL),
 below AS (SELECT image, most, coalesce(sum(r) OVER (PARTITION BY image ORDER BY most ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(r) OVER (PARTITION BY image) AS n FROM ref)
SELECT image, x, y, round(coalesce(b / n, 0.0), 6) AS share FROM square JOIN below USING (image, most)"""


def t3(spark, sf):
    """The first twelve peaks of each image, the seven by seven about each taken out."""
    return peaks(mosaic(spark, sf), 3, 12).select("image", "x", "y", R(F.col("v")).alias("v"), F.col("rank").cast("long").alias("rank"))


def peaks_sql(keys, reach, most, source="px"):
    near = f"len(list_filter(kept, lambda q: abs(q.x - p.x) <= {reach} AND abs(q.y - p.y) <= {reach})) = 0"
    on = " AND ".join(f"g.{k} = p.{k}" for k in keys)
    own = ", ".join(f"g.{k}" for k in keys)
    return f"""go AS (SELECT {', '.join(keys)}, 0 AS k, CAST([] AS STRUCT(v DOUBLE, x BIGINT, y BIGINT)[]) AS kept FROM (SELECT DISTINCT {', '.join(keys)} FROM {source})
 UNION ALL SELECT {own}, g.k + 1, list_append(any_value(g.kept), first({{'v': p.v, 'x': p.x, 'y': p.y}} ORDER BY p.v DESC, p.y, p.x)) FROM go g JOIN {source} p ON {on} WHERE g.k < {most} AND {near} GROUP BY {own}, g.k),
 done AS (SELECT {', '.join(keys)}, arg_max(kept, k) AS kept FROM go GROUP BY ALL), each AS (SELECT {', '.join(keys)}, unnest(range(1, len(kept) + 1)) AS rank, kept FROM done)"""


T3_SQL = f"WITH RECURSIVE {MOSAIC}, {peaks_sql(['image'], 3, 12)} SELECT image, kept[rank].x AS x, kept[rank].y AS y, round(kept[rank].v, 6) AS v, rank FROM each"


def t4(spark, sf):
    """Three peaks of every picture under each of two poses, the picture and its transpose brightened by a ramp; the five by five about a peak goes."""
    p = pictures(spark, sf).select(F.col("picture").alias("image"), (F.col("px") % SIDE).cast("long").alias("x"), F.floor(F.col("px") / SIDE).cast("long").alias("y"), "v")
    turned = p.select("image", F.lit(1).alias("pose"), F.col("y").alias("x"), F.col("x").alias("y"), (F.col("v") + F.col("y") * 0.01).alias("v"))
    both = p.select("image", F.lit(0).alias("pose"), "x", "y", "v").unionByName(turned)
    return peaks(both, 2, 3, ("image", "pose")).select("image", "pose", "x", "y", R(F.col("v")).alias("v"), F.col("rank").cast("long").alias("rank"))


T4_SQL = f"""WITH RECURSIVE {PICTURES}, p0 AS (SELECT picture AS image, CAST(px % {SIDE} AS BIGINT) AS x, CAST(px // {SIDE} AS BIGINT) AS y, v FROM pic), posed AS (SELECT image, 0 AS pose, x, y, v FROM p0 UNION ALL SELECT image, 1, y, x, v + y * 0.01 FROM p0),
 {peaks_sql(['image', 'pose'], 2, 3, 'posed')} SELECT image, pose, kept[rank].x AS x, kept[rank].y AS y, round(kept[rank].v, 6) AS v, rank FROM each"""


def k14(spark, sf):
    """Correlation of the four by four in the middle of each image's first tile with every place of the image."""
    m = mosaic(spark, sf)
    t = m.where(F.col("x").between(2, 5) & F.col("y").between(2, 5)).select("image", (F.col("x") - 2).alias("i"), (F.col("y") - 2).alias("j"), F.col("v").alias("t"))
    return correlation_scan(m, t, 4, 4).select("image", "x", "y", R(F.col("score")).alias("score"))


K14_SQL = f"""WITH {MOSAIC}, t AS (SELECT image, x - 2 AS i, y - 2 AS j, v AS t FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5),
 m AS (SELECT px.image, px.x - i AS x, px.y - j AS y, count(*) AS n, sum(v) AS s, sum(v * v) AS q, sum(v * t) AS d, sum(t) AS st, sum(t * t) AS qt FROM px JOIN t ON px.image = t.image GROUP BY ALL HAVING count(*) = 16)
SELECT image, x, y, round((d - s * st / n) / sqrt((q - s * s / n) * (qt - st * st / n)), 6) AS score FROM m"""


def s4(spark, sf):
    """The components of the pixels over .12 with two pixels or more."""
    return components(mosaic(spark, sf), F.col("v") > 0.12).select("image", "y", "x", "area", R(F.col("cx")).alias("cx"), R(F.col("cy")).alias("cy"))


S4_SQL = f"""WITH RECURSIVE {MOSAIC}, lit AS (SELECT image, x, y FROM px WHERE v > 0.12),
 reach(image, x, y, rx, ry) AS (SELECT image, x, y, x, y FROM lit UNION SELECT a.image, a.x, a.y, b.x, b.y FROM reach a JOIN lit b ON a.image = b.image AND b.x BETWEEN a.rx - 1 AND a.rx + 1 AND b.y BETWEEN a.ry - 1 AND a.ry + 1),
 root AS (SELECT image, x, y, min({{'y': ry, 'x': rx}}) AS r FROM reach GROUP BY ALL)
SELECT image, r.y AS y, r.x AS x, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM root GROUP BY image, r HAVING count(*) >= 2"""


CENTRE = (SIDE - 1) / 2
DISC = [(i, j) for j in range(-2, 3) for i in range(-2, 3) if i * i + j * j <= 4]


def poses(spark, sf):
    """(pose, n, x, y): samples of the disc under the bank's 120 poses."""
    b = bank(load(spark, sf, "embeddings").select(F.lit("all").alias("key")).limit(1))
    at = b.select(F.col("pose"), "scale", F.radians(F.col("angle").cast("double")).alias("t"), F.posexplode(F.array(*(F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j")) for i, j in DISC))).alias("n", "s"))
    c, s = F.cos("t"), F.sin("t")
    return at.select("pose", "n", (CENTRE + (F.col("s.i") * c - F.col("s.j") * s) / F.col("scale")).alias("x"), (CENTRE + (F.col("s.i") * s + F.col("s.j") * c) / F.col("scale")).alias("y"))


def k10(spark, sf):
    """The pose under which each picture looks most like its label's first one, read without turn or scale, of 120."""
    # dealt by picture once, so that the samples of a picture, 24 times its pixels, are made, summed and compared where they are; the templates are thirteen rows a label
    e = load(spark, sf, "embeddings").select("vec_id", "label", "embedding").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")
    p = as_pixels(e)
    at = poses(spark, sf)
    values = sampled(p, at, SIDE, ("picture", "label"))
    first = load(spark, sf, "embeddings").groupBy("label").agg(F.min("vec_id").alias("picture"))
    plain = sampled(pictures(spark, sf).join(F.broadcast(first.select("picture")), "picture", "left_semi"), at.where("pose = 0").select("n", "x", "y"), SIDE)
    template = F.broadcast(plain.join(first, "picture").select("label", "n", F.col("v").alias("t")))
    return best_pose(values, template, ["label"]).select("picture", F.col("pose").cast("long").alias("pose"), R(F.col("score")).alias("score"))


SCALES_SQL = "(CASE s WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.87 WHEN 3 THEN 1.15 ELSE 1.33 END)::DOUBLE"
WEIGHTS_SQL = f"""pose AS (SELECT s * 24 + a AS pose, {SCALES_SQL} AS scale, radians(a * 15.0) AS t FROM range(5) p(s), range(24) q(a)),
 disc AS (SELECT row_number() OVER (ORDER BY j, i) - 1 AS n, i, j FROM range(-2, 3) p(i), range(-2, 3) q(j) WHERE i * i + j * j <= 4),
 at AS (SELECT pose, n, {CENTRE} + (i * cos(t) - j * sin(t)) / scale AS x, {CENTRE} + (i * sin(t) + j * cos(t)) / scale AS y FROM pose, disc),
 w AS (SELECT pose, n, CAST((floor(y) + dj) * {SIDE} + floor(x) + di AS BIGINT) AS px, (CASE di WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE dj WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS weight FROM at, range(2) a(di), range(2) b(dj))"""
K10_SQL = f"""WITH {PICTURES}, {WEIGHTS_SQL.replace('at AS (', 'seen AS (').replace('FROM at,', 'FROM seen,')}, val AS (SELECT picture, label, pose, n, sum(v * weight) AS v FROM pic JOIN w USING (px) WHERE weight > 0 GROUP BY ALL),
 tpl AS (SELECT label, n, v AS t FROM val JOIN (SELECT label, min(picture) AS picture FROM pic GROUP BY label) USING (label, picture) WHERE pose = 0),
 c AS (SELECT picture, pose, count(*) AS c, sum(v) AS v, sum(t) AS t, sum(v * v) AS vv, sum(t * t) AS tt, sum(v * t) AS vt FROM val JOIN tpl USING (label, n) GROUP BY ALL)
SELECT picture, pose, round(score, 6) AS score FROM (SELECT picture, pose, round((vt - v * t / c) / sqrt((vv - v * v / c) * (tt - t * t / c)), 9) AS score FROM c) QUALIFY row_number() OVER (PARTITION BY picture ORDER BY score DESC, pose) = 1"""


RINGS, ORDERS, ANGLES = (0.6, 1.2, 1.8, 2.4, 3.0), (0, 1, 2, 3), 16


def k7(spark, sf):
    """Rings' Fourier magnitudes of every picture: five radii, orders 0 to 3, sixteen angles."""
    at = fourier_samples(spark, RINGS, ORDERS, ANGLES, CENTRE)
    basis = corners(at, SIDE).groupBy("ring", "order", "px").agg(F.sum(F.col("weight") * F.col("re")).alias("re"), F.sum(F.col("weight") * F.col("im")).alias("im"))
    h = harmonics(pictures(spark, sf).select("picture", "px", "v"), basis)
    return h.select("picture", F.col("ring").cast("long").alias("ring"), F.col("order").cast("long").alias("order"), R(F.col("value")).alias("value"))


K7_SQL = f"""WITH {PICTURES}, smp AS (SELECT r AS ring, o AS ord, {list(RINGS)}[r + 1] AS radius, 2 * pi() * a / {ANGLES} AS t FROM range({len(RINGS)}) p(r), range({len(ORDERS)}) q(o), range({ANGLES}) s(a)),
 seen AS (SELECT ring, ord, {CENTRE} + radius * cos(t) AS x, {CENTRE} + radius * sin(t) AS y, cos(ord * t) / {ANGLES} AS re, sin(ord * t) / {ANGLES} AS im FROM smp),
 b AS (SELECT ring, ord, CAST((floor(y) + dj) * {SIDE} + floor(x) + di AS BIGINT) AS px, (CASE di WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE dj WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS weight, re, im FROM seen, range(2) a(di), range(2) c(dj)),
 h AS (SELECT picture, ring, ord, CASE ord WHEN 0 THEN sum(v * weight * re) ELSE sqrt(sum(v * weight * re) ** 2 + sum(v * weight * im) ** 2) END AS size FROM pic JOIN b USING (px) GROUP BY picture, ring, ord),
 z AS (SELECT picture, ring, ord, CASE ord WHEN 0 THEN size - avg(size) FILTER (ord = 0) OVER (PARTITION BY picture) ELSE size END AS size FROM h)
SELECT picture, ring, ord AS "order", round(size / greatest(1e-6, sqrt(sum(size * size) OVER (PARTITION BY picture))), 6) AS value FROM z"""


def k6(spark, sf):
    """Polar means of every picture: eight radii read at each of five scales, 64 angles each, less their mean and of unit length by scale."""
    rings = tuple((s, r * 0.28) for s in (0.75, 0.87, 1.0, 1.15, 1.33) for r in range(8))
    at = fourier_samples(spark, tuple(r / s for s, r in rings), (0,), 64, CENTRE)
    weights = corners(at, SIDE).groupBy("ring", "px").agg(F.sum(F.col("weight") * F.col("re")).alias("w"))
    means = pictures(spark, sf).join(weights, "px").groupBy("picture", "ring").agg(F.sum(F.col("v") * F.col("w")).alias("m")).select("picture", F.floor(F.col("ring") / 8).alias("scale"), (F.col("ring") % 8).cast("long").alias("radius"), "m")
    own = Window.partitionBy("picture", "scale")  # eight rows
    c = means.withColumn("m", F.col("m") - F.avg("m").over(own))
    return c.select("picture", "scale", "radius", R(F.col("m") / F.greatest(F.lit(1e-6), F.sqrt(F.sum(F.col("m") * F.col("m")).over(own)))).alias("value"))


K6_SQL = f"""WITH {PICTURES}, smp AS (SELECT s AS scale, r AS radius, r * 0.28 / (CASE s WHEN 0 THEN 0.75 WHEN 1 THEN 0.87 WHEN 2 THEN 1.0 WHEN 3 THEN 1.15 ELSE 1.33 END)::DOUBLE AS far, 2 * pi() * a / 64 AS t FROM range(5) p(s), range(8) q(r), range(64) u(a)),
 seen AS (SELECT scale, radius, {CENTRE} + far * cos(t) AS x, {CENTRE} + far * sin(t) AS y FROM smp),
 b AS (SELECT scale, radius, CAST((floor(y) + dj) * {SIDE} + floor(x) + di AS BIGINT) AS px, (CASE di WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE dj WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) / 64 AS weight FROM seen, range(2) a(di), range(2) c(dj)),
 m AS (SELECT picture, scale, radius, sum(v * weight) AS m FROM pic JOIN b USING (px) GROUP BY ALL), z AS (SELECT picture, scale, radius, m - avg(m) OVER (PARTITION BY picture, scale) AS m FROM m)
SELECT picture, scale, radius, round(m / greatest(1e-6, sqrt(sum(m * m) OVER (PARTITION BY picture, scale))), 6) AS value FROM z"""


QUERIES = {
    "k9_local_maxima": (k9, K9_SQL), "k16_auxiliary_share": (k16, K16_SQL), "t3_raster_peaks": (t3, T3_SQL), "t4_peaks_by_pose": (t4, T4_SQL), "k14_correlation_scan": (k14, K14_SQL),
    "s4_components": (s4, S4_SQL), "k10_j3_best_pose": (k10, K10_SQL), "k7_harmonics": (k7, K7_SQL), "k6_polar_means": (k6, K6_SQL),
}
