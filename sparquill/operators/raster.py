"""Pictures as rows of pixels (image, x, y, v): sliding maxima, peaks, box sums, correlation scans, samples under poses, descriptors, components.

An image is never gathered: windows go along pixel rows and columns, in tiles of ``TILE`` pixels that hold their neighbours' edge, and everything else is joins on places.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .rounds import connected, first_kept

TILE = 512


def along(pixels: DataFrame, axis: str, reach: int, made: dict[str, Column | Callable], keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """``pixels`` with aggregates over the places up to ``reach`` to either side along an axis. Each tile of a row is a window of its own and has the ``reach`` pixels
    on either side beside its own, so a wide row is no large group."""
    other = "y" if axis == "x" else "x"
    tile = F.floor(F.col(axis) / TILE)
    seen = F.array_distinct(F.array(F.floor((F.col(axis) - reach) / TILE), tile, F.floor((F.col(axis) + reach) / TILE)))
    w = Window.partitionBy(*keys, other, "__tile").orderBy(axis).rangeBetween(-reach, reach)
    rows = pixels.withColumn("__tile", F.explode(seen)).withColumns({name: f.over(w) for name, f in made.items()})
    return rows.where(F.col("__tile") == tile).drop("__tile")


def sliding_max(pixels: DataFrame, reach: int, value: str = "v", name: str = "most", keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """``pixels`` with the greatest value in the square of ``reach`` pixels to every side, as far as there are pixels; first along rows, then along columns.
    The image must have all of its pixels; a null value is none."""
    return along(along(pixels, "x", reach, {"__row": F.max(value)}, keys), "y", reach, {name: F.max("__row")}, keys).drop("__row")


def local_maxima(pixels: DataFrame, reach: int, threshold: float) -> DataFrame:
    """The pixels over ``threshold`` that are the greatest of their square; equal ones all."""
    return sliding_max(pixels, reach).where((F.col("v") == F.col("most")) & (F.col("v") > threshold)).drop("most")


def peaks(pixels: DataFrame, reach: int, most: int, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """(keys, x, y, v, rank): the first ``most`` pixels that are left when going from the greatest on, ties by y and x, and taking out the square about each taken one.

    A pixel that is the greatest of its square is taken, whatever happens elsewhere. Where an image has ``most`` of these, no pixel after the last of them in order can be among the first ``most``, nor
    take out one that is; so the raster is looked at once, and what goes on are the few pixels as great, with those of them that lie in each other's squares as pairs, settled in rounds. An image with fewer greatest
    pixels keeps all of its pixels, each with its square's. Null and NaN pixels are never taken.
    """
    first = F.when(F.col("v").isNotNull() & ~F.isnan("v"), F.struct(F.col("v").alias("v"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x")))
    best = sliding_max(pixels.select(*keys, "x", "y", first.alias("__first")), reach, "__first", "__most", keys).where("__first IS NOT NULL")
    best = checkpointed(best.select(*keys, "x", "y", "__first", (F.col("__first") == F.col("__most")).alias("__new")))
    order = Window.partitionBy(*keys).orderBy(F.desc("__first"))
    last = best.where("__new").withColumn("k", F.row_number().over(order)).where(F.col("k") == most)
    last = last.select(*(F.col(k).alias(f"__of_{k}") for k in keys), F.col("__first").alias("__last"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys))
    id_of = F.struct((-F.col("__first.v")).alias("v"), "y", "x").alias("id")  # ascends as pixels are gone through
    live = checkpointed(best.join(last, same, "left").where("__last IS NULL OR __first >= __last").select(F.struct(*keys).alias("__key"), id_of, "x", "y"))  # a struct is never null, though a key in it may be
    cell = lambda c: F.floor(F.col(c) / (reach + 1))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    other = live.select("__key", F.col("id").alias("second"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.explode(steps).alias("s"), cell("x").alias("cx"), cell("y").alias("cy"))
    other = other.withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j")}).drop("s")
    met = live.withColumns({"cx": cell("x"), "cy": cell("y")}).join(other, ["__key", "cx", "cy"])
    met = met.where((F.abs(F.col("x") - F.col("__x")) <= reach) & (F.abs(F.col("y") - F.col("__y")) <= reach) & (F.col("id") < F.col("second")))
    kept = first_kept(live, ["__key"], met.select("__key", F.col("id").alias("first"), "second"))
    taken = kept.select(*(F.col(f"__key.{k}").alias(k) for k in keys), F.col("id.x").alias("x"), F.col("id.y").alias("y"), (-F.col("id.v")).alias("v"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("v"), "y", "x"))
    return taken.withColumn("rank", rank).where(F.col("rank") <= most)


def box_sums(pixels: DataFrame, wide: int, high: int, values: dict[str, Column]) -> DataFrame:
    """(image, x, y and the sum of each value) over the boxes of ``wide`` x ``high`` pixels that begin at (x, y) and lie inside: differences of summed-area tables.

    The tables are prefix sums along rows and then along columns. Pixels must be dense; a box that leaves the image has no row.
    """
    row, column = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    sums = pixels.select("image", "x", "y", *(v.alias(k) for k, v in values.items()))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({k: F.sum(k).over(up_to(row)) for k in values})
    sums = sums.withColumns({k: F.sum(k).over(up_to(column)) for k in values})
    sums = sums.withColumns({k: F.col(k) - F.coalesce(F.lag(k, wide).over(row), F.lit(0.0)) for k in values} | {"__x": F.row_number().over(row)})
    sums = sums.withColumns({k: F.col(k) - F.coalesce(F.lag(k, high).over(column), F.lit(0.0)) for k in values} | {"__y": F.row_number().over(column)})
    inside = sums.where((F.col("__x") >= wide) & (F.col("__y") >= high))
    return inside.select("image", (F.col("x") - (wide - 1)).alias("x"), (F.col("y") - (high - 1)).alias("y"), *values)


def correlation_scan(pixels: DataFrame, template: DataFrame, wide: int, high: int) -> DataFrame:
    """(image, x, y, score): the normalised correlation of each image's template with every box of its size; 0 where either is flat.

    ``template``: (image, i, j, t), ``wide`` x ``high`` values. Means and norms of the boxes come from summed-area tables; the products are a join of pixels with
    the template's few values, summed by place.
    """
    own = template.groupBy("image").agg(F.avg("t").alias("m"), F.sqrt(F.sum(F.col("t") * F.col("t")) - F.sum("t") * F.sum("t") / F.count("t")).alias("norm"))
    centred = template.join(own, "image").select("image", "i", "j", (F.col("t") - F.col("m")).alias("t"))
    hits = pixels.join(centred, "image").groupBy("image", (F.col("x") - F.col("i")).alias("x"), (F.col("y") - F.col("j")).alias("y")).agg(F.sum(F.col("v") * F.col("t")).alias("dot"))
    v = F.col("v")
    boxes = box_sums(pixels, wide, high, {"s": v.cast("double"), "q": (v * v).cast("double")})
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / (wide * high)))
    score = F.when((spread > 1e-9) & (F.col("norm") > 1e-9), F.col("dot") / (spread * F.col("norm"))).otherwise(0.0)
    return boxes.join(hits, ["image", "x", "y"]).join(own, "image").select("image", "x", "y", score.alias("score"))


def corners(samples: DataFrame, side: int) -> DataFrame:
    """``samples`` (x, y and others) as the four pixels about each with their bilinear weights: px = y * side + x, weight. Samples must lie in the picture; an edge's outer pixels weigh nothing and are left out."""
    x, y = F.floor("x"), F.floor("y")
    fx, fy = F.col("x") - x, F.col("y") - y
    parts = [F.struct(((y + j) * side + x + i).cast("int").alias("px"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("weight")) for j in (0, 1) for i in (0, 1)]
    return samples.withColumn("__c", F.explode(F.array(*parts))).select(*(c for c in samples.columns if c not in ("x", "y")), "__c.px", "__c.weight").where("weight > 0")


def sampled(pictures: DataFrame, samples: DataFrame, side: int, own: tuple[str, ...] = ("picture",)) -> DataFrame:
    """(own, the samples' own columns, v): bilinear values of every picture at every sample. ``pictures``: (own, px, v), ``own`` being picture and what goes with it."""
    weights = corners(samples, side)
    keys = [c for c in weights.columns if c not in ("px", "weight")]
    return pictures.join(F.broadcast(weights), "px").groupBy(*own, *keys).agg(F.sum(F.col("v") * F.col("weight")).alias("v"))


def best_pose(values: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    """(picture, pose, score): of the poses of each picture the one whose samples correlate best with its template's, ties by pose. ``values``: (picture, keys, pose, n, v); ``template``: (keys, n, t)."""
    s = F.sum
    met = values.join(template, [*keys, "n"]).groupBy("picture", "pose").agg(F.count("*").alias("c"), s("v").alias("v"), s("t").alias("t"), s(F.col("v") * F.col("v")).alias("vv"), s(F.col("t") * F.col("t")).alias("tt"), s(F.col("v") * F.col("t")).alias("vt"))
    norm = F.sqrt(F.greatest(F.lit(0.0), F.col("vv") - F.col("v") * F.col("v") / F.col("c")) * F.greatest(F.lit(0.0), F.col("tt") - F.col("t") * F.col("t") / F.col("c")))
    score = F.when(norm > 1e-12, (F.col("vt") - F.col("v") * F.col("t") / F.col("c")) / norm).otherwise(0.0)
    rows = met.select("picture", "pose", F.round(score, 9).alias("score"))
    return rows.groupBy("picture").agg(F.max(F.struct("score", (-F.col("pose")).alias("p"))).alias("m")).select("picture", (-F.col("m.p")).alias("pose"), F.col("m.score").alias("score"))


def harmonics(pictures: DataFrame, basis: DataFrame) -> DataFrame:
    """(picture, ring, order, value): magnitudes of the angular Fourier coefficients on rings, order 0 less its mean over rings, the whole of unit length.

    ``basis``: (ring, order, px, re, im), the sums of sampling weights and Fourier terms over a ring's samples; so a picture is joined with it once, and folded.
    """
    parts = pictures.join(basis, "px").groupBy("picture", "ring", "order").agg(F.sum(F.col("v") * F.col("re")).alias("re"), F.sum(F.col("v") * F.col("im")).alias("im"))
    size = F.when(F.col("order") == 0, F.col("re")).otherwise(F.hypot("re", "im"))
    parts = parts.withColumn("size", size)
    whole = Window.partitionBy("picture")  # a picture's few coefficients
    parts = parts.withColumn("size", F.when(F.col("order") == 0, F.col("size") - F.avg(F.when(F.col("order") == 0, F.col("size"))).over(whole)).otherwise(F.col("size")))
    return parts.select("picture", "ring", "order", (F.col("size") / F.greatest(F.lit(1e-6), F.sqrt(F.sum(F.col("size") * F.col("size")).over(whole)))).alias("value"))


def runs(pixels: DataFrame, lit: Column) -> DataFrame:
    """(run, image, y, x0, x1): unbroken runs of lit pixels in a row, named by their first pixel."""
    row = Window.partitionBy("image", "y").orderBy("x")
    rows = pixels.where(lit).withColumn("gap", F.col("x") - F.row_number().over(row))
    found = rows.groupBy("image", "y", "gap").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return found.select(F.struct("image", "y", F.col("x0").alias("x")).alias("run"), "image", "y", "x0", "x1")


def components(pixels: DataFrame, lit: Column, least_area: int = 2) -> DataFrame:
    """(image, y, x, area, cx, cy): the components of lit pixels, neighbours being the eight about a pixel, of ``least_area`` pixels or more; each by its first pixel, with its centroid.

    Pixel rows are cut into runs; runs of adjacent rows that touch are joined, which is all that has to be known across rows, tiles or tasks. Images without lit pixels have no rows.
    """
    own = checkpointed(runs(pixels, lit))
    # a run of the next row touches if it begins before this one's end + 1 and ends after its start - 1; cells of a tile's width make it an equal join
    cell = lambda c: F.floor(F.col(c) / TILE)
    spread = own.withColumn("cell", F.explode(F.sequence(F.floor((F.col("x0") - 1) / TILE), F.floor((F.col("x1") + 1) / TILE))))
    below = own.select(F.col("run").alias("b"), "image", (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.explode(F.sequence(cell("x0"), cell("x1"))).alias("cell"))
    touch = spread.join(below, ["image", "y", "cell"]).where("b0 <= x1 + 1 AND b1 >= x0 - 1").select(F.col("run").alias("a"), "b").distinct()
    of = connected(own.select(F.col("run").alias("id")), touch)
    n = F.col("x1") - F.col("x0") + 1
    sums = own.join(of, own["run"] == of["id"]).groupBy("root").agg(F.sum(n).alias("area"), F.sum((F.col("x0") + F.col("x1")) / 2.0 * n).alias("sx"), F.sum(F.col("y") * n).alias("sy"))
    return sums.where(F.col("area") >= least_area).select("root.image", "root.y", "root.x", "area", (F.col("sx") / F.col("area")).alias("cx"), (F.col("sy") / F.col("area")).alias("cy"))
