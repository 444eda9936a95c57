"""Exact nearest triangles and quads of scenes for those of patterns, without a table of the scenes' shapes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shapes import CHUNK, MOST_CHUNKS, all_shapes, nearest_shapes
from ..sources.tables import checkpointed

SOUGHT = 4000  # nodes of patterns whose shapes a task looks for, about
DIGITS = 9  # to which distances are compared


def shape_neighbours(patterns: DataFrame, points: DataFrame, corners: int, k: int) -> DataFrame:
    """(a_order, b_order, k, d): the ``k`` shapes of all scenes nearest to each shape of every pattern, by distance to nine digits and then by name: scene and ids in order of vertex, joined by hyphens.

    Both are (scene, id, x, y), of any number of points. A task makes the shapes of its patterns and its share of all scenes' shapes, these in steps, and holds the nearest alone. So what is stored are
    the points and the result; the time is that of all shapes, once for each block of patterns.
    """
    nodes = checkpointed(patterns.select(F.col("scene").cast("string").alias("name"), F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    own = checkpointed(points.select(F.col("scene").cast("string").alias("scene"), F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    at_least = 2 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(at_least, -(-nodes.count() // SOUGHT))
    n = F.col("n").cast("double")
    shapes = n * (n - 1) * (n - 2) / 6 if corners == 3 else n * (n - 1) * (n - 2) * (n - 3) / 24
    made = own.groupBy("scene").agg(F.count("*").alias("n")).agg(F.sum(shapes)).first()[0] or 0.0
    chunks = int(min(MOST_CHUNKS, max(1, -(-made // (8 * CHUNK)))))

    def seek(key: tuple, f: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        names, forms = [], []
        for name, rows in f.sort_values(["name", "id"], kind="stable").groupby("name", sort=False):
            at = rows["id"].to_numpy()
            vertices, form = all_shapes(rows[["x", "y"]].to_numpy(), corners, corners == 3)
            forms.append(form)
            names += ["-".join((name, *map(str, ids))) for ids in at[vertices].tolist()]
        wanted = np.concatenate(forms) if forms else np.empty((0, 2 if corners == 3 else 4))
        which, d, there, within = np.empty(0, np.int64), np.empty(0), np.empty(0, object), None
        for scene, rows in other.sort_values(["scene", "id"], kind="stable").groupby("scene", sort=True):
            at = rows["id"].to_numpy().astype(str).astype(object)
            rank = np.empty(len(at), np.int64)
            rank[np.argsort(at, kind="stable")] = np.arange(len(at))
            w, ids, gap = nearest_shapes(wanted, rows[["x", "y"]].to_numpy(), k, corners, key[1], chunks, corners == 3, rank, DIGITS, within)
            order = np.lexsort((np.arange(len(which) + len(w)), np.round(np.concatenate([d, gap]), DIGITS), np.concatenate([which, w])))  # scenes come in order of name
            label = np.array(["-".join((scene, *i)) for i in at[ids].tolist()], object)
            which, d, there = (np.concatenate(c)[order] for c in ((which, w), (d, gap), (there, label)))
            keep = np.arange(len(which)) - np.searchsorted(which, which) < k
            which, d, there = which[keep], d[keep], there[keep]
            n_of, most = np.bincount(which, minlength=len(wanted)), np.zeros(len(wanted))
            np.maximum.at(most, which, d)
            within = np.where(n_of >= k, most, np.inf)
        return pd.DataFrame({"a_order": np.array(names, object)[which], "b_order": there, "k": np.arange(len(which)) - np.searchsorted(which, which) + 1, "d": d})

    every = lambda number, name: F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias(name)
    left = nodes.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")).select("*", every(chunks, "chunk"))
    right = own.select("*", every(blocks, "block")).select("*", every(chunks, "chunk"))
    sides = [df.repartition(min(4 * blocks * chunks, 4096), "block", "chunk").groupBy("block", "chunk") for df in (left, right)]
    found = sides[0].cogroup(sides[1]).applyInPandas(seek, "a_order string, b_order string, k long, d double")
    if chunks > 1:
        rank = F.row_number().over(Window.partitionBy("a_order").orderBy(F.round("d", DIGITS), "b_order"))
        found = found.withColumn("k", rank.cast("long")).where(F.col("k") <= k)
    return found
