"""Image scans: scenes, patches and reference diagrams as rows of arrays."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels


def write_png(path: str, pixels: np.ndarray) -> None:
    """A grey (h, w) or RGBA (h, w, 4) PNG."""
    h, w = pixels.shape[:2]
    rows = b"".join(b"\0" + pixels[i].astype(np.uint8).tobytes() for i in range(h))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 6 if pixels.ndim == 3 else 0, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def scan(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, height, width, channels, data) of all images of a glob; data in rows, BGR(A) where there is colour."""
    i = spark.read.format("image").option("dropInvalid", "true").load(pattern)
    return i.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def checked(images: DataFrame, height: int, width: int) -> DataFrame:
    """``images``; reading fails at one of another size."""
    right = (F.col("height") == height) & (F.col("width") == width)
    return images.where(F.when(right, True).otherwise(F.raise_error(F.concat(F.lit("wrong size: "), "path")).cast("boolean")))


def scene_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/(?:patches/)?[^/]+$", 1)


def scenes(spark: SparkSession, root: str, size: int = 3000) -> DataFrame:
    """(scene, data, ...) of each folder's one ``*_image.png``; reading fails where a folder has several."""
    s = checked(scan(spark, f"{root}/*/*_image.png"), size, size).withColumn("scene", scene_name(F.col("path")))
    n = s.groupBy("scene").agg(F.count("*").alias("n"))
    return s.join(n, "scene").where(F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("several images: "), "scene")).cast("boolean"))).drop("n")


def patches(spark: SparkSession, root: str, counts: DataFrame | None = None) -> DataFrame:
    """(scene, query, data, ...) of ``patches/patch_NN.png``; with ``counts`` (scene, n_patches) only the first of each scene."""
    p = checked(scan(spark, f"{root}/*/patches/patch_*.png"), 32, 32)
    p = p.withColumns({"scene": scene_name(F.col("path")), "query": F.regexp_extract("path", r"patch_(\d+)\.png$", 1).cast("int")})
    return p if counts is None else p.join(counts, "scene").where("query BETWEEN 1 AND n_patches").drop("n_patches")


def pixels(row_data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(row_data, np.uint8).reshape(height, width, channels)
    return a[..., 0] if channels == 1 else a


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """(name, node, x, y): the marks of each ``<name>_pattern.png``."""

    def give(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                a = pixels(r.data, r.height, r.width, r.channels)
                for k, (x, y) in enumerate(kernels.diagram_nodes(a[..., [2, 1, 0, 3]])):
                    rows.append((r.name, k, float(x), float(y)))
            yield pd.DataFrame(rows, columns=["name", "node", "x", "y"])

    named = scan(spark, f"{root}/*_pattern.png").withColumn("name", F.regexp_extract("path", r"([^/]+)_pattern\.png$", 1))
    return named.select("name", "height", "width", "channels", "data").mapInPandas(give, "name string, node int, x double, y double")


def inventory(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, sha256, first_path): the hash of each image's pixels and the first path with the same."""
    i = scan(spark, pattern).select("path", F.sha2("data", 256).alias("sha256"))
    return i.join(i.groupBy("sha256").agg(F.min("path").alias("first_path")), "sha256").select("path", "sha256", "first_path")


def auxiliary(scene_rows: DataFrame) -> DataFrame:
    """(scene, height, width, image): each sky's auxiliary map, as the recogniser takes it; worth keeping with ``results.cached``."""

    def give(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            maps = [kernels.auxiliary_map(pixels(r.data, r.height, r.width, r.channels).astype(float)).astype(np.float32).tobytes() for r in f.itertuples()]
            yield pd.DataFrame({"scene": f["scene"], "height": f["height"], "width": f["width"], "image": maps})

    kind = scene_rows.schema["scene"].dataType.simpleString()
    return scene_rows.select("scene", "height", "width", "channels", "data").mapInPandas(give, f"scene {kind}, height int, width int, image binary")


def candidates(scene_rows: DataFrame, patch_rows: DataFrame, keep: int = 20, budget: int = 1000, adaptive: bool = False, refined: bool = True, representation: str = "blur", dense: bool = False) -> DataFrame:
    """(scene, query, pos, x, y, score, angle, scale): retrieval by two indexes, verification and refinement of every patch.

    Patches are grouped by scene and a few parts, so that each task builds a scene's indexes once for many patches.
    """
    parts = patch_rows.withColumn("part", F.pmod("query", F.lit(4)))

    def find(key: tuple, own: pd.DataFrame, image: pd.DataFrame) -> pd.DataFrame:
        names = ["scene", "query", "pos", "x", "y", "score", "angle", "scale"]
        if own.empty or image.empty:
            return pd.DataFrame(columns=names)
        i = image.iloc[0]
        sky = pixels(i["data"], i["height"], i["width"], i["channels"]).astype(float)
        radial, harmonic = kernels.radial_index(sky), kernels.harmonic_index(sky)
        rows = []
        for r in own.itertuples():
            patch = pixels(r.data, r.height, r.width, r.channels).astype(float)
            tried = [kernels.retrieve(*radial, kernels.radial_query(patch), budget)[:, :2], kernels.retrieve(*harmonic, kernels.harmonics(kernels.blur(patch, 0.6), np.array([[15.5, 15.5]])), 2 * budget)[:, :2]]
            if dense:
                tried.append(kernels.dense_search(sky, patch))
            found = kernels.verify(sky, patch, np.unique(np.concatenate(tried), axis=0), keep, adaptive=adaptive, representation=representation)
            if refined:
                found = sorted((kernels.refine(sky, patch, f) for f in found), key=lambda f: -f[2])
            rows += [(r.scene, r.query, k, *map(float, f)) for k, f in enumerate(found)]
        return pd.DataFrame(rows, columns=names)

    sky = scene_rows.select("scene", "height", "width", "channels", "data", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part"))
    own = parts.select("scene", "query", "height", "width", "channels", "data", "part")
    return own.groupBy("scene", "part").cogroup(sky.groupBy("scene", "part")).applyInPandas(find, "scene string, query int, pos int, x double, y double, score double, angle double, scale double")
