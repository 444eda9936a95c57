"""Grids and combinations as table functions: rows that a key's rows call for are made beside them, in the task of their partition."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Scales of the pose bank; its angles lie 15 degrees apart.
SCALES, ANGLES = (1.0, 0.75, 0.87, 1.15, 1.33), 24


@udtf(returnType="key string, pose int, scale double, angle int")
class PoseGrid:
    """All poses of the bank for each key: numbered by scale, then angle; pose 0 neither turns nor scales."""

    def __init__(self) -> None:
        self.key: str | None = None
        self.met = False

    def eval(self, row) -> Iterator[tuple]:
        self.key, self.met = None if row["key"] is None else str(row["key"]), True
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        if self.met:
            for s, scale in enumerate(SCALES):
                for a in range(ANGLES):
                    yield self.key, s * ANGLES + a, scale, a * 360 // ANGLES


@udtf(returnType="key string, ids array<long>")
class Combinations:
    """All combinations of ``size`` ids of a key, each in order of id. A key's ids are held, so they must be capped: n make n^size / size! rows."""

    def __init__(self) -> None:
        self.key: str | None = None
        self.ids: list[int] = []
        self.size = 0

    def eval(self, row) -> Iterator[tuple]:
        self.key, self.size = None if row["key"] is None else str(row["key"]), row["size"]
        if row["id"] is not None:
            self.ids.append(row["id"])
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        for own in itertools.combinations(sorted(set(self.ids)), self.size) if self.size else ():
            yield self.key, list(own)


def bank(keys: DataFrame) -> DataFrame:
    """(key, pose, scale, angle): the pose bank of each ``key``."""
    return PoseGrid(keys.asTable().partitionBy("key"))


def combinations(rows: DataFrame) -> DataFrame:
    """(key, ids): combinations of each key's ids; ``rows``: (key, id, size)."""
    return Combinations(rows.asTable().partitionBy("key"))


def fourier_samples(spark: SparkSession, rings: tuple, orders: tuple, angles: int, centre: float) -> DataFrame:
    """(ring, order, x, y, re, im): samples on rings of the given radii about the centre, with their share of each order's Fourier term."""
    ring = F.posexplode(F.array(*map(F.lit, rings))).alias("ring", "radius")
    rows = spark.range(1).select(ring).select("*", F.explode(F.array(*map(F.lit, orders))).alias("order")).select("*", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("k"))
    t = 2 * math.pi * F.col("k") / angles
    return rows.select("ring", "order", (centre + F.col("radius") * F.cos(t)).alias("x"), (centre + F.col("radius") * F.sin(t)).alias("y"), (F.cos(F.col("order") * t) / angles).alias("re"), (F.sin(F.col("order") * t) / angles).alias("im"))
