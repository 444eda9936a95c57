"""Synthetic scenes whose truth is known, the same on any partitioning: each key seeds its own generator."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sparquill.functions.kernels import bilinear, blur

CANDIDATES = "scene long, query int, pos int, x double, y double, score double"


def keyed(seed: int, *parts) -> np.random.Generator:
    """A generator of its own for each key."""
    return np.random.default_rng([seed, *(crc32(str(p).encode()) for p in parts)])


def place(nodes: np.ndarray, rng: np.random.Generator, size: int = 3000) -> np.ndarray:
    """Nodes under a random rotation, mild shear, reflection and scale, inside a scene."""
    unit = (nodes - nodes.mean(axis=0)) / np.maximum(np.ptp(nodes, axis=0), 1e-6)
    t, s = rng.uniform(0, 2 * np.pi), rng.uniform(700, 1400)
    turn = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]) @ np.diag([s, s * rng.uniform(0.8, 1.2) * rng.choice([-1, 1])])
    out = unit @ turn.T
    low, high = 60 - out.min(axis=0), size - 60 - out.max(axis=0)
    return out + rng.uniform(np.minimum(low, high), np.maximum(low, high))


def scene_rows(seed: int, scene: int, catalog: dict[str, np.ndarray], hit: float = 0.75, clutter: int = 12, k: int = 20, error: float = 4.0) -> tuple[str, list[tuple]]:
    """A scene's class and its ranked candidates: with a chance ``hit`` the first one of a figure's query is right, else a later one
    is; other queries see clutter."""
    rng = keyed(seed, scene)
    name = sorted(catalog)[int(rng.integers(len(catalog)))]
    true = place(catalog[name], rng) + rng.normal(0, error, (len(catalog[name]), 2))
    where = [*map(tuple, true), *map(tuple, rng.uniform(60, 2940, (clutter, 2)))]
    rows = []
    for q, at in enumerate(where):
        right = 0 if rng.random() < hit else int(rng.integers(1, 8))
        scores = np.sort(rng.uniform(0.6, 0.97, k))[::-1]
        if right:
            scores[: right + 1] = scores[0] - np.arange(right + 1) * 0.002
        for pos in range(k):
            x, y = at if pos == right else rng.uniform(60, 2940, 2)
            rows.append((scene, q, pos, float(x), float(y), float(scores[pos])))
    return name, rows


def scenes(spark: SparkSession, seed: int, n: int, catalog: dict[str, np.ndarray], **options) -> DataFrame:
    """Candidates of n scenes."""

    def give(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for s in f["id"] for r in scene_rows(seed, int(s), catalog, **options)[1]]
            yield pd.DataFrame(rows, columns=["scene", "query", "pos", "x", "y", "score"])

    return spark.range(n).mapInPandas(give, CANDIDATES)


def render(points: np.ndarray, rng: np.random.Generator, size: int, moffat: bool = False) -> np.ndarray:
    """A sky with a smooth background and noise and a Gaussian or Moffat source at each point."""
    y, x = np.mgrid[:size, :size]
    sky = 20 + 4 * np.sin(2 * np.pi * (x * rng.uniform(0.3, 1) + y * rng.uniform(0.3, 1)) / size) + rng.normal(0, 1.5, (size, size))
    for px, py in points:
        r2, width, peak = (x - px) ** 2 + (y - py) ** 2, rng.uniform(1.2, 2.2), rng.lognormal(4, 0.4)
        sky += peak * ((1 + r2 / width**2) ** -2.5 if moffat else np.exp(-r2 / (2 * width**2)))
    return np.clip(sky, 0, 255)


def degraded(sky: np.ndarray, x: float, y: float, angle: float, scale: float, rng: np.random.Generator | None = None, sigma: float = 0.0, gain: float = 1.0, offset: float = 0.0, noise: float = 0.0) -> np.ndarray:
    """The 32-pixel patch about (x, y): turned, scaled, blurred, with another gain, offset and noise. Fails outside the sky."""
    j, i = np.mgrid[:32, :32] - 15.5
    t = np.radians(angle)
    px, py = x + scale * (np.cos(t) * i + np.sin(t) * j), y + scale * (-np.sin(t) * i + np.cos(t) * j)
    if px.min() < 0 or py.min() < 0 or px.max() > sky.shape[1] - 1 or py.max() > sky.shape[0] - 1:
        raise ValueError("the patch leaves the sky")
    out = gain * bilinear(sky, px, py) + offset
    out = blur(out, sigma) if sigma else out
    return out + rng.normal(0, noise, out.shape) if noise and rng is not None else out
