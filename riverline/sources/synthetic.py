"""Made rivers with known answers: a sine river with its terrain, and water shapes for checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def river(spark: SparkSession, length: float = 6000.0, wave: float = 1500.0, amplitude: float = 260.0, width: float = 40.0, step: float = 10.0) -> DataFrame:
    """(idx, x, y, left_x, left_y, right_x, right_y): a sine centreline with its banks along the normals."""
    n = int(np.ceil((length + step) / step))
    turn = 2 * np.pi / wave
    d = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * step).alias("x")).withColumn("y", amplitude * F.sin(turn * F.col("x")))
    slope = amplitude * turn * F.cos(turn * F.col("x"))
    size = F.sqrt(1 + slope * slope)
    nx, ny = -slope / size, 1 / size
    return d.select("idx", "x", "y", *((c + sign * width / 2 * v).alias(f"{side}_{name}") for side, sign in (("left", 1), ("right", -1)) for name, c, v in (("x", F.col("x"), nx), ("y", F.col("y"), ny))))


def terrain(x: Column, y: Column, off: Column, half: float = 20.0, level: float = 0.0, fall: float = 1e-4, depth: float = 3.0, flood: float = 3.0, hill: tuple[float, float, float, float] = (1875.0, 150.0, 15.0, 120.0)) -> Column:
    """Height at distance `off` from the centreline: a parabolic bed, a gently rising plain beside it, and a hill on the plain."""
    water = level + fall * x
    share = off / half
    hx, hy, height, reach = hill
    rise = height * F.exp(-((x - hx) * (x - hx) + (y - hy) * (y - hy)) / (2 * reach * reach))
    return F.when(off < half, water - depth * (1 - share * share)).otherwise(water + flood + 0.002 * (off - half) + rise)


def closed(points) -> np.ndarray:
    return np.array([*points, points[0]], float)


def canal(length: float, width: float, jitter: float, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(water, line): a straight canal and a line that strays from its middle but for its ends."""
    h = width / 2
    water = closed([(-width, -h), (length + width, -h), (length + width, h), (-width, h)])
    n = max(1, int(np.ceil(length / 100)))
    y = np.random.default_rng(seed).uniform(-jitter, jitter, n + 1)
    y[[0, -1]] = 0
    return [water], np.stack([length * np.arange(n + 1) / n, y], axis=1)


def narrowing(wide: float, narrow: float, length: float = 3000.0, taper_in: tuple = (900.0, 1000.0), taper_out: tuple = (1500.0, 1600.0)) -> tuple[list[np.ndarray], np.ndarray]:
    """Wide water that narrows on the way in and widens on the way out, and its straight middle."""
    x = [-wide, *taper_in, *taper_out, length + wide]
    h = np.array([wide, wide, narrow, narrow, wide, wide]) / 2
    return [closed([*zip(x, -h), *zip(x[::-1], h[::-1])])], np.array([[0.0, 0.0], [length, 0.0]])


def basin(leg: float, corner: float, outer: float = 200.0) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Water of a right-angled bend with an inner corner, and its two legs."""
    far = leg + outer
    water = closed([(-outer, -far), (corner, -far), (corner, -corner), (far, -corner), (far, outer), (-outer, outer)])
    return [water], [np.array([[0.0, -leg], [0.0, 0.0]]), np.array([[0.0, 0.0], [leg, 0.0]])]


def basin_radius(corner: float, clearance: float) -> float:
    """The largest radius that turns the basin's corner with that clearance."""
    return (1 + np.sqrt(2)) * (np.sqrt(2) * corner - clearance)
