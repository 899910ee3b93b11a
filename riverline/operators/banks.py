"""Banks and levels: checks and repair along a reference line, crossings, levels that never rise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverline.operators.planar import Line, bank_offsets, hits, edges
from riverline.operators.search import jumps

#: Share and metres of an excursion, widths against their running median, length ratios.
EXCURSION_SHARE, EXCURSION, WIDTH_LOW, WIDTH_HIGH = 0.25, 30.0, 0.5, 2.0
RATIO_LOW, RATIO_HIGH = 0.5, 1.5
KINDS = ("missing", "side", "jump", "excursion", "width")


def running_median(values: np.ndarray, half: int) -> np.ndarray:
    """Of known values in a centred window that shrinks at the ends."""
    padded = np.pad(values, half, constant_values=np.nan)
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
    out = np.full(len(values), np.nan)
    some = np.isfinite(windows).any(axis=1)
    out[some] = np.nanmedian(windows[some], axis=1)
    return out


def bank_checks(off: np.ndarray, step: float, near: float = 250.0, wide: float = 500.0, jump: float = 50.0) -> dict[str, np.ndarray]:
    """Flags of each station from its (left, right) offsets: a bank missing, banks on the wrong sides, a jump, an excursion from the running median, a width far from its own."""
    left, right = off.T
    known = np.isfinite(off).all(axis=1)
    out = {"missing": ~known, "side": known & (left <= right)}
    good = np.where((known & ~out["side"])[:, None], off, np.nan)
    half = max(1, round(near / 2 / step))
    out["jump"] = jumps(good[:, 0], jump) | jumps(-good[:, 1], jump)
    away = np.zeros(len(off), bool)
    for bank in good.T:
        median = running_median(np.abs(bank), half)
        with np.errstate(invalid="ignore"):
            away |= np.abs(np.abs(bank) - median) > np.maximum(EXCURSION, EXCURSION_SHARE * median)
    out["excursion"] = away
    width = good[:, 0] - good[:, 1]
    median = running_median(width, max(1, round(wide / 2 / step)))
    with np.errstate(invalid="ignore"):
        out["width"] = (width < WIDTH_LOW * median) | (width > WIDTH_HIGH * median)
    return out


def repaired(off: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Offsets with straight lines between good stations in place of bad ones; beyond the outermost good ones nothing changes."""
    out, at = off.copy(), np.arange(len(off))
    for k in (0, 1):
        good = np.flatnonzero(~bad & np.isfinite(off[:, k]))
        if len(good) > 1:
            inner = (at > good[0]) & (at < good[-1])
            new = np.interp(at, good, off[good, k])
            out[:, k] = np.where(inner & (bad | ~np.isfinite(off[:, k])), new, off[:, k])
    return out


def check_and_repair(left, right, seed, step: float, rounds: int = 4, **limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, flags by station and kind): checks and repairs until nothing is flagged, `rounds` times at most; the first flags are kept."""
    xy = Line(seed).even(step)
    line = Line(xy)
    d = line.direction(line.along, step)
    n = np.stack([-d[:, 1], d[:, 0]], axis=1)
    off = bank_offsets(xy, left, right)
    flags = None
    for _ in range(rounds):
        found = bank_checks(off, step, **limits)
        bad = np.any(list(found.values()), axis=0)
        flags = np.stack([found[k] for k in KINDS], axis=1) if flags is None else flags
        if not bad.any():
            break
        off = repaired(off, bad)
    keep = np.isfinite(off).all(axis=1)
    return xy[keep] + off[keep, :1] * n[keep], xy[keep] + off[keep, 1:] * n[keep], flags


def crossing_points(a, b) -> np.ndarray:
    """Where two lines meet, in the order of the first."""
    a = np.asarray(a, float)
    out = []
    for p, q in zip(a, a[1:]):
        size = np.hypot(*(q - p))
        if size:
            t = hits(p[None], ((q - p) / size)[None], *edges([b]))[0]
            out += [p + v * (q - p) / size for v in np.sort(t[(t >= 0) & (t <= size)])]
    return np.array(out).reshape(-1, 2)


def untangled(left, right, clearance: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Banks that no longer cross: between two crossings both run `clearance` apart beside their common middle. Also how many pieces changed."""
    left, right = np.asarray(left, float), np.asarray(right, float)
    meet, pieces = crossing_points(left, right), 0
    for p, q in zip(meet[::2], meet[1::2]):
        one, two = Line(left), Line(right)
        cuts = [sorted((float(line.project([p])[0][0]), float(line.project([q])[0][0]))) for line in (one, two)]
        share = np.linspace(0, 1, 9)
        middle = sum(line.at(a + share * (b - a)) for line, (a, b) in zip((one, two), cuts)) / 2
        whole = Line(middle)
        d = whole.direction(whole.along, max(whole.length / 8, 1e-9))
        n = np.stack([-d[:, 1], d[:, 0]], axis=1) * clearance / 2
        margin = 2 * clearance
        left, right = (
            np.concatenate([line.slice(0, max(0.0, a - margin))[:-1], middle + k * n, line.slice(min(line.length, b + margin), line.length)[1:]]) for line, (a, b), k in zip((one, two), cuts, (1, -1))
        )
        pieces += 1
    return left, right, pieces


def sanity(route: float, left, right, centre) -> list[str]:
    """What is wrong with surveyed lines: lengths outside RATIO_LOW to RATIO_HIGH of the route's, banks that cross."""
    out = []
    for name, points in (("left_bank_length", left), ("right_bank_length", right), ("centreline_length", centre)):
        if not RATIO_LOW <= Line(points).length / route <= RATIO_HIGH:
            out.append(name)
    return out + (["banks_cross"] if len(crossing_points(left, right)) else [])


def merged_stretches(one: DataFrame, other: DataFrame, key: str = "line_id") -> DataFrame:
    """Union of stretches (key, a, b, rank, width), overlapping or touching ones one: of the highest rank and the least width."""
    every = one.unionByName(other)
    order = Window.partitionBy(key).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = every.withColumn("__new", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("__g", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "__g").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("rank").alias("rank"), F.min("width").alias("width")).drop("__g")


def never_rising_across_joins(points: DataFrame, measured: Column, key: str = "line_id", at: str = "chainage", value: str = "level", name: str = "fixed") -> DataFrame:
    """Levels downstream along `at`: measured ones (water) never rise, the others (terrain) are kept between the measured ones about them."""
    order = Window.partitionBy(key).orderBy(at)
    so_far, rest = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    d = points.withColumn("__m", F.min(F.when(measured, F.col(value))).over(so_far)).withColumn("__w", F.when(measured, F.col("__m")))
    d = d.withColumn("__hi", F.last("__w", True).over(so_far)).withColumn("__lo", F.first("__w", True).over(rest))
    low = F.greatest(F.col(value), F.coalesce("__lo", F.col(value)))
    # above both is cut to the upper one, which counts first
    inner = F.when(F.col(value) > F.col("__hi"), F.col("__hi")).otherwise(low)
    return d.withColumn(name, F.coalesce("__w", inner)).drop("__m", "__w", "__hi", "__lo")


def low_levels(readings: DataFrame, least_count: int = 3, least_width: float = 100.0, share: float = 0.1, worst_quality: int = 1) -> DataFrame:
    """(reach, level, n): a low percentile of good readings (reach, wse, width, quality) of reaches that have enough of them."""
    good = readings.where((F.col("width") >= least_width) & (F.col("quality") <= worst_quality) & F.col("wse").isNotNull())
    return good.groupBy("reach").agg(F.percentile("wse", F.lit(share)).alias("level"), F.count("*").alias("n")).where(F.col("n") >= least_count)
