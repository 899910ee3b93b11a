"""Cross-sections, pools, chunks, rasters and rules as aggregates. Sums are exact decimals before they become doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverline.functions.formulas import cut_face
from riverline.operators.joins import small
from riverline.operators.search import per_line

#: Fixed values of the cut model: intrusion that calls for a bench, sustained run, depth bands.
INTRUDES, DAYLIGHT_RUN, BANDS = 2.0, 15.0, 40


def exact(c: Column, scale: int = 6) -> Column:
    return F.sum(c.cast(f"decimal(28,{scale})")).cast("double")


def bench_gate(samples: DataFrame, hb: Column, wl: Column, depth: Column, slope: Column) -> DataFrame:
    """(station, side, bench): ground above the water line intrudes the prism by more than INTRUDES."""
    edge = hb + slope * depth
    first = F.min(F.when((F.col("z") > wl) & (F.col("off") <= edge), F.col("off")))
    return samples.groupBy("station", "side").agg(F.coalesce(F.first(edge) - first > INTRUDES, F.lit(False)).alias("bench"))


def faces(samples: DataFrame, hb: Column, wl: Column, depth: Column, slope: Column) -> DataFrame:
    """samples with bench and face: the design surface of model A, null where nothing is cut."""
    w = Window.partitionBy("station", "side")
    edge = hb + slope * depth
    first = F.min(F.when((F.col("z") > wl) & (F.col("off") <= edge), F.col("off"))).over(w)
    d = samples.withColumn("bench", F.coalesce(edge - first > INTRUDES, F.lit(False)))
    return d.withColumn("face", cut_face(F.col("off"), F.col("bench"), hb, wl - depth, wl, depth, slope))


def daylight_limits(faced: DataFrame, edge: Column, run_m: float = DAYLIGHT_RUN) -> DataFrame:
    """faced with `limit`: start of the first stretch beyond the prism where ground stays at or under the face for run_m; gaps in the ground count."""
    side = Window.partitionBy("station", "side").orderBy("off", "k")
    d = faced.withColumn("__o", F.when(F.col("off") > edge, F.col("off")))
    lit = F.col("z").isNull() | F.col("face").isNull() | (F.col("z") <= F.col("face"))
    d = d.withColumn("__b", F.sum(F.when(F.col("__o").isNotNull() & ~lit, 1).otherwise(0)).over(side.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min(F.when(F.col("__o").isNotNull() & lit, F.col("__o"))).over(Window.partitionBy("station", "side", "__b"))
    d = d.withColumn("__s", start).withColumn("__l", F.when(F.col("__o").isNotNull() & lit & (F.col("__o") - F.col("__s") >= run_m), F.col("__s")))
    return d.withColumn("limit", F.min("__l").over(Window.partitionBy("station", "side"))).drop("__o", "__b", "__s", "__l")


def section_areas(faced: DataFrame, wl: Column, dx: float = 1.0) -> DataFrame:
    """(station, dredge, excav, face_h) over samples within the limit, if there is a column `limit`."""
    cut = F.col("z") - F.col("face")
    inside = (cut > 0) & (F.coalesce(F.col("off") <= F.col("limit"), F.lit(True)) if "limit" in faced.columns else F.lit(True))
    area = F.when(inside, cut * dx)
    return faced.groupBy("station").agg(
        F.coalesce(exact(F.when(F.col("wet"), area)), F.lit(0.0)).alias("dredge"), F.coalesce(exact(F.when(~F.col("wet"), area)), F.lit(0.0)).alias("excav"),
        F.coalesce(F.max(F.when(inside & (F.col("z") > wl), F.col("z") - wl)), F.lit(0.0)).alias("face_h"),
    )


def totals(areas: DataFrame, step: float, *keys: str) -> DataFrame:
    d, e = exact(F.col("dredge") * step), exact(F.col("excav") * step)
    return areas.groupBy(*keys).agg(d.alias("dredge"), e.alias("excav"), (d + e).alias("total"), F.coalesce(F.max("face_h"), F.lit(0.0)).alias("face_h"))


def depth_bands(cells: DataFrame, key: str, cut: str, bands: int = BANDS) -> DataFrame:
    """(key, band, volume): what each metre of depth holds of the cut."""
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(cut) - F.col("band")))
    d = cells.where(F.col(cut) > 0).groupBy(key, cut).agg(F.count("*").alias("__n"))  # equal cuts are one row before bands multiply them
    return d.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).groupBy(key, "band").agg(exact(part * F.col("__n")).alias("volume"))


def pool_volumes(cells: DataFrame, key: str, deep: float) -> DataFrame:
    """(key, n, volume, deep_volume, most, mean) of positive cuts."""
    c = F.when(F.col("cut") > 0, F.col("cut"))
    return cells.groupBy(key).agg(F.count(c).alias("n"), F.coalesce(exact(c), F.lit(0.0)).alias("volume"), F.coalesce(exact(F.when(c > deep, c)), F.lit(0.0)).alias("deep_volume"), F.max(c).alias("most"), (exact(c) / F.count(c)).alias("mean"))


def stretches(stations: DataFrame, kind: Column, deficit: Column) -> DataFrame:
    """Runs of consecutive failing stations of one kind: i0, i1, n, the worst station and its deficit (first wins)."""
    from riverline.operators.line import runs

    d = stations.withColumn("__deficit", deficit)
    worst = F.max_by(F.struct("idx", "__deficit"), F.struct("__deficit", -F.col("idx"))).alias("worst")
    return runs(d, kind, worst, exact(F.coalesce("z", F.lit(0.0))).alias("volume")).select("line_id", F.col("key").alias("kind"), "i0", "i1", "n", F.col("worst.idx").alias("worst"), F.col("worst.__deficit").alias("deficit"), "volume")


def decimated(cells: DataFrame, k: int) -> DataFrame:
    """Means of k x k blocks; null if any cell of a block is missing or not there."""
    g = cells.groupBy("raster_id", F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col"))
    return g.agg(F.when(F.count("z") == k * k, F.sum("z") / (k * k)).alias("z"))


def despiked(cells: DataFrame, size: int, reach: int = 2, k: float = 4.0, floor: float = 3.0) -> DataFrame:
    """Hampel filter on (2 * reach + 1) squared windows of size x size tiles, edge cells repeated, upper median; columns z, spike. A tile is one array of a task."""
    n = (2 * reach + 1) ** 2

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        z = np.full((size, size), np.nan)
        z[p.row, p["col"]] = p.z
        near = np.lib.stride_tricks.sliding_window_view(np.pad(z, reach, mode="edge"), (2 * reach + 1, 2 * reach + 1)).reshape(size, size, n)
        median = np.sort(near, axis=2)[:, :, n // 2]
        spread = np.sort(np.abs(near - median[:, :, None]), axis=2)[:, :, n // 2]
        spike = np.abs(z - median) > np.maximum(floor, k * 1.4826 * spread)
        found = np.where(spike, median, z)
        return pd.DataFrame({"raster_id": p.raster_id, "row": p.row, "col": p["col"], "z": found[p.row, p["col"]], "spike": spike[p.row, p["col"]]})

    return per_line(cells.select("raster_id", "row", "col", "z"), "raster_id long, row long, col long, z double, spike boolean", solve, "raster_id", "row")


def governing(rules: DataFrame, objects: DataFrame, applies: Column) -> DataFrame:
    """(object, measure, limit, rule): the strictest lower bound of the rules that apply; the least rule id of equals."""
    hit = objects.join(small(rules, "the rule table"), applies)
    return hit.groupBy("object", "measure").agg(F.max("limit").alias("limit"), F.max_by("rule", F.struct("limit", -F.col("rule"))).alias("rule"))


def otsu(values: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """(cut, variance): the bin edge of greatest between-class variance of `v`, the least of equals."""
    width = (high - low) / bins
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("v") - low) / width))).cast("int")
    h = values.groupBy(b.alias("b")).agg(F.count("*").alias("n"))
    h = h.withColumn("s", F.col("n") * F.col("b"))
    # at most `bins` rows from here on
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = h.withColumn("n0", F.sum("n").over(w)).withColumn("s0", F.sum("s").over(w)).withColumn("n1", F.sum("n").over(every) - F.col("n0")).withColumn("s1", F.sum("s").over(every) - F.col("s0"))
    v = F.col("n0") * F.col("n1") * F.pow(F.col("s0") / F.col("n0") - F.col("s1") / F.col("n1"), F.lit(2))
    best = d.where("n1 > 0").withColumn("variance", v).groupBy().agg(F.max_by(F.struct("b", "variance"), F.struct("variance", -F.col("b"))).alias("x"))
    return best.select((low + (F.col("x.b") + 1) * width).alias("cut"), F.col("x.variance").alias("variance"))


def composite(scenes: DataFrame) -> DataFrame:
    """(raster_id, row, col, state, rank): the best-ranked scene that knows a pixel."""
    return scenes.groupBy("raster_id", "row", "col").agg(F.min_by("state", F.when(F.col("state").isNotNull(), F.col("rank"))).alias("state"), F.min(F.when(F.col("state").isNotNull(), F.col("rank"))).alias("rank"))
