"""Sequence operators along lines: windows keyed by line and ordered by vertex.

Tables have line_id and idx; each operator adds columns or returns runs. A line is one partition of its windows, so
lines are the unit of parallelism; missing values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverline.functions.formulas import wrapped

def ordered():
    return Window.partitionBy("line_id").orderBy("idx")


def whole():
    return Window.partitionBy("line_id")


def so_far():
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def ahead():
    return ordered().rowsBetween(0, Window.unboundedFollowing)


def rows(before: int, after: int):
    return ordered().rowsBetween(-before, after)


def lag(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(ordered())


def lead(c: str, n: int = 1) -> Column:
    return F.lead(c, n).over(ordered())


def segment_length() -> Column:
    dx, dy = F.col("x") - lag("x"), F.col("y") - lag("y")
    return F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))


def chainages(line: DataFrame, name: str = "along") -> DataFrame:
    return line.withColumn("__d", segment_length()).withColumn(name, F.sum("__d").over(so_far())).drop("__d")


def three_points(stride: int = 1) -> tuple[Column, Column]:
    """(cross product, product of side lengths) of each vertex with those `stride` before and after."""
    ax, ay, cx, cy = lag("x", stride), lag("y", stride), lead("x", stride), lead("y", stride)
    bx, by = F.col("x"), F.col("y")
    side = lambda ux, uy, vx, vy: F.sqrt((vx - ux) * (vx - ux) + (vy - uy) * (vy - uy))
    return (bx - ax) * (cy - ay) - (cx - ax) * (by - ay), side(ax, ay, bx, by) * side(bx, by, cx, cy) * side(ax, ay, cx, cy)


def curvature(line: DataFrame, name: str = "kappa") -> DataFrame:
    """Signed curvature 2 * cross / product of sides; 0 where that product vanishes; ends copy their neighbours."""
    cross, sides = three_points()
    inner = line.withColumn("__k", F.when(sides >= 1e-9, 2 * cross / sides).when(sides.isNotNull(), 0.0))
    return inner.withColumn(name, F.coalesce("__k", lead("__k"), lag("__k"), F.lit(0.0))).drop("__k")


def radius(line: DataFrame, stride: int = 1, name: str = "radius") -> DataFrame:
    """Circumradius over +-stride; null at ends and on straights."""
    cross, sides = three_points(stride)
    return line.withColumn(name, F.when((sides > 0) & (F.abs(cross) > 1e-12), sides / (2 * F.abs(cross))))


def local_radius(line: DataFrame, stride: int = 2, around: int = 2, name: str = "radius") -> DataFrame:
    """Circumradius over +-stride, averaged where known over +-around vertices."""
    return radius(line, stride, "__r").withColumn(name, F.avg("__r").over(rows(around, around))).drop("__r")


def rolling_radius_by_distance(line: DataFrame, window: float, name: str = "mean_radius") -> DataFrame:
    frame = f"(PARTITION BY line_id ORDER BY chainage RANGE BETWEEN {float(window)}D PRECEDING AND {float(window)}D FOLLOWING)"
    return line.withColumn(name, F.expr(f"avg(CASE WHEN radius > 0 THEN radius END) OVER {frame}"))


def rolling_radius_by_samples(line: DataFrame, window: float, spacing: float, name: str = "mean_radius") -> DataFrame:
    k = max(0, round(window / spacing))
    return line.withColumn(name, F.avg(F.when(F.col("radius") > 0, F.col("radius"))).over(rows(k, k)))


def turn_angles(line: DataFrame, name: str = "turn") -> DataFrame:
    before = F.atan2(F.col("y") - lag("y"), F.col("x") - lag("x"))
    after = F.atan2(lead("y") - F.col("y"), lead("x") - F.col("x"))
    return line.withColumn(name, F.coalesce(wrapped(after - before), F.lit(0.0)))


def cumulative_turn(line: DataFrame) -> DataFrame:
    return turn_angles(line).groupBy("line_id").agg(F.degrees(F.sum(F.abs("turn"))).alias("turn_deg"))


def unwrap(line: DataFrame, angle: str, name: str = "unwrapped") -> DataFrame:
    """Add whole turns so that neighbours differ by less than half a turn."""
    step = F.col(angle) - lag(angle)
    return line.withColumn("__c", F.coalesce(wrapped(step) - step, F.lit(0.0))).withColumn(name, F.col(angle) + F.sum("__c").over(so_far())).drop("__c")


def fill_missing(line: DataFrame, value: str, name: str = "filled") -> DataFrame:
    """Linear by index between known values, nearest beyond the ends, 0 where nothing is known."""
    known = F.when(F.col(value).isNotNull(), F.col("idx"))
    d = line.withColumn("__i0", F.last(known, True).over(so_far())).withColumn("__i1", F.first(known, True).over(ahead()))
    d = d.withColumn("__v0", F.last(value, True).over(so_far())).withColumn("__v1", F.first(value, True).over(ahead()))
    inside = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col("idx") - F.col("__i0")) / (F.col("__i1") - F.col("__i0"))
    return d.withColumn(name, F.coalesce(F.col(value), inside, "__v0", "__v1", F.lit(0.0))).drop("__i0", "__i1", "__v0", "__v1")


def rolling_percentile(line: DataFrame, value: str, samples: int, q: float, name: str = "low") -> DataFrame:
    """Type-7 percentile of known values in a centred window that shrinks at the ends."""
    return line.withColumn(name, F.percentile(value, F.lit(q)).over(rows(samples // 2, samples // 2)))


def overall_bottom(line: DataFrame, value: str, spacing: float, q: float, low_m: float, mean_m: float, name: str = "bottom") -> DataFrame:
    """Filled, low rolling percentile, wide rolling mean, then never falling along the line."""
    half = lambda m: max(1, round(m / spacing)) // 2
    d = rolling_percentile(fill_missing(line, value, "__f"), "__f", 2 * half(low_m), q, "__p")
    d = d.withColumn("__m", F.avg("__p").over(rows(half(mean_m), half(mean_m))))
    return d.withColumn(name, F.max("__m").over(so_far())).drop("__f", "__p", "__m")


def moving_average(line: DataFrame, value: str, window: int, name: str = "smooth") -> DataFrame:
    """Odd window; beyond the ends the end values repeat, so they weigh once per missing place."""
    h = window // 2
    d = line.withColumn("__n", F.count("*").over(whole())).withColumn("__a", F.first(value).over(ordered())).withColumn("__z", F.last(value).over(whole().orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    before, after = F.greatest(F.lit(0), h - F.col("idx")), F.greatest(F.lit(0), F.col("idx") + h + 1 - F.col("__n"))
    return d.withColumn(name, (F.sum(value).over(rows(h, h)) + before * F.col("__a") + after * F.col("__z")) / (2 * h + 1)).drop("__n", "__a", "__z")


def binomial(line: DataFrame, value: str, passes: int, name: str = "smooth") -> DataFrame:
    """[1 4 6 4 1] / 16 with repeated ends, `passes` times."""
    d = line.withColumn(name, F.col(value))
    for _ in range(passes):
        first, last = F.first(name).over(ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(name).over(ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        total = F.coalesce(lag(name, 2), first) + 4 * F.coalesce(lag(name), first) + 6 * F.col(name) + 4 * F.coalesce(lead(name), last) + F.coalesce(lead(name, 2), last)
        d = d.withColumn("__s", total / 16).drop(name).withColumnRenamed("__s", name)
    return d


def chaikin(line: DataFrame, passes: int) -> DataFrame:
    """Corner cutting: each segment gives its quarter points; the ends stay."""
    d = line.select("line_id", "idx", "x", "y")
    for _ in range(passes):
        point = lambda t: F.struct((F.col("x") + (lead("x") - F.col("x")) * t).alias("x"), (F.col("y") + (lead("y") - F.col("y")) * t).alias("y"))
        own = F.struct("x", "y")
        pair = F.when(lead("x").isNull(), F.array(own)).when(lag("x").isNull(), F.array(own, point(0.25), point(0.75))).otherwise(F.array(point(0.25), point(0.75)))
        d = d.withColumn("__p", pair).select("line_id", "idx", F.posexplode("__p").alias("k", "p"))
        d = d.select("line_id", (F.row_number().over(Window.partitionBy("line_id").orderBy("idx", "k")) - 1).cast("long").alias("idx"), "p.x", "p.y")
    return d


def runs(line: DataFrame, key: Column, *aggs: Column, least: int = 1) -> DataFrame:
    """Maximal runs of consecutive vertices with one key; null keys belong to none."""
    d = line.withColumn("__k", key)
    change = F.when(F.col("__k").eqNullSafe(F.lag("__k").over(ordered())), 0).otherwise(1)
    d = d.withColumn("__c", change).withColumn("__run", F.sum("__c").over(so_far())).where(F.col("__k").isNotNull())
    found = d.groupBy("line_id", "__run").agg(F.first("__k").alias("key"), F.min("idx").alias("i0"), F.max("idx").alias("i1"), F.count("*").alias("n"), *aggs)
    return found.where(F.col("n") >= least).drop("__run")


def curvature_runs(line: DataFrame, least: int = 3) -> DataFrame:
    """Runs of one curvature sign; |kappa| under 1e-6 breaks a run."""
    sign = F.when(F.abs("kappa") >= 1e-6, F.signum("kappa"))
    return runs(line, sign, F.min("radius").alias("least_radius"), F.min_by("chainage", F.struct(F.coalesce("radius", F.lit(1e300)), "idx")).alias("apex"), least=least)


def meander_runs(line: DataFrame, most: float, least: int = 3) -> DataFrame:
    return curvature_runs(line, least).where(F.col("least_radius") <= most)


def meanders(line: DataFrame, most: float, least: int = 3) -> DataFrame:
    """Meander runs numbered along each line."""
    found = meander_runs(line, most, least)
    return found.withColumn("number", F.row_number().over(Window.partitionBy("line_id").orderBy("i0")).cast("long"))


def resampled(line: DataFrame, step: float, ends: str) -> DataFrame:
    """Points every `step` along each line. ends: "floor" (i * step), "exact" (the same, the line's very end dropped), "ceil" (whole line in even parts, three at least), "frame" (even parts, floor)."""
    d = chainages(line).withColumn("__x1", lead("x")).withColumn("__y1", lead("y")).withColumn("__s1", lead("along"))
    total = F.max("along").over(whole())
    count = {"floor": F.floor(total / step) + 1, "exact": F.ceil((total + 1e-9) / step), "ceil": F.greatest(F.ceil(total / step) + 1, F.lit(3)), "frame": F.floor(total / step) + 1}[ends]
    d = d.withColumn("__t", total).withColumn("__n", count.cast("long"))
    spacing = F.lit(float(step)) if ends in ("floor", "exact") else F.when(F.col("__n") > 1, F.col("__t") / (F.col("__n") - 1)).otherwise(F.lit(float(step)))
    d = d.withColumn("__h", spacing).where("__s1 > along")
    # a segment owns the samples from its start up to its end, the last one also the line's end
    last = F.col("__s1") == F.col("__t")
    first = F.ceil(F.col("along") / F.col("__h")).cast("long")
    final = F.when(last, F.least(F.col("__n") - 1, F.floor(F.col("__s1") / F.col("__h") + 1e-9).cast("long"))).otherwise(F.ceil(F.col("__s1") / F.col("__h")).cast("long") - 1)
    d = d.withColumn("k", F.explode(F.when(final >= first, F.sequence(first, final)).otherwise(F.array().cast("array<bigint>"))))
    share = (F.col("k") * F.col("__h") - F.col("along")) / (F.col("__s1") - F.col("along"))
    return d.select("line_id", "k", (F.col("k") * F.col("__h")).alias("s"), (F.col("x") + share * (F.col("__x1") - F.col("x"))).alias("px"), (F.col("y") + share * (F.col("__y1") - F.col("y"))).alias("py"))


def climbs(line: DataFrame, value: str = "z") -> DataFrame:
    """Ascent and descent over known values only."""
    step = F.col(value) - lag(value)
    d = line.where(F.col(value).isNotNull()).withColumn("__d", step)
    return d.groupBy("line_id").agg(F.coalesce(F.sum(F.when(F.col("__d") > 0, F.col("__d"))), F.lit(0.0)).alias("ascent"), F.coalesce(F.sum(F.when(F.col("__d") < 0, F.col("__d"))), F.lit(0.0)).alias("descent"))


def running_median(line: DataFrame, value: str, window: int, name: str = "median") -> DataFrame:
    """Centred odd window, end values repeated: the padded values are gathered in index order, at most `window` of them."""
    h = window // 2
    every = ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = F.collect_list(value).over(rows(h, h))
    d = line.withColumn("__l", near).withColumn("__n", F.count("*").over(whole())).withColumn("__a", F.first(value).over(every)).withColumn("__z", F.last(value).over(every))
    before, after = F.greatest(F.lit(0), h - F.col("idx")).cast("int"), F.greatest(F.lit(0), F.col("idx") + h + 1 - F.col("__n")).cast("int")
    padded = F.concat(F.array_repeat("__a", before), F.col("__l"), F.array_repeat("__z", after))
    return d.withColumn(name, F.element_at(F.sort_array(padded), h + 1)).drop("__l", "__n", "__a", "__z")


def upper_median(group: DataFrame, key: str, value: str, name: str = "median") -> DataFrame:
    """The value at rank n div 2 (from 0), not the mean of the middle pair."""
    w = Window.partitionBy(key).orderBy(value)
    ranked = group.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    return ranked.where(F.col("__r") == F.floor(F.col("__n") / 2)).select(key, F.col(value).alias(name))


def merged_intervals(spans: DataFrame, key: str = "line_id") -> DataFrame:
    """Union of overlapping or touching [a, b] intervals."""
    w = Window.partitionBy(key).orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = spans.withColumn("__new", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "__g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("__g")


def stitched(starts: DataFrame, end: Column) -> DataFrame:
    """Each start ends where the next begins, the last at `end`."""
    return starts.withColumn("stop", F.coalesce(F.lead("start").over(Window.partitionBy("line_id").orderBy("start")), end))


def offset_bounds(line: DataFrame, least: float) -> DataFrame:
    """Lateral window in which a shifted line keeps the least radius: bounded on the inside of each bend."""
    r = F.col("radius")
    inner = F.greatest(F.lit(0.0), r - least)
    return line.withColumn("low", F.when(F.col("kappa") < 0, -inner)).withColumn("high", F.when(F.col("kappa") > 0, inner))
