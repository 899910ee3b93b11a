"""Joins that the engine needs beyond equality: as-of, interval, point in polygon, nearest, segment crossings.

Range predicates become equalities on bucket columns plus an exact test, so they shuffle by bucket and never compare all
with all. As-of joins are one union and one window, keyed by line where there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a side that is broadcast; checked before it is.
BROADCAST_ROWS = 200_000


def small(table: DataFrame, what: str) -> DataFrame:
    """`table` with a broadcast hint, after a count: more than BROADCAST_ROWS rows are refused."""
    if table.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"{what} is meant to be small")
    return F.broadcast(table)


def if_small(table: DataFrame) -> DataFrame:
    """`table` with a broadcast hint if it has at most BROADCAST_ROWS rows, else as it is."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def as_of(left: DataFrame, right: DataFrame, at: str, start: str, value: str, keys: list[str], default: Column | None = None, name: str | None = None) -> DataFrame:
    """The value of the last right row with start <= at, by keys; `default` before the first. Of equal starts the greatest value holds."""
    name = name or value
    marks = right.groupBy(*keys, start).agg(F.max(value).alias("__v"))
    both = left.withColumn("__t", F.col(at)).withColumn("__o", F.lit(1)).unionByName(marks.select(*keys, F.col(start).alias("__t"), "__v", F.lit(0).alias("__o")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__f", F.last("__v", True).over(w)).where("__o = 1")
    return found.withColumn(name, F.coalesce("__f", default) if default is not None else F.col("__f")).drop("__t", "__o", "__v", "__f")


def interpolated(left: DataFrame, right: DataFrame, at: str, start: str, value: str, keys: list[str], name: str = "level") -> DataFrame:
    """Linear between points, flat beyond the ends, the later of two points at one place holds from there on."""
    marks = right.select(*keys, F.col(start).alias("__t"), F.col(value).alias("__v"), F.col("ord").alias("__ord"))
    both = left.withColumn("__t", F.col(at)).withColumn("__q", F.lit(1)).unionByName(marks.withColumn("__q", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("__t", "__q", F.coalesce("__ord", F.lit(0)))
    point = F.when(F.col("__q") == 0, F.struct("__t", "__v"))
    back = F.last(point, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(point, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    d = both.withColumn("__a", back).withColumn("__b", ahead).where("__q = 1")
    inner = F.col("__a.__v") + (F.col("__b.__v") - F.col("__a.__v")) * (F.col(at) - F.col("__a.__t")) / (F.col("__b.__t") - F.col("__a.__t"))
    return d.withColumn(name, F.when(F.col("__a").isNull(), F.col("__b.__v")).when(F.col("__b").isNull(), F.col("__a.__v")).otherwise(inner)).drop("__t", "__q", "__v", "__ord", "__a", "__b")


def within(points: DataFrame, spans: DataFrame, at: str, a: str, b: str, width: float, how: str = "inner", closed: bool = False) -> DataFrame:
    """points joined to the spans that hold them: [a, b), or [a, b] if closed. A span goes to each bucket of `width` it meets; few spans are broadcast."""
    spread = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    test = (F.col(at) >= F.col(a)) & ((F.col(at) <= F.col(b)) if closed else (F.col(at) < F.col(b)))
    dealt = points.withColumn("__p", F.floor(F.col(at) / width))
    return dealt.join(if_small(spread), (F.col("__p") == F.col("__b")) & test, how).drop("__p", "__b")


def overlapping(spans: DataFrame, others: DataFrame, width: float, test: Column) -> DataFrame:
    """Pairs of (a, b) and (c, d) intervals that pass `test`, which must imply that they meet; each pair once."""
    left = spans.withColumn("__k", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))))
    right = others.withColumn("__l", F.explode(F.sequence(F.floor(F.col("c") / width), F.floor(F.col("d") / width))))
    first = F.greatest(F.floor(F.col("a") / width), F.floor(F.col("c") / width))
    return left.join(right, (F.col("__k") == F.col("__l")) & (F.col("__k") == first) & test).drop("__k", "__l")


def inside(points: DataFrame, edges: DataFrame, height: float) -> DataFrame:
    """points (x, y, ...) with `inside`: strictly inside the polygon of edges (poly, x1, y1, x2, y2), even-odd; the boundary is outside.

    Edges go to the horizontal strips they meet, points to one; a point counts the edges that cross to its right. Few edges are
    broadcast as one list a strip and counted in the point's own row; many are joined, and crossings summed before the points' shuffle.
    """
    strip = lambda c: F.floor(c / height)
    spread = edges.withColumn("__s", F.explode(F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))))

    def tests(e) -> tuple[Column, Column]:
        x1, y1, x2, y2 = (e(c) for c in ("x1", "y1", "x2", "y2"))
        x, y = F.col("x"), F.col("y")
        cross = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        on = (cross == 0) & y.between(F.least(y1, y2), F.greatest(y1, y2)) & x.between(F.least(x1, x2), F.greatest(x1, x2))
        right = ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0)))
        return F.coalesce(right, F.lit(False)), on

    dealt = points.withColumn("__p", strip(F.col("y")))
    if spread.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        lists = spread.groupBy("__s").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("__e"))
        d = dealt.join(F.broadcast(lists), F.col("__p") == F.col("__s"), "left")
        count = F.size(F.filter("__e", lambda e: tests(lambda c: e[c])[0]))
        edge = F.exists("__e", lambda e: tests(lambda c: e[c])[1])
        return d.withColumn("inside", F.when(F.col("__e").isNull(), False).otherwise((count % 2 == 1) & ~edge)).drop("__p", "__s", "__e")
    right, on = tests(F.col)
    hits = dealt.withColumn("__id", F.monotonically_increasing_id()).join(spread, F.col("__p") == F.col("__s"), "left").groupBy("__id", *points.columns).agg(F.sum(right.cast("int")).alias("__n"), F.max(on).alias("__on"))
    return hits.withColumn("inside", (F.coalesce("__n", F.lit(0)) % 2 == 1) & ~F.coalesce("__on", F.lit(False))).drop("__id", "__n", "__on")


def nearest_on_lines(points: DataFrame, segments: DataFrame, reach: float, keys: list[str] | None = None) -> DataFrame:
    """points (pid, px, py) with the nearest segment (sid, ax, ay, bx, by) of the same keys within `reach`: pid, sid, share, dist; the least sid wins ties."""
    keys = keys or []
    from riverline.functions.formulas import share_on_segment

    cell = lambda c: F.floor(F.col(c) / reach)
    span = lambda p, q: F.explode(F.sequence(F.least(cell(p), cell(q)) - 1, F.greatest(cell(p), cell(q)) + 1))
    spread = segments.withColumn("__cx", span("ax", "bx")).withColumn("__cy", span("ay", "by"))
    dealt = points.withColumn("__px", cell("px")).withColumn("__py", cell("py"))
    d = dealt.withColumnsRenamed({"__px": "__cx", "__py": "__cy"}).join(spread, [*keys, "__cx", "__cy"])
    d = d.withColumn("share", share_on_segment(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by"))))
    dx, dy = F.col("ax") + F.col("share") * (F.col("bx") - F.col("ax")) - F.col("px"), F.col("ay") + F.col("share") * (F.col("by") - F.col("ay")) - F.col("py")
    d = d.withColumn("dist", F.sqrt(dx * dx + dy * dy)).where(F.col("dist") <= reach)
    return d.groupBy(*keys, "pid").agg(F.min_by(F.struct("sid", "share", "dist"), F.struct("dist", "sid")).alias("h")).select(*keys, "pid", "h.*")


def crossings(segments: DataFrame, others: DataFrame, cell: float, keys: list[str] | None = None) -> DataFrame:
    """Proper and touching meetings of segments (sid, ax..by) and others (oid, cx, cy, dx, dy) of the same keys: sid, oid, t, u."""
    keys = keys or []
    box = lambda lo, hi: F.sequence(F.floor(F.least(lo, hi) / cell), F.floor(F.greatest(lo, hi) / cell))
    left = segments.withColumn("__i", F.explode(box("ax", "bx"))).withColumn("__j", F.explode(box("ay", "by")))
    right = others.withColumn("__i", F.explode(box("cx", "dx"))).withColumn("__j", F.explode(box("cy", "dy")))
    rx, ry, sx, sy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("dx") - F.col("cx"), F.col("dy") - F.col("cy")
    det = rx * sy - ry * sx
    t = ((F.col("cx") - F.col("ax")) * sy - (F.col("cy") - F.col("ay")) * sx) / F.nullif(det, F.lit(0.0))
    u = ((F.col("cx") - F.col("ax")) * ry - (F.col("cy") - F.col("ay")) * rx) / F.nullif(det, F.lit(0.0))
    d = left.join(right, [*keys, "__i", "__j"]).withColumn("t", t).withColumn("u", u)
    return d.where(F.col("t").between(0, 1) & F.col("u").between(0, 1)).select(*keys, "sid", "oid", "t", "u").distinct()


def next_larger(rows: DataFrame, caps: DataFrame, amount: str, cap: str, name: str) -> DataFrame:
    """The least cap >= amount, with its name: a forward as-of over the whole (small, checked) cap table."""
    small(caps, "the cap table")
    table = caps.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col(cap).alias("c"), F.col(name).alias("n")))).alias("__caps"))
    found = F.try_element_at(F.filter("__caps", lambda x: x["c"] >= F.col(amount)), F.lit(1))
    return rows.join(F.broadcast(table)).withColumn(name, found["n"]).drop("__caps")


def bilinear(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (pid, r, c) in pixel-centre units with z: weighted mean of four cells; null outside the outermost centres or by a missing cell."""
    corner = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    fr, fc = F.col("r") - F.floor("r"), F.col("c") - F.floor("c")
    d = points.withColumn("q", F.explode(corner)).withColumn("row", F.floor("r") + F.col("q.i")).withColumn("col", F.floor("c") + F.col("q.j"))
    d = d.withColumn("w", F.when(F.col("q.i") == 1, fr).otherwise(1 - fr) * F.when(F.col("q.j") == 1, fc).otherwise(1 - fc)).where("w > 0")
    hit = d.join(cells, ["raster_id", "row", "col"], "left")
    return hit.groupBy("raster_id", "pid").agg(F.when(F.count("*") == F.count("z"), F.sum(F.col("w") * F.col("z"))).alias("z"))
