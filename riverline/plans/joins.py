"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from riverline import fixtures as x
from riverline.operators import joins as j
from riverline.plans.lines import r6

QUERIES: dict = {}
SQL: dict[str, str] = {}
DOWN = 5.0


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def pools(spark, d):
    """A pool starts at each station with the tag of a structure; its level is the station's."""
    s = x.stations(spark, d).where(F.col("tag") == STRUCTURE)
    return s.select("line_id", (F.col("chainage") + F.col("line_id") % 7).alias("start"), F.coalesce("z", F.lit(7.5)).alias("level"))


STRUCTURE = "purchase"
POOLS = f"pools AS (SELECT line_id, chainage + line_id % 7 AS start, coalesce(z, 7.5) AS level FROM stations WHERE tag = '{STRUCTURE}')"
HEAD = f"WITH {x.STATIONS}, {POOLS}"


@query("join_water_level", f"{HEAD} SELECT s.line_id, s.idx, coalesce(p.level, {DOWN}) AS level FROM stations s ASOF LEFT JOIN pools p ON s.line_id = p.line_id AND s.chainage >= p.start")
def _(spark, d):
    return j.as_of(x.stations(spark, d), pools(spark, d), "chainage", "start", "level", ["line_id"], F.lit(DOWN)).select("line_id", "idx", "level")


@query("join_grade", f"{HEAD} SELECT s.line_id, s.idx, round(coalesce(p.level, {DOWN}) - 3.25 - 0.3, 6) AS grade FROM stations s ASOF LEFT JOIN pools p ON s.line_id = p.line_id AND s.chainage >= p.start")
def _(spark, d):
    g = j.as_of(x.stations(spark, d), pools(spark, d), "chainage", "start", "level", ["line_id"], F.lit(DOWN))
    return g.select("line_id", "idx", r6(F.col("level") - 3.25 - 0.3).alias("grade"))


@query("join_depth_table", f"""{HEAD}, n AS (SELECT *, lead(start) OVER (PARTITION BY line_id ORDER BY start) AS s1, lead(level) OVER (PARTITION BY line_id ORDER BY start) AS l1, first_value(level) OVER (PARTITION BY line_id ORDER BY start) AS f FROM pools)
SELECT s.line_id, s.idx, round(CASE WHEN n.start IS NULL THEN (SELECT min_by(level, start) FROM pools p WHERE p.line_id = s.line_id) WHEN s1 IS NULL THEN level ELSE level + (l1 - level) * (s.chainage - n.start) / (s1 - n.start) END, 6) AS level
FROM stations s ASOF LEFT JOIN n ON s.line_id = n.line_id AND s.chainage >= n.start""")
def _(spark, d):
    marks = pools(spark, d).withColumn("ord", F.lit(0))
    return j.interpolated(x.stations(spark, d), marks, "chainage", "start", "level", ["line_id"]).select("line_id", "idx", r6("level", 6).alias("level"))


@query("join_station_reach", f"WITH {x.STATIONS}, {x.REACHES} SELECT s.line_id, s.idx, coalesce(r.reach, (SELECT max(reach) FROM reaches)) AS reach FROM stations s LEFT JOIN reaches r ON s.chainage >= r.a AND s.chainage < r.b")
def _(spark, d):
    r = x.reaches(spark, d)
    last = r.agg(F.max("reach").alias("last"))
    found = j.within(x.stations(spark, d), r, "chainage", "a", "b", 300.0, "left")
    return found.join(F.broadcast(last)).select("line_id", "idx", F.coalesce("reach", "last").alias("reach"))


BLOCKS = "blocked AS (SELECT line_id % 50 + 1 AS size, chainage AS c, chainage + (idx % 3) * 400.0 AS d FROM stations WHERE z > 300), kms AS (SELECT DISTINCT floor(chainage / 1000) * 1000 AS a, floor(chainage / 1000) * 1000 + 1000 AS b FROM stations)"


@query("join_km_envelope", f"""WITH {x.STATIONS}, {BLOCKS}, sizes AS (SELECT DISTINCT p_size AS size FROM part)
SELECT k.a AS km, max(s.size) AS largest FROM kms k CROSS JOIN sizes s WHERE NOT EXISTS (SELECT 1 FROM blocked w WHERE w.size = s.size AND w.c < k.b AND w.d >= k.a) GROUP BY k.a""")
def _(spark, d):
    s = x.stations(spark, d)
    blocked = s.where("z > 300").select((F.col("line_id") % 50 + 1).alias("size"), F.col("chainage").alias("c"), (F.col("chainage") + (F.col("idx") % 3) * 400.0).alias("d")).distinct()
    km = (F.floor(F.col("chainage") / 1000) * 1000).cast("double")
    kms = s.select(km.alias("a"), (km + 1000).alias("b")).distinct()
    sizes = x.table(spark, d, "part").select(F.col("p_size").cast("long").alias("size")).distinct()  # the catalogue of sizes
    shut = j.overlapping(kms, blocked, 1000.0, (F.col("c") < F.col("b")) & (F.col("d") >= F.col("a"))).select("a", "size").distinct()
    free = kms.crossJoin(j.small(sizes, "the catalogue of sizes")).join(shut, ["a", "size"], "left_anti")
    return free.groupBy(F.col("a").alias("km")).agg(F.max("size").alias("largest"))


MARKS = "marks AS (SELECT line_id, idx, chainage AS a, chainage + (idx % 4) * 20.0 AS b FROM stations)"


@query("join_overlap_guard", f"WITH {x.STATIONS}, {MARKS} SELECT p.line_id, count(*) AS overlaps FROM marks p JOIN marks q ON p.line_id = q.line_id AND p.idx < q.idx AND p.a < q.b AND q.a < p.b GROUP BY p.line_id")
def _(spark, d):
    m = x.stations(spark, d).select("line_id", "idx", F.col("chainage").alias("a"), (F.col("chainage") + (F.col("idx") % 4) * 20.0).alias("b"))
    o = m.select(F.col("line_id").alias("l2"), F.col("idx").alias("i2"), F.col("a").alias("c"), F.col("b").alias("d"))
    test = (F.col("line_id") == F.col("l2")) & (F.col("idx") < F.col("i2")) & (F.col("a") < F.col("d")) & (F.col("c") < F.col("b"))
    return j.overlapping(m, o, 100.0, test).groupBy("line_id").agg(F.count("*").alias("overlaps"))


@query("join_stretch_volumes", f"WITH {x.STATIONS}, {x.REACHES} SELECT r.reach, count(*) AS n, round(sum(coalesce(z, 0)::DECIMAL(18, 4))::DOUBLE, 4) AS volume FROM stations s JOIN reaches r ON s.chainage >= r.a AND s.chainage <= r.b GROUP BY r.reach")
def _(spark, d):
    found = j.within(x.stations(spark, d), x.reaches(spark, d), "chainage", "a", "b", 300.0, closed=True)
    return found.groupBy("reach").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("z", F.lit(0.0)).cast("decimal(18,4)")).cast("double"), 4).alias("volume"))


def square(spark):
    """A polygon with a notch, as edges."""
    ring = [(0.0, 10.0), (900.0, 10.0), (900.0, 80.0), (450.0, 40.0), (0.0, 80.0)]
    return spark.createDataFrame([(0, *p, *q) for p, q in zip(ring, ring[1:] + ring[:1])], "poly int, x1 double, y1 double, x2 double, y2 double")


EDGES = "edges(x1, y1, x2, y2) AS (VALUES (0.0::DOUBLE, 10.0::DOUBLE, 900.0::DOUBLE, 10.0::DOUBLE), (900, 10, 900, 80), (900, 80, 450, 40), (450, 40, 0, 80), (0, 80, 0, 10))"


@query("join_point_in_polygon", f"""WITH {x.STATIONS}, {EDGES}, t AS (SELECT line_id, idx, (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0) AS hit,
 (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1) = 0 AND y BETWEEN least(y1, y2) AND greatest(y1, y2) AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AS on_edge FROM stations CROSS JOIN edges)
SELECT line_id, idx, count(*) FILTER (WHERE hit) % 2 = 1 AND NOT bool_or(on_edge) AS inside FROM t GROUP BY line_id, idx""")
def _(spark, d):
    return j.inside(x.stations(spark, d).select("line_id", "idx", "x", "y"), square(spark), 20.0).select("line_id", "idx", "inside")


def segments(spark, d):
    from riverline.operators.line import lead

    s = x.stations(spark, d).withColumn("bx", lead("x")).withColumn("by", lead("y")).where("bx IS NOT NULL")
    return s.select("line_id", F.col("idx").alias("sid"), F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")


SEG = "seg AS (SELECT line_id, idx AS sid, x AS ax, y AS ay, bx, ey FROM (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS ey FROM stations WINDOW w AS (PARTITION BY line_id ORDER BY idx)) WHERE bx IS NOT NULL)"
NEAR = "greatest(0, least(1, ((p.x - ax) * (bx - ax) + (p.y - ay) * (ey - ay)) / ((bx - ax) * (bx - ax) + (ey - ay) * (ey - ay))))"


@query("join_nearest_segment", f"""WITH {x.STATIONS}, {SEG}, n AS (SELECT seg.line_id, p.idx AS pid, sid, ax, ay, bx, ey, p.x AS px, p.y AS py, {NEAR} AS t FROM stations p JOIN seg ON seg.line_id = p.line_id + 1),
dd AS (SELECT line_id, pid, sid, round(sqrt((ax + t * (bx - ax) - px) ** 2 + (ay + t * (ey - ay) - py) ** 2), 6) AS dist FROM n)
SELECT line_id, pid, min(dist) AS dist FROM dd WHERE dist <= 60 GROUP BY line_id, pid""")
def _(spark, d):
    """Each line's vertices on the line after it."""
    p = x.stations(spark, d).select((F.col("line_id") + 1).alias("line_id"), F.col("idx").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"))
    near = j.nearest_on_lines(p, segments(spark, d), 60.0 + 1e-6, ["line_id"])  # the limit is one of rounded distances
    return near.select("line_id", "pid", r6("dist").alias("dist")).where("dist <= 60")


@query("join_line_crossings", f"""WITH {x.STATIONS}, {SEG}, m AS (SELECT s.line_id, s.sid, o.sid AS oid, (s.bx - s.ax) * (o.ey - o.ay) - (s.ey - s.ay) * (o.bx - o.ax) AS det,
 (o.ax - s.ax) * (o.ey - o.ay) - (o.ay - s.ay) * (o.bx - o.ax) AS tn, (o.ax - s.ax) * (s.ey - s.ay) - (o.ay - s.ay) * (s.bx - s.ax) AS un FROM seg s JOIN seg o ON o.line_id = s.line_id + 1)
SELECT line_id, sid, oid, round(tn / det, 6) + 0.0 AS t FROM m WHERE det <> 0 AND tn / det BETWEEN 0 AND 1 AND un / det BETWEEN 0 AND 1""")
def _(spark, d):
    """Each line with the line after it."""
    other = segments(spark, d).select((F.col("line_id") - 1).alias("line_id"), F.col("sid").alias("oid"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    return j.crossings(segments(spark, d), other, 50.0, ["line_id"]).select("line_id", "sid", "oid", r6("t").alias("t"))


#: Vertices strayed along the line, so that lines cross themselves.
ASTRAY = "astray AS (SELECT line_id, idx, x - (idx % 5) * 30.0 AS x, y FROM stations)"
SELF = SEG.replace("stations", "astray")


@query("join_self_crossings", f"""WITH {x.STATIONS}, {ASTRAY}, {SELF}, m AS (SELECT s.line_id, s.sid, o.sid AS oid, (s.bx - s.ax) * (o.ey - o.ay) - (s.ey - s.ay) * (o.bx - o.ax) AS det,
 (o.ax - s.ax) * (o.ey - o.ay) - (o.ay - s.ay) * (o.bx - o.ax) AS tn, (o.ax - s.ax) * (s.ey - s.ay) - (o.ay - s.ay) * (s.bx - s.ax) AS un FROM seg s JOIN seg o ON o.line_id = s.line_id AND o.sid > s.sid + 1)
SELECT line_id, count(*) AS meetings, false AS simple FROM m WHERE det <> 0 AND tn / det BETWEEN 0 AND 1 AND un / det BETWEEN 0 AND 1 GROUP BY line_id
UNION ALL SELECT line_id, 0, true FROM (SELECT DISTINCT line_id FROM stations) WHERE line_id NOT IN (SELECT line_id FROM m WHERE det <> 0 AND tn / det BETWEEN 0 AND 1 AND un / det BETWEEN 0 AND 1)""")
def _(spark, d):
    """A line is simple if no two of its segments meet but neighbours."""
    from riverline.operators.line import lead

    s = x.stations(spark, d).withColumn("x", F.col("x") - (F.col("idx") % 5) * 30.0)
    seg = s.withColumn("bx", lead("x")).withColumn("by", lead("y")).where("bx IS NOT NULL").select("line_id", F.col("idx").alias("sid"), F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")
    other = seg.select("line_id", F.col("sid").alias("oid"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    met = j.crossings(seg, other, 50.0, ["line_id"]).where("oid > sid + 1").groupBy("line_id").agg(F.count("*").alias("meetings"))
    return s.select("line_id").distinct().join(met, "line_id", "left").select("line_id", F.coalesce("meetings", F.lit(0)).alias("meetings"), F.col("meetings").isNull().alias("simple"))


@query("join_next_larger_class", f"WITH {x.VESSELS}, caps AS (SELECT n_nationkey * 20.0::DOUBLE AS cap, n_name AS name FROM nation) SELECT id, (SELECT min_by(name, cap) FROM caps WHERE cap >= loa) AS name FROM vessels")
def _(spark, d):
    caps = x.table(spark, d, "nation").select((F.col("n_nationkey") * 20.0).alias("cap"), F.col("n_name").alias("name"))
    return j.next_larger(x.vessels(spark, d), caps, "loa", "cap", "name").select("id", "name")


@query("join_typical_key", f"WITH {x.VESSELS} SELECT v.id, count(*) AS same FROM vessels v JOIN vessels w ON v.class = w.class AND v.loa = w.loa AND v.beam = w.beam GROUP BY v.id")
def _(spark, d):
    v = x.vessels(spark, d)
    key = F.concat_ws(" ", "class", F.concat_ws("x", F.format_number("loa", 1), F.format_number("beam", 1)))
    sizes = v.groupBy(key.alias("key")).agg(F.count("*").alias("same"))
    return v.select("id", key.alias("key")).join(sizes, "key").select("id", "same")


@query("join_bilinear", f"""WITH {x.PIXELS}, p AS (SELECT DISTINCT raster_id, (raster_id % 27) / 4.0::DOUBLE AS r, (raster_id % 25) / 4.0::DOUBLE AS c FROM pixels),
q AS (SELECT p.*, i, k, CASE WHEN i = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END * CASE WHEN k = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END AS w FROM p CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) b(k))
SELECT q.raster_id, round(CASE WHEN count(*) = count(z) THEN sum(w * z) END, 6) + 0.0 AS z FROM q LEFT JOIN pixels x ON q.raster_id = x.raster_id AND x.row = floor(r) + i AND x.col = floor(c) + k WHERE w > 0 GROUP BY q.raster_id""")
def _(spark, d):
    cells = x.pixels(spark, d)
    p = cells.select("raster_id").distinct().select("raster_id", F.lit(0).alias("pid"), ((F.col("raster_id") % 27) / 4.0).alias("r"), ((F.col("raster_id") % 25) / 4.0).alias("c"))
    return j.bilinear(p, cells).select("raster_id", r6("z").alias("z"))


@query("join_water_fallback", f"WITH {x.PIXELS}, seen AS (SELECT raster_id, row, col, z > 0 AS wet FROM pixels WHERE abs(z) > 60) SELECT p.raster_id, p.row, p.col, coalesce(s.wet, p.col < 4) AS wet, CASE WHEN s.wet IS NULL THEN 'fallback' ELSE 'scene' END AS origin FROM pixels p LEFT JOIN seen s USING (raster_id, row, col)")
def _(spark, d):
    p = x.pixels(spark, d)
    seen = p.where(F.abs("z") > 60).select("raster_id", "row", "col", (F.col("z") > 0).alias("wet"))
    g = p.join(seen, ["raster_id", "row", "col"], "left")
    return g.select("raster_id", "row", "col", F.coalesce("wet", F.col("col") < 4).alias("wet"), F.when(F.col("wet").isNull(), "fallback").otherwise("scene").alias("origin"))


@query("join_dem_tiles", f"WITH {x.VESSELS} SELECT id, unnest(range(floor(lon)::BIGINT, floor(lon + 1.5)::BIGINT + 1)) AS tx, floor(lat)::BIGINT AS ty FROM vessels")
def _(spark, d):
    v = x.vessels(spark, d)
    return v.select("id", F.explode(F.sequence(F.floor("lon"), F.floor(F.col("lon") + 1.5))).alias("tx"), F.floor("lat").alias("ty"))
