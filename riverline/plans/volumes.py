"""Queries of sections, volumes, rasters, rules and screening."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riverline import fixtures as x
from riverline.operators import volumes as v
from riverline.plans.lines import r6

QUERIES: dict = {}
SQL: dict[str, str] = {}
L = F.lit


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def faced(spark, d):
    return v.faces(x.samples(spark, d), L(6.0), L(10.0), L(3.0), L(3.0))


EDGE, FIRST = "15.0::DOUBLE", "min(CASE WHEN z > 10 AND off <= 15 THEN off END)"
FACED = f"""benched AS (SELECT *, coalesce(15 - {FIRST} OVER (PARTITION BY station, side) > 2, false) AS bench FROM samples),
faced AS (SELECT *, CASE WHEN off <= 6 THEN 7.0 WHEN off - 6 <= 9 THEN 7 + (off - 6) / 3 WHEN NOT bench THEN NULL WHEN off - 15 <= 2 THEN 10 ELSE 10 + (off - 17) / 1.5 END AS face FROM benched)"""
AREAS = """SELECT station, coalesce(sum((z - face)::DECIMAL(28, 6)) FILTER (WHERE wet AND z > face {0}), 0)::DOUBLE AS dredge, coalesce(sum((z - face)::DECIMAL(28, 6)) FILTER (WHERE NOT wet AND z > face {0}), 0)::DOUBLE AS excav,
coalesce(max(z - 10) FILTER (WHERE z > face AND z > 10 {0}), 0) AS face_h FROM {1} GROUP BY station"""


@query("section_bench_gate", f"WITH {x.SAMPLES} SELECT station, side, coalesce(15 - {FIRST} > 2, false) AS bench FROM samples GROUP BY station, side")
def _(spark, d):
    return v.bench_gate(x.samples(spark, d), L(6.0), L(10.0), L(3.0), L(3.0)).select("station", "side", "bench")


@query("section_faces", f"WITH {x.SAMPLES}, {FACED} SELECT station, k, bench, round(face, 6) AS face FROM faced")
def _(spark, d):
    return faced(spark, d).select("station", "k", "bench", r6("face").alias("face"))


@query("section_area_a", f"WITH {x.SAMPLES}, {FACED}, a AS ({AREAS.format('', 'faced')}) SELECT station, round(dredge, 3) AS dredge, round(excav, 3) AS excav, face_h FROM a")
def _(spark, d):
    return v.section_areas(faced(spark, d), L(10.0)).select("station", r6("dredge", 3).alias("dredge"), r6("excav", 3).alias("excav"), "face_h")


LIMITS = """lit AS (SELECT *, CASE WHEN off > 15 THEN off END AS o, z IS NULL OR face IS NULL OR z <= face AS lit FROM faced),
broken AS (SELECT *, sum(CASE WHEN o IS NOT NULL AND NOT lit THEN 1 ELSE 0 END) OVER (PARTITION BY station, side ORDER BY off, k ROWS UNBOUNDED PRECEDING) AS b FROM lit),
begun AS (SELECT *, min(CASE WHEN o IS NOT NULL AND lit THEN o END) OVER (PARTITION BY station, side, b) AS s FROM broken),
held AS (SELECT *, CASE WHEN o IS NOT NULL AND lit AND o - s >= 4 THEN s END AS l FROM begun), limited AS (SELECT *, min(l) OVER (PARTITION BY station, side) AS lim FROM held)"""


@query("section_daylight_limit", f"WITH {x.SAMPLES}, {FACED}, {LIMITS} SELECT DISTINCT station, side, lim AS stops FROM limited")
def _(spark, d):
    return v.daylight_limits(faced(spark, d), L(15.0), 4.0).select("station", "side", F.col("limit").alias("stops")).distinct()


@query("section_area_b", f"WITH {x.SAMPLES}, {FACED}, {LIMITS}, a AS ({AREAS.format('AND coalesce(off <= lim, true)', 'limited')}) SELECT station, round(dredge, 3) AS dredge, round(excav, 3) AS excav, face_h FROM a")
def _(spark, d):
    return v.section_areas(v.daylight_limits(faced(spark, d), L(15.0), 4.0), L(10.0)).select("station", r6("dredge", 3).alias("dredge"), r6("excav", 3).alias("excav"), "face_h")


@query("section_totals", f"WITH {x.SAMPLES}, {FACED}, a AS ({AREAS.format('', 'faced')}) SELECT round(sum((dredge * 25)::DECIMAL(28, 6))::DOUBLE, 2) AS dredge, round(sum((excav * 25)::DECIMAL(28, 6))::DOUBLE, 2) AS excav, max(face_h) AS face_h FROM a")
def _(spark, d):
    return v.totals(v.section_areas(faced(spark, d), L(10.0)), 25.0).select(r6("dredge", 2).alias("dredge"), r6("excav", 2).alias("excav"), "face_h")


@query("volumes_by_tag", f"WITH {x.STATIONS} SELECT tag, count(*) AS n, round(sum(greatest(coalesce(z, 0) - 50, 0)::DECIMAL(28, 6))::DOUBLE, 4) AS volume, max(z) AS face_h FROM stations GROUP BY tag")
def _(spark, d):
    cut = F.greatest(F.coalesce("z", L(0.0)) - 50, L(0.0))
    return x.stations(spark, d).groupBy("tag").agg(F.count("*").alias("n"), F.round(v.exact(cut), 4).alias("volume"), F.max("z").alias("face_h"))


@query("volumes_depth_bands", f"WITH {x.STATIONS}, b AS (SELECT tag, z - 20 AS cut FROM stations WHERE z > 20) SELECT tag, band, round(sum(least(1, greatest(0, cut - band))::DECIMAL(28, 6))::DOUBLE, 2) AS volume FROM b, (SELECT unnest(range(40))::INT AS band) GROUP BY tag, band")
def _(spark, d):
    s = x.stations(spark, d).withColumn("cut", F.col("z") - 20)
    return v.depth_bands(s, "tag", "cut").select("tag", "band", r6("volume", 2).alias("volume"))


@query("volumes_by_pool", f"WITH {x.STATIONS}, c AS (SELECT floor(chainage / 400)::BIGINT AS pool, z - 100 AS cut FROM stations), p AS (SELECT pool, CASE WHEN cut > 0 THEN cut END AS c FROM c) SELECT pool, count(c) AS n, round(coalesce(sum(c::DECIMAL(28, 6)), 0)::DOUBLE, 4) AS volume, round(coalesce(sum(c::DECIMAL(28, 6)) FILTER (WHERE c > 200), 0)::DOUBLE, 4) AS deep_volume, round(max(c), 6) AS most, round(sum(c::DECIMAL(28, 6))::DOUBLE / count(c), 4) AS mean FROM p GROUP BY pool")
def _(spark, d):
    c = x.stations(spark, d).withColumn("pool", F.floor(F.col("chainage") / 400)).withColumn("cut", F.col("z") - 100)
    return v.pool_volumes(c, "pool", 200.0).select("pool", "n", r6("volume", 4).alias("volume"), r6("deep_volume", 4).alias("deep_volume"), r6("most").alias("most"), r6("mean", 4).alias("mean"))


@query("volumes_by_chunk", f"""WITH {x.STATIONS}, {x.WEIRS}, edges AS (SELECT DISTINCT e FROM (SELECT start AS e FROM weirs UNION ALL SELECT unnest(range(0, 4000, 300))::DOUBLE)),
chunks AS (SELECT e AS a, lead(e) OVER (ORDER BY e) AS b FROM edges) SELECT a, b, count(*) AS n, round(sum(coalesce(z, 0)::DECIMAL(28, 6))::DOUBLE, 4) AS volume FROM chunks JOIN stations ON chainage >= a AND chainage < b GROUP BY a, b""")
def _(spark, d):
    from riverline.operators.joins import within

    edges = x.weirs(spark, d).select(F.col("start").alias("e")).union(spark.range(0, 4000, 300).select(F.col("id").cast("double"))).distinct()
    chunks = edges.select(F.col("e").alias("a"), F.lead("e").over(Window.orderBy("e")).alias("b")).where("b IS NOT NULL")  # chunk edges, not cells
    found = within(x.stations(spark, d), chunks, "chainage", "a", "b", 300.0)
    return found.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(v.exact(F.coalesce("z", L(0.0))), 4).alias("volume"))


STRETCH = """kinds AS (SELECT *, CASE WHEN z < 60 THEN 'too_narrow' WHEN z > 400 THEN 'too_tight' END AS kind, CASE WHEN z < 60 THEN 60 - z WHEN z > 400 THEN z - 400 END AS deficit FROM stations),
marks AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND idx > 0 THEN 0 ELSE 1 END AS c FROM kinds WINDOW w AS (PARTITION BY line_id ORDER BY idx)),
isles AS (SELECT *, sum(c) OVER (PARTITION BY line_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS g FROM marks)"""


@query("screening_stretches", f"WITH {x.STATIONS}, {STRETCH} SELECT line_id, kind, min(idx) AS i0, max(idx) AS i1, count(*) AS n, arg_max(idx, (deficit, -idx)) AS worst, round(max(deficit), 6) AS deficit, round(sum(z::DECIMAL(28, 6))::DOUBLE, 4) AS volume FROM isles WHERE kind IS NOT NULL GROUP BY line_id, g, kind")
def _(spark, d):
    z = F.col("z")
    found = v.stretches(x.stations(spark, d), F.when(z < 60, "too_narrow").when(z > 400, "too_tight"), F.when(z < 60, 60 - z).when(z > 400, z - 400))
    return found.select("line_id", "kind", "i0", "i1", "n", "worst", r6("deficit").alias("deficit"), r6("volume", 4).alias("volume"))


@query("screening_verdict", f"WITH {x.STATIONS} SELECT line_id, CASE WHEN count(*) FILTER (WHERE z > 480) > 0 THEN 'not-navigable' WHEN count(*) FILTER (WHERE z > 300) > 0 THEN 'navigable-with-works' ELSE 'navigable-as-is' END AS verdict FROM stations GROUP BY line_id")
def _(spark, d):
    g = x.stations(spark, d).groupBy("line_id").agg(F.max(F.coalesce(F.col("z") > 480, L(False))).alias("bad"), F.max(F.coalesce(F.col("z") > 300, L(False))).alias("works"))
    return g.select("line_id", F.when(F.col("bad"), "not-navigable").when(F.col("works"), "navigable-with-works").otherwise("navigable-as-is").alias("verdict"))


@query("long_section", f"WITH {x.SAMPLES} SELECT station, arg_min(z, (off, k)) AS bed FROM samples GROUP BY station")
def _(spark, d):
    return x.samples(spark, d).groupBy("station").agg(F.min_by("z", F.struct("off", "k")).alias("bed"))


@query("nearest_station", f"WITH {x.STATIONS} SELECT line_id, arg_min(idx, (abs(x - 333) + abs(y - 50), idx)) AS idx FROM stations GROUP BY line_id")
def _(spark, d):
    s = x.stations(spark, d)
    return s.groupBy("line_id").agg(F.min_by("idx", F.struct(F.abs(F.col("x") - 333) + F.abs(F.col("y") - 50), "idx")).alias("idx"))


@query("percentile_type7", f"WITH {x.STATIONS} SELECT line_id, count(z) AS n, round(quantile_cont(z, 0.1), 6) AS low FROM stations GROUP BY line_id HAVING count(z) >= 3")
def _(spark, d):
    g = x.stations(spark, d).groupBy("line_id").agg(F.count("z").alias("n"), F.percentile("z", L(0.1)).alias("low"))
    return g.where("n >= 3").select("line_id", "n", r6("low").alias("low"))


@query("raster_decimate", f"WITH {x.PIXELS} SELECT raster_id, row // 2 AS row, col // 2 AS col, CASE WHEN count(z) = 4 THEN sum(z) / 4 END AS z FROM pixels GROUP BY ALL")
def _(spark, d):
    return v.decimated(x.pixels(spark, d), 2)


@query("raster_despike", f"""WITH {x.PIXELS}, o AS (SELECT unnest(range(-2, 3)) AS i), n AS (SELECT p.raster_id, p.row, p.col, p.z, q.z AS v FROM pixels p CROSS JOIN o a CROSS JOIN o b JOIN pixels q ON q.raster_id = p.raster_id AND q.row = least(7, greatest(0, p.row + a.i)) AND q.col = least(7, greatest(0, p.col + b.i))),
m AS (SELECT raster_id, row, col, any_value(z) AS z, list_sort(list(v)) AS v FROM n GROUP BY raster_id, row, col), d AS (SELECT *, v[13] AS med, list_sort(list_transform(v, lambda t: abs(t - v[13])))[13] AS mad FROM m)
SELECT raster_id, row, col, CASE WHEN abs(z - med) > greatest(3, 2 * 1.4826 * mad) THEN med ELSE z END AS z, abs(z - med) > greatest(3, 2 * 1.4826 * mad) AS spike FROM d""")
def _(spark, d):
    return v.despiked(x.pixels(spark, d), 8, k=2.0)


@query("raster_hillshade_slope", f"WITH {x.PIXELS} SELECT p.raster_id, p.row, p.col, round(sqrt(((e.z - w.z) / 2) ** 2 + ((s.z - n.z) / 2) ** 2), 6) AS slope FROM pixels p JOIN pixels e ON e.raster_id = p.raster_id AND e.row = p.row AND e.col = p.col + 1 JOIN pixels w ON w.raster_id = p.raster_id AND w.row = p.row AND w.col = p.col - 1 JOIN pixels n ON n.raster_id = p.raster_id AND n.col = p.col AND n.row = p.row - 1 JOIN pixels s ON s.raster_id = p.raster_id AND s.col = p.col AND s.row = p.row + 1")
def _(spark, d):
    p = x.pixels(spark, d)
    across, down = Window.partitionBy("raster_id", "row").orderBy("col"), Window.partitionBy("raster_id", "col").orderBy("row")
    p = p.withColumn("gx", (F.lead("z").over(across) - F.lag("z").over(across)) / 2).withColumn("gy", (F.lead("z").over(down) - F.lag("z").over(down)) / 2)
    return p.where("gx IS NOT NULL AND gy IS NOT NULL").select("raster_id", "row", "col", r6(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("slope"))


@query("raster_otsu", f"""WITH {x.PIXELS}, h AS (SELECT least(39, greatest(0, floor((z + 400) / 20)))::INT AS b, count(*) AS n FROM pixels GROUP BY 1),
c AS (SELECT b, sum(n) OVER w AS n0, sum(n * b) OVER w AS s0, sum(n) OVER () AS nn, sum(n * b) OVER () AS ss FROM h WINDOW w AS (ORDER BY b ROWS UNBOUNDED PRECEDING)),
q AS (SELECT b, n0::DOUBLE * (nn - n0) * (s0::DOUBLE / n0 - (ss - s0)::DOUBLE / (nn - n0)) ** 2 AS var FROM c WHERE nn > n0) SELECT -400.0 + (arg_max(b, (round(var, 3), -b)) + 1) * 20 AS cut FROM q""")
def _(spark, d):
    return v.otsu(x.pixels(spark, d).withColumnRenamed("z", "v"), -400.0, 400.0, 40).select("cut")


@query("raster_mndwi", f"WITH {x.PIXELS}, m AS (SELECT *, avg(abs(z)) OVER (PARTITION BY raster_id, row // 2, col // 2) AS m FROM pixels) SELECT raster_id, row, col, round(CASE WHEN m > 0 THEN abs(z) / m END, 6) AS sharpened FROM m")
def _(spark, d):
    w = Window.partitionBy("raster_id", F.floor(F.col("row") / 2), F.floor(F.col("col") / 2))
    p = x.pixels(spark, d).withColumn("m", F.avg(F.abs("z")).over(w))
    return p.select("raster_id", "row", "col", r6(F.when(F.col("m") > 0, F.abs("z") / F.col("m"))).alias("sharpened"))


@query("raster_composite", f"WITH {x.PIXELS}, s AS (SELECT raster_id // 10 AS raster_id, row, col, raster_id % 10 AS rank, CASE WHEN abs(z) > 80 THEN z > 0 END AS state FROM pixels) SELECT raster_id, row, col, arg_min(state, rank) FILTER (WHERE state IS NOT NULL) AS state, min(rank) FILTER (WHERE state IS NOT NULL) AS rank FROM s GROUP BY raster_id, row, col")
def _(spark, d):
    s = x.pixels(spark, d).select(F.floor(F.col("raster_id") / 10).alias("raster_id"), "row", "col", (F.col("raster_id") % 10).alias("rank"), F.when(F.abs("z") > 80, F.col("z") > 0).alias("state"))
    return v.composite(s)


@query("raster_clear_share", f"WITH {x.PIXELS} SELECT raster_id, count(*) FILTER (WHERE abs(z) > 60 AND col < 4) / count(*) FILTER (WHERE col < 4) AS share FROM pixels GROUP BY raster_id")
def _(spark, d):
    near = F.col("col") < 4
    return x.pixels(spark, d).groupBy("raster_id").agg((F.count(F.when(near & (F.abs("z") > 60), 1)) / F.count(F.when(near, 1))).alias("share"))


@query("raster_band_statistics", f"WITH {x.PIXELS} SELECT raster_id, round(avg(z), 6) + 0.0 AS mean, round(coalesce(covar_samp(z, row), 0), 4) + 0.0 AS cov FROM pixels GROUP BY raster_id")
def _(spark, d):
    return x.pixels(spark, d).groupBy("raster_id").agg(r6(F.avg("z")).alias("mean"), r6(F.coalesce(F.covar_samp("z", F.col("row").cast("double")), L(0.0)), 4).alias("cov"))


@query("raster_mosaic_check", f"WITH {x.PIXELS} SELECT raster_id, count(*) AS cells, count(*) = 64 AND count(DISTINCT row * 8 + col) = 64 AS whole FROM pixels GROUP BY raster_id")
def _(spark, d):
    return x.pixels(spark, d).groupBy("raster_id").agg(F.count("*").alias("cells"), ((F.count("*") == 64) & (F.countDistinct(F.col("row") * 8 + F.col("col")) == 64)).alias("whole"))


@query("rank_scenes", "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id % 7 DESC, vec_id % 5, vec_id) AS rank FROM embeddings")
def _(spark, d):
    w = Window.partitionBy("label").orderBy(F.desc(F.col("vec_id") % 7), F.col("vec_id") % 5, "vec_id")
    return x.table(spark, d, "embeddings").select("vec_id", F.row_number().over(w).cast("long").alias("rank"))


@query("best_scene", "SELECT label, arg_min(vec_id, (vec_id % 5, -vec_id)) AS vec_id FROM embeddings WHERE vec_id % 12 < 6 GROUP BY label")
def _(spark, d):
    return x.table(spark, d, "embeddings").where("vec_id % 12 < 6").groupBy("label").agg(F.min_by("vec_id", F.struct(F.col("vec_id") % 5, -F.col("vec_id"))).alias("vec_id"))


#: Fixed values of the sizing rules by quality of the waterway: widths, radii, depths as multiples of beam, length, draught.
RULES = [(1, "A", "width", 3.4), (2, "B", "width", 3.2), (3, "C", "width", 3.0), (4, "A", "radius", 4.0), (5, "B", "radius", 3.0), (6, "C", "radius", 2.0), (7, "A", "depth", 1.3), (8, "B", "depth", 1.3), (9, "C", "depth", 1.2)]
RULES_SQL = f"rules(rule, quality, measure, k) AS (VALUES {', '.join(map(str, RULES))})"
TRACE = f"""WITH {x.VESSELS}, {RULES_SQL}, hits AS (SELECT id AS object, measure, rule, k * CASE measure WHEN 'width' THEN beam WHEN 'radius' THEN loa ELSE draught END AS lim FROM vessels JOIN rules ON list_contains(CASE WHEN bench THEN ['A', 'B'] ELSE ['B', 'C'] END, quality))"""


def trace(spark, d):
    rules = spark.createDataFrame(RULES, "rule int, quality string, measure string, k double")
    ships = x.vessels(spark, d).select(F.col("id").alias("object"), "beam", "loa", "draught", F.when(F.col("bench"), F.array(L("A"), L("B"))).otherwise(F.array(L("B"), L("C"))).alias("qualities"))
    size = F.when(F.col("measure") == "width", F.col("beam")).when(F.col("measure") == "radius", F.col("loa")).otherwise(F.col("draught"))
    hit = ships.join(F.broadcast(rules), F.expr("array_contains(qualities, quality)"))  # nine rules
    return hit.withColumn("limit", F.col("k") * size)


@query("rules_trace", TRACE + " SELECT object, measure, rule, round(lim, 6) AS bound FROM hits")
def _(spark, d):
    return trace(spark, d).select("object", "measure", "rule", r6("limit").alias("bound"))


@query("rules_governing", TRACE + " SELECT object, measure, round(max(lim), 6) AS bound, arg_max(rule, (lim, -rule)) AS rule FROM hits GROUP BY object, measure")
def _(spark, d):
    g = trace(spark, d).groupBy("object", "measure").agg(F.max("limit").alias("l"), F.max_by("rule", F.struct("limit", -F.col("rule"))).alias("rule"))
    return g.select("object", "measure", r6("l").alias("bound"), "rule")


@query("rules_size_channel", TRACE + " SELECT object, round(max(lim) FILTER (WHERE measure = 'width'), 6) AS width, round(max(lim) FILTER (WHERE measure = 'radius'), 6) AS radius, round(max(lim) FILTER (WHERE measure = 'depth'), 6) AS depth FROM hits GROUP BY object")
def _(spark, d):
    g = trace(spark, d).groupBy("object").pivot("measure", ["width", "radius", "depth"]).agg(F.max("limit"))
    return g.select("object", *(r6(c).alias(c) for c in ("width", "radius", "depth")))


@query("rules_design_basis", TRACE + " SELECT object, measure, string_agg(rule, ';' ORDER BY rule) AS rules FROM hits GROUP BY object, measure")
def _(spark, d):
    return trace(spark, d).groupBy("object", "measure").agg(F.array_join(F.sort_array(F.collect_list("rule")).cast("array<string>"), ";").alias("rules"))


@query("rules_scenario_grid", "WITH l AS (SELECT DISTINCT p_size * 8.0::DOUBLE AS loa FROM part), b AS (SELECT DISTINCT (p_size % 12) + 4.0::DOUBLE AS beam FROM part) SELECT loa, beam, round(3.2 * beam, 6) AS width, 3 * loa AS radius FROM l CROSS JOIN b")
def _(spark, d):
    p = x.table(spark, d, "part")
    loa, beam = p.select((F.col("p_size") * 8.0).alias("loa")).distinct(), p.select((F.col("p_size") % 12 + 4.0).alias("beam")).distinct()
    return loa.crossJoin(F.broadcast(beam)).select("loa", "beam", r6(F.col("beam") * 3.2).alias("width"), (F.col("loa") * 3).alias("radius"))  # at most 12 beams


@query("fits_largest_class", f"WITH {x.VESSELS} SELECT formation, arg_max(class, (beam, loa, id)) AS largest, count(DISTINCT class) AS fitting FROM vessels WHERE 3.2 * beam <= 100 AND loa <= 240 GROUP BY formation")
def _(spark, d):
    v_ = x.vessels(spark, d).where((F.col("beam") * 3.2 <= 100) & (F.col("loa") <= 240))
    return v_.groupBy("formation").agg(F.max_by("class", F.struct("beam", "loa", "id")).alias("largest"), F.countDistinct("class").alias("fitting"))


@query("classes_in_size_order", f"WITH {x.VESSELS} SELECT id, row_number() OVER (PARTITION BY formation ORDER BY beam, loa, id) AS place FROM vessels")
def _(spark, d):
    return x.vessels(spark, d).select("id", F.row_number().over(Window.partitionBy("formation").orderBy("beam", "loa", "id")).cast("long").alias("place"))


@query("option_table", f"WITH {x.VESSELS} SELECT id, class, concat_ws(';', CASE WHEN depth < draught THEN 'depth' END, CASE WHEN radius < loa THEN 'radius' END) AS failed FROM vessels")
def _(spark, d):
    from riverline.functions.formulas import failed_checks

    return x.vessels(spark, d).select("id", "class", F.concat_ws(";", failed_checks(depth=F.col("depth") >= F.col("draught"), radius=F.col("radius") >= F.col("loa"))).alias("failed"))


@query("cascade_levels", """WITH RECURSIVE r(level) AS (SELECT 100.0::DECIMAL(12, 3) UNION SELECT (level + lift)::DECIMAL(12, 3) FROM r, (VALUES (2.5::DECIMAL(12, 3)), (4.0), (5.75)) AS t(lift) WHERE level + lift <= 130) SELECT level::DOUBLE AS level FROM r""")
def _(spark, d):
    """Levels reachable by any sums of the lifts up to the cap: all counts of each lift, three short sequences."""
    lifts, room = (2.5, 4.0, 5.75), 30
    counts = spark.range(1)
    for k, lift in enumerate(lifts):
        counts = counts.withColumn(f"n{k}", F.explode(F.sequence(L(0), L(int(room // lift)))))
    level = sum((F.col(f"n{k}") * L(lift).cast("decimal(12,3)") for k, lift in enumerate(lifts)), L(100).cast("decimal(12,3)"))
    return counts.select(level.cast("double").alias("level")).where("level <= 130").distinct()


@query("reach_volumes", f"WITH {x.STATIONS}, p AS (SELECT line_id, chainage, sum(coalesce(z, 0)::DECIMAL(28, 6)) OVER (PARTITION BY line_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM stations) SELECT line_id, round(coalesce(max(run) FILTER (WHERE chainage < 900), 0)::DOUBLE - coalesce(max(run) FILTER (WHERE chainage < 300), 0)::DOUBLE, 4) AS volume FROM p GROUP BY line_id")
def _(spark, d):
    s = x.stations(spark, d).where((F.col("chainage") >= 300) & (F.col("chainage") < 900)).groupBy("line_id").agg(v.exact(F.coalesce("z", L(0.0))).alias("volume"))
    return x.stations(spark, d).select("line_id").distinct().join(s, "line_id", "left").select("line_id", r6(F.coalesce("volume", L(0.0)), 4).alias("volume"))


@query("dependency_hash", f"WITH {x.VESSELS} SELECT class, sha256(string_agg(id || ':' || beam::INT, ',' ORDER BY id)) AS lineage FROM vessels GROUP BY class")
def _(spark, d):
    g = x.vessels(spark, d).groupBy("class").agg(F.sort_array(F.collect_list(F.struct("id", F.col("beam").cast("int").alias("b")))).alias("r"))
    return g.select("class", F.sha2(F.array_join(F.transform("r", lambda e: F.concat_ws(":", e["id"], e["b"])), ","), 256).alias("lineage"))


@query("props_json", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(spark, d):
    return x.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
