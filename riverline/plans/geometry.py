"""Queries of plane geometry, routes, rasters, banks, networks and documents; tests hold those without SQL against known answers and brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from riverline import fixtures as x
from riverline.functions import plugins, projection
from riverline.operators import banks, grid, lattice, network, planar, polygons, route
from riverline.operators import search as s
from riverline.operators.line import fill_missing
from riverline.plans.joins import HEAD
from riverline.plans.lines import KAPPA, r6
from riverline.plans.volumes import TRACE, trace
from riverline.sources import designs, synthetic

QUERIES: dict = {}
SQL: dict[str, str] = {}
S = x.STATIONS


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def per_line(name: str, schema: str, source=None, least: int = 0):
    """Register solve(frame of one line) -> dict of columns; line_id comes first."""

    def add(solve):
        def whole(p: pd.DataFrame) -> pd.DataFrame:
            found = solve(p)
            n = max((len(v) for v in found.values() if not np.isscalar(v) and v is not None), default=1)
            return pd.DataFrame({"line_id": np.full(n, p.line_id.iloc[0]), **found})

        QUERIES[name] = lambda spark, d: s.per_line((source or fill_missing_z)(spark, d), f"line_id long, {schema}", whole, least=least)
        return solve

    return add


def fill_missing_z(spark, d):
    return fill_missing(x.stations(spark, d), "z", "h").select("line_id", "idx", "x", "y", "h", "z", "tag")


def points(p: pd.DataFrame) -> np.ndarray:
    """A line's vertices, calmed: y swings within 20 m of a wave."""
    along = p.x.to_numpy()
    return np.stack([along, 60 * np.sin(along / 180) + p.y.to_numpy() / 5], axis=1)


def sides(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two banks 25 to 65 m off the wave, on from either end of the line."""
    along = np.linspace(-100, p.x.max() + 100, 2 * len(p) + 20)
    middle, off = 60 * np.sin(along / 180) + 10, 45 + 20 * np.sin(along / 70)
    return np.stack([along, middle + off], axis=1), np.stack([along, middle - off], axis=1)


def water(p: pd.DataFrame) -> list[np.ndarray]:
    left, right = sides(p)
    return [np.concatenate([right, left[::-1], right[:1]])]


def widths(radius) -> np.ndarray:
    """Bottom width that a radius asks for: straight width and widening in bends."""
    return 38.0 + np.where(np.isfinite(radius), 4000 / np.maximum(radius, 150), 0)


# --- with SQL


@query("line_least_radius", f"WITH {S}, {KAPPA} SELECT line_id, arg_min(idx, (round(radius, 6), idx)) AS idx, round(min(radius), 4) AS radius FROM bent WHERE radius IS NOT NULL GROUP BY line_id")
def _(spark, d):
    from riverline.operators import line as o

    g = o.radius(x.stations(spark, d)).where("radius IS NOT NULL").groupBy("line_id")
    return g.agg(F.min_by("idx", F.struct(F.round("radius", 6), "idx")).alias("idx"), F.round(F.min("radius"), 4).alias("radius"))


@query("section_at_chainage", f"WITH {S}, n AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY abs(chainage - 333), idx) AS r FROM stations) SELECT line_id, idx, z, tag FROM n WHERE r = 1")
def _(spark, d):
    one = F.min_by(F.struct("idx", "z", "tag"), F.struct(F.abs(F.col("chainage") - 333), "idx")).alias("s")
    return x.stations(spark, d).groupBy("line_id").agg(one).select("line_id", "s.*")


@query("rules_governing_radii", TRACE + " SELECT object, round(max(lim), 6) AS radius FROM hits WHERE measure = 'radius' GROUP BY object")
def _(spark, d):
    return trace(spark, d).where("measure = 'radius'").groupBy("object").agg(F.round(F.max("limit"), 6).alias("radius"))


#: Rules that block, and the depth without which they are not evaluated.
BLOCKING = (1, 4, 7)


@query("rules_blocking_not_evaluated", TRACE + f" SELECT DISTINCT h.object, h.rule FROM hits h JOIN vessels v ON v.id = h.object WHERE h.rule IN {BLOCKING} AND v.depth = 0")
def _(spark, d):
    gaps = x.vessels(spark, d).where("depth = 0").select(F.col("id").alias("object"))
    return trace(spark, d).where(F.col("rule").isin(*BLOCKING)).join(gaps, "object", "left_semi").select("object", "rule").distinct()


WIDEN = "CASE WHEN isnan(r) THEN 'NaN'::DOUBLE WHEN r <= 0 OR isinf(r) THEN 0 ELSE loa * loa / (2 * r) END"


@query("rules_governing_widening", f"WITH {x.VESSELS}, r AS (SELECT id, loa, CASE WHEN id % 11 = 0 THEN 'Infinity'::DOUBLE ELSE radius - 40 END AS r FROM vessels) SELECT id, round({WIDEN}, 6) AS widening FROM r")
def _(spark, d):
    v = x.vessels(spark, d).withColumn("r", F.when(F.col("id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("radius") - 40))
    wide = F.when(F.isnan("r"), F.lit(float("nan"))).when((F.col("r") <= 0) | (F.col("r") == float("inf")), 0.0).otherwise(F.col("loa") * F.col("loa") / (2 * F.col("r")))
    return v.select("id", F.round(wide, 6).alias("widening"))


@query("quantity_schedule", f"""WITH {S}, c AS (SELECT *, greatest(coalesce(z, 0) - 60, 0) AS cut, CASE WHEN z > 400 THEN 'tight' WHEN z < 60 THEN 'narrow' ELSE 'free' END AS stretch FROM stations)
SELECT line_id, stretch, count(*) AS n, round(coalesce(sum((cut * 25)::DECIMAL(28, 6)) FILTER (WHERE idx % 2 = 0), 0)::DOUBLE, 3) AS dredge, round(coalesce(sum((cut * 25)::DECIMAL(28, 6)) FILTER (WHERE idx % 2 = 1), 0)::DOUBLE, 3) AS excav,
 round(max(cut), 6) AS face, arg_max(idx, (cut, -idx)) AS face_at FROM c GROUP BY line_id, stretch""")
def _(spark, d):
    from riverline.operators.volumes import exact

    cut, z, wet = F.greatest(F.coalesce("z", F.lit(0.0)) - 60, F.lit(0.0)), F.col("z"), F.col("idx") % 2 == 0
    c = x.stations(spark, d).withColumn("cut", cut).withColumn("stretch", F.when(z > 400, "tight").when(z < 60, "narrow").otherwise("free"))
    part = lambda test: F.round(F.coalesce(exact(F.when(test, F.col("cut") * 25)), F.lit(0.0)), 3)
    return c.groupBy("line_id", "stretch").agg(F.count("*").alias("n"), part(wet).alias("dredge"), part(~wet).alias("excav"), F.round(F.max("cut"), 6).alias("face"), F.max_by("idx", F.struct("cut", -F.col("idx"))).alias("face_at"))


@query("line_never_rising_joins", f"""WITH {S}, p AS (SELECT *, tag IN ('view', 'click') AS seen FROM stations WHERE z IS NOT NULL),
m AS (SELECT *, CASE WHEN seen THEN min(CASE WHEN seen THEN z END) OVER w END AS w FROM p WINDOW w AS (PARTITION BY line_id ORDER BY chainage ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, last_value(w IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY chainage ROWS UNBOUNDED PRECEDING) AS hi, first_value(w IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY chainage ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lo FROM m)
SELECT line_id, idx, coalesce(w, CASE WHEN z > hi THEN hi ELSE greatest(z, coalesce(lo, z)) END) AS fixed FROM b""")
def _(spark, d):
    p = x.stations(spark, d).where("z IS NOT NULL")
    return banks.never_rising_across_joins(p, F.col("tag").isin("view", "click"), value="z").select("line_id", "idx", "fixed")


@query("swot_low_levels", f"""WITH {S}, r AS (SELECT floor(chainage / 300)::BIGINT AS reach, z AS wse, y * 4 AS width, idx % 4 AS q FROM stations)
SELECT reach, round(quantile_cont(wse, 0.1), 6) AS level, count(*) AS n FROM r WHERE width >= 100 AND q <= 1 AND wse IS NOT NULL GROUP BY reach HAVING count(*) >= 3""")
def _(spark, d):
    r = x.stations(spark, d).select(F.floor(F.col("chainage") / 300).alias("reach"), F.col("z").alias("wse"), (F.col("y") * 4).alias("width"), (F.col("idx") % 4).alias("quality"))
    return banks.low_levels(r).select("reach", r6("level").alias("level"), "n")


@query("merge_low_confidence", f"""WITH {S}, e AS (SELECT line_id, chainage AS a, chainage + 30 AS b, 1 AS rank, y AS width FROM stations WHERE z < 60 UNION ALL SELECT line_id, chainage - 10, chainage + 40, 2, y / 2 FROM stations WHERE z > 300),
m AS (SELECT *, max(b) OVER (PARTITION BY line_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e), g AS (SELECT *, sum(CASE WHEN a <= r THEN 0 ELSE 1 END) OVER (PARTITION BY line_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT line_id, min(a) AS a, max(b) AS b, max(rank) AS rank, min(width) AS width FROM g GROUP BY line_id, g""")
def _(spark, d):
    st, c = x.stations(spark, d), F.col("chainage")
    low = st.where("z < 60").select("line_id", c.alias("a"), (c + 30).alias("b"), F.lit(1).alias("rank"), F.col("y").alias("width"))
    high = st.where("z > 300").select("line_id", (c - 10).alias("a"), (c + 40).alias("b"), F.lit(2).alias("rank"), (F.col("y") / 2).alias("width"))
    return banks.merged_stretches(low, high)


def _series(terms, form) -> str:
    return " + ".join(f"({c!r}) * {form.format(n=2 * k)}" for k, c in enumerate(terms, 1))


PLACED = "placed AS (SELECT id, lon, lat, floor((lon + 180) / 6) + 1 AS zone, lat < 0 AS south FROM (SELECT id, lon, lat FROM vessels))"
FORWARD = f"""conformal AS (SELECT *, radians(lon - (zone * 6 - 183)) AS away, sinh(atanh(sin(radians(lat))) - {projection.E!r} * atanh({projection.E!r} * sin(radians(lat)))) AS t FROM placed),
plane AS (SELECT *, atan2(t, cos(away)) AS xi, atanh(sin(away) / sqrt(1 + t * t)) AS eta FROM conformal),
utm AS (SELECT id, lon, lat, zone, south, {projection.EAST} + {projection.SCALE * projection.RADIUS!r} * (eta + {_series(projection.ALPHA, 'cos({n} * xi) * sinh({n} * eta)')}) AS east,
 CASE WHEN south THEN {projection.SOUTH} ELSE 0 END + {projection.SCALE * projection.RADIUS!r} * (xi + {_series(projection.ALPHA, 'sin({n} * xi) * cosh({n} * eta)')}) AS north FROM plane)"""


def utm(spark, d):
    v = x.vessels(spark, d).select("id", "lon", "lat", (F.floor((F.col("lon") + 180) / 6) + 1).alias("zone"), (F.col("lat") < 0).alias("south"))
    east, north = projection.utm_forward(*(F.col(c) for c in ("lon", "lat", "zone", "south")))
    return v.withColumn("east", east).withColumn("north", north)


@query("formula_utm_forward", f"WITH {x.VESSELS}, {PLACED}, {FORWARD} SELECT id, round(east, 4) AS east, round(north, 4) AS north FROM utm")
def _(spark, d):
    return utm(spark, d).select("id", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"))


@query("formula_utm_inverse", f"WITH {x.VESSELS} SELECT id, round(lon, 8) + 0.0 AS lon, round(lat, 8) + 0.0 AS lat FROM vessels")
def _(spark, d):
    """There and back: the SQL says what must come out."""
    lon, lat = projection.utm_inverse(*(F.col(c) for c in ("east", "north", "zone", "south")))
    return utm(spark, d).select("id", (F.round(lon, 8) + 0.0).alias("lon"), (F.round(lat, 8) + 0.0).alias("lat"))


@query("formula_half_width_of_shape", f"WITH {x.VESSELS} SELECT id, round(beam * 1.6 + CASE WHEN radius > 0 AND radius < 600 THEN 0.5 * loa * loa / (2 * greatest(radius, 3 * loa)) ELSE 0 END, 6) AS half FROM vessels")
def _(spark, d):
    v, r, loa = x.vessels(spark, d), F.col("radius"), F.col("loa")
    wide = F.when((r > 0) & (r < 600), 0.5 * loa * loa / (2 * F.greatest(r, 3 * loa))).otherwise(0.0)
    return v.select("id", F.round(F.col("beam") * 1.6 + wide, 6).alias("half"))


@query("stage_status", f"WITH {x.VESSELS} SELECT id, CASE WHEN id % 5 = 0 THEN 'not run' WHEN class IS NOT DISTINCT FROM formation THEN 'fresh' WHEN id % 2 = 0 THEN 'fresh' ELSE 'stale' END AS status FROM vessels")
def _(spark, d):
    v = x.vessels(spark, d)
    results, recorded = F.when(F.col("id") % 5 != 0, F.col("class")), F.when(F.col("id") % 2 == 0, F.col("formation")).otherwise(F.col("class"))
    return v.select("id", designs.stage_status(results, recorded, F.col("formation")).alias("status"))


@query("no_feasible_line", "SELECT event_id, (props->>'$.k')::BIGINT % 3 = 0 AS infeasible FROM events")
def _(spark, d):
    """An option whose feasibility check says no, read from its JSON."""
    e = x.table(spark, d, "events").select("event_id", F.to_json(F.struct(F.struct(F.struct((F.get_json_object("props", "$.k").cast("long") % 3 != 0).alias("ok")).alias("feasible")).alias("checks"))).alias("o"))
    option = F.from_json("o", "checks struct<feasible:struct<ok:boolean>>")
    return e.select("event_id", (option["checks"]["feasible"]["ok"] == False).alias("infeasible"))  # noqa: E712


@query("canonical_hashes", """SELECT event_id, sha256('{"k":' || (props->>'$.k') || ',"user":' || user_id || '}') AS hash FROM events""")
def _(spark, d):
    @F.pandas_udf("string")
    def hashed(k: pd.Series, user: pd.Series) -> pd.Series:
        return pd.Series([designs.canonical_hash({"user": int(u), "k": int(v)}) for u, v in zip(user, k)])

    return x.table(spark, d, "events").select("event_id", hashed(F.get_json_object("props", "$.k").cast("long"), "user_id").alias("hash"))


@query("plugin_widths", f"WITH {x.VESSELS} SELECT id, round(beam * 3.2, 6) AS straight, round(beam * 3.2 + loa * loa / (2 * greatest(radius, 100)), 6) AS bend FROM vessels")
def _(spark, d):
    plugins.register(plugins.WidthMethod("plain", lambda beam, loa, r: beam * 3.2, lambda beam, loa, r: beam * 3.2 + loa * loa / (2 * F.greatest(r, F.lit(100))), lambda beam, loa, r: 3 * loa), replace=True)
    method, args = plugins.width_method("plain"), [F.col(c) for c in ("beam", "loa", "radius")]
    return x.vessels(spark, d).select("id", F.round(method.straight(*args), 6).alias("straight"), F.round(method.bend(*args), 6).alias("bend"))


@query("plugin_callbacks", f"WITH {x.VESSELS} SELECT id, beam * 2 + 1 AS one, loa - beam * draught AS three, CASE WHEN beam > 25 THEN 'wide' END AS tag, lon + 2 * lat AS z FROM vessels")
def _(spark, d):
    one, three, tag = plugins.scalar(lambda v: v * 2 + 1), plugins.triple(lambda a, b, c: a - b * c), plugins.text(lambda v: "wide" if v > 25 else None)
    v = plugins.heights(x.vessels(spark, d), lambda lon, lat: lon + 2 * lat, "lon", "lat", "height")
    return v.select("id", one("beam").alias("one"), three("loa", "beam", "draught").alias("three"), tag("beam").alias("tag"), F.col("height").alias("z"))


@query("parallel_jobs", f"WITH {x.VESSELS} SELECT id, beam * 8 AS answer FROM vessels")
def _(spark, d):
    return plugins.over_jobs(x.vessels(spark, d).select("id", "beam"), lambda job: {"answer": job["beam"] * 8}, "answer double").select("id", "answer")


@query("synthetic_river", "SELECT id AS idx, id * 10.0::DOUBLE AS x, round(260 * sin(2 * pi() * id * 10.0 / 1500), 6) + 0.0 AS y FROM (SELECT unnest(range(601)) AS id)")
def _(spark, d):
    return synthetic.river(spark).select("idx", "x", (F.round("y", 6) + 0.0).alias("y"))


@query("synthetic_terrain", f"WITH {S} SELECT line_id, idx, round(CASE WHEN y < 20 THEN 1e-4 * x - 3 * (1 - (y / 20) * (y / 20)) ELSE 1e-4 * x + 3 + 0.002 * (y - 20) + 15 * exp(-((x - 1875) * (x - 1875) + (y - 150) * (y - 150)) / 28800) END, 6) AS z FROM stations")
def _(spark, d):
    return x.stations(spark, d).select("line_id", "idx", F.round(synthetic.terrain(F.col("x"), F.col("y"), F.col("y")), 6).alias("z"))


@query("raster_water_index", f"""WITH {x.PIXELS}, b AS (SELECT raster_id, row, col, abs(z) AS g, abs(z) % 97 + 1 AS n, (abs(z) * 3) % 89 AS s FROM pixels),
m AS (SELECT *, s * n / avg(n) OVER (PARTITION BY raster_id, row // 2, col // 2) AS h FROM b) SELECT raster_id, row, col, round(CASE WHEN g + h > 0 THEN (g - h) / (g + h) END, 6) + 0.0 AS mndwi FROM m""")
def _(spark, d):
    z = F.abs("z")
    b = x.pixels(spark, d).select("raster_id", "row", "col", z.alias("g"), (z % 97 + 1).alias("n"), ((z * 3) % 89).alias("s"))
    mean = F.avg("n").over(Window.partitionBy("raster_id", F.floor(F.col("row") / 2), F.floor(F.col("col") / 2)))
    sharp = b.withColumn("h", F.col("s") * F.col("n") / mean)
    return sharp.select("raster_id", "row", "col", (F.round(F.when(F.col("g") + F.col("h") > 0, (F.col("g") - F.col("h")) / (F.col("g") + F.col("h"))), 6) + 0.0).alias("mndwi"))


@query("cascade_fixed_score", f"""{HEAD}, w AS (SELECT line_id, start, row_number() OVER (PARTITION BY line_id ORDER BY start) AS n FROM pools WHERE start <= 1500), t AS (SELECT DISTINCT line_id FROM stations),
b AS (SELECT line_id, start AS a, 2.5 * n AS level FROM w UNION ALL SELECT line_id, 0, 0 FROM t), r AS (SELECT *, lead(a, 1, 2000) OVER (PARTITION BY line_id ORDER BY a, level) AS e FROM b)
SELECT line_id, round(sum((e - a) * abs(level - 6) / 10) + 7 * 2.5 * (count(*) - 1), 4) AS cost FROM r GROUP BY line_id""")
def _(spark, d):
    """The cost of given weirs, 2.5 m each, between source and 2000 m."""
    from riverline.plans.joins import pools

    w = pools(spark, d).where("start <= 1500").select("line_id", "start")
    rows = x.stations(spark, d).select("line_id").distinct().select("line_id", F.lit(None).cast("double").alias("start")).unionByName(w).withColumn("idx", F.lit(0))

    def solve(p):
        cost, _ = s.cascade_cost([(v, 2.5) for v in p.start.dropna()], 2000.0, 0.0, lambda a, b, level: (b - a) * np.abs(level - 6) / 10, lambda lift: 7 * lift)
        return pd.DataFrame({"line_id": [p.line_id.iloc[0]], "cost": [round(cost, 4)]})

    return s.per_line(rows, "line_id long, cost double", solve)


# --- lines, one at a time


@per_line("geo_radius_on_chord", "radius double")
def _(p):
    return {"radius": [planar.radius_on_chord(points(p), 85.0)]}


@per_line("geo_loop_verdict", "loop boolean, reason string")
def _(p):
    verdict = planar.loop_verdict(points(p)[:, ::-1] if p.line_id.iloc[0] % 2 else points(p), float(p.x.max()) / 2 + 1)
    return {"loop": [verdict[0]], "reason": [verdict[1]]}


@per_line("geo_cut_loops", "idx long, x double, y double")
def _(p):
    xy = points(p)
    xy[::5, 0] -= 60
    xy = planar.cut_loops(xy, 8)
    return {"idx": range(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}


@per_line("geo_line_merge", "part long, n long")
def _(p):
    xy = points(p)
    lines = planar.merged_lines([xy[k : k + 4][:: (-1) ** (k // 3)] for k in range(0, len(xy) - 1, 3) if len(xy[k : k + 4]) > 1])
    return {"part": range(len(lines)), "n": [len(v) for v in lines]}


@per_line("geo_water_width", "idx long, width double")
def _(p):
    line = planar.Line(points(p))
    return {"idx": p.idx, "width": planar.water_width(line, line.along, water(p))}


@per_line("geo_probed_width", "idx long, width double")
def _(p):
    line = planar.Line(points(p))
    n = planar.normals(line, line.along, 5.0)
    rings = water(p)
    return {"idx": p.idx, "width": [planar.probed_width(rings, line.points[k], n[k]) for k in range(len(p))]}


@per_line("geo_measured_widths", "sample long, chainage double, width double")
def _(p):
    rows, _ = planar.measured_widths(points(p), *sides(p), 50.0, 200.0)
    return {k: [r[i] for r in rows] for i, k in enumerate(("sample", "chainage", "width"))}


@per_line("geo_bank_offsets", "idx long, left double, right double")
def _(p):
    off = planar.bank_offsets(points(p), *sides(p)) if len(p) > 1 else np.full((1, 2), np.nan)
    return {"idx": p.idx, "left": off[:, 0], "right": off[:, 1]}


def _runs(found):
    return {"a": [r[0] for r in found], "b": [r[1] for r in found], "kind": [{1: "too_narrow", 2: "r_min_not_possible"}[r[2]] for r in found]}


@per_line("geo_width_check", "a double, b double, kind string")
def _(p):
    return _runs(planar.width_check(points(p), water(p), widths, 255.0, 85.0))


@per_line("geo_kind_checks", "a double, b double, kind string")
def _(p):
    return _runs(planar.kind_checks(points(p), water(p), widths, 255.0, 85.0))


@per_line("geo_class_fit", "verdict string, failing double, worst_width double, worst_radius double")
def _(p):
    """Length that fails, and by how much width and radius fall short at worst."""
    line = planar.Line(points(p))
    found = planar.width_check(line.points, water(p), widths, 255.0, 85.0)
    at = np.arange(0, line.length + 1e-9, planar.RUN_STEP)
    radius = line.radius(at, 85.0)
    narrow = np.maximum(widths(radius) - planar.water_width(line, at, water(p)), 0)
    failing = sum(b - a for a, b, _ in found)
    verdict = "fits" if not found else "works" if failing < line.length / 2 else "does not fit"
    return {"verdict": [verdict], "failing": [failing], "worst_width": [float(narrow.max())], "worst_radius": [float(np.maximum(255.0 - radius, 0).max())]}


@per_line("geo_turn_segments", "idx long, phi double, radius double")
def _(p):
    xy = points(p)
    heading = np.unwrap(np.append(np.arctan2(*np.diff(xy, axis=0).T[::-1]), 0.0)[: len(xy)]) if len(xy) > 1 else np.zeros(1)
    phi, least = planar.turn_segments(heading, planar.vertex_radii(xy))
    return {"idx": p.idx, "phi": phi, "radius": least}


@per_line("geo_bends", "i0 long, i1 long, need double, width double, room double, kind string")
def _(p):
    found = planar.bends(points(p), water(p), 150.0, 60.0, 40.0, 0.5, 40.0)
    return {k: [f[n] for f in found] for k, n in (("i0", "i0"), ("i1", "i1"), ("need", "need"), ("width", "width"), ("room", "room"), ("kind", "class"))}


@per_line("geo_tangent_joins", "idx long, x double, y double, radius double")
def _(p):
    xy = points(p)
    out, radius = planar.tangent_joins(xy, [xy[len(xy) // 2]], 200.0, 60.0) if len(xy) > 8 else (xy, [np.inf])
    return {"idx": range(len(out)), "x": out[:, 0], "y": out[:, 1], "radius": np.full(len(out), radius[0])}


@per_line("geo_paired_centreline", "idx long, x double, y double")
def _(p):
    xy = planar.paired_centreline(*sides(p), 25.0)
    return {"idx": range(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}


@per_line("geo_midline", "idx long, x double, y double")
def _(p):
    xy = planar.midline(*sides(p), points(p), 50.0) if len(p) > 1 else points(p)
    return {"idx": range(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}


@per_line("geo_fairway", "idx long, x double, y double")
def _(p):
    xy = planar.fairway(points(p), water(p), 10.0, step=50.0) if len(p) > 4 else points(p)
    return {"idx": range(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}


@per_line("geo_join_legs", "idx long, x double, y double")
def _(p):
    xy, k = points(p), len(p) // 2
    xy = planar.joined_legs([xy[: k + 1], xy[k:]], water(p), 10.0, 50.0) if len(p) > 8 else xy
    return {"idx": range(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}


@per_line("geo_rolling_circle", "idx long, x double, y double, arcs long")
def _(p):
    xy, arcs = planar.rolling_circle(points(p), 120.0, 20.0) if len(p) > 4 else (points(p), [])
    return {"idx": range(len(xy)), "x": xy[:, 0], "y": xy[:, 1], "arcs": np.full(len(xy), len(arcs))}


@per_line("geo_navigable_water", "part long, area double", lambda spark, d: x.stations(spark, d).select("line_id", "idx", "x"), 256)
def _(p):
    found = polygons.parts(polygons.navigable_water(water(p), 15.0, 5.0))
    return {"part": range(len(found)), "area": [round(polygons.area(f), 3) for f in found]}


@per_line("geo_excavation", "part long, side string, area double")
def _(p):
    found = polygons.excavation(points(p), *sides(p), 45.0, lambda r: np.where(np.isfinite(r), np.minimum(2000 / np.maximum(r, 1), 20), 0), 25.0, 10.0) if len(p) > 2 else []
    return {"part": range(len(found)), "side": [f["side"] for f in found], "area": [round(f["area"], 3) for f in found]}


@per_line("geo_channel_limits", "least_radius double, most_extra double, mean_extra double")
def _(p):
    numbers = polygons.channel_limits(points(p), 30.0, lambda r: np.where(np.isfinite(r), np.minimum(2000 / np.maximum(r, 1), 20), 0), 25.0)[2] if len(p) > 1 else {"least_radius": None, "most_extra": 0.0, "mean_extra": 0.0}
    return {k: [v] for k, v in numbers.items()}


@per_line("bank_checks", "idx long, missing boolean, side boolean, jump boolean, excursion boolean, width boolean")
def _(p):
    off = np.stack([20 + p.z.to_numpy(float) / 4, -20 - p.y.to_numpy()], axis=1)
    return {"idx": p.idx, **banks.bank_checks(off, 25.0)}


@per_line("bank_repair", "idx long, left double, right double")
def _(p):
    off = np.stack([20 + p.z.to_numpy(float) / 4, -20 - p.y.to_numpy()], axis=1)
    bad = np.any(list(banks.bank_checks(off, 25.0).values()), axis=0)
    out = banks.repaired(off, bad)
    return {"idx": p.idx, "left": out[:, 0], "right": out[:, 1]}


@per_line("bank_untangle", "pieces long, crossings long")
def _(p):
    left, right = sides(p)
    k = len(left) // 2
    left[k - 2 : k + 2, 1] -= 150
    a, b, pieces = banks.untangled(left, right, 4.0)
    return {"pieces": [pieces], "crossings": [len(banks.crossing_points(a, b))]}


@per_line("bank_sanity", "warnings string")
def _(p):
    left, right = sides(p)
    return {"warnings": [";".join(banks.sanity(float(p.x.max()) + 1.0, left, right, points(p)))]}


# --- routes, cascades, lattices


def terrain_of(p: pd.DataFrame):
    """Heights over a line: its own, rising away from it."""
    along, height = p.x.to_numpy(), p.h.to_numpy()
    return lambda xy: np.interp(xy[:, 0], along, height) / 50 + 0.02 * np.abs(xy[:, 1] - 40)


def route_grid(p: pd.DataFrame) -> route.Grid:
    return route.cost_grid(points(p), terrain_of(p), water(p), lambda v: np.full(np.shape(v), 1.0), 20.0, 3.0, 3.0, 40.0, 50.0, 10.0, 5.0)


@per_line("route_cost_grid", "station double, offset double, cut double, wet double")
def _(p):
    if len(p) < 2:
        return {"station": [], "offset": [], "cut": [], "wet": []}
    g = route_grid(p)
    st, off = np.meshgrid(g.stations, g.offsets, indexing="ij")
    return {"station": st.ravel(), "offset": off.ravel(), "cut": g.cut.ravel(), "wet": g.wet.ravel()}


@per_line("route_optimised", "idx long, offset double, corridor double, saving double, ok boolean")
def _(p):
    empty = {"idx": [], "offset": [], "corridor": [], "saving": [], "ok": []}
    if len(p) < 6:
        return empty
    try:
        best = route.best_route(route_grid(p), 80.0, 1.0, 3.0, [10.0, 20.0, 40.0])
    except ValueError:
        return empty
    n = len(best["offsets"])
    return {"idx": range(n), "offset": best["offsets"], "corridor": np.full(n, best["corridor"]), "saving": np.full(n, best["saving"]), "ok": np.full(n, best["ok"])}


@per_line("section_volumes_on_terrain", "station double, dredge double, excav double, face double")
def _(p):
    """Station frame, offsets, terrain and water in one: areas of model B."""
    line = planar.Line(points(p))
    at = np.arange(0, line.length + 1e-9, 25.0)
    off = np.arange(-60, 61, 2.0)
    n = planar.normals(line, at, 5.0)
    xy = (line.at(at)[:, None] + off[None, :, None] * n[:, None]).reshape(-1, 2)
    ground, wet = terrain_of(p)(xy).reshape(len(at), -1), planar.inside(xy, water(p)).reshape(len(at), -1)
    surface = grid.template_b(ground, off, np.full(len(at), 10.0), 1.0, 4.0, 3.0, 15.0)
    a = grid.section_areas(ground, wet, surface, 4.0, 2.0)
    return {"station": at, "dredge": a["dredge"], "excav": a["excav"], "face": a["face"]}


@per_line("cascade_level_table", "level double, dredge double, excav double")
def _(p):
    """Volumes of whole lines at several levels, from one table of stations by levels."""
    along, ground = p.x.to_numpy(float), p.h.to_numpy()[:, None] / 50 + np.abs(np.arange(-30, 31, 5.0)) * 0.02
    off = np.arange(-30, 31, 5.0)
    wet = np.broadcast_to(np.abs(off) < 12, ground.shape)

    def areas(level):
        return grid.section_areas(ground, wet, grid.template_a(ground, off, np.full(len(p), 8.0), level - 3, level, 3.0), level, 5.0)

    table = s.level_table(along, areas, [2.0, 3.0, 4.5], 25.0)
    found = [table["volumes"](0.0, along[-1] + 1, v) for v in table["levels"]]
    return {"level": table["levels"], "dredge": [f[0] for f in found], "excav": [f[1] for f in found]}


@per_line("cascade_best_three", "place long, cost double, weirs long, top double")
def _(p):
    places, run = p.x.to_numpy(float), np.append(0.0, np.cumsum(p.h.to_numpy()))
    reach = lambda a, b, level: run[np.searchsorted(places, b)] - run[np.searchsorted(places, a)] + level * (b - a) / 1000
    found = s.cascade(places.tolist(), [2.5, 4.0], float(places[-1]), 200.0, 12.0, 0.0, reach, lambda lift: 40.0 * lift, terminal_level=5.0, best=3)
    return {"place": range(1, len(found) + 1), "cost": [round(f[0], 6) for f in found], "weirs": [len(f[1]) for f in found], "top": [f[1][-1][1] for f in found]}


@per_line("lattice_channel", "cost double, vertices long, states long")
def _(p):
    """Across a line's first 400 m: cheapest poses over its terrain."""
    corridor = [synthetic.closed([(-50, -100), (450, -100), (450, 200), (-50, 200)])]
    t = lattice.terrain_grid(terrain_of(p), [], corridor, 25.0)
    scorer, moves = lattice.Scorer(t, lattice.Section(10.0, 1.0)), lattice.Moves(8, 80.0)
    price = lattice.least_price(scorer, moves)
    goal = (400.0, 40.0)
    found = lattice.solve(scorer, moves, (0.0, 40.0, 0), goal, 40.0, lambda px, py: price * max(0.0, np.hypot(px - goal[0], py - goal[1]) - 40.0))
    return {"cost": [round(found["cost"], 6) if found else None], "vertices": [len(found["line"]) if found else 0], "states": [found["states"] if found else 0]}


# --- rasters


def per_tile(name: str, schema: str):
    def add(solve):
        def whole(p: pd.DataFrame) -> pd.DataFrame:
            z = np.full((8, 8), np.nan)
            z[p.row, p["col"]] = p.z
            out = solve(z)
            r, c = np.indices(out.shape)
            value = schema.split()[0]
            return pd.DataFrame({"raster_id": p.raster_id.iloc[0], "row": r.ravel(), "col": c.ravel(), value: out.ravel()})

        QUERIES[name] = lambda spark, d: s.per_line(x.pixels(spark, d), f"raster_id long, row long, col long, {schema}", whole, "raster_id", "row")
        return solve

    return add


@per_tile("raster_hillshade", "shade double")
def _(z):
    return grid.hillshade(z, 10.0, 10.0)


@per_tile("raster_decimate_any", "z double")
def _(z):
    return grid.decimated(z, 3, 5)


@per_tile("raster_distance", "far double")
def _(z):
    return grid.distance(z > 100, 10.0)


@per_tile("raster_navigable", "open boolean")
def _(z):
    return grid.navigable(np.kron(z > -80, np.ones((3, 3), bool)), 10.0, 8.0, 4.0, 6.0)


@per_tile("raster_line_burn", "touched boolean")
def _(z):
    line = np.array([[1.0, 3.0], [35.0, 60.0 + z[0, 0] % 15], [77.0, 5.0]])
    return grid.line_cells(line, z.shape, 0.0, 80.0, 10.0)


@per_tile("raster_polygon_mask", "inside boolean")
def _(z):
    return grid.polygon_mask([synthetic.closed([(5, 5), (75, 12), (60, 70 + z[0, 0] % 9), (30, 40), (8, 66)])], z.shape, 0.0, 80.0, 10.0)


@per_tile("raster_mosaic", "z double")
def _(z):
    return grid.mosaic([(z[:3, :5], 0.0, 80.0, 10.0), (z[:3, 5:], 50.0, 80.0, 10.0), (z[3:, :5], 0.0, 50.0, 10.0), (z[3:, 5:], 50.0, 50.0, 10.0)])[0]


@per_tile("raster_water_score", "score double")
def _(z):
    big = np.kron(np.nan_to_num(z), np.ones((5, 5)))
    within = np.zeros(big.shape, bool)
    within[12:28, 6:34] = True
    features = np.stack([big / 100 + within, -big / 150, big % 7 / 7 + 2 * within], axis=2)
    score = grid.water_score(features, within, np.ones_like(within), 10.0, least=50)
    return np.zeros(z.shape) if score is None else score[::5, ::5]


@query("raster_window_bilinear")
def _(spark, d):
    """Nine points a tile, read from its array."""

    def solve(p):
        z = np.full((8, 8), np.nan)
        z[p.row, p["col"]] = p.z
        xy = np.array([(a, b) for a in (3.0, 41.5, 78.0) for b in (5.0, 39.0, 74.5)])
        return pd.DataFrame({"raster_id": p.raster_id.iloc[0], "pid": range(9), "z": grid.bilinear(z, 0.0, 80.0, 10.0, xy)})

    return s.per_line(x.pixels(spark, d), "raster_id long, pid long, z double", solve, "raster_id", "row")


# --- networks


def ways_of(p: pd.DataFrame) -> list:
    xy = np.stack([p.x / 111_000 + 4.0, p.y / 111_000 + 6.0], axis=1)
    n, ways = p.idx.tolist(), []
    for k in range(0, len(n) - 1, 5):
        ways.append((k, n[k : k + 6], xy[k : k + 6]))
    for k in range(0, len(n) - 9, 9):
        ways.append((1000 + k, [n[k], n[k + 8]], xy[[k, k + 8]]))
    return ways


@per_line("network_route", "metres double, ways string")
def _(p):
    if len(p) < 2:
        return {"metres": [], "ways": []}
    ways = ways_of(p)
    ends = [ways[0][2][0] + 1e-5, max(ways, key=lambda w: w[2][-1][0])[2][-1] + 1e-5]
    size, _, used = network.Network(ways).route(ends)
    return {"metres": [round(size, 3)], "ways": [";".join(map(str, used))]}


@per_line("network_trace", "part long, kind string, metres double")
def _(p):
    if len(p) < 12:
        return {"part": [], "kind": [], "metres": []}
    xy = ways_of(p)[0][2]
    trace_ = np.concatenate([xy[:4] + 1e-6, xy[4:5] + [0.004, 0.02], [[p.x.max() / 111_000 + 4.0, 6.0]]])
    parts = network.Network(ways_of(p)).match(trace_, 50.0)
    return {"part": range(len(parts)), "kind": [q[0] for q in parts], "metres": [round(q[1], 3) for q in parts]}


@per_line("network_main_stem", "source long, mouth long, metres double")
def _(p):
    if len(p) < 2:
        return {"source": [], "mouth": [], "metres": []}
    a, b, size = network.main_stem(ways_of(p))
    return {"source": [a], "mouth": [b], "metres": [round(size, 3)]}


@per_line("reach_placement", "reach long, a double, b double")
def _(p):
    """Reaches of four vertices each, placed along the line within 300 m of it."""
    line, out = planar.Line(points(p)), []
    for k in range(0, len(p) - 3, 4):
        along, far, _ = line.project(points(p)[k : k + 4] + [0.0, 5.0 * (k % 100)])
        if (far <= 300).any():
            out.append((k // 4, float(along[far <= 300].min()), float(along[far <= 300].max())))
    return {n: [o[i] for o in out] for i, n in enumerate(("reach", "a", "b"))}


@per_line("weirs_implanted", "number long, chainage double, level double")
def _(p):
    bed = np.maximum.accumulate(p.h.to_numpy())
    found = s.crossings_of(bed, p.x.to_numpy(float), 30.0, float(bed[0]), 1000.0, implanted=4.0, start=100.0)
    return {"number": range(1, len(found) + 1), "chainage": [f[0] for f in found], "level": [f[1] for f in found]}

