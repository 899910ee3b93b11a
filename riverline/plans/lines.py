"""Queries of the line operators over the station table."""

from __future__ import annotations

from pyspark.sql import functions as F

from riverline import fixtures
from riverline.operators import line as o

QUERIES: dict = {}
SQL: dict[str, str] = {}
S = fixtures.STATIONS
W = "(PARTITION BY line_id ORDER BY idx)"
KAPPA = f"""
three AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS cx, lead(y) OVER w AS cy FROM stations WINDOW w AS {W}),
sides AS (SELECT *, (x - ax) * (cy - ay) - (cx - ax) * (y - ay) AS crossed,
  sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) * sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)) * sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) AS sides FROM three),
inner_k AS (SELECT *, CASE WHEN sides >= 1e-9 THEN 2 * crossed / sides WHEN sides IS NOT NULL THEN 0 END AS k0,
  CASE WHEN sides > 0 AND abs(crossed) > 1e-12 THEN sides / (2 * abs(crossed)) END AS radius FROM sides),
bent AS (SELECT *, coalesce(k0, lead(k0) OVER w, lag(k0) OVER w, 0) AS kappa FROM inner_k WINDOW w AS {W})"""
DIST = f"""
steps AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS d FROM stations WINDOW w AS {W}),
along AS (SELECT *, sum(d) OVER (PARTITION BY line_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS along FROM steps)"""


def r6(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n) + 0.0


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def pts(spark, d):
    return fixtures.stations(spark, d)


def bent(spark, d):
    return o.radius(o.curvature(pts(spark, d)))


@query("line_chainages", f"WITH {S}, {DIST} SELECT line_id, idx, round(along, 6) AS along FROM along")
def _(spark, d):
    return o.chainages(pts(spark, d)).select("line_id", "idx", r6("along").alias("along"))


@query("line_curvature", f"WITH {S}, {KAPPA} SELECT line_id, idx, round(kappa, 9) + 0.0 AS kappa FROM bent")
def _(spark, d):
    return o.curvature(pts(spark, d)).select("line_id", "idx", r6("kappa", 9).alias("kappa"))


@query("line_circumradius", f"WITH {S}, {KAPPA} SELECT line_id, idx, round(radius, 4) AS radius FROM bent")
def _(spark, d):
    return o.radius(pts(spark, d)).select("line_id", "idx", r6("radius", 4).alias("radius"))


@query("line_local_radius", f"""WITH {S}, three AS (SELECT *, lag(x, 2) OVER w AS ax, lag(y, 2) OVER w AS ay, lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy FROM stations WINDOW w AS {W}),
r AS (SELECT line_id, idx, CASE WHEN abs((x - ax) * (cy - ay) - (cx - ax) * (y - ay)) > 1e-12 THEN
  sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) * sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)) * sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) / (2 * abs((x - ax) * (cy - ay) - (cx - ax) * (y - ay))) END AS r FROM three)
SELECT line_id, idx, round(avg(r) OVER (PARTITION BY line_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 3) AS radius FROM r""")
def _(spark, d):
    return o.local_radius(pts(spark, d)).select("line_id", "idx", r6("radius", 3).alias("radius"))


@query("line_rolling_radius_distance", f"WITH {S}, {KAPPA} SELECT line_id, idx, round(avg(CASE WHEN radius > 0 THEN radius END) OVER (PARTITION BY line_id ORDER BY chainage RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING), 3) AS mean_radius FROM bent")
def _(spark, d):
    return o.rolling_radius_by_distance(bent(spark, d), 100.0).select("line_id", "idx", r6("mean_radius", 3).alias("mean_radius"))


@query("line_rolling_radius_samples", f"WITH {S}, {KAPPA} SELECT line_id, idx, round(avg(CASE WHEN radius > 0 THEN radius END) OVER (PARTITION BY line_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 3) AS mean_radius FROM bent")
def _(spark, d):
    return o.rolling_radius_by_samples(bent(spark, d), 75.0, 25.0).select("line_id", "idx", r6("mean_radius", 3).alias("mean_radius"))


TURN = f"turned AS (SELECT *, lead(y) OVER w - y AS dy1, lead(x) OVER w - x AS dx1, y - lag(y) OVER w AS dy0, x - lag(x) OVER w AS dx0 FROM stations WINDOW w AS {W}), angles AS (SELECT *, atan2(dy1, dx1) - atan2(dy0, dx0) AS a FROM turned), turns AS (SELECT *, coalesce(a - 2 * pi() * ceil((a - pi()) / (2 * pi())), 0) AS turn FROM angles)"


@query("line_turn_angles", f"WITH {S}, {TURN} SELECT line_id, idx, round(turn, 8) + 0.0 AS turn FROM turns")
def _(spark, d):
    return o.turn_angles(pts(spark, d)).select("line_id", "idx", r6("turn", 8).alias("turn"))


@query("line_cumulative_turn", f"WITH {S}, {TURN} SELECT line_id, round(degrees(sum(abs(turn))), 4) AS turn_deg FROM turns GROUP BY line_id")
def _(spark, d):
    return o.cumulative_turn(pts(spark, d)).select("line_id", r6("turn_deg", 4).alias("turn_deg"))


@query("line_unwrap", f"""WITH {S}, a AS (SELECT line_id, idx, (idx * 17 % 50) / 8.0::DOUBLE AS a FROM stations), s AS (SELECT *, a - lag(a) OVER {W} AS step FROM a),
c AS (SELECT *, coalesce(-2 * pi() * ceil((step - pi()) / (2 * pi())), 0) AS c FROM s)
SELECT line_id, idx, round(a + sum(c) OVER (PARTITION BY line_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS unwrapped FROM c""")
def _(spark, d):
    p = pts(spark, d).withColumn("a", (F.col("idx") * 17 % 50) / 8.0)
    return o.unwrap(p, "a").select("line_id", "idx", r6("unwrapped").alias("unwrapped"))


FILL = f"""ends AS (SELECT *, last_value(CASE WHEN z IS NOT NULL THEN idx END IGNORE NULLS) OVER u AS i0, last_value(z IGNORE NULLS) OVER u AS v0,
 first_value(CASE WHEN z IS NOT NULL THEN idx END IGNORE NULLS) OVER v AS i1, first_value(z IGNORE NULLS) OVER v AS v1 FROM stations
 WINDOW u AS (PARTITION BY line_id ORDER BY idx ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY line_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT *, coalesce(z, v0 + (v1 - v0) * (idx - i0) / (i1 - i0), v0, v1, 0) AS f FROM ends)"""


@query("line_fill_missing", f"WITH {S}, {FILL} SELECT line_id, idx, round(f, 6) AS filled FROM filled")
def _(spark, d):
    return o.fill_missing(pts(spark, d), "z").select("line_id", "idx", r6("filled").alias("filled"))


LOW = "(PARTITION BY line_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"


@query("line_rolling_percentile", f"WITH {S} SELECT line_id, idx, round(quantile_cont(z, 0.2) OVER {LOW}, 6) AS low FROM stations")
def _(spark, d):
    return o.rolling_percentile(pts(spark, d), "z", 10, 0.2).select("line_id", "idx", r6("low").alias("low"))


@query("line_overall_bottom", f"""WITH {S}, {FILL}, p AS (SELECT line_id, idx, quantile_cont(f, 0.2) OVER {LOW} AS p FROM filled),
m AS (SELECT line_id, idx, avg(p) OVER (PARTITION BY line_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS m FROM p)
SELECT line_id, idx, round(max(m) OVER (PARTITION BY line_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 5) AS bottom FROM m""")
def _(spark, d):
    return o.overall_bottom(pts(spark, d), "z", 25.0, 0.2, 250.0, 500.0).select("line_id", "idx", r6("bottom", 5).alias("bottom"))


@query("line_bed_profile", f"""WITH {S}, {FILL}, n AS (SELECT *, count(*) OVER (PARTITION BY line_id) AS n FROM filled),
heads AS (SELECT line_id, avg(CASE WHEN idx < greatest(1, n // 10) THEN f END) > avg(CASE WHEN idx >= n - greatest(1, n // 10) THEN f END) AS flip FROM n GROUP BY line_id)
SELECT line_id, CASE WHEN flip THEN n - 1 - idx ELSE idx END AS idx, round(f, 6) AS z FROM n JOIN heads USING (line_id)""")
def _(spark, d):
    p = o.fill_missing(pts(spark, d), "z").withColumn("n", F.count("*").over(o.whole())).withColumn("m", F.greatest(F.lit(1), F.floor(F.col("n") / 10)))
    head, tail = F.avg(F.when(F.col("idx") < F.col("m"), F.col("filled"))).over(o.whole()), F.avg(F.when(F.col("idx") >= F.col("n") - F.col("m"), F.col("filled"))).over(o.whole())
    return p.withColumn("i", F.when(head > tail, F.col("n") - 1 - F.col("idx")).otherwise(F.col("idx"))).select("line_id", F.col("i").alias("idx"), r6("filled").alias("z"))


@query("line_moving_average", f"""WITH {S}, e AS (SELECT *, count(*) OVER (PARTITION BY line_id) AS n, first_value(y) OVER u AS a, last_value(y) OVER u AS b FROM stations
WINDOW u AS (PARTITION BY line_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT line_id, idx, round((sum(y) OVER (PARTITION BY line_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + greatest(0, 3 - idx) * a + greatest(0, idx + 4 - n) * b) / 7, 6) AS smooth FROM e""")
def _(spark, d):
    return o.moving_average(pts(spark, d), "y", 7).select("line_id", "idx", r6("smooth").alias("smooth"))


@query("line_binomial", f"""WITH {S}, e AS (SELECT *, first_value(y) OVER u AS a, last_value(y) OVER u AS b FROM stations WINDOW u AS (PARTITION BY line_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT line_id, idx, round((coalesce(lag(y, 2) OVER w, a) + 4 * coalesce(lag(y) OVER w, a) + 6 * y + 4 * coalesce(lead(y) OVER w, b) + coalesce(lead(y, 2) OVER w, b)) / 16, 6) AS smooth FROM e WINDOW w AS {W}""")
def _(spark, d):
    return o.binomial(pts(spark, d), "y", 1).select("line_id", "idx", r6("smooth").alias("smooth"))


@query("line_chaikin", f"""WITH {S}, n AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lag(x) OVER w AS x0 FROM stations WINDOW w AS {W}),
p AS (SELECT line_id, idx, 0 AS k, x, y FROM n WHERE x0 IS NULL OR x1 IS NULL UNION ALL SELECT line_id, idx, 1, x + (x1 - x) * 0.25, y + (y1 - y) * 0.25 FROM n WHERE x1 IS NOT NULL
 UNION ALL SELECT line_id, idx, 2, x + (x1 - x) * 0.75, y + (y1 - y) * 0.75 FROM n WHERE x1 IS NOT NULL)
SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY idx, k) - 1 AS idx, round(x, 6) AS x, round(y, 6) AS y FROM p""")
def _(spark, d):
    return o.chaikin(pts(spark, d), 1).select("line_id", "idx", r6("x").alias("x"), r6("y").alias("y"))


RUNS = f"""signs AS (SELECT *, CASE WHEN abs(kappa) >= 1e-6 THEN sign(kappa) END AS s FROM bent),
marks AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM lag(s) OVER {W} AND idx > 0 THEN 0 ELSE 1 END AS c FROM signs),
isles AS (SELECT *, sum(c) OVER (PARTITION BY line_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS g FROM marks),
found AS (SELECT line_id, g, any_value(s)::DOUBLE AS key, min(idx) AS i0, max(idx) AS i1, count(*) AS n, min(radius) AS least_radius FROM isles WHERE s IS NOT NULL GROUP BY line_id, g HAVING count(*) >= 2)"""


@query("line_curvature_runs", f"WITH {S}, {KAPPA}, {RUNS} SELECT line_id, key, i0, i1, n FROM found")
def _(spark, d):
    return o.curvature_runs(bent(spark, d), 2).select("line_id", "key", "i0", "i1", "n")


@query("line_meander_runs", f"WITH {S}, {KAPPA}, {RUNS} SELECT line_id, i0, i1, round(least_radius, 3) AS least_radius FROM found WHERE least_radius <= 30")
def _(spark, d):
    return o.meander_runs(bent(spark, d), 30.0, 2).select("line_id", "i0", "i1", r6("least_radius", 3).alias("least_radius"))


@query("line_meanders", f"WITH {S}, {KAPPA}, {RUNS} SELECT line_id, i0, row_number() OVER (PARTITION BY line_id ORDER BY i0) AS number FROM found WHERE least_radius <= 30")
def _(spark, d):
    return o.meanders(bent(spark, d), 30.0, 2).select("line_id", "i0", "number")


@query("line_bend_units", f"""WITH {S}, {KAPPA}, sm AS (SELECT *, avg(kappa) OVER (PARTITION BY line_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ks FROM bent),
sg AS (SELECT *, CASE WHEN round(ks, 12) < 0 THEN -1 ELSE 1 END AS s FROM sm), mk AS (SELECT *, CASE WHEN s = lag(s) OVER {W} THEN 0 ELSE 1 END AS c FROM sg),
g AS (SELECT *, sum(c) OVER (PARTITION BY line_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS g FROM mk)
SELECT line_id, min(idx) AS i0, max(idx) AS i1, round(max(abs(ks)), 8) AS sharpest FROM g GROUP BY line_id, g, s HAVING count(*) >= 2""")
def _(spark, d):
    smooth = o.curvature(pts(spark, d)).withColumn("ks", F.avg("kappa").over(o.rows(2, 2)))
    found = o.runs(smooth, F.when(F.round("ks", 12) < 0, -1).otherwise(1), F.max(F.abs("ks")).alias("m"), least=2)
    return found.select("line_id", "i0", "i1", r6("m", 8).alias("sharpest"))


for _kind, _step in (("floor", 40.0), ("exact", 35.0), ("ceil", 40.0), ("frame", 25.0)):
    _count = {"exact": f"ceil((total + 1e-9) / {_step})::BIGINT", "floor": f"floor(total / {_step})::BIGINT + 1", "ceil": f"greatest(ceil(total / {_step})::BIGINT + 1, 3)", "frame": f"floor(total / {_step})::BIGINT + 1"}[_kind]
    _h = f"{_step}::DOUBLE" if _kind in ("floor", "exact") else f"CASE WHEN n > 1 THEN total / (n - 1) ELSE {_step}::DOUBLE END"

    @query(f"line_resample_{_kind}", f"""WITH {S}, {DIST}, t AS (SELECT line_id, max(along) AS total FROM along GROUP BY line_id HAVING max(along) > 0), c AS (SELECT line_id, total, {_count} AS n FROM t),
h AS (SELECT line_id, total, n, {_h} AS h FROM c), k AS (SELECT line_id, h, total, unnest(range(n)) AS k FROM h),
seg AS (SELECT line_id, along, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(along) OVER w AS s1 FROM along WINDOW w AS {W})
SELECT k.line_id, k.k, round(x + (least(k.k * h, total) - along) / (s1 - along) * (x1 - x), 4) + 0.0 AS px, round(y + (least(k.k * h, total) - along) / (s1 - along) * (y1 - y), 4) + 0.0 AS py FROM k JOIN seg ON k.line_id = seg.line_id AND s1 > along
 AND ((least(k.k * h, total) >= along AND least(k.k * h, total) < s1) OR (s1 = total AND least(k.k * h, total) >= total))""")
    def _(spark, d, kind=_kind, step=_step):
        return o.resampled(pts(spark, d), step, kind).select("line_id", "k", r6("px", 4).alias("px"), r6("py", 4).alias("py"))


@query("line_climbs", f"""WITH {S}, s AS (SELECT line_id, z - lag(z) OVER {W} AS d FROM stations WHERE z IS NOT NULL)
SELECT line_id, round(coalesce(sum(d) FILTER (WHERE d > 0), 0), 4) AS ascent, round(coalesce(sum(d) FILTER (WHERE d < 0), 0), 4) + 0.0 AS descent FROM s GROUP BY line_id""")
def _(spark, d):
    return o.climbs(pts(spark, d)).select("line_id", r6("ascent", 4).alias("ascent"), r6("descent", 4).alias("descent"))


@query("line_running_median", f"""WITH {S}, e AS (SELECT *, count(*) OVER (PARTITION BY line_id) AS n, first_value(y) OVER u AS a, last_value(y) OVER u AS b, list(y) OVER (PARTITION BY line_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l
 FROM stations WINDOW u AS (PARTITION BY line_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT line_id, idx, list_sort(list_concat(list_concat([a for i in range(greatest(0, 2 - idx))], l), [b for i in range(greatest(0, idx + 3 - n))]))[3] AS median FROM e""")
def _(spark, d):
    return o.running_median(pts(spark, d), "y", 5).select("line_id", "idx", "median")


@query("line_upper_median", f"WITH {S}, r AS (SELECT line_id, z, row_number() OVER (PARTITION BY line_id ORDER BY z) - 1 AS r, count(*) OVER (PARTITION BY line_id) AS n FROM stations WHERE z IS NOT NULL) SELECT line_id, z AS median FROM r WHERE r = n // 2")
def _(spark, d):
    return o.upper_median(pts(spark, d), "line_id", "z")


SPANS = "spans AS (SELECT line_id, chainage AS a, chainage + (idx * 13 % 4) * 20.0 AS b FROM stations WHERE z IS NOT NULL)"


@query("line_merge_intervals", f"""WITH {S}, {SPANS}, m AS (SELECT *, max(b) OVER (PARTITION BY line_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans),
g AS (SELECT *, sum(CASE WHEN a <= r THEN 0 ELSE 1 END) OVER (PARTITION BY line_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT line_id, min(a) AS a, max(b) AS b FROM g GROUP BY line_id, g""")
def _(spark, d):
    spans = pts(spark, d).where("z IS NOT NULL").select("line_id", F.col("chainage").alias("a"), (F.col("chainage") + (F.col("idx") * 13 % 4) * 20.0).alias("b"))
    return o.merged_intervals(spans)


@query("line_stitched_pools", f"WITH {S}, s AS (SELECT line_id, chainage AS start FROM stations WHERE z > 200) SELECT line_id, start, coalesce(lead(start) OVER (PARTITION BY line_id ORDER BY start), 99999.0) AS stop FROM s")
def _(spark, d):
    return o.stitched(pts(spark, d).where("z > 200").select("line_id", F.col("chainage").alias("start")), F.lit(99999.0))


@query("line_offset_bounds", f"WITH {S}, {KAPPA} SELECT line_id, idx, round(CASE WHEN kappa < 0 THEN -greatest(0, radius - 10) END, 3) + 0.0 AS low, round(CASE WHEN kappa > 0 THEN greatest(0, radius - 10) END, 3) + 0.0 AS high FROM bent")
def _(spark, d):
    return o.offset_bounds(bent(spark, d), 10.0).select("line_id", "idx", r6("low", 3).alias("low"), r6("high", 3).alias("high"))


@query("line_setting_out", f"WITH {S}, n AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM stations WINDOW w AS {W}) SELECT line_id, idx, x, y, round((degrees(atan2(dx, dy)) + 360) % 360, 5) AS bearing FROM n WHERE idx % 4 = 0")
def _(spark, d):
    from riverline.functions.formulas import bearing

    p = pts(spark, d).withColumn("b", bearing(o.lead("x") - F.col("x"), o.lead("y") - F.col("y")))
    return p.where("idx % 4 = 0").select("line_id", "idx", "x", "y", r6("b", 5).alias("bearing"))
