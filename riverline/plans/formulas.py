"""One query per formula over the vessel table."""

from __future__ import annotations

from pyspark.sql import functions as F

from riverline import fixtures
from riverline.functions import formulas as f

c = F.col
#: name: (Column of the engine, equal SQL)
FORMULAS = {
    "cut_face": (lambda: f.cut_face(c("off"), c("bench"), c("hb"), c("wl") - c("depth"), c("wl"), c("depth"), F.lit(3.0)),
        "CASE WHEN off <= hb THEN wl - depth WHEN off - hb <= 3 * depth THEN wl - depth + (off - hb) / 3 WHEN NOT bench THEN NULL WHEN off - hb - 3 * depth <= 2 THEN wl ELSE wl + (off - hb - 3 * depth - 2) / 1.5 END"),
    "widened_half_width": (lambda: f.widened(c("radius"), c("loa"), c("beam"), 3.0, 3.2, 0.5), "3.2 * beam / 2 + CASE WHEN radius > 0 AND radius < 2000 THEN least(0.5 * loa * loa / greatest(radius, 3 * loa), loa) / 2 ELSE 0 END"),
    "trapezoid_area": (lambda: f.trapezoid(c("hb"), c("depth"), F.lit(3.0)), "(4 * hb + 6 * depth) / 2 * depth"),
    "keel_clearance": (lambda: f.keel_clearance(c("draught"), 0.25, 0.5), "greatest(0.5, 0.25 * draught)"),
    "required_depth": (lambda: f.required_depth(c("draught"), 0.25, 0.5), "draught + greatest(0.5, 0.25 * draught)"),
    "most_draft": (lambda: f.most_draft(c("depth"), 0.25, 0.5), "CASE WHEN depth <= 0 THEN 0 WHEN 0.25 * (depth / 1.25) >= 0.5 THEN depth / 1.25 ELSE greatest(0, depth - 0.5) END"),
    "banded_width": (lambda: f.banded_width(c("radius"), c("loa"), 3.0, 0.5, 800.0, 4),
        """CASE WHEN radius <= 0 OR radius >= 800 THEN 0 WHEN radius < 3 * loa + (greatest(800, 3 * loa + 1) - 3 * loa) / 4 THEN 0.5 * loa * loa / (3 * loa)
        WHEN radius < 3 * loa + (greatest(800, 3 * loa + 1) - 3 * loa) / 4 * 2 THEN 0.5 * loa * loa / (3 * loa + (greatest(800, 3 * loa + 1) - 3 * loa) / 4)
        WHEN radius < 3 * loa + (greatest(800, 3 * loa + 1) - 3 * loa) / 4 * 3 THEN 0.5 * loa * loa / (3 * loa + (greatest(800, 3 * loa + 1) - 3 * loa) / 4 * 2)
        WHEN radius < greatest(800, 3 * loa + 1) THEN 0.5 * loa * loa / (3 * loa + (greatest(800, 3 * loa + 1) - 3 * loa) / 4 * 3) ELSE 0 END"""),
    "straight_width": (lambda: f.straight_width(c("beam"), 3.2), "3.2 * beam"),
    "built_width": (lambda: f.built_width(c("beam"), 1.5, F.create_map(F.lit("wind"), F.lit(0.25), F.lit("current"), F.lit(0.5)), 1.0), "3.25 * beam"),
    "bend_width": (lambda: f.bend_width(c("loa"), c("beam"), c("radius"), 3.2), "3.2 * beam + CASE WHEN radius > 0 THEN loa * loa / (8 * radius) ELSE 0 END"),
    "least_radius": (lambda: f.least_radius(c("loa"), 3.0), "3 * loa"),
    "width_parts": (lambda: f.width_parts(c("beam"), 3.2)["fairway"], "round(3.2 * beam, 2)"),
    "width_at_radius": (lambda: f.width_at_radius(c("loa"), c("beam"), c("radius"), 3.2), "greatest(3.2 * beam, 3.2 * beam + CASE WHEN radius > 0 THEN loa * loa / (8 * radius) ELSE 0 END)"),
    "lateral_room": (lambda: f.lateral_room(c("radius"), c("loa"), c("beam")), "greatest(0, (radius - loa) / 2) + 0.4 * beam"),
    "bend_class": (lambda: f.bend_class(c("off"), c("beam"), F.lit(0.5)), "CASE WHEN off <= 0.5 THEN 'S' WHEN off <= beam + 0.5 THEN 'G' ELSE 'T' END"),
    "closed_form_offset": (lambda: f.closed_form_offset(c("radius"), c("phi"), 3 * c("loa")), "CASE WHEN radius >= 3 * loa OR phi <= 0 THEN 0 ELSE (3 * loa - radius) * (1 / cos(least(phi, pi() * 0.98) / 2) - 1) END"),
    "radius_ok": (lambda: f.radius_ok(c("radius"), 2 * c("loa")), "radius >= 0.98 * (2 * loa)"),
    "check_chord": (lambda: f.check_chord(c("loa")), "loa / 3"),
    "falls_short": (lambda: f.falls_short(c("beam"), F.nullif(c("off"), F.lit(0.0))), "coalesce(nullif(off, 0) < beam, false)"),
    "parabola": (lambda: f.parabola(c("off"), c("beam")), "greatest(0, 1 - (off / beam) * (off / beam))"),
    "haversine": (lambda: F.round(f.haversine(c("lon"), c("lat"), F.lit(5.0), F.lit(45.0)), 2),
        "round(2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(45 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(45)) * pow(sin(radians(5 - lon) / 2), 2)))), 2)"),
    "share_on_segment": (lambda: f.share_on_segment(c("off"), c("wl"), F.lit(0.0), F.lit(0.0), c("beam"), c("depth")), "greatest(0, least(1, (off * beam + wl * depth) / (beam * beam + depth * depth)))"),
    "utm_zone": (lambda: f.utm_zone(c("lon")), "least(60, floor((lon + 180) / 6)::INT + 1)"),
    "bearing": (lambda: f.bearing(c("off") - 20, c("wl") + 1), "(degrees(atan2(off - 20, wl + 1)) + 360) % 360"),
    "wrapped_angle": (lambda: f.wrapped(c("phi") * 7), "phi * 7 - 2 * pi() * ceil((phi * 7 - pi()) / (2 * pi()))"),
    "swot_level": (lambda: f.swot_level(c("z"), c("wl"), c("bench")), "CASE WHEN bench THEN z + wl ELSE z END"),
    "model_alias": (lambda: f.model_alias(F.when(c("bench"), "A ").otherwise("b")), "CASE WHEN bench THEN 'cut-model-a' ELSE 'cut-model-b' END"),
    "failed_checks": (lambda: F.concat_ws(";", f.failed_checks(depth=c("depth") >= c("draught"), width=c("hb") * 2 >= c("beam"), radius=c("radius") >= c("loa"))),
        "concat_ws(';', CASE WHEN depth < draught THEN 'depth' END, CASE WHEN hb * 2 < beam THEN 'width' END, CASE WHEN radius < loa THEN 'radius' END)"),
    "merged_options": (lambda: f.merged_options(F.create_map(F.lit("k"), c("beam"), F.lit("c"), F.lit(1.0)), F.create_map(F.lit("k"), c("loa")))["k"], "loa"),
    "earthworks_cost": (lambda: f.earthworks_cost(c("depth"), c("off"), F.lit(1.5), F.lit(4.0)), "depth * 1.5 + off * 4"),
    "pixel_features": (lambda: F.element_at(f.pixel_features(c("off"), c("wl"), c("z"), c("depth")), 5), "CASE WHEN off + depth > 1e-6 THEN (off - depth) / (off + depth) * 10 ELSE 0 END"),
    "limits_width": (lambda: F.when((c("radius") > 0) & (c("radius") < 800) & (c("off") >= 5), 0.5 * c("loa") * c("loa") / c("radius")).otherwise(0.0),
        "CASE WHEN radius > 0 AND radius < 800 AND off >= 5 THEN 0.5 * loa * loa / radius ELSE 0 END"),
}
TEXT = {"bend_class", "model_alias", "failed_checks", "radius_ok", "falls_short", "utm_zone"}


def query(name: str):
    def run(spark, sf_dir):
        value = FORMULAS[name][0]()
        value = value if name in TEXT else F.round(value.cast("double"), 6) + 0.0
        return fixtures.vessels(spark, sf_dir).select("id", value.alias("value"))

    return run


QUERIES = {f"formula_{name}": query(name) for name in FORMULAS}
SQL = {f"formula_{n}": f"WITH {fixtures.VESSELS} SELECT id, " + (sql if n in TEXT else f"round(({sql})::DOUBLE, 6) + 0.0::DOUBLE") + " AS value FROM vessels" for n, (_, sql) in FORMULAS.items()}
