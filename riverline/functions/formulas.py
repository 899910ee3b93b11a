"""Element-wise formulas as Column builders. Missing numbers are null; "no cut" and "no limit" are null, never infinity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres and ratios of the cut model and of the checks.
BERM, ABOVE_SLOPE, WIDEN_RMAX, RADIUS_SHARE, BANK_CUT = 2.0, 1.5, 2000.0, 0.98, 0.40
EARTH = 6371008.8
COS_CAP = 0.98


def number(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def cut_face(off, bench, hb, grade, wl, depth, wet_slope) -> Column:
    """Design surface at an offset: bed, wet batter, berm at the water line and slope above where benched."""
    beyond = off - hb
    dry = beyond - wet_slope * depth
    return F.when(off <= hb, grade).when(dry <= 0, grade + beyond / wet_slope).when(~bench, None).when(dry <= BERM, wl).otherwise(wl + (dry - BERM) / ABOVE_SLOPE)


def model_alias(name: Column) -> Column:
    known = {"a": "cut-model-a", "cut-model-a": "cut-model-a", "b": "cut-model-b", "cut-model-b": "cut-model-b"}
    low = F.lower(F.trim(name))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), low), name)


def widened(radius, loa, beam, multiple, width, c, rmax=WIDEN_RMAX) -> Column:
    """Half width: half the straight width plus half the bend widening, where the radius is known, positive and small."""
    bend = F.least(number(c) * loa * loa / F.greatest(radius, number(multiple) * loa), loa)
    return number(width) * beam / 2 + F.when((radius > 0) & (radius < rmax), bend / 2).otherwise(0.0)


def trapezoid(hb, depth, slope) -> Column:
    return (2 * hb + 2 * (hb + slope * depth)) / 2 * depth


def keel_clearance(draft, share, least) -> Column:
    return F.greatest(number(least), number(share) * draft)


def required_depth(draft, share, least) -> Column:
    return draft + keel_clearance(draft, share, least)


def most_draft(depth, share, least) -> Column:
    by_share = depth / (1 + number(share))
    return F.when(depth <= 0, 0.0).when(number(share) * by_share >= least, by_share).otherwise(F.greatest(F.lit(0.0), depth - least))


def banded_width(radius, loa, multiple: float, c: float, rmax: float, bands: int) -> Column:
    """Widening by the lower edge of the radius band; the outermost band gets none."""
    low = multiple * loa
    upper = F.greatest(F.lit(rmax), low + 1)
    step = (upper - low) / bands
    edge = lambda k: low + step * k if k < bands else upper
    width = lambda k: c * loa * loa / edge(k) if k < bands else F.lit(0.0)
    chosen = reduce(lambda rest, k: F.when(radius < edge(k + 1), width(k)).otherwise(rest), range(bands - 1, -1, -1), width(bands))
    return F.when((radius <= 0) | (radius >= rmax) | (loa <= 0), 0.0).otherwise(chosen)


def straight_width(beam, k) -> Column:
    return number(k) * beam


def built_width(beam, lane: float, extras: Column, banks: float) -> Column:
    """Lane, additional widths (a map of name to multiple) and banks, in beams."""
    total = F.aggregate(F.map_values(extras), F.lit(0.0), lambda a, b: a + b)
    return (F.lit(lane) + total + banks) * beam


def bend_width(loa, beam, radius, k) -> Column:
    return straight_width(beam, k) + F.when(radius > 0, loa * loa / (8 * radius)).otherwise(0.0)


def least_radius(loa, k) -> Column:
    return number(k) * loa


def width_parts(beam, k) -> Column:
    """Named parts of the straight width, rounded half to even as decimals."""
    two = F.bround((number(k) * beam).cast("decimal(38,18)"), 2).cast("double")
    return F.create_map(F.lit("fairway"), two, F.lit("multiple"), number(k))


def width_at_radius(loa, beam, radius, k) -> Column:
    return F.greatest(straight_width(beam, k), bend_width(loa, beam, radius, k))


def lateral_room(wetted, top, bottom, share=BANK_CUT) -> Column:
    return F.greatest(F.lit(0.0), (wetted - top) / 2) + share * bottom


def bend_class(e, room, tolerance) -> Column:
    return F.when(e <= tolerance, "S").when(e <= room + tolerance, "G").otherwise("T")


def closed_form_offset(radius, turn, least) -> Column:
    """(least - radius) * (sec(turn / 2) - 1) for a bend tighter than the least radius."""
    half = F.least(turn, F.lit(3.141592653589793 * COS_CAP)) / 2
    return F.when((radius >= least) | (turn <= 0), 0.0).otherwise((least - radius) * (1 / F.cos(half) - 1))


def radius_ok(measured, least) -> Column:
    return F.coalesce(~F.isnan(measured) & (measured >= RADIUS_SHARE * least), F.lit(False))


def check_chord(least) -> Column:
    return least / 3


def falls_short(required, river) -> Column:
    return F.coalesce(~F.isnan(river) & (river < required), F.lit(False))


def parabola(off, half) -> Column:
    t = off / half
    return F.when(half > 0, F.greatest(F.lit(0.0), 1 - t * t)).otherwise(0.0)


def haversine(lon1, lat1, lon2, lat2) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def share_on_segment(px, py, ax, ay, bx, by) -> Column:
    """Clamped share of the way from a to b nearest to p."""
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    return F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length))).otherwise(0.0)


def utm_zone(lon) -> Column:
    return F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)


def bearing(dx, dy) -> Column:
    return F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))


def wrapped(angle) -> Column:
    """An angle in (-pi, pi]."""
    turn = 6.283185307179586
    return angle - turn * F.ceil((angle - 3.141592653589793) / turn)


def swot_level(wse, geoid, ellipsoidal) -> Column:
    return F.when(ellipsoidal, wse + geoid).otherwise(wse)


def failed_checks(**checks: Column) -> Column:
    """Names of the checks that are false, in the order given; unknown ones don't fail."""
    return F.filter(F.array(*(F.when(~c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())


def merged_options(base: Column, over: Column) -> Column:
    """Maps joined, the later one wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def earthworks_cost(wet, dry, wet_weight, dry_weight) -> Column:
    return wet * wet_weight + dry * dry_weight


def pixel_features(green, red, nir, swir) -> Column:
    total = green + swir
    index = F.when(total > 1e-6, (green - swir) / total * 10).otherwise(0.0)
    return F.array(green * 100, red * 100, nir * 100, swir * 100, index)
