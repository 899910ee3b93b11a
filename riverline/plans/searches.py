"""Queries of the sequential searches; tests hold them against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riverline import fixtures as x
from riverline.operators import search as s
from riverline.operators.line import fill_missing

SQL: dict[str, str] = {}


def filled(spark, d):
    return fill_missing(x.stations(spark, d), "z")


def never_rising(spark, d):
    def solve(p):
        return pd.DataFrame({"line_id": p.line_id, "idx": p.idx, "level": np.round(s.never_rising(p.filled.to_numpy()), 6)})

    return s.per_line(filled(spark, d), "line_id long, idx long, level double", solve)


def taubin(spark, d):
    def solve(p):
        xy = s.taubin(p[["x", "y"]].to_numpy(), 10)
        return pd.DataFrame({"line_id": p.line_id, "idx": p.idx, "x": xy[:, 0], "y": xy[:, 1]})

    return s.per_line(x.stations(spark, d), "line_id long, idx long, x double, y double", solve)


def weirs(spark, d):
    def solve(p):
        bed = np.maximum.accumulate(p.filled.to_numpy())
        found = s.crossings_of(bed, p.chainage.to_numpy(), 25.0, float(bed[0]), 1000.0)
        return pd.DataFrame({"line_id": int(p.line_id[0]), "number": range(1, len(found) + 1), "chainage": [f[0] for f in found], "level": [f[1] for f in found]})

    return s.per_line(filled(spark, d), "line_id long, number long, chainage double, level double", solve)


def level_path(spark, d):
    levels = np.arange(0.0, 500.0, 25.0)

    def solve(p):
        path, cost = s.cheapest_levels(np.abs(p.filled.to_numpy()[:, None] - levels[None, :]), 5.0, 2)
        return pd.DataFrame({"line_id": p.line_id, "idx": p.idx, "level": levels[path], "total": round(cost, 6)})

    return s.per_line(filled(spark, d), "line_id long, idx long, level double, total double", solve)


def cascades(spark, d):
    """Every vertex is a site, and a line's own end its terminal."""

    def solve(p):
        places, run = p.chainage.to_numpy(float), np.append(0.0, np.cumsum(p.filled.to_numpy(float)))

        def reach(a, b, level):
            return run[np.searchsorted(places, b)] - run[np.searchsorted(places, a)] + level * (b - a) / 1000

        found = s.cascade(places.tolist(), [2.5, 4.0], float(places[-1]), 150.0, 12.0, 0.0, reach, lambda lift: 40.0 * lift)
        total, chain = found[0] if found else (0.0, [])
        return pd.DataFrame({"line_id": np.full(len(chain), p.line_id[0]), "chainage": [c[0] for c in chain], "level": [c[1] for c in chain], "total": np.full(len(chain), round(total, 6))})

    return s.per_line(filled(spark, d), "line_id long, chainage double, level double, total double", solve)


def lateral_jumps(spark, d):
    def solve(p):
        return pd.DataFrame({"line_id": p.line_id, "idx": p.idx, "jump": s.jumps(p.z.to_numpy(float), 150.0)})

    return s.per_line(x.stations(spark, d), "line_id long, idx long, jump boolean", solve)


def monotone_projection(spark, d):
    def solve(p):
        xy = p[["x", "y"]].to_numpy()
        return pd.DataFrame({"line_id": p.line_id, "idx": p.idx, "onto": s.monotone(xy, s.taubin(xy, 5), 3)})

    return s.per_line(x.stations(spark, d), "line_id long, idx long, onto long", solve)


def network_distances(spark, d):
    def solve(p):
        n = p.idx.tolist()
        edges = [(a, b, 25.0) for a, b in zip(n, n[1:])] + [(a, a + 7, 60.0) for a in n if a + 7 in set(n) and a % 3 == 0]
        found = s.shortest(edges, 0)
        return pd.DataFrame({"line_id": int(p.line_id[0]), "idx": list(found), "dist": list(found.values())})

    return s.per_line(x.stations(spark, d), "line_id long, idx long, dist double", solve)


QUERIES = {
    "search_never_rising": never_rising, "search_taubin": taubin, "search_weirs": weirs, "search_level_path": level_path,
    "search_cascade": cascades, "search_lateral_jumps": lateral_jumps, "search_monotone_projection": monotone_projection, "search_network_distances": network_distances,
}
