import itertools

import numpy as np
import pandas as pd
import pytest

from riverline.operators import banks, grid, lattice, network, planar, polygons, route
from riverline.sources import synthetic


def test_the_narrow_stretch_is_too_narrow():
    rings, line = synthetic.narrowing(60.0, 20.0)
    for check in (planar.width_check, planar.kind_checks):
        found = check(line, rings, lambda r: np.full(np.shape(r), 30.4), 255.0, 85.0)
        assert len(found) == 1 and found[0][2] == planar.TOO_NARROW
        assert found[0][:2] == (pytest.approx(974.0, abs=0.01), pytest.approx(1526.0, abs=0.01))


def test_sharp_lines_are_too_tight():
    rings, legs = synthetic.basin(1000.0, 200.0)
    line = np.concatenate([legs[0], legs[1][1:]])
    found = planar.kind_checks(line, rings, lambda r: np.full(np.shape(r), 10.0), 300.0, 100.0)
    assert [k for *_, k in found] == [planar.TOO_TIGHT] and abs(sum(found[0][:2]) / 2 - 1000) < 1
    smooth, arcs = planar.rolling_circle(line, 300.0, 5.0)
    assert arcs and planar.radius_on_chord(smooth, 100.0) >= 0.98 * 300
    assert planar.rolling_circle(line, 300.0, 5.0, water=[])[1] == []


def test_radii_turns_and_resampling():
    a = np.linspace(0, np.pi, 400)
    circle = 50 * np.stack([np.cos(a), np.sin(a)], axis=1)
    assert planar.radius_on_chord(circle, 20.0) == pytest.approx(50, rel=1e-3)
    assert planar.least_radius(circle)[0] == pytest.approx(50, rel=1e-6)
    assert planar.cumulative_turn(circle) == pytest.approx(180, abs=1)
    line = planar.Line([(0, 0), (10, 0), (10, 5)])
    assert line.exact(4.0).tolist() == [[0, 0], [4, 0], [8, 0], [10, 2]]
    assert line.project([(4, 3), (12, 2)])[0].tolist() == [4, 12] and np.sign(line.project([(4, 3), (12, 2)])[2]).tolist() == [1, -1]
    assert line.slice(5, 12).tolist() == [[5, 0], [10, 0], [10, 2]]


def test_loops():
    eight = np.array([(0, 0), (10, 10), (20, 0), (20, 10), (10, 0), (0, 10), (-5, 12)], float)
    assert not planar.is_simple(eight) and planar.loop_verdict(eight, 100.0) == (True, "self-intersecting")
    assert planar.is_simple(planar.cut_loops(eight, 6))
    straight = np.stack([np.arange(50.0), np.zeros(50)], axis=1)
    assert planar.loop_verdict(straight, 49.0) == (False, None)
    assert planar.loop_verdict(straight, 10.0)[1] == "length ratio 4.90 > 3.0 backstop"
    ring = np.array([(0, 0), (4, 0), (4, 4), (0, 0)], float)
    assert planar.is_simple(ring)
    rng = np.random.default_rng(0)
    for _ in range(20):
        p = rng.random((9, 2))
        brute = []
        for i, j in itertools.combinations(range(8), 2):
            if j - i > 1:
                m = np.stack([p[i + 1] - p[i], p[j] - p[j + 1]], axis=1)
                t = np.linalg.solve(m, p[j] - p[i])
                if (t >= 0).all() and (t <= 1).all():
                    brute.append((i, j))
        assert [m[:2] for m in planar.self_meetings(p)] == brute


def test_merged_lines():
    parts = [np.array([(0, 0), (1, 0)]), np.array([(2, 0), (1, 0)]), np.array([(2, 0), (3, 0)]), np.array([(9, 9), (8, 8)])]
    found = sorted(len(m) for m in planar.merged_lines(parts))
    assert found == [2, 4]
    fork = [np.array([(0, 0), (1, 0)]), np.array([(1, 0), (2, 0)]), np.array([(1, 0), (1, 5)])]
    assert len(planar.merged_lines(fork)) == 3


def test_widths_of_water():
    rings = [synthetic.closed([(0, -20), (100, -20), (100, 30), (0, 30)]), synthetic.closed([(40, -5), (60, -5), (60, -15), (40, -15)])]
    line = planar.Line([(0, 0), (100, 0)])
    assert planar.water_width(line, [50.0, 10.0, 50.0], rings).tolist() == [35.0, 50.0, 35.0]
    assert planar.water_width(planar.Line([(0, 50), (100, 50)]), [50.0], rings).tolist() == [0.0]
    assert planar.probed_width(rings, (10, 0), (0, 1)) == 29 + 19 and planar.probed_width(rings, (50, 0), (0, 1)) == 29 + 4
    rows, failed = planar.measured_widths([(0, 0), (100, 0)], [(-5, 30), (105, 30)], [(-5, -20), (45, -20)], 25.0, 100.0)
    assert [r[2] for r in rows] == [50.0, 50.0] and failed == 3
    off = planar.bank_offsets([(0, 0), (50, 0), (100, 0)], [(-5, 30), (105, 30)], [(-5, -20), (60, -20)])
    assert off[:2].tolist() == [[30, -20], [30, -20]] and np.isnan(off[2, 1])


def test_corridors_of_bends():
    bent = np.full(10, 1 / 100)
    assert planar.corridor_holds(bent, 20.0, 0.0, 100.0) and not planar.corridor_holds(bent, 20.0, 0.0, 150.0)
    assert planar.corridor_holds(np.zeros(10), 20.0, 5.0, 100.0)
    wide = planar.least_corridor(bent, 20.0, 150.0)
    assert 0 < wide < 100 and planar.corridor_holds(bent, 20.0, wide, 150.0) and not planar.corridor_holds(bent, 20.0, wide / 4, 150.0)
    phi, least = planar.turn_segments(np.array([0, 0, 0.5, 1.0, 1.0, 0.6]), np.array([np.inf, 90, 80, 70, 60, 50]))
    assert phi[0] == 0 and phi[1:4] == pytest.approx(np.degrees(1.0)) and least[3] == 70 and phi[5] == pytest.approx(np.degrees(0.4))


def test_fillet_touches_both_legs():
    arc = planar.fillet((0, 0), (1, 0), (100, 100), (0, 1), 40.0, 2.0)
    assert arc[0].tolist() == [0, 0] and arc[-1].tolist() == [100, 100]
    assert planar.vertex_radii(arc)[3:-3] == pytest.approx(40.0, rel=1e-6)
    assert planar.fillet((0, 0), (1, 0), (100, 100), (0, 1), 140.0, 2.0) is None and planar.fillet((0, 0), (1, 0), (9, 0), (1, 0), 1.0, 1.0) is None
    line, used = planar.tangent_joins([(0, 0), (100, 0), (100, 100)], [(100, 0)], 200.0, 50.0)
    assert used[0] == pytest.approx(50.0, rel=1e-6) and planar.radius_on_chord(line, 20.0) >= 0.97 * 50


def test_midlines():
    x = np.linspace(0, 100, 21)
    left, right = np.stack([x, np.full(21, 20.0)], axis=1), np.stack([x, np.full(21, -10.0)], axis=1)
    assert planar.paired_centreline(left, right, 10.0)[:, 1] == pytest.approx(5.0)
    assert planar.midline(left, right, [(5, 12), (95, -3)], 10.0)[1:-1, 1] == pytest.approx(5.0, abs=1.0)


def test_box_least_squares_against_a_fine_grid():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.normal(size=(4, 2)), rng.normal(size=4)
        low, high = -rng.random(2), rng.random(2)
        x = planar.box_least_squares(a, b, low, high)
        axes = [np.linspace(lo, hi, 401) for lo, hi in zip(low, high)]
        best = min(((a @ v - b) ** 2).sum() for v in itertools.product(*axes))
        assert (x >= low).all() and (x <= high).all() and ((a @ x - b) ** 2).sum() <= best + 1e-9


def test_fairway_is_straight_in_a_canal_and_clear_of_banks():
    rings, line = synthetic.canal(1000.0, 60.0, 15.0, 3)
    found = planar.fairway(line, rings, 10.0)
    assert np.abs(found[:, 1]).max() < 0.5
    rings, legs = synthetic.basin(800.0, 150.0)
    bent = planar.joined_legs(legs, rings, 15.0)
    assert planar.inside(bent[1:-1], rings).all() and planar.radius_on_chord(bent, 100.0) > 100


def test_route_equals_enumeration():
    rng = np.random.default_rng(1)
    centres = np.stack([np.arange(6) * 50.0, 8 * np.sin(np.arange(6))], axis=1)
    offsets = np.arange(-20, 21, 10.0)
    turn = planar.turns(centres)
    for fairness in (0.0, 30.0):
        cost = rng.integers(0, 20, (6, 5)).astype(float)
        best = np.inf
        for path in itertools.product(range(5), repeat=6):
            o = offsets[list(path)]
            bent = turn[1:-1] + np.diff(np.arctan2(np.diff(o), 50.0))
            if (np.abs(bent) <= np.maximum(50 / 150, np.abs(turn[1:-1])) + 1e-12).all():
                best = min(best, cost[range(6), path].sum() + fairness * (bent**2).sum())
        assert route.steered(offsets, centres, cost, 150.0, 50.0, fairness)[1] == pytest.approx(best)


def test_cost_grid_of_flat_ground():
    g = route.cost_grid([(0, 0), (200, 0)], lambda xy: np.full(len(xy), 4.0), [synthetic.closed([(-9, 0), (300, 0), (300, 99), (-9, 99)])], lambda s: np.full(len(s), 1.0), 20.0, 3.0, 3.0, 30.0, 50.0, 10.0, 1.0)
    assert g.cut == pytest.approx((20 * 3 + 3 * 9) * 50, rel=0.01)  # the trapezoid's area times the step
    assert g.wet[:, 3] == pytest.approx(g.cut[:, 3] / 2, rel=0.05) and (np.diff(g.wet, axis=1) >= -1e-9).all()
    held = route.cost_grid([(0, 0), (200, 0)], lambda xy: np.full(len(xy), 4.0), [], lambda s: np.full(len(s), 1.0), 20.0, 3.0, 3.0, 30.0, 50.0, 10.0, 1.0, [(0, 80, 1)])
    assert held.shut[:2, -1].all() and not held.shut[3:].any()
    best = route.best_route(route.cost_grid([(0, 0), (2000, 0)], lambda xy: np.full(len(xy), 4.0), [synthetic.closed([(-9, 0), (2300, 0), (2300, 99), (-9, 99)])], lambda s: np.full(len(s), 1.0), 20.0, 3.0, 3.0, 30.0, 50.0, 10.0, 1.0), 100.0, 0.0, 1.0, [10.0, 30.0])
    assert best["corridor"] == 30.0 and best["saving"] > 0 and best["ok"] and best["offsets"].max() > 10
    assert route.protected_cut(held, np.zeros(5)) > 0


def test_overlay_areas():
    square = [synthetic.closed([(0, 0), (10, 0), (10, 10), (0, 10)])]
    other = [synthetic.closed([(5, 5), (15, 5), (15, 15), (5, 15)])]
    assert [round(polygons.area(polygons.overlay(square, other, how)), 6) for how in ("union", "intersection", "difference")] == [175, 25, 75]
    beside = [synthetic.closed([(10, 0), (20, 0), (20, 10), (10, 10)])]
    assert polygons.area(polygons.overlay(square, beside, "union")) == pytest.approx(200) and len(polygons.overlay(square, beside, "union")) == 1
    assert polygons.overlay(square, beside, "intersection") == [] and polygons.overlay(square, square, "difference") == []
    hole = [synthetic.closed([(3, 3), (7, 3), (7, 7), (3, 7)])]
    ring = polygons.overlay(square, hole, "difference")
    assert polygons.area(ring) == pytest.approx(84) and [len(p) for p in polygons.parts(ring)] == [2]
    rng = np.random.default_rng(3)
    for _ in range(10):
        a, b = ([synthetic.closed(np.stack([np.cos(t), np.sin(t)], axis=1) * rng.uniform(1, 3, (9, 1)) + rng.random(2))] for t in (np.arange(9) * 2 * np.pi / 9,) * 2)
        p = rng.uniform(-4, 5, (4000, 2))
        for how, test in (("union", np.logical_or), ("intersection", np.logical_and), ("difference", lambda u, v: u & ~v)):
            assert (planar.inside(p, polygons.overlay(a, b, how)) == test(planar.inside(p, a), planar.inside(p, b))).mean() > 0.999


def test_buffers_and_navigable_water():
    square = [synthetic.closed([(0, 0), (100, 0), (100, 100), (0, 100)])]
    assert polygons.area(polygons.buffer(square, -20.0)) == pytest.approx(60 * 60, rel=1e-6)
    assert polygons.area(polygons.buffer(square, 20.0)) == pytest.approx(100 * 100 + 4 * 100 * 20 + np.pi * 400, rel=0.002)
    assert polygons.buffer(square, -60.0) == []
    dumbbell = [synthetic.closed([(0, 0), (100, 0), (100, 45), (200, 45), (200, 0), (300, 0), (300, 100), (200, 100), (200, 55), (100, 55), (100, 100), (0, 100)])]
    assert len(polygons.parts(polygons.navigable_water(dumbbell, 8.0, 2.0))) == 2
    assert len(polygons.parts(polygons.navigable_water(dumbbell, 1.0, 1.0))) == 1
    assert len(polygons.parts(polygons.navigable_water(dumbbell, 1.0, 1.0, 6.0))) == 2
    cells = grid.polygon_mask(dumbbell, (50, 150), 0.0, 100.0, 2.0)
    open_ = grid.navigable(cells, 2.0, 8.0, 2.0)
    assert open_.sum() * 4 == pytest.approx(2 * 80 * 80, rel=0.08)


def test_navigable_water_of_a_long_line():
    """16 times the edges take some 16 times as long, not 256; inside is what is 20 m from the banks."""
    import time

    def bank(n):
        along = np.arange(n) * 200.0
        off = 45 + 20 * np.sin(along / 70)
        return [synthetic.closed(np.concatenate([np.stack([along, off], axis=1), np.stack([along, -off], axis=1)[::-1]]))]

    began = time.process_time()
    found = polygons.navigable_water(bank(160), 15.0, 5.0)
    assert time.process_time() - began < 2.5
    rng = np.random.default_rng(6)
    p = np.stack([rng.uniform(0, 31800, 3000), rng.uniform(-70, 70, 3000)], axis=1)
    ring = bank(160)
    far = planar.Line(ring[0]).project(p)[1]
    clear = np.abs(far - 20) > 0.2
    assert (planar.inside(p, found) == (planar.inside(p, ring) & (far > 20)))[clear].all() and planar.inside(p, found).sum() > 500


def test_navigable_water_has_the_whole_banks(spark):
    """Each line's area is that of the points over 20 m from its banks, all their vertices taken, both ends of the line with them."""
    from riverline.catalog import QUERIES
    from riverline.plans.geometry import sides

    sf = "/root/testdata/sf0.001"
    found = QUERIES["geo_navigable_water"](spark, sf).toPandas().groupby("line_id").area.sum()
    sizes = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().toPandas().set_index("user_id")["count"]
    assert sorted(found.index) == sorted(sizes.index)
    for size in {sizes.min(), sizes.max()}:
        left, right = sides(pd.DataFrame({"x": np.arange(size) * 25.0}))
        ring = synthetic.closed(np.concatenate([right, left[::-1]]))
        a, b = ring[:-1], ring[1:]
        cells = [np.stack([np.full(200, x), np.arange(-100, 150, 1.25)], axis=1) for x in np.arange(ring[:, 0].min() + 0.5, ring[:, 0].max(), 1.0)]
        deep = 0
        for p in cells:
            near = np.abs((a + b)[:, 0] / 2 - p[0, 0]) < 60
            t = np.clip(((p[:, None] - a[near]) * (b - a)[near]).sum(axis=2) / ((b - a)[near] ** 2).sum(axis=1), 0, 1)
            far = np.hypot(*np.moveaxis(p[:, None] - a[near] - t[..., None] * (b - a)[near], 2, 0)).min(axis=1)
            deep += (planar.inside(p, [ring]) & (far > 20)).sum()
        assert found[sizes == size].to_numpy() == pytest.approx(deep * 1.25, rel=0.003)


def test_buffers_of_any_rings():
    """Against distances to all edges: crossing rings, holes, either way about, needles and edges much shorter than the distance."""
    rng = np.random.default_rng(5)
    for k in range(60):
        m = int(rng.integers(3, 40))
        t = np.arange(m) * 2 * np.pi / m
        c = np.stack([np.cos(t), np.sin(t)], axis=1)
        rings = [rng.uniform(-50, 50, (m, 2))] if k % 2 else [c * rng.uniform(40, 60, (m, 1)), c[:: (-1) ** (k // 2)] * rng.uniform(8, 30, (m, 1)), np.array([(45.0, 0), (80, 3), (70, 30), (40, 20)])]
        rings = [synthetic.closed(r) for r in rings]
        by = float(rng.choice([-12, -5, -0.5, 1, 4, 15]))
        p = rng.uniform(-90, 90, (3000, 2))
        a, b = planar.edges(rings)
        s = np.clip(((p[:, None] - a) * (b - a)).sum(axis=2) / ((b - a) ** 2).sum(axis=1), 0, 1)
        far = np.hypot(*np.moveaxis(p[:, None] - a - s[..., None] * (b - a), 2, 0)).min(axis=1)
        within = polygons.even_odd(p, rings)
        want = within | (far <= by) if by > 0 else within & (far > -by)
        clear = np.abs(far - abs(by)) > 0.005 * abs(by)
        assert (polygons.even_odd(p, polygons.buffer(rings, by)) == want)[clear].all()


def test_excavation_sides():
    line = np.array([(0, 0), (200, 0)])
    found = polygons.excavation(line, [(-10, 8), (210, 8)], [(-10, -30), (210, -30)], 20.0, lambda r: np.zeros(np.shape(r)), 10.0, 1.0)
    assert [f["side"] for f in found] == ["left"] and found[0]["area"] == pytest.approx(200 * 12)
    assert polygons.excavation(line, [(-10, 8), (210, 8)], [(-10, -30), (210, -30)], 20.0, lambda r: np.zeros(np.shape(r)), 10.0, 1e6) == []
    _, _, numbers = polygons.channel_limits(line, 20.0, lambda r: np.zeros(np.shape(r)), 10.0)
    assert numbers == {"least_radius": None, "most_extra": 0.0, "mean_extra": 0.0}


def test_rasters_against_brute_force():
    rng = np.random.default_rng(6)
    mask = rng.random((9, 13)) < 0.1
    mask[4, 4] = True
    set_ = np.argwhere(mask)
    want = np.array([[np.hypot(*(set_ - (r, c)).T).min() for c in range(13)] for r in range(9)])
    assert np.allclose(grid.distance(mask, 2.0), 2 * want)
    z = rng.random((6, 10))
    assert np.allclose(grid.decimated(z, 3, 5), z.reshape(3, 2, 5, 2).mean(axis=(1, 3)))
    fine = np.kron(z, np.ones((4, 3)))  # 24 x 30 cells: blocks of 6 x 5
    assert np.allclose(grid.decimated(z, 4, 6), fine.reshape(4, 6, 6, 5).mean(axis=(1, 3)))
    z[2, 2] = np.nan
    assert np.isnan(grid.decimated(z, 3, 5)[1, 1]) and np.isfinite(grid.decimated(z, 3, 5)).sum() == 14
    touched = grid.line_cells([(1.0, 1.0), (27.0, 16.0), (3.0, 18.0)], (4, 6), 0.0, 20.0, 5.0)
    t = np.linspace(0, 1, 200_001)[:, None]
    dense = np.concatenate([np.array([1.0, 1.0]) + t * [26.0, 15.0], np.array([27.0, 16.0]) + t * [-24.0, 2.0]])
    brute = np.zeros((4, 6), bool)
    brute[np.floor((20 - dense[:, 1]) / 5).astype(int), np.floor(dense[:, 0] / 5).astype(int)] = True
    assert np.array_equal(touched, brute)
    slope = np.add.outer(np.arange(5.0)[::-1], np.zeros(5))  # rises to the north
    assert grid.hillshade(slope, 1.0, 1.0)[2, 2] == pytest.approx((np.sin(np.pi / 4) - np.cos(np.pi / 4) * np.sin(np.radians(135))) / np.sqrt(2))
    tiles = [(z[:3], 0.0, 6.0, 1.0), (z[3:], 0.0, 3.0, 1.0)]
    assert np.allclose(grid.mosaic(tiles)[0], z, equal_nan=True)
    for bad in ([tiles[0], (z[3:], 0.0, 2.0, 1.0)], [tiles[0], (z[3:], 0.0, 4.0, 1.0)], [tiles[0], (z[3:], 0.0, 3.0, 2.0)], [tiles[0], (z[3:], 0.5, 3.0, 1.0)]):
        with pytest.raises(ValueError):
            grid.mosaic(bad)
    assert grid.bilinear(slope, 0.0, 5.0, 1.0, [(2.5, 3.0), (0.2, 2.0)])[0] == pytest.approx(2.5)


def test_templates_agree_with_single_sections():
    rng = np.random.default_rng(2)
    off = np.arange(-40, 41, 1.0)
    ground = rng.uniform(-2, 12, (6, len(off)))
    half, grade, level, slope = np.full(6, 8.0), 1.0, 4.0, 3.0
    a = grid.template_a(ground, off, half, grade, level, slope)
    b = grid.template_b(ground, off, half, grade, level, slope, 5.0)
    for i in range(6):
        for side in (1, -1):
            own = np.flatnonzero(off * side > 0)
            own = own[np.argsort(np.abs(off[own]))]
            first = next((abs(off[k]) for k in own if abs(off[k]) <= 17 and ground[i, k] > level), None)
            bench = first is not None and 17 - first > 2
            lit, begun = [], None
            for k in own:
                o = abs(off[k])
                want = 1.0 if o <= 8 else 1 + (o - 8) / 3 if o <= 17 else np.inf if not bench else 4.0 if o <= 19 else 4 + (o - 19) / 1.5
                assert a[i, k] == pytest.approx(want)
                lit.append(ground[i, k] <= want)
            for t, k in enumerate(own):  # the first place beyond the prism from which the ground stays lit for 5 m
                if abs(off[k]) > 17 and t + 5 < len(own) and all(lit[t : t + 6]):
                    begun = abs(off[k])
                    break
            for k in own:
                assert np.isinf(b[i, k]) if begun is not None and abs(off[k]) >= begun else b[i, k] == a[i, k]


def test_lattice_is_the_cheapest():
    rng = np.random.default_rng(5)
    corridor = [synthetic.closed([(0, 0), (200, 0), (200, 160), (0, 160)])]
    heights = rng.uniform(0, 6, (8, 10))
    t = lattice.terrain_grid(lambda xy: heights[np.clip((xy[:, 1] // 20).astype(int), 0, 7), np.clip((xy[:, 0] // 20).astype(int), 0, 9)], [], corridor, 20.0)
    scorer, moves = lattice.Scorer(t, lattice.Section(8.0, 2.0)), lattice.Moves(8, 40.0)
    start, goal = (20.0, 80.0, 0), (170.0, 90.0)
    price = lattice.least_price(scorer, moves, 1)
    plain = lattice.solve(scorer, moves, start, goal, 25.0)
    led = lattice.solve(scorer, moves, start, goal, 25.0, lambda x, y: max(0.0, np.hypot(x - goal[0], y - goal[1]) - 25.0))
    assert plain and led and led["cost"] == pytest.approx(plain["cost"]) and led["states"] <= plain["states"] and price >= 1
    assert planar.inside(plain["line"], corridor).all()
    rest = lattice.cost_to_go(scorer, moves, goal)
    assert rest(*goal) == 0 and rest(20.0, 80.0) > rest(120.0, 80.0) > 0
    assert lattice.solve(scorer, moves, (500.0, 500.0, 0), goal, 25.0) is None


def test_network():
    rng = np.random.default_rng(7)
    place = rng.uniform(0, 0.05, (12, 2)) + [4.0, 6.0]
    ways = [(k, [int(a), int(b)], place[[a, b]]) for k, (a, b) in enumerate(rng.choice(12, (22, 2))) if a != b]
    net = network.Network(ways)
    dist = np.full((12, 12), np.inf)
    for _, (a, b), xy in ways:
        dist[a, b] = dist[b, a] = min(dist[a, b], float(network.metres(*xy)))
    np.fill_diagonal(dist, 0)
    for k in range(12):
        dist = np.minimum(dist, dist[:, k : k + 1] + dist[k])
    used = sorted({n for _, pair, _ in ways for n in pair})
    for a, b in itertools.islice(itertools.combinations(used, 2), 30):
        if np.isfinite(dist[a, b]):
            assert net.route([place[a], place[b]])[0] == pytest.approx(dist[a, b], rel=1e-6, abs=1e-3)
    assert net.snap((9.0, 9.0)) is None
    river = [(1, [0, 1], np.array([(4.0, 6.0), (4.01, 6.0)])), (2, [1, 2], np.array([(4.01, 6.0), (4.03, 6.0)])), (3, [5, 1], np.array([(4.01, 6.05), (4.01, 6.0)]))]
    assert network.main_stem(river)[:2] == (5, 2)
    parts = network.Network(river).match([(4.0, 6.0), (4.01, 6.0), (4.01, 5.95)], 30.0)
    assert [p[0] for p in parts] == ["waterway", "as drawn"]


def test_banks():
    n = 60
    off = np.stack([np.full(n, 50.0), np.full(n, -50.0)], axis=1)
    off[20] = np.nan
    off[30] = [-60, 60]
    off[40, 0] = 200
    flags = banks.bank_checks(off, 25.0)
    assert flags["missing"].nonzero()[0].tolist() == [20] and flags["side"].nonzero()[0].tolist() == [30]
    assert flags["excursion"].nonzero()[0].tolist() == [40] and flags["jump"].nonzero()[0].tolist() == [40] and flags["width"].nonzero()[0].tolist() == [40]
    fixed = banks.repaired(off, np.any(list(flags.values()), axis=0))
    assert np.allclose(fixed, [50, -50])
    x = np.arange(0, 1001, 25.0)
    left, right = np.stack([x, np.where(abs(x - 500) < 20, 160, 40)], axis=1), np.stack([x, np.full(len(x), -40.0)], axis=1)
    a, b, _ = banks.check_and_repair(left, right, [(0, 0), (1000, 0)], 25.0)
    assert np.abs(a[:, 1] - 40).max() < 1e-6 and np.abs(b[:, 1] + 40).max() < 1e-6
    crossed = np.stack([x, np.where(abs(x - 500) < 60, -60, 40.0)], axis=1)
    assert len(banks.crossing_points(crossed, right)) == 2 and banks.sanity(1000.0, crossed, right, left) == ["banks_cross"]
    u, v, pieces = banks.untangled(crossed, right, 5.0)
    assert pieces == 1 and not len(banks.crossing_points(u, v))
    assert banks.sanity(5000.0, left, right, left) == ["left_bank_length", "right_bank_length", "centreline_length"]


def test_water_score_tells_water_from_land():
    rng = np.random.default_rng(8)
    within = np.zeros((60, 60), bool)
    within[20:40, 5:55] = True
    features = rng.normal(0, 0.3, (60, 60, 3)) + np.where(within[..., None], 2.0, 0.0)
    score = grid.water_score(features, within, np.ones_like(within), 10.0)
    assert (score[within] > 0).mean() > 0.95 and (score[~within] < 0).mean() > 0.95 and np.abs(score).max() <= 6
    assert grid.water_score(features, np.zeros_like(within), np.ones_like(within), 10.0) is None
    mean, cov = grid.colour_model(features[within])
    assert np.allclose(cov, np.cov(features[within].T)) and np.allclose(grid.colour_model(features[0, :1])[1], 0)


def test_heap_order_of_equal_nodes():
    ways = [(1, [0, 1], np.array([(4.0, 6.0), (4.01, 6.0)])), (2, [0, 1], np.array([(4.0, 6.0), (4.01, 6.0)])), (3, [1, 2], np.array([(4.01, 6.0), (4.02, 6.0)]))]
    assert network.Network(ways).route([(4.0, 6.0), (4.02, 6.0)])[2] in ([1, 3], [2, 3])
