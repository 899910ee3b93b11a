"""Plane geometry of lines and polygons as numpy arrays: one line or polygon is one task's value.

A line is an (n, 2) array, a ring a closed one, a polygon set a list of rings (holes included, even-odd). Radii of straights are
infinite, widths outside water 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Tolerance of radius checks, step and accuracy of failing runs, loop limits, heading and offset grids of the corridor test.
RADIUS_SHORT, RUN_STEP, RUN_ACCURACY = 0.02, 10.0, 0.01
LOOP_TURN, LOOP_RATIO = 1080.0, 3.0
OFFSETS, HEADINGS, STEEPEST, CONTROLS = 81, 41, 80.0, 9
WIDEST_OFFSET, OFFSET_ACCURACY = 300.0, 0.5
LONGEST_STRIDE = 5.0
FOLD = 0.9


class Line:
    """A line that can be read by distance along it."""

    def __init__(self, points):
        self.points = np.asarray(points, float).reshape(-1, 2)
        self.along = np.append(0.0, np.cumsum(np.hypot(*np.diff(self.points, axis=0).T)))
        self.length = float(self.along[-1])

    def at(self, s) -> np.ndarray:
        s = np.asarray(s, float)
        return np.stack([np.interp(s, self.along, self.points[:, k]) for k in (0, 1)], axis=-1)

    def direction(self, s, reach: float) -> np.ndarray:
        """Unit vectors of chords of 2 * reach about s, shifted inwards at the ends."""
        span = min(2 * reach, self.length)
        first = np.clip(np.asarray(s, float) - reach, 0, max(0.0, self.length - span))
        d = self.at(first + span) - self.at(first)
        size = np.hypot(d[..., 0], d[..., 1])[..., None]
        return np.where(size > 0, d / np.where(size > 0, size, 1), [1.0, 0.0])

    def radius(self, s, chord: float) -> np.ndarray:
        """Circumradius of three points over a chord, shifted inwards at the ends."""
        if self.length < chord:
            return np.full(np.shape(s), np.inf)
        mid = np.clip(s, chord / 2, self.length - chord / 2)
        return circumradius(self.at(mid - chord / 2), self.at(mid), self.at(mid + chord / 2))

    def project(self, points) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distance along, distance from, side > 0 on the left) of each point; the first of equal segments."""
        p = np.asarray(points, float).reshape(-1, 1, 2)
        a, d = self.points[:-1], np.diff(self.points, axis=0)
        square = (d**2).sum(axis=1)
        share = np.clip(((p - a) * d).sum(axis=2) / np.where(square > 0, square, 1), 0, 1)
        off = p - (a + share[..., None] * d)
        far = np.hypot(off[..., 0], off[..., 1])
        k, rows = far.argmin(axis=1), np.arange(len(p))
        rel = p[:, 0] - a[k]
        return self.along[k] + share[rows, k] * np.sqrt(square[k]), far[rows, k], d[k, 0] * rel[:, 1] - d[k, 1] * rel[:, 0]

    def slice(self, a: float, b: float) -> np.ndarray:
        inner = (self.along > a) & (self.along < b)
        return np.concatenate([self.at([a]), self.points[inner], self.at([b])])

    def exact(self, step: float) -> np.ndarray:
        """Points each `step`, what is left over at the end dropped."""
        return self.at(np.arange(max(0, int(np.ceil((self.length + 1e-9) / step)))) * step)

    def even(self, step: float, least: int = 1) -> np.ndarray:
        """Points that cut the line into equal parts of at most `step`."""
        return self.at(np.linspace(0, self.length, max(int(np.ceil(self.length / step)), least) + 1))


def circumradius(a, b, c) -> np.ndarray:
    side = [np.hypot(*np.moveaxis(p - q, -1, 0)) for p, q in ((b, c), (a, c), (a, b))]
    double = np.abs((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (c[..., 0] - a[..., 0]) * (b[..., 1] - a[..., 1]))
    return np.where(double > 2e-9, side[0] * side[1] * side[2] / np.where(double > 2e-9, 2 * double, 1), np.inf)


def vertex_radii(points: np.ndarray, stride: int = 1) -> np.ndarray:
    out = np.full(len(points), np.inf)
    if len(points) > 2 * stride:
        out[stride:-stride] = circumradius(points[: -2 * stride], points[stride:-stride], points[2 * stride :])
    return out


def least_radius(points: np.ndarray) -> tuple[float, int]:
    """(radius, vertex) of the sharpest vertex, the first of equals."""
    r = vertex_radii(points)
    return float(r.min()), int(r.argmin())


def radius_on_chord(points: np.ndarray, chord: float) -> float:
    """The least three-point radius over `chord`, sampled from both ends."""
    if not chord > 0:
        raise ValueError("the chord must be positive")
    stride = max(1, int(np.ceil(chord / 2 / LONGEST_STRIDE)))
    return min(float(vertex_radii(Line(p).exact(chord / 2 / stride), stride).min(initial=np.inf)) for p in (points, points[::-1]))


def wide_enough(radius, least: float):
    return np.asarray(radius) >= (1 - RADIUS_SHORT) * least


def turns(points: np.ndarray) -> np.ndarray:
    """Turn at each vertex, within half a turn, 0 at the ends."""
    heading = np.arctan2(*np.diff(points, axis=0).T[::-1])
    out = np.zeros(len(points))
    out[1:-1] = np.mod(np.diff(heading) + np.pi, 2 * np.pi) - np.pi
    return out


# --- polygons


def edges(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rings = [np.asarray(r, float) for r in rings]
    return np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])


def inside(points, rings: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """Strictly inside by even-odd; the boundary is outside."""
    p = np.asarray(points, float).reshape(-1, 2)
    if not rings:
        return np.zeros(len(p), bool)
    a, b = edges(rings)
    out = np.zeros(len(p), bool)
    for at in range(0, len(p), block):
        x, y = p[at : at + block, 0, None], p[at : at + block, 1, None]
        spans = (a[:, 1] > y) != (b[:, 1] > y)
        cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (x - a[:, 0]) * (b[:, 1] - a[:, 1])
        on = (cross == 0) & (np.minimum(a[:, 0], b[:, 0]) <= x) & (x <= np.maximum(a[:, 0], b[:, 0])) & (np.minimum(a[:, 1], b[:, 1]) <= y) & (y <= np.maximum(a[:, 1], b[:, 1]))
        right = spans & ((cross < 0) == (b[:, 1] < a[:, 1])) & (cross != 0)
        out[at : at + block] = (right.sum(axis=1) % 2 == 1) & ~on.any(axis=1)
    return out


def hits(origin: np.ndarray, along: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signed distances from each origin along its unit vector to each segment; NaN where they don't meet."""
    o, n = origin[:, None, :], along[:, None, :]
    d = b - a
    det = n[..., 0] * d[:, 1] - n[..., 1] * d[:, 0]
    rel = a - o
    ok = det != 0
    det = np.where(ok, det, 1)
    t = (rel[..., 0] * d[:, 1] - rel[..., 1] * d[:, 0]) / det
    u = (rel[..., 0] * n[..., 1] - rel[..., 1] * n[..., 0]) / det
    return np.where(ok & (u >= 0) & (u <= 1), t, np.nan)


def normals(line: Line, s, reach: float) -> np.ndarray:
    d = line.direction(s, reach)
    return np.stack([-d[..., 1], d[..., 0]], axis=-1)


def water_width(line: Line, s, rings: list[np.ndarray], reach: float = 5.0) -> np.ndarray:
    """Width of water across the line at s: the stretch of the normal that holds the point; 0 on land."""
    s = np.atleast_1d(np.asarray(s, float))
    p = line.at(s)
    t = hits(p, normals(line, s, reach), *edges(rings))
    right = np.min(np.where(t > 0, t, np.inf), axis=1)
    left = np.min(np.where(t < 0, -t, np.inf), axis=1)
    return np.where(inside(p, rings), left + right, 0.0)


def probed_width(rings: list[np.ndarray], centre, normal, most: float = 200.0, probe: float = 1.0) -> float:
    """Width of water by probes on either side, each side up to its first dry one."""
    steps = np.arange(1, int(np.ceil(most / probe)) + 1) * probe
    total = 0.0
    for side in (1.0, -1.0):
        wet = inside(np.asarray(centre) + side * steps[:, None] * np.asarray(normal), rings)
        total += probe * (len(wet) if wet.all() else int(wet.argmin()))
    return total


def measured_widths(centre, left, right, spacing: float, span: float) -> tuple[list[tuple[int, float, float]], int]:
    """(sample, chainage, width) between the nearest meetings with both banks, and how many samples had none."""
    line, out, failed = Line(centre), [], 0
    s = np.minimum(np.arange(int(np.ceil(line.length / spacing)) + 1) * spacing, line.length)
    p = line.at(s)
    ahead, behind = line.at(np.minimum(s + spacing, line.length)), line.at(np.maximum(s - spacing, 0))
    d = ahead - behind
    size = np.hypot(d[:, 0], d[:, 1])
    n = np.stack([-d[:, 1], d[:, 0]], axis=1) / np.where(size > 0, size, 1)[:, None]
    found = []
    for bank in (left, right):
        t = hits(p, n, *edges([bank]))
        t = np.where(np.abs(t) <= span, t, np.nan)
        near = np.where(np.isnan(t), np.inf, np.abs(t))
        k = near.argmin(axis=1)
        found.append(np.where(np.isfinite(near.min(axis=1)), t[np.arange(len(s)), k], np.nan))
    width = np.abs(found[0] - found[1])
    for k, w in enumerate(width):
        if size[k] > 0 and w > 0:
            out.append((k, float(s[k]), float(w)))
        else:
            failed += 1
    return out, failed


def gap_length(points: np.ndarray) -> float:
    """Segments of this length or more are gaps, not banks: 20 times the upper median, 1.5 km at least."""
    size = np.sort(np.hypot(*np.diff(points, axis=0).T))
    return max(20 * float(size[len(size) // 2]), 1500.0)


def bank_offsets(centre, left, right) -> np.ndarray:
    """(n, 2) offsets along the normals (left positive) to either bank, NaN where there is none; gaps are no bank."""
    line = Line(centre)
    n = normals(line, line.along, max(line.length / max(1, len(line.points) - 1), 1e-9))
    out = np.full((len(line.points), 2), np.nan)
    for k, bank in enumerate((left, right)):
        a, b = edges([bank])
        real = np.hypot(*(b - a).T) < gap_length(np.asarray(bank, float))
        t = hits(line.points, n, a[real], b[real])
        far = np.where(np.isnan(t), np.inf, np.abs(t))
        best = far.argmin(axis=1)
        out[:, k] = np.where(np.isfinite(far.min(axis=1)), t[np.arange(len(t)), best], np.nan)
    return out


# --- failing stretches


def failing_runs(length: float, status: Callable[[np.ndarray], np.ndarray]) -> list[tuple[float, float, int]]:
    """(from, to, kind) of runs of one kind > 0, sampled each RUN_STEP; the edges are bisected to RUN_ACCURACY, all at once."""
    s = np.minimum(np.arange(int(np.ceil(length / RUN_STEP)) + 1) * RUN_STEP, length)
    kind = status(s)
    change = np.flatnonzero(kind[1:] != kind[:-1])
    low, high, before = s[change], s[change + 1], kind[change]
    while len(low) and (high - low).max() > RUN_ACCURACY:
        mid = (low + high) / 2
        same = status(mid) == before
        low, high = np.where(same, mid, low), np.where(same, high, mid)
    cuts = np.concatenate([[0.0], (low + high) / 2, [length]])
    kinds = np.append(kind[change], kind[-1]) if len(s) else []
    return [(float(a), float(b), int(k)) for a, b, k in zip(cuts, cuts[1:], kinds) if k]


TOO_NARROW, TOO_TIGHT = 1, 2


def width_check(points, rings, width_at: Callable, least: float, chord: float) -> list[tuple[float, float, int]]:
    """Stretches too narrow (first) or too tight for a channel: width_at(radius) is the bottom width that a radius asks for."""
    line = Line(points)

    def status(s):
        r = line.radius(s, chord)
        return np.where(water_width(line, s, rings) < width_at(r), TOO_NARROW, np.where(wide_enough(r, least), 0, TOO_TIGHT))

    return failing_runs(line.length, status)


def kind_checks(points, rings, width_at: Callable, least: float, chord: float) -> list[tuple[float, float, int]]:
    """Either kind by itself, in the order of their starts."""
    line = Line(points)
    narrow = failing_runs(line.length, lambda s: np.where(water_width(line, s, rings) < width_at(line.radius(s, chord)), TOO_NARROW, 0))
    tight = failing_runs(line.length, lambda s: np.where(wide_enough(line.radius(s, chord), least), 0, TOO_TIGHT))
    return sorted(narrow + tight, key=lambda r: r[0])


# --- simple lines, loops


def self_meetings(points: np.ndarray, window: int | None = None) -> list[tuple[int, int, float, float]]:
    """(i, j, t, u) of segments i < j, not neighbours and at most `window` apart, that meet; sorted."""
    a, d = points[:-1], np.diff(points, axis=0)
    n, out = len(a), []
    closed = n > 2 and np.array_equal(points[0], points[-1])
    for lag in range(2, min(n, (window or n) + 1)):  # all pairs of one lag at once
        rel = a[lag:] - a[:-lag]
        d0, d1 = d[:-lag], d[lag:]
        det = d0[:, 0] * d1[:, 1] - d0[:, 1] * d1[:, 0]
        ok = det != 0
        det = np.where(ok, det, 1)
        t, u = (rel[:, 0] * d1[:, 1] - rel[:, 1] * d1[:, 0]) / det, (rel[:, 0] * d0[:, 1] - rel[:, 1] * d0[:, 0]) / det
        met = np.flatnonzero(ok & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
        out += [(i, i + lag, float(t[i]), float(u[i])) for i in met.tolist() if not (closed and i == 0 and i + lag == n - 1)]
    return sorted(out)


def is_simple(points: np.ndarray) -> bool:
    return len(points) < 3 or not self_meetings(points)


def cumulative_turn(points: np.ndarray) -> float:
    d = np.diff(points, axis=0)
    d = d[np.hypot(d[:, 0], d[:, 1]) > 1e-9]
    step = np.diff(np.arctan2(d[:, 1], d[:, 0]))
    return float(np.degrees(np.abs(np.mod(step + np.pi, 2 * np.pi) - np.pi).sum()))


def loop_verdict(points: np.ndarray, window: float) -> tuple[bool, str | None]:
    """Whether a piece is a loop and why: it crosses itself, turns too much, or is too long for its window."""
    ratio = Line(points).length / window if window else np.inf
    turn = cumulative_turn(points)
    if not is_simple(points):
        return True, "self-intersecting"
    if turn > LOOP_TURN:
        return True, f"cumulative turn {turn:.0f} deg > {LOOP_TURN:.0f}"
    if ratio > LOOP_RATIO:
        return True, f"length ratio {ratio:.2f} > {LOOP_RATIO:.1f} backstop"
    return False, None


def cut_loops(points: np.ndarray, window: int) -> np.ndarray:
    """The line without its loops of at most `window` segments: the first crossing is cut until none is left."""
    points = np.asarray(points, float)
    while True:
        near = self_meetings(points, window)
        if not near:
            return points
        i, j, t, _ = min(near)
        at = points[i] + t * (points[i + 1] - points[i])
        points = np.concatenate([points[: i + 1], [at], points[j + 1 :]])
        points = points[np.append(True, np.any(np.diff(points, axis=0) != 0, axis=1))]


def merged_lines(lines: list[np.ndarray]) -> list[np.ndarray]:
    """Lines joined at ends that exactly two of them share; rings stay closed."""
    key = lambda p: (float(p[0]), float(p[1]))
    ends: dict[tuple, list[int]] = {}
    for k, line in enumerate(lines):
        for p in (line[0], line[-1]):
            ends.setdefault(key(p), []).append(k)
    left, out = set(range(len(lines))), []

    def extend(chain: list) -> list:
        while True:
            k = next((k for k in ends[key(chain[-1])] if k in left), None)
            if k is None or len(ends[key(chain[-1])]) != 2:
                return chain
            left.discard(k)
            more = [tuple(p) for p in lines[k]]
            chain = chain + (more if more[0] == tuple(chain[-1]) else more[::-1])[1:]

    for k in range(len(lines)):
        if k in left:
            left.discard(k)
            chain = extend([tuple(p) for p in lines[k]])
            out.append(np.array(extend(chain[::-1])[::-1]))
    return out


# --- offsets of a route


def smooth_offsets(offsets: np.ndarray, budget: float, turn: np.ndarray, step: float, passes: int = 3) -> np.ndarray:
    """Binomial passes; a vertex that would turn more than its budget keeps its offset."""
    o, limit = np.asarray(offsets, float).copy(), np.maximum(budget, np.abs(turn)) + 1e-4
    for _ in range(passes):
        new = o.copy()
        new[1:-1] = (o[:-2] + 2 * o[1:-1] + o[2:]) / 4
        lean = np.zeros(len(o))
        lean[1:-1] = turn[1:-1] + np.diff(np.arctan2(np.diff(new), step))
        o = np.where(np.abs(lean) > limit, o, new)
    return o


def tapered(offsets: np.ndarray, stations: int) -> np.ndarray:
    """Offsets faded in and out over `stations` at either end."""
    n = len(offsets)
    count = min(max(stations, 0), n // 2)
    fade = np.ones(n)
    fade[:count] *= np.arange(count) / max(stations, 1)
    fade[n - count :] *= fade[:count][::-1]
    return offsets * fade


def relaxed(offsets, centres, normal, least: float, most_passes: int = 600, taper: int = 8) -> tuple[np.ndarray, int, float]:
    """Smooth offsets until every vertex radius is `least` or more: (offsets, passes, least radius)."""
    corridor = max(1.0, float(np.abs(offsets).max()))
    o = tapered(np.asarray(offsets, float), taper)
    radius = lambda o: float(vertex_radii(centres + o[:, None] * normal).min())
    passes, found = 0, radius(o)
    while found < least - 1e-6 and passes < most_passes:
        new = o.copy()
        new[1:-1] = (o[:-2] + 2 * o[1:-1] + o[2:]) / 4
        o = tapered(np.clip(new, -corridor, corridor), taper)
        passes, found = passes + 1, radius(o)
    return o, passes, found


def opened(offsets, centres, normal, least: float, corridor: float, most_passes: int = 5000, taper: int = 8) -> tuple[np.ndarray, int, float]:
    """Pull vertices towards their neighbours' middle, along the normals and within the corridor, until the radius is `least`."""
    n = len(offsets)
    place = np.minimum(np.arange(n), np.arange(n)[::-1])
    room = corridor * (np.minimum(1.0, place / taper) if taper > 0 else np.ones(n))
    fold, turn = FOLD * vertex_radii(centres), turns(centres)
    low, high = np.where(turn < -1e-6, np.maximum(-room, -fold), -room), np.where(turn > 1e-6, np.minimum(room, fold), room)
    o = np.asarray(offsets, float).copy()
    radius = lambda o: float(vertex_radii(centres + o[:, None] * normal).min())
    passes, found = 0, radius(o)
    while found < least - 1e-6 and passes < most_passes:
        p = centres + o[:, None] * normal
        pull = np.zeros((n, 2))
        pull[1:-1] = (p[:-2] + p[2:]) / 4 - p[1:-1] / 2
        o = np.clip(o + (pull * normal).sum(axis=1), low, high)
        passes, found = passes + 1, radius(o)
    return o, passes, found


# --- bends


def turn_segments(heading: np.ndarray, radius: np.ndarray, straight: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(deflection in degrees, least radius) of the bend that a point belongs to; 0 and infinite on straights."""
    phi, least = np.zeros(len(heading)), np.full(len(heading), np.inf)
    step = np.diff(heading)
    sign = np.where(step > straight, 1, np.where(step < -straight, -1, 0))
    edge = np.flatnonzero(np.diff(sign)) + 1
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(sign)]):
        if b > a and sign[a]:
            known = radius[a : b + 1][np.isfinite(radius[a : b + 1])]
            phi[a : b + 1] = np.degrees(abs(heading[b] - heading[a]))
            least[a : b + 1] = known.min() if len(known) else np.inf
    return phi, least


def corridor_holds(kappa: np.ndarray, step: float, half: float, least: float, offsets: int = OFFSETS, headings: int = HEADINGS) -> bool:
    """Whether some path of curvature up to 1 / least stays within `half` of a line of curvature kappa: reachable (offset, heading) cells."""
    if half <= 0:
        return bool((np.abs(kappa) <= 1 / least + 1e-12).all())
    y, psi = np.linspace(-half, half, offsets), np.radians(np.linspace(-STEEPEST, STEEPEST, headings))
    dy, dpsi = y[1] - y[0], psi[1] - psi[0]
    reach = np.zeros((offsets, headings), bool)
    reach[np.abs(y).argmin(), np.abs(psi).argmin()] = True
    controls = np.linspace(-1 / least, 1 / least, CONTROLS)
    for k in kappa[:-1]:
        i, j = np.nonzero(reach)
        if not len(i):
            return False
        row = np.rint((y[i] + psi[j] * step + half) / dy).astype(int)
        column = np.rint((psi[j] + (controls[:, None] - k) * step - psi[0]) / dpsi).astype(int)
        row = np.broadcast_to(row, column.shape)
        ok = (row >= 0) & (row < offsets) & (column >= 0) & (column < headings)
        reach = np.zeros_like(reach)
        reach[row[ok], column[ok]] = True
    return bool(reach.any())


def least_corridor(kappa: np.ndarray, step: float, least: float) -> float:
    """The smallest half width that holds a path of radius `least`, to OFFSET_ACCURACY; infinite beyond WIDEST_OFFSET."""
    if corridor_holds(kappa, step, 0.0, least):
        return 0.0
    low, high = 0.0, WIDEST_OFFSET
    if not corridor_holds(kappa, step, high, least):
        return np.inf
    while high - low > OFFSET_ACCURACY:
        mid = (low + high) / 2
        low, high = (low, mid) if corridor_holds(kappa, step, mid, least) else (mid, high)
    return high


def curvature(points: np.ndarray) -> np.ndarray:
    """Signed curvature by three points; the ends copy their neighbours."""
    out = np.zeros(len(points))
    if len(points) > 2:
        out[1:-1] = np.sign(turns(points)[1:-1]) / vertex_radii(points)[1:-1]
        out[0], out[-1] = out[1], out[-2]
    return out


def bends(points, rings, least: float, top: float, bottom: float, bank_share: float, step: float = 20.0) -> list[dict]:
    """Catalogue of bends: where they are, the offset they need, the room there is, and their class."""
    line = Line(points)
    xy = line.at(np.arange(int(line.length // step) + 1) * step)
    kappa = curvature(xy)
    smooth = np.convolve(np.pad(kappa, 2, mode="edge"), np.ones(5) / 5, "valid")
    sign = np.where(smooth < 0, -1, 1)
    edge = np.flatnonzero(np.diff(sign)) + 1
    out = []
    for a, b in zip([0, *edge.tolist()], [*(edge - 1).tolist(), len(xy) - 1]):
        if b - a < 2:
            continue
        need = least_corridor(kappa[a : b + 1], step, least)
        heading = np.arctan2(*(xy[b] - xy[a])[::-1])
        width = probed_width(rings, line.at(step * (a + b) / 2), (-np.sin(heading), np.cos(heading)))
        room = max(0.0, ((width or top) - bottom) / 2) + bank_share * max(0.0, top - bottom) / 2
        out.append({"i0": a, "i1": b, "need": need, "width": width, "room": room, "class": "S" if need <= 1e-9 else "G" if need <= room else "T"})
    return out


def fillet(a, d_in, b, d_out, radius: float, step: float) -> np.ndarray | None:
    """From a along d_in to b along d_out by an arc of `radius` that touches both; None if the legs are parallel or too short."""
    a, d_in, b, d_out = (np.asarray(v, float) for v in (a, d_in, b, d_out))
    turn = float(np.arctan2(d_in[0] * d_out[1] - d_in[1] * d_out[0], d_in @ d_out))
    if abs(turn) < 1e-6 or abs(abs(turn) - np.pi) < 1e-9:
        return None
    t, back = np.linalg.solve(np.stack([d_in, d_out], axis=1), b - a)
    cut = radius * np.tan(abs(turn) / 2)
    if min(t, back) <= 0 or cut > min(t, back):
        return None
    first = a + (t - cut) * d_in
    side = np.sign(turn) * np.array([-d_in[1], d_in[0]])
    centre = first + radius * side
    n = max(2, int(np.ceil(radius * abs(turn) / step)))
    angle = np.arctan2(*(first - centre)[::-1]) + turn * np.arange(n + 1) / n
    arc = centre + radius * np.stack([np.cos(angle), np.sin(angle)], axis=1)
    out = np.concatenate([[a], arc, [b]])
    return out[np.append(True, np.hypot(*np.diff(out, axis=0).T) > 1e-9)]


def tangent_joins(points, at, radius: float, arm: float, step: float = 5.0) -> tuple[np.ndarray, list[float]]:
    """The line with a fillet at each of the places `at`; where arms of `arm` are too short for the radius, the largest that fits."""
    used, points = [], np.asarray(points, float)
    for p in at:
        line = Line(points)
        s = float(line.project([p])[0][0])
        a, b = max(0.0, s - arm), min(line.length, s + arm)
        near = min(1.0, (b - a) / 4)
        d_in, d_out = (line.at(v + near) - line.at(v) for v in (a, b - near))
        d_in, d_out = d_in / np.hypot(*d_in), d_out / np.hypot(*d_out)
        turn = abs(float(np.arctan2(d_in[0] * d_out[1] - d_in[1] * d_out[0], d_in @ d_out)))
        fits = min(radius, min(s - a, b - s) / np.tan(turn / 2) * (1 - 1e-9)) if turn > 1e-6 else radius
        arc = fillet(line.at(a), d_in, line.at(b), d_out, fits, step)
        used.append(float(fits) if arc is not None else np.inf)
        if arc is not None:
            points = np.concatenate([line.slice(0, a)[:-1], arc, line.slice(b, line.length)[1:]])
    return points, used


# --- mid-lines


def monotone_points(source, target, most_step: float) -> np.ndarray:
    """The nearest point of `target` for each point of `source`, never back and at most `most_step` on; the last is its end."""
    line, at, out = Line(target), 0.0, []
    for k, s in enumerate(line.project(source)[0]):
        at = min(max(float(s), at), at + most_step, line.length)
        if k == len(source) - 1:
            at = line.length
        out.append(at)
    return line.at(out)


def paired_centreline(left, right, step: float, window: int = 5, passes: int = 1) -> np.ndarray:
    """Blend of the mid-lines seen from either bank, smoothed and cut evenly."""
    left, right = np.asarray(left, float), np.asarray(right, float)
    middles = [(left + monotone_points(left, right, 5 * step)) / 2, (monotone_points(right, left, 5 * step) + right) / 2]
    share = np.linspace(0, 1, max(map(len, middles)))
    both = sum(Line(m).at(share * Line(m).length) for m in middles) / 2
    for _ in range(passes):  # corner cutting
        pairs = np.stack([0.75 * both[:-1] + 0.25 * both[1:], 0.25 * both[:-1] + 0.75 * both[1:]], axis=1).reshape(-1, 2)
        both = np.concatenate([both[:1], pairs, both[-1:]])
    if window > 1:
        half = window // 2
        both = np.stack([np.convolve(np.pad(both[:, k], half, mode="edge"), np.ones(2 * half + 1) / (2 * half + 1), "valid") for k in (0, 1)], axis=1)
    return Line(both).even(step, 2)


def midline(left, right, seed, step: float, passes: int = 3) -> np.ndarray:
    """Stations move along their normals to the middle of both banks, by one river width at most; smoothed and cut evenly between passes."""
    points = Line(seed).even(step)
    for _ in range(passes):
        off = bank_offsets(points, left, right)
        move, width = off.mean(axis=1), np.nanmedian(np.abs(off[:, 0] - off[:, 1])) if np.isfinite(off).all(axis=1).any() else 0.0
        move = np.where(np.isfinite(move), np.clip(move, -width, width), 0.0)
        line = Line(points)
        points = points + move[:, None] * normals(line, line.along, max(step, 1e-9))
        smooth = points.copy()
        smooth[1:-1] = (points[:-2] + 2 * points[1:-1] + points[2:]) / 4
        points = Line(smooth).even(step)
    return points


# --- least squares in a box, fairway


def box_least_squares(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = 500) -> np.ndarray:
    """x in [low, high] with least |a x - b|^2 by projected Newton steps: bounds that the gradient presses on are held, the rest is solved."""
    if (low > high).any():
        raise ValueError("the box is empty")
    gram, goal = a.T @ a, a.T @ b
    gram = gram + 1e-12 * max(1.0, float(np.trace(gram))) * np.eye(len(goal))
    worth = lambda x: x @ gram @ x / 2 - goal @ x
    x = np.clip(np.zeros(len(goal)), low, high)
    for _ in range(most):
        grad = gram @ x - goal
        free = ~(((x <= low) & (grad >= 0)) | ((x >= high) & (grad <= 0)))
        if not free.any():
            break
        step = np.zeros(len(x))
        step[free] = np.linalg.solve(gram[np.ix_(free, free)], -grad[free])
        share, now = 1.0, worth(x)
        new = np.clip(x + step, low, high)
        while share > 1e-9 and worth(new) > now - 1e-4 * share * abs(grad @ step):
            share /= 2
            new = np.clip(x + share * step, low, high)
        done = np.abs(new - x).max() <= 1e-10 * max(1.0, np.abs(x).max())
        x = new if worth(new) <= now else x
        if done:
            break
    return x


def fairway(points, rings, clearance: float, fixed: list[int] = (), step: float = 25.0, passes: int = 16) -> np.ndarray:
    """The line of least squared curvature whose stations stay `clearance` off the banks: offsets in a box, anew along the new normals."""
    xy = Line(points).even(step)
    for _ in range(passes):
        line = Line(xy)
        n = normals(line, line.along, step)
        t = hits(xy, n, *edges(rings))
        high = np.min(np.where(t > 0, t, np.inf), axis=1) - clearance
        low = -(np.min(np.where(t < 0, -t, np.inf), axis=1) - clearance)
        shut = ~(inside(xy, rings) & (low <= high)) | ~np.isfinite(low + high)
        shut[[0, -1, *fixed]] = True
        low, high = np.where(shut, 0, np.clip(low, -4 * step, 4 * step)), np.where(shut, 0, np.clip(high, -4 * step, 4 * step))
        bend = np.zeros((len(xy) - 2, len(xy)))
        rows = np.arange(len(bend))
        bend[rows, rows], bend[rows, rows + 1], bend[rows, rows + 2] = 1, -2, 1
        second = bend @ xy
        a = np.concatenate([bend * n[:, k] for k in (0, 1)])
        move = box_least_squares(a, -np.concatenate([second[:, 0], second[:, 1]]), low, high)
        xy = xy + move[:, None] * n
        if np.abs(move).max() < 0.01:
            break
    return xy


def joined_legs(legs: list, rings, clearance: float, step: float = 25.0) -> np.ndarray:
    """One fairway over legs that meet end to end; where they meet the line is free."""
    whole = np.concatenate([np.asarray(legs[0], float), *(np.asarray(leg, float)[1:] for leg in legs[1:])])
    return fairway(whole, rings, clearance, step=step)


def rolling_circle(points, least: float, step: float, passes: int = 2, water: list | None = None) -> tuple[np.ndarray, list[tuple[int, int, float, float]]]:
    """Arcs of radius `least` in place of what is sharper: (line, (pass, side, from, to) of each arc).

    The centres of a circle that rolls along one side are the line's parallel at distance `least`. Where that crosses itself the circle
    touches the line twice; its arc between the two places is tangent to the line at both and takes the place of what lies between.
    With `water`, an arc that leaves it is not taken.
    """
    xy, arcs = Line(points).even(step), []
    for k in range(passes):
        for side in (1, -1):
            line = Line(xy)
            n = side * normals(line, line.along, step)
            centres = xy + least * n
            meetings: dict[int, tuple[int, float, float]] = {}
            for i, j, t, u in self_meetings(centres, int(np.ceil(2 * np.pi * least / step))):
                meetings[i] = (j, t, u)  # the farthest of a start, as meetings are sorted
            pieces, done = [], 0.0
            for i in sorted(meetings):
                j, t, u = meetings[i]
                s, e = (float(line.along[q] + share * (line.along[q + 1] - line.along[q])) for q, share in ((i, t), (j, u)))
                if s < done:
                    continue
                centre = centres[i] + t * (centres[i + 1] - centres[i])
                first, last = (np.arctan2(*(line.at(v) - centre)[::-1]) for v in (s, e))
                sweep = float(np.mod(side * (last - first), 2 * np.pi))
                angle = first + side * sweep * np.linspace(0, 1, max(2, int(np.ceil(least * sweep / step))) + 1)
                arc = centre + least * np.stack([np.cos(angle), np.sin(angle)], axis=1)
                if water is None or inside(arc, water).all():
                    pieces += [line.slice(done, s)[:-1], arc]
                    arcs.append((k + 1, side, s, e))
                    done = e
            if pieces:
                xy = Line(np.concatenate([*pieces, line.slice(done, line.length)[1:]])).even(step)
    return xy, arcs
