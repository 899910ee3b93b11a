"""Polygon sets: union, intersection, difference, buffers, footprints. Rings are closed (n, 2) arrays, holes among them; inside is even-odd.

All operations go one way: every edge is cut where it meets another, a piece stays if exactly one of its sides belongs to the result, and
the pieces that stay are chained into rings, interior on the left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from riverline.operators.planar import Line, edges, inside, normals

SNAP = 1e-6
#: Pieces too short to tell their sides may be missing from a border; a ring goes on over gaps up to this.
GAP = 0.01
#: Pairs of edges or points looked at together.
PAIRS = 1 << 19
ROUND = 8  # segments of a quarter circle


def closed(points) -> np.ndarray:
    p = np.asarray(points, float)
    return p if np.array_equal(p[0], p[-1]) else np.concatenate([p, p[:1]])


def signed_area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def area(rings: list[np.ndarray]) -> float:
    """Of rings whose holes run against their outer rings."""
    return abs(sum(signed_area(r) for r in rings))


def spans(low: np.ndarray, high: np.ndarray, at: np.ndarray, side: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (k, i) with low[k] <= at[i] < high[k] (side "left") or <= high[k] (side "right"), by k, in blocks of about PAIRS."""
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], low, "left")
    counts = np.maximum(np.searchsorted(at[order], high, side) - first, 0)
    ends = np.cumsum(counts)
    done = 0
    while done < len(low):
        base = ends[done] - counts[done]
        stop = max(int(np.searchsorted(ends, base + PAIRS, "right")), done + 1)
        k = np.repeat(np.arange(done, stop), counts[done:stop])
        yield k, order[np.arange(len(k)) - np.repeat(ends[done:stop] - counts[done:stop] - base, counts[done:stop]) + first[k]]
        done = stop


def long_axis(a: np.ndarray, b: np.ndarray) -> int:
    """The axis along which edges reach farthest: few of them lie over one place on it."""
    return int(np.argmax(np.maximum(a, b).max(axis=0) - np.minimum(a, b).min(axis=0))) if len(a) else 0


def winding(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Turns of the edges about each point, counted along a ray across the longer side of their box."""
    out, axis = np.zeros(len(points), int), long_axis(a, b)
    for k, i in spans(np.minimum(a, b)[:, axis], np.maximum(a, b)[:, axis], points[:, axis], "left"):
        left = (b[k, 0] - a[k, 0]) * (points[i, 1] - a[k, 1]) - (points[i, 0] - a[k, 0]) * (b[k, 1] - a[k, 1])
        on = (a[k, axis] < b[k, axis]) == (axis == 1)  # runs left about a point that it passes on its left
        out += np.bincount(i[on & (left > 0)], minlength=len(points)) - np.bincount(i[~on & (left < 0)], minlength=len(points))
    return out


def even_odd(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """As `inside`, for many points: strictly inside, the boundary is outside."""
    if not rings or not len(points):
        return np.zeros(len(points), bool)
    a, b = edges(rings)
    low, high, axis = np.minimum(a, b), np.maximum(a, b), long_axis(a, b)
    count, border = np.zeros(len(points), int), np.zeros(len(points), bool)
    for k, i in spans(low[:, axis], high[:, axis], points[:, axis], "right"):
        p = points[i]
        cross = (b[k, 0] - a[k, 0]) * (p[:, 1] - a[k, 1]) - (p[:, 0] - a[k, 0]) * (b[k, 1] - a[k, 1])
        over = (a[k, axis] > p[:, axis]) != (b[k, axis] > p[:, axis])
        ahead = (cross < 0) == ((b[k, axis] < a[k, axis]) == (axis == 1))
        count += np.bincount(i[over & ahead & (cross != 0)], minlength=len(points))
        border[i[(cross == 0) & (low[k] <= p).all(axis=1) & (p <= high[k]).all(axis=1)]] = True
    return (count % 2 == 1) & ~border


def pieces(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges a-b cut where they meet, each piece once, on a grid of SNAP."""
    d = b - a
    low, high = np.minimum(a, b), np.maximum(a, b)
    square = (d**2).sum(axis=1)
    slack = SNAP / np.sqrt(np.maximum(square, SNAP**2))
    every = np.arange(len(a))
    edge, cut = [every, every], [np.zeros(len(a)), np.ones(len(a))]
    axis = long_axis(a, b)
    for k, j in spans(low[:, axis], high[:, axis] + SNAP, low[:, axis], "right"):  # j begins on k
        near = (k != j) & (low[j, 1 - axis] <= high[k, 1 - axis] + SNAP) & (high[j, 1 - axis] >= low[k, 1 - axis] - SNAP)
        near &= (low[j, axis] > low[k, axis]) | (k < j)  # of edges that begin together each pair once
        k, j = k[near], j[near]
        i, j = np.concatenate([k, j]), np.concatenate([j, k])
        i, j = i[square[i] > 0], j[square[i] > 0]
        det = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        rel = a[j] - a[i]
        ok = np.abs(det) > 1e-14 * square[i]
        t = np.where(ok, (rel[:, 0] * d[j, 1] - rel[:, 1] * d[j, 0]) / np.where(ok, det, 1), -1)
        u = np.where(ok, (rel[:, 0] * d[i, 1] - rel[:, 1] * d[i, 0]) / np.where(ok, det, 1), -1)
        met = (t > 0) & (t < 1) & (u >= -slack[j]) & (u <= 1 + slack[j])
        edge.append(i[met])
        cut.append(t[met])
        for end in (a[j], b[j]):  # ends on this edge, collinear ones too
            rel = end - a[i]
            along = (rel * d[i]).sum(axis=1) / square[i]
            off = np.abs(rel[:, 0] * d[i, 1] - rel[:, 1] * d[i, 0]) / np.sqrt(square[i])
            met = (off < SNAP) & (along > 0) & (along < 1)
            edge.append(i[met])
            cut.append(along[met])
    edge, cut = np.concatenate(edge), np.concatenate(cut)
    order = np.lexsort((cut, edge))
    edge, cut = edge[order], cut[order]
    p = np.round((a[edge] + cut[:, None] * d[edge]) / SNAP).astype(np.int64)
    one = (edge[1:] == edge[:-1]) & (p[1:] != p[:-1]).any(axis=1)
    q, r = p[:-1][one], p[1:][one]
    turned = (q[:, 0] > r[:, 0]) | ((q[:, 0] == r[:, 0]) & (q[:, 1] > r[:, 1]))
    same = np.where(turned[:, None], np.concatenate([r, q], axis=1), np.concatenate([q, r], axis=1))
    order = np.lexsort(same.T)  # stable: the first of equal pieces stays, in its place
    new = np.ones(len(same), bool)
    new[1:] = (same[order][1:] != same[order][:-1]).any(axis=1)
    found = same[np.sort(order[new])] * SNAP
    return found[:, :2], found[:, 2:]


def numbered(p: np.ndarray) -> np.ndarray:
    """A number for each point, the same for equal points on the grid of SNAP."""
    grid = np.round(p / SNAP).astype(np.int64)
    order = np.lexsort(grid.T)
    out = np.empty(len(p), int)
    out[order] = np.cumsum(np.append(0, (grid[order][1:] != grid[order][:-1]).any(axis=1)))[: len(p)]
    return out


def chained(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Rings of directed pieces: at a vertex the sharpest left turn goes on, over a gap the nearest piece."""
    if not len(a):
        return []
    vertex = numbered(np.concatenate([a, b]))
    begin, end = vertex[: len(a)], vertex[len(a) :]
    alone = (np.bincount(begin, minlength=len(vertex)) == 1) & (np.bincount(end, minlength=len(vertex)) == 1)
    runs = np.flatnonzero(np.append(True, (end[:-1] != begin[1:]) | ~alone[begin[1:]]))  # pieces in a row with no other way
    stops = np.append(runs[1:], len(a))
    start: dict[int, list[int]] = {}
    for n, p in enumerate(begin[runs].tolist()):
        start.setdefault(p, []).append(n)
    into, out_of = (np.arctan2(*(b - a)[k].T[::-1]) for k in (stops - 1, runs))
    whence, whither = a[runs], b[stops - 1]
    free, out = np.ones(len(runs), bool), []
    for first in range(len(runs)):
        if not free[first]:
            continue
        way, n, whole = [], first, False
        while n is not None:
            free[n] = False
            way.append(n)
            home = np.abs(whither[n] - whence[first]).max()
            if home <= SNAP:
                whole = True
                break
            ways = [m for m in start.get(int(end[stops[n] - 1]), ()) if free[m]]
            if ways:
                n = max(ways, key=lambda m: np.mod(out_of[m] - into[n] + np.pi, 2 * np.pi))
                continue
            far = np.where(free, np.abs(whence - whither[n]).max(axis=1), np.inf)
            m = int(far.argmin())
            whole = bool(home <= GAP and home <= far[m])
            n = m if far[m] <= GAP and not whole else None
        ring = np.concatenate([whence[first : first + 1], *(b[runs[n] : stops[n]] for n in way)])
        if whole and len(ring) > 3:
            ring[-1] = ring[0]
            d = np.diff(ring, axis=0)
            bent = np.abs(d[:-1, 0] * d[1:, 1] - d[:-1, 1] * d[1:, 0]) > 1e-9 * np.maximum(SNAP, np.hypot(*d[:-1].T) * np.hypot(*d[1:].T))
            ring = ring[np.concatenate([[True], bent, [True]])]
            if len(ring) > 3 and abs(signed_area(ring)) > GAP * GAP:
                out.append(ring)
    return out


def arranged(rings: list[np.ndarray], belongs: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Rings of the points that belong, whose border lies on the given rings."""
    if not rings:
        return []
    a, b = pieces(*edges(rings))
    if not len(a):
        return []
    d = b - a
    size = np.hypot(*d.T)
    side = np.stack([-d[:, 1], d[:, 0]], axis=1) / size[:, None] * np.clip(size / 4, 2 * SNAP, 20 * SNAP)[:, None]
    mid = (a + b) / 2
    left, right = np.split(belongs(np.concatenate([mid + side, mid - side])), 2)
    one, back = left != right, right[:, None]
    return chained(np.where(back, b, a)[one], np.where(back, a, b)[one])


def overlay(one: list, other: list, how: str) -> list[np.ndarray]:
    """how: "union", "intersection", "difference"."""
    one, other = [closed(r) for r in one], [closed(r) for r in other]
    test = {"union": np.logical_or, "intersection": np.logical_and, "difference": lambda p, q: p & ~q}[how]
    return arranged(one + other, lambda p: test(even_odd(p, one), even_odd(p, other)))


def parallel(ring: np.ndarray, distance: float) -> np.ndarray:
    """The closed curve beside a ring, to its right or, if negative, to its left.

    About each vertex on whose outer side the curve runs it follows an arc. On the inner side the two edges' parallels meet, or, where they may end
    before they do, the curve goes through the vertex. So its winding number is the ring's, and to the right one more for each edge's strip and each
    vertex's sector that holds the point, to the left one less; of strips that meet their common part counts once.
    """
    v, off = ring[:-1], abs(distance)
    d = np.diff(ring, axis=0)
    size = np.hypot(*d.T)
    d /= size[:, None]
    n = np.sign(distance) * np.stack([d[:, 1], -d[:, 0]], axis=1)
    d0, n0 = np.roll(d, 1, axis=0), np.roll(n, 1, axis=0)
    turn = np.arctan2(d0[:, 0] * d[:, 1] - d0[:, 1] * d[:, 0], (d0 * d).sum(axis=1))
    out = turn * np.sign(distance)  # positive: an arc
    meet = off * np.tan(np.clip(-out, 0, np.pi - 1e-9) / 2) <= np.minimum(size, np.roll(size, 1)) / 2
    steps = np.where(out > 0, np.ceil(out * (2 * ROUND / np.pi) - 1e-9), np.where(meet, 0, 2)).clip(0).astype(int)
    k = np.repeat(np.arange(len(v)), steps + 1)
    j = np.arange(len(k)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)
    angle = turn[k] * j / np.maximum(steps[k], 1)
    cos, sin = np.cos(angle), np.sin(angle)
    to = np.stack([n0[k, 0] * cos - n0[k, 1] * sin, n0[k, 0] * sin + n0[k, 1] * cos], axis=1)
    last = (j == steps[k]) & (steps[k] > 0)
    to[last] = n[k[last]]
    one = (steps[k] == 0) & (out[k] <= 0)
    to[one] = ((n0 + n) / np.maximum(1 + (n0 * n).sum(axis=1), SNAP)[:, None])[k[one]]
    to[(out[k] <= 0) & (j == 1)] = 0
    return closed(np.round((v[k] + off * to) / SNAP) * SNAP)


def simplified(ring: np.ndarray, off: float) -> np.ndarray:
    """The ring without vertices nearer than `off` to what stays (Douglas and Peucker), from its two vertices farthest apart."""
    keep = np.zeros(len(ring), bool)
    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    keep[[0, far, -1]] = True
    stack = [(0, far), (far, len(ring) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i > 1:
            d = ring[j] - ring[i]
            rel = ring[i + 1 : j] - ring[i]
            size = np.hypot(*d)
            away = np.abs(rel[:, 0] * d[1] - rel[:, 1] * d[0]) / size if size else np.hypot(*rel.T)
            k = int(away.argmax())
            if away[k] > off:
                keep[i + 1 + k] = True
                stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return ring[keep]


def plain(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Rings with the same points inside that don't cross, interior on the left."""
    if len(rings) == 1 and len(rings[0]) > 3 and np.bincount(numbered(rings[0][:-1])).max() == 1 and len(pieces(*edges(rings))[0]) == len(rings[0]) - 1:
        return [rings[0] if signed_area(rings[0]) > 0 else rings[0][::-1]]
    return arranged(rings, lambda p: even_odd(p, rings))


def buffer(rings: list, distance: float) -> list[np.ndarray]:
    """Rings of the points within `distance` (or, if negative, deeper inside than that); quarter circles have ROUND segments."""
    rings = plain([closed(r) for r in rings])
    if not distance or not rings:
        return rings
    beside = [parallel(r, distance) for r in rings]
    a, b = edges(beside)
    return arranged(beside, lambda p: winding(p, a, b) > 0)


def navigable_water(rings: list, half_width: float, clearance: float, smooth: float = 0.0) -> list[np.ndarray]:
    """Water shrunk by half a width and the clearance, then opened and closed by `smooth`: what each of these steps starts from goes without vertices that tell less than an arc's."""
    if not all(np.isfinite(v) and v >= 0 for v in (half_width, clearance, smooth)):
        raise ValueError("distances must be finite and not negative")
    done = half_width + clearance
    out = buffer(rings, -done)
    if smooth:
        for by in (-smooth, smooth, smooth, -smooth):
            out, done = buffer([simplified(r, 0.004 * done) for r in out], by), smooth
    return out


def parts(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Outer rings, each with its holes."""
    outer = [r for r in rings if signed_area(r) > 0]
    out = [[r] for r in outer]
    for hole in (r for r in rings if signed_area(r) < 0):
        holders = [k for k, r in enumerate(outer) if inside((hole[:1] + hole[1:2]) / 2, [r])[0]]
        if holders:
            out[min(holders, key=lambda k: signed_area(outer[k]))].append(hole)
    return out


def difference_parts(channel: list, river: list, least_area: float = 0.0) -> list[list[np.ndarray]]:
    """What of the channel is not river, without slivers under `least_area`."""
    return [p for p in parts(overlay(channel, river, "difference")) if area(p) >= max(least_area, 0.0)]


def bank_polygon(left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """The ring between two banks; the right one is turned if it runs the other way."""
    left, right = np.asarray(left, float), np.asarray(right, float)
    if np.hypot(*(left[0] - right[0])) + np.hypot(*(left[-1] - right[-1])) > np.hypot(*(left[0] - right[-1])) + np.hypot(*(left[-1] - right[0])):
        right = right[::-1]
    return [closed(np.concatenate([left, right[::-1]]))]


def inner_point(part: list[np.ndarray]) -> np.ndarray:
    """A point inside: the middle of the widest stretch of a horizontal line between two vertices' heights."""
    a, b = edges(part)
    heights = np.unique(np.concatenate(part)[:, 1])
    best = None
    for y in (heights[1:] + heights[:-1]) / 2:
        cut = (a[:, 1] > y) != (b[:, 1] > y)
        x = np.sort(a[cut, 0] + (y - a[cut, 1]) * (b[cut, 0] - a[cut, 0]) / (b[cut, 1] - a[cut, 1]))
        for low, high in zip(x[::2], x[1::2]):
            if best is None or high - low > best[0]:
                best = (high - low, (low + high) / 2, y)
    return np.array(best[1:])


def sides(found: list[list[np.ndarray]], left: np.ndarray, right: np.ndarray) -> list[str]:
    """The nearer channel limit of each part, left of equals."""
    out = []
    for part in found:
        p = inner_point(part)
        out.append("left" if Line(left).project([p])[1][0] <= Line(right).project([p])[1][0] else "right")
    return out


def channel_limits(points, base: float, extra: Callable[[np.ndarray], np.ndarray], step: float, window: float = 50.0) -> tuple[np.ndarray, np.ndarray, dict]:
    """(left, right, numbers): the line's parallels at base + extra(radius) / 2, the radius averaged over +-window along it."""
    from riverline.operators.planar import vertex_radii

    xy = Line(points).even(max(step, 0.5), 2)
    line = Line(xy)
    radius = vertex_radii(xy)
    near = np.abs(line.along[:, None] - line.along[None, :]) <= window
    known = np.isfinite(radius)
    count = (near & known).sum(axis=1)
    mean = np.where(count > 0, np.where(known, radius, 0) @ near.T / np.maximum(count, 1), np.inf)
    wide = np.asarray(extra(mean), float)
    n = normals(line, line.along, step) * (base + wide / 2)[:, None]
    found = mean[np.isfinite(mean)]
    return xy + n, xy - n, {"least_radius": float(found.min()) if len(found) else None, "most_extra": float(wide.max()), "mean_extra": float(wide.mean())}


def excavation(points, left_bank, right_bank, base: float, extra: Callable, step: float, least_area: float) -> list[dict]:
    """Parts of the channel outside the river: ring, side and area."""
    left, right, _ = channel_limits(points, base, extra, step)
    found = difference_parts(bank_polygon(left, right), bank_polygon(left_bank, right_bank), least_area)
    return [{"rings": p, "side": s, "area": area(p)} for p, s in zip(found, sides(found, left, right))]
