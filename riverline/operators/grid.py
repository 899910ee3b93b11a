"""Rasters as numpy arrays: one tile with its halo is one task's value. Rows run north to south; NaN is unknown."""

from __future__ import annotations

import numpy as np

from riverline.operators.planar import inside

#: Fixed values of the cut model: bench, slope above water, intrusion that calls for a bench.
BERM, ABOVE, INTRUDES = 2.0, 1.5, 2.0


def distance(mask: np.ndarray, size: float = 1.0) -> np.ndarray:
    """Exact Euclidean distance of every cell's centre to the nearest set cell: columns first, then lower envelopes by rows."""
    rows, cols = mask.shape
    far = rows + cols
    down = np.full(mask.shape, far, float)
    run = np.full(cols, far, float)
    for r in range(rows):
        run = np.where(mask[r], 0, run + 1)
        down[r] = run
    run = np.full(cols, far, float)
    for r in range(rows - 1, -1, -1):
        run = np.where(mask[r], 0, run + 1)
        down[r] = np.minimum(down[r], run)
    across = (np.arange(cols)[:, None] - np.arange(cols)[None, :]) ** 2
    out = np.array([(across + row[None, :] ** 2).min(axis=1) for row in down])
    return np.where(mask.any(), np.sqrt(out) * size, np.inf)


def shrunk(mask: np.ndarray, by: float, size: float) -> np.ndarray:
    """Cells farther than `by` from any cell outside; beyond the tile is outside."""
    return distance(~np.pad(mask, 1), size)[1:-1, 1:-1] > by


def grown(mask: np.ndarray, by: float, size: float) -> np.ndarray:
    return distance(mask, size) <= by


def navigable(water: np.ndarray, size: float, half_width: float, clearance: float, smooth: float = 0.0) -> np.ndarray:
    """Water shrunk by half a width and the clearance, then opened and closed by `smooth`."""
    if min(half_width, clearance, smooth) < 0:
        raise ValueError("distances must not be negative")
    out = shrunk(water, half_width + clearance, size)
    if smooth:
        out = grown(shrunk(out, smooth, size), smooth, size)
        out = shrunk(grown(np.pad(out, int(np.ceil(smooth / size)) + 1), smooth, size), smooth, size)
        edge = int(np.ceil(smooth / size)) + 1
        out = out[edge:-edge, edge:-edge]
    return out


def polygon_mask(rings: list, shape: tuple[int, int], x0: float, y0: float, size: float) -> np.ndarray:
    """Cells whose centre is inside; (x0, y0) is the north-west corner."""
    r, c = np.indices(shape)
    return inside(np.stack([x0 + (c.ravel() + 0.5) * size, y0 - (r.ravel() + 0.5) * size], axis=1), rings).reshape(shape)


def line_cells(points, shape: tuple[int, int], x0: float, y0: float, size: float) -> np.ndarray:
    """All cells that a line touches: each segment is cut at every grid line it crosses, and a piece lies in one cell."""
    out = np.zeros(shape, bool)
    p = np.stack([(np.asarray(points, float)[:, 0] - x0) / size, (y0 - np.asarray(points, float)[:, 1]) / size], axis=1)
    for a, b in zip(p, p[1:]):
        cuts = [np.array([0.0, 1.0])]
        for k in (0, 1):
            low, high = sorted((a[k], b[k]))
            if high > low:
                cuts.append((np.arange(np.ceil(low), np.floor(high) + 1) - a[k]) / (b[k] - a[k]))
        t = np.unique(np.clip(np.concatenate(cuts), 0, 1))
        mid = np.concatenate([(t[1:] + t[:-1]) / 2, [0.0, 1.0]])
        cell = np.floor(a + mid[:, None] * (b - a)).astype(int)
        ok = (cell >= 0).all(axis=1) & (cell[:, 0] < shape[1]) & (cell[:, 1] < shape[0])
        out[cell[ok, 1], cell[ok, 0]] = True
    return out


def hillshade(z: np.ndarray, dx: float, dy: float, azimuth: float = 315.0, altitude: float = 45.0) -> np.ndarray:
    """Lambert shading of Horn slopes, 0 to 1; edge cells repeat, NaN near unknown cells."""
    p = np.pad(z, 1, mode="edge")
    part = lambda r, c: p[1 + r : 1 + r + z.shape[0], 1 + c : 1 + c + z.shape[1]]
    east = sum(w * (part(r, 1) - part(r, -1)) for r, w in ((-1, 1), (0, 2), (1, 1))) / (8 * dx)
    north = sum(w * (part(-1, c) - part(1, c)) for c, w in ((-1, 1), (0, 2), (1, 1))) / (8 * dy)
    light, height = np.radians(90 - azimuth), np.radians(altitude)
    sun = np.cos(height) * np.cos(light), np.cos(height) * np.sin(light), np.sin(height)
    return np.where(np.isfinite(z), np.clip((sun[2] - sun[0] * east - sun[1] * north) / np.sqrt(1 + east**2 + north**2), 0, 1), np.nan)


def decimated(z: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Area-weighted means over rows x cols new cells of any size; unknown where any part is."""

    def weights(old: int, new: int) -> np.ndarray:
        edge = np.linspace(0, old, new + 1)
        low, high = edge[:-1, None], edge[1:, None]
        cell = np.arange(old)[None, :]
        return np.clip(np.minimum(high, cell + 1) - np.maximum(low, cell), 0, None) * new / old

    a, b = weights(z.shape[0], rows), weights(z.shape[1], cols)
    out = a @ np.where(np.isfinite(z), z, 0) @ b.T
    return np.where(a @ (~np.isfinite(z)).astype(float) @ b.T > 1e-12, np.nan, out)


def mosaic(tiles: list[tuple[np.ndarray, float, float, float]]) -> tuple[np.ndarray, float, float]:
    """(z, x0, y0) of tiles (z, x0, y0, size) that lie side by side on one grid; refuses other sizes, gaps and overlaps."""
    size = tiles[0][3]
    if any(t[3] != size for t in tiles):
        raise ValueError("the tiles' cells differ in size")
    x0, y0 = min(t[1] for t in tiles), max(t[2] for t in tiles)
    place = [((y0 - t[2]) / size, (t[1] - x0) / size) for t in tiles]
    if any(abs(v - round(v)) > 1e-6 for p in place for v in p):
        raise ValueError("the tiles lie on different grids")
    place = [(round(r), round(c)) for r, c in place]
    shape = tuple(max(p[k] + t[0].shape[k] for p, t in zip(place, tiles)) for k in (0, 1))
    out, times = np.full(shape, np.nan), np.zeros(shape, int)
    for (r, c), (z, *_) in zip(place, tiles):
        out[r : r + z.shape[0], c : c + z.shape[1]] = z
        times[r : r + z.shape[0], c : c + z.shape[1]] += 1
    if (times != 1).any():
        raise ValueError("the tiles overlap" if (times > 1).any() else "the tiles leave a gap")
    return out, x0, y0


def bilinear(z: np.ndarray, x0: float, y0: float, size: float, points) -> np.ndarray:
    """Heights at points; NaN beyond the outermost centres or by an unknown cell."""
    p = np.asarray(points, float)
    c, r = (p[:, 0] - x0) / size - 0.5, (y0 - p[:, 1]) / size - 0.5
    ok = (r >= 0) & (c >= 0) & (r <= z.shape[0] - 1) & (c <= z.shape[1] - 1)
    r, c = np.where(ok, r, 0), np.where(ok, c, 0)
    i, j = np.floor(r).astype(int), np.floor(c).astype(int)
    total = np.zeros(len(p))
    for di in (0, 1):
        for dj in (0, 1):
            w = np.abs(1 - di - (r - i)) * np.abs(1 - dj - (c - j))
            v = z[np.minimum(i + di, z.shape[0] - 1), np.minimum(j + dj, z.shape[1] - 1)]
            total += np.where(w > 0, w * v, 0)
    return np.where(ok, total, np.nan)


# --- sections on a grid of stations (rows) and offsets (columns)


def template_a(ground: np.ndarray, offsets: np.ndarray, half: np.ndarray, grade: float, level: float, slope: float) -> np.ndarray:
    """Design surface: bottom, wet slope, and bench and upper slope on sides where ground above water stands in the prism; infinite where nothing is cut."""
    far, r = np.abs(offsets)[None, :], np.abs(offsets)[None, :] - half[:, None]
    edge = slope * (level - grade)
    stands = np.where(np.isfinite(ground) & (ground > level) & (r <= edge), edge - r, 0)
    upper = np.where(r <= edge + BERM, level, level + (r - edge - BERM) / ABOVE)
    benched = np.zeros(ground.shape, bool)
    for side in (offsets > 0, offsets < 0):
        benched |= (np.where(side, stands, 0).max(axis=1, initial=0) > INTRUDES)[:, None] & side
    out = np.where(r <= edge, grade + np.maximum(r, 0) / slope, np.where(benched, upper, np.inf))
    return np.where(np.broadcast_to(far, out.shape) >= 0, out, np.inf)


def beyond_works(surface: np.ndarray, ground: np.ndarray, offsets: np.ndarray, edge: np.ndarray, run: float, step: float) -> np.ndarray:
    """Cells from the first stretch beyond `edge`, `run` long, on which the ground stays at or under the surface."""
    out, length = np.zeros(ground.shape, bool), max(1, int(np.ceil(run / step)))
    lit = ~np.isfinite(ground) | ~np.isfinite(surface) | (ground <= surface)
    for sign in (1, -1):
        order = np.flatnonzero(offsets * sign > 0)
        order = order[np.argsort(np.abs(offsets[order]), kind="stable")]
        dark = np.cumsum(np.pad(~lit[:, order], ((0, 0), (1, 0))), axis=1)
        n = len(order) - length
        if n <= 0:
            continue
        free = dark[:, length + 1 :] == dark[:, :n]
        starts = free & (np.abs(offsets[order])[None, :n] > edge[:, None])
        first = np.where(starts.any(axis=1), starts.argmax(axis=1), len(order))
        out[:, order] = np.arange(len(order))[None, :] >= first[:, None]
    return out


def template_b(ground: np.ndarray, offsets: np.ndarray, half: np.ndarray, grade: float, level: float, slope: float, run: float, step: float | None = None) -> np.ndarray:
    """Model A, closed (infinite) beyond the works."""
    surface = template_a(ground, offsets, half, grade, level, slope)
    step = step or float(np.diff(np.unique(np.abs(offsets))).min(initial=1.0) if len(np.unique(np.abs(offsets))) > 1 else 1.0)
    return np.where(beyond_works(surface, ground, offsets, half + slope * (level - grade), run, step), np.inf, surface)


def section_areas(ground: np.ndarray, wet: np.ndarray, surface: np.ndarray, level: float, dx: float) -> dict[str, np.ndarray]:
    """Dredged and excavated areas and the tallest face of each station."""
    cut = np.where(np.isfinite(ground) & np.isfinite(surface), np.maximum(ground - np.where(np.isfinite(surface), surface, 0), 0), 0)
    face = np.where((cut > 0) & (ground > level), ground - level, 0)
    return {"dredge": (cut * wet).sum(axis=1) * dx, "excav": (cut * ~wet).sum(axis=1) * dx, "face": face.max(axis=1, initial=0)}


# --- imagery


def index_of_water(green: np.ndarray, nir: np.ndarray, swir: np.ndarray, clear: np.ndarray) -> np.ndarray:
    """(G - S) / (G + S), S sharpened by the NIR over its mean of 2 x 2 cells; NaN where not clear or the sum is not positive."""
    rows, cols = nir.shape
    block = np.add.reduceat(np.add.reduceat(nir, np.arange(0, rows, 2), axis=0), np.arange(0, cols, 2), axis=1)
    count = np.add.reduceat(np.add.reduceat(np.ones_like(nir, float), np.arange(0, rows, 2), axis=0), np.arange(0, cols, 2), axis=1)
    mean = np.repeat(np.repeat(block / count, 2, axis=0)[:rows], 2, axis=1)[:, :cols]
    s = swir * np.where(mean > 0, nir / np.where(mean > 0, mean, 1), 1)
    total = green + s
    return np.where(clear & (total > 0), (green - s) / np.where(total > 0, total, 1), np.nan)


def colour_model(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of feature rows; one row has covariance 0."""
    mean = samples.mean(axis=0)
    d = samples - mean
    return mean, d.T @ d / max(1, len(samples) - 1)


def water_score(features: np.ndarray, within: np.ndarray, valid: np.ndarray, size: float, floor: float = 1.0, least: int = 150) -> np.ndarray | None:
    """Log-likelihood ratio of water to land, cut at +-6, of (rows, cols, k) features; None where too few cells tell.

    Water is learned from cells well inside the polygon (0.3 of its half width, two cells at least), land from 4 to 9 cells outside.
    """
    if within.all() or not within.any():
        return None
    deep, off = distance(~within, size), distance(within, size)
    wet = valid & within & (deep >= max(0.3 * deep[within].max(), 2 * size))
    dry = valid & ~within & (off >= 4 * size) & (off <= 9 * size)
    if min(wet.sum(), dry.sum()) < least:
        return None
    (a, ca), (b, cb) = colour_model(features[wet]), colour_model(features[dry])
    weight = np.linalg.solve((ca + cb) / 2 + floor * np.eye(len(a)), a - b)
    return np.clip((features - (a + b) / 2) @ weight, -6, 6)
