"""Routes: cut costs on a grid of stations and offsets, and the cheapest line through it that a vessel can steer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from riverline.operators.planar import Line, inside, normals, opened, relaxed, smooth_offsets, turns, vertex_radii, wide_enough, radius_on_chord

LEAST_KNOWN = 5


@dataclass
class Grid:
    """cut and wet: cubic metres a station (row) and offset (column); `guarded` is cut on banks that must not be dug."""

    offsets: np.ndarray
    stations: np.ndarray
    centres: np.ndarray
    normals: np.ndarray
    cut: np.ndarray
    wet: np.ndarray
    step: float
    guarded: np.ndarray | None = None
    shut: np.ndarray = field(init=False)

    def __post_init__(self):
        self.shut = np.zeros(self.cut.shape, bool) if self.guarded is None else self.guarded > 0

    def weighted(self, wet: float, dry: float) -> np.ndarray:
        return self.wet * wet + (self.cut - self.wet) * dry

    def columns(self, offsets: np.ndarray) -> np.ndarray:
        """The grid's columns nearest to given offsets."""
        width = self.offsets[1] - self.offsets[0] if len(self.offsets) > 1 else 1.0
        return np.clip(np.rint((np.asarray(offsets) - self.offsets[0]) / width), 0, len(self.offsets) - 1).astype(int)

    def path(self, offsets: np.ndarray) -> np.ndarray:
        return self.centres + np.asarray(offsets)[:, None] * self.normals


def cost_grid(points, terrain: Callable, rings: list, grade: Callable, bottom: float, slope: float, depth: float, corridor: float, step: float, offset_step: float, transect_step: float, guarded: list[tuple[float, float, int]] = ()) -> Grid:
    """Cut of a trapezoid centred on each offset of each station: terrain(xy) heights, NaN unknown; grade(s) the bottom's level.

    A station with fewer than LEAST_KNOWN heights costs nothing. guarded: (from, to, side) of banks; side > 0 is the left one.
    """
    line = Line(points)
    s = np.arange(0, line.length + step / 2, step)
    s = s[s <= line.length]
    offsets = np.arange(-corridor, corridor + offset_step, offset_step)
    reach = corridor + bottom / 2 + slope * depth + transect_step
    across = np.arange(-reach, reach + transect_step, transect_step)
    centres, n = line.at(s), normals(line, s, 5.0)
    xy = (centres[:, None] + across[None, :, None] * n[:, None]).reshape(-1, 2)
    z = np.asarray(terrain(xy), float).reshape(len(s), -1)
    wet = inside(xy, rings).reshape(z.shape)
    known = np.isfinite(z)
    template = np.maximum(np.abs(across[None, :] - offsets[:, None]) - bottom / 2, 0) / slope  # offset x transect
    area = transect_step * step
    kept = known.sum(axis=1) >= LEAST_KNOWN
    above = np.where(known, z, -np.inf)[:, None, :] - np.asarray(grade(s), float)[:, None, None] - template[None]
    above = np.where(kept[:, None, None], np.maximum(above, 0), 0)
    held = None
    if guarded:
        along, _, side = line.project(xy)
        bank = np.zeros(len(xy), bool)
        for a, b, where in guarded:
            bank |= (along >= a) & (along <= b) & (np.sign(side) == np.sign(where))
        held = (above * (bank.reshape(z.shape) & ~wet)[:, None]).sum(axis=2) * area
    return Grid(offsets, s, centres, n, above.sum(axis=2) * area, (above * wet[:, None]).sum(axis=2) * area, step, held)


def steered(offsets: np.ndarray, centres: np.ndarray, cost: np.ndarray, least: float, step: float, fairness: float = 0.0) -> tuple[np.ndarray, float]:
    """Columns of the cheapest path whose turn at each station is within step / least (or the line's own turn): exact over pairs of columns.

    Of equal paths the lesser columns win. Raises ValueError where there is none.
    """
    k, n = len(offsets), len(cost)
    lean = np.arctan2(offsets[None, :] - offsets[:, None], step)  # from row to column
    turn = turns(centres)
    best = cost[0][:, None] + cost[1][None, :]
    back = np.zeros((n, k, k), np.int32)
    for i in range(2, n):
        bent = turn[i - 1] + lean[None, :, :] - lean[:, :, None]  # before, here, next
        fits = np.abs(bent) <= max(step / least, abs(turn[i - 1])) + 1e-12
        total = np.where(fits, best[:, :, None] + fairness * bent**2, np.inf)
        back[i] = total.argmin(axis=0)
        best = total.min(axis=0) + cost[i][None, :]
    at = int(best.argmin())
    if not np.isfinite(best.flat[at]):
        raise ValueError("no path fits the corridor and the radius")
    path = [at % k, at // k]
    for i in range(n - 1, 1, -1):
        path.append(int(back[i][path[-1], path[-2]]))
    return np.array(path[::-1]), float(best.flat[at])


def bounds(centres: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Offsets within which the shifted line keeps the radius: bounded on the inside of bends."""
    room, turn = np.maximum(vertex_radii(centres) - least, 0), turns(centres)
    return np.where(turn < -1e-6, -room, -np.inf), np.where(turn > 1e-6, room, np.inf)


def protected_cut(grid: Grid, offsets: np.ndarray) -> float:
    return 0.0 if grid.guarded is None else float(grid.guarded[np.arange(len(offsets)), grid.columns(offsets)].sum())


def saving(grid: Grid, cost: np.ndarray, offsets: np.ndarray) -> float:
    """Per cent of the straight path's cost that the offsets save."""
    rows, middle = np.arange(len(offsets)), int(np.abs(grid.offsets).argmin())
    base, own = cost[rows, middle].sum(), cost[rows, grid.columns(offsets)].sum()
    return float(100 * (base - own) / base) if base else 0.0


def within_corridor(grid: Grid, cost: np.ndarray, corridor: float, least: float, fairness: float = 0.0) -> dict:
    """The path of one corridor: cheapest columns, smoothed, then relaxed or opened until the radius holds."""
    low, high = bounds(grid.centres, least)
    o = grid.offsets[None, :]
    shut = (np.abs(o) > corridor + 1e-6) | (o < low[:, None] - 1e-6) | (o > high[:, None] + 1e-6) | grid.shut
    columns, _ = steered(grid.offsets, grid.centres, np.where(shut, np.inf, cost), least, grid.step, fairness)
    target = 0.98 * least
    own = smooth_offsets(grid.offsets[columns], grid.step / least, turns(grid.centres), grid.step)
    own, passes, radius = relaxed(own, grid.centres, grid.normals, target)
    if radius < target - 1e-6:
        wider, more, found = opened(own, grid.centres, grid.normals, target, corridor)
        if protected_cut(grid, wider) <= protected_cut(grid, own):
            own, passes, radius = wider, passes + more, found
    return {"corridor": corridor, "offsets": own, "passes": passes, "radius": radius, "saving": saving(grid, cost, own)}


def best_route(grid: Grid, least: float, wet: float, dry: float, corridors: list[float], chord: float | None = None, fairness: float = 0.0) -> dict:
    """The best of several corridors: no cut on guarded banks before the radius, that before the saving; the first of equals."""
    cost, found, failure = grid.weighted(wet, dry), [], None
    stride = max(1, int(np.floor(chord / (2 * grid.step) + 0.5))) if chord else 1
    for corridor in corridors:
        try:
            one = within_corridor(grid, cost, corridor, least, fairness)
        except ValueError as error:
            if grid.guarded is None:
                raise
            failure = error
            continue
        xy = grid.path(one["offsets"])
        one |= {"clean": protected_cut(grid, one["offsets"]) == 0, "ok": bool(wide_enough(vertex_radii(xy, stride).min(), least)), "line": xy}
        found.append(one)
    if not found:
        raise failure or ValueError("no corridor to try")
    best = max(found, key=lambda f: (f["clean"], f["ok"], f["saving"]))  # max keeps the first of equals
    measured = radius_on_chord(best["line"], chord or max(2 * grid.step, least / 3))
    return best | {"measured": measured, "ok": bool(wide_enough(measured, least)), "sweep": [(f["corridor"], f["saving"], f["radius"]) for f in found]}
