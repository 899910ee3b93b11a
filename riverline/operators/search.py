"""Sequential searches, one problem per key: numpy inside Arrow groups; parallel over lines, options and classes."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def per_line(line: DataFrame, schema: str, solve: Callable[[pd.DataFrame], pd.DataFrame], key: str = "line_id", order: str = "idx", least: int = 0) -> DataFrame:
    """solve gets one line in vertex order. Lines are dealt to buckets, several to a task, and a bucket is one Arrow table: a line must fit a task, as every window over it must.
    Of few buckets a task may get twice its share by hash, and tasks are joined by bytes, not work: slow solves ask for `least` buckets and keep all tasks."""
    tasks = int(line.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    buckets = max(4 * tasks, least)

    def work(table: pa.Table) -> pa.Table:
        frame = table.to_pandas().drop(columns="__bucket").sort_values([key, order], kind="stable")
        keys = frame[key].to_numpy()
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        found = [solve(frame.iloc[s:e].reset_index(drop=True)) for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(frame)])]
        return pa.Table.from_pandas(pd.concat(found, ignore_index=True), preserve_index=False)

    wanted = StructType.fromDDL(schema)
    dealt = line.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    if least:
        dealt = dealt.repartition(tasks, "__bucket")
    arrow = to_arrow_schema(wanted)
    return dealt.groupBy("__bucket").applyInArrow(lambda t: work(t).select(arrow.names).cast(arrow), wanted)


def never_rising(levels: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Least-squares non-increasing fit: neighbouring blocks that rise are pooled to their mean."""
    blocks: list[list[float]] = []
    for v, w in zip(levels, np.ones(len(levels)) if weights is None else weights):
        blocks.append([float(v), float(w), 1])
        while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
            v1, w1, n1 = blocks.pop()
            v0, w0, n0 = blocks[-1]
            blocks[-1] = [(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, n0 + n1]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks]) if blocks else np.zeros(0)


def taubin(xy: np.ndarray, passes: int, shrink: float = 0.5, swell: float = -0.53) -> np.ndarray:
    """Alternating Laplacian steps that smooth without shrinking; the ends stay."""
    out = xy.astype(float).copy()
    for _ in range(passes):
        for factor in (shrink, swell):
            inner = (out[:-2] + out[2:]) / 2 - out[1:-1]
            out[1:-1] += factor * inner
    return out


def crossings_of(profile: np.ndarray, chainage: np.ndarray, height: float, first: float, most: float, implanted: float = 0.0, start: float | None = None) -> list[tuple[float, float]]:
    """(chainage, level) of each weir: the next stands where the bed first reaches the pool level of the last.

    A weir of `height` stands `implanted` in the bed and lifts the water by the rest. The first stands at `start`, or where the bed first
    reaches the level `first`; its crest is above its own bed, and no weir starts from a pool of `most` or more.
    """
    lift = height - implanted
    if lift <= 0:
        raise ValueError("the lift must be positive")
    reached = np.flatnonzero(profile >= first)
    at = min(int(np.searchsorted(chainage, start)), len(profile) - 1) if start is not None else int(reached[0]) if len(reached) else 0
    out = [(float(chainage[at]), float(profile[at] + lift))]
    while out[-1][1] < most:
        level = out[-1][1]
        later = np.flatnonzero(profile[at + 1 :] >= level)
        if not len(later):
            break
        k = at + 1 + int(later[0])
        rise = profile[k] - profile[k - 1]
        share = (level - profile[k - 1]) / rise if rise else 1.0
        out.append((float(chainage[k - 1] + share * (chainage[k] - chainage[k - 1])), float(level + lift)))
        at = k
    return out


def cheapest_levels(cost: np.ndarray, step_cost: float, most_step: int) -> tuple[list[int], float]:
    """One state per station at least total of cost and |step| * step_cost, steps of at most most_step; of equals the smaller step, then the lower state."""
    n, m = cost.shape
    best, back = cost[0].astype(float).copy(), np.zeros((n, m), int)
    moves = sorted(range(-most_step, most_step + 1), key=lambda s: (abs(s), s))
    for i in range(1, n):
        total = np.full(m, np.inf)
        for s in moves:
            source = np.arange(m) - s
            ok = (source >= 0) & (source < m)
            value = np.full(m, np.inf)
            value[ok] = best[source[ok]] + abs(s) * step_cost
            better = value < total
            total[better], back[i][better] = value[better], source[better]
        best = total + cost[i]
    path = [int(np.argmin(best))]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    return path[::-1], float(best.min())


def cascade(sites: list[float], lifts: list[float], terminal: float, spacing: float, cap: float, base: float, reach_cost, structure_cost, source: float = 0.0, terminal_level: float = -math.inf, best: int = 1) -> list[tuple[float, list[tuple[float, float]]]]:
    """The `best` cheapest chains of (site, level), each (cost, chain): exact over sites x levels reachable by sums of lifts.

    Sites lie beyond the source and up to the terminal, `spacing` from each other and from the source; levels stay at or under `cap`, the
    last at or over `terminal_level`. reach_cost(from, to, level) takes arrays. Endings are ordered by cost, site, level; of equal ways
    to a state the earlier site, level, lift wins. A negative `best` leaves out so many endings.
    """
    at = np.array([source, *sorted(s for s in sites if source < s <= terminal)])
    levels, new = {round(base, 3)}, {round(base, 3)}
    while new:
        new = {round(h + x, 3) for h in new for x in lifts} - levels
        new = {h for h in new if h <= cap}
        levels |= new
    height = np.array(sorted(levels))
    price = [structure_cost(x) for x in lifts]
    into: list[list[tuple[int, float]]] = [[] for _ in height]  # for each level the levels below it and what the lift costs, in order
    for h, low in enumerate(height.tolist()):
        for x, cost in zip(lifts, price):
            up = round(low + x, 3)
            if up in levels:
                into[int(np.searchsorted(height, up))].append((h, cost))
    total = np.full((len(at), len(height)), np.inf)
    total[0, np.searchsorted(height, round(base, 3))] = 0.0
    back = np.zeros((len(at), len(height), 2), int)
    for j in range(1, len(at)):
        n = int(np.searchsorted(-(at[j] - at[:j]), -spacing, side="right"))  # sites far enough back
        if not n:
            continue
        known = total[:n] + np.where(np.isfinite(total[:n]), reach_cost(at[:n, None], at[j], height[None, :]), 0)
        for k, ways in enumerate(into):
            if ways:
                options = np.stack([known[:, h] + cost for h, cost in ways], axis=1)
                flat = int(options.argmin())
                i, w = divmod(flat, len(ways))
                total[j, k], back[j, k] = options[i, w], (i, ways[w][0])
    j, k = np.nonzero(np.isfinite(total) & (height >= terminal_level - 1e-9)[None, :])
    j, k = j[j > 0], k[j > 0]
    if not len(j):
        return []
    whole = total[j, k] + reach_cost(at[j], terminal, height[k])
    order = np.lexsort((k, j, whole))
    out = []
    for e in (order[:best] if best >= 0 else order[: max(0, len(order) + best)]).tolist():
        chain, state = [], (int(j[e]), int(k[e]))
        while state[0] > 0:
            chain.append((float(at[state[0]]), float(height[state[1]])))
            state = tuple(back[state].tolist())
        out.append((float(whole[e]), chain[::-1]))
    return out


def cascade_cost(weirs: list[tuple[float, float]], terminal: float, base: float, reach_cost, structure_cost, source: float = 0.0) -> tuple[float, list[tuple[float, float]]]:
    """(cost, chain) of given weirs (place, lift): levels add up, rounded to millimetres."""
    level, at, total, chain = round(base, 3), source, 0.0, []
    for place, lift in sorted(weirs):
        total += float(reach_cost(np.array(at), place, np.array(level))) + structure_cost(lift)
        at, level = place, round(level + lift, 3)
        chain.append((place, level))
    return total + float(reach_cost(np.array(at), terminal, np.array(level))), chain


def level_table(along: np.ndarray, areas: Callable[[float], dict[str, np.ndarray]], levels: list[float], step: float) -> dict:
    """Dredged and excavated areas of every station at every level, and a reach cost from their running sums."""
    levels = sorted(levels)
    found = [areas(level) for level in levels]
    sums = {k: np.concatenate([np.zeros((1, len(levels))), np.cumsum(np.stack([f[k] for f in found], axis=1) * step, axis=0)]) for k in ("dredge", "excav")}

    def volumes(a, b, level) -> tuple[np.ndarray, np.ndarray]:
        """Of stations a <= s < b."""
        k = np.searchsorted(levels, np.round(level, 3))
        if np.any(k >= len(levels)) or not np.allclose(np.take(levels, np.minimum(k, len(levels) - 1)), level):
            raise KeyError("a level that the table does not hold")
        i, j = np.searchsorted(along, a), np.searchsorted(along, b)
        return tuple(sums[n][j, k] - sums[n][i, k] for n in ("dredge", "excav"))

    return {"levels": levels, "areas": found, "volumes": volumes, "cost": lambda wet, dry: lambda a, b, level: sum(w * v for w, v in zip((wet, dry), volumes(a, b, level)))}


def jumps(offset: np.ndarray, limit: float) -> np.ndarray:
    """True from where the offset grows by more than `limit` between stations until it is back within `limit` of what it was."""
    out, held = np.zeros(len(offset), bool), None
    for i in range(1, len(offset)):
        if np.isnan(offset[i]):
            continue
        if held is None and not np.isnan(offset[i - 1]) and offset[i] - offset[i - 1] > limit:
            held = offset[i - 1]
        if held is not None:
            if offset[i] - held <= limit:
                held = None
            else:
                out[i] = True
    return out


def monotone(source: np.ndarray, target: np.ndarray, most_step: int) -> np.ndarray:
    """Index of the nearest target for each source point, never back and at most most_step on."""
    at, out = 0, []
    for p in source:
        window = target[at : at + most_step + 1]
        at += int(np.argmin(((window - p) ** 2).sum(axis=1)))
        out.append(at)
    return np.array(out, int)


def shortest(edges: list[tuple[int, int, float]], start: int) -> dict[int, float]:
    """Dijkstra over an undirected edge list."""
    import heapq

    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    done, heap = {}, [(0.0, start)]
    while heap:
        d, a = heapq.heappop(heap)
        if a not in done:
            done[a] = d
            for b, w in near.get(a, []):
                if b not in done:
                    heapq.heappush(heap, (d + w, b))
    return done
