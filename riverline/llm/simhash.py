"""SimHash near-dedup with vantage-point trees.

A fingerprint is a point of the 64-bit Hamming cube. A top tree, built from a bounded sample, cuts the space into shards:
a node holds a vantage point and a radius, points within it go left, others right. Points left of a border that the
triangle inequality can't rule out also visit the right side, down to every shard a link of theirs may end in. In a
shard the same recursion goes on over its members until blocks are small enough to compare one by one. So every link
of the table is found in exactly the shard of its right-hand member, and only a spanning forest of it leaves the shard.

Each level of the top tree copies the points near its border, so the tree has `LEAVES` leaves at any size, and a point has some three
copies. A table of more points than `LEAVES` shards hold is first cut into groups: of radius + 1 equal blocks of bits, two linked
fingerprints share one at least, so a point joins the group of each of its blocks (by the block's first bits, as many as the size asks
for), and every group has its own shards under the same tree. So copies per point stay under a bound while the table grows.

Equal fingerprints are one point, so a group of copies costs one row per task before the first shuffle.

Defined cases: no words (null, empty or blank text) gives fingerprint zero, linked like any other; fewer words than a
shingle: the whole sequence is the one shingle; a null id sorts first; repeated rows share a component; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverline.llm.common import durable, ids_and_bytes, raw_slices, restore_id
from riverline.llm.components import components

SEED = 42
CHUNK = 1 << 16
LEAVES = 16


def shingle_hashes(body: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of `words` lower-cased words joined by spaces, repeats included."""
    joined = b" ".join(body.lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(gaps) + 1 <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = [0, *(gaps[: len(gaps) + 1 - words] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(joined)]
    hashed = xxhash.xxh64_intdigest
    return np.fromiter([hashed(joined[s:e], SEED) for s, e in zip(starts, ends)], np.uint64, len(starts))


def fingerprint(body: bytes, words: int) -> int:
    return majority(shingle_hashes(body, words))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_slices(batch.column("body"))
            whole, ends = data.tobytes(), offsets.tolist()
            found = np.array([fingerprint(whole[s:e], words) for s, e in zip(ends, ends[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return ids_and_bytes(docs, id_col, text_col).mapInArrow(work, "doc_id long, fp long")


def apart(points: np.ndarray, other) -> np.ndarray:
    return np.bitwise_count(points ^ other).astype(np.int16)


def border(points: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 24) -> tuple[np.uint64, int] | None:
    """The vantage point and radius, of some tried, that leave fewest points near the border and at least a fifth on either side."""
    best = None
    sample = points if len(points) <= 2048 else rng.choice(points, 2048, replace=False)
    for vantage in rng.choice(sample, tries):
        counts = np.bincount(apart(sample, vantage), minlength=65)[:65]
        inside = np.cumsum(counts)
        for cut in range(64):
            side = min(inside[cut], len(sample) - inside[cut])
            if 5 * side >= len(sample):
                near = inside[min(64, cut + radius)] - (inside[cut - radius] if cut >= radius else 0)
                cost = (near + 0.5 * abs(2 * inside[cut] - len(sample))) / len(sample)
                if best is None or cost < best[0]:
                    best = (cost, vantage, cut)
    return best and best[1:]


def grow(sample: np.ndarray, depth: int, radius: int) -> list[tuple]:
    """The top tree as a list of (vantage, radius, left, right); a leaf is a negative number, -1 - shard."""
    rng, nodes, leaves = np.random.default_rng(7), [], 0

    def build(points: np.ndarray, left: int) -> int:
        nonlocal leaves
        cut = border(points, radius, rng) if left and len(points) >= 32 else None
        if cut is None:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(None)
        inside = apart(points, cut[0]) <= cut[1]
        nodes[at] = (cut[0], cut[1], build(points[inside], left - 1), build(points[~inside], left - 1))
        return at

    root = build(sample, depth)
    return nodes if root >= 0 else []


def route(nodes: list[tuple], points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of point, shard, is member) for the home shard of each point and the shards it visits."""
    found = []

    def go(at: int, home: np.ndarray, guests: np.ndarray) -> None:
        if not len(home) and not len(guests):
            return
        if at < 0 or not nodes:
            shard = -1 - at if nodes else 0
            found.append((np.concatenate([home, guests]), shard, np.repeat([True, False], [len(home), len(guests)])))
            return
        vantage, cut, left, right = nodes[at]
        d, g = apart(points[home], vantage), apart(points[guests], vantage)
        go(left, home[d <= cut], guests[g <= cut + radius])
        go(right, home[d > cut], np.concatenate([home[(d <= cut) & (d + radius > cut)], guests[g + radius > cut]]))

    every = np.arange(len(points))
    go(0, every, every[:0])
    index = np.concatenate([f[0] for f in found] or [every])
    shard = np.repeat([f[1] for f in found], [len(f[0]) for f in found]).astype(np.int32)
    return index, shard, np.concatenate([f[2] for f in found] or [np.zeros(0, bool)])


class Forest:
    """Union-find over point numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the classes of each pair: hang roots under least roots until nothing moves."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low != high
            if not open_.any():
                return
            a, b = low[open_], high[open_]
            np.minimum.at(self.up, b, a)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while not np.array_equal(r, self.up[r]):
            r = self.up[r]
        self.up[x] = r
        return r


def search(points: np.ndarray, members: np.ndarray, guests: np.ndarray, radius: int, forest: Forest, block: int = 1024) -> None:
    """Join points within `radius`: members with each other and with guests."""
    rng = np.random.default_rng(11)
    stack = [(members, guests)]
    while stack:
        home, away = stack.pop()
        cut = border(points[home], radius, rng, 6) if len(home) > block else None
        if cut is not None:
            d, g = apart(points[home], cut[0]), apart(points[away], cut[0])
            stack.append((home[d <= cut[1]], away[g <= cut[1] + radius]))
            stack.append((home[d > cut[1]], np.concatenate([home[(d <= cut[1]) & (d + radius > cut[1])], away[g + radius > cut[1]]])))
            continue
        every = np.concatenate([home, away])
        for at in range(0, len(home), 256):
            rows = home[at : at + 256]
            for to in range(0, len(every), 8192):
                near = np.bitwise_count(points[rows][:, None] ^ points[every[to : to + 8192]][None, :]) <= radius
                i, j = np.nonzero(near)
                forest.link(rows[i], every[to : to + 8192][j])


def shard_links(radius: int):
    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        points = table.column("fp").to_numpy().view(np.uint64)
        nodes, member = table.column("node").to_numpy(), table.column("member").to_numpy()
        order = np.argsort(nodes, kind="stable")  # the least node of a class is its root
        points, nodes, member = points[order], nodes[order], member[order]
        forest = Forest(len(points))
        search(points, np.flatnonzero(member), np.flatnonzero(~member), radius, forest)
        root = forest.roots(np.arange(len(points)))
        moved = np.flatnonzero(root != np.arange(len(points)))
        return pa.table({"u": nodes[moved], "v": nodes[root[moved]]})

    return work


def blocks(fp: Column, count: int, bits: int) -> Column:
    """Numbers of the groups of a fingerprint: one a block, by the first `bits` bits of the block."""
    width = 64 // count
    return F.array(*(F.lit(k << bits) + F.shiftrightunsigned(F.shiftleft(fp, width * k), 64 - bits) for k in range(count))) if bits else F.array(F.lit(0).cast("long"))


def near_links(nodes: DataFrame, radius: int = 3, members_per_shard: int = 200_000, leaves: int = LEAVES, sample_points: int = 1 << 14) -> DataFrame:
    """nodes (fp, node), fp distinct -> links (u, v) whose closure is that of all pairs within `radius` bits."""
    spark = nodes.sparkSession
    count, width = nodes.count(), 64 // (radius + 1)
    over = -(-count // (leaves * members_per_shard))
    bits = min(width, (over - 1).bit_length()) if over > 1 else 0
    depth = (leaves - 1).bit_length() if count > 1000 else 0
    sample = nodes.select("fp").orderBy(F.xxhash64("fp")).limit(sample_points if depth else 0).collect()
    tree = spark.sparkContext.broadcast(grow(np.array([r[0] for r in sample], np.int64).view(np.uint64), depth, radius))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, fp, node = (batch.column(c).to_numpy() for c in ("grp", "fp", "node"))
            index, leaf, member = route(tree.value, fp.view(np.uint64), radius)
            yield pa.RecordBatch.from_pydict({"shard": group[index] << 16 | leaf, "fp": fp[index], "node": node[index], "member": member})

    grouped = nodes.select(F.explode(blocks(F.col("fp"), radius + 1, bits)).alias("grp"), "fp", "node")
    dealt = grouped.mapInArrow(deal, "shard long, fp long, node long, member boolean")
    return dealt.groupBy("shard").applyInArrow(lambda t: shard_links(radius)(t), "u long, v long")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least id of those reachable by links of at most `radius` bits)."""
    prints = durable(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    moved = components(near_links(nodes, radius))
    labels = nodes.join(moved, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return restore_id(prints.join(labels, "fp"), "doc_id", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    from riverline.llm.common import documents

    found = simhash_components(documents(spark, sf_dir), words=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
