"""Near copies at a Jaccard similarity of word shingles.

First the method of op5: SimHash fingerprints of the shingles are joined by vantage-point trees at RADIUS bits, and the texts of each class
are compared on all their shingles (as 32-bit hashes): the similar ones are linked. A pair of similarity 0.8 may differ in a quarter of its bits, where triangle
bounds rule out nothing, so fingerprints alone would lose it. The rest is dealt by min-hash keys (`KEYS` of them: a pair of
similarity s shares none with probability (1-s)**KEYS, 0.0003 at 0.8), and of a key's texts each leads once: those not yet of its
class, from the first step on, are compared in the same way, and the similar ones join it with their classes. Only pairs inside a class are skipped, so a group costs few passes, and no link of a key is lost.
In a key of more than `FEW` texts only those are compared that share rare hashes and whose sizes and bits leave room for the similarity:
filters that lose no pair, so a passage that many texts share costs no comparison of all with all.
Texts of a key that more than `MOST` share are dealt to chunks, and each two chunks (and each with itself) meet in a task of their own: no task
holds more than two chunks, and still every pair of the key meets.

Defined cases: texts of one shingle set are one point (no words, like null, is the empty set); a null id sorts first;
repeated rows share a group; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverline.llm.common import NULL_ID, durable, fresh, ids_and_bytes, mix64, raw_slices, shuffle_width
from riverline.llm.components import components
from riverline.llm.simhash import majority, near_links, shingle_hashes

RADIUS = 3
KEYS = 5
MOST = 20_000
#: Keys of more texts look up who shares rare hashes; in smaller ones all are compared.
FEW = 32
LONG, BITS = 8, 2048
SLACK = 1e-9
SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64) for k in range(KEYS)]


def prints(body: bytes, words: int) -> tuple[list[int], bytes, bytes, int]:
    """(min-hash keys, all sorted 32-bit hashes, digest of the 64-bit ones, SimHash fingerprint as a signed long) of a text's shingles."""
    every = shingle_hashes(body, words)
    hashes = np.unique(every)
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    if not len(hashes):
        return [0] * KEYS, b"", digest, 0
    keys = [int(mix64(mix64(hashes ^ s)).min().astype(np.int64)) for s in SEEDS]
    return keys, np.unique((mix64(hashes) >> np.uint64(32)).astype("<u4")).tobytes(), digest, int(np.uint64(majority(every)).astype(np.int64))


def links_of(nodes: np.ndarray, hashes: list[bytes], similarity: float, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (node, leader) that connect all pairs of a key at `similarity`: everyone leads in turn, against all that are not yet of its class.

    `known` are classes found before: texts of one are linked already.
    """
    sets = [np.frombuffer(h, "<u4") for h in hashes]
    sizes = np.array([len(s) for s in sets])
    edges = np.append(0, np.cumsum(sizes))
    found, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    sums = np.append(0, np.cumsum(often[at]))
    common = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(sizes, 1)
    mates, bits = (rare_mates(at, often, sizes, similarity), bit_sets(sets)) if len(nodes) > FEW else (None, None)
    classes = np.arange(len(nodes)) if known is None else np.unique(known, return_inverse=True)[1]
    out, held = [], np.zeros(len(found), bool)
    for lead in np.argsort(-common, kind="stable"):  # an original, of the most common hashes, before its copies: only time depends on it
        if mates:
            met = mates(lead, classes)
        elif (classes == classes[lead]).all():
            break
        else:
            met = np.flatnonzero(classes != classes[lead])
        met = met[np.minimum(sizes[met], sizes[lead]) >= similarity * np.maximum(sizes[met], sizes[lead]) - SLACK]
        if mates and len(met):  # hashes that a bit tells to be missing on either side bound what can be common
            most = np.minimum(sizes[met] - np.bitwise_count(bits[met] & ~bits[lead]).sum(axis=1, dtype=np.int64), sizes[lead] - np.bitwise_count(bits[lead] & ~bits[met]).sum(axis=1, dtype=np.int64))
            met = met[most >= (similarity - SLACK) * (sizes[met] + sizes[lead] - most)]
        if not len(met):
            continue
        held[at[edges[lead] : edges[lead + 1]]] = True
        ends = np.cumsum(sizes[met])
        sums = np.append(0, np.cumsum(held[at[np.arange(ends[-1]) + np.repeat(edges[met] - ends + sizes[met], sizes[met])]]))
        held[at[edges[lead] : edges[lead + 1]]] = False
        both = sums[ends] - sums[ends - sizes[met]]
        near = met[both / np.maximum(sizes[met] + sizes[lead] - both, 1) >= similarity]
        joined, first = np.unique(classes[near], return_index=True)
        out += [(int(nodes[i]), int(nodes[lead])) for i in near[first]]
        classes[np.isin(classes, joined)] = classes[lead]
    return out


def bit_sets(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set of hashes: those of its hashes' low ends."""
    out = np.zeros((len(sets), BITS // 8), np.uint8)
    for row, found in zip(out, sets):
        flags = np.zeros(BITS, bool)
        flags[found % BITS] = True
        row[:] = np.packbits(flags)
    return out.view("<u8")


def rare_mates(at: np.ndarray, often: np.ndarray, sizes: np.ndarray, similarity: float):
    """A function (lead, classes) -> the texts of other classes that may be similar to lead and have not led before.

    Two sets at `similarity` share that part of either's hashes at least, so they share one of the rarest that make up the rest and one
    more of each, all sets' hashes taken in one order: texts that share none of these are never compared, and no similar pair is lost.
    """
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((rank[at], owner))
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rest = sizes - np.ceil(similarity * sizes - SLACK).astype(np.int64) + 1
    picked = order[(place < rest[owner]) & (often[at[order]] > 1)]  # owner is the same before and after the sort
    holder, rare = owner[picked], at[picked]
    first = np.searchsorted(holder, np.arange(len(sizes) + 1))
    listed = np.argsort(rare, kind="stable")
    lists, start = holder[listed], np.searchsorted(rare[listed], np.arange(len(often) + 1))
    settled, led = np.zeros(len(often), bool), np.zeros(len(sizes), bool)

    def mates(lead: int, classes: np.ndarray) -> np.ndarray:
        led[lead] = True
        own = rare[first[lead] : first[lead + 1]]
        own = own[~settled[own]]
        counts = start[own + 1] - start[own]
        ends = np.cumsum(counts)
        if not len(own):
            return own
        if ends[-1] > LONG * len(sizes):  # looking them up would take longer than comparing bits with all
            return np.flatnonzero(~led & (classes != classes[lead]))
        others = lists[np.arange(ends[-1]) + np.repeat(start[own] - ends + counts, counts)]
        apart = ~led[others] & (classes[others] != classes[lead])
        settled[own[np.add.reduceat(apart, ends - counts, dtype=np.int64) == 0]] = True
        found = np.zeros(len(sizes), bool)
        found[others[apart]] = True
        return np.flatnonzero(found)

    return mates


def shard_links(similarity: float):
    def work(table: pa.Table) -> pa.Table:
        table = table.select(["key", "node", "class", "hashes"]).sort_by([("key", "ascending"), ("node", "ascending")]).combine_chunks()
        key, node, known = (table.column(c).to_numpy() for c in ("key", "node", "class"))
        hashes = table.column("hashes")
        edges = np.flatnonzero(np.diff(key)) + 1
        out: list[tuple[int, int]] = []
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(key)]):
            out += links_of(node[s:e], hashes[s:e].to_pylist(), similarity, known[s:e])
        u, v = zip(*set(out)) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return work


def points_of(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two durable tables: (doc_id, keys, hashes, point, fp) of each document, and (point, node, keys, fp) of each different set, node its least id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_slices(batch.column("body"))
            whole, edges = data.tobytes(), offsets.tolist()
            keys, hashes, point, fp = zip(*(prints(whole[s:e], words) for s, e in zip(edges, edges[1:]))) if batch.num_rows else ((),) * 4
            columns = [batch.column("doc_id"), pa.array(keys, pa.list_(pa.int64())), pa.array(hashes, pa.binary()), pa.array(point, pa.binary()), pa.array(fp, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "keys", "hashes", "point", "fp"])

    points = durable(ids_and_bytes(docs, id_col, text_col).mapInArrow(work, "doc_id long, keys array<long>, hashes binary, point binary, fp long"), "prints")
    return points, durable(points.groupBy("point").agg(F.min("doc_id").alias("node"), F.min("keys").alias("keys"), F.min("fp").alias("fp")), "points")


def key_links(keyed: DataFrame, points: DataFrame, similarity: float, most: int = MOST) -> DataFrame:
    """keyed (node, point, class, key) -> links (u, v) that connect all pairs of a key at `similarity`, but for those of one class."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key", F.ceil(F.col("n") / most).cast("int").alias("chunks"))
    owners = points.select(F.col("doc_id").alias("node"), "point", "hashes")  # a row that repeats an owner only repeats a member of its class
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.xxhash64("key", F.least(c, own), F.greatest(c, own)))
    met = keyed.hint("merge").join(shared, "key").select("node", "point", "class", F.explode(F.when(F.col("chunks") > 1, pairs).otherwise(F.array("key"))).alias("key"))
    wanted = met.hint("merge").join(owners, ["node", "point"])
    shards = 4 * shuffle_width(points.sparkSession)
    dealt = wanted.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(shard_links(similarity), "u long, v long")


def fingerprint_links(points: DataFrame, nodes: DataFrame, similarity: float, most: int = MOST) -> DataFrame:
    """Links at `similarity` among the texts that vantage-point trees join: whose fingerprints reach each other by RADIUS bits or fewer."""
    marks = durable(nodes.groupBy("fp").agg(F.min("node").alias("owner")), "marks")
    reached = components(near_links(marks.select("fp", F.col("owner").alias("node")), RADIUS)).withColumnRenamed("node", "owner")
    near = marks.join(reached, "owner", "left").select("fp", F.coalesce("component", "owner").alias("key"))
    return key_links(nodes.select("node", "point", F.col("node").alias("class"), "fp").join(near, "fp").drop("fp"), points, similarity, most)


def near_copy_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row per document: doc_id (nulls as NULL_ID), component_id: the least id of its group."""
    points, nodes = points_of(docs, words, id_col, text_col)
    near = durable(components(fingerprint_links(points, nodes, similarity, most)), "near")
    classed = nodes.join(near, "node", "left").select("node", "point", F.coalesce("component", "node").alias("class"), F.posexplode("keys").alias("k", "key"))
    rest = key_links(classed.select("node", "point", "class", F.xxhash64("k", "key").alias("key")), points, similarity, most)
    moved = components(near.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(rest))
    labels = nodes.select("point", "node").join(moved, "node", "left").select("point", F.coalesce("component", "node").alias("component_id"))
    return points.select("doc_id", "point").join(labels, "point").select("doc_id", "component_id")


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is the least of its group; rows that repeat such an id once each stay."""
    groups = near_copy_groups(docs, words, similarity, id_col)
    name = fresh(docs, "__stay")
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stay, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)) == F.col(name), "left_semi")
