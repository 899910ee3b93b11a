"""Exact dedup with a log-structured merge index.

Each map task keeps a memtable from digest to the distinct texts seen (compared byte by byte) and flushes it as a sorted
run, cut by digest range into blocks, each with a Bloom filter. Compaction takes one digest range at a time, puts its
blocks into levels that merge when they grow, and asks a level only for digests its filter lets through. Digests
found in more than one run go to byte verification: one text per run is fetched and grouped by its bytes.

A group of copies of any size reaches compaction as one entry per run, and its member ids never leave their run's block.

Defined cases: null text equals empty text; a null id is an id (the smallest); if the deciding id occurs on several
rows, the first of them in one run stays; an empty table gives no rows. Ids name rows: of rows that share id and text
any serves as the text to verify.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverline.llm.common import IdFilter, durable, ids_and_bytes, mix64, restore_id, shuffle_width

WIDTH = 32
SHARD_ENTRIES = 1 << 21
BLOCKS = "run long, shard int, entries int, digests binary, best binary, sizes binary, ids binary, filter binary"
HITS = "run long, shard int, place int, digest binary, sample long, best long, size long"
PROBES = 4


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def bloom(prefix: np.ndarray) -> np.ndarray:
    """Bits for the entries' first 8 bytes: 16 bits an entry, a power of two."""
    n = 64
    while n < 16 * len(prefix):
        n *= 2
    bits = np.zeros(n, bool)
    bits[places(prefix, n)] = True
    return np.packbits(bits)


def places(prefix: np.ndarray, n: int) -> np.ndarray:
    first, second = mix64(prefix), mix64(prefix ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((first + steps * second) & np.uint64(n - 1)).astype(np.int64)


def may_hold(filter_bits: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    at = places(prefix, 8 * len(filter_bits))
    return ((filter_bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def flusher(shards: int, memtable_bytes: int, keep_largest: bool, digest: Callable[[bytes], bytes]):
    better = max if keep_largest else min

    def flush(run: int, table: dict) -> Iterator[tuple]:
        entries = sorted(((d, text, ids) for d, group in table.items() for text, ids in group), key=lambda e: (e[0], e[2][0]))
        shard = [int.from_bytes(e[0][:4], "big") * shards >> 32 for e in entries]
        start = 0
        for end in range(1, len(entries) + 1):
            if end == len(entries) or shard[end] != shard[start]:
                part = entries[start:end]
                digests = b"".join(e[0] for e in part)
                ids = np.array([i for e in part for i in e[2]], "<i8")
                yield (
                    run, shard[start], len(part), digests, np.array([better(e[2]) for e in part], "<i8").tobytes(),
                    np.array([len(e[2]) for e in part], "<i8").tobytes(), ids.tobytes(), bloom(prefixes(digests)).tobytes(),
                )
                start = end

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        run, table, held = (context.partitionId() if context else 0) << 24, {}, 0
        schema = pa.schema([("run", pa.int64()), ("shard", pa.int32()), ("entries", pa.int32()), *((n, pa.binary()) for n in ("digests", "best", "sizes", "ids", "filter"))])
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("body")):
                text = text.as_py()
                group = table.setdefault(digest(text), [])
                for known, ids in group:
                    if known == text:
                        ids.append(i)
                        held += 8
                        break
                else:
                    group.append((text, [i]))
                    held += len(text) + 200
                if held > memtable_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flush(run, table)), schema)], schema=schema)
                    run, table, held = run + 1, {}, 0
        if table:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flush(run, table)), schema)], schema=schema)

    return work


def prefixes(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, ">u8").reshape(-1, WIDTH // 8)[:, 0].astype(np.uint64)


class Level:
    """Sorted digests of some runs, with where each came from."""

    def __init__(self, digests: np.ndarray, source: np.ndarray, bits: np.ndarray | None = None):
        self.digests, self.source = digests, source
        self.prefix = prefixes(digests.tobytes())
        self.bits = bloom(self.prefix) if bits is None else bits

    def merged(self, other: Level) -> Level:
        digests, source = np.concatenate([self.digests, other.digests]), np.concatenate([self.source, other.source])
        order = np.argsort(digests, kind="stable")
        return Level(digests[order], source[order])

    def shared(self, other: Level) -> np.ndarray:
        """The digests of `other` that are here too: filter first, then a search on whole digests."""
        asked = np.flatnonzero(may_hold(self.bits, other.prefix))
        if not len(asked):
            return other.digests[:0]
        wanted = other.digests[asked]
        at = np.minimum(np.searchsorted(self.digests, wanted), len(self.digests) - 1)
        return wanted[self.digests[at] == wanted]


def compact(table: pa.Table) -> pa.Table:
    """Entries of one shard whose digest another entry of the shard has too."""
    rows = table.sort_by("run").to_pylist()
    starts = np.cumsum([0, *(r["entries"] for r in rows)])
    levels: list[Level] = []
    found = [np.zeros(0, f"S{WIDTH}")]
    for r, first in zip(rows, starts):
        digests = np.frombuffer(r["digests"], f"S{WIDTH}")
        found.append(digests[1:][digests[1:] == digests[:-1]])  # different texts under one digest
        new = Level(digests, first + np.arange(len(digests)), np.frombuffer(r["filter"], np.uint8))
        found += [level.shared(new) for level in levels]
        levels.append(new)
        while len(levels) > 1 and 2 * len(levels[-1].digests) > len(levels[-2].digests):
            levels[-2:] = [levels[-2].merged(levels[-1])]
    shared = np.unique(np.concatenate(found))
    out: dict[str, list] = {k: [] for k in ("run", "shard", "place", "digest", "sample", "best", "size")}
    for r in rows if len(shared) else []:
        digests = np.frombuffer(r["digests"], f"S{WIDTH}")
        at = np.minimum(np.searchsorted(shared, digests), len(shared) - 1)
        best, sizes, ids = (np.frombuffer(r[k], "<i8") for k in ("best", "sizes", "ids"))
        first = np.concatenate([[0], np.cumsum(sizes)])
        for place in np.flatnonzero(shared[at] == digests).tolist():
            out["run"].append(r["run"])
            out["shard"].append(r["shard"])
            out["place"].append(place)
            out["digest"].append(r["digests"][place * WIDTH : place * WIDTH + WIDTH])
            out["sample"].append(int(ids[first[place]]))
            out["best"].append(int(best[place]))
            out["size"].append(int(sizes[place]))
    kinds = {"shard": pa.int32(), "place": pa.int32(), "digest": pa.binary()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document of a block, with what verification said of its entry."""
    for batch in batches:
        for r in batch.to_pylist():
            best, sizes, ids = (np.frombuffer(r[k], "<i8") for k in ("best", "sizes", "ids"))
            keep, total, mine = best.copy(), sizes.copy(), np.ones(len(best), bool)
            for hit in r["verified"] or []:
                keep[hit["place"]], total[hit["place"]], mine[hit["place"]] = hit["keep_id"], hit["group_size"], hit["mine"]
            entry = np.repeat(np.arange(len(sizes)), sizes)
            stays = (ids == keep[entry]) & mine[entry]
            again = np.flatnonzero(stays)
            first = again[np.unique(entry[again], return_index=True)[1]] if len(again) else again
            kept = np.zeros(len(ids), bool)
            kept[first] = True
            digests = np.frombuffer(r["digests"], np.uint8).reshape(-1, WIDTH)[entry]
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "keep_id": keep[entry], "group_size": total[entry], "kept": kept, "digest": pa.array([d.tobytes() for d in digests], pa.binary())})


def digested(texts: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """texts (sample, body) with column digest."""
    if digest is sha256:
        return texts.withColumn("digest", F.unhex(F.sha2("body", 256)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([digest(b) for b in batch.column("body").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("sample"), batch.column("body"), found], names=["sample", "body", "digest"])

    return texts.select("sample", "body").mapInArrow(work, "sample long, body binary, digest binary")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    memtable_bytes: int = 64 << 20, shards: int | None = None, digest: Callable[[bytes], bytes] = sha256,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest. keep: "smallest" or "largest" id of equal texts."""
    shards = shards or max(shuffle_width(docs.sparkSession), docs.count() // SHARD_ENTRIES)
    body = ids_and_bytes(docs, id_col, text_col)
    blocks = durable(body.mapInArrow(flusher(shards, memtable_bytes, keep == "largest", digest), BLOCKS), "runs")
    hits = durable(blocks.select("run", "shard", "entries", "digests", "best", "sizes", "ids", "filter").groupBy("shard").applyInArrow(compact, HITS), "hits")

    # only texts of hits are moved, each (id, text) once: a filter picks them where they are read
    texts = digested(IdFilter(hits, "sample").apply(body.withColumnRenamed("doc_id", "sample"), "sample"), digest).distinct()
    wanted = hits.select("run", "shard", "place", "digest", "sample", "best", "size")
    seen = wanted.hint("merge").join(texts, ["sample", "digest"])
    seen = seen.groupBy("digest", "body", "run", "shard", "place").agg(F.first("best").alias("best"), F.first("size").alias("size"))
    rank = F.struct(F.col("best") if keep == "largest" else F.bitwise_not("best"), -F.col("run"), -F.col("place"))
    classes = seen.groupBy("digest", "body").agg(
        F.sum("size").alias("group_size"), F.max(F.struct(rank.alias("rank"), "best", "run", "place")).alias("top"),
        F.collect_list(F.struct("run", "shard", "place")).alias("entries"),  # one per run, not per document
    )
    verified = (
        classes.select("group_size", "top", F.explode("entries").alias("e"))
        .select("e.run", "e.shard", F.struct("e.place", F.col("top.best").alias("keep_id"), "group_size", ((F.col("top.run") == F.col("e.run")) & (F.col("top.place") == F.col("e.place"))).alias("mine")).alias("hit"))
        .groupBy("run", "shard").agg(F.collect_list("hit").alias("verified"))
    )
    rows = blocks.select("run", "shard", "digests", "best", "sizes", "ids").join(verified, ["run", "shard"], "left")
    out = rows.mapInArrow(members, "doc_id long, keep_id long, group_size long, kept boolean, digest binary")
    return restore_id(out, "doc_id", "keep_id")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from riverline.llm.common import documents

    found = exact_dedup(documents(spark, sf_dir), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
