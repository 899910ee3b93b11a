"""Suffix-array dedup: remove every byte covered by a long string that also starts in a document with a smaller id.

1. Anchors. Each window of `LENGTH` bytes has an anchor, the least hash of its q-grams, so equal windows have equal
   anchors wherever they are. Neighbouring windows with one anchor form a run. Only anchor hashes of a group of documents
   (five bytes each, once a group) go to shards, which answer with those that two documents share.
2. Contexts. The bytes of runs with shared anchors, each distinct content once a group with its least id, go to buckets
   by anchor. An anchor with more than `WIDE` contexts in some group or `WIDE_IN_ALL` in all of them (the border of a passage that
   many documents hold) is split up: its windows go one by one, by their own content.
3. Refinement. A bucket builds suffix buckets by bucket-pointer refinement: initial q-gram buckets are refined by sorting
   on the bucket numbers of later offsets (5, 10, 20, 40, then 50 bytes), each pass reusing the numbers of the last, and
   the least id of each final bucket is the first document of its windows. These are comparisons of bytes: hashes only
   choose what is compared.
4. Every group turns first documents into removed bytes.

The exchange of texts by group is one, read three times. Copies of any number cost one context a group.

Defined cases: null text is empty; texts under `LENGTH` bytes lose nothing; rows with one id don't remove each other's bytes;
within one document repeats stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverline.llm.common import NULL_ID, documents, mix64, raw_slices, restore_id, shuffle_width, total_bytes
from riverline.llm.textscan import per_text

LENGTH = 50
GRAM = 32
CHUNK = 1 << 17
#: Bits of an anchor: up to a TB of text most anchors differ in the first number, beyond it in the second.
KEY_BITS, MORE_KEY_BITS, MORE_FROM = 40, 56, 1 << 40
WIDE = 32
WIDE_IN_ALL = 256
GROUP_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
SHARD_KEYS = 1 << 21
NARROW = 1 << 20


def wide(data: np.ndarray) -> np.ndarray:
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def anchors(data: np.ndarray) -> np.ndarray:
    """For each window of LENGTH bytes the least hash of its q-grams."""
    words = np.ascontiguousarray(wide(data))
    n = len(words) - GRAM + 8
    h = sum((words[k : k + n] ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15 + 0xD6E8FEB86659FD92 * k & 2**64 - 1) for k in range(0, GRAM, 8))
    h = mix64(h)
    grams, have = LENGTH - GRAM + 1, 1
    while 2 * have <= grams:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (grams - have)], h[grams - have :])


def runs(data: np.ndarray, offsets: np.ndarray, bits: int = KEY_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows, text) of each run of windows with one anchor."""
    keys, starts, sizes = [], [], []
    n = len(data) - LENGTH + 1
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    edge[np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])] = True
    for at in range(0, max(n, 0), CHUNK):
        end = min(n, at + CHUNK)
        low = anchors(data[at : end + LENGTH - 1])
        new = edge[at:end].copy()
        new[0] = True
        new[1:] |= low[1:] != low[:-1]
        begin = np.flatnonzero(new)
        keys.append(low[begin] >> np.uint64(64 - bits))
        starts.append(begin + at)
        sizes.append(np.diff(np.append(begin, end - at)))
    if not keys:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    key, start, size = np.concatenate(keys), np.concatenate(starts), np.concatenate(sizes)
    text = np.searchsorted(offsets, start, side="right") - 1
    inside = start + LENGTH <= offsets[text + 1]
    return key[inside], start[inside], size[inside], text[inside]


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True) if data else b""


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True) if data else b""


def short(keys: np.ndarray) -> bytes:
    """Keys as differences in byte planes, compressed: sorted keys take about half of their bits. The first byte says how many planes."""
    planes = max(1, (int(keys.max()).bit_length() + 7) // 8) if len(keys) else 1
    steps = np.diff(keys, prepend=np.uint64(0))
    return bytes([planes]) + packed(np.ascontiguousarray(steps, "<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes())


def full(data: bytes) -> np.ndarray:
    n = data[0]
    planes = np.frombuffer(unpacked(data[1:]), np.uint8).reshape(n, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :n] = planes.T
    return np.cumsum(out.view("<u8").reshape(-1), dtype=np.uint64) & np.uint64((1 << 8 * n) - 1)


def by_id(table: pa.Table) -> pa.Table:
    """A group's documents by id, then text."""
    return table.sort_by([("__id", "ascending"), ("__body", "ascending")]).combine_chunks()


def texts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bytes, offsets) of a group's documents in the order of by_id."""
    table = by_id(table.select(["__id", "__body"]))
    data, offsets = raw_slices(table.column("__body"))
    return table.column("__id").to_numpy(), np.ascontiguousarray(data), offsets


def table_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def split(keys: np.ndarray, parts: int, bits: int):
    """(part, slice) of sorted keys by equal ranges."""
    part = ((keys >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(part)) + 1
    for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]):
        if e > s:
            yield int(part[s]), slice(s, e)


KEYS = pa.schema([("shard", pa.int32()), ("g", pa.int64()), ("keys", pa.binary()), ("kinds", pa.binary())])
SHARED = pa.schema([("g", pa.int64()), ("keys", pa.binary()), ("hot", pa.binary())])
CONTEXTS = pa.schema([("bucket", pa.int32()), ("g", pa.int64()), ("keys", pa.binary()), ("hot", pa.bool_()), ("at", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("content", pa.binary())])
FIRSTS = pa.schema([("g", pa.int64()), ("keys", pa.binary()), ("hot", pa.bool_()), ("at", pa.binary()), ("sizes", pa.binary()), ("firsts", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary', pa.bool_(): 'boolean', pa.string(): 'string'})[f.type]}" for f in schema)


def send_keys(shards: int, bits: int):
    """Sorted anchors by shard; `kinds` counts an anchor's contexts (127 at most), and its highest bit tells that two documents of the group hold it."""

    def work(table: pa.Table) -> pa.Table:
        g = table.column("__g")[0].as_py()
        ids, data, offsets = texts_of(table)
        key, start, size, text = runs(data, offsets, bits)
        order = np.argsort(key, kind="stable")
        key, owner, start, size = key[order], ids[text[order]], start[order], size[order]
        if not len(key):
            return KEYS.empty_table()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        many = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        words = wide(data)
        look = mix64(words[start] ^ mix64(words[start + size + LENGTH - 9] + size.astype(np.uint64)))  # tells contexts of a key apart
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        by = np.lexsort((look, own))
        kinds = np.bincount(own[by][np.append(True, (own[by][1:] != own[by][:-1]) | (look[by][1:] != look[by][:-1]))], minlength=len(first))
        flags = (np.minimum(kinds, 127) + 128 * many).astype(np.uint8)
        key = key[first]
        return table_of(KEYS, [(shard, g, short(key[s]), packed(flags[s].tobytes())) for shard, s in split(key, shards, bits)])

    return work


def shared_keys(table: pa.Table) -> pa.Table:
    rows = table.select(["g", "keys", "kinds"]).to_pylist()
    own = [full(r["keys"]) for r in rows]
    flags = np.concatenate([np.frombuffer(unpacked(r["kinds"]), np.uint8) for r in rows]).astype(np.int64)
    distinct, which, groups = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    kinds, many = flags & 127, flags >> 7
    shared = (groups > 1) | (np.bincount(which, many, len(distinct)) > 0)
    hot = shared & ((np.bincount(which, kinds, len(distinct)) > WIDE_IN_ALL) | (np.bincount(which, kinds > WIDE, len(distinct)) > 0))
    out, at = [], 0
    for r, keys in zip(rows, own):
        w = which[at : at + len(keys)]
        at += len(keys)
        if shared[w].any():
            out.append((r["g"], short(keys[shared[w] & ~hot[w]]), short(keys[hot[w]])))
    return table_of(SHARED, out)


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def contexts(data: np.ndarray, offsets: np.ndarray, plain: np.ndarray, hot: np.ndarray, bits: int):
    """Distinct contexts of a group in a fixed order, and where they occur.

    (contents, key of each, hot or not, first text of each, context of each occurrence, its first window, its windows, its text).
    """
    key, start, size, text = runs(data, offsets, bits)
    is_hot = member(key, hot)
    use = is_hot | member(key, plain)
    key, start, size, text, is_hot = key[use], start[use], size[use], text[use], is_hot[use]
    if is_hot.any():  # window by window
        times = np.where(is_hot, size, 1)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        key, text, is_hot = (np.repeat(x, times) for x in (key, text, is_hot))
        start = np.repeat(start, times) + step
        size = np.where(is_hot, 1, np.repeat(size, times))
    whole = data.tobytes()
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(whole[s:e], len(number)) for s, e in zip(start.tolist(), (start + size + LENGTH - 1).tolist())), np.int64, len(start))
    first = np.full(len(number), len(start), np.int64)
    np.minimum.at(first, which, np.arange(len(start)))
    return list(number), key[first], is_hot[first], text[first], which, start, size, text


def send_contexts(buckets: int, bits: int):
    def work(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows or not shared.num_rows:
            return CONTEXTS.empty_table()
        g = docs.column("__g")[0].as_py()
        ids, data, offsets = texts_of(docs)
        plain, hot = (np.sort(np.concatenate([full(b) for b in shared.column(c).to_pylist()])) for c in ("keys", "hot"))
        contents, key, is_hot, text, *_ = contexts(data, offsets, plain, hot, bits)
        bucket = (mix64(key) % np.uint64(buckets)).astype(np.int64)
        for k in np.flatnonzero(is_hot).tolist():
            bucket[k] = zlib.crc32(contents[k]) % buckets
        out = []
        order = np.lexsort((is_hot, bucket))
        edges = np.flatnonzero((np.diff(bucket[order]) != 0) | (np.diff(is_hot[order].astype(np.int8)) != 0)) + 1
        for part in np.split(order, edges):
            if len(part):
                content = [contents[k] for k in part.tolist()]
                sizes = np.array([len(c) for c in content], "<u4")
                out.append((int(bucket[part[0]]), g, short(key[part]), bool(is_hot[part[0]]), packed(part.astype("<u4").tobytes()), packed(np.diff(ids[text[part]], prepend=0).astype("<i8").tobytes()), packed(sizes.tobytes()), packed(b"".join(content))))
        return table_of(CONTEXTS, out)

    return work


def ranks(high: np.ndarray, low: np.ndarray | None = None, bits: int = 20) -> np.ndarray:
    """Bucket numbers of the pairs (high, low) in their order; equal pairs share one."""
    key = high if low is None else high << np.uint64(bits) | low
    n = len(key)
    if n <= NARROW and (2 * bits if low is not None else 40) <= 44:  # key and 20 bits of place sort as one number
        packed = np.sort(key << np.uint64(20) | np.arange(n, dtype=np.uint64))
        order, key = (packed & np.uint64(NARROW - 1)).astype(np.int64), packed >> np.uint64(20)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    out = np.empty(n, np.uint64)
    out[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if n else []
    return out


def refine(text: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Numbers of the buckets of equal LENGTH-byte strings that start at `windows`."""
    bits = max(20, int(len(text)).bit_length())  # 32 at most: two numbers make one key
    if bits > 32:
        raise ValueError("a part holds 4 GB at most")
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    bucket = ranks(wide(padded)[: len(text)] & np.uint64((1 << 40) - 1))  # 5-gram buckets

    def later(b: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([b[by:], np.zeros(min(by, len(b)), np.uint64)])

    for depth in (5, 10, 20):
        bucket = ranks(bucket, later(bucket, depth), bits)
    return ranks(bucket[windows], bucket[windows + LENGTH - 40], bits)


def first_documents(table: pa.Table) -> pa.Table:
    """For each context sent, the least id among all contexts of its windows, as runs of (windows, id)."""
    rows = table.select(["g", "keys", "hot", "at", "ids", "sizes", "content"]).to_pylist()
    number: dict[bytes, int] = {}
    which, key_of, least = [], [], []
    for r in rows:
        content, ends = unpacked(r["content"]), np.cumsum(np.frombuffer(unpacked(r["sizes"]), "<u4")).tolist()
        own = []
        for s, e, k, i in zip([0, *ends], ends, full(r["keys"]).tolist(), np.cumsum(np.frombuffer(unpacked(r["ids"]), "<i8")).tolist()):
            c = content[s:e]
            at = number.setdefault(c, len(number))
            if at == len(least):
                least.append(i)
                key_of.append(k)
            elif i < least[at]:
                least[at] = i
            own.append(at)
        which.append(own)
    contents, least_ = list(number), np.array(least, np.int64)
    firsts: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(contents)  # only where windows differ from the context's own least id
    keys = np.array(key_of, np.uint64)
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.diff(keys[order]) != 0) + 1
    batch: list[int] = []
    held = 0

    def solve() -> None:
        sizes = np.array([len(contents[k]) for k in batch])
        base = np.cumsum(sizes) - sizes
        windows_of = sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(batch)), windows_of)
        place = np.arange(windows_of.sum()) - np.repeat(np.cumsum(windows_of) - windows_of, windows_of)
        bucket = refine(np.frombuffer(b"".join(contents[k] for k in batch), np.uint8), base[owner] + place).astype(np.int64)
        own = least_[np.array(batch)][owner]
        low = np.full(bucket.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, bucket, own)
        found = low[bucket]
        edge = np.append(True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1]))
        at = np.flatnonzero(edge)
        length = np.diff(np.append(at, len(edge)))
        for b, (s, e) in zip(batch, zip(*(lambda c: (c[:-1], c[1:]))(np.searchsorted(owner[at], np.arange(len(batch) + 1)).tolist()))):
            firsts[b] = (length[s:e], found[at[s:e]])

    for part in np.split(order, edges) if len(order) else []:
        if len(part) > 1:
            size = sum(len(contents[k]) for k in part.tolist())
            if batch and held + size > NARROW:
                solve()
                batch, held = [], 0
            batch += part.tolist()
            held += size
    if batch:
        solve()
    out = []
    for r, own in zip(rows, which):
        sizes, docs, counts = [], [], []
        for k in own:
            if firsts[k] is None:
                sizes.append(np.array([len(contents[k]) - LENGTH + 1]))
                docs.append(least_[k : k + 1])
            else:
                sizes.append(firsts[k][0])
                docs.append(firsts[k][1])
            counts.append(len(docs[-1]))
        at = np.stack([np.frombuffer(unpacked(r["at"]), "<u4"), np.array(counts, "<u4")]).astype("<u4")
        out.append((r["g"], r["keys"], r["hot"], packed(at.tobytes()), packed(np.concatenate(sizes).astype("<u4").tobytes()), packed(np.concatenate(docs).astype("<i8").tobytes())))
    return table_of(FIRSTS, out)


def covered(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, firsts: pa.Table, bits: int) -> np.ndarray:
    """Which bytes of a group go."""
    depth = np.zeros(len(data) + 1, np.int64)
    rows = firsts.to_pylist()
    if rows:
        plain, hot = (np.unique(np.concatenate([np.zeros(0, np.uint64), *(full(r["keys"]) for r in rows if r["hot"] == h)])) for h in (False, True))
        *_, which, start, _, text = contexts(data, offsets, plain, hot, bits)
        at, counts = (np.concatenate([np.frombuffer(unpacked(r["at"]), "<u4").reshape(2, -1)[k] for r in rows]).astype(np.int64) for k in (0, 1))
        sizes = np.concatenate([np.frombuffer(unpacked(r["sizes"]), "<u4") for r in rows]).astype(np.int64)
        docs = np.concatenate([np.frombuffer(unpacked(r["firsts"]), "<i8") for r in rows])
        begin = np.cumsum(counts) - counts
        skip = np.cumsum(sizes) - sizes
        skip -= np.repeat(skip[begin], counts)  # windows of the context before this part
        row_of = np.empty(at.max() + 1, np.int64)
        row_of[at] = np.arange(len(at))
        row = row_of[which]
        times = counts[row]
        part = np.repeat(begin[row], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        low = np.repeat(start, times) + skip[part]
        gone = docs[part] < np.repeat(ids[text], times)
        np.add.at(depth, low[gone], 1)
        np.add.at(depth, (low + sizes[part] + LENGTH - 1)[gone], -1)
    return np.cumsum(depth[:-1]) > 0


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def left_over(docs: pa.Table, firsts: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(ids, offsets, which bytes go, what remains of each text), by id."""
    ids, data, offsets = texts_of(docs)
    gone = covered(ids, data, offsets, firsts, bits)
    stay = data[~gone].tobytes()
    edges = np.concatenate([[0], np.cumsum(per_text((~gone).astype(np.int64), offsets))]).tolist()
    return ids, offsets, gone, [stay[s:e] for s, e in zip(edges, edges[1:])]


def report(bits: int):
    def work(docs: pa.Table, firsts: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return RESULT.empty_table()
        ids, offsets, gone, kept = left_over(docs, firsts, bits)
        fresh = gone.copy()
        fresh[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(gone)]
        fresh[inner] = gone[inner]
        columns = [ids, np.diff(offsets), per_text(gone.astype(np.int64), offsets), per_text(fresh.astype(np.int64), offsets), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        return pa.table([pa.array(c) for c in columns], schema=RESULT)

    return work


def grouped_firsts(docs: DataFrame, id_col: str, text_col: str, *carried: str):
    """(documents by group, with columns __g, __id, __body and, in __row, those carried; first documents by group; bits of an anchor)."""
    width = shuffle_width(docs.sparkSession)
    size = total_bytes(docs, text_col)
    groups = max(width, size // GROUP_BYTES + 1)
    shards = max(4 * width, size // (10 * SHARD_KEYS) + 1)  # several to a task, as they are dealt by hash
    bits = KEY_BITS if size < MORE_FROM else MORE_KEY_BITS
    buckets = max(width, size // BUCKET_BYTES + 1)
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    body = docs.select(ident.alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("__body"), *([F.struct(*(F.col(f"`{c}`") for c in carried)).alias("__row")] if carried else []))
    body = body.withColumn("__g", F.pmod(F.xxhash64("__id"), F.lit(groups)))
    keys = body.groupBy("__g").applyInArrow(send_keys(shards, bits), ddl(KEYS))
    shared = keys.groupBy("shard").applyInArrow(shared_keys, ddl(SHARED))
    sent = body.groupBy("__g").cogroup(shared.groupBy("g")).applyInArrow(send_contexts(buckets, bits), ddl(CONTEXTS))
    firsts = sent.groupBy("bucket").applyInArrow(first_documents, ddl(FIRSTS))
    return body.groupBy("__g"), firsts.groupBy("g"), bits


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    body, firsts, bits = grouped_firsts(docs, id_col, text_col)
    return restore_id(body.cogroup(firsts).applyInArrow(report(bits), ddl(RESULT)))


def removed_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, columns as they are, with the bytes gone from the text; a character that loses a byte goes whole."""
    columns = docs.columns
    others = [c for c in columns if c != text_col]
    body, groups, bits = grouped_firsts(docs, id_col, text_col, *others)

    def work(rows: pa.Table, firsts: pa.Table) -> pa.Table:
        kept = left_over(rows, firsts, bits)[3] if rows.num_rows else []
        table = by_id(rows) if rows.num_rows else rows
        text = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        kept_row = table.column("__row").combine_chunks() if others else None
        return pa.table([text if c == text_col else kept_row.field(others.index(c)) for c in columns], names=columns)

    return body.cogroup(groups).applyInArrow(work, docs.schema)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))
