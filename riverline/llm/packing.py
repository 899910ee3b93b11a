"""Packing by order-preserving dynamic programming.

Documents keep their order and form one stream of ids per task. Cuts lie at document ends, at sentence ends and, inside
longer stretches, every `STRIDE` ids. Of all cut sequences with windows of at most `width` ids, the program takes one
that minimises padding plus what each cut costs (nothing at a document's end, little at a sentence's, more elsewhere)
plus a constant a window. Padding grows by one per id that a window lacks, so the best window start is the minimum of
cost + position over the last `width` ids: a monotone queue gives it in constant time. Windows of a smaller power of two
need no padding and are tried besides. The stream is solved block by block; a block's last window goes on into the next.

Defined cases: null or empty text is its end id alone; a null id is an id; repeated rows are packed each; an empty
table packs nothing.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from riverline.llm.common import documents, ids_and_bytes, raw_slices, restore_id

WIDTH = 1024
STRIDE = 32
SENTENCE, ELSEWHERE, WINDOW = 2, 8, 4
BLOCK = 1 << 19
#: Texts of these characters only are split alike by any release of the Unicode tables.
PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f]")
#: Fixed value: the pattern that splits text before the merges of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Ids as the tokenizers library gives them, by a faster encoder where both provably agree."""

    def __init__(self, file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(file)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(max(ranks.values()), self.exact.get_vocab_size()) + 1, bool)
        self.ends[[i for token, i in ranks.items() if token[-1:] in (b".", b"!", b"?") or b"\n" in token]] = True

    def encode(self, text: str) -> np.ndarray:
        if PLAIN.search(text) or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text).astype(np.uint32)


def cuts(sentence_end: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and what that costs."""
    n = len(sentence_end)
    cost = np.full(n + 1, -1)
    cost[1:][sentence_end] = SENTENCE
    cost[doc_ends] = 0
    at = np.flatnonzero(cost >= 0)
    gaps = np.diff(np.concatenate([[0], at]))
    for g in np.flatnonzero(gaps > STRIDE):
        cost[np.arange(at[g] - gaps[g] + STRIDE, at[g], STRIDE)] = ELSEWHERE
    cost[0] = -1
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_windows(at: np.ndarray, cost: np.ndarray, width: int) -> list[int]:
    """Ends of the windows that cover [0, at[-1]] at least cost."""
    place, price = at.tolist(), cost.tolist()
    halves = [width >> k for k in range(1, 4)]
    value, back, seen = {0: 0.0}, {0: -1}, value_queue()
    seen.push(0, 0.0)
    for x, p in zip(place, price):
        start, least = seen.least(x - width)
        least += width - x
        for h in halves:
            other = value.get(x - h)
            if other is not None and other < least:
                start, least = x - h, other
        least += p + WINDOW
        value[x], back[x] = least, start
        seen.push(x, least + x)
    out, x = [], place[-1]
    while x > 0:
        out.append(x)
        x = back[x]
    return out[::-1]


class value_queue:
    """Positions with rising keys: the first one not before a moving bound is the least."""

    def __init__(self):
        self.items: deque[tuple[int, float]] = deque()

    def push(self, x: int, key: float) -> None:
        items = self.items
        while items and items[-1][1] >= key:
            items.pop()
        items.append((x, key))

    def least(self, bound: int) -> tuple[int, float]:
        items = self.items
        while items[0][0] < bound:
            items.popleft()
        return items[0]


SCHEMA = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])


def packer(file: str, width: int, end_id: int):
    kept: list[ByteBpe] = []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(ByteBpe(file))
        bpe = kept[0]
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        docs: list[tuple[int, int, np.ndarray, int]] = []  # id, ids before, ids from there on, ids in all
        held = 0

        def solve(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal docs, held, sequence
            flat = np.concatenate([d[2] for d in docs])
            ends = np.cumsum([len(d[2]) for d in docs])
            windows = np.array([0, *best_windows(*cuts(bpe.ends[flat], ends), width)])
            if not last:
                windows = windows[:-1]
            stop = windows[-1]
            edges = np.unique(np.concatenate([windows, np.concatenate([[0], ends[ends < stop]])]))
            begin, length = edges[:-1], np.diff(edges)
            doc = np.searchsorted(ends, begin, side="right")
            own = np.searchsorted(windows, begin, side="right") - 1
            first = np.concatenate([[0], ends])[doc]
            raw = flat.astype("<u4").tobytes()
            columns = [
                np.array([d[0] for d in docs], np.int64)[doc], np.array([d[1] for d in docs], np.int64)[doc] + begin - first, length,
                np.array([zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist())], np.int64),
                np.array([d[3] for d in docs], np.int64)[doc], sequence + own, begin - windows[own],
            ]
            if len(begin):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=SCHEMA)
            sequence += len(windows) - 1
            k = int(np.searchsorted(ends, stop, side="right"))
            rest = docs[k:]
            if rest:
                i, before, ids, total = rest[0]
                gone = int(stop - (ends[k] - len(ids)))
                rest[0] = (i, before + gone, ids[gone:], total)
            docs, held = rest, int(ends[-1] - stop)

        for batch in batches:
            data, offsets = raw_slices(batch.column("body"))
            whole, edges = data.tobytes(), offsets.tolist()
            for i, s, e in zip(batch.column("doc_id").to_pylist(), edges, edges[1:]):
                ids = np.append(bpe.encode(whole[s:e].decode("utf-8", "replace")), np.uint32(end_id))
                docs.append((i, 0, ids, len(ids)))
                held += len(ids)
                if held >= BLOCK:
                    yield from solve(False)
        if docs:
            yield from solve(True)

    return work


def pack(docs: DataFrame, file: str, width: int = WIDTH, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kinds = ", ".join(f"{f.name} long" for f in SCHEMA)
    return restore_id(ids_and_bytes(docs).mapInArrow(packer(file, width, end_id), kinds))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
