"""Language-model scoring by subword lattice likelihood.

The lattice of a word has an arc for every piece of an existing vocabulary that matches somewhere in it; the pieces'
scores become arc weights, and a log-space forward recursion sums over all segmentations. The scores of the
vocabulary are negated ranks, so a piece of rank r weighs 1 / (r + RANK_SHIFT), normalised apart for word starts and
insides; byte pieces share BYTE_MASS, so every word has a path. Words seen in training have one more arc, the whole
word, with its discounted relative frequency (absolute discounting from counts of counts); the mass taken off goes to
the lattice. So a document's probability is a product over its words and the end, and sums to at most one over texts.

Execution: each task numbers the words of a block of documents once, keeps the documents as numbers, and sends words
with training counts to hash shards. A shard adds up the counts of a word over all blocks, runs the recursion once per
distinct word and answers every block. A word in every document costs one entry per block. Nothing grows on the driver
but three sums.

Defined cases: null, empty or blank text is the end token alone; without training documents the lattice alone scores
(the end has probability 1); repeated rows score alike and each counts in training.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverline.llm.common import documents, durable, id_remainder, ids_and_bytes, raw_slices, restore_id, shuffle_width, total_bytes

RANK_SHIFT = 50.0
BYTE_MASS = 0.02
WORD_END = 0.3
START = "\u2581".encode()
BLOCK_WORDS = 1 << 18
NEVER = -1e30
#: Bytes of text that a shard of words answers for, and how many shards a block is cut into at most.
SHARD_BYTES, MOST_SHARDS = 256 << 20, 1 << 14
BLOCKS = "kind int, block long, shard int, ids binary, words binary, counts binary"
ANSWERS = "block long, at binary, count binary, inside binary, tokens long, seen long, once long, twice long"


class Lattice:
    """Arc weights (natural logs) of the vocabulary's pieces; at word starts and inside words."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=model_file)
        raw: tuple[dict[bytes, float], dict[bytes, float]] = ({}, {})
        for i in range(pieces.get_piece_size()):
            if pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i) or pieces.is_unused(i):
                continue
            piece = pieces.id_to_piece(i).encode()
            if piece.lower() == piece and START not in piece[1:]:  # bytes: only A-Z are lowered in texts, too
                raw[0 if piece.startswith(START) else 1][piece] = 1 / (RANK_SHIFT - pieces.get_score(i))
        self.arcs: list[dict[bytes, float]] = []
        self.open: list[set[bytes]] = []
        for k, found in enumerate(raw):
            if not k:
                found.setdefault(START, 1 / RANK_SHIFT)
            total = sum(found.values()) or 1.0
            share = 1.0 if k == 0 else 1 - BYTE_MASS  # a start always has its mark, an inside may fall back to bytes
            arcs = {p: log(share * v / total * (1 - WORD_END if k else 1)) for p, v in found.items()}
            if k:
                byte = BYTE_MASS / 256 * (1 - WORD_END)
                for b in range(256):
                    one = bytes([b])
                    arcs[one] = log(exp(arcs[one]) + byte) if one in arcs else log(byte)
            self.arcs.append(arcs)
            self.open.append({p[:n] for p in arcs for n in range(1, len(p) + 1)})

    def word(self, word: bytes) -> float:
        """Natural log of the sum over all segmentations of START + word, each piece and the word's end included."""
        text = START + word
        n = len(text)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for i in range(n):
            if not into[i]:
                continue
            here = logsum(into[i])
            arcs, open_ = self.arcs[i > 0], self.open[i > 0]
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                if piece not in open_:
                    break
                weight = arcs.get(piece)
                if weight is not None:
                    into[j].append(here + weight)
        return (logsum(into[n]) if into[n] else NEVER) + log(WORD_END)


def logsum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    top = max(terms)
    return top + log(sum(exp(t - top) for t in terms))


def planes(values: np.ndarray) -> bytes:
    """Little-endian 32-bit numbers as four byte planes; the high ones compress to nothing."""
    return np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def joined(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def numbering(shards: int):
    """Blocks of documents as word numbers (kind 0) and their words with training counts by shard (kind 1)."""

    def flush(block: int, words: dict, docs: list) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(t) for _, _, t in docs], np.int64)
        flat = np.concatenate([t for _, _, t in docs])
        trained = np.repeat([t for _, t, _ in docs], sizes)
        counts = np.bincount(flat[trained], minlength=len(words)).astype("<i8")
        head = np.array([[i for i, _, _ in docs], sizes], "<i8").tobytes()
        rows = [(0, block, -1, head, planes(flat), b"")]
        names = list(words)
        shard = np.array([zlib.crc32(w) for w in names], np.uint32) % np.uint32(shards)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            rows.append((1, block, int(shard[part[0]]), part.astype("<u4").tobytes(), b"\n".join([names[i] for i in part]), counts[part].tobytes()))
        schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("ids", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block, words, docs = (context.partitionId() if context else 0) << 24, {b"": 0}, []
        for batch in batches:
            data, offsets = raw_slices(batch.column("body"))
            whole, edges = data.tobytes(), offsets.tolist()
            train = batch.column("train").to_pylist()
            for k, i in enumerate(batch.column("doc_id").to_pylist()):
                tokens = [words.setdefault(w, len(words)) for w in whole[edges[k] : edges[k + 1]].lower().split()]
                tokens.append(0)  # the end, which no word can equal
                docs.append((i, train[k], np.array(tokens, np.uint32)))
                if len(words) >= BLOCK_WORDS:
                    yield from flush(block, words, docs)
                    block, words, docs = block + 1, {b"": 0}, []
        if docs:
            yield from flush(block, words, docs)

    return work


def answering(model_file: str):
    kept: list[Lattice] = []

    def work(table: pa.Table) -> pa.Table:
        if not kept:
            kept.append(Lattice(model_file))
        lattice = kept[0]
        rows = table.select(["block", "ids", "words", "counts"]).to_pylist()
        number: dict[bytes, int] = {}
        places = [np.array([number.setdefault(w, len(number)) for w in r["words"].split(b"\n")], np.int64) for r in rows]
        total = np.zeros(len(number), np.int64)
        for r, place in zip(rows, places):
            total[place] += np.frombuffer(r["counts"], "<i8")
        inside = np.array([lattice.word(w) if w else NEVER for w in number])
        sums = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
        out = {
            "block": [r["block"] for r in rows], "at": [r["ids"] for r in rows],
            "count": [planes(np.minimum(total[p], 2**32 - 1)) for p in places], "inside": [inside[p].astype("<f4").tobytes() for p in places],
        }
        for k, name in enumerate(("tokens", "seen", "once", "twice")):
            out[name] = [sums[k]] + [0] * (len(rows) - 1)
        return pa.table({k: pa.array(v, pa.binary() if k in ("at", "count", "inside") else pa.int64()) for k, v in out.items()})

    return work


def scoring(tokens: int, seen: int, once: int, twice: int):
    discount = once / (once + 2 * twice) if once and twice else 0.5

    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found = answers.select(["at", "count", "inside"]).to_pylist()
        size = sum(len(r["at"]) // 4 for r in found)
        count, inside = np.zeros(size), np.full(size, NEVER)
        for r in found:
            at = np.frombuffer(r["at"], "<u4")
            count[at], inside[at] = joined(r["count"]), np.frombuffer(r["inside"], "<f4")
        base = np.log10((count + 1) / (tokens + seen + 1))
        if tokens:
            chance = (np.maximum(count - discount, 0) + discount * seen * np.exp(inside)) / tokens
            with np.errstate(divide="ignore"):
                own = np.where(chance > 1e-290, np.log10(np.maximum(chance, 1e-300)), inside / np.log(10) + np.log10(discount * seen / tokens))
        else:
            own = inside / np.log(10)
        if not tokens or not count[0]:
            own[0] = 0.0
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "n_known", "base_score", "score")}
        for row in docs.select(["ids", "words"]).to_pylist():
            ids, sizes = np.frombuffer(row["ids"], "<i8").reshape(2, -1)
            flat = joined(row["words"])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            out["doc_id"].append(ids)
            out["n_tokens"].append(sizes)
            out["n_known"].append(np.add.reduceat((count > 0)[flat].astype(np.int64), starts))
            out["base_score"].append(np.add.reduceat(base[flat], starts))
            out["score"].append(np.add.reduceat(own[flat], starts))
        kinds = {"base_score": pa.float64(), "score": pa.float64()}
        return pa.table({k: pa.array(np.concatenate(v) if v else [], kinds.get(k, pa.int64())) for k, v in out.items()})

    return work


def lm_scores(docs: DataFrame, model_file: str, shards: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    shards = shards or max(shuffle_width(docs.sparkSession), min(MOST_SHARDS, total_bytes(docs) // SHARD_BYTES))
    body = ids_and_bytes(docs).withColumn("train", id_remainder(F.col("doc_id"), 7) != 2)
    blocks = durable(body.mapInArrow(numbering(shards), BLOCKS), "blocks")
    asked = blocks.where("kind = 1").select("shard", "block", "ids", "words", "counts")
    answers = durable(asked.groupBy("shard").applyInArrow(answering(model_file), ANSWERS), "answers")
    tokens, seen, once, twice = (x or 0 for x in answers.agg(*(F.sum(c) for c in ("tokens", "seen", "once", "twice"))).first())
    left = blocks.where("kind = 0").select("block", "ids", "words").groupBy("block")
    right = answers.select("block", "at", "count", "inside").groupBy("block")
    found = left.cogroup(right).applyInArrow(scoring(tokens, seen, once, twice), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held = id_remainder(F.col("doc_id"), 7) == 2
    return restore_id(found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"))


def op6_lattice_lm(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_scores(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
