"""Quality classifier: supervised subword embeddings.

Words, word pairs and character 3- and 4-grams hash to rows of one learned table. A document is the mean of its word
rows plus the mean of its character rows, and goes through a softmax. Stochastic gradient descent in numpy trains both
on a bounded sample of the labelled rows (parameter `sample_rows`, the rows whose hashed ids come first, as far as their bags fit
`sample_bytes` together). The sample's texts become bags of at most BUCKETS numbers where they are read, and one task descends over the bags:
neither texts nor bags reach the driver. The model is one number per bucket (table and output folded); that is what the driver gets
and broadcasts, and its size is fixed. Scoring reads every text once.

Two more kinds of word feature stand for repetition, whatever the words: a word equal to the one before, or to any of the three before.

Defined cases: an empty or blank text (or null) has no features and scores the bias, which is the sample's prior; without
labelled rows every score is 0.5; rows with a null label or null id don't train; of repeated rows of an id and label the one with the least bag trains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverline.llm.common import NULL_ID, documents, fresh, id_remainder, ids_and_bytes, raw_slices, restore_id, sliced
from riverline.llm.textscan import Words

SLICE = 1 << 19
BUCKETS = 1 << 16


def features(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Two groups, of words and of characters, of parts: (bucket of each feature, first and end of each text's features)."""
    words = Words(data, offsets)
    h = words.hashes()
    pairs, first = words.runs(h, 2)
    same, recent = np.zeros(len(h), bool), np.zeros(len(h), bool)
    text = words.text_of()
    for back in (1, 2, 3):
        equal = (h[back:] == h[:-back]) & (text[back:] == text[:-back])
        recent[back:] |= equal
        if back == 1:
            same[1:] = equal
    lo, hi = words.first[:-1], words.first[1:]
    parts = [(bucket_of(h), lo, hi)]
    for bucket, at in ((bucket_of(pairs), first), (None, np.flatnonzero(same)), (None, np.flatnonzero(recent))):
        edges = np.searchsorted(at, words.first)
        parts.append((np.full(len(at), len(parts)) if bucket is None else bucket, edges[:-1], edges[1:]))
    wide = data.astype(np.uint32)
    three = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    four = three[:-1] | wide[3:] << np.uint32(24)
    grams = []
    for n, g, m in ((3, three, 0x9E3779B1), (4, four, 0x85EBCA6B)):
        lo = np.minimum(offsets[:-1], len(g))  # a short last text begins beyond the last gram
        grams.append(((g * np.uint32(m)) >> np.uint32(16), lo, np.maximum(lo, offsets[1:] + 1 - n)))
    return [parts, grams]


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, bucket indices, shares) of each text: shares of a group add up to one."""
    for batch in sliced(batches, SLICE):
        data, offsets = raw_slices(batch.column("body"))
        groups = features(data, offsets)
        at, share = [], []
        for i in range(batch.num_rows):
            total = np.zeros(BUCKETS)
            for parts in groups:
                n = sum(hi[i] - lo[i] for _, lo, hi in parts)
                for f, lo, hi in parts:
                    if hi[i] > lo[i]:
                        total += np.bincount(f[lo[i] : hi[i]], minlength=BUCKETS) / n
            used = np.flatnonzero(total)
            at.append(used.astype("<i4").tobytes())
            share.append(total[used].astype("<f4").tobytes())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "at": pa.array(at, pa.binary()), "share": pa.array(share, pa.binary())})


class Model:
    """table: one number per bucket (embedding times output difference); score = sigmoid(mean + mean + bias)."""

    def __init__(self, table: np.ndarray, bias: float, rows: int):
        self.table, self.bias, self.rows = table.astype(np.float32), bias, rows

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        logit = np.full(len(offsets) - 1, self.bias)
        for parts in features(data, offsets):
            total, n = np.zeros(len(logit)), np.zeros(len(logit), np.int64)
            for f, lo, hi in parts:
                sums = np.zeros(len(f) + 1)
                np.cumsum(self.table[f], out=sums[1:], dtype=np.float64)
                total += sums[hi] - sums[lo]
                n += hi - lo
            logit += total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def descend(samples: list[tuple[int, np.ndarray, np.ndarray]], dim: int = 8, epochs: int = 5, rate: float = 4.0, seed: int = 3) -> Model:
    """Stochastic gradient descent on embeddings and softmax output, one document a step, falling rate."""
    rng = np.random.default_rng(seed)
    ones = sum(s[0] for s in samples)
    bias = float(np.log((ones + 1) / (len(samples) - ones + 1))) if samples else 0.0
    table = rng.normal(0, 0.02, (BUCKETS, dim))
    out = rng.normal(0, 0.3, (dim, 2))
    own = np.array([0.0, bias])
    steps, done = epochs * len(samples), 0
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            label, at, share = samples[k]
            step = rate * (1 - done / steps)
            done += 1
            rows, for_out, for_own = gradients(table[at], out, own, label, share.astype(float))
            out -= 0.05 * step * for_out
            own -= 0.01 * step * for_own
            table[at] -= step * rows
    turn = out[:, 1] - out[:, 0]
    return Model(table @ turn, float(own[1] - own[0]), len(samples))


def gradients(rows: np.ndarray, out: np.ndarray, own: np.ndarray, label: int, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of -ln softmax(share @ rows @ out + own)[label] by rows, out and own."""
    hidden = share @ rows
    logit = hidden @ out + own
    p = np.exp(logit - logit.max())
    p /= p.sum()
    p[label] -= 1
    return share[:, None] * (out @ p)[None, :], np.outer(hidden, p), p


def fit(sample_bytes: int):
    """One row (table, bias, rows) from all bags of the task, in their order, as far as `sample_bytes` hold them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, held = [], 0
        for batch in batches:
            for y, at, share in zip(batch.column("label").to_pylist(), batch.column("at"), batch.column("share")):
                held += 2 * at.as_buffer().size
                if held <= sample_bytes:
                    samples.append((y, np.frombuffer(at.as_py(), "<i4"), np.frombuffer(share.as_py(), "<f4")))
        if samples:
            model = descend(samples)
            yield pa.RecordBatch.from_pydict({"table": pa.array([model.table.astype("<f4").tobytes()], pa.binary()), "bias": [model.bias], "rows": pa.array([model.rows], pa.int64())})

    return work


def train(docs: DataFrame, labels: DataFrame, label: str, learn, sample_rows: int, sample_bytes: int = 128 << 20) -> Model:
    """Fit on the `sample_rows` labelled rows with the first hashed ids; learn: condition on doc_id."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").where(learn(F.col("doc_id")))
    chosen = chosen.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    rows = ids_and_bytes(docs).where(F.col("doc_id") != F.lit(NULL_ID)).join(F.broadcast(chosen), "doc_id")  # sample_rows rows at most
    bagged = rows.select("doc_id", "label", "body").mapInArrow(bags, "doc_id long, label int, at binary, share binary")
    once = bagged.groupBy("doc_id", "label").agg(F.min(F.struct("at", "share")).alias("bag")).select("doc_id", "label", "bag.*")
    ordered = once.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "label")  # sample_rows rows at most
    found = ordered.select("label", "at", "share").mapInArrow(fit(sample_bytes), "table binary, bias double, rows long").first()
    return Model(np.frombuffer(found["table"], "<f4"), found["bias"], found["rows"]) if found else Model(np.zeros(BUCKETS), 0.0, 0)


def score(docs: DataFrame, model: Model, *kept: str) -> DataFrame:
    """(doc_id, score) of every document, and the columns named in `kept`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE):
            found = shared.value.scores(*raw_slices(batch.column("body")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return ids_and_bytes(docs).mapInArrow(work, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score. Rows with crc32(doc_id) mod 4 = 2 are held out and never train."""
    model = train(docs, labels, "quality", lambda i: id_remainder(i, 4) != 2, sample_rows)
    return restore_id(score(docs, model).select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = 4000) -> DataFrame:
    """The rows of docs, columns as they are, that score `threshold` or more; all of them where nothing can be learned."""
    model = train(docs, labels, "quality", lambda i: id_remainder(i, 4) != 2, sample_rows)
    if not model.rows:
        return docs
    shared, columns, body = docs.sparkSession.sparkContext.broadcast(model), docs.columns, fresh(docs, "__body")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE, body):
            good = shared.value.scores(*raw_slices(batch.column(body))) >= threshold
            yield batch.select(columns).filter(pa.array(good))

    return docs.withColumn(body, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).mapInArrow(work, docs.schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(documents(spark, sf_dir), labels).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
