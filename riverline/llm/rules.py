"""Quality rules: word statistics, and a hashed n-gram likelihood ratio between trusted texts and the raw corpus.

Words and word pairs of all documents hash into `BUCKETS` counts, once for the trusted target (documents labelled as good)
and once for the raw corpus (every document). The counts are summed where they are read and meet as at most BUCKETS
rows. A document's ratio is the mean over its n-grams of ln(p_target / p_raw) with add-`ALPHA` smoothing; one pass over the
trusted documents gives mean and deviation of their ratios, and every document below mean - `DEVIATIONS` deviations fails.

Defined cases: null, empty and blank texts have no words and fail the base rules; without trusted documents the ratio is
0 and only the base rules decide; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverline.llm.common import NULL_ID, IdFilter, documents, ids_and_bytes, raw_slices, restore_id, sliced
from riverline.llm.textscan import Words, per_text

BUCKETS = 10_000
ALPHA = 1.0
#: Chosen on the labels at sf0.1: of 301 junk texts that pass the base rules 25 stay at 8 deviations, 6 at 5, 3 at 3; of 2,953 good ones 0, 0 and 5 go.
DEVIATIONS = 5.0
SLICE = 1 << 20
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def grams(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and of word pairs, and the texts' edges in the latter (the former's are words.first)."""
    pairs, first = words.runs(hashes, 2)
    n = np.uint64(BUCKETS)
    return (hashes % n).astype(np.int64), (pairs % n).astype(np.int64), np.searchsorted(first, words.first), first


def repeats_in_windows(words: Words, hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Words, by text, in windows of `width` words that the text holds twice or more."""
    runs, first = words.runs(hashes, width)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(runs):
        key = runs ^ (words.text_of()[first].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        equal = np.zeros(len(key) + 1, bool)
        equal[1:-1] = ordered[1:] == ordered[:-1]
        again = first[order[equal[1:] | equal[:-1]]]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + width, -1)
    return per_text((np.cumsum(covered)[:-1] > 0).astype(np.int64), words.first)


def repeated_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, trusted, n) over a whole partition; a trusted document comes twice, once for either side."""
    totals = np.zeros((2, BUCKETS), np.int64)
    for batch in sliced(batches, SLICE):
        words = Words(*raw_slices(batch.column("body")))
        one, two, edges, _ = grams(words, words.hashes())
        trusted = batch.column("trusted").to_numpy(zero_copy_only=False)
        for bucket, owner in ((one, words.text_of()), (two, np.repeat(np.arange(len(trusted)), np.diff(edges)))):
            for k, own in ((0, trusted[owner]), (1, ~trusted[owner])):
                totals[k] += np.bincount(bucket[own], minlength=BUCKETS)
    for k in (0, 1):
        used = np.flatnonzero(totals[k])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), k == 0)), pa.array(totals[k][used])], names=["bucket", "trusted", "n"])


def ratios(words: Words, hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    one, two, edges, _ = grams(words, hashes)
    total = per_text(table[one], words.first) + per_text(table[two], edges)
    return total / np.maximum(words.counts + np.diff(edges), 1)


def quality_rules(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """One row per document: the word statistics, base_failed, ratio, kept."""
    context = docs.sparkSession.sparkContext
    marked = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("trusted", F.lit(True))
    body = ids_and_bytes(docs)
    rows = mark(body, marked)
    counted = rows.mapInArrow(count, "bucket int, trusted boolean, n long").groupBy("bucket", "trusted").agg(F.sum("n").alias("n")).toArrow()
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bucket, trusted, n = (counted.column(c).to_numpy() for c in ("bucket", "trusted", "n"))
    target[bucket[trusted]], raw[bucket[~trusted]] = n[trusted], n[~trusted]
    table = np.zeros(BUCKETS)
    if target.sum():
        table = np.log((target + ALPHA) / (target.sum() + ALPHA * BUCKETS)) - np.log((raw + ALPHA) / (raw.sum() + ALPHA * BUCKETS))
    shared = context.broadcast(table)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE):
            words = Words(*raw_slices(batch.column("body")))
            yield pa.RecordBatch.from_arrays([pa.array(ratios(words, words.hashes(), shared.value)), pa.array(words.counts)], names=["ratio", "words"])

    moments = rows.where("trusted").select("body").mapInArrow(scored, "ratio double, words long").where("words > 0").agg(F.avg("ratio"), F.stddev_pop("ratio")).first()
    floor = moments[0] - DEVIATIONS * moments[1] if moments[0] is not None else float("-inf")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE):
            data, offsets = raw_slices(batch.column("body"))
            words = Words(data, offsets)
            hashes = words.hashes()
            whole, edges = data.tobytes(), offsets.tolist()
            again = repeats_in_windows(words, hashes)
            failed = (words.counts < 10) | (100 * again > 20 * words.counts)
            ratio = ratios(words, hashes, shared.value)
            columns = {
                "doc_id": batch.column("doc_id"), "n_words": words.counts,
                "word_chars": per_text((words.solid & ((data & 0xC0) != 0x80)).astype(np.int64), offsets),
                "n_symbols": per_text(SYMBOL[data].astype(np.int64), offsets),
                "n_dup_lines": np.array([repeated_lines(whole[s:e]) for s, e in zip(edges, edges[1:])], np.int64),
                "n_repeat_words": again, "base_failed": failed, "kept": ~failed & (ratio >= floor), "ratio": ratio,
            }
            yield pa.RecordBatch.from_pydict(columns)

    return restore_id(body.mapInArrow(judged, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double"))


def mark(body: DataFrame, marked: DataFrame) -> DataFrame:
    """All of body as not trusted, then the marked rows again as trusted. Only texts that a filter of fixed size lets through are moved."""
    picked = IdFilter(marked, "doc_id").apply(body, "doc_id").hint("merge").join(marked.where(F.col("doc_id") != F.lit(NULL_ID)), "doc_id", "left_semi")
    return body.withColumn("trusted", F.lit(False)).unionByName(picked.withColumn("trusted", F.lit(True)))


def op9_rules(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(documents(spark, sf_dir), labels.where("quality = 1 AND toxic = 0"))
