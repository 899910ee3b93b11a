"""Toxicity by maximum-scoring segments.

Training counts words of labelled documents by class and gives each word, and each word start of 3, 4 and 5 characters,
a log-odds whose Dirichlet prior is centred on the next shorter start (the root prior on the classes' sizes), so a word
never seen takes the odds of its longest known start. Counts are of documents, odds shrink by `caution` standard errors,
and a word counts in favour once per text, so mere repetition proves nothing. Scoring is a linear-time scan: of the running sums of
log-odds less a drift, every maximal segment is found in one pass. Segment scores get an extreme-value calibration:
lambda solves E[exp(lambda * score)] = 1 over words of clean documents, K is fitted on their segments, and a segment of
score S in n words has E-value K * n * exp(-lambda * S). The significant ones of a document are combined by the sum
statistic, and one logistic step turns the result into a score between 0 and 1.

Training uses at most `sample_rows` labelled rows (those whose hashed ids come first, as far as their texts fit `sample_bytes`
together); all it keeps is bounded by them. Everything that scores reads whole texts.

Defined cases: a text without words (null, empty, blank) has no segment and gets the score of a clean text; without
labels of both classes every score is 0; repeated rows get equal scores, and of repeated rows of an id the least text trains.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverline.llm.common import NULL_ID, documents, id_remainder, ids_and_bytes, raw_slices, restore_id

STARTS = (3, 4, 5)
EDGES = b".,;:!?\"'()[]{}<>*#$%&-_/\\"
CACHE = 200_000


def token(word: bytes) -> str:
    return word.strip(EDGES).decode("utf-8", "replace")


def chain(word: str) -> list[str]:
    """The word's starts, shortest first, then the word itself (marked, so that it differs from a start)."""
    return [word[:n] for n in STARTS if len(word) > n] + [word + "$"] if word else []


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) in one pass (Ruzzo and Tompa 1999).

    Only words with a positive score start a candidate, so runs of negative words are crossed by prefix sums.
    """
    if not len(scores):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=float)])
    up = scores > 0
    begins = np.flatnonzero(up & ~np.concatenate([[False], up[:-1]])).tolist()
    ends = (np.flatnonzero(up & ~np.concatenate([up[1:], [False]])) + 1).tolist()
    stack: list[list] = []  # [start, end, sum before, sum after, place of the nearest candidate with a smaller sum before]
    for b, e in zip(begins, ends):
        left, right = float(total[b]), float(total[e])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([b, e, left, right, j])
                break
            b, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s[3] - s[2], s[0], s[1]) for s in stack]


class Model:
    def __init__(self, odds: dict[str, float], root: float, drift: float):
        self.odds, self.root, self.drift = odds, root, drift
        self.lam, self.k, self.slope, self.offset, self.significant = 1.0, 1.0, 1.0, -1.0, 0.05
        self.cache: dict[bytes, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def word(self, word: bytes) -> float:
        value = self.root
        for part in chain(token(word)):
            value = self.odds.get(part, value)
        return value - self.drift

    def scores(self, body: bytes) -> np.ndarray:
        words = body.lower().split()
        if len(self.cache) > CACHE:
            self.cache = {}
        cache = self.cache
        out = []
        for w in words:
            s = cache.get(w)
            if s is None:
                s = cache[w] = self.word(w)
            out.append(s)
        scores, seen = np.array(out), set()
        for i in np.flatnonzero(scores > 0).tolist():
            if words[i] in seen:
                scores[i] = -self.drift
            seen.add(words[i])
        return scores

    def passages(self, body: bytes) -> tuple[list[tuple[float, int, int]], int]:
        """The significant segments, best first, and the number of words."""
        scores = self.scores(body)
        floor = np.log(self.k * max(len(scores), 1) / self.significant) / self.lam
        return sorted((s for s in segments(scores) if s[0] >= floor), reverse=True), len(scores)

    def evidence(self, body: bytes) -> tuple[float, list[tuple[float, int, int]]]:
        """-ln of the least p-value over sums of the r best significant segments (0 if there is none), and those segments."""
        found, n = self.passages(body)
        total, best = 0.0, 0.0
        for r, (s, _, _) in enumerate(found, 1):
            total += self.lam * s - np.log(self.k * n)
            if total > 0:
                tail = total - (r - 1) * np.log(total) + lgamma(r + 1) + lgamma(r) if r > 1 else total
                best = max(best, tail)
        return best, found

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.offset, -40, 40))))


def learn(rows: list[tuple[int, bytes]], prior: float = 4.0, drift: float = 0.7, caution: float = 2.0) -> Model | None:
    """rows: (label, text). None without both classes."""
    kinds = Counter(y for y, _ in rows)
    if len(kinds) < 2:
        return None
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for y, body in rows:
        counts[y].update(set(body.lower().split()))
    parts: tuple[Counter, Counter] = (Counter(), Counter())
    for y in (0, 1):
        for w, n in counts[y].items():
            for part in chain(token(w)):
                parts[y][part] += n
    sizes = [max(1, sum(c.values())) for c in counts]
    share = sizes[1] / (sizes[0] + sizes[1])
    base = np.log(sizes[1] / sizes[0])
    odds: dict[str, float] = {}
    means: dict[str, float] = {}
    for part in sorted(set(parts[0]) | set(parts[1]), key=lambda p: (p.endswith("$"), len(p))):
        body = part[:-1] if part.endswith("$") else part
        longest = [body[:n] for n in STARTS if n < len(body)]
        mean = means[longest[-1]] if longest else share
        a, b = parts[1][part] + prior * mean, parts[0][part] + prior * (1 - mean)
        means[part] = a / (a + b)
        doubt = caution * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        value = np.log(a / b) - base
        odds[part] = float(np.clip(np.sign(value) * max(0.0, abs(value) - doubt), -8, 8))
    model = Model(odds, 0.0, drift)

    clean = [(b, model.scores(b)) for y, b in rows if not y]
    every = np.concatenate([s for _, s in clean] or [np.zeros(0)])
    values, times = np.unique(np.round(every, 3), return_counts=True)
    low, high = 1e-3, 20.0
    if len(values) and values.max() > 0 and every.mean() < 0:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (times * np.exp(np.minimum(mid * values, 600))).sum() < times.sum() else (low, mid)
    model.lam = float(np.clip((low + high) / 2, 0.05, 5.0))
    found = [s[0] for _, x in clean for s in segments(x)]
    if found:
        at = max(1e-3, float(np.quantile(found, 0.9)))
        model.k = float(np.clip((np.array(found) >= at).sum() * np.exp(model.lam * at) / max(len(every), 1), 1e-6, 1e6))
    x = np.array([np.log1p(model.evidence(b)[0]) for _, b in rows])
    y = np.array([v for v, _ in rows], float)
    w = np.zeros(2)
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):  # Newton steps on the logistic likelihood with a small ridge
        p = 1 / (1 + np.exp(-design @ w))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(w[0]), float(w[1])
    return model


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_bytes: int) -> list[tuple[int, bytes]]:
    """Training rows: the labelled rows with the first hashed ids, whole texts, as far as `sample_bytes` hold them together."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    chosen = chosen.where(id_remainder(F.col("doc_id"), 5) != 0).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    rows = ids_and_bytes(docs).where(F.col("doc_id") != F.lit(NULL_ID)).join(F.broadcast(chosen), "doc_id")  # sample_rows rows at most
    rows = rows.groupBy("doc_id", "label").agg(F.min("body").alias("body"))
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "label").rowsBetween(Window.unboundedPreceding, 0)  # sample_rows rows at most
    rows = rows.withColumn("held", F.sum(F.octet_length("body")).over(so_far)).where(F.col("held") <= sample_bytes)
    found = rows.select("doc_id", "label", "body").toArrow()
    return [(y, b) for _, y, b in sorted(zip(*(found.column(c).to_pylist() for c in ("doc_id", "label", "body"))))]


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, sample_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, held_out, score, passages, best_start, best_words: the significant passages' number and the best one's place in words.

    Rows with crc32(doc_id) mod 5 = 0 are held out. No text is cut, in training or in scoring.
    """
    model = learn(sample(docs, labels, sample_rows, sample_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = raw_slices(batch.column("body"))
            whole, edges = data.tobytes(), offsets.tolist()
            out: list[tuple] = []
            for s, e in zip(edges, edges[1:]):
                if model is None:
                    out.append((0.0, 0, None, None))
                    continue
                evidence, found = model.evidence(whole[s:e])
                out.append((model.probability(evidence), len(found), *((found[0][1], found[0][2] - found[0][1]) if found else (None, None))))
            score, n, start, words = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(words, pa.int64())], names=["doc_id", "score", "passages", "best_start", "best_words"])

    out = ids_and_bytes(docs).mapInArrow(work, "doc_id long, score double, passages int, best_start long, best_words long")
    return restore_id(out.withColumn("held_out", id_remainder(F.col("doc_id"), 5) == 0))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    found = toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages", "best_start", "best_words")
