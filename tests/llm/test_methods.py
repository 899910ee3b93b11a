"""What single steps of the operators do, at sizes and in groups that the tables of test_operators don't have."""

import collections
import hashlib
import math
import os
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from riverline.llm import common, exact_dedup, line_dedup, near_copies, quality, simhash, suffix_dedup, toxicity
from riverline.llm.components import components

WORDS = "the and river water under bridge stone light of in on long old new grey".split()


def test_refine_beyond_eight_megabytes():
    rng = np.random.default_rng(3)
    windows = rng.integers(97, 123, (190_000, suffix_dedup.LENGTH), dtype=np.uint8)
    windows[100_000:110_000] = windows[:10_000]
    starts = np.arange(len(windows)) * suffix_dedup.LENGTH
    found = suffix_dedup.refine(windows.reshape(-1), starts)
    distinct, inverse = np.unique(windows.view(f"S{suffix_dedup.LENGTH}").reshape(-1), return_inverse=True)
    assert len(np.unique(found)) == len(distinct)
    assert len(set(zip(found.tolist(), inverse.reshape(-1).tolist()))) == len(distinct)


@pytest.mark.parametrize("bits", [40, 56])
def test_keys_survive_their_packing(bits):
    keys = np.random.default_rng(1).integers(0, 1 << bits, 1000, dtype=np.uint64)
    for k in (keys, np.sort(keys), keys[:0], keys[:1], np.zeros(3, np.uint64)):
        assert np.array_equal(suffix_dedup.full(suffix_dedup.short(k)), k)
    parts = [(p, np.sort(keys)[s]) for p, s in suffix_dedup.split(np.sort(keys), 7, bits)]
    assert np.array_equal(np.concatenate([k for _, k in parts]), np.sort(keys)) and [p for p, _ in parts] == list(range(7))


def test_anchors_with_contexts_in_many_groups_are_split():
    """20 contexts in each of 20 groups are few in each and many in all."""
    key = np.array([5], np.uint64)
    row = lambda g, kinds: (0, g, suffix_dedup.short(key), suffix_dedup.packed(np.array([kinds], np.uint8).tobytes()))
    many = suffix_dedup.shared_keys(suffix_dedup.table_of(suffix_dedup.KEYS, [row(g, 20) for g in range(20)])).to_pylist()
    few = suffix_dedup.shared_keys(suffix_dedup.table_of(suffix_dedup.KEYS, [row(g, 20) for g in range(3)])).to_pylist()
    assert [len(suffix_dedup.full(r["hot"])) for r in many] == [1] * 20 and [len(suffix_dedup.full(r["hot"])) for r in few] == [0] * 3


def test_passages_that_many_documents_share(spark):
    rng = random.Random(2)
    passage = " ".join(rng.choice(WORDS) for _ in range(40))
    rows = [(k, f"{' '.join(rng.choice(WORDS) for _ in range(8))} {k} {passage} {k * k} {' '.join(rng.choice(WORDS) for _ in range(8))}") for k in range(500)]
    first: dict[bytes, int] = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50].encode(), i)
    want = {}
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50].encode()] < i:
                gone[p : p + 50] = b"\1" * 50
        want[i] = hashlib.sha256(bytes(x for x, g in zip(t.encode(), gone) if not g)).hexdigest()
    assert {r.doc_id: r.kept_sha256 for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_repeated_and_null_ids_do_not_multiply(spark):
    rows = [(None, f"text {k % 7}") for k in range(400)] + [(5, "text 1")] * 300 + [(5, "other")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = exact_dedup.exact_dedup(docs, memtable_bytes=500, shards=3).collect()
    sizes = collections.Counter(t for _, t in rows)
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(sizes)
    assert collections.Counter(r.group_size for r in found) == collections.Counter(sizes[t] for _, t in rows)


def test_line_dedup_equals_its_sql(spark):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))
    often = ["Licensed under CC BY-NC 4.0.", "And ornd.", "Page {} of 99, printed by Anna", "the old river was long and {} stones were grey in it", ""]
    rows = [(k, None if k == 7 else "\n".join(rng.choice(often).format(k) if rng.random() < 0.6 else line() for _ in range(rng.randint(0, 9)))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.line_dedup(docs)
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})  # noqa: F841
    want = duckdb.sql(line_dedup.OP7_SQL).fetchall()
    got = [(r.doc_id, r.text, r["__lines"], r["__dropped"]) for r in found.collect()]
    assert sorted(got) == sorted(want) and sum(r[3] for r in got) > 100
    assert sum("Licensed under" in r[1] for r in got) == 1 and sum("And ornd." in r[1] for r in got) == 1


def test_line_dedup_keeps_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, 8), (2, "", 9, None)], "doc_id long, text string, `__LINES` int, `__dropped` int")
    found = line_dedup.line_dedup(docs)
    before, dropped = line_dedup.counters(docs)
    assert found.columns == [*docs.columns, before, dropped]
    assert sorted((r.doc_id, r["__LINES"]) for r in found.select("doc_id", "`__LINES`").collect()) == [(1, 7), (2, 9)]
    assert common.fresh(docs, "__Lines") not in docs.columns


def classes(ids, near):
    """Least id reachable over near(a, b)."""
    found = {}
    for i in sorted(ids):
        if i in found:
            continue
        stack = [i]
        while stack:
            a = stack.pop()
            if a not in found:
                found[a] = i
                stack += [b for b in ids if b not in found and near(a, b)]
    return found


@pytest.mark.parametrize("most", [3, near_copies.MOST])
def test_near_copies_against_all_pairs(spark, most):
    """Recall against brute force over real documents; chunks of few texts change nothing."""
    d = "/root/testdata/sf0.01/documents.parquet"
    rows = pq.read_table(d, columns=["doc_id", "text"]).to_pylist()
    sets = {}
    for r in rows:
        w = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s or [()]:
            holders[x].append(i)
    mates = collections.defaultdict(collections.Counter)
    for group in holders.values():
        for i in group:
            mates[i].update(group)
    near = lambda a, b: mates[a][b] > 0 and (sets[a] == sets[b] or mates[a][b] >= 0.8 * (len(sets[a]) + len(sets[b]) - mates[a][b]))
    links = [(a, b) for a in sets for b in mates[a] if a < b and near(a, b)]
    found = {r.doc_id: r.component_id for r in near_copies.near_copy_groups(spark.read.parquet(d), most=most).collect()}
    caught = sum(found[a] == found[b] for a, b in links)
    assert len(links) > 50 and caught >= 0.99 * len(links)
    linked = {i for pair in links for i in pair}
    assert all(found[i] == i for i in sets if i not in linked)


@pytest.mark.parametrize("members", [100, 40])
def test_groups_of_blocks_find_all_links(spark, members):
    """More points than the tree's shards hold: the blocks' groups find the same classes."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    far = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in np.repeat(centres[:90], 20)]
    v = np.array(sorted({*centres.tolist(), *far}), np.uint64)
    nodes = spark.createDataFrame([(int(p.astype(np.int64)), k) for k, p in enumerate(v)], "fp long, node long")
    forest = simhash.Forest(len(v))
    forest.link(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3))
    want = {k: int(c) for k, c in enumerate(forest.roots(np.arange(len(v)))) if c != k}
    assert {r.node: r.component for r in components(simhash.near_links(nodes, members_per_shard=members, leaves=8)).collect()} == want


def test_quality_features_and_gradient():
    texts = [b"", b"abc", b"the the river river runs the", "é à zug zug".encode(), b"a b a b a b"]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    groups = quality.features(data, offsets)
    for i, t in enumerate(texts):
        w = t.split()
        counts = [len(w), max(0, len(w) - 1), sum(a == b for a, b in zip(w, w[1:])), sum(w[k] in w[max(0, k - 3) : k] for k in range(len(w)))]
        assert [hi[i] - lo[i] for _, lo, hi in groups[0]] == counts
        for k, (f, lo, hi) in enumerate(groups[1]):
            n = 3 + k
            factor = (0x9E3779B1, 0x85EBCA6B)[k]
            grams = [int.from_bytes(t[j : j + n], "little") * factor % 2**32 >> 16 for j in range(len(t) - n + 1)]
            assert f[lo[i] : hi[i]].tolist() == grams
        words = groups[0][0]
        assert len(set(words[0][words[1][i] : words[2][i]].tolist())) == len(set(w))

    rng = np.random.default_rng(2)
    rows, out, own, share = rng.normal(size=(4, 3)), rng.normal(size=(3, 2)), rng.normal(size=2), rng.random(4)

    def loss(r, o, b):
        z = share @ r @ o + b
        return math.log(np.exp(z).sum()) - z[1]

    for k, (value, slope) in enumerate(zip((rows, out, own), quality.gradients(rows, out, own, 1, share))):
        for at in np.ndindex(value.shape):
            up, down = ([x.copy() for x in (rows, out, own)] for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(*up) - loss(*down)) / 2e-5 - slope[at]) < 1e-6


def test_quality_training_is_bounded_and_repeatable(spark):
    rows = [(k, ("good words here " if k % 2 else "## junk $$ ") * 30) for k in range(60)]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] * 2 + [(None, 1), (3, None), (3, 7)], "doc_id long, quality int")
    models = [quality.train(docs, labels, "quality", lambda i: i >= 0, 40) for _ in range(2)]
    assert models[0].rows == 40 and models[0].bias == models[1].bias and np.array_equal(models[0].table, models[1].table)
    assert 0 < quality.train(docs, labels, "quality", lambda i: i >= 0, 40, sample_bytes=4000).rows < 40


def test_toxicity_learning_and_calibration():
    rng = random.Random(4)
    bad = ["vile", "awful", "hate"]
    rows = [(k % 3 == 0, " ".join(rng.choice(WORDS + bad * 3 if k % 3 == 0 else WORDS) for _ in range(rng.randint(5, 40))).encode()) for k in range(300)]
    rows = [(int(y), b) for y, b in rows]
    model = toxicity.learn(rows)
    counts = [collections.Counter(p for y, b in rows if y == k for w in set(b.split()) for p in toxicity.chain(toxicity.token(w))) for k in (0, 1)]
    sizes = [sum(len(set(b.split())) for y, b in rows if y == k) for k in (0, 1)]
    means = {}
    for part in sorted(set(counts[0]) | set(counts[1]), key=lambda p: (p.endswith("$"), len(p))):
        body = part.rstrip("$")
        shorter = [body[:n] for n in toxicity.STARTS if n < len(body)]
        mean = means[shorter[-1]] if shorter else sizes[1] / sum(sizes)
        a, b = counts[1][part] + 4 * mean, counts[0][part] + 4 * (1 - mean)
        means[part] = a / (a + b)
        value = math.log(a / b) - math.log(sizes[1] / sizes[0])
        shrunk = math.copysign(max(0.0, abs(value) - 2 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))), value)
        assert abs(model.odds[part] - max(-8, min(8, shrunk))) < 1e-9
    clean = np.concatenate([model.scores(b) for y, b in rows if not y])
    if 0.06 < model.lam < 4.9:
        assert abs(np.exp(model.lam * clean).mean() - 1) < 0.05
    for _, b in rows[:60]:  # evidence by its definition, over the significant ones among all maximal segments
        s = model.scores(b)
        floor = math.log(model.k * len(s) / model.significant) / model.lam
        best, total = 0.0, 0.0
        for r, x in enumerate(sorted((x[0] for x in toxicity.segments(s) if x[0] >= floor), reverse=True), 1):
            total += model.lam * x - math.log(model.k * len(s))
            if total > 0:
                best = max(best, total if r == 1 else total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        assert abs(model.evidence(b)[0] - best) < 1e-9
    assert all((model.probability(model.evidence(b)[0]) >= 0.5) == bool(y) for y, b in rows if len(b.split()) > 12)


def test_segments_come_with_their_places():
    rng = np.random.default_rng(1)
    for _ in range(100):
        scores = rng.integers(-4, 4, 30).astype(float)
        for s, b, e in toxicity.segments(scores):
            assert s == scores[b:e].sum() > 0 and all(scores[b:k].sum() > 0 for k in range(b + 1, e + 1)) and all(scores[k:e].sum() > 0 for k in range(b, e))


def test_no_folder_of_one_machine_on_a_cluster():
    class Session:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_durable_tables_go_when_discarded(spark):
    kept = common.durable(spark.range(5), "test")
    path = kept._durable_path.removeprefix("file://")
    assert os.path.isdir(path) and kept.count() == 5
    common.discard(kept)
    assert not os.path.exists(path)


def test_texts_of_a_key_that_share_little_are_not_all_compared():
    """A key of one common passage: the classes of brute force, in time that does not grow with the square of the texts."""
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 2**32, 60, dtype=np.uint64) for _ in range(40)]
    sets = [np.unique(np.append(rng.choice(b, rng.integers(50, 61), replace=False), 7).astype("<u4")) for b in base for _ in range(3)]
    links = near_copies.links_of(np.arange(len(sets)), [s.tobytes() for s in sets], 0.8)
    similar = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
    near = np.array([[similar(a, b) for b in sets] for a in sets])
    want, found = simhash.Forest(len(sets)), simhash.Forest(len(sets))
    want.link(*np.nonzero(near))
    found.link(*np.array(links).T)
    every = np.arange(len(sets))
    assert near.sum() > 2 * len(sets) > near.diagonal().sum() and all(near[u, v] for u, v in links)
    assert found.roots(every).tolist() == want.roots(every).tolist()
    many = [np.unique(np.append(rng.integers(0, 2**32, 100, dtype=np.uint64), 7).astype("<u4")).tobytes() for _ in range(6000)]
    began = time.process_time()
    assert near_copies.links_of(np.arange(6000), [*many[:-1], many[0]], 0.8) in ([(0, 5999)], [(5999, 0)])
    assert time.process_time() - began < 6


def test_near_copies_are_linked_by_fingerprints_first(spark):
    """Copies whose fingerprints differ in three bits at most are linked by the trees' classes alone, if their shingles agree."""
    rng, texts = random.Random(21), []
    for _ in range(40):
        base = [f"w{rng.randrange(10**7)}" for _ in range(300)]
        texts += [" ".join(base), " ".join([*base[:-1], "end"])]
    texts += [" ".join(["alike"] * k) for k in (5, 6)]  # one set of shingles
    points, nodes = near_copies.points_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5)
    got = {frozenset((r.u, r.v)) for r in near_copies.fingerprint_links(points, nodes, 0.8).collect()}
    fp = [simhash.fingerprint(t.encode(), 5) for t in texts]
    want = {frozenset((k, k + 1)) for k in range(0, 80, 2) if (fp[k] ^ fp[k + 1]).bit_count() <= 3}
    assert len(want) > 20 and got == want and nodes.count() == 81
    assert near_copies.fingerprint_links(points, nodes, 0.999).count() == 0
