"""Each operator against a brute-force version on awkward rows, and on an empty table."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riverline.llm import exact_dedup, lattice_lm, line_dedup, near_copies, packing, quality, rules, simhash, suffix_dedup, toxicity, word_bpe
from riverline.llm.components import components

SCHEMA = "doc_id long, text string, lang string, key long, g int, __id int, shard string"
WORDS = "the and river water under bridge stone light of in on à été Zug schön".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    shared = "This passage stands in a great many of the documents, word for word, 1234. " + sentence(rng, 12)
    texts = [None, "", " \n\t ", "one", "two words", "x" * 9000, "ab " * 3000, shared, shared, shared + " " + sentence(rng, 30)]
    texts += [sentence(rng, rng.randint(1, 200)) for _ in range(20)]
    texts += [sentence(rng, 40) + "\n" + f"Page {k} of 99, printed by Anna" + "\n" + shared + "\n" + sentence(rng, 15) for k in range(14)]
    base = sentence(rng, 150)
    texts += [base, base, base + " end", "new " + base, base.replace("river", "rivers", 1), base.upper()]
    texts += ["ERER!! ED!! " * 30, "a### b*** c$$$ " * 30, "日本語 テキスト <|endoftext|> end", "é" * 60 + "e" + "é" * 60, "é" * 130]
    texts += [sentence(rng, 25_000), "noblanksatall" * 3000]
    out = [(k, t, "en", k % 3, k % 2, 1, "s") for k, t in enumerate(texts)]
    return [*out, out[7], (None, "no id here", None, None, None, None, None), (None, shared, "en", 1, 1, 1, "s")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int("!!" not in (r[1] or "") and "###" not in (r[1] or "")), int("bridge" in (r[1] or ""))) for r in rows], "doc_id long, quality int, toxic int")


def ident(i):
    return -math.inf if i is None else i


def same(got, want):
    assert collections.Counter(got) == collections.Counter(want)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda b: hashlib.sha256(b[:1]).digest()])
def test_exact_dedup(docs, rows, keep, digest):
    unique = docs.dropDuplicates(["doc_id", "text"]) if digest is not exact_dedup.sha256 else docs
    kept = {(r[0], r[1]) for r in rows} if digest is not exact_dedup.sha256 else rows
    texts = [(r[0], r[1] or "") for r in kept]
    if digest is not exact_dedup.sha256:  # a weak digest collides: bytes must decide, and ids must be unique
        unique, texts = unique.where("doc_id IS NOT NULL"), [t for t in texts if t[0] is not None]
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[t].append(i)
    found = exact_dedup.exact_dedup(unique, keep=keep, memtable_bytes=2000, shards=5, digest=digest).collect()
    pick = max if keep == "largest" else min
    same([(r.doc_id, r.keep_id, r.group_size) for r in found], [(i, pick(groups[t], key=ident), len(groups[t])) for i, t in texts])
    assert sum(r.kept for r in found) == len(groups)


def test_suffix_dedup(docs, rows):
    texts = [(ident(r[0]), (r[1] or "").encode()) for r in rows]
    first = {}
    for i, b in sorted(texts):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    want = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        want.append((None if i == -math.inf else i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    same([tuple(r) for r in suffix_dedup.suffix_dedup(docs).collect()], want)
    cleaned = suffix_dedup.removed_repeats(docs)
    assert cleaned.schema == docs.schema and cleaned.count() == len(rows)


def test_simhash(docs, rows):
    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    prints = [(r[0], fp(r[1])) for r in rows]
    component = {}
    ids = sorted(range(len(prints)), key=lambda k: ident(prints[k][0]))
    for k in ids:
        if k in component:
            continue
        stack = [k]
        while stack:
            a = stack.pop()
            if a not in component:
                component[a] = prints[k][0]
                stack += [b for b in ids if (prints[a][1] ^ prints[b][1]).bit_count() <= 3]
    found = simhash.simhash_components(docs).collect()
    same([(r.doc_id, r.fp % 2**64, r.component_id) for r in found], [(*prints[k], component[k]) for k in range(len(rows))])


def test_vantage_trees_find_all_links(spark):
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 2**63, 300, dtype=np.uint64)
    points = [int(c) for c in centres] + [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in np.repeat(centres[:60], 20)]
    points = sorted(set(points))
    nodes = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p, k) for k, p in enumerate(points)], "fp long, node long")
    v = np.array(points, np.uint64)
    forest = simhash.Forest(len(v))
    forest.link(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3))
    want = {k: int(c) for k, c in enumerate(forest.roots(np.arange(len(v)))) if c != k}
    links = simhash.near_links(nodes, members_per_shard=100)
    assert {r.node: r.component for r in components(links).collect()} == want


def test_near_copies(docs, rows):
    got = near_copies.near_dedup(docs)
    assert got.columns == docs.columns
    texts = [r.text for r in got.collect()]
    base = rows[44][1]
    assert base in texts and base + " end" not in texts and "new " + base not in texts
    assert texts.count("one") == 1 and texts.count("two words") == 1


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_of_an_original_with_the_largest_id(spark):
    rng = random.Random(11)
    original = [f"w{rng.randrange(10**6)}" for _ in range(104)]
    copies = []
    for k in range(6):
        words = list(original)
        for at in (5 + 16 * k, 10 + 16 * k):
            words[at] = f"other{k}x{at}"
        copies.append(" ".join(words))
    texts = [*copies, " ".join(original)]
    sets = [shingles(t) for t in texts]
    near = lambda a, b: len(a & b) / len(a | b) >= 0.8
    assert all(near(sets[6], s) for s in sets[:6]) and not any(near(a, b) for k, a in enumerate(sets[:6]) for b in sets[:k])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in near_copies.near_copy_groups(docs).collect()} == {0}


def test_near_copies_decide_long_texts_on_all_shingles(spark):
    rng, texts, want = random.Random(12), [], []
    for k, gaps in enumerate([22] * 15 + [23] * 15):  # 1,000 shingles, of which each gap changes 5: 0.802 or 0.794
        base = [f"w{rng.randrange(10**7)}" for _ in range(1004)]
        copy = list(base)
        for at in rng.sample(range(10, 990, 12), gaps):
            copy[at] = f"x{rng.randrange(10**7)}"
        a, b = shingles(" ".join(base)), shingles(" ".join(copy))
        want.append(len(a & b) / len(a | b) >= 0.8)
        texts += [" ".join(base), " ".join(copy)]
    assert want == [True] * 15 + [False] * 15
    found = {r.doc_id: r.component_id for r in near_copies.near_copy_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[2 * k + 1] == 2 * k for k in range(30)] == want


def test_lattice_lm(docs, rows):
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [b""]) for r in rows]
    text = lambda i: "" if i is None else str(i)
    counts = collections.Counter(w for i, t in tokens for w in t if zlib.crc32(text(i).encode()) % 7 != 2)
    n, v = sum(counts.values()), len(counts)
    file = public_tokenizers.path("piece_bpe_32k.model")
    found = lattice_lm.lm_scores(docs, file, shards=3).collect()
    want = [(i, zlib.crc32(text(i).encode()) % 7 == 2, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 4)) for i, t in tokens]
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found], want)

    lattice = lattice_lm.Lattice(file)
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = once / (once + 2 * twice)

    @functools.cache
    def inside(word):
        """Sum over all segmentations, from the end backwards."""
        t = lattice_lm.START + word
        tail = [0.0] * len(t) + [lattice_lm.WORD_END]
        for i in range(len(t) - 1, -1, -1):
            arcs = lattice.arcs[i > 0]
            tail[i] = math.fsum(math.exp(arcs[t[i:j]]) * tail[j] for j in range(i + 1, min(len(t), i + 80) + 1) if t[i:j] in arcs)
        return tail[0]

    def chance(w):
        lower = 0.0 if not w else inside(w)
        return (max(counts[w] - discount, 0) + discount * v * lower) / n

    wants = collections.Counter((i, round(sum(math.log10(chance(w)) for w in t), 2)) for i, t in tokens if all(len(w) < 100 for w in t))
    got = collections.Counter((r.doc_id, round(r.score, 2)) for r in found if r.doc_id is None or all(len(w) < 100 for w in (rows[r.doc_id][1] or "").split()))
    assert sum(abs(a[1] - b[1]) > 0.02 or a[0] != b[0] for a, b in zip(sorted(wants.elements(), key=str), sorted(got.elements(), key=str))) == 0
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)


def test_lattice_keeps_pieces_with_other_capitals():
    lattice = lattice_lm.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    assert any(p.decode("utf-8", "ignore").lower() != p.decode("utf-8", "ignore") for arcs in lattice.arcs for p in arcs)


def test_lattice_sums_over_all_segmentations():
    lattice = lattice_lm.Lattice(public_tokenizers.path("piece_bpe_32k.model"))

    def brute(text, at=0):
        if at == len(text):
            return 1.0
        arcs = lattice.arcs[at > 0]
        return sum(math.exp(arcs[text[at:j]]) * brute(text, j) for j in range(at + 1, len(text) + 1) if text[at:j] in arcs)

    for word in (b"the", b"water", "été".encode(), b"zq"):
        assert abs(lattice.word(word) - math.log(brute(lattice_lm.START + word) * lattice_lm.WORD_END)) < 1e-9
    for k in (0, 1):
        assert sum(math.exp(x) for x in lattice.arcs[k].values()) <= 1 + 1e-9


def test_line_dedup(docs, rows):
    got = line_dedup.line_dedup(docs)
    assert got.columns == [*docs.columns, "__lines", "__dropped"]
    same([(r.doc_id, r.key, r["__id"]) for r in got.select(*docs.columns).collect()], [(r[0], r[3], r[5]) for r in rows])
    pages = [r for r in got.collect() if r.text and "Page" in r.text]
    assert [r.doc_id for r in pages] == [30]  # the first document with the template keeps its line
    assert all(a[1] is None or r.text == a[1] for r in got.where("doc_id IN (3, 4, 5)").collect() for a in rows if a[0] == r.doc_id)


def check_pieces(got, texts):
    """Each id of each text in exactly one piece; sequences gapless from 0; little padding."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = collections.defaultdict(list)
    for i, t in texts:
        ids[i].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    spans = collections.defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(spans) == set(ids)
    for i, texts_of_id in ids.items():
        left = sorted(spans[i])
        for own in sorted(texts_of_id, key=len, reverse=True):  # rows that share an id take the pieces that fit
            at = 0
            while at < len(own):
                fit = next(p for p in left if p[0] == at and p[3] == len(own) and p[2] == zlib.crc32(own[at : at + p[1]].tobytes()))
                left.remove(fit)
                at += fit[1]
            assert at == len(own)
        assert not left
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding, total


def test_packing(docs, rows):
    padding, total = check_pieces(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect(), [r[:2] for r in rows])
    assert padding <= 0.01 * total + 3 * 1024  # a last sequence for each of three tasks


def test_best_windows_equal_enumeration():
    rng = np.random.default_rng(6)
    for _ in range(30):
        at = np.unique(np.append(rng.integers(1, 40, 10), 40))
        at = np.unique(np.concatenate([at, np.arange(8, 41, 8)]))
        cost = rng.integers(0, 5, len(at))
        price = dict(zip(at.tolist(), cost.tolist()))

        def total(ends):
            lengths = np.diff([0, *ends])
            return sum(0 if n in (2, 4, 8, 16) else 16 - n for n in lengths) + sum(price[e] + packing.WINDOW for e in ends)

        best = {0: 0}
        for x in at.tolist():
            best[x] = min(best[i] + (0 if x - i in (2, 4, 8, 16) else 16 - x + i) + price[x] + packing.WINDOW for i in best if x - i <= 16)
        assert total(packing.best_windows(at, cost, 16)) == best[40]


def test_word_bpe(docs, rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same([tuple(r) for r in word_bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).collect()], want)


def test_rules(docs, rows, labels):
    want, bags, word_lists = [], [], []
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)))
        h = [plain_hash(x.encode()) for x in w]
        bags.append([x % rules.BUCKETS for x in h] + [plain_mix((plain_mix(a) * 31 + b) % 2**64) % rules.BUCKETS for a, b in zip(h, h[1:])])
        word_lists.append(w)
    found = rules.quality_rules(docs, labels.where("quality = 1")).collect()
    same([tuple(r)[:7] for r in found], want)

    target, raw = collections.Counter(), collections.Counter()
    for r, bag in zip(rows, bags):
        raw.update(bag)
        if r[0] is not None and r[0] in good:
            target.update(bag)
    odds = lambda b: math.log((target[b] + rules.ALPHA) / (sum(target.values()) + rules.ALPHA * rules.BUCKETS)) - math.log((raw[b] + rules.ALPHA) / (sum(raw.values()) + rules.ALPHA * rules.BUCKETS))
    table = {b: odds(b) for b in raw}
    ratio = [sum(table[b] for b in bag) / max(len(bag), 1) for bag in bags]
    trusted = [x for r, x, w in zip(rows, ratio, word_lists) if r[0] is not None and r[0] in good and w]
    floor = np.mean(trusted) - rules.DEVIATIONS * np.std(trusted)
    same([(r.doc_id, round(r.ratio, 6), r.kept) for r in found], [(w[0], round(x, 6), not w[6] and x >= floor) for w, x in zip(want, ratio)])


def plain_mix(x):
    """mix64 on plain numbers."""
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD % 2**64
    x ^= x >> 29
    return x * 0xC4CEB9FE1A85EC53 % 2**64 ^ x >> 32


def plain_hash(word):
    return plain_mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, b in enumerate(word)) % 2**64)


def test_quality_and_toxicity_score_every_row(docs, rows, labels):
    for found in (quality.quality_scores(docs, labels), toxicity.toxicity(docs, labels)):
        got = found.collect()
        same([r.doc_id for r in got], [r[0] for r in rows])
        assert all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id: r.held_out for r in quality.quality_scores(docs, labels).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in held if i is not None)
    assert quality.accepted(docs, labels.limit(0)).count() == len(rows)


@pytest.mark.parametrize("last", ["", "a", "ab", "abc"])
def test_quality_scores_a_short_last_text(last):
    model = quality.Model(np.arange(quality.BUCKETS) / quality.BUCKETS - 0.5, 0.1, 1)
    bodies = [b"abc def", b"the river", last.encode()]
    one = lambda b: model.scores(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
    got = model.scores(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)]))
    assert np.allclose(got, [one(b) for b in bodies])


def test_quality_keeps_rows_beside_a_null_last_text(spark):
    docs = spark.createDataFrame([(1, "abc def"), (2, "the river"), (3, None)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert sorted(r.doc_id for r in quality.quality_scores(docs, labels).collect()) == [1, 2, 3]
    assert quality.accepted(docs, labels, threshold=0.0).count() == 3


def test_segments_equal_definition():
    rng = np.random.default_rng(9)
    for _ in range(200):
        scores = rng.integers(-4, 4, 12).astype(float)
        want, stack = [], [(0, len(scores))]
        while stack:  # the best segment (leftmost, shortest) first, then both sides
            s, e = stack.pop()
            best = max(((scores[i:j].sum(), -(j - i), -i) for i in range(s, e) for j in range(i + 1, e + 1)), default=(0.0, 0, 0))
            if best[0] > 0:
                i, j = -best[2], -best[2] - best[1]
                want.append(best[0])
                stack += [(s, i), (j, e)]
        assert abs(sum(want) - sum(x[0] for x in toxicity.segments(scores))) < 1e-9


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    q = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out")
    assert q.where((F.col("score") >= 0.7) == (F.col("quality") == 1)).count() >= 0.97 * q.count()
    t = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    assert t.where((F.col("score") >= 0.5) == (F.col("toxic") == 1)).count() >= 0.93 * t.count()


def test_empty_tables(nothing, labels):
    none = labels.limit(0)
    file = public_tokenizers.path
    for found in (
        exact_dedup.exact_dedup(nothing), suffix_dedup.suffix_dedup(nothing), suffix_dedup.removed_repeats(nothing), simhash.simhash_components(nothing), near_copies.near_dedup(nothing),
        lattice_lm.lm_scores(nothing, file("piece_bpe_32k.model")), line_dedup.line_dedup(nothing), packing.pack(nothing, file("byte_bpe_50k.json")), word_bpe.encode_decode(nothing, file("word_bpe_49k.json")),
        rules.quality_rules(nothing, none), quality.quality_scores(nothing, none), toxicity.toxicity(nothing, none),
    ):
        assert found.count() == 0
