"""Each stage of the pipeline against a brute-force version, on rows with two more columns."""

import random

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riverline.llm import line_dedup, quality
from riverline.llm.common import id_remainder
from test_operators import check_pieces

STAGES = dict(corpus_pipeline.STAGES)
WORDS = "the and river water under bridge stone light of in on long old new grey Zug schön été".split()
SCHEMA = "doc_id long, text string, lang string, n_chars int, `__lines` int, part int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = [say(rng.randint(1, 90)) for _ in range(50)]
    passage = say(60)
    texts = [None, "", " ", *base, base[9], base[9] + " end", base[12].replace("river", "lake", 1)]
    texts += [f"{say(6)}\nPage {k} of 70\n{passage}\nAll rights reserved.\n{say(5)}" for k in range(25)] + [" ".join(rng.choice(["#", "*", "$$", "&", "##"]) for _ in range(60)) for _ in range(25)]
    return [(k, t, "en", len(t or ""), k % 4, k % 3) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, int("#" not in (t or "")), 0) for k, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def run(name, spark, docs, folder):
    found = STAGES[name](spark, docs, folder)
    assert found.schema.simpleString() == docs.schema.simpleString()
    return sorted((r.doc_id, r.text, r["__lines"], r.part) for r in found.collect())


def others(rows, texts):
    return sorted((r[0], t, r[4], r[5]) for r, t in zip(rows, texts) if t is not False)


def test_quality(spark, docs, rows, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(docs, labels, "quality", lambda i: id_remainder(i, 4) != 2, 4000)
    one = lambda t: model.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] >= 0.7
    got = run("quality", spark, docs, folder)
    assert got == others(rows, [r[1] if one((r[1] or "").encode()) else False for r in rows])
    assert not any("#" in (t or "") for _, t, *_ in got)


def test_lines(spark, docs, rows, folder):
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})  # noqa: F841
    want = {r[0]: r[1] for r in duckdb.sql(line_dedup.OP7_SQL).fetchall()}
    got = run("lines", spark, docs, folder)
    assert got == others(rows, [want[r[0]] for r in rows])
    assert sum("All rights" in t for _, t, *_ in got) == 1
    assert all(r.n_chars == len(r.text) for r in STAGES["lines"](spark, docs, folder).collect())


def test_near_copies(spark, docs, rows, folder):
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(r[1]) for r in rows]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) > 0
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[k] for k in range(len(rows)) if near(sets[i], sets[k])) for i in range(len(rows))]
    assert run("near_copies", spark, docs, folder) == others(rows, [r[1] if group[k] == k else False for k, r in enumerate(rows)])
    assert len(set(group)) <= len(rows) - 5


def test_repeats(spark, docs, rows, folder):
    first: dict[bytes, int] = {}
    for k, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], k)
    want = []
    for k, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < k:
                gone[p : p + 50] = b"\1" * 50
        want.append(bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore"))
    assert run("repeats", spark, docs, folder) == others(rows, want)


def test_packing(spark, docs, rows, folder):
    padding, total = check_pieces(STAGES["packing"](spark, docs, folder).collect(), [r[:2] for r in rows])
    assert padding <= 3 * 1024 and total > 2000


def test_stages_on_an_empty_table(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs.limit(0), folder)
        assert found.count() == 0 and (name == "packing" or found.columns == docs.columns)


def test_run_is_the_stages_one_after_the_other(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    total = lambda found: found.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert sorted(total(corpus_pipeline.run(spark, d)).collect()) == sorted(total(docs).collect())
