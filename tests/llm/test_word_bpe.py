import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riverline.llm.packing import ByteBpe
from riverline.llm.word_bpe import LEAF, WordBpe, encode_decode

ALPHABETS = ["ab", "the and ing er", "aeiou nrst. ,!?'s 't 've\n\t  123", "éèàüßñç ÀÉ ÑÖ¿¡ ªº²½", "日本語テキスト Σς İ ﬁ é ​　", "<|endoftext|><|startoftext|> x", "\x85\x1c\x00\xa0 a", "#*$%&-_/\\"]


def texts(n=400):
    rng = random.Random(5)
    out = ["", " ", "\n\n", "a" * 5000, "ab" * 3000, "the" * 2000, "x <|endoftext|> y<|endoftext|>", "<|startoftext|>", "zzz" * 700 + " " + "q" * 999]
    for _ in range(n):
        alphabet = "".join(rng.sample(ALPHABETS, rng.randint(1, 3)))
        out.append("".join(rng.choice(alphabet) for _ in range(rng.choice([3, 30, 300, 1500]))))
    for _ in range(40):
        out.append("".join(rng.choice(["in", "th", "an", "re", "ar", "er", "st", "ing"]) for _ in range(rng.randint(40, 900))))
    return out


def test_word_bpe_equals_library():
    file = public_tokenizers.path("word_bpe_49k.json")
    own, library = WordBpe(file), Tokenizer.from_file(file)
    for text in texts():
        ids, shown = own.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        assert shown == library.decode(want, skip_special_tokens=False)


def test_byte_bpe_equals_library():
    file = public_tokenizers.path("byte_bpe_50k.json")
    own, library = ByteBpe(file), Tokenizer.from_file(file)
    for text in texts():
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize("size", [33, 64, 1000])
def test_tree_concatenation_equals_direct(size):
    own = WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(size)
    for _ in range(30):
        parts = own.merges.symbols("".join(rng.choice("theanrsio") for _ in range(size)))
        assert own.merges.encode(parts) == own.merges.direct(parts)


def test_whole_texts_go_through_tree_concatenation():
    """Real documents, as they are and with letters, quotes and dashes of other scripts: joins happen, and ids equal the library's."""
    import pyarrow.parquet as pq

    file = public_tokenizers.path("word_bpe_49k.json")
    own, library = WordBpe(file), Tokenizer.from_file(file)
    real = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if t]
    foreign = str.maketrans({"e": "\u03b5", "o": "\u0151", " ": "\u3000", "'": "\u2019", "-": "\u2014", "n": "n\u0303"})
    for text in [*real, *(t.translate(foreign) for t in real[:40]), "".join(real[:60]).replace(" ", "")[:20_000]]:
        before = own.joins
        ids, shown = own.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        assert shown == library.decode(want, skip_special_tokens=False)
        assert own.joins > before or len(text) <= LEAF
    assert own.joins > 100


@pytest.mark.parametrize("split", [40, 1000])
def test_long_texts_are_encoded_in_parallel_parts(spark, split):
    file = public_tokenizers.path("word_bpe_49k.json")
    rows = [(None if k == 3 else k // 2, t) for k, t in enumerate(texts(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256)
    assert sorted(encode_decode(docs, file, split).collect(), key=key) == sorted(encode_decode(docs, file).collect(), key=key)
