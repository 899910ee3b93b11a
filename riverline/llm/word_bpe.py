"""BPE encoding and decoding with tree concatenation.

A text longer than `LEAF` characters is cut in halves, wherever that falls, each half is encoded by itself (recursively), and the
halves are joined: a window around the cut, which begins and ends next to a blank, is encoded again and grows until its first word
is the left half's and its last word the right half's at these places. That is exact: blanks belong to no word, so what a
text's words are between two blanks depends on nothing outside them. Words longer than `SYMBOLS` symbols (texts without blanks are one)
go the same way: halves of symbols, and windows of tokens around the join that grow until their outer tokens equal those of both
sides; a sequence of tokens is the encoding of its text when every neighbouring pair of tokens encodes to itself.

Halves know nothing of each other. Texts longer than `SPLIT` characters are dealt out by halves to parallel tasks and joined in one task per
text; shorter ones are one task's work, as their neighbours keep the other tasks busy.

Words of Latin text are found by a pattern of our own; a leaf with any other character takes its words from the library's own normaliser and
word splitter (Unicode tables differ between releases, and results must not). All words are encoded here.

Defined cases: null or empty text has no ids and decodes to nothing; special tokens in a text get their own ids, as the
library does it; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from riverline.llm.common import documents, durable, ids_and_bytes, raw_slices, restore_id, shuffle_width
from riverline.llm.packing import PLAIN, byte_letters

LEAF = 2048
WINDOW = 32
SYMBOLS = 32
SPLIT = 1 << 22
CACHE = 500_000
NEVER = 1 << 60
BLANK = re.compile("[ \\t\\n\\r]")
Unit = tuple[bytes, str]
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
BLANKS = "\\t\\n\\r \\xa0"
#: Fixed value: contractions, letter runs, single numbers, runs of anything else; restricted to characters of PLAIN.
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")


class Merges:
    """Byte-pair merges over symbols; a word's last symbol carries the end mark."""

    def __init__(self, merges: list, suffix: str):
        self.rank = {tuple(m): k for k, m in enumerate(merges)}
        self.suffix = suffix

    def symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.suffix] if word else []

    def direct(self, parts: list[str]) -> list[str]:
        """Merge the pair of least rank, leftmost first, until none is left."""
        parts, rank = list(parts), self.rank.get
        ranks = [rank(p, NEVER) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NEVER)
        return parts

    def encode(self, parts: list[str]) -> list[str]:
        """Tokens of a symbol sequence by tree concatenation."""
        if len(parts) <= SYMBOLS:
            return self.direct(parts)
        half = len(parts) // 2
        return self.join(self.encode(parts[:half]), self.encode(parts[half:]))

    def split(self, token: str) -> list[str]:
        return self.symbols(token.removesuffix(self.suffix)) if token.endswith(self.suffix) else list(token)

    def join(self, left: list[str], right: list[str]) -> list[str]:
        take = 1
        while True:
            a, b = left[-take:], right[:take]
            found = self.direct([s for t in [*a, *b] for s in self.split(t)])
            whole_left, whole_right = take >= len(left), take >= len(right)
            if (whole_left or found[0] == a[0]) and (whole_right or found[-1] == b[-1]):
                return [*left[: max(0, len(left) - take)], *found, *right[take:]]
            take *= 2


class WordBpe:
    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(file)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        self.vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.letter = {b: c for c, b in byte_letters().items()}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.cache: dict[str, Unit] = {}
        self.by_letters: dict[str, Unit] = {}
        self.joins = 0

    def of_letters(self, letters: str) -> Unit:
        """(ids, decoded tokens) of a normalised word in byte letters."""
        tokens = self.merges.encode(self.merges.symbols(letters))
        return np.array([self.vocab[t] for t in tokens], "<u4").tobytes(), " ".join(tokens)

    def word(self, word: str) -> Unit:
        return self.of_letters("".join(self.letter[b] for b in word.encode()))

    def words(self, text: str) -> list[Unit]:
        """The words of a text, one after the other."""
        out: list[Unit] = []
        for part in self.specials.split(text) if "<|" in text else [text]:
            if part in self.special:
                out.append((self.special[part].to_bytes(4, "little"), part))
                continue
            if PLAIN.search(part):
                split = self.exact.pre_tokenizer.pre_tokenize_str(self.exact.normalizer.normalize_str(part))
                found, cache, make = [w for w, _ in split], self.by_letters, self.of_letters
            else:
                found, cache, make = WORD.findall(part.lower()), self.cache, self.word
            units = list(map(cache.get, found))
            if None in units:
                if len(cache) > CACHE:
                    cache.clear()
                for k, w in enumerate(found):
                    if units[k] is None:
                        units[k] = cache.get(w) or make(w)
                        if len(w) < 64:
                            cache[w] = units[k]
            out += units
        return out

    def tree(self, text: str, lo: int, hi: int) -> list[Unit]:
        """The words of text[lo:hi] by tree concatenation."""
        if hi - lo <= LEAF:
            return self.words(text[lo:hi])
        mid = (lo + hi) // 2
        return self.concatenated(text, lo, mid, hi, self.tree(text, lo, mid), self.tree(text, mid, hi))

    def concatenated(self, text: str, lo: int, mid: int, hi: int, left: list[Unit], right: list[Unit]) -> list[Unit]:
        """The words of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        self.joins += 1
        width = WINDOW
        while True:
            a, b = max(lo, mid - width), min(hi, mid + width)
            width *= 2
            if a > lo:
                blank = BLANK.search(text, a, mid)
                if not blank:
                    continue
                a = blank.end()
            if b < hi:
                b = max(text.rfind(c, mid, b) for c in " \t\n\r")
                if b < 0:
                    continue
            before, after, whole = self.words(text[a:mid]), self.words(text[mid:b]), self.words(text[a:b])
            if a > lo and not (before and whole and whole[0] == before[0] == left[-len(before)]):
                continue
            if b < hi and not (after and whole and whole[-1] == after[-1] == right[len(after) - 1]):
                continue
            return left[: len(left) - len(before)] + whole + right[len(after) :]

    def encode(self, text: str) -> Unit:
        """(ids as little-endian 32-bit numbers, decoded text)."""
        return summary(self.tree(text, 0, len(text)))


def summary(units: list[Unit]) -> Unit:
    return b"".join([u[0] for u in units]), " ".join([u[1] for u in units])


def digests(ids: bytes, shown: str) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()


def halves(lo: int, hi: int, most: int) -> list[tuple[int, int]]:
    """The leaves of the tree over [lo, hi) whose leaves are `most` long at most."""
    if hi - lo <= most:
        return [(lo, hi)]
    mid = (lo + hi) // 2
    return halves(lo, mid, most) + halves(mid, hi, most)


FIRST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, row long, part int, text binary"


class Coder:
    """Encodes short texts, cuts long ones, encodes the cut parts and joins them; one WordBpe a worker."""

    def __init__(self, file: str, most: int):
        self.file, self.most, self.kept = file, most, None

    def __getstate__(self):
        return self.__dict__ | {"kept": None}

    @property
    def bpe(self) -> WordBpe:
        if self.kept is None:
            self.kept = WordBpe(self.file)
        return self.kept

    def first(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with its digests (no part), or a row per part of a text longer than `most` characters."""
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        for batch in batches:
            data, offsets = raw_slices(batch.column("body"))
            whole, edges = data.tobytes(), offsets.tolist()
            out: list[tuple] = []
            for i, s, e in zip(batch.column("doc_id").to_pylist(), edges, edges[1:]):
                text = whole[s:e].decode("utf-8", "replace")
                row += 1
                if len(text) <= self.most:
                    out.append((i, *digests(*self.bpe.encode(text)), row, None, None))
                else:
                    out += [(i, None, None, None, row, k, text[a:b].encode()) for k, (a, b) in enumerate(halves(0, len(text), self.most))]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "row", "part", "text"])

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [self.bpe.tree(t, 0, len(t)) for t in (b.decode() for b in batch.column("text").to_pylist())]
            ids = pa.array([b"".join(u[0] for u in part) for part in units], pa.binary())
            sizes = pa.array([np.array([len(u[0]) // 4 for u in part], "<u4").tobytes() for part in units], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "part", "text")), ids, sizes], names=["doc_id", "row", "part", "text", "ids", "sizes"])

    def joined(self, table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        text = "".join(r["text"].decode() for r in rows)

        def units(r: dict) -> list[Unit]:
            ids, ends = np.frombuffer(r["ids"], "<u4"), np.cumsum(np.frombuffer(r["sizes"], "<u4")).tolist()
            return [(ids[s:e].tobytes(), " ".join(self.bpe.token[i] for i in ids[s:e].tolist())) for s, e in zip([0, *ends], ends)]

        def up(lo: int, hi: int) -> list[Unit]:
            """Words of text[lo:hi]; parts are taken in order."""
            if hi - lo <= self.most:
                return units(rows.pop(0))
            mid = (lo + hi) // 2
            left = up(lo, mid)
            return self.bpe.concatenated(text, lo, mid, hi, left, up(mid, hi))

        n, a, b = digests(*summary(up(0, len(text))))
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "n_tokens": pa.array([n], pa.int64()), "ids_sha256": [a], "decoded_sha256": [b]})


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, file: str, split: int = SPLIT) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Texts longer than `split` characters are encoded in parallel parts."""
    coder = Coder(file, split)
    found = durable(ids_and_bytes(docs).mapInArrow(coder.first, FIRST), "encoded")
    out = found.where("part IS NULL").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    cut = found.where("part IS NOT NULL").select("doc_id", "row", "part", "text")
    if not cut.isEmpty():
        parts = cut.repartition(shuffle_width(docs.sparkSession), "row", "part").mapInArrow(coder.parts, "doc_id long, row long, part int, text binary, ids binary, sizes binary")
        out = out.unionByName(parts.groupBy("row").applyInArrow(lambda t: coder.joined(t), RESULT))
    return restore_id(out)


def op8_word_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
