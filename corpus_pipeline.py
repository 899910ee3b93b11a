"""The corpus pipeline: quality classifier, line dedup, near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the columns of
documents. Stages are written to the shared folder as Parquet and read again.

Defined cases: an empty table stays empty; nothing to learn from keeps every document; null texts are empty texts (kept as null until
line dedup); columns of documents with any name come through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverline.llm.common import durable
from riverline.llm.line_dedup import counters, line_dedup
from riverline.llm.near_copies import near_dedup
from riverline.llm.packing import pack
from riverline.llm.quality import accepted
from riverline.llm.suffix_dedup import removed_repeats


def measured(docs: DataFrame) -> DataFrame:
    """n_chars follows a changed text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; documents stay."""
    return measured(line_dedup(docs).drop(*counters(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id."""
    return near_dedup(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; documents stay."""
    return measured(removed_repeats(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("repeats", repeats), ("packing", packing)]

#: Learned weights and byte-pair merges are beyond SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, f"stage-{name}")
    return docs
