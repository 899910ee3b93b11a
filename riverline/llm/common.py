"""Helpers that the text operators share: input columns, durable tables, size-derived partition counts.

Conventions for every operator here:

* a null text is an empty text; a null doc_id is an id of its own that sorts first and comes back as null;
* extra columns of the input are ignored, whatever their names;
* empty tables give empty results with the same columns.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, body binary): nulls replaced by NULL_ID and no bytes."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
    )


def fresh(docs: DataFrame, name: str) -> str:
    """`name`, longer if docs has such a column in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def restore_id(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols or ("doc_id",):
        df = df.withColumn(c, F.when(F.col(c) != F.lit(NULL_ID), F.col(c)))
    return df


def id_remainder(doc_id, modulus: int):
    """crc32(doc_id as text) mod `modulus`; a null id counts as empty text."""
    text = F.when(doc_id == F.lit(NULL_ID), F.lit("")).otherwise(doc_id.cast("string"))
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % F.lit(modulus)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of our own only on a single machine whose session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='riverline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/riverline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    found = spark.read.schema(df.schema).parquet(path)
    found._durable_path = path
    return found


def discard(df: DataFrame) -> None:
    """Delete the files of a durable table that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(df._durable_path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def total_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts; a native scan with one number per task."""
    return docs.select(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def raw_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary Arrow column without copying; offsets has one more entry than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.binary())
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], most_bytes: int, column: str = "body") -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `most_bytes` of `column`, or one longer row."""
    for batch in batches:
        sizes = np.diff(raw_slices(batch.column(column))[1])
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)


_mixed = np.uint64(0xFF51AFD7ED558CCD)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection on 64-bit integers that spreads low-entropy keys."""
    x = x ^ (x >> np.uint64(33))
    x = x * _mixed
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xC4CEB9FE1A85EC53) ^ (x >> np.uint64(32))


class IdFilter:
    """A Bloom filter of longs: 16 bits a row, rounded up to a power of two, between LEAST and MOST bits.

    Built by native aggregation (at most bits/64 rows reach the driver) and broadcast (32 MB at most). Beyond MOST / 16 rows it only
    lets more others through; what it lets through is always joined exactly afterwards.
    """

    LEAST, MOST = 1 << 16, 1 << 28

    def __init__(self, rows: DataFrame, column: str):
        bits = min(self.MOST, max(self.LEAST, 1 << (16 * rows.count()).bit_length()))
        places = self.hashes(F.col(column), bits)
        words = rows.select(F.explode(F.array(*places)).alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        found = words.toArrow()
        table = np.zeros(bits // 64, np.int64)
        table[found.column("w").to_numpy()] = found.column("b").to_numpy()
        self.table = rows.sparkSession.sparkContext.broadcast(table)

    @staticmethod
    def hashes(column, bits: int) -> list:
        h, g = F.xxhash64(column, F.lit(1)), F.xxhash64(column, F.lit(2))
        return [x.bitwiseAND(F.lit(bits - 1)) for x in (h, F.shiftright(h, 32), g, F.shiftright(g, 32))]

    def apply(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows of `rows` whose id may be among those gathered."""
        table, names, bits = self.table, rows.columns, 64 * len(self.table.value)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for k in range(4):
                    p = batch.column(f"__p{k}").to_numpy()
                    keep &= (table.value[p >> 6] >> (p & 63)) & 1 == 1
                yield batch.select(names).filter(pa.array(keep))

        asked = rows.select(*rows.columns, *(h.alias(f"__p{k}") for k, h in enumerate(self.hashes(F.col(column), bits))))
        return asked.mapInArrow(work, rows.schema)
