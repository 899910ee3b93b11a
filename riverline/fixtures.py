"""Deterministic projections of the driver's tables into line-referenced shapes, and the same projections as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, idx, x, y, chainage, z, tag): one line per user, a vertex each 25 m, z missing on every seventh event."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    e = e.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    return e.select(
        F.col("user_id").alias("line_id"), "idx", (F.col("idx") * 25.0).alias("x"), (F.pmod(F.col("event_id") * 7919, F.lit(1000)) / 10.0).alias("y"),
        (F.col("idx") * 25.0).alias("chainage"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("z"), F.col("event_type").alias("tag"),
    )


STATIONS = """stations AS (
  SELECT user_id AS line_id, idx, idx * 25.0::DOUBLE AS x, ((event_id * 7919) % 1000) / 10.0::DOUBLE AS y, idx * 25.0::DOUBLE AS chainage,
         CASE WHEN event_id % 7 <> 0 THEN value END AS z, event_type AS tag
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events))"""


def vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessel and section numbers, one row per part; all are exact in binary."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("beam"), F.col("p_brand").alias("class"), F.col("p_type").alias("formation"))
    i = F.col("id")
    return p.select(
        "id", "class", "formation", "beam", (F.col("beam") * 8).alias("loa"), (F.col("beam") / 8).alias("draught"), ((i % 97) * 10.0).alias("radius"),
        ((i % 83) / 2.0).alias("off"), ((i % 13) / 2.0).alias("depth"), (i % 7).cast("double").alias("wl"), ((i % 29) / 2.0 - 3).alias("z"),
        (i % 2 == 0).alias("bench"), (F.col("beam") / 4).alias("hb"), ((i % 360) - 179.75).alias("lon"), ((i % 160) - 79.5).alias("lat"), ((i % 180) / 64.0).alias("phi"),
    )


VESSELS = """vessels AS (
  SELECT p_partkey AS id, p_brand AS class, p_type AS formation, p_size::DOUBLE AS beam, p_size * 8.0::DOUBLE AS loa, p_size / 8.0::DOUBLE AS draught,
         (p_partkey % 97) * 10.0::DOUBLE AS radius, (p_partkey % 83) / 2.0::DOUBLE AS off, (p_partkey % 13) / 2.0::DOUBLE AS depth, (p_partkey % 7)::DOUBLE AS wl,
         (p_partkey % 29) / 2.0::DOUBLE - 3 AS z, p_partkey % 2 = 0 AS bench, p_size / 4.0::DOUBLE AS hb, (p_partkey % 360) - 179.75::DOUBLE AS lon,
         (p_partkey % 160) - 79.5::DOUBLE AS lat, (p_partkey % 180) / 64.0::DOUBLE AS phi
  FROM part)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transverse samples (station, k, off, side, z, wet), about four a station and side; k numbers them."""
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    s = s.withColumn("k", F.row_number().over(w).cast("long"))
    off = (F.col("k") * 3 + F.col("l_partkey") % 7).cast("double")
    return s.select(F.col("l_orderkey").alias("station"), "k", off.alias("off"), F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(-1).cast("int").alias("side"), F.col("l_quantity").alias("z"), (F.col("l_returnflag") == "R").alias("wet"))


SAMPLES = """samples AS (
  SELECT l_orderkey AS station, k, (k * 3 + l_partkey % 7)::DOUBLE AS off, CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END AS side, l_quantity AS z, l_returnflag = 'R' AS wet
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS k FROM lineitem))"""


def weirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(start, level): a pool starts every 400 m."""
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 400.0).alias("start"), F.abs(F.col("s_acctbal")).alias("level"))


WEIRS = "weirs AS (SELECT s_suppkey * 400.0::DOUBLE AS start, abs(s_acctbal) AS level FROM supplier)"


def reaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reach, kind, a, b): half-open intervals of 300 m, with the kind of their region."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("reach"), F.col("n_regionkey").cast("long").alias("kind"), (F.col("n_nationkey") * 300.0).alias("a"), (F.col("n_nationkey") * 300.0 + 300.0).alias("b"))


REACHES = "reaches AS (SELECT n_nationkey::BIGINT AS reach, n_regionkey::BIGINT AS kind, n_nationkey * 300.0::DOUBLE AS a, n_nationkey * 300.0::DOUBLE + 300 AS b FROM nation)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raster_id, row, col, z): an 8 x 8 tile per vector; values in thousandths, rounded to whole numbers, are exact."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return e.select(F.col("vec_id").alias("raster_id"), F.floor(F.col("p") / 8).cast("long").alias("row"), (F.col("p") % 8).cast("long").alias("col"), F.floor(F.col("v").cast("double") * 1000).cast("double").alias("z"))


PIXELS = """pixels AS (
  SELECT vec_id AS raster_id, (p // 8)::BIGINT AS row, (p % 8)::BIGINT AS col, floor(v::DOUBLE * 1000) AS z
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"""
