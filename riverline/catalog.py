"""All queries of the engine by name, with equal SQL where there is some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverline import fixtures
from riverline.operators.joins import as_of
from riverline.operators.volumes import exact
from riverline.plans import formulas, geometry, joins, lines, searches, volumes

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (formulas, lines, joins, volumes, searches, geometry):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water level as of each station, cut above the grade, dredge and dry volumes by tag."""
    placed = as_of(fixtures.stations(spark, sf_dir), joins.pools(spark, sf_dir), "chainage", "start", "level", ["line_id"], F.lit(joins.DOWN))
    cut = F.greatest(F.lit(0.0), F.col("z") - (F.pmod(F.col("level"), F.lit(100.0)) - 3.25))
    wet = F.col("idx") % 2 == 0
    return placed.withColumn("cut", F.coalesce(cut, F.lit(0.0))).groupBy("tag").agg(
        F.count("*").alias("n"), F.round(F.coalesce(exact(F.when(wet, F.col("cut") * 25)), F.lit(0.0)), 2).alias("dredge"), F.round(F.coalesce(exact(F.when(~wet, F.col("cut") * 25)), F.lit(0.0)), 2).alias("excav"),
    )


QUERIES["flagship_volumes"] = flagship
SQL["flagship_volumes"] = f"""{joins.HEAD}, c AS (SELECT s.tag, s.idx % 2 = 0 AS wet, coalesce(greatest(0, s.z - (coalesce(p.level, {joins.DOWN}) % 100 - 3.25)), 0) * 25 AS v FROM stations s ASOF LEFT JOIN pools p ON s.line_id = p.line_id AND s.chainage >= p.start)
SELECT tag, count(*) AS n, round(coalesce(sum(v::DECIMAL(28, 6)) FILTER (WHERE wet), 0)::DOUBLE, 2) AS dredge, round(coalesce(sum(v::DECIMAL(28, 6)) FILTER (WHERE NOT wet), 0)::DOUBLE, 2) AS excav FROM c GROUP BY tag"""
