"""Text sinks: lines of CSV and GeoJSON as DataFrames of one string column, ready for `write.text`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_cell(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(rows: DataFrame, notices: list[str]) -> DataFrame:
    """Notice lines, the header, then one line per row."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(k, t) for k, t in enumerate([*(f"# {n}" for n in notices), ",".join(rows.columns)])], "ord int, value string")
    body = rows.select(F.lit(1 << 20).alias("ord"), F.concat_ws(",", *(csv_cell(F.col(c)) for c in rows.columns)).alias("value"))
    return head.unionByName(body).orderBy("ord", "value").select("value")


def geojson_features(points: DataFrame, key: str, *properties: str) -> DataFrame:
    """One GeoJSON LineString feature per key from (key, idx, x, y); a line's vertices meet in one row."""
    g = points.groupBy(key, *properties).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(key, *properties).alias("properties"), F.struct(F.lit("LineString").alias("type"), "coordinates").alias("geometry"))
    return g.select(F.to_json(feature).alias("value"))
