"""Rasters derived from the tables, as pixel relations, and the same in SQL.

A pixel relation has raster_id, band, row, col, depth, value (double) and valid. Invalid pixels may be absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First and last week of lineitem's ship dates, counted from 1992-01-01.
FIRST_WEEK, LAST_WEEK = 156, 513
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(df: DataFrame, raster_id: str, row: Column, col: Column, value: Column, *, band: Column | None = None, depth: Column | None = None, valid: Column | None = None) -> DataFrame:
    zero = F.lit(0)
    return df.select(
        F.lit(raster_id).alias("raster_id"),
        (zero if band is None else band).cast("int").alias("band"),
        row.cast("int").alias("row"),
        col.cast("int").alias("col"),
        (zero if depth is None else depth).cast("int").alias("depth"),
        value.cast("double").alias("value"),
        (F.lit(True) if valid is None else valid).alias("valid"),
    )


def r_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding"))
    return pixels(e, "r_emb", F.col("vec_id"), F.col("pos"), F.col("col"))


def r_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return pixels(e, "r_evt", F.expr("event_id div 100"), F.expr("event_id % 100"), F.col("value"))


def r_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return pixels(p, "r_part", F.expr("p_partkey div 50"), F.expr("p_partkey % 50"), F.col("p_size"))


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("week", F.expr("cast(datediff(l_shipdate, date'1992-01-01') div 7 as int)"))
    return li.groupBy("l_suppkey", "week").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"), F.max("l_linenumber").alias("top_line"))


def r_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _weeks(spark, sf_dir)
    return pixels(w, "r_li", F.col("l_suppkey"), F.col("week"), F.col("quantity"))


def r_li_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of r_li's rows; the missing ones invalid."""
    w = _weeks(spark, sf_dir)
    rows = w.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("week", "quantity"))).alias("cells"))  # as many as there are weeks
    cells = rows.select("l_suppkey", "cells", F.explode(F.sequence(F.lit(FIRST_WEEK), F.lit(LAST_WEEK))).alias("week"))
    value = F.element_at("cells", F.col("week"))
    return pixels(cells, "r_li", F.col("l_suppkey"), F.col("week"), F.coalesce(value, F.lit(0.0)), valid=value.isNotNull())


def r_li3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three depths: quantity (-9999 where it is a multiple of 7), lines, highest line number."""
    w = _weeks(spark, sf_dir)
    quantity = F.when(F.col("quantity") % 7 == 0, F.lit(-9999.0)).otherwise(F.col("quantity"))
    three = F.array(quantity, F.col("lines").cast("double"), F.col("top_line").cast("double"))
    w = w.select("l_suppkey", "week", F.posexplode(three).alias("depth", "v"))
    return pixels(w, "r_li3", F.col("l_suppkey"), F.col("week"), F.col("v"), depth=F.col("depth"))


def r_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r_evt with a band for each event type, valid where the event has that type."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(len(EVENT_TYPES) - 1))))
    is_of = F.element_at(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("band") + 1) == F.col("event_type")
    return pixels(e, "r_bands", F.expr("event_id div 100"), F.expr("event_id % 100"), F.col("value"), band=F.col("band"), valid=is_of)


SQL = {
    "r_emb": "r_emb AS (SELECT CAST(vec_id AS INTEGER) AS row, unnest(range(0, len(embedding)))::INTEGER AS col, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)",
    "r_evt": "r_evt AS (SELECT CAST(event_id // 100 AS INTEGER) AS row, CAST(event_id % 100 AS INTEGER) AS col, value FROM events)",
    "r_part": "r_part AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS row, CAST(p_partkey % 50 AS INTEGER) AS col, CAST(p_size AS DOUBLE) AS value FROM part)",
    "r_li": """r_li AS (SELECT CAST(l_suppkey AS INTEGER) AS row, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 7 AS INTEGER) AS col,
      CAST(sum(l_quantity) AS DOUBLE) AS value, CAST(count(*) AS DOUBLE) AS lines, CAST(max(l_linenumber) AS DOUBLE) AS top_line FROM lineitem GROUP BY 1, 2)""",
    "r_li_dense": """r_li_dense AS (SELECT g.row, g.col, coalesce(r_li.value, 0e0) AS value, r_li.value IS NOT NULL AS valid
      FROM (SELECT row, CAST(unnest(range(156, 514)) AS INTEGER) AS col FROM (SELECT DISTINCT row FROM r_li)) g LEFT JOIN r_li ON r_li.row = g.row AND r_li.col = g.col)""",
    "r_li3": """r_li3 AS (SELECT row, col, 0 AS depth, CASE WHEN value % 7 = 0 THEN -9999e0 ELSE value END AS value FROM r_li
      UNION ALL SELECT row, col, 1, lines FROM r_li UNION ALL SELECT row, col, 2, top_line FROM r_li)""",
    "r_bands": """r_bands AS (SELECT CAST(event_id // 100 AS INTEGER) AS row, CAST(event_id % 100 AS INTEGER) AS col, b.band, value, e.event_type = b.name AS valid
      FROM events e, (VALUES (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view')) b(band, name))""",
}


def with_rasters(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
