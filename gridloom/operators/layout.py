"""Where a pixel lies: linear and plane order, tiles, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = ["raster_id", "band", "depth", "ti", "tj"]
PIXEL = ["raster_id", "band", "row", "col"]
PLANE = ["raster_id", "band", "depth"]


def tiled(pix: DataFrame, block: int = 8) -> DataFrame:
    """With ti, tj: the tile of each pixel."""
    return pix.withColumns({"ti": F.expr(f"row div {block}").cast("int"), "tj": F.expr(f"col div {block}").cast("int")})


def extent(pix: DataFrame, *keys: str) -> DataFrame:
    """Rows, columns and depths of each raster (or of each ``keys``), counting from 0."""
    top = lambda c: (F.max(c) + 1).cast("int")
    return pix.groupBy(*(keys or ("raster_id",))).agg(top("row").alias("n_rows"), top("col").alias("n_cols"), top("depth").alias("n_depth"))


def linear_index(n_cols: Column | int, n_depth: Column | int = 1, n_rows: Column | int | None = None) -> Column:
    """Place in the interleaved layout; with ``n_rows`` counted on over the bands."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    at = (F.col("row").cast("long") * as_col(n_cols) + F.col("col")) * as_col(n_depth) + F.col("depth")
    return at if n_rows is None else at + F.col("band").cast("long") * as_col(n_rows) * as_col(n_cols) * as_col(n_depth)


def planar_index(n_rows: Column | int, n_cols: Column | int) -> Column:
    """Place in the layout with one plane a depth."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return (F.col("depth").cast("long") * as_col(n_rows) + F.col("row")) * as_col(n_cols) + F.col("col")


def bands(pix: DataFrame, first: int, count: int = 1) -> DataFrame:
    """``count`` bands from ``first`` on."""
    return pix.where(F.col("band").between(first, first + count - 1))


def explode_array(df: DataFrame, n_cols: int, n_depth: int = 1, values: str = "values") -> DataFrame:
    """Interleaved arrays (raster_id, band, ``values``) -> pixels; NaN and null become invalid."""
    k = F.col("k")
    out = df.select("raster_id", "band", F.posexplode(values).alias("k", "v"))
    return out.select("raster_id", "band", F.expr(f"k div {n_cols * n_depth}").cast("int").alias("row"), (F.expr(f"k div {n_depth}") % n_cols).cast("int").alias("col"), (k % n_depth).alias("depth"), F.col("v").cast("double").alias("value"), (F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double"))).alias("valid"))
