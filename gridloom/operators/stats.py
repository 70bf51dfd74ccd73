"""Counts and ranges of valid values: by tile, depth, band and raster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import PLANE, TILE, tiled


def _of_valid(agg, what: str = "value") -> Column:  # noqa: ANN001
    return agg(F.when(F.col("valid"), F.col(what)))


def is_integer(z: Column) -> Column:
    return z == F.floor(z + 0.5)


def valid_counts(pix: DataFrame, *keys: str) -> DataFrame:
    """Valid pixels (not values) and all that are present."""
    first = pix.where("depth = 0")
    return first.groupBy(*keys).agg(F.count_if("valid").alias("n_valid"), F.count("*").alias("n"))


def ranges(pix: DataFrame, *keys: str) -> DataFrame:
    """z_min, z_max and the count of valid values; null where there are none."""
    return pix.groupBy(*keys).agg(_of_valid(F.min).alias("z_min"), _of_valid(F.max).alias("z_max"), F.count_if("valid").alias("n_valid"))


def range_rollup(pix: DataFrame) -> DataFrame:
    """Ranges by depth, by band, by raster and over all, in one pass."""
    return pix.rollup("raster_id", "band", "depth").agg(_of_valid(F.min).alias("z_min"), _of_valid(F.max).alias("z_max"), F.count_if("valid").alias("n_valid"))


def masked_range(pix: DataFrame, *keys: str) -> DataFrame:
    """Ranges with -1, -1 for what has no valid value."""
    r = ranges(pix, *keys)
    return r.withColumns({"z_min": F.coalesce("z_min", F.lit(-1.0)), "z_max": F.coalesce("z_max", F.lit(-1.0))})


def tile_stats(pix: DataFrame, block: int = 8, max_error: float = 0.0) -> DataFrame:
    """By tile and depth: n, z_min, z_max, values equal to the one before (row by row), and whether a table may pay."""
    t = tiled(pix.where("valid"), block)
    before = F.lag("value").over(Window.partitionBy(*TILE).orderBy("row", "col"))
    t = t.withColumn("same", F.coalesce((F.col("value") == before).cast("int"), F.lit(0)))
    s = t.groupBy(*TILE).agg(F.count("*").alias("n"), F.min("value").alias("z_min"), F.max("value").alias("z_max"), F.sum("same").alias("n_same"))
    hint = (F.col("n") > 4) & (F.col("z_max") > F.col("z_min") + 3 * max_error) & (2 * F.col("n_same") > F.col("n"))
    return s.withColumn("try_table", hint)


def tile_ranges(pix: DataFrame, block: int = 8) -> DataFrame:
    """Like :func:`tile_stats` without what needs an order; combines before the shuffle."""
    t = tiled(pix.where("valid"), block)
    return t.groupBy(*TILE).agg(F.count("*").alias("n"), F.min("value").alias("z_min"), F.max("value").alias("z_max"))


def constant_planes(pix: DataFrame) -> DataFrame:
    """By plane, whether it is constant (an empty one is)."""
    r = ranges(pix, *PLANE)
    return r.select(*PLANE, F.coalesce(F.col("z_min") == F.col("z_max"), F.lit(True)).alias("constant"))


def integrality(pix: DataFrame, *keys: str, limit: float = float(1 << 53)) -> DataFrame:
    """Whether all valid values are integers that the type holds exactly."""
    v = F.col("value")
    return pix.where("valid").groupBy(*keys).agg(F.bool_and(is_integer(v) & v.between(-limit, limit)).alias("all_int"), F.count_if(~is_integer(v)).alias("n_fractions"))


def band_statistics(pix: DataFrame) -> DataFrame:
    """By band, overall range and an array of ranges by depth; 0 where nothing is valid."""
    r = ranges(pix, "raster_id", "band", "depth").withColumns({"z_min": F.coalesce("z_min", F.lit(0.0)), "z_max": F.coalesce("z_max", F.lit(0.0))})
    by_depth = F.sort_array(F.collect_list(F.struct("depth", "z_min", "z_max"))).alias("by_depth")  # as many as depths
    return r.groupBy("raster_id", "band").agg(F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max"), by_depth)
