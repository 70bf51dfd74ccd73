"""Masks, NaN and no-data values, brought to one model: a pixel is valid or not; within a valid one, depths may hold the no-data value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dtypes
from .layout import PIXEL


def only_valid(pix: DataFrame) -> DataFrame:
    return pix.where("valid")


def nan_to_mask(pix: DataFrame) -> DataFrame:
    """NaN and null values become invalid, value 0."""
    bad = F.col("value").isNull() | F.isnan("value")
    return pix.withColumns({"valid": F.col("valid") & ~bad, "value": F.when(bad, F.lit(0.0)).otherwise(F.col("value"))})


def has_nan(pix: DataFrame, *keys: str) -> DataFrame:
    return pix.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("valid") & F.isnan("value")), F.lit(False)).alias("has_nan"))


def replace_nan(pix: DataFrame, low: float) -> DataFrame:
    """How versions before 6 do it: NaN becomes ``low`` where pixels have several depths, 0 where they have one."""
    depths = F.count("*").over(Window.partitionBy(*PIXEL))
    return pix.withColumn("value", F.when(F.isnan("value"), F.when(depths > 1, F.lit(low)).otherwise(F.lit(0.0))).otherwise(F.col("value")))


def count_bad(pix: DataFrame, no_data: float | None) -> DataFrame:
    """By valid pixel: depths, and how many are NaN or the no-data value."""
    bad = F.isnan("value") if no_data is None else F.isnan("value") | (F.col("value") == no_data)
    return pix.where("valid").groupBy(*PIXEL).agg(F.count("*").alias("n_depth"), F.count_if(bad).alias("n_bad"))


def promote_no_data(pix: DataFrame, no_data: float | None) -> DataFrame:
    """Pixels without a good depth become invalid; those with some keep their no-data values (mixed)."""
    bad = F.isnan("value") if no_data is None else F.isnan("value") | (F.col("value") == no_data)
    w = Window.partitionBy(*PIXEL)
    n_bad = F.sum((F.col("valid") & bad).cast("int")).over(w)
    out = pix.withColumns({"n_bad": n_bad, "n_all": F.count("*").over(w)})
    return out.withColumns({"mixed": F.col("valid") & (F.col("n_bad") > 0) & (F.col("n_bad") < F.col("n_all")), "valid": F.col("valid") & (F.col("n_bad") < F.col("n_all"))}).drop("n_bad", "n_all")


def distance_check(z_min: Column, z_max: Column, no_data: Column, max_error: Column, all_int: Column) -> Column:
    """Whether the no-data value is so near to the valid range that only lossless coding is safe."""
    apart = F.when(all_int, F.floor(max_error).cast("double")).otherwise(2 * max_error)
    return no_data.between(z_min - apart, z_max + apart)


def stand_in(z_min: Column, max_error: Column, all_int: bool, low: float) -> Column:
    """The highest candidate below z_min - 2e that may stand for no-data; null if there is none."""
    steps = [1.0, 10.0, 100.0, 1000.0, 10000.0] if all_int else [1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1000.0, 10000.0]
    half = F.when(z_min > 0, z_min / 2).otherwise(z_min * 2)
    found = F.array(z_min - 4 * max_error, *[z_min - F.lit(s) for s in steps], F.floor(half).cast("double") if all_int else half)
    fits = F.filter(found, lambda c: (c > low) & (c < z_min - 2 * max_error) & (c == F.floor(c) if all_int else F.lit(True)))
    return F.array_max(fits)


def remap(pix: DataFrame, old: float, new: Column | float) -> DataFrame:
    new = new if isinstance(new, Column) else F.lit(new)
    return pix.withColumn("value", F.when(F.col("valid") & (F.col("value") == old), new).otherwise(F.col("value")))


def unified_mask(pix: DataFrame) -> DataFrame:
    """By pixel of a raster, whether all its bands are valid there."""
    return pix.groupBy("raster_id", "row", "col").agg(F.bool_and("valid").alias("valid"))


def masks_differ(pix: DataFrame) -> DataFrame:
    """By band after the first, whether its mask differs from that of the band before; absent pixels are invalid."""
    m = pix.where("depth = 0 and valid").select("raster_id", "band", "row", "col")
    last = pix.groupBy("raster_id").agg(F.max("band").alias("last"))
    # a valid pixel stands in its own comparison and in that of the next band; twice there means the same
    each = m.withColumn("at", F.explode(F.array("band", F.col("band") + 1))).groupBy("raster_id", "at", "row", "col").count()
    differ = each.groupBy("raster_id", F.col("at").alias("band")).agg(F.bool_or(F.col("count") == 1).alias("d"))
    steps = last.where("last > 0").select("raster_id", F.explode(F.sequence(F.lit(1), "last")).alias("band"))
    return steps.join(differ, ["raster_id", "band"], "left").select("raster_id", "band", F.coalesce("d", F.lit(False)).alias("differs"))


def fill_no_data(pix: DataFrame, no_data: float, code: int) -> DataFrame:
    """Invalid pixels hold the no-data value, where the type can."""
    low, high = dtypes.value_range(code)
    return pix.withColumn("value", F.when(~F.col("valid") & F.lit(low <= no_data <= high), F.lit(float(no_data))).otherwise(F.col("value")))


def in_type_range(z: Column, code: Column) -> Column:
    """Whether z lies in the range of a type code."""
    lows, highs = zip(*(dtypes.value_range(c) for c in range(8)))
    at = code + 1
    return z.between(F.element_at(F.array(*[F.lit(x) for x in lows]), at), F.element_at(F.array(*[F.lit(x) for x in highs]), at))
