"""Two rasters against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import PIXEL

_AT = [*PIXEL, "depth"]


def max_difference(one: DataFrame, two: DataFrame, *keys: str) -> DataFrame:
    """The largest absolute difference of values valid in both, how many there are, and how many are valid in one only."""
    a = one.where("valid").select(*_AT, F.col("value").alias("a"))
    b = two.where("valid").select(*_AT, F.col("value").alias("b"))
    both = a.join(b, _AT, "full_outer")
    return both.groupBy(*keys).agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_one"))


def unequal(one: DataFrame, two: DataFrame) -> DataFrame:
    """Pixels that are in one of two relations only, either way; none if the rasters are the same."""
    cols = [*_AT, "value", "valid"]
    a, b = one.select(*cols), two.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("one")).union(b.exceptAll(a).withColumn("side", F.lit("two")))
