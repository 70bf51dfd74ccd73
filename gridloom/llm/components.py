"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import settle


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b: long) -> (v, root): each vertex and the smallest vertex that it reaches.

    Vertices without a link are absent. Every round only takes minima (combined before the shuffle) and
    joins on a vertex, whose hot keys the adaptive skew join splits; no component is ever in one place.
    Null ends and loops are ignored.
    """
    state = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    seen = _digest(state)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = state.union(state.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        state = settle(hung.union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        now = _digest(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    return state.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("v"), "root").union(
        state.select("v", F.col("v").alias("root")).distinct()
    )


def _digest(state: DataFrame) -> tuple[int, int]:
    row = state.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1])

