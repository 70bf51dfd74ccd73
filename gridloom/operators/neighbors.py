"""What depends on the order of pixels: differences, runs, histograms of them, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import PIXEL, PLANE, TILE, tiled


def _along(across: str, along: str):  # noqa: ANN202
    return Window.partitionBy(*PLANE, across).orderBy(along)


def neighbour_delta(pix: DataFrame) -> DataFrame:
    """Valid pixels with ``delta``: less the valid pixel to the left, else the one above, else the last valid one in scan order (0 at first).

    Scan order runs over a whole plane, but only rows' last values have to be carried along it: one value a row.
    """
    p, rows, cols = pix.where("valid"), _along("row", "col"), _along("col", "row")
    near = lambda w, c: F.when(F.lag(c).over(w) == F.col(c) - 1, F.lag("value").over(w))
    p = p.withColumns({"left": near(rows, "col"), "up": near(cols, "row"), "last": F.lag("value").over(rows)})
    ends = p.groupBy(*PLANE, "row").agg(F.max_by("value", "col").alias("end"))
    carried = F.lag("end").over(Window.partitionBy(*PLANE).orderBy("row"))
    ends = ends.withColumn("carried", carried).select(*PLANE, "row", "carried")
    out = p.join(ends, [*PLANE, "row"])
    return out.withColumn("delta", F.col("value") - F.coalesce("left", "up", "last", "carried", F.lit(0.0))).drop("left", "up", "last", "carried")


def byte_delta(delta: Column) -> Column:
    """Modulo 256, as 8-bit types wrap."""
    return F.pmod(delta.cast("long"), F.lit(256))


def depth_delta(pix: DataFrame) -> DataFrame:
    """Valid pixels with ``delta`` to the depth before; null at the first."""
    before = F.lag("value").over(Window.partitionBy(*PIXEL).orderBy("depth"))
    return pix.where("valid").withColumn("delta", F.col("value") - before)


def byte_derivative(seq: DataFrame, order: int, keys: list[str], at: str = "k", byte: str = "b") -> DataFrame:
    """Differences of bytes modulo 256, ``order`` times; the k-th leaves the first k bytes of a sequence alone."""
    w = Window.partitionBy(*keys).orderBy(at)
    for k in range(1, order + 1):
        seq = seq.withColumn(byte, F.when(F.row_number().over(w) <= k, F.col(byte)).otherwise(F.pmod(F.col(byte) - F.lag(byte).over(w), F.lit(256))))
    return seq


def restore_bytes(seq: DataFrame, order: int, keys: list[str], at: str = "k", byte: str = "b") -> DataFrame:
    """The inverse of :func:`byte_derivative`: running sums from the k-th byte on."""
    w = Window.partitionBy(*keys).orderBy(at)
    for k in range(order, 0, -1):
        place = F.row_number().over(w)
        seq = seq.withColumn("__place", place)
        running = F.sum(F.when(F.col("__place") >= k, F.col(byte)).otherwise(F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
        seq = seq.withColumn(byte, F.when(F.col("__place") < k, F.col(byte)).otherwise(F.pmod(running, F.lit(256)))).drop("__place")
    return seq


def histogram(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """How often each value occurs; values that don't are absent."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def entropy_bytes(df: DataFrame, byte: str, at: str, *keys: str, stride: int = 7) -> DataFrame:
    """Bytes of a perfect code for every ``stride``-th byte."""
    h = histogram(df.where(F.col(at) % stride == 0), byte, *keys)
    total = F.sum("n").over(Window.partitionBy(*keys))
    h = h.withColumn("bits", F.col("n") * F.log2(total / F.col("n")))
    return h.groupBy(*keys).agg(F.floor((F.floor(F.sum("bits") + 7 + 1e-9)) / 8).alias("bytes"), F.sum("n").alias("n"))


def runs(pix: DataFrame, what: str = "valid") -> DataFrame:
    """Maximal runs of equal ``what`` along rows: first column, length."""
    rows = _along("row", "col")
    p = pix.withColumn("new", F.coalesce((F.col(what) != F.lag(what).over(rows)).cast("int"), F.lit(1)))
    p = p.withColumn("run", F.sum("new").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy(*PLANE, "row", "run").agg(F.first(what).alias(what), F.min("col").alias("col"), F.count("*").alias("length")).drop("run")


def table_index(tiles: DataFrame, q: str = "q") -> DataFrame:
    """Place of each quantum among the distinct ones of its tile."""
    return tiles.withColumn("index", F.dense_rank().over(Window.partitionBy(*TILE).orderBy(q)) - 1)


def best_strategy(*named: tuple[str, Column]) -> Column:
    """The name with the least cost; the first of equal ones."""
    options = F.array(*[F.struct(cost.cast("double").alias("cost"), F.lit(k).alias("turn"), F.lit(name).alias("name")) for k, (name, cost) in enumerate(named)])
    return F.array_min(options)["name"]


def sample_stripes(n_rows: int, n_cols: int, least: int = 8192) -> list[tuple[int, int]]:
    """(first row, rows) of evenly spaced stripes, about the square root of the size in units of ``least``."""
    k = max(1, int((n_rows * n_cols / least + 1) ** 0.5))
    k = min(k, n_rows)
    height = max(1, min(n_rows // k, least // max(1, n_cols) or 1))
    return [(i * n_rows // k, height) for i in range(k)]


def tile_sequence(pix: DataFrame, block: int = 8) -> DataFrame:
    """Pixels numbered within their tile, row by row."""
    return tiled(pix, block).withColumn("at", F.row_number().over(Window.partitionBy(*TILE).orderBy("row", "col")) - 1)
