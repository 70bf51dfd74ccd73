"""Exact sizes of encodings, computed without encoding, and the choice between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import container, dtypes
from . import quant
from .layout import PIXEL, TILE, tiled


def header_size(version: int) -> int:
    """Bytes of a header, without the count of mask bytes behind it."""
    return container.header_size(version)


def bits_needed(x: Column) -> Column:
    """Binary digits of x >= 0, none for 0."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x.cast("long"))))


def count_bytes(n: Column) -> Column:
    return F.when(n < 256, F.lit(1)).when(n < 65536, F.lit(2)).otherwise(F.lit(4))


def packed_bytes(n: Column, width: Column) -> Column:
    return F.floor((n * width + 7) / 8)


def plain_size(n: Column, top: Column) -> Column:
    return 1 + count_bytes(n) + packed_bytes(n, bits_needed(top))


def table_size(n: Column, distinct: Column, top: Column) -> Column:
    return 2 + count_bytes(n) + packed_bytes(distinct, bits_needed(top)) + packed_bytes(n, bits_needed(distinct))


def offset_size(z: Column, code: int) -> Column:
    """Bytes of the narrowest type that holds a tile's offset."""
    out = F.lit(dtypes.DTYPES[code].itemsize)
    for bits in sorted(b for b in range(1, 4) if dtypes.widened(code, b) not in (None, code)):
        small = dtypes.widened(code, bits)
        low, high = dtypes.value_range(small)
        exact = z.cast("float").cast("double") == z if small == dtypes.FLOAT32 else z == F.floor(z)
        out = F.when(z.between(low, high) & exact, F.lit(dtypes.DTYPES[small].itemsize)).otherwise(out)
    return out


def tile_costs(pix: DataFrame, code: int, max_error: float, block: int = 8, raw_item: int | None = None) -> DataFrame:
    """By tile and depth, how it would be stored (zero, raw, constant, packed, table) and its bytes.

    Values are settled already: the error is final, invalid pixels are marked. One shuffle by tile for the
    window, which the aggregation reuses.
    """
    item = raw_item or dtypes.DTYPES[code].itemsize
    w = Window.partitionBy(*TILE)
    t = tiled(pix.where("valid"), block)
    t = t.withColumns({"low": F.min("value").over(w), "same": (F.col("value") == F.lag("value").over(w.orderBy("row", "col"))).cast("int")})
    lossless = dtypes.is_integer(code) and max_error == 0.5
    q = F.lit(0) if max_error == 0 else (F.col("value") - F.col("low")).cast("long") if lossless else quant.quantized(F.col("value"), F.col("low"), max_error)
    s = t.withColumn("q", q).groupBy(*TILE).agg(F.count("*").alias("n"), F.min("value").alias("z_min"), F.max("value").alias("z_max"), F.coalesce(F.sum("same"), F.lit(0)).alias("n_same"), (F.count_distinct("q") - 1).alias("distinct"), F.max("q").alias("top_q"))
    return choose_mode(s, code, max_error, item)


def choose_mode(s: DataFrame, code: int, max_error: float, item: int) -> DataFrame:
    """Tiles (n, z_min, z_max, n_same, distinct, top_q, ...) with mode and bytes."""
    n, z_min, z_max = F.col("n"), F.col("z_min"), F.col("z_max")
    raw = 1 + n * item
    zero = (z_min == 0) & (z_max == 0)
    if max_error == 0:
        must, most = z_max > z_min, F.lit(0)
    else:
        top = quant.top_quantum(z_min, z_max, max_error)
        must, most = top > quant.quanta_limit(F.lit(code)), F.floor(top + 0.5)
    hint = (n > 4) & (z_max > z_min + 3 * max_error) & (2 * F.col("n_same") > n)
    plain = plain_size(n, most)
    tabled = table_size(n, F.col("distinct"), F.col("top_q"))
    use_table = hint & F.col("distinct").between(1, 254) & (tabled < plain)
    coded = 1 + offset_size(z_min, code) + F.when(most > 0, F.when(use_table, tabled).otherwise(plain)).otherwise(F.lit(0))
    mode = F.when(zero, "zero").when(must | (coded >= raw), "raw").when(most == 0, "constant").when(use_table, "table").otherwise("packed")
    size = F.when(zero, F.lit(1)).when(must | (coded >= raw), raw).otherwise(coded)
    return s.withColumns({"mode": mode, "bytes": size.cast("long")})


def empty_tile_bytes(pix: DataFrame, block: int = 8) -> DataFrame:
    """By raster and band, the bytes of tiles without a valid pixel: one for each depth. pix holds all pixels."""
    t = tiled(pix, block).groupBy("raster_id", "band", "ti", "tj").agg(F.bool_or("valid").alias("any"), (F.max("depth") + 1).alias("n_depth"))
    return t.groupBy("raster_id", "band").agg(F.sum(F.when(F.col("any"), 0).otherwise(F.col("n_depth"))).alias("bytes"))


def depth_delta_costs(pix: DataFrame, code: int, block: int = 8) -> DataFrame:
    """For lossless integers, by tile and depth, the bytes of values and of differences to the depth before, and the lesser; values win ties."""
    plain = tile_costs(pix, code, 0.5, block).select(*TILE, F.col("bytes").alias("plain"))
    before = F.lag("value").over(Window.partitionBy(*PIXEL).orderBy("depth"))
    steps = pix.where("valid").withColumn("before", before).where("before is not null").withColumn("value", F.col("value") - F.col("before")).drop("before")
    # the first difference of a tile counts as a repeat if it is 0
    delta = _delta_costs(steps, block)
    return plain.join(delta, TILE, "left").withColumn("bytes", F.least("plain", F.coalesce("delta", "plain")))


def _delta_costs(steps: DataFrame, block: int) -> DataFrame:
    w = Window.partitionBy(*TILE)
    t = tiled(steps, block).withColumns({"low": F.min("value").over(w), "last": F.coalesce(F.lag("value").over(w.orderBy("row", "col")), F.lit(0.0))})
    s = t.withColumns({"q": (F.col("value") - F.col("low")).cast("long"), "same": (F.col("value") == F.col("last")).cast("int")})
    s = s.groupBy(*TILE).agg(F.count("*").alias("n"), F.min("value").alias("z_min"), F.max("value").alias("z_max"), F.sum("same").alias("n_same"), (F.count_distinct("q") - 1).alias("distinct"), F.max("q").alias("top_q"))
    costed = choose_mode(s.where("z_min >= -2147483648 and z_max <= 2147483647"), dtypes.INT32, 0.5, 4)
    return costed.where("mode <> 'raw'").select(*TILE, F.col("bytes").alias("delta"))


def choose_block(pix: DataFrame, code: int, max_error: float) -> DataFrame:
    """By raster and band, bytes of all tiles of 8 and of 16, and which block wins (16 only if the rate is under 1.5 bits a value; it wins ties)."""
    keys = ["raster_id", "band"]
    sized = lambda b: tile_costs(pix, code, max_error, b).groupBy(*keys).agg(F.sum("bytes").alias(f"bytes_{b}"), F.sum("n").alias(f"n_{b}"))
    both = sized(8).join(sized(16), keys)
    item = dtypes.DTYPES[code].itemsize
    shape = pix.groupBy(*keys).agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), (F.max("depth") + 1).alias("n_depth"))
    both = both.join(shape, keys)
    low_rate = (F.col("bytes_8") * 8 < F.col("n_rows") * F.col("n_cols") * F.col("n_depth") * 1.5) & (F.col("bytes_8") < 4 * F.col("n_8") * item) & (F.greatest("n_rows", "n_cols") > 8)
    return both.select(*keys, "bytes_8", "bytes_16", F.when(low_rate & (F.col("bytes_16") <= F.col("bytes_8")), F.lit(16)).otherwise(F.lit(8)).alias("block"))


def band_mode(tiled_bytes: Column, coded_bytes: Column, raw_bytes: Column, flagged: Column, planes: Column) -> Column:
    """sweep, tiles or codes: raw wins ties; byte planes have to be a tenth smaller than tiles, prefix codes only smaller."""
    better = F.when(planes, coded_bytes < tiled_bytes * 0.9).otherwise(coded_bytes < tiled_bytes)
    least = F.when(better, coded_bytes).otherwise(tiled_bytes) + flagged.cast("int")
    return F.when(raw_bytes <= least, F.lit("sweep")).when(better, F.lit("codes")).otherwise(F.lit("tiles"))


def plane_total(planes: DataFrame, *keys: str) -> DataFrame:
    """Bytes of a band's byte planes: the predictor, and six more for each plane."""
    return planes.groupBy(*keys).agg((1 + F.sum(F.col("size") + 6)).alias("bytes"))


