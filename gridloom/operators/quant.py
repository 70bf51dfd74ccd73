"""Quantization under an error bound, and the rules that settle the bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dtypes
from .layout import PLANE, TILE, tiled

LADDER = [(1.0, 1), (0.5, 2), (0.1, 10), (0.05, 20), (0.01, 100), (0.005, 200), (0.001, 1000), (0.0005, 2000), (0.0001, 10000)]


def normalized(max_error: Column, code: Column) -> Column:
    """Integers take whole errors, one half at least (lossless)."""
    return F.when(code < dtypes.FLOAT32, F.greatest(F.lit(0.5), F.floor(max_error).cast("double"))).otherwise(max_error)


def top_quantum(z_min: Column, z_max: Column, max_error: float) -> Column:
    return (z_max - z_min) * F.lit(1 / (2 * max_error))


def quanta_limit(code: Column) -> Column:
    return F.when(code <= dtypes.UINT16, F.lit((1 << 15) - 1)).otherwise(F.lit((1 << 30) - 1))


def needs_quanta(n: Column, z_min: Column, z_max: Column, max_error: float, code: Column) -> Column:
    if max_error == 0:
        return F.lit(False)
    top = top_quantum(z_min, z_max, max_error)
    return (n > 0) & (top <= quanta_limit(code)) & (F.floor(top + 0.5) != 0)


def quantized(z: Column, z_min: Column, max_error: float) -> Column:
    return F.floor((z - z_min) * F.lit(1 / (2 * max_error)) + 0.5)


def dequantized(q: Column, z_min: Column, max_error: float, z_max: Column) -> Column:
    return F.least(z_min + q * F.lit(2 * max_error), z_max)


def quantize_tiles(pix: DataFrame, max_error: float, block: int = 8) -> DataFrame:
    """Valid pixels with their tile's range, their quantum q and what it decodes to; clamped by the plane's maximum."""
    t = tiled(pix.where("valid"), block)
    by_tile = t.groupBy(*TILE).agg(F.min("value").alias("z_min"), F.max("value").alias("z_max"))
    by_plane = by_tile.groupBy(*PLANE).agg(F.max("z_max").alias("clamp"))
    out = t.join(by_tile, TILE).join(by_plane, PLANE)
    out = out.withColumn("q", quantized(F.col("value"), F.col("z_min"), max_error))
    return out.withColumn("decoded", dequantized(F.col("q"), F.col("z_min"), max_error, F.col("clamp")))


def raise_error(pix: DataFrame, max_error: float, *keys: str) -> DataFrame:
    """The largest error of the ladder whose rounding alone costs no more than half of ``max_error``, else ``max_error``.

    All steps are tried in one pass: one maximum a step, which combine before the shuffle.
    """
    steps = [(s, f) for s, f in LADDER if s / 2 > max_error]
    x = F.col("value")
    worst = [F.max(F.abs(F.floor(x * f + 0.5) - x * f)).alias(f"w{f}") for _, f in steps]
    if not steps:
        return pix.where("valid").groupBy(*keys).agg(F.lit(float(max_error)).alias("raised"))
    raised = F.coalesce(*[F.when(F.col(f"w{f}") / f <= max_error / 2, F.lit(s / 2)) for s, f in steps], F.lit(float(max_error)))
    return pix.where("valid").groupBy(*keys).agg(*worst).select(*keys, raised.alias("raised"))


def neighbour_pairs(pix: DataFrame) -> DataFrame:
    """Valid pixels as integers ``v`` with those to the ``right`` and ``below``; null where there is none.

    A pixel is sent to its own place and to those of its left and upper neighbours, so that a pair meets in one group of three at most.
    """
    p = pix.where("valid").select(*PLANE, "row", "col", F.col("value").cast("long").alias("v"))
    places = F.array(
        F.struct(F.col("row").alias("r"), F.col("col").alias("c"), F.lit(0).alias("side")),
        F.struct(F.col("row").alias("r"), (F.col("col") - 1).alias("c"), F.lit(1).alias("side")),
        F.struct((F.col("row") - 1).alias("r"), F.col("col").alias("c"), F.lit(2).alias("side")),
    )
    sent = p.withColumn("at", F.explode(places)).select(*PLANE, "at.r", "at.c", "at.side", "v")
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("v")))
    met = sent.groupBy(*PLANE, "r", "c").agg(side(0).alias("v"), side(1).alias("right"), side(2).alias("below")).where("v is not null")
    return met.select(*PLANE, F.col("r").alias("row"), F.col("c").alias("col"), "v", "right", "below")


def bitplane_flips(pix: DataFrame, n_bits: int) -> DataFrame:
    """By plane and bit: neighbour pairs, and in how many the bit differs.

    A raster of depth 1 without an invalid pixel counts the pairs of those pixels only that have both a right and
    a lower neighbour; any other counts all pairs. The extent of a raster is that of its valid pixels, from row and column 0.
    """
    corner = F.col("right").isNotNull() & F.col("below").isNotNull()
    differs = lambda other, s: F.coalesce(F.shiftright(F.col("v").bitwiseXOR(F.col(other)), s).bitwiseAND(F.lit(1)), F.lit(0))
    flips = [differs("right", s) + differs("below", s) for s in range(n_bits)]
    every = [F.sum(x).alias(f"f{s}") for s, x in enumerate(flips)] + [F.count("right").alias("p1"), F.count("below").alias("p2")]
    corners = [F.sum(F.when(corner, x)).alias(f"g{s}") for s, x in enumerate(flips)] + [F.count_if(corner).alias("q")]
    shape = [F.count("*").alias("n"), ((F.max("row") + 1).cast("long") * (F.max("col") + 1)).alias("cells")]
    wide = neighbour_pairs(pix).groupBy(*PLANE).agg(*every, *corners, *shape)
    alone = F.count("*").over(Window.partitionBy("raster_id", "band")) == 1  # a row a plane
    wide = wide.withColumn("whole", alone & (F.col("n") == F.col("cells")))
    pairs = F.when(F.col("whole"), 2 * F.col("q")).otherwise(F.col("p1") + F.col("p2"))
    long = F.posexplode(F.array(*[F.when(F.col("whole"), F.coalesce(f"g{s}", F.lit(0))).otherwise(F.col(f"f{s}")) for s in range(n_bits)])).alias("bit", "n_flips")
    return wide.select(*PLANE, pairs.alias("n_pairs"), long).where("n_pairs > 0")


def noise_error(flips: DataFrame, eps: float = 0.01, least_pairs: int = 5000) -> DataFrame:
    """By raster and band, the error that drops the bit planes of noise; 0 where there are too few pairs to tell.

    A plane is noise if it flips like a coin in every depth. From the top down the first noisy plane is the cut;
    the next takes its place if planes that are not lie between; two neighbours end it.
    """
    noisy = F.abs(1 - 2 * F.col("n_flips") / F.col("n_pairs")) < eps
    by_bit = flips.groupBy("raster_id", "band", "bit").agg(F.bool_and(noisy).alias("noisy"), F.min("n_pairs").alias("n_pairs"))
    bits = by_bit.groupBy("raster_id", "band").agg(F.min("n_pairs").alias("n_pairs"), F.reverse(F.sort_array(F.collect_list(F.struct("bit", "noisy")))).alias("bits"))  # 32 at most
    start = F.struct(F.lit(0).alias("found"), F.lit(0).alias("kept"))

    def step(s: Column, b: Column) -> Column:
        apart = (s["found"] == 1) & (b["bit"] < s["kept"] - 1)
        found = F.when(s["found"] == 0, 1).when(apart, 1).otherwise(s["found"] + 1)
        kept = F.when((s["found"] == 0) | apart, b["bit"]).otherwise(s["kept"])
        return F.when(b["noisy"] & (s["found"] < 2), F.struct(found.cast("int").alias("found"), kept.cast("int").alias("kept"))).otherwise(s)

    cut = F.aggregate("bits", start, step, lambda s: s["kept"])
    e = F.when(F.col("n_pairs") < least_pairs, F.lit(0.0)).otherwise(F.floor(F.pow(F.lit(2.0), cut) / 2).cast("double"))
    return bits.select("raster_id", "band", e.alias("error"))
