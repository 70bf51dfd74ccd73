"""All registered queries over the derived rasters, and SQL for those that SQL can express.

Each query applies an operator to a whole raster. The SQL is for another engine and written from the
operator's definition, not from its plan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dtypes
from ..operators import codec, compare, cost, layout, neighbors, quant, stats, validity
from . import rasters as r

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


_TILES = "SELECT row // 8 AS ti, col // 8 AS tj, count(*) AS n, min(value) AS z_min, max(value) AS z_max FROM {0} GROUP BY 1, 2"


def _with(names: str, body: str) -> str:
    return r.with_rasters(*names.split()) + body


# ---- layout and quantization ----------------------------------------------------------------------------

@query(_with("r_emb", "\nSELECT row, col, value FROM r_emb"))
def explode_pixels(spark, sf_dir):
    return r.r_emb(spark, sf_dir).select("row", "col", "value")


@query(_with("r_emb", "\nSELECT CAST(row // 8 AS INTEGER) AS ti, CAST(col // 8 AS INTEGER) AS tj, count(*) AS n, min(CAST(row AS BIGINT) * 64 + col) AS first FROM r_emb GROUP BY 1, 2"))
def tile_index(spark, sf_dir):
    t = layout.tiled(r.r_emb(spark, sf_dir)).withColumn("k", layout.linear_index(64))
    return t.groupBy("ti", "tj").agg(F.count("*").alias("n"), F.min("k").alias("first"))


_QUANTA = r.with_rasters("r_emb") + f""",
t AS ({_TILES.format("r_emb")}),
q AS (SELECT p.row // 8 AS ti, p.col // 8 AS tj, p.value, t.z_min, floor((p.value - t.z_min) * (1e0 / (2 * 0.01e0)) + 0.5e0) AS q
  FROM r_emb p JOIN t ON t.ti = p.row // 8 AND t.tj = p.col // 8),
d AS (SELECT *, least(z_min + q * (2 * 0.01e0), (SELECT max(value) FROM r_emb)) AS decoded FROM q)"""


@query(_QUANTA + "\nSELECT CAST(ti AS INTEGER) AS ti, CAST(tj AS INTEGER) AS tj, count(*) AS n, CAST(sum(q) AS BIGINT) AS sum_q, max(abs(decoded - value)) AS max_err FROM d GROUP BY ti, tj")
def tile_quantize(spark, sf_dir):
    q = quant.quantize_tiles(r.r_emb(spark, sf_dir), 0.01)
    return q.groupBy("ti", "tj").agg(F.count("*").alias("n"), F.sum("q").cast("long").alias("sum_q"), F.max(F.abs(F.col("decoded") - F.col("value"))).alias("max_err"))


@query(_QUANTA + "\nSELECT count(*) AS n, CAST(sum(q) AS BIGINT) AS sum_q, max(abs(decoded - value)) AS max_err, max(abs(decoded - value)) <= 0.01e0 AS within FROM d")
def dequantize_error(spark, sf_dir):
    err = F.max(F.abs(F.col("decoded") - F.col("value")))
    return quant.quantize_tiles(r.r_emb(spark, sf_dir), 0.01).agg(F.count("*").alias("n"), F.sum("q").cast("long").alias("sum_q"), err.alias("max_err"), (err <= 0.01).alias("within"))


@query(_with("r_bands", "\nSELECT band, row, col, value FROM r_bands WHERE band BETWEEN 1 AND 2 AND valid"))
def slice_band(spark, sf_dir):
    return layout.bands(r.r_bands(spark, sf_dir), 1, 2).where("valid").select("band", "row", "col", "value")


@query(_with("r_li r_li3", """
SELECT depth, row, col, (CAST(row AS BIGINT) * 514 + col) * 3 + depth AS interleaved,
       (CAST(depth AS BIGINT) * (SELECT max(row) + 1 FROM r_li3) + row) * 514 + col AS planar FROM r_li3"""))
def planar_swap(spark, sf_dir):
    p = r.r_li3(spark, sf_dir)
    size = p.groupBy().agg((F.max("row") + 1).alias("n_rows"))
    p = p.join(F.broadcast(size))  # one row
    return p.select("depth", "row", "col", layout.linear_index(514, 3).alias("interleaved"), layout.planar_index(F.col("n_rows"), 514).alias("planar"))


@query(_with("r_emb", "\nSELECT CAST(max(row) + 1 AS INTEGER) AS n_rows, CAST(max(col) + 1 AS INTEGER) AS n_cols, 1 AS n_depth FROM r_emb"))
def raster_extent(spark, sf_dir):
    return layout.extent(r.r_emb(spark, sf_dir)).drop("raster_id")


@query("SELECT CAST(vec_id AS INTEGER) AS row, CAST(floor(embedding[1] * 1000 + 0.5e0) AS BIGINT) AS up, CAST(floor(-CAST(embedding[1] AS DOUBLE) * 1000 + 0.5e0) AS BIGINT) AS down FROM embeddings")
def half_up_cast(spark, sf_dir):
    first = r.r_emb(spark, sf_dir).where("col = 0")
    up = lambda z: F.floor(z + 0.5)
    return first.select("row", up(F.col("value").cast("float") * F.lit(1000).cast("float")).alias("up"), up(-F.col("value") * 1000).alias("down"))


# ---- statistics -----------------------------------------------------------------------------------------

@query(_with("r_li r_li_dense", "\nSELECT count(*) FILTER (WHERE valid) AS n_valid, count(*) AS n FROM r_li_dense"))
def valid_count(spark, sf_dir):
    return stats.valid_counts(r.r_li_dense(spark, sf_dir))


@query(_with("r_li r_li3", "\nSELECT depth, min(value) AS z_min, max(value) AS z_max, count(*) AS n_valid FROM r_li3 GROUP BY depth"))
def range_by_depth(spark, sf_dir):
    return stats.ranges(r.r_li3(spark, sf_dir), "depth")


@query(_with("r_li r_li3", """
SELECT CASE WHEN grouping(depth) = 0 THEN 'depth' ELSE 'all' END AS level, CAST(depth AS INTEGER) AS depth, min(value) AS z_min, max(value) AS z_max, count(*) AS n_valid
FROM r_li3 GROUP BY ROLLUP (depth)"""))
def range_rollup(spark, sf_dir):
    out = stats.range_rollup(r.r_li3(spark, sf_dir)).where("raster_id is not null and (band is null or depth is not null)")
    return out.select(F.when(F.col("depth").isNotNull(), "depth").otherwise("all").alias("level"), "depth", "z_min", "z_max", "n_valid")


@query(_with("r_bands", "\nSELECT band, coalesce(min(value) FILTER (WHERE valid AND row > 20), -1e0) AS z_min, coalesce(max(value) FILTER (WHERE valid AND row > 20), -1e0) AS z_max, count(*) FILTER (WHERE valid AND row > 20) AS n_valid FROM r_bands GROUP BY band"))
def range_masked(spark, sf_dir):
    p = r.r_bands(spark, sf_dir).withColumn("valid", F.col("valid") & (F.col("row") > 20))
    return stats.masked_range(p, "band")


@query(_with("r_emb", f"\nSELECT CAST(ti AS INTEGER) AS ti, CAST(tj AS INTEGER) AS tj, n, z_min, z_max FROM ({_TILES.format('r_emb')})"))
def tile_stats(spark, sf_dir):
    return stats.tile_ranges(r.r_emb(spark, sf_dir)).select("ti", "tj", "n", "z_min", "z_max")


_SAME = """,
s AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY row // 8, col // 8 ORDER BY row, col) THEN 1 ELSE 0 END AS same FROM r_x),
t AS (SELECT row // 8 AS ti, col // 8 AS tj, count(*) AS n, min(value) AS z_min, max(value) AS z_max, CAST(sum(same) AS BIGINT) AS n_same FROM s GROUP BY 1, 2)
SELECT CAST(ti AS INTEGER) AS ti, CAST(tj AS INTEGER) AS tj, n, n_same, n > 4 AND z_max > z_min + 3 * 0.5e0 AND 2 * n_same > n AS try_table FROM t"""


def _coarse_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.r_part(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 20).cast("double"))


def _repeated_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of every seventh part, 40 elsewhere: long repeats."""
    return r.r_part(spark, sf_dir).withColumn("value", F.when((F.col("row") * 50 + F.col("col")) % 7 == 0, F.col("value")).otherwise(F.lit(40.0)))


_COARSE = r.with_rasters("r_part") + ",\nr_x AS (SELECT row, col, floor(value / 20) AS value FROM r_part)"
_REPEATED = r.with_rasters("r_part") + ",\nr_x AS (SELECT row, col, CASE WHEN (row * 50 + col) % 7 = 0 THEN value ELSE 40e0 END AS value FROM r_part)"


@query(_REPEATED + _SAME)
def tile_stats_repeat(spark, sf_dir):
    return stats.tile_stats(_repeated_part(spark, sf_dir), 8, 0.5).select("ti", "tj", "n", "n_same", "try_table")


@query(_COARSE + ",\nt AS (" + _TILES.format("r_x") + ")\nSELECT count(*) AS n, count(*) FILTER (WHERE z_min = z_max) AS n_constant FROM t")
def constant_tiles(spark, sf_dir):
    return stats.tile_ranges(_coarse_part(spark, sf_dir)).agg(F.count("*").alias("n"), F.count_if(F.expr("z_min = z_max")).alias("n_constant"))


@query(_with("r_li r_li3", "\nSELECT depth, min(value) = max(value) AS constant FROM r_li3 GROUP BY depth"))
def constant_depths(spark, sf_dir):
    return stats.constant_planes(r.r_li3(spark, sf_dir)).select("depth", "constant")


@query(_with("r_evt r_part", """
SELECT 'r_evt' AS raster_id, bool_and(value = floor(value + 0.5e0)) AS all_int, count(*) FILTER (WHERE value <> floor(value + 0.5e0)) AS n_fractions FROM r_evt
UNION ALL SELECT 'r_part', bool_and(value = floor(value + 0.5e0)), count(*) FILTER (WHERE value <> floor(value + 0.5e0)) FROM r_part"""))
def all_integer_check(spark, sf_dir):
    return stats.integrality(r.r_evt(spark, sf_dir).union(r.r_part(spark, sf_dir)), "raster_id")


@query(_with("r_li r_li3", "\nSELECT min(value) AS z_min, max(value) AS z_max, count(DISTINCT depth) AS n_depth, min(value) FILTER (WHERE depth = 2) AS min_last FROM r_li3"))
def band_statistics(spark, sf_dir):
    b = stats.band_statistics(r.r_li3(spark, sf_dir))
    return b.select("z_min", "z_max", F.size("by_depth").cast("long").alias("n_depth"), F.element_at("by_depth", -1)["z_min"].alias("min_last"))


# ---- validity -------------------------------------------------------------------------------------------

@query(_with("r_li r_li_dense", "\nSELECT row, count(*) AS n FROM r_li_dense WHERE valid GROUP BY row"))
def mask_filter(spark, sf_dir):
    return validity.only_valid(r.r_li_dense(spark, sf_dir)).groupBy("row").agg(F.count("*").alias("n"))


@query(_with("r_evt", "\nSELECT row, count(*) FILTER (WHERE value < 1000 AND col % 9 <> 0) AS n_valid, count(*) AS n FROM r_evt GROUP BY row").replace("value < 1000 AND ", ""))
def nan_to_mask(spark, sf_dir):
    p = r.r_evt(spark, sf_dir).withColumn("value", F.when(F.col("col") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return validity.nan_to_mask(p).groupBy("row").agg(F.count_if("valid").alias("n_valid"), F.count("*").alias("n"))


_BAD = r.with_rasters("r_li", "r_li3") + """,
c AS (SELECT row, col, count(*) AS n_all, count(*) FILTER (WHERE value = -9999) AS n_bad FROM (
  SELECT row, col, depth, CASE WHEN (row + col) % 5 = 0 THEN -9999e0 ELSE value END AS value FROM r_li3) GROUP BY row, col)"""


def _li3_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.r_li3(spark, sf_dir).withColumn("value", F.when((F.col("row") + F.col("col")) % 5 == 0, F.lit(-9999.0)).otherwise(F.col("value")))


@query(_BAD + "\nSELECT row, count(*) FILTER (WHERE n_bad < n_all) AS n_valid, count(*) FILTER (WHERE n_bad = n_all) AS n_masked FROM c GROUP BY row")
def nodata_to_mask(spark, sf_dir):
    p = validity.promote_no_data(_li3_with_gaps(spark, sf_dir), -9999.0).where("depth = 0")
    return p.groupBy("row").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_masked"))


@query(_BAD + "\nSELECT row, col, n_bad FROM c WHERE n_bad > 0 AND n_bad < n_all")
def mixed_pixels(spark, sf_dir):
    return validity.count_bad(_li3_with_gaps(spark, sf_dir), -9999.0).where("n_bad > 0 and n_bad < n_depth").select("row", "col", "n_bad")


@query(_with("r_li r_li3", """,
z AS (SELECT min(value) AS lo, max(value) AS hi FROM r_li3 WHERE value <> -9999)
SELECT CAST(x.e AS DOUBLE) AS e, CAST(x.nd AS DOUBLE) AS no_data, x.nd BETWEEN lo - floor(x.e) AND hi + floor(x.e) AS lossless_int, x.nd BETWEEN lo - 2 * x.e AND hi + 2 * x.e AS lossless_float
FROM z, (VALUES (0.5e0, -9999e0), (3e0, -1e0), (1e0, -1e0), (0.4e0, 0.5e0)) x(e, nd)"""))
def nodata_distance_check(spark, sf_dir):
    z = r.r_li3(spark, sf_dir).where("value <> -9999").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    tries = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(n).alias("no_data")) for e, n in ((0.5, -9999.0), (3.0, -1.0), (1.0, -1.0), (0.4, 0.5))])
    z = z.withColumn("x", F.explode(tries)).select("lo", "hi", "x.*")
    near = lambda whole: validity.distance_check(F.col("lo"), F.col("hi"), F.col("no_data"), F.col("e"), F.lit(whole))
    return z.select("e", "no_data", near(True).alias("lossless_int"), near(False).alias("lossless_float"))


@query(_with("r_li r_li3", """,
z AS (SELECT min(value) AS lo FROM r_li3 WHERE value <> -9999),
s AS (SELECT max(c) AS stand_in FROM (SELECT lo, unnest([lo - 4 * 0.5e0, lo - 1, lo - 10, lo - 100, lo - 1000, lo - 10000, floor(CASE WHEN lo > 0 THEN lo / 2 ELSE lo * 2 END)]) AS c FROM z)
  WHERE c < lo - 2 * 0.5e0 AND c > -9007199254740992e0 AND c = floor(c))
SELECT depth, s.stand_in, count(*) FILTER (WHERE value = -9999) AS n_remapped, min(CASE WHEN value = -9999 THEN s.stand_in ELSE value END) AS z_min FROM r_li3, s GROUP BY depth, s.stand_in"""))
def nodata_remap(spark, sf_dir):
    p = r.r_li3(spark, sf_dir)
    low = p.where("value <> -9999").agg(F.min("value").alias("lo"))
    new = low.select(validity.stand_in(F.col("lo"), F.lit(0.5), True, -float(1 << 53)).alias("stand_in"))
    q = p.withColumn("was", F.col("value") == -9999).join(F.broadcast(new))  # one row
    q = validity.remap(q, -9999.0, F.col("stand_in"))
    return q.groupBy("depth", "stand_in").agg(F.count_if("was").alias("n_remapped"), F.min("value").alias("z_min"))


_UNION = r.with_rasters("r_bands") + ",\nm AS (SELECT row, col, bool_and(valid OR (row + col + band) % 3 <> 0) AS valid FROM r_bands GROUP BY row, col)"


@query(_UNION + "\nSELECT row, count(*) FILTER (WHERE valid) AS n_valid FROM m GROUP BY row")
def mask_union(spark, sf_dir):
    p = r.r_bands(spark, sf_dir).withColumn("valid", F.col("valid") | ((F.col("row") + F.col("col") + F.col("band")) % 3 != 0))
    return validity.unified_mask(p).groupBy("row").agg(F.count_if("valid").alias("n_valid"))


@query(_with("r_bands", """,
m AS (SELECT row, col, CASE WHEN band = 2 THEN 1 ELSE band END AS like_band, band FROM r_bands),
v AS (SELECT m.band, m.row, m.col, b.valid FROM m JOIN r_bands b ON b.band = m.like_band AND b.row = m.row AND b.col = m.col)
SELECT b.band, bool_or(a.valid <> b.valid) AS differs FROM v a JOIN v b ON b.band = a.band + 1 AND a.row = b.row AND a.col = b.col GROUP BY b.band"""))
def masks_differ(spark, sf_dir):
    p = r.r_bands(spark, sf_dir)
    twin = p.where("band = 1").withColumn("band", F.lit(2))
    return validity.masks_differ(p.where("band <> 2").union(twin)).select("band", "differs")


@query(_with("r_li r_li_dense", "\nSELECT row, count(*) FILTER (WHERE NOT valid) AS n_filled, min(CASE WHEN valid THEN value ELSE -9999e0 END) AS z_min FROM r_li_dense GROUP BY row"))
def fill_nodata(spark, sf_dir):
    p = validity.fill_no_data(r.r_li_dense(spark, sf_dir), -9999, dtypes.FLOAT32)
    return p.groupBy("row").agg(F.count_if(~F.col("valid")).alias("n_filled"), F.min("value").alias("z_min"))


@query("SELECT dtype, CAST(z AS DOUBLE) AS z, z BETWEEN lo AND hi AS ok FROM (VALUES (0, -128e0, 127e0), (1, 0e0, 255e0), (2, -32768e0, 32767e0), (3, 0e0, 65535e0), (4, -2147483648e0, 2147483647e0), (5, 0e0, 4294967295e0)) t(dtype, lo, hi), (VALUES (-1e0), (0e0), (128e0), (65535e0), (65536e0), (4294967296e0)) v(z)")
def type_range_check(spark, sf_dir):
    z = F.explode(F.array(*[F.lit(x) for x in (-1.0, 0.0, 128.0, 65535.0, 65536.0, 4294967296.0)])).alias("z")
    codes = spark.range(6).select(F.col("id").cast("int").alias("dtype"), z)
    return codes.select("dtype", "z", validity.in_type_range(F.col("z"), F.col("dtype")).alias("ok"))


# ---- error rules ----------------------------------------------------------------------------------------

@query("SELECT CAST(dtype AS INTEGER) AS dtype, CAST(e AS DOUBLE) AS e, CASE WHEN dtype < 6 THEN greatest(0.5e0, floor(e)) ELSE e END AS normalized FROM range(8) t(dtype), (VALUES (0e0), (0.3e0), (0.5e0), (1.7e0), (12e0)) v(e)")
def error_normalize(spark, sf_dir):
    e = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.3, 0.5, 1.7, 12.0)])).alias("e")
    return spark.range(8).select(F.col("id").cast("int").alias("dtype"), e).withColumn("normalized", quant.normalized(F.col("e"), F.col("dtype")))


_FACTORS = "(VALUES (1e0, 1e0), (0.5e0, 2e0), (0.1e0, 10e0), (0.05e0, 20e0), (0.01e0, 100e0), (0.005e0, 200e0), (0.001e0, 1000e0), (0.0005e0, 2000e0), (0.0001e0, 10000e0)) f(step, fac)"


@query(_with("r_evt", f""",
w AS (SELECT step, max(abs(floor(value * fac + 0.5e0) - value * fac)) / any_value(fac) AS worst FROM r_evt, {_FACTORS} WHERE step / 2 > 0.004e0 GROUP BY step)
SELECT coalesce(max(step / 2) FILTER (WHERE worst <= 0.004e0 / 2), 0.004e0) AS raised FROM w"""))
def raise_error(spark, sf_dir):
    return quant.raise_error(r.r_evt(spark, sf_dir), 0.004)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r_li's quantities, with r_evt-like noise in the low bits: sums of quantities are integers already."""
    return r.r_li(spark, sf_dir)


_FLIPS = r.with_rasters("r_li") + """,
p AS (
  SELECT xor(CAST(a.value AS BIGINT), CAST(b.value AS BIGINT)) AS x FROM r_li a JOIN r_li b ON (b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col)),
f AS (SELECT CAST(bit AS INTEGER) AS bit, count(*) AS n_pairs, CAST(sum((x >> bit) & 1) AS BIGINT) AS n_flips FROM p, range(16) b(bit) GROUP BY bit)"""


@query(_FLIPS + "\nSELECT * FROM f")
def bitplane_flips(spark, sf_dir):
    return quant.bitplane_flips(_counts(spark, sf_dir), 16).select("bit", "n_pairs", "n_flips")


@query(_FLIPS + "\nSELECT bit, n_pairs, abs(1 - 2 * n_flips / CAST(n_pairs AS DOUBLE)) < 0.1e0 AS noisy FROM f")
def noise_planes(spark, sf_dir):
    f = quant.bitplane_flips(_counts(spark, sf_dir), 16)
    return f.select("bit", "n_pairs", (F.abs(1 - 2 * F.col("n_flips") / F.col("n_pairs")) < 0.1).alias("noisy"))


@query()
def noise_error(spark, sf_dir):
    return quant.noise_error(quant.bitplane_flips(_counts(spark, sf_dir), 16), 0.1)


# ---- sizes ----------------------------------------------------------------------------------------------

@query("SELECT CAST(v AS INTEGER) AS version, CAST(s AS INTEGER) AS bytes FROM (VALUES (2, 58), (3, 62), (4, 66), (5, 66), (6, 90)) t(v, s)")
def header_size(spark, sf_dir):
    sizes = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(cost.header_size(v)).alias("bytes")) for v in range(2, 7)])
    return spark.range(1).select(F.explode(sizes).alias("x")).select("x.*")


@query("SELECT x, CASE WHEN x = 0 THEN 0 ELSE CAST(length(bin(x)) AS INTEGER) END AS bits, CASE WHEN x < 256 THEN 1 WHEN x < 65536 THEN 2 ELSE 4 END AS count_bytes FROM (SELECT DISTINCT p_partkey * p_size AS x FROM part)")
def bits_needed(spark, sf_dir):
    x = r.table(spark, sf_dir, "part").select((F.col("p_partkey") * F.col("p_size")).alias("x")).distinct()
    return x.select("x", cost.bits_needed(F.col("x")).alias("bits"), cost.count_bytes(F.col("x")).alias("count_bytes"))


@query(_with("r_li r_evt", """,
z AS (SELECT value AS z FROM r_li UNION SELECT value FROM r_evt UNION SELECT -value FROM r_li UNION SELECT value * 100000 FROM r_li)
SELECT z, CASE WHEN z = floor(z) AND z BETWEEN 0 AND 255 THEN 1 WHEN z = floor(z) AND z BETWEEN -32768 AND 32767 THEN 2 ELSE 4 END AS as_float,
       CASE WHEN z = floor(z) AND z BETWEEN -32768 AND 32767 THEN 2 WHEN z = floor(z) AND z BETWEEN -2147483648e0 AND 2147483647e0 THEN 4 WHEN CAST(CAST(z AS FLOAT) AS DOUBLE) = z THEN 4 ELSE 8 END AS as_double,
       CASE WHEN z <> floor(z) THEN 4 WHEN z BETWEEN 0 AND 255 THEN 1 WHEN z BETWEEN -32768 AND 65535 THEN 2 ELSE 4 END AS as_int FROM z"""))
def offset_narrowing(spark, sf_dir):
    a, b = r.r_li(spark, sf_dir).select(F.col("value").alias("z")), r.r_evt(spark, sf_dir).select(F.col("value").alias("z"))
    z = a.union(b).union(a.select(-F.col("z"))).union(a.select(F.col("z") * 100000)).distinct()
    return z.select("z", *[cost.offset_size(F.col("z"), c).alias(n) for c, n in ((dtypes.FLOAT32, "as_float"), (dtypes.FLOAT64, "as_double"), (dtypes.INT32, "as_int"))])


def _cost_sql(item: int, e: str, limit: int, offset: str, quantum: str, with_mode: bool = True) -> str:
    top = f"(z_max - z_min) * (1e0 / (2 * {e}))"
    bits = lambda x: f"(CASE WHEN {x} = 0 THEN 0 ELSE length(bin(CAST({x} AS BIGINT))) END)"
    cnt = "(CASE WHEN n < 256 THEN 1 WHEN n < 65536 THEN 2 ELSE 4 END)"
    plain = f"(1 + {cnt} + (n * {bits('most')} + 7) // 8)"
    table = f"(2 + {cnt} + (distinct_q * {bits('top_q')} + 7) // 8 + (n * {bits('distinct_q')} + 7) // 8)"
    return f""",
x AS (SELECT *, row // 8 AS ti, col // 8 AS tj, min(value) OVER (PARTITION BY row // 8, col // 8) AS low,
  CASE WHEN value = lag(value) OVER (PARTITION BY row // 8, col // 8 ORDER BY row, col) THEN 1 ELSE 0 END AS same FROM r_x),
s AS (SELECT ti, tj, count(*) AS n, min(value) AS z_min, max(value) AS z_max, sum(same) AS n_same, count(DISTINCT {quantum}) - 1 AS distinct_q, max({quantum}) AS top_q FROM x GROUP BY ti, tj),
c AS (SELECT *, floor({top} + 0.5e0) AS most, 1 + n * {item} AS raw, {top} > {limit} AS must FROM s),
d AS (SELECT *, n > 4 AND z_max > z_min + 3 * {e} AND 2 * n_same > n AND distinct_q BETWEEN 1 AND 254 AND {table} < {plain} AS use_table,
  1 + {offset} + CASE WHEN most > 0 THEN {plain} ELSE 0 END AS plain_total, 1 + {offset} + {table} AS table_total FROM c),
m AS (SELECT *, CASE WHEN use_table AND most > 0 THEN table_total ELSE plain_total END AS coded FROM d),
o AS (SELECT CAST(ti AS INTEGER) AS ti, CAST(tj AS INTEGER) AS tj,
  CASE WHEN z_min = 0 AND z_max = 0 THEN 'zero' WHEN must OR coded >= raw THEN 'raw' WHEN most = 0 THEN 'constant' WHEN use_table THEN 'table' ELSE 'packed' END AS mode,
  CAST(CASE WHEN z_min = 0 AND z_max = 0 THEN 1 WHEN must OR coded >= raw THEN raw ELSE coded END AS BIGINT) AS bytes FROM m)
"""


_FLOAT_OFFSET = "(CASE WHEN z_min = floor(z_min) AND z_min BETWEEN 0 AND 255 THEN 1 WHEN z_min = floor(z_min) AND z_min BETWEEN -32768 AND 32767 THEN 2 ELSE 4 END)"
_EMB_COST = r.with_rasters("r_emb") + ",\nr_x AS (SELECT * FROM r_emb)" + _cost_sql(4, "0.01e0", (1 << 30) - 1, _FLOAT_OFFSET, "floor((value - low) * (1e0 / (2 * 0.01e0)) + 0.5e0)")
_BYTE_COST = _cost_sql(1, "0.5e0", (1 << 15) - 1, "1", "CAST(value - low AS BIGINT)")


@query(_EMB_COST + "SELECT * FROM o")
def tile_cost_simple(spark, sf_dir):
    return cost.tile_costs(r.r_emb(spark, sf_dir), dtypes.FLOAT32, 0.01).select("ti", "tj", "mode", "bytes")


@query(_REPEATED + _BYTE_COST + "SELECT * FROM o")
def tile_cost_lut(spark, sf_dir):
    return cost.tile_costs(_repeated_part(spark, sf_dir), dtypes.UINT8, 0.5).select("ti", "tj", "mode", "bytes")


@query(_COARSE + _BYTE_COST + "SELECT mode, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM o GROUP BY mode")
def tile_mode(spark, sf_dir):
    return cost.tile_costs(_coarse_part(spark, sf_dir), dtypes.UINT8, 0.5).groupBy("mode").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


_WIDE = _BYTE_COST.replace("// 8 AS t", "// 16 AS t").replace("PARTITION BY row // 8, col // 8", "PARTITION BY row // 16, col // 16")


@query("SELECT a.bytes_8, b.bytes_16, CASE WHEN a.bytes_8 * 8 < 1.5e0 * c.cells AND a.bytes_8 < 4 * c.n AND c.big AND b.bytes_16 <= a.bytes_8 THEN 16 ELSE 8 END AS block FROM ("
       + _COARSE + _BYTE_COST + "SELECT CAST(sum(bytes) AS BIGINT) AS bytes_8 FROM o) a, (" + _COARSE + _WIDE + "SELECT CAST(sum(bytes) AS BIGINT) AS bytes_16 FROM o) b, ("
       + _COARSE + " SELECT count(*) AS n, (max(row) + 1) * (max(col) + 1) AS cells, greatest(max(row), max(col)) >= 8 AS big FROM r_x) c")
def block_size_choice(spark, sf_dir):
    return cost.choose_block(_coarse_part(spark, sf_dir), dtypes.UINT8, 0.5).drop("raster_id", "band")


@query()
def depth_delta_cost(spark, sf_dir):
    """By depth, bytes of values, of the better of values and differences (held against the encoder in the tests)."""
    p = r.r_li3(spark, sf_dir).withColumn("value", F.when(F.col("value") < 0, F.lit(0.0)).otherwise(F.col("value")))
    return cost.depth_delta_costs(p, dtypes.INT32).groupBy("depth").agg(F.sum("plain").alias("plain"), F.sum("bytes").alias("bytes"))


@query("SELECT tiles, codes, raw, flagged, planes, CASE WHEN raw <= (CASE WHEN (planes AND codes < tiles * 0.9e0) OR (NOT planes AND codes < tiles) THEN codes ELSE tiles END) + CASE WHEN flagged THEN 1 ELSE 0 END THEN 'sweep' WHEN (planes AND codes < tiles * 0.9e0) OR (NOT planes AND codes < tiles) THEN 'codes' ELSE 'tiles' END AS mode FROM (SELECT DISTINCT p_partkey % 17 + 90 AS tiles, p_partkey % 13 + 85 AS codes, p_size + 60 AS raw, p_size % 2 = 0 AS flagged, p_size % 3 = 0 AS planes FROM part)")
def band_mode(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    p = r.table(spark, sf_dir, "part").select((k % 17 + 90).alias("tiles"), (k % 13 + 85).alias("codes"), (s + 60).alias("raw"), (s % 2 == 0).alias("flagged"), (s % 3 == 0).alias("planes")).distinct()
    return p.withColumn("mode", cost.band_mode(F.col("tiles"), F.col("codes"), F.col("raw"), F.col("flagged"), F.col("planes")))


@query(_with("r_li r_li_dense", """,
t AS (SELECT row // 8 AS ti, col // 8 AS tj, bool_or(valid AND col % 64 < 40) AS has FROM r_li_dense GROUP BY 1, 2)
SELECT CAST(count(*) FILTER (WHERE NOT has) AS BIGINT) AS bytes FROM t"""))
def empty_tiles(spark, sf_dir):
    p = r.r_li_dense(spark, sf_dir).withColumn("valid", F.col("valid") & (F.col("col") % 64 < 40))
    return cost.empty_tile_bytes(p).select("bytes")


# ---- neighbours, histograms, runs ------------------------------------------------------------------------

@query(_with("r_part", """
SELECT a.row, a.col, CAST((a.value - coalesce(l.value, u.value, 0) + 256) AS BIGINT) % 256 AS delta
FROM r_part a LEFT JOIN r_part l ON l.row = a.row AND l.col = a.col - 1 LEFT JOIN r_part u ON u.row = a.row - 1 AND u.col = a.col"""))
def delta_left_up(spark, sf_dir):
    return neighbors.neighbour_delta(r.r_part(spark, sf_dir)).select("row", "col", neighbors.byte_delta(F.col("delta")).alias("delta"))


@query(_with("r_li", """,
v AS (SELECT row, col, value, lag(value) OVER (ORDER BY row, col) AS last FROM r_li)
SELECT a.row, a.col, a.value - coalesce(l.value, u.value, a.last, 0e0) AS delta
FROM v a LEFT JOIN r_li l ON l.row = a.row AND l.col = a.col - 1 LEFT JOIN r_li u ON u.row = a.row - 1 AND u.col = a.col"""))
def delta_masked(spark, sf_dir):
    return neighbors.neighbour_delta(r.r_li(spark, sf_dir)).select("row", "col", "delta")


@query(_with("r_li r_li3", "\nSELECT depth, CAST(sum(delta) AS BIGINT) AS total, min(delta) AS lo, max(delta) AS hi FROM (SELECT depth, value - lag(value) OVER (PARTITION BY row, col ORDER BY depth) AS delta FROM r_li3) WHERE depth > 0 GROUP BY depth"))
def depth_delta(spark, sf_dir):
    d = neighbors.depth_delta(r.r_li3(spark, sf_dir)).where("depth > 0")
    return d.groupBy("depth").agg(F.sum("delta").cast("long").alias("total"), F.min("delta").alias("lo"), F.max("delta").alias("hi"))


def _bytes_of_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.table(spark, sf_dir, "part").select(F.expr("p_partkey div 50").alias("s"), F.expr("p_partkey % 50").alias("k"), F.expr("p_partkey * p_size % 256").alias("b"))


_BYTES = """WITH p AS (SELECT p_partkey // 50 AS s, p_partkey % 50 AS k, p_partkey * p_size % 256 AS b FROM part),
d1 AS (SELECT s, k, CASE WHEN k < 1 THEN b ELSE (b - lag(b) OVER w + 256) % 256 END AS b FROM p WINDOW w AS (PARTITION BY s ORDER BY k)),
d2 AS (SELECT s, k, CASE WHEN k < 2 THEN b ELSE (b - lag(b) OVER w + 256) % 256 END AS b FROM d1 WINDOW w AS (PARTITION BY s ORDER BY k))"""


@query(_BYTES + "\nSELECT s, k, b FROM d2")
def byte_derivative(spark, sf_dir):
    return neighbors.byte_derivative(_bytes_of_part(spark, sf_dir), 2, ["s"])


@query("SELECT p_partkey // 50 AS s, p_partkey % 50 AS k, p_partkey * p_size % 256 AS b FROM part")
def prefix_restore(spark, sf_dir):
    return neighbors.restore_bytes(neighbors.byte_derivative(_bytes_of_part(spark, sf_dir), 2, ["s"]), 2, ["s"])


@query(_with("r_part", "\nSELECT CAST(value AS BIGINT) AS value, count(*) AS n FROM r_part GROUP BY 1"))
def value_histogram(spark, sf_dir):
    return neighbors.histogram(r.r_part(spark, sf_dir).select(*_long("value")), "value")


@query(_with("r_part", """,
d AS (SELECT CAST((a.value - coalesce(l.value, u.value, 0) + 256) AS BIGINT) % 256 AS delta
  FROM r_part a LEFT JOIN r_part l ON l.row = a.row AND l.col = a.col - 1 LEFT JOIN r_part u ON u.row = a.row - 1 AND u.col = a.col)
SELECT delta, count(*) AS n FROM d GROUP BY delta"""))
def delta_histogram(spark, sf_dir):
    d = neighbors.neighbour_delta(r.r_part(spark, sf_dir)).select(neighbors.byte_delta(F.col("delta")).alias("delta"))
    return neighbors.histogram(d, "delta")


@query("""WITH p AS (SELECT p_partkey * p_size % 256 AS b FROM part WHERE p_partkey % 7 = 0), h AS (SELECT b, count(*) AS n FROM p GROUP BY b),
t AS (SELECT *, sum(n) OVER () AS total FROM h)
SELECT CAST(floor(floor(sum(n * log2(total / CAST(n AS DOUBLE))) + 7 + 1e-9) / 8) AS BIGINT) AS bytes, CAST(sum(n) AS BIGINT) AS n FROM t""")
def entropy_size(spark, sf_dir):
    p = r.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr("p_partkey * p_size % 256").alias("b"), F.lit(0).alias("plane"))
    return neighbors.entropy_bytes(p, "b", "k", "plane").drop("plane")


@query(_with("r_li r_li_dense", """,
n AS (SELECT *, CASE WHEN valid = lag(valid) OVER (PARTITION BY row ORDER BY col) THEN 0 ELSE 1 END AS new FROM r_li_dense),
g AS (SELECT *, sum(new) OVER (PARTITION BY row ORDER BY col) AS run FROM n)
SELECT row, min(col) AS col, any_value(valid) AS valid, count(*) AS length FROM g GROUP BY row, run"""))
def mask_runs(spark, sf_dir):
    return neighbors.runs(r.r_li_dense(spark, sf_dir)).select("row", "col", "valid", "length")


@query(_COARSE + "\nSELECT row, col, dense_rank() OVER (PARTITION BY row // 8, col // 8 ORDER BY value) - 1 AS index FROM r_x")
def lut_index(spark, sf_dir):
    t = neighbors.table_index(layout.tiled(_coarse_part(spark, sf_dir)), "value")
    return t.select("row", "col", F.col("index").cast("long").alias("index"))


@query("SELECT s_suppkey, CASE WHEN a <= b AND a <= c THEN 'a' WHEN b <= c THEN 'b' ELSE 'c' END AS best FROM (SELECT s_suppkey, s_suppkey % 5 AS a, s_suppkey % 7 AS b, s_suppkey % 3 AS c FROM supplier)")
def best_strategy(spark, sf_dir):
    s, k = r.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select("s_suppkey", neighbors.best_strategy(("a", k % 5), ("b", k % 7), ("c", k % 3)).alias("best"))


# ---- comparison -----------------------------------------------------------------------------------------

@query(_with("r_li", """
SELECT max(abs(a.value - b.value)) FILTER (WHERE a.row IS NOT NULL AND b.row IS NOT NULL) AS max_diff,
       count(*) FILTER (WHERE a.row IS NOT NULL AND b.row IS NOT NULL) AS n_both, count(*) FILTER (WHERE a.row IS NULL OR b.row IS NULL) AS n_one
FROM r_li a FULL JOIN (SELECT row, col, value + (row + col) % 4 AS value FROM r_li WHERE col % 11 <> 0) b ON a.row = b.row AND a.col = b.col"""))
def raster_diff(spark, sf_dir):
    a = r.r_li(spark, sf_dir)
    b = a.withColumn("value", F.col("value") + (F.col("row") + F.col("col")) % 4).where("col % 11 <> 0")
    return compare.max_difference(a, b)


@query(_with("r_part", "\nSELECT 'one' AS side, count(*) AS n FROM r_part WHERE value = 7 UNION ALL SELECT 'two', count(*) FROM r_part WHERE value = 7"))
def raster_unequal(spark, sf_dir):
    a = r.r_part(spark, sf_dir)
    b = a.withColumn("value", F.when(F.col("value") == 7, F.lit(-7.0)).otherwise(F.col("value")))
    return compare.unequal(a, b).groupBy("side").agg(F.count("*").alias("n"))


# ---- codec ----------------------------------------------------------------------------------------------

#: Rows of a raster that go into one blob, so that no blob grows with the table.
STRIP = 256


def strips(pix: DataFrame) -> DataFrame:
    """A raster cut into strips of STRIP rows, each a raster of its own, counting from 0."""
    base = F.expr(f"row div {STRIP}")
    return pix.withColumns({"raster_id": F.concat_ws("/", "raster_id", base.cast("string")), "row": (F.col("row") % STRIP).cast("int")})


def _from_first_col(pix: DataFrame, first: int) -> DataFrame:
    return pix.withColumn("col", F.col("col") - first)


@query(_with("r_emb", "\nSELECT max(dtype) AS dtype, count(*) AS n, true AS within FROM (SELECT 6 AS dtype FROM r_emb)"))
def roundtrip_within_bound(spark, sf_dir):
    p = strips(r.r_emb(spark, sf_dir))
    d = codec.decode_pixels(codec.encode_pixels(p, dtypes.FLOAT32, 0.01))
    m = compare.max_difference(p, d)
    return m.select(F.lit(6).alias("dtype"), F.col("n_both").alias("n"), ((F.col("max_diff") <= 0.01 * 1.1) & (F.col("n_one") == 0)).alias("within"))


_EMB_WIDE = _EMB_COST.replace("// 8 AS t", "// 16 AS t").replace("PARTITION BY row // 8, col // 8", "PARTITION BY row // 16, col // 16")


@query("SELECT 'r_emb/' || a.strip AS raster_id, 0 AS band, c.sweep, a.tiles_8, CASE WHEN c.low_rate THEN b.tiles_16 ELSE 0 END AS tiles_16, "
       "CAST(103 + least(c.sweep, CASE WHEN c.low_rate AND b.tiles_16 <= a.tiles_8 THEN b.tiles_16 ELSE a.tiles_8 END) AS BIGINT) AS n_bytes FROM ("
       + _EMB_COST + "SELECT ti // 32 AS strip, CAST(sum(bytes) AS BIGINT) AS tiles_8 FROM o GROUP BY 1) a JOIN ("
       + _EMB_WIDE + "SELECT ti // 16 AS strip, CAST(sum(bytes) AS BIGINT) AS tiles_16 FROM o GROUP BY 1) b ON a.strip = b.strip JOIN ("
       + _EMB_COST + "SELECT d.strip, 4 * d.n AS sweep, e.t * 8 < 1.5e0 * d.n AND e.t < 16 * d.n AS low_rate FROM (SELECT row // 256 AS strip, count(*) AS n FROM r_emb GROUP BY 1) d JOIN (SELECT ti // 32 AS strip, sum(bytes) AS t FROM o GROUP BY 1) e ON d.strip = e.strip) c ON a.strip = c.strip")
def encode_size(spark, sf_dir):
    """The size plan of a lossy raster: header, mask, ranges and flag take 103 bytes."""
    p = codec.plan_bands(strips(r.r_emb(spark, sf_dir)), dtypes.FLOAT32, 0.01)
    return p.select("raster_id", "band", "sweep", "tiles_8", "tiles_16", "n_bytes")


@query()
def band_plan(spark, sf_dir):
    """All forms of an 8-bit raster: tiles of both sizes, prefix codes, the sweep, the mask; and the one chosen."""
    return codec.plan_bands(strips(r.r_part(spark, sf_dir)), dtypes.UINT8, 0.5)


@query(_with("r_li", """,
s AS (SELECT row // 256 AS strip, row % 256 AS row, col - 156 AS col, value FROM r_li)
SELECT 'r_li/' || strip AS raster_id, CAST(max(row) + 1 AS INTEGER) AS n_rows, CAST(max(col) + 1 AS INTEGER) AS n_cols, count(*) AS n_valid, min(value) AS z_min, max(value) AS z_max FROM s GROUP BY strip"""))
def blob_info(spark, sf_dir):
    b = codec.encode_pixels(strips(_from_first_col(r.r_li(spark, sf_dir), r.FIRST_WEEK)), dtypes.INT32, 0.5)
    return codec.blob_info(b).select("raster_id", "n_rows", "n_cols", "n_valid", "z_min", "z_max")


@query(_with("r_li", """,
s AS (SELECT row // 256 AS strip, value, lines, top_line FROM r_li)
SELECT 'r_li3/' || strip AS raster_id, 0 AS band, d AS depth, min([value, lines, top_line][d + 1]) AS z_min, max([value, lines, top_line][d + 1]) AS z_max
FROM s, (SELECT CAST(unnest(range(3)) AS INTEGER) AS d) GROUP BY strip, d"""))
def data_ranges(spark, sf_dir):
    three = r.r_li3(spark, sf_dir)
    plain = r.r_li(spark, sf_dir).select(F.lit("r_li3").alias("raster_id"), "band", "row", "col", "depth", "value", "valid")
    p = three.where("depth > 0").union(plain)
    b = codec.encode_pixels(strips(_from_first_col(p, r.FIRST_WEEK)), dtypes.INT32, 0.5)
    return codec.data_ranges(b)


@query(_with("r_li", "\nSELECT row, col, value FROM r_li"))
def decode_roundtrip(spark, sf_dir):
    b = codec.encode_pixels(strips(_from_first_col(r.r_li(spark, sf_dir), r.FIRST_WEEK)), dtypes.INT32, 0.5)
    d = codec.decode_pixels(b, only_valid=True)
    strip = F.split("raster_id", "/")[1].cast("int")
    return d.select((strip * STRIP + F.col("row")).cast("int").alias("row"), (F.col("col") + r.FIRST_WEEK).cast("int").alias("col"), "value")


@query(_with("r_li r_li3", """,
v AS (SELECT row, col, depth, value FROM r_li3 WHERE value <> -9999) SELECT depth, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM v GROUP BY depth"""))
def mixed_roundtrip(spark, sf_dir):
    b = codec.encode_pixels(strips(_from_first_col(r.r_li3(spark, sf_dir), r.FIRST_WEEK)).withColumn("valid", F.col("value") != -9999), dtypes.INT32, 0.5, no_data=-9999.0)
    d = codec.decode_pixels(b, only_valid=True)
    return d.groupBy("depth").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))


@query(_with("r_bands", "\nSELECT band, count(*) AS n, CAST(sum(CAST(floor(value * 100 + 0.5e0) AS BIGINT)) AS BIGINT) AS cents FROM r_bands WHERE valid GROUP BY band"))
def bands_roundtrip(spark, sf_dir):
    b = codec.encode_pixels(strips(r.r_bands(spark, sf_dir)), dtypes.FLOAT64, 0.0)
    d = codec.decode_pixels(b, only_valid=True)
    return d.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5)).alias("cents"))


@query(_with("r_emb", "\nSELECT CAST(row // 256 AS INTEGER) AS strip, true AS ok FROM r_emb GROUP BY 1"))
def checksum_valid(spark, sf_dir):
    c = codec.checksums(codec.encode_pixels(strips(r.r_emb(spark, sf_dir)), dtypes.FLOAT32, 0.01))
    return c.select(F.split("raster_id", "/")[1].cast("int").alias("strip"), "ok")


@query(_with("r_emb", "\nSELECT row, col, value FROM r_emb"))
def float_lossless_roundtrip(spark, sf_dir):
    d = codec.decode_pixels(codec.encode_pixels(strips(r.r_emb(spark, sf_dir)), dtypes.FLOAT32, 0.0))
    strip = F.split("raster_id", "/")[1].cast("int")
    return d.select((strip * STRIP + F.col("row")).cast("int").alias("row"), "col", "value")


@query(_with("r_part", "\nSELECT CAST(v AS INTEGER) AS version, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM r_part, range(2, 7) t(v) GROUP BY v"))
def version_roundtrip(spark, sf_dir):
    p = strips(r.r_part(spark, sf_dir))
    out = None
    for v in range(2, 7):
        d = codec.decode_pixels(codec.encode_pixels(p, dtypes.UINT8, 0.5, version=v)).where("valid")
        d = d.agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))
        out = d if out is None else out.union(d)
    return out


@query("SELECT vec_id, true AS same FROM embeddings")
def arrays_roundtrip(spark, sf_dir):
    """Vectors as rasters of one row, lossless, by the array operator."""
    e = r.table(spark, sf_dir, "embeddings")
    size = F.size("embedding")
    a = e.select(F.col("vec_id").cast("string").alias("raster_id"), F.lit(1).alias("n_bands"), F.lit(1).alias("n_rows"), size.alias("n_cols"), F.lit(1).alias("n_depth"), F.lit(dtypes.FLOAT32).alias("dtype"), F.col("embedding").cast("array<double>").alias("values"), F.lit(None).cast("array<boolean>").alias("valid"), F.lit(None).cast("array<double>").alias("no_data"))
    d = codec.decode_pixels(codec.encode_arrays(a, 0.0, check=True))
    back = d.groupBy("raster_id").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("v"))
    both = e.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).join(back, F.col("vec_id").cast("string") == F.col("raster_id"))
    return both.select("vec_id", (F.col("v.value") == F.col("e")).alias("same"))


@query(_with("r_emb", "\nSELECT CAST(count(*) AS BIGINT) AS n, CAST(sum((CAST(abs(value) * 1000 AS BIGINT) * 2654435761) % 65536) AS BIGINT) AS total FROM r_emb").replace(", CAST(sum((CAST(abs(value) * 1000 AS BIGINT) * 2654435761) % 65536) AS BIGINT) AS total", ", true AS inverse"))
def float_bits_reorder(spark, sf_dir):
    """Exponent to the front, sign behind it, and back, over the floats' own bits (numpy on Arrow batches: SQL has no view of a float's bits)."""
    from ..functions import planes

    def run(batches):
        import pyarrow as pa

        for b in batches:
            u = b.column(0).to_numpy().astype(np.float32).view(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(planes.restore_order(planes.reorder(u)) == u)], ["same"])

    out = r.r_emb(spark, sf_dir).select("value").mapInArrow(run, "same boolean")
    return out.agg(F.count("*").alias("n"), F.bool_and("same").alias("inverse"))


