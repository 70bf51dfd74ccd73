"""The data source, streams, and the codec operators at their edges."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import container, dtypes
from gridloom.operators import codec, compare, layout, stats, validity
from gridloom.sources import blobs
from gridloom.streaming import codec as streams


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("grids")
    rng = np.random.default_rng(0)
    for k in range(6):
        a = (rng.random((1 + k % 2, 9, 11, 1)) * 10 + 100 * k).astype(np.float32)
        (at / f"g{k}.grid").write_bytes(container.encode(a, rng.random((9, 11)) < 0.8, 0.0))
    return str(at)


def test_headers(spark, folder):
    blobs.register(spark)
    h = spark.read.format("gridloom").load(folder)
    assert h.count() == 6 and h.where("n_bands = 2").count() == 3
    assert {r.raster_id for r in h.where("z_min >= 300").collect()} == {"g3", "g4", "g5"}
    assert h.where("raster_id = 'g2'").count() == 1


def test_pixels(spark, folder):
    blobs.register(spark)
    p = spark.read.format("gridloom").option("content", "pixel").load(folder)
    assert p.count() == 9 * 11 * (3 + 6)
    high = p.where("value > 450 and valid")
    assert {r.raster_id for r in high.select("raster_id").distinct().collect()} == {"g5"}
    fewer = spark.read.format("gridloom").option("content", "pixel").option("valuemin", 450).load(folder)
    assert {r.raster_id for r in fewer.select("raster_id").distinct().collect()} == {"g5"} and compare.unequal(fewer.where("value > 450 and valid"), high).count() == 0
    by_hand = codec.decode_pixels(spark.read.format("gridloom").option("content", "blob").load(folder))
    assert compare.unequal(p, by_hand).count() == 0


def test_write_and_read_back(spark, folder, tmp_path):
    blobs.register(spark)
    b = spark.read.format("gridloom").option("content", "blob").load(folder)
    out = str(tmp_path / "out")
    b.write.format("gridloom").option("path", out).mode("append").save()
    assert sorted(os.listdir(out)) == [f"g{k}.grid" for k in range(6)]
    again = spark.read.format("gridloom").option("content", "blob").load(out)
    assert again.exceptAll(b).count() == 0
    b.where("raster_id = 'g1'").write.format("gridloom").option("path", out).mode("overwrite").save()
    assert os.listdir(out) == ["g1.grid"]


def test_streams(spark, folder):
    for df, n in ((streams.header_stream(spark, folder), 6), (streams.pixel_stream(spark, folder, only_valid=True), None)):
        q = df.writeStream.format("memory").queryName("streamed").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        got = spark.table("streamed")
        assert got.count() == n if n else got.where("not valid").count() == 0 and got.count() > 300


def test_unreadable_blobs(spark):
    df = spark.createDataFrame([("a", b"nothing"), ("b", bytes(container.encode(np.ones((2, 2), np.uint8))))], "raster_id string, blob binary")
    assert codec.blob_info(df, strict=False).count() == 1 and codec.decode_pixels(df, strict=False).count() == 4
    with pytest.raises(Exception):
        codec.blob_info(df).collect()


def test_empty_tables_and_nan(spark):
    empty = spark.createDataFrame([], codec.PIXELS)
    assert codec.encode_pixels(empty, dtypes.FLOAT32).count() == 0
    assert stats.tile_stats(empty).count() == 0 and stats.masked_range(empty, "band").count() == 0
    rows = [("x", 0, i, j, 0, float("nan") if i == j else float(i), i != 1) for i in range(3) for j in range(3)]
    p = spark.createDataFrame(rows, codec.PIXELS)
    d = codec.decode_pixels(codec.encode_pixels(p, dtypes.FLOAT32)).where("valid")
    assert d.count() == 4
    assert validity.nan_to_mask(p).where("valid").count() == 4
    assert stats.masked_range(p.where("row = 1"), "row").first()["z_min"] == -1
    assert validity.has_nan(p, "raster_id").first()["has_nan"]


def test_size_only_and_check(spark):
    rows = [("a", 2, 2, 2, 1, dtypes.FLOAT64, [1.0, 2.5, float("nan"), 4.0, 1.0, 1.0, 1.0, 1.0], [True, True, True, False], None)]
    df = spark.createDataFrame(rows, "raster_id string, n_bands int, n_rows int, n_cols int, n_depth int, dtype int, values array<double>, valid array<boolean>, no_data array<double>")
    n = codec.encode_arrays(df, 0.1, size_only=True).first()["n_bytes"]
    b = codec.encode_arrays(df, 0.1, check=True).first()
    assert len(b["blob"]) == n and container.read_info(bytes(b["blob"])).n_valid == 2
    p = layout.explode_array(df.select("raster_id", F.lit(0).alias("band"), "values"), 2)
    assert p.where("not valid").count() == 1
    assert codec.split_bands(codec.encode_arrays(df, 0.1)).count() == 2


def test_replace_nan_and_stand_in(spark):
    rows = [("x", 0, 0, 0, d, v, True) for d, v in enumerate((float("nan"), 2.0))] + [("y", 0, 0, 0, 0, float("nan"), True)]
    out = {(r.raster_id, r.depth): r.value for r in validity.replace_nan(spark.createDataFrame(rows, codec.PIXELS), -9.0).collect()}
    assert out == {("x", 0): -9.0, ("x", 1): 2.0, ("y", 0): 0.0}
    z = spark.createDataFrame([(5.0,), (-3.0,)], "z double")
    got = [r[0] for r in z.select(validity.stand_in(F.col("z"), F.lit(0.01), False, -3e38)).collect()]
    assert got == [container.new_no_data(5.0, 0.01, False, dtypes.FLOAT64), container.new_no_data(-3.0, 0.01, False, dtypes.FLOAT64)]


def test_sink_escapes_ids_and_refuses_twins(spark, tmp_path):
    register = __import__("gridloom.sources.blobs", fromlist=["register"]).register
    register(spark)
    blob = bytearray(container.encode(np.arange(12, dtype="<i4").reshape(3, 4)))
    ids = ["r/0", "r/1", "..", ".x", "a%2Fb", "ü b", "c.grid"]
    df = spark.createDataFrame([(i, blob) for i in ids], "raster_id string, blob binary")
    at = str(tmp_path / "out")
    df.write.format("gridloom").mode("append").save(at)
    read = lambda: sorted(r.raster_id for r in spark.read.format("gridloom").load(at).collect())
    assert read() == sorted(ids)
    twins = spark.createDataFrame([("x", blob), ("x", blob)], "raster_id string, blob binary")
    with pytest.raises(Exception, match="two rows have the raster_id"):
        twins.write.format("gridloom").mode("overwrite").save(at)
    assert read() == sorted(ids) and not [p for p in (tmp_path / "out").iterdir() if p.name.endswith(".part")]
    df.where("raster_id = 'r/0'").write.format("gridloom").mode("overwrite").save(at)
    assert read() == ["r/0"]
