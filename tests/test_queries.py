"""Every registered reference query against its SQL, and those without SQL against the encoder."""

from __future__ import annotations

import numpy as np
import pytest
from compare import assert_same

from gridloom.functions import container, dtypes
from gridloom.operators import codec, cost, quant
from gridloom.plans import catalog, rasters


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, sf_dir, duck, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), duck.sql(catalog.ORACLE_SQL[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def _grid(pix):
    t = pix.toPandas()
    shape = [int(t[c].max()) + 1 for c in ("row", "col", "depth")]
    a, m = np.zeros(shape), np.zeros(shape[:2], bool)
    a[t.row, t.col, t.depth], m[t.row, t.col] = t.value, True
    return a, m


def _empty(spark, m, depth, block):
    dense = spark.createDataFrame([("x", 0, i, j, d, 0.0, bool(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) for d in range(depth)], codec.PIXELS)
    return cost.empty_tile_bytes(dense, block).first()["bytes"]


def test_tile_costs_equal_encoded_tiles(spark, sf_dir):
    for pix, code, e in [(rasters.r_emb(spark, sf_dir), dtypes.FLOAT32, 0.01), (catalog._repeated_part(spark, sf_dir), dtypes.UINT8, 0.5), (rasters.r_li(spark, sf_dir), dtypes.INT32, 2.0)]:
        a, m = _grid(pix)
        for block in (8, 16):
            h = container.Header(n_rows=a.shape[0], n_cols=a.shape[1], n_depth=1, dtype=code, max_error=e)
            size, _ = container.write_tiles(a.astype(dtypes.DTYPES[code]), m, h, block)
            assert cost.tile_costs(pix, code, e, block).agg({"bytes": "sum"}).first()[0] + _empty(spark, m, 1, block) == size


def test_depth_delta_cost_equals_encoded_tiles(spark, sf_dir):
    pix = rasters.r_li3(spark, sf_dir).selectExpr("raster_id", "band", "row", "col", "depth", "greatest(value, 0d) as value", "valid")
    a, m = _grid(pix)
    h = container.Header(n_rows=a.shape[0], n_cols=a.shape[1], n_depth=3, dtype=dtypes.INT32, max_error=0.5)
    size, _ = container.write_tiles(a.astype("<i4"), m, h, 8)
    assert cost.depth_delta_costs(pix, dtypes.INT32).agg({"bytes": "sum"}).first()[0] + _empty(spark, m, 3, 8) == size


@pytest.mark.parametrize("invalid", [0, 1, 700])
@pytest.mark.parametrize("depth", [1, 2])
def test_noise_error_agrees_with_encoder(spark, invalid, depth):
    rng = np.random.default_rng(5)
    a = (np.add.outer(np.arange(80), np.arange(90)) * 64 + rng.integers(0, 16, (80, 90))).astype("<i4")
    mask = np.ones(a.shape, bool)
    mask.ravel()[rng.choice(a.size - 1, invalid, replace=False)] = False  # not the last pixel, which gives the extent
    rows = [("x", 0, i, j, d, float(a[i, j] + d), bool(mask[i, j])) for i in range(80) for j in range(90) for d in range(depth)]
    pix = spark.createDataFrame(rows, codec.PIXELS)
    both = np.stack([a + d for d in range(depth)], axis=2)
    flips = quant.bitplane_flips(pix, 32)
    u = both.astype(np.int64)
    right, down = mask[:, 1:] & mask[:, :-1], mask[1:] & mask[:-1]
    n = 2 * 79 * 89 if depth == 1 and not invalid else int(right.sum() + down.sum())
    assert {r.n_pairs for r in flips.select("n_pairs").distinct().collect()} == {n}
    assert quant.noise_error(flips, 0.1).first()["error"] == container.noise_error(u.astype("<i4"), mask, 0.1) > 0


