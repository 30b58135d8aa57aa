"""Operators on tiles against those on cells, and against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relievo.operators import rasters as ra
from relievo.operators import tiles as ti

ROWS, COLS, SIZE = 37, 50, 16


@pytest.fixture(scope="module")
def band():
    rng = np.random.default_rng(6)
    val = rng.normal(1000, 50, (ROWS, COLS))
    val[rng.random((ROWS, COLS)) < 0.2] = np.nan
    val[16:32, 0:16] = np.nan  # a tile without data
    return val


@pytest.fixture(scope="module")
def cells(spark, band):
    rows = [(r, c, None if np.isnan(band[r, c]) else float(band[r, c])) for r in range(ROWS) for c in range(COLS)]
    return spark.createDataFrame(rows, "r int, c int, val double").repartition(3).cache()


@pytest.fixture(scope="module")
def tiles(cells):
    return ti.to_tiles(cells.where("val IS NOT NULL"), ROWS, COLS, tile=SIZE).cache()


def array(df, shape=(ROWS, COLS)):
    out = np.full(shape, -1.0)
    rows = df.collect()
    assert len(rows) == shape[0] * shape[1]
    for r in rows:
        out[r.r, r.c] = np.nan if r.val is None else r.val
    return out


def of(tiles, **how):
    return array(ti.to_cells(tiles, tile=SIZE, **how))


def test_there_and_back(tiles, band):
    assert tiles.count() == 12 and tiles.where("lo IS NULL").count() == 1
    assert np.array_equal(of(tiles), band, equal_nan=True)


@pytest.mark.parametrize("name", ["gap_fill", "median", "wiener"])
def test_tiles_equal_cells(cells, tiles, name):
    on_tiles = {"gap_fill": ti.gap_fill, "median": ti.median, "wiener": ti.wiener}[name](tiles, tile=SIZE)
    on_cells = {"gap_fill": ra.gap_fill, "median": ra.median3x3, "wiener": ra.wiener3x3}[name](cells)
    np.testing.assert_allclose(of(on_tiles), array(on_cells), rtol=1e-9)


def test_neighbours(cells, tiles):
    want = {(r.r, r.c): r for r in ra.neighbors8(cells).collect()}
    found = ti.neighbours(tiles, ra.AROUND, tile=SIZE)
    for name, _, _ in ra.AROUND:
        got = of(found.where(F.col("name") == name))
        assert all((np.isnan(got[k]) and r[name] is None) or got[k] == r[name] for k, r in want.items())


@pytest.mark.parametrize("size", [5, 9])
def test_windows_of_any_size(tiles, band, size):
    half = size // 2
    wide, bare = np.pad(band, half, mode="symmetric"), np.pad(band, half, constant_values=np.nan)
    medians, means = of(ti.median(tiles, size, tile=SIZE)), of(ti.box_mean(tiles, size, tile=SIZE))
    for r in range(ROWS):
        for c in range(COLS):
            assert np.isnan(medians[r, c]) if np.isnan(band[r, c]) else medians[r, c] == pytest.approx(np.nanmedian(wide[r : r + size, c : c + size]))
            box = bare[r : r + size, c : c + size]
            assert np.isnan(means[r, c]) if np.isnan(box).all() else means[r, c] == pytest.approx(np.nanmean(box), rel=1e-12)


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_resampled_tiles_equal_cells(spark, cells, tiles, method):
    turn = lambda r, c: (0.8 * r + 0.3 * c - 3.25, 0.9 * c - 0.25 * r + 2.5)
    shape = (41, 33)
    got = array(ti.to_cells(ti.resample(tiles, *shape, (ROWS, COLS), turn, method, tile=SIZE), tile=SIZE), shape)
    targets = spark.range(shape[0] * shape[1]).select((F.col("id") / shape[1]).cast("int").alias("r"), (F.col("id") % shape[1]).cast("int").alias("c"))
    want = array(ra.resample(cells, targets, *turn(F.col("r"), F.col("c")), method), shape)
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_a_plane_survives_resampling(spark):
    plane = spark.range(90 * 70).select((F.col("id") / 70).cast("int").alias("r"), (F.col("id") % 70).cast("int").alias("c")).withColumn("val", 3 * F.col("r") - 2.5 * F.col("c"))
    out = ti.to_cells(ti.resample(ti.to_tiles(plane, 90, 70, tile=SIZE), 60, 40, (90, 70), lambda r, c: (1.2 * r + 5, 1.1 * c + 9), tile=SIZE), tile=SIZE)
    assert all(abs(r.val - (3 * (1.2 * r.r + 5) - 2.5 * (1.1 * r.c + 9))) < 1e-8 for r in out.collect())


def test_keys_stay_apart_and_empty_rasters(spark, cells, band):
    two = cells.withColumn("key", F.lit("a")).unionByName(cells.withColumn("key", F.lit(None).cast("string")).withColumn("val", -F.col("val")))
    out = ti.to_cells(ti.median(ti.to_tiles(two, ROWS, COLS, ["key"], SIZE), 3, ["key"], SIZE), ["key"], SIZE)
    a, b = array(out.where("key = 'a'")), array(out.where("key IS NULL"))
    np.testing.assert_allclose(a, -b)
    assert ti.to_cells(ti.gap_fill(ti.to_tiles(cells, 0, 0))).count() == 0


def test_a_stencil_is_one_shuffle(spark, tmp_path, tiles):
    stored = ti.store(tiles, f"{tmp_path}/tiles")
    assert ti.median(stored, 5, tile=SIZE)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_stored_in_space_order(spark, tmp_path, tiles):
    stored = ti.store(tiles, f"{tmp_path}/tiles")
    assert np.array_equal(of(stored), of(tiles), equal_nan=True)
    z = {(r.ty, r.tx): r.z for r in tiles.select("ty", "tx", ti.curve(F.col("ty"), F.col("tx")).alias("z")).collect()}
    assert z == {k: sum((k[0] >> b & 1) << (2 * b + 1) | (k[1] >> b & 1) << (2 * b) for b in range(8)) for k in z}
    text = stored.where("ty = 1 AND hi > 1100")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ty), IsNotNull(hi), EqualTo(ty,1), GreaterThan(hi,1100.0)]" in text
