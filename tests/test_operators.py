import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relievo.functions import projections as pr
from relievo.functions import transforms as tr
from relievo.operators import cleanup, fitting, graphs, points, rasters, windows
from relievo.plans import stages


def raster(spark, array):
    return spark.createDataFrame([(r, c, None if math.isnan(v) else float(v)) for r, row in enumerate(array) for c, v in enumerate(row)], "r int, c int, val double")


def dense(df, shape):
    out = np.full(shape, np.nan)
    for x in df.collect():
        out[x["r"], x["c"]] = np.nan if x["val"] is None else x["val"]
    return out


def test_utm_there_and_back(spark):
    places = spark.createDataFrame([(30.5, 39.8), (31.2, 40.1), (29.8, 38.5), (-43.2, -22.9)], "lon double, lat double")
    zone, south = pr.zone_of("lon"), "lat < 0"
    x, y = pr.ll2utm("lon", "lat", zone, south)
    there = places.select("lon", "lat", F.expr(x).alias("x"), F.expr(y).alias("y"), F.expr(zone).alias("zone"))
    lon, lat = pr.utm2ll("x", "y", "zone", south)
    for r in there.select("lon", "lat", F.expr(lon).alias("lon2"), F.expr(lat).alias("lat2")).collect():
        assert abs(r.lon - r.lon2) < 1e-6 and abs(r.lat - r.lat2) < 1e-6


@pytest.mark.parametrize("lat_ts, lats", [(-71.0, (-75, -80, -70)), (90.0, (80, 75, 85))])
def test_polar_there_and_back(spark, lat_ts, lats):
    places = spark.createDataFrame([(lon, float(lat)) for lon, lat in zip((-45.0, 90.0, 135.0), lats, strict=True)], "lon double, lat double")
    x, y = pr.ll2ps("lon", "lat", 0.0, lat_ts)
    lon, lat = pr.ps2ll("x", "y", 0.0, lat_ts)
    for r in places.select("lon", "lat", F.expr(x).alias("x"), F.expr(y).alias("y")).select("lon", "lat", F.expr(lon).alias("lon2"), F.expr(lat).alias("lat2")).collect():
        assert abs(r.lon - r.lon2) < 1e-6 and abs(r.lat - r.lat2) < 1e-6


def test_rotations():
    for angles in ((15, -5, 30), (45, 0, -90), (1, 2, 3)):
        assert np.allclose(np.degrees(tr.euler(tr.rotation(*angles))), angles)
    for a, b in (((1, 0, 0), (0, 1, 0)), ((0, 0, 1), (0, 0, -1))):
        assert np.allclose(np.array(tr.rotation_between(a, b)) @ a, b)
    with pytest.raises(ValueError):
        tr.rotation_between((2, 0, 0), (0, 1, 0))


def test_solver_inverse_undoes(spark):
    args = {"variables": {"rz": 0.75, "tz": 1.0, "s": 0.2}, "bounds": {"rz": (-90, 90), "tz": (-50, 50), "s": (0.5, 2)}, "centre": (1, 2, 3)}
    p = spark.createDataFrame([(4.0, 5.0, 6.0)], "x double, y double, z double")
    there = p.select(*[c.alias(n) for n, c in zip("xyz", tr.solver(F.col("x"), F.col("y"), F.col("z"), **args), strict=True)])
    back = there.select(*tr.solver(F.col("x"), F.col("y"), F.col("z"), **args, inverse=True)).first()
    assert tuple(back) == pytest.approx((4, 5, 6))


def test_neighbours_in_order(spark):
    row = rasters.neighbors8(raster(spark, np.arange(1, 10).reshape(3, 3))).where("r = 1 AND c = 1").select(*[n for n, _, _ in rasters.AROUND]).first()
    assert tuple(row) == (2, 3, 6, 9, 8, 7, 4, 1)


def test_plane_is_sampled_exactly(spark):
    plane = raster(spark, [[2 * c + 3 * r for c in range(6)] for r in range(5)])
    asked = spark.createDataFrame([(0, 1.25, 2.5), (1, 4.0, 5.0), (2, 4.1, 1.0), (3, -0.1, 0.0)], "id int, row double, col double")
    got = {r.id: r.sampled for r in rasters.sample(plane, asked).collect()}
    assert got[0] == pytest.approx(8.75) and got[1] == 22 and got[2] is None and got[3] is None


def test_null_rules(spark):
    r = raster(spark, [[0.0, -600.0, 9500.0, 5.0]])
    assert np.isnan(dense(rasters.mask_nulls(r, "dem"), (1, 4))).tolist() == [[False, True, True, False]]
    assert np.isnan(dense(rasters.mask_nulls(r, [0, 5]), (1, 4))).tolist() == [[True, False, False, True]]
    assert rasters.mask_nulls(r, None) is r
    with pytest.raises(ValueError):
        rasters.mask_nulls(r, "other")


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31), (31, 32), (30, 30), (5, 3)], "a long, b long")
    got = {r.node: r.component for r in graphs.components(edges).collect()}
    assert got == {**{k: 0 for k in range(21)}, 30: 30, 31: 30, 32: 30}


def test_regions_and_gaps(spark):
    mask = ["##..#", ".#..#", "..#..", "....#"]
    cells = spark.createDataFrame([(r, c) for r, row in enumerate(mask) for c, v in enumerate(row) if v == "#"], "r int, c int")
    assert sorted(r["size"] for r in cleanup.regions(cells).select("region", "size").distinct().collect()) == [1, 1, 2, 3]
    assert sorted(r["size"] for r in cleanup.regions(cells, diagonal=True).select("region", "size").distinct().collect()) == [1, 2, 4]


def test_inpaint_continues_a_plane(spark):
    z = np.array([[2.0 * c + r for c in range(5)] for r in range(5)])
    want = z.copy()
    z[2, 2:4] = np.nan
    assert np.allclose(dense(cleanup.inpaint(raster(spark, z)), (5, 5)), want, atol=1e-2)


def test_similarity_and_ransac(spark):
    rng = np.random.default_rng(7)
    p = rng.uniform(0, 100, (60, 3))
    m = np.array(tr.rotation(0, 0, 20))
    q = 1.1 * p @ m.T + (8, -4, 2)
    q[::5] += 30
    pairs = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(q, p, strict=True)], "x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    got, marked = fitting.ransac(pairs, 50, 1.0, seed=1)
    assert np.allclose(got[:3, :3], 1.1 * m, atol=1e-6) and np.allclose(got[:3, 3], (8, -4, 2), atol=1e-5)
    assert marked.where("inlier").count() == 48


def test_blocks_cover_without_overlap(spark):
    b = windows.blocks(spark.createDataFrame([(1, 1000, 437)], "image int, rows int, cols int"), 300).collect()
    assert sum((r.r1 - r.r0) * (r.c1 - r.c0) for r in b) == 437000


def test_failed_block_is_reported(spark):
    def kernel(tile):
        if np.nanmax(tile) > 9:
            raise RuntimeError("no")
        return tile * 2

    got = windows.block_process(raster(spark, np.arange(16.0).reshape(4, 4)), 2, 0, kernel).collect()
    assert {(r.r, r.c): r.val for r in got}[0, 0] == 0 and sum(r.error is not None for r in got) == 8


def test_trim_and_mad(spark):
    v = spark.createDataFrame([(float(k),) for k in range(101)], "d double")
    assert points.trim(v, "d", 0.05, 0.95).count() == 91
    assert points.mad_reject(v, "d", sigmas=1.0).agg(F.max("d")).first()[0] == 87.0


def test_a_height_model_of_no_points_is_empty(spark):
    none = spark.createDataFrame([], "x double, y double, z double")
    assert rasters.dense(none.selectExpr("1 AS r", "1 AS c", "z AS val"), 0, 5).count() == 0
    assert stages.height_model(none, **rasters.grid_of(none, 1.0, 1.0)).count() == 0
