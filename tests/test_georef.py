"""The georeferencing chain on clouds that are moved off a known surface, and the small image rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relievo.operators import georef as gr
from relievo.operators import imagery as im

GRID = {"x0": 500_000.0, "y0": 4_203_000.0, "dx": 100.0, "dy": 100.0, "cols": 32, "rows": 31}


def surface(x, y):
    u, v = (x - 500_000) / 400, (y - 4_200_000) / 500
    return 900 + 120 * np.sin(u) * np.cos(v) + 60 * np.cos(0.6 * u + 0.4 * v)


@pytest.fixture(scope="module")
def reference(spark):
    r, c = (a.ravel() for a in np.mgrid[0 : GRID["rows"], 0 : GRID["cols"]])
    z = surface(GRID["x0"] + c * 100.0, GRID["y0"] - r * 100.0)
    return spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(r, c, z, strict=True)], "r int, c int, val double").cache()


@pytest.fixture(scope="module")
def truth():
    rng = np.random.default_rng(6)
    xy = np.column_stack([rng.uniform(500_300, 502_700, 1500), rng.uniform(4_200_400, 4_202_600, 1500)])
    return np.column_stack([xy, surface(xy[:, 0], xy[:, 1])])


def cloud(spark, at):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)], "id long, x double, y double, z double").repartition(3)


def test_a_vertical_offset_goes(spark, reference, truth):
    fit = gr.optimize(cloud(spark, truth + [0, 0, 3.0]), reference, GRID, gr.bounds_of(translation=(0, 0, 20)), rounds=12, settled=0.01)
    assert fit.rmse < 5 and fit.history[0] >= fit.rmse
    moved = fit.moved(cloud(spark, truth + [0, 0, 3.0])).orderBy("id").toPandas()
    assert abs((moved["z"] - truth[:, 2]).mean()) < 1.5
    back = fit.moved(fit.moved(cloud(spark, truth)), inverse=True).orderBy("id").toPandas()
    assert np.allclose(back[["x", "y", "z"]], truth, atol=1e-5)


def test_points_far_from_the_reference_are_left_out(spark, reference, truth):
    """Against the rule by hand: mean heights of cells, differences, sampled between four cells."""
    lifted = truth.copy()
    lifted[:40, 2] += 400
    near = {r.id for r in gr.near_reference(cloud(spark, lifted), reference, GRID).select("id").collect()}
    u, v = (lifted[:, 0] - GRID["x0"]) / 100, (GRID["y0"] - lifted[:, 1]) / 100
    cells = {}
    for a, b, z in zip(np.floor(v + 0.5).astype(int), np.floor(u + 0.5).astype(int), lifted[:, 2], strict=True):
        cells.setdefault((a, b), []).append(z)
    off = {(a, b): surface(GRID["x0"] + b * 100.0, GRID["y0"] - a * 100.0) - np.mean(z) for (a, b), z in cells.items()}
    want = set()
    for k, (x, y) in enumerate(zip(u, v, strict=True)):
        i, j = int(np.floor(y)), int(np.floor(x))
        four = [(off.get((i + a, j + b)), (y - i if a else 1 - y + i) * (x - j if b else 1 - x + j)) for a in (0, 1) for b in (0, 1)]
        if all(d is not None for d, _ in four) and abs(sum(d * w for d, w in four)) < 50:
            want.add(k)
    assert near == want and 800 < len(near) < 1500 and len(near & set(range(40))) < 20


def test_alignment_and_fit(spark, reference, truth):
    moved = truth + [30.0, -20.0, 12.0]
    move, fit = gr.opti_trans(cloud(spark, moved), reference, GRID, gr.bounds_of(translation=(50, 50, 50)), sample=600, rounds=12)
    assert move.shape == (4, 4) and fit.rmse < 10 < gr.costs(cloud(spark, moved), reference, GRID, {}, (0, 0, 0), [{}])[0][1]


def test_first_georeference(spark, reference, truth):
    """Model coordinates are a turned, shrunken copy of the world; control points say where some of it lies."""
    angle, k, t = 0.3, 0.01, truth.mean(axis=0)
    turn = np.array([[np.cos(angle), -np.sin(angle), 0], [np.sin(angle), np.cos(angle), 0], [0, 0, 1]])
    model = k * (truth - t) @ turn.T
    controls = cloud(spark, truth[:12]).select("id", F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("z").alias("h"))
    lon, lat = (F.expr(e) for e in gr.pr.utm2ll("wx", "wy", "35", "FALSE"))
    controls = controls.join(cloud(spark, model[:12]), "id").select("x", "y", "z", lon.alias("lon"), lat.alias("lat"), "h")
    bounds = gr.bounds_of(translation=(10, 10, 10))
    found = gr.init_trans(cloud(spark, model), controls, reference, GRID, bounds, sample=500, rounds=3)
    assert (found.zone, found.south) == (35, False) and found.fit.rmse < 10
    back = found.moved(cloud(spark, model)).orderBy("id").toPandas()
    assert np.median(np.abs(back[["x", "y", "z"]].to_numpy() - truth)) < 15
    with pytest.raises(ValueError, match="root mean square"):
        gr.init_trans(cloud(spark, model), controls, reference, GRID, bounds, sample=500, most=1e-9, rounds=1)


def test_curvature(spark):
    """A flat frame of 100 km drops away from its middle by distance squared over twice the earth's radius."""
    flat = np.array([[500_000 + 10_000.0 * a, 4_200_000 + 10_000.0 * b, 100.0] for a in range(-5, 6) for b in range(-5, 6)])
    curved, matrix = gr.curvature(cloud(spark, flat), 35, False, sample=200)
    z = curved.orderBy("id").toPandas()["z"].to_numpy()
    far = ((flat[:, :2] - flat[60, :2]) ** 2).sum(axis=1)
    assert np.abs((z - z[60]) - far / (2 * 6_371_000)).max() < 0.01 * far.max() / (2 * 6_371_000) + 3
    back = gr.curvature_undone(curved, 35, False, matrix).orderBy("id").toPandas()
    assert np.allclose(back[["x", "y", "z"]], flat, atol=2e-3)


def test_corner_transforms():
    corners = im.corner_points([40, 20, 41, 25, 38, 26, 37, 21])
    assert corners == [(25, 41), (26, 38), (21, 37), (20, 40)]
    square = [(10.0, 50.0), (12.0, 50.0), (12.0, 49.0), (10.0, 49.0)]
    for similarity in (False, True):
        m = im.spatial_transform(square, 101, 201, similarity)
        for image, world in zip([(1, -1), (201, -1), (201, -101), (1, -101)], square, strict=True):
            assert np.allclose((m @ [*image, 1])[:2], world)
    with pytest.raises(ValueError):
        im.corner_points([1, 2])


def test_region_ids():
    assert im.region_ids(" 1, x,2 ,,30") == [1, 2, 30]


def test_windows_share_a_frame(spark):
    """Points seen by two cameras, and the same points in a frame of their own."""
    rng = np.random.default_rng(1)
    world = np.column_stack([rng.uniform(-40, 40, (60, 2)), rng.uniform(400, 500, 60)])
    k = np.array([[1000.0, 0, 320], [0, 1000, 240], [0, 0, 1]])
    cameras = [k @ np.column_stack([np.eye(3), [-b, 0, 0]]) for b in (0.0, 100.0)]
    seen = [(h[:, :2] / h[:, 2:]) for h in (np.column_stack([world, np.ones(60)]) @ p.T for p in cameras)]
    own = 0.25 * world[:, [1, 2, 0]] + [5, -6, 7]
    rows = [(i, *map(float, [*own[i], *seen[0][i], *seen[1][i]])) for i in range(60)]
    m = gr.window_transform(spark.createDataFrame(rows, "id long, x double, y double, z double, xl double, yl double, xr double, yr double"), *cameras)
    assert np.allclose(own @ m[:3, :3].T + m[:3, 3], world, atol=1e-4)


def test_reference_heights(spark, tmp_path):
    from relievo.plans import stages
    from relievo.sources import geotiff

    band = np.arange(100, dtype="int16").reshape(10, 10) * 10
    band[4, 4] = -9999
    (tmp_path / "dem.tif").write_bytes(geotiff.encode(band, 30.0, 39.0, 0.1, 0.1))
    got = stages.reference_heights(spark, str(tmp_path / "dem.tif"), (30.3, 38.5, 30.5, 38.7)).collect()
    assert {(r.r, r.c) for r in got} == {(r, c) for r in (3, 4, 5) for c in (3, 4, 5)} and {(r.r, r.c) for r in got if r.val is None} == {(4, 4)}
    with pytest.raises(ValueError):
        stages.reference_heights(spark, str(tmp_path / "dem.tif"), (50.0, 10.0, 51.0, 11.0))
