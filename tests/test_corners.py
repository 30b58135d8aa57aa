"""Footprints and frame corners against brute force on whole rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relievo.operators import corners as co
from relievo.operators import tiles as ti

SIZE = 32


def tiled(spark, rasters):
    """Tiles of rasters of one shape by key."""
    rows, cols = next(iter(rasters.values())).shape
    cells = [(k, r, c, float(v[r, c])) for k, v in rasters.items() for r in range(rows) for c in range(cols) if not np.isnan(v[r, c])]
    return ti.to_tiles(spark.createDataFrame(cells, "key string, r int, c int, val double").repartition(4), rows, cols, ["key"], SIZE)


def spread(val, boxes, r, c, halo):
    wide = np.pad(val, halo, mode="symmetric")
    some = np.concatenate([wide[halo + r + a : halo + r + b + 1, halo + c + d : halo + c + e + 1].ravel() for a, b, d, e in boxes])
    some = some[~np.isnan(some)]
    return some.std(ddof=1) if len(some) > 1 else np.nan


@pytest.mark.parametrize("down, right", [(True, False), (False, False), (True, True)])
def test_std_on_an_l(spark, down, right):
    rng = np.random.default_rng(3)
    val = 4000 + rng.normal(0, 2, (45, 70))
    val[rng.random(val.shape) < 0.1] = np.nan
    boxes = co.l_shape(9, down, right)
    got = np.full(val.shape, np.nan)
    for x in ti.to_cells(co.footprint_std(tiled(spark, {"a": val}), boxes, ["key"], SIZE), ["key"], SIZE).collect():
        got[x.r, x.c] = np.nan if x.val is None else x.val
    want = [[spread(val, boxes, r, c, 9) for c in range(70)] for r in range(45)]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def flooded(free):
    """The cells that are joined to the edge through ``free`` cells."""
    seen = np.zeros_like(free)
    rows, cols = free.shape
    todo = [(r, c) for r in range(rows) for c in range(cols) if free[r, c] and (r in (0, rows - 1) or c in (0, cols - 1))]
    while todo:
        r, c = todo.pop()
        if 0 <= r < rows and 0 <= c < cols and free[r, c] and not seen[r, c]:
            seen[r, c] = True
            todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return seen


def brute(val, arm, down, right):
    val = np.where(val > 250, 0.0, val)
    least = np.minimum(val.mean(axis=1)[:, None], val.mean(axis=0)[None, :])
    lo, hi = least.min(), least.max()
    bins = np.minimum(255, np.floor((least - lo) / (hi - lo) * 256).astype(int))
    best, level = -1.0, 0
    for k in range(255):
        a, b = bins[bins <= k], bins[bins > k]
        if len(a) and len(b) and len(a) * len(b) * (a.mean() - b.mean()) ** 2 > best * (1 + 1e-12):
            best, level = len(a) * len(b) * (a.mean() - b.mean()) ** 2, k
    mask = ~flooded(~flooded(bins > level))  # parts that reach the edge, then holes that do not
    wide = np.pad(mask.astype(float), 1, mode="edge")
    g = np.zeros(mask.shape)
    at = lambda r, c: wide[1 + r : 1 + r + mask.shape[0], 1 + c : 1 + c + mask.shape[1]]
    g[at(-1, 1) + 2 * at(0, 1) + at(1, 1) != at(-1, -1) + 2 * at(0, -1) + at(1, -1)] = 1
    g[at(1, -1) + 2 * at(1, 0) + at(1, 1) != at(-1, -1) + 2 * at(-1, 0) + at(-1, 1)] = -1
    out = np.pad(mask, 1)
    found = []
    for r, c in zip(*np.nonzero(mask), strict=True):
        up, low, left, far = out[r, c + 1], out[r + 2, c + 1], out[r + 1, c], out[r + 1, c + 2]
        if not (up and low) and not (left and far):
            found.append((-round(spread(g, co.l_shape(arm, down, right), r, c, arm), 12), r, c))
    s, r, c = min(found)
    return r, c, -s


def scan(rng, shape, top, right, bottom):
    """Dark film holder, a bright frame that reaches the left edge, white writing and a bright speck."""
    val = rng.uniform(0, 40, shape)
    val[top:bottom, :right] = rng.uniform(150, 240, (bottom - top, right))
    val[2:5, 10:60] = 255
    val[top - 6 : top - 4, right + 5 : right + 8] = 200
    return val


def test_corners_of_frames(spark):
    rng = np.random.default_rng(5)
    rasters = {"a": scan(rng, (80, 110), 20, 85, 80), "b": scan(rng, (80, 110), 13, 64, 71), "c": scan(rng, (80, 110), 31, 97, 80), "noise": rng.uniform(0, 200, (80, 110))}
    tiles = tiled(spark, rasters).cache()
    for down, top in ((True, True), (False, False)):
        got = {x.key: (x.r, x.c, x.std) for x in co.frame_corners(tiles, 25, down, False, keys=["key"], tile=SIZE).collect()}
        for k, val in rasters.items():
            r, c, std = brute(val, 25, down, False)
            assert got[k][:2] == (r, c) and got[k][2] == pytest.approx(std, abs=1e-9)
        assert not top or (got["a"][:2], got["b"][:2]) == ((20, 84), (13, 63))


def test_no_corner_without_values(spark):
    tiles = tiled(spark, {"a": np.full((40, 40), 7.0)})
    assert co.frame_corners(tiles, 5, True, True, keys=["key"], tile=SIZE).count() == 0
    assert co.frame_corners(tiles.limit(0), 5, True, True, keys=["key"], tile=SIZE).count() == 0
    assert co.frame_corners(tiles.limit(0).drop("key"), 5, True, True, tile=SIZE).count() == 0


def test_profiles(spark):
    val = np.random.default_rng(1).uniform(0, 300, (40, 50))
    got = {(x.axis, x.k): x.val for x in co.profiles(tiled(spark, {"a": val}), 250, ["key"], SIZE).collect()}
    val = np.where(val > 250, 0, val)
    assert len(got) == 90 and all(got[0, k] == pytest.approx(val[k].mean()) for k in range(40)) and all(got[1, k] == pytest.approx(val[:, k].mean()) for k in range(50))
    assert co.bright_lines(co.profiles(tiled(spark, {"a": val}), None, ["key"], SIZE), ["key"]).where(F.col("first") > F.col("final")).count() == 0
