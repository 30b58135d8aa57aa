import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relievo.functions import transforms as tr
from relievo.operators import fitting, matching, points


def test_polyfit_finds_its_surface(spark):
    c = (0.5, -0.25, 0.1, 0.2, -0.3, 0.01, 0.02, -0.03, 0.04)
    grid = spark.createDataFrame([(x / 3, y / 3) for x in range(-6, 7) for y in range(-6, 7)], "x double, y double")
    assert fitting.polyfit_surface(grid.withColumn("z", tr.surface(c, F.col("x"), F.col("y")))) == pytest.approx(c)


def test_nuth_kaab_finds_a_shift(spark):
    aspect = [k * 7.3 % 360 for k in range(200)]
    rows = [((3 * math.cos(math.radians(40 - a)) + 2) * math.tan(math.radians(20 + k % 30)), 20.0 + k % 30, a) for k, a in enumerate(aspect)]
    diff = spark.createDataFrame(rows, "d double, slope double, aspect double")
    dx, dy, _ = fitting.nuth_kaab(diff, 1.0, 1.0)
    assert dx == pytest.approx(3 * math.sin(math.radians(40)), abs=1e-6) and dy == pytest.approx(3 * math.cos(math.radians(40)), abs=1e-6)
    assert fitting.nuth_kaab(diff.limit(5), 1.0, 1.0) == (0.0, 0.0, 0.0)


def test_icp_lifts_points_to_the_surface(spark):
    height = lambda x, y: 3 * math.sin(x / 4) + 2 * math.cos(y / 5)
    rows = []
    for x in range(8):
        for y in range(8):
            p, q = 0.75 * math.cos(x / 4), -0.4 * math.sin(y / 5)
            n = math.sqrt(1 + p * p + q * q)
            rows.append((x * 8 + y, float(x), float(y), height(x, y), -p / n, -q / n, 1 / n))
    reference = spark.createDataFrame(rows, "id long, x double, y double, z double, nx double, ny double, nz double").cache()
    moving = reference.select("id", "x", "y", (F.col("z") - 0.5).alias("z"))
    got = fitting.icp(moving, reference, 2.0, iterations=2)
    assert abs(got[2, 3] - 0.5) < 0.2 and np.allclose(got[:3, :3], np.eye(3), atol=0.1)


def test_sample_is_repeatable(spark):
    table = spark.range(100).withColumnRenamed("id", "pid")
    a, b = (points.sample_points(table.repartition(n), 10, "pid", seed=3).collect() for n in (1, 4))
    assert a == b and len(a) == 10 and points.sample_points(table, 500, "pid").count() == 100


def test_ring_descriptor_does_not_mind_rotation(spark):
    rings = lambda shift: [(ring, (k + shift) % 12, math.sin(k) * (ring + 1) + (5 if k == 4 else 0)) for ring in range(3) for k in range(12)]
    table = spark.createDataFrame([(pid, *r) for pid, s in ((1, 0), (2, 5)) for r in rings(s)] + [(3, 0, 0, None)], "pid int, ring int, k int, val double")
    got = {r.pid: r.vec for r in matching.ring_descriptor(table, ["pid"]).collect()}
    assert set(got) == {1, 2} and got[1] == pytest.approx(got[2]) and got[1][12] == max(got[1][12:24])


@pytest.mark.parametrize("axes", ["xyz", "xy"])
def test_weighted_similarities(spark, axes):
    """Against the least squares of all weighted residuals, solved by singular vectors of the whole sums in numpy."""
    rng, size = np.random.default_rng(9), len(axes)
    p = rng.normal(0, 50, (60, size)) + 4_000_000
    turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
    turn[:, 0] *= np.sign(np.linalg.det(turn))
    q = 1.3 * p @ turn.T + rng.normal(0, 2, p.shape) - 7
    w = rng.choice([0.0, 0.5, 3.0], 60)
    rows = [(*a, *b, c) for a, b, c in zip(p.tolist(), q.tolist(), w.tolist(), strict=True)]
    rows += [(*[None] * size, *[1.0] * size, 1.0), (*[9e9] * size, *[1.0] * size, None)]
    got = fitting.absor(spark.createDataFrame(rows, ", ".join(f"{a}{k} double" for k in (1, 2) for a in axes) + ", w double"), axes=axes, weight="w")
    mp, mq = (np.average(v, axis=0, weights=w) for v in (p, q))
    h = ((p - mp) * w[:, None]).T @ (q - mq)
    u, s, vt = np.linalg.svd(h)
    flip = np.diag([*[1.0] * (size - 1), np.sign(np.linalg.det(vt.T @ u.T))])
    k = (s * np.diag(flip)).sum() / ((p - mp) ** 2 * w[:, None]).sum()
    assert got[:size, :size] == pytest.approx(k * vt.T @ flip @ u.T, rel=1e-9, abs=1e-9)
    assert got[:size, :size] @ mp + got[:size, size] == pytest.approx(mq, abs=1e-6)
    even = fitting.absor(spark.createDataFrame([(*a, *b, 2.0) for a, b in zip(p.tolist(), q.tolist(), strict=True)], ", ".join(f"{a}{k} double" for k in (1, 2) for a in axes) + ", w double"), axes=axes)
    assert even.shape == (size + 1, size + 1)
    with pytest.raises(ValueError, match="pairs"):
        fitting.absor(spark.createDataFrame(rows[:1], ", ".join(f"{a}{k} double" for k in (1, 2) for a in axes) + ", w double"), axes=axes, weight="w")
