"""Damped least squares against curves and cameras that are known."""

import numpy as np
import pytest

from relievo.functions import transforms as tr
from relievo.operators import leastsq as ls


def test_a_curve_comes_back_though_some_rows_are_wrong(spark):
    decay = lambda v, rows: (v[:, :1] * np.exp(-v[:, 1:2] * rows[None, :, 0]) + v[:, 2:3] - rows[None, :, 1])[..., None]
    rng = np.random.default_rng(2)
    t = rng.uniform(0, 5, 1000)
    y = 3 * np.exp(-0.7 * t) + 0.5
    y[::100] += 40  # one in a hundred
    table = spark.createDataFrame([*((float(a), float(b)) for a, b in zip(t, y, strict=True)), (None, 1.0)], "t double, y double").repartition(3)
    got = ls.damped(table, ("t", "y"), decay, (1, 0.2, 0), (0, 0, -5), (10, 3, 5), keep=0.985)
    assert got.parameters == pytest.approx([3, 0.7, 0.5], abs=1e-3) and got.cost < 1e-4 * got.start
    edge = ls.damped(table, ("t", "y"), decay, (1, 0.2, 0), (0, 0, -5), (2, 3, 5), keep=0.985, rounds=4)
    assert edge.parameters[0] <= 2 and edge.cost > got.cost
    assert ls.damped(table.limit(0), ("t", "y"), decay, (1, 0.2, 0), (0, 0, -5), (10, 3, 5), keep=0.9).parameters.tolist() == [1, 0.2, 0]


def test_cameras_are_adjusted(spark):
    """Calibration and pose a little off: the adjusted cameras see the pairs again, within the bounds."""
    rng = np.random.default_rng(8)
    k = np.array([[1200.0, 0, 400], [0, 1200, 300], [0, 0, 1]])
    pose = np.column_stack([np.array(tr.rotation(1.0, -3.0, 2.0)), [1.0, 0.2, 0.1]])
    p = np.column_stack([rng.uniform(-3, 3, (150, 2)), rng.uniform(8, 14, 150), np.ones(150)])
    seen = [h[:, :2] / h[:, 2:] for h in (p[:, :3] @ k.T, p @ pose.T @ k.T)]
    table = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack(seen)], "xl double, yl double, xr double, yr double").repartition(2)
    off = np.column_stack([np.array(tr.rotation(1.6, -2.5, 1.4)), [1.1, 0.18, 0.12]])
    wrong = k + [[3.0, 0, 2], [0, 3.0, -2], [0, 0, 0]]
    k1, k2, adjusted, found = ls.bundle(table, wrong, k, off, rounds=12)
    assert found.cost < 1e-3 * found.start
    assert np.abs(k1 - wrong).max() <= 5 and np.abs((k2 - k)[:2, 2]).max() <= 5 and k2[0, 0] == k1[0, 0] and (np.abs(adjusted[:, 3] - off[:, 3]) <= np.abs(off[:, 3]) / 2 + 1e-9).all()
    angle = lambda r: np.degrees(np.arccos(min(1.0, (np.trace(r[:, :3] @ pose[:, :3].T) - 1) / 2)))
    assert angle(adjusted) < angle(off)
