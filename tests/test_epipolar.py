"""Two-view geometry against known cameras with outliers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relievo.functions import transforms as tr
from relievo.operators import epipolar as ep

K = np.array([[1200.0, 0, 400], [0, 1200, 300], [0, 0, 1]])
POSES = {"a": ((2.0, 5.0, -1.0), (1.0, 0.1, 0.05)), "b": ((-3.0, -4.0, 2.0), (-0.9, 0.2, 0.1)), None: ((0.5, 6.0, 0.3), (1.0, -0.1, 0.2))}
SCHEMA = "window string, id int, good boolean, xl double, yl double, xr double, yr double"


def pose_of(name):
    angles, t = POSES[name]
    return np.array(tr.rotation(*angles)), np.array(t) / np.linalg.norm(t)


@pytest.fixture(scope="module")
def pairs(spark):
    """Twenty in a hundred pairs are wrong; the others have a tenth of a pixel of noise."""
    rng, rows = np.random.default_rng(4), []
    for name, n in (("a", 400), ("b", 5000), (None, 60)):
        r, t = pose_of(name)
        p = np.column_stack([rng.uniform(-3, 3, (n, 2)), rng.uniform(8, 14, n)])
        left, right = p @ K.T, (p @ r.T + t) @ K.T
        at = np.column_stack([left[:, :2] / left[:, 2:], right[:, :2] / right[:, 2:]]) + rng.normal(0, 0.1, (n, 4))
        good = np.arange(n) % 5 != 0
        at[~good, 2:] += rng.uniform(25, 250, (int((~good).sum()), 2)) * rng.choice([-1, 1], (int((~good).sum()), 2))
        rows += [(name, k, bool(good[k]), *map(float, at[k])) for k in range(n)]
    rows += [("few", k, False, float(k), 1.0, 2.0, 3.0) for k in range(5)] + [("a", -1, False, None, 1.0, 2.0, 3.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def models(pairs):
    return ep.cut(ep.fundamental(pairs))


def test_known_cameras_come_back(pairs, models):
    found = {r.window: r for r in models.collect()}
    assert set(found) == set(POSES) and {k: r.n for k, r in found.items()} == {"a": 400, "b": 5000, None: 60}
    share = ep.flagged(pairs, models).where("window IS NULL OR window <> 'few'").groupBy("good").agg(F.avg(F.col("inlier").cast("int")).alias("s")).collect()
    share = {r.good: r.s for r in share}
    assert share[True] > 0.99 and share[False] < 0.1
    assert ep.flagged(pairs, models).where("window = 'few' AND inlier").count() == 0 and ep.flagged(pairs, models).count() == pairs.count()


def test_poses_by_votes(pairs, models):
    for row in ep.poses(pairs, models, K, K).collect():
        m, (r, t) = np.reshape(row.pose, (3, 4)), pose_of(row.window)
        angle = np.degrees(np.arccos(min(1.0, (np.trace(m[:, :3] @ r.T) - 1) / 2)))
        assert angle < 0.5 and m[:, 3] @ t > 0.99 and row.votes >= 0.95 * row.voters


def test_windows_do_not_depend_on_each_other(pairs, models):
    alone = ep.fundamental(pairs.where("window = 'a'")).first()
    assert np.allclose(alone.f, next(r.f for r in models.collect() if r.window == "a"), atol=1e-9)
    assert ep.fundamental(pairs.limit(0)).count() == 0


def test_rectified_pairs_lie_on_equal_lines(pairs, models):
    found = ep.best_rectifying(pairs, [models, models], (800, 600)).collect()
    assert len(found) == 3
    for row in found:
        assert row.level >= 0.97 * row.n > 0
        left, right = np.reshape(row.left, (3, 3)), np.reshape(row.right, (3, 3))
        corners = np.array([[0, 0, 1], [800, 0, 1], [800, 600, 1], [0, 600, 1.0]])
        for h in (left, right):
            w = corners @ h.T
            assert (np.sign(w[:, 2]) == np.sign(w[0, 2])).all() and np.isfinite(w).all()


def test_blocks_hold_all_pairs(pairs, monkeypatch):
    monkeypatch.setattr(ep, "BLOCK", 64)
    sizes = [(r.window, len(r.xl), r.n) for r in ep.blocks(pairs.dropna(subset=["xl"])).collect()]
    assert sum(n for _, n, _ in sizes) == pairs.where("xl IS NOT NULL").count() and max(n for _, n, _ in sizes) < 130 and len(sizes) > 60


def test_repeated_pairs_count_as_often_as_they_occur(pairs):
    one = pairs.where("window = 'a'")
    twice = ep.fundamental(one.unionByName(one)).first()
    alone = ep.fundamental(one).first()
    assert (twice.n, twice.inliers) == (2 * alone.n, 2 * alone.inliers) and np.allclose(twice.f, alone.f, atol=1e-6)
