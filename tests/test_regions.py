"""Regions fitted at once against each fitted alone, and against how they were moved."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_georef import GRID, cloud, surface

from relievo.functions import transforms as tr
from relievo.operators import georef as gr
from relievo.operators import regions as rg

BOUNDS = gr.bounds_of(translation=(0, 0, 20))


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


def lifted(spark, truth, heights):
    parts = [cloud(spark, truth[k::3] + [0, 0, h]).withColumn("region", F.lit(name)) for k, (name, h) in enumerate(heights)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def test_the_matrix_is_the_solvers_transform(spark):
    variables, bounds = {"rx": 0.3, "rz": 0.9, "ty": 0.2, "sx": 0.7, "s": 0.4}, {"rx": (-5, 5), "rz": (-30, 30), "ty": (-9, 9), "sx": (0.5, 1.5), "s": (0.5, 2)}
    x, y, z = tr.solver(F.col("x"), F.col("y"), F.col("z"), variables, bounds, (3.0, -2.0, 7.0))
    got = spark.createDataFrame([(1.5, 2.5, -4.0)], "x double, y double, z double").select(x, y, z).first()
    assert np.allclose(rg.matrix_of(variables, bounds, (3.0, -2.0, 7.0)) @ [1.5, 2.5, -4.0, 1.0], [*got, 1.0])


def test_regions_at_once_equal_one_at_a_time(spark, reference, truth):
    """A null region is one as well; the fits are those of the simplex for a single cloud."""
    heights = [("a", 3.0), (None, -6.0)]
    table = lifted(spark, truth, heights)
    together = {r.region: r for r in rg.optimize(table, reference, GRID, BOUNDS, rounds=4, settled=0.01).collect()}
    assert set(together) == {"a", None}
    for name, h in heights:
        one = gr.optimize(table.where(F.col("region").eqNullSafe(F.lit(name))), reference, GRID, BOUNDS, rounds=5, settled=0.01)
        assert together[name].variables[0] == pytest.approx(one.variables["tz"], abs=1e-9) and together[name].rmse == pytest.approx(one.rmse)
        assert abs(together[name].move[11] + h) < 8


def test_many_regions_take_the_jobs_of_one(spark, reference, truth):
    """Forty regions ask for as many Spark jobs as one, but for what adaptive execution splits."""
    jobs = []
    for n in (1, 40):
        table = cloud(spark, truth + [0, 0, 4.0]).withColumn("region", F.pmod("id", F.lit(n)))
        spark.sparkContext.setJobGroup(f"regions-{n}", "fit")
        assert rg.optimize(table, reference, GRID, BOUNDS, rounds=1).count() == n
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"regions-{n}")))
    assert jobs[1] <= 2 * jobs[0]


def test_fit_of_regions(spark, reference, truth):
    """Regions that cover enough come back to the surface; a thin one is left out; one off the reference has no rmse."""
    thin = cloud(spark, truth[:6]).withColumn("region", F.lit("thin"))
    table = lifted(spark, truth, [("a", 5.0), ("b", -7.0)]).unionByName(thin)
    targets = gr.cut(gr.reference_points(reference, GRID))
    found = {r.region: r for r in rg.fit(table, reference, targets, GRID, BOUNDS, least_cover=0.2, tries=2, rounds=2).collect()}
    assert set(found) == {"a", "b"} and all(r.rmse < 25 and r.tries == 1 for r in found.values())
    for k, name in enumerate("ab"):
        at = truth[k::3] + [0, 0, (5.0, -7.0)[k]]
        now = at @ np.reshape(found[name].move, (3, 4))[:, :3].T + np.reshape(found[name].move, (3, 4))[:, 3]
        assert np.median(np.abs(now[:, 2] - surface(now[:, 0], now[:, 1]))) < 3
    assert rg.fit(table.limit(0), reference, targets, GRID, BOUNDS).count() == 0


def test_a_sample_takes_its_share_of_each_region(spark):
    table = spark.range(20_000).select("id", F.when(F.col("id") < 19_000, 1).when(F.col("id") < 19_990, 2).alias("region"))
    counts = {r.region: r["count"] for r in rg.sample(table, 500).groupBy("region").count().collect()}
    assert counts[None] == 10 and all(400 < counts[k] < 600 for k in (1, 2))
