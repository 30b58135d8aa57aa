"""Queries of estimations that run for many keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relievo.operators import epipolar as ep
from relievo.operators import leastsq as ls
from relievo.operators import regions as rg
from relievo.plans.fixtures import dref, pc, read, with_sql


def region_costs(spark: SparkSession, d: str) -> DataFrame:
    """What two transforms of each region's points cost against the reference, all in one pass."""
    points = pc(spark, d)
    x0, x1, y0, y1 = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    grid = {"x0": float(x0), "y0": float(y1), "dx": (x1 - x0) / 39.0, "dy": (y1 - y0) / 39.0, "cols": 40, "rows": 40}
    moves = [[1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, a, b] for a, b in ((1.0, 0.0), (0.5, 10.0))]
    asked = points.select("region").distinct().withColumn("moves", F.array(*[F.array(*map(F.lit, m)) for m in moves]))
    reference = dref(spark, d).where("val IS NOT NULL").select("r", "c", F.col("val").alias("ref"))
    found = rg.costs(points, asked, reference, grid).select("region", F.explode("got").alias("g")).select("region", "g.*")
    return found.select("region", "k", "n", F.round(F.col("total") / F.col("n"), 4).alias("mean_square"))


def _seen(spark: SparkSession, d: str) -> DataFrame:
    """Parts seen by two cameras 100 apart, a window a type; large parts are seen in a wrong line by the right camera."""
    size, key = F.col("p_size").cast("double"), F.col("p_partkey")
    points = read(spark, d, "part").select(F.col("p_type").alias("window"), key.alias("id"), size.alias("x"), (key % 83).cast("double").alias("y"), (F.lit(100.0) + (key * 7) % 61).alias("z"))
    at = lambda a, f, c: F.lit(f) * F.col(a) / F.col("z") + F.lit(c)
    wrong = F.when(F.col("x") > 40, 30 + F.col("x") * 3 + F.col("id") % 17 * 5).otherwise(0.0)
    return points.select("window", "id", at("x", 1000.0, 320.0).alias("xl"), at("y", 1000.0, 240.0).alias("yl"), (at("x", 1000.0, 320.0) - F.lit(100000.0) / F.col("z")).alias("xr"), (at("y", 1000.0, 240.0) + wrong).alias("yr"))


def epipolar_inliers(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of each window that agree with one geometry of two views."""
    pairs = _seen(spark, d)
    models = ep.fundamental(pairs)
    return ep.flagged(pairs, models).join(models.select("window", "n", "inliers"), "window").select("window", "id", "inlier", "n", "inliers")


def rectified_lines(spark: SparkSession, d: str) -> DataFrame:
    """How many of the agreeing pairs of each window lie on equal lines after rectification, and how many lie before both cameras."""
    pairs = _seen(spark, d)
    models = ep.cut(ep.fundamental(pairs))
    k = ep.np.array([[1000.0, 0, 320], [0, 1000, 240], [0, 0, 1]])
    votes = ep.poses(pairs, models, k, k).select("window", "votes", F.transform("pose", lambda v: F.round(v, 4) + F.lit(0.0)).alias("p"))
    lines = ep.rectifying(pairs, models, (640, 480)).select("window", "level", "n")
    return lines.join(votes, "window").select("window", "level", "n", "votes", *[F.abs(F.get("p", F.lit(i))).alias(name) for i, name in ((0, "r00"), (3, "tx"), (7, "ty"))])


def damped_line(spark: SparkSession, d: str) -> DataFrame:
    """Price against quantity by damped steps from a start that is far off."""
    rows = read(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).cast("double").alias("y"))
    off = lambda v, at: (v[:, :1] * at[None, :, 0] + v[:, 1:2] - at[None, :, 1])[..., None]
    found = ls.damped(rows, ("x", "y"), off, (0.0, 50.0), (-100.0, -1000.0), (100.0, 1000.0), rounds=30, ftol=1e-14, xtol=1e-12)
    return spark.createDataFrame([(float(found.parameters[0]), float(found.parameters[1]))], "a double, b double").select(F.round("a", 4).alias("slope"), F.round("b", 3).alias("intercept"))


QUERIES = {"damped_line": damped_line, "region_costs": region_costs, "epipolar_inliers": epipolar_inliers, "rectified_lines": rectified_lines}
_TRUE = "s AS (SELECT p_type AS window_, p_partkey AS id, p_size <= 40 AS good FROM part)"
SQL = {
    "damped_line": "SELECT round(regr_slope(l_extendedprice / 1000, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice / 1000, l_quantity), 3) AS intercept FROM lineitem",
    "epipolar_inliers": f"""WITH {_TRUE} SELECT window_ AS "window", id, good AS inlier, count(*) OVER (PARTITION BY window_) AS n, sum(CAST(good AS INT)) OVER (PARTITION BY window_)::BIGINT AS inliers FROM s""",
    "rectified_lines": f"""WITH {_TRUE} SELECT window_ AS "window", count(*) AS level, count(*) AS n, count(*) AS votes, CAST(1 AS DOUBLE) AS r00, CAST(1 AS DOUBLE) AS tx, CAST(0 AS DOUBLE) AS ty FROM s WHERE good GROUP BY 1""",
    "region_costs": f"""{with_sql("dref", "pc")}, e AS (SELECT CAST(min(x) AS DOUBLE) AS x0, (max(x) - min(x)) / CAST(39 AS DOUBLE) AS dx, CAST(max(y) AS DOUBLE) AS y0, (max(y) - min(y)) / CAST(39 AS DOUBLE) AS dy FROM pc),
      m AS (SELECT * FROM (VALUES (0, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)), (1, CAST('0.5' AS DOUBLE), CAST(10 AS DOUBLE))) t(k, a, b)),
      g AS (SELECT region, k, CAST(round((y0 - y) / dy) AS INT) AS r, CAST(round((x - x0) / dx) AS INT) AS c, avg(a * z + b) AS val FROM pc CROSS JOIN e CROSS JOIN m GROUP BY ALL),
      f AS (SELECT region, k, dref.val - g.val AS d FROM g JOIN dref USING (r, c) WHERE dref.val IS NOT NULL),
      q AS (SELECT region, k, quantile_cont(d, CAST('0.05' AS DOUBLE)) AS lo, quantile_cont(d, CAST('0.95' AS DOUBLE)) AS hi FROM f GROUP BY region, k)
      SELECT region, k, count(*) AS n, round(sum(d * d) / count(*), 4) AS mean_square FROM f JOIN q USING (region, k) WHERE d BETWEEN lo AND hi GROUP BY region, k""",
}
