"""Queries over tiled rasters that grow with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relievo.operators import corners as co
from relievo.operators import tiles as ti
from relievo.plans.fixtures import side, terrain, with_sql

SIZE = 64


def _tiles(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    n = side(spark, d)
    return ti.to_tiles(terrain(spark, d), n, n, tile=SIZE), n


def _cells(tiles: DataFrame) -> DataFrame:
    return ti.to_cells(tiles, tile=SIZE).select("r", "c", F.round("val", 6).alias("val"))


def tiles_median5(spark: SparkSession, d: str) -> DataFrame:
    return _cells(ti.median(_tiles(spark, d)[0], 5, tile=SIZE))


def tiles_box_mean7(spark: SparkSession, d: str) -> DataFrame:
    return _cells(ti.box_mean(_tiles(spark, d)[0], 7, tile=SIZE))


def tiles_wiener(spark: SparkSession, d: str) -> DataFrame:
    return _cells(ti.wiener(_tiles(spark, d)[0], tile=SIZE))


def tiles_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return _cells(ti.gap_fill(_tiles(spark, d)[0], tile=SIZE))


def tiles_resample(spark: SparkSession, d: str) -> DataFrame:
    """A turned and stretched view, as large as the raster."""
    tiles, n = _tiles(spark, d)
    return _cells(ti.resample(tiles, n, n, (n, n), lambda r, c: (0.75 * r + 0.25 * c + 0.5, 0.875 * c - 0.125 * r + 1.25), tile=SIZE))


def tiles_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d)[0].select("ty", "tx", "h", "w", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def tiles_l_std(spark: SparkSession, d: str) -> DataFrame:
    """To three places, as variances are differences of running sums, and times the root of three: half the difference of two values has few digits here."""
    spread = co.footprint_std(_tiles(spark, d)[0], co.l_shape(4, True, False), tile=SIZE)
    return ti.to_cells(spread, tile=SIZE).select("r", "c", F.round(F.col("val") * 1.7320508075688772, 3).alias("val"))


def tiles_profiles(spark: SparkSession, d: str) -> DataFrame:
    return co.profiles(_tiles(spark, d)[0], 250.0, tile=SIZE).select("axis", "k", F.round("val", 6).alias("val"))


def frame_corner(spark: SparkSession, d: str) -> DataFrame:
    """The corner of a frame laid over the terrain: dimmed above a fifth of the rows and right of four fifths of the columns."""
    n = side(spark, d)
    inside = (F.col("r") >= n / 5) & (F.col("c") < n - n / 5)
    scan = terrain(spark, d).withColumn("val", F.when(inside, F.col("val")).otherwise(F.col("val") / 8))
    return co.frame_corners(ti.to_tiles(scan, n, n, tile=SIZE), min(SIZE, n // 3), True, False, white=None, tile=SIZE)


_GRID = "g AS (SELECT r, c, val, n FROM (SELECT CAST(unnest(range(0, n)) AS INT) AS r, n FROM side) CROSS JOIN (SELECT CAST(unnest(range(0, n)) AS INT) AS c FROM side) LEFT JOIN terrain USING (r, c))"


def _around(half: int) -> str:
    steps = f"(SELECT CAST(unnest(range(-{half}, {half} + 1)) AS INT) AS d)"
    return f"o AS (SELECT g.r, g.c, g.n, g.val, g.r + a.d AS i, g.c + b.d AS j FROM g CROSS JOIN {steps} a CROSS JOIN {steps} b)"


_MIRROR = "CASE WHEN {0} < 0 THEN -1 - {0} WHEN {0} >= n THEN 2 * n - 1 - {0} ELSE {0} END"
QUERIES = {"tiles_median5": tiles_median5, "tiles_box_mean7": tiles_box_mean7, "tiles_wiener": tiles_wiener, "tiles_gap_fill": tiles_gap_fill, "tiles_resample": tiles_resample, "tiles_bounds": tiles_bounds, "tiles_l_std": tiles_l_std, "tiles_profiles": tiles_profiles, "frame_corner": frame_corner}
SQL = {
    "tiles_median5": f"""{with_sql("terrain")}, {_GRID}, {_around(2)}, m AS (SELECT r, c, val, {_MIRROR.format("i")} AS i, {_MIRROR.format("j")} AS j FROM o)
      SELECT m.r, m.c, CASE WHEN max(m.val) IS NOT NULL THEN round(median(t.val), 6) END AS val FROM m LEFT JOIN terrain t ON t.r = m.i AND t.c = m.j GROUP BY m.r, m.c""",
    "tiles_box_mean7": f"""{with_sql("terrain")}, {_GRID}, {_around(3)} SELECT o.r, o.c, round(avg(t.val), 6) AS val FROM o LEFT JOIN terrain t ON t.r = o.i AND t.c = o.j GROUP BY o.r, o.c""",
    "tiles_l_std": f"""{with_sql("terrain")}, {_GRID}, {_around(4)}, m AS (SELECT r, c, {_MIRROR.format("i")} AS i, {_MIRROR.format("j")} AS j FROM o WHERE (i >= r AND j = c) OR (i = r AND j < c))
      SELECT m.r, m.c, round(stddev_samp(t.val) * CAST('1.7320508075688772' AS DOUBLE), 3) AS val FROM m LEFT JOIN terrain t ON t.r = m.i AND t.c = m.j GROUP BY m.r, m.c""",
    "tiles_profiles": f"""{with_sql("terrain")}, {_GRID}, w AS (SELECT r, c, CASE WHEN val > 250 THEN 0 ELSE val END AS val FROM g)
      SELECT CAST(0 AS INT) AS axis, r AS k, round(avg(val), 6) AS val FROM w GROUP BY r UNION ALL SELECT CAST(1 AS INT), c, round(avg(val), 6) FROM w GROUP BY c""",
    "tiles_gap_fill": f"""{with_sql("terrain")}, {_GRID}, {_around(1)} SELECT o.r, o.c, round(coalesce(max(o.val), avg(t.val)), 6) AS val FROM o LEFT JOIN terrain t ON t.r = o.i AND t.c = o.j GROUP BY o.r, o.c""",
    "tiles_wiener": f"""{with_sql("terrain")}, {_GRID}, {_around(1)}, l AS (SELECT o.r, o.c, max(o.val) AS val, coalesce(sum(t.val), 0) / 9 AS m, coalesce(sum(t.val * t.val), 0) / 9 AS q FROM o LEFT JOIN terrain t ON t.r = o.i AND t.c = o.j GROUP BY o.r, o.c),
      v AS (SELECT *, q - m * m AS s FROM l), z AS (SELECT avg(s) AS noise FROM v WHERE val IS NOT NULL)
      SELECT r, c, round(m + CASE WHEN s > noise THEN (s - noise) / s ELSE 0 END * (val - m), 6) AS val FROM v CROSS JOIN z""",
    "tiles_resample": f"""{with_sql("terrain")}, {_GRID}, p AS (SELECT r, c, CAST('0.75' AS DOUBLE) * r + CAST('0.25' AS DOUBLE) * c + CAST('0.5' AS DOUBLE) AS y, CAST('0.875' AS DOUBLE) * c - CAST('0.125' AS DOUBLE) * r + CAST('1.25' AS DOUBLE) AS x FROM g),
      q AS (SELECT *, CAST(floor(y) AS INT) AS i, CAST(floor(x) AS INT) AS j FROM p), s AS (SELECT CAST(unnest(range(0, 2)) AS INT) AS d),
      k AS (SELECT q.r, q.c, (CASE WHEN a.d = 1 THEN y - i ELSE 1 - (y - i) END) * (CASE WHEN b.d = 1 THEN x - j ELSE 1 - (x - j) END) AS w, i + a.d AS i, j + b.d AS j FROM q CROSS JOIN s a CROSS JOIN s b)
      SELECT k.r, k.c, CASE WHEN count(t.val) = count(*) THEN round(sum(w * t.val), 6) END AS val FROM k LEFT JOIN terrain t ON t.r = k.i AND t.c = k.j WHERE w > 0 GROUP BY k.r, k.c""",
    "tiles_bounds": f"""{with_sql("terrain")}, {_GRID} SELECT r // {SIZE} AS ty, c // {SIZE} AS tx, CAST(count(DISTINCT r) AS INT) AS h, CAST(count(DISTINCT c) AS INT) AS w, round(min(val), 6) AS lo, round(max(val), 6) AS hi FROM g GROUP BY 1, 2""",
}
