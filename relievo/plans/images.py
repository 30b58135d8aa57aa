"""Queries over images, footprints, fits and georeferencing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relievo.operators import georef as gr
from relievo.operators import imagery as im
from relievo.operators import matching as mt
from relievo.operators import nearest as ne
from relievo.plans.fixtures import dref, geo, href, img, read, tgt, vectors, with_sql

#: Image (x, -y) to world: a turned and scaled map.
WORLD = (0.002, 0.0003, 30.0, -0.0002, 0.0021, 42.0)
#: The grid of the reference in the georeferencing queries.
GRID = {"x0": 0.0, "y0": 3900.0, "dx": 100.0, "dy": 100.0, "cols": 40, "rows": 40}


def to_float(spark: SparkSession, d: str) -> DataFrame:
    """Both images; one of them is in bytes already, the other is not."""
    raised = F.when(F.col("side") == "F", F.col("val") * 260 - 2).otherwise(F.col("val") * 1.5 - 0.25)
    return im.to_float(img(spark, d).select("side", "r", "c", raised.alias("val")), "side").select("side", "r", "c", F.round("val", 9).alias("val"))


def valid_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows to match in, with and without enough of them."""
    few, many = im.valid_rows(dref(spark, d), 40, 150, 0.4, 1000), im.valid_rows(dref(spark, d), 40, 150, 0.4, 3)
    return few.select(F.lit(1000).alias("least"), "*").unionByName(many.select(F.lit(3).alias("least"), "*"))


def line_means(spark: SparkSession, d: str) -> DataFrame:
    return im.line_means(dref(spark, d).withColumn("val", F.col("val") * 1.5)).select("r", "c", F.round("val", 6).alias("val"))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))


def world_window(spark: SparkSession, d: str) -> DataFrame:
    m = F.array(*[F.lit(v) for v in WORLD])
    windows = _suppliers(spark, d).select(F.col("k").alias("window"), (F.col("k") * 10).cast("double").alias("x0"), F.lit(400.0).alias("y0"), (1000.0 - F.col("k")).alias("x1"), (F.col("nation") * 30).cast("double").alias("y1"), m.alias("m"))
    return im.world_window(windows).select("window", "corner", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


def stereo_overlap(spark: SparkSession, d: str) -> DataFrame:
    a, b, c, e, f, g = (F.lit(v) for v in WORLD)
    pairs = _suppliers(spark, d).select(
        F.col("k").alias("pair"), F.array(a, b, c, e, f, g).alias("lm"), F.lit(3000).alias("lw"), F.lit(2000).alias("lh"),
        F.array(a, b * 2, c + F.col("k") % 40 / 10.0 - 1, e, f, g + F.col("nation") / 10.0 - 1).alias("rm"), F.lit(2800).alias("rw"), F.lit(2100).alias("rh"),
    )
    return im.stereo_overlap(pairs)


def edge_blanks(spark: SparkSession, d: str) -> DataFrame:
    """Low cells that hang together with the edge, grown by a square of 3."""
    return im.edge_blanks(dref(spark, d).where("val < 145").select("r", "c"), 40, 40, 3)


def valid_disparity(spark: SparkSession, d: str) -> DataFrame:
    cells = dref(spark, d)
    return im.valid_disparity(cells, 130.0, 170.0, cells.where("r < 3").select("r", "c")).select("r", "c", F.round("val", 9).alias("val"))


def spacing_median(spark: SparkSession, d: str) -> DataFrame:
    return im.spacing_median(geo(spark, d), "id", "lat").select(F.round("resolution", 6).alias("resolution"))


def spacing_top(spark: SparkSession, d: str) -> DataFrame:
    return im.spacing_top(geo(spark, d).select("id", (F.col("lat") * 24).alias("x")), "id", "x").select(F.round("resolution", 6).alias("resolution"))


def converged(spark: SparkSession, d: str) -> DataFrame:
    costs = read(spark, d, "customer").select(F.col("c_nationkey").alias("fit"), F.col("c_custkey").alias("step"), (10.0 / (F.col("c_custkey") + 1) + F.col("c_custkey") % 7 / 100.0).alias("rmse"))
    return im.converged(costs, ["fit"])


def best_scale(spark: SparkSession, d: str) -> DataFrame:
    matches = read(spark, d, "part").select((F.col("p_partkey") % 9).alias("image"), (F.col("p_size") % 11).alias("scale"), (F.col("p_retailprice") > 1200).alias("inlier"))
    return im.best_scale(matches, ["image"])


def best_pose(spark: SparkSession, d: str) -> DataFrame:
    return im.best_pose(_suppliers(spark, d).select("nation", F.col("k").alias("pose"), (F.col("bal") - 3000).alias("tz")), ["nation"])


def stitch_is_sane(spark: SparkSession, d: str) -> DataFrame:
    return im.stitch_is_sane(_suppliers(spark, d).select("k", (F.col("k") % 13 / 10.0 + 0.4).alias("scale"), (F.col("bal") / 400).alias("angle"))).select("k", "sane")


def region_tries(spark: SparkSession, d: str) -> DataFrame:
    """Tries of regions until one is good enough."""
    tries = _suppliers(spark, d).select((F.col("k") % 20).alias("region"), F.floor(F.col("k") / 20).alias("attempt"), (F.abs("bal") / 100).alias("rmse"))
    return im.gated(tries).select("region", "attempt", F.round("rmse", 6).alias("rmse"), "best")


def pyramid_levels(spark: SparkSession, d: str) -> DataFrame:
    return im.pyramid_levels(href(spark, d), (2, 5)).select("level", "r", "c", F.round("val", 4).alias("val"))


def file_stems(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/scans/roll 1/D3C-"), F.col("p_partkey").cast("string"), F.lit("_a.tif"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("image"), im.stem(path).alias("stem"), im.stem(path, 2).alias("strip"))


def hamming_nearest(spark: SparkSession, d: str) -> DataFrame:
    codes = vectors(spark, d).select("id", "label", mt.sign_bits(F.col("v")).alias("code"))
    return ne.nearest_codes(codes.where("id % 2 = 0"), codes.where("id % 2 = 1"), ["label"])


def matches_sorted(spark: SparkSession, d: str) -> DataFrame:
    codes = vectors(spark, d).select("id", "label", mt.sign_bits(F.col("v")).alias("code"))
    return mt.sorted_code_matches(codes.where("id % 2 = 0"), codes.where("id % 2 = 1"), ["label"])


def image_crop(spark: SparkSession, d: str) -> DataFrame:
    return im.crop(img(spark, d), 5, 11, 40, 60).select("side", "r", "c", F.round("val", 9).alias("val"))


def keypoint_cells(spark: SparkSession, d: str) -> DataFrame:
    points = _suppliers(spark, d).select("k", (F.col("k") * 37 % 1000).cast("double").alias("x"), (F.col("bal") / 10).alias("y"))
    return im.keypoint_cells(points, 900, 700).groupBy("kx", "ky").agg(F.count("*").alias("n"))


#: A triangle and a square, in the coordinates of ``GRID``.
POLYGONS = {1: [(310.0, 3580.0), (1490.0, 2410.0), (820.0, 3790.0)], 2: [(2555.0, 905.0), (3145.0, 905.0), (3145.0, 1510.0), (2555.0, 1510.0)]}


def unstable_terrain(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the reference that are under polygons, or near them."""
    edges = [(k, *a, *b) for k, ring in POLYGONS.items() for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    mask = im.unstable_terrain(spark.createDataFrame(edges, "poly_id int, x1 double, y1 double, x2 double, y2 double"), GRID)
    return dref(spark, d).join(mask, ["r", "c"]).select("r", "c", F.round("val", 6).alias("val"))


def curvature_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Onto the curved earth and back: the differences are rounding."""
    flat = tgt(spark, d).select("id", (500000 + F.col("x") * 900).alias("x"), (4200000 + F.col("y") * 40).alias("y"), F.col("z"))
    curved, matrix = gr.curvature(flat, 35, False)
    back = gr.curvature_undone(curved, 35, False, matrix).select("id", *[F.col(a).alias(f"{a}2") for a in "xyz"])
    return flat.join(back, "id").select("id", *[(F.round(F.col(a) - F.col(f"{a}2"), 3) + 0.0).alias(a) for a in "xyz"])


def dem_fit(spark: SparkSession, d: str) -> DataFrame:
    """How far a cloud that was moved off its reference is from it, before and after the fit."""
    reference = dref(spark, d).select("r", "c", (500 + 200 * F.sin(F.col("r") / 6.0) * F.cos(F.col("c") / 7.0) + F.col("val") / 10).alias("val"))
    points = reference.select((F.col("r").cast("long") * 40 + F.col("c")).alias("id"), (F.col("c") * 100.0 + 20).alias("x"), (3900 - F.col("r") * 100.0).alias("y"), (F.col("val") + 30).alias("z"))
    bounds = gr.bounds_of(translation=(0, 0, 100))
    start = gr.costs(points, reference, GRID, bounds, (0.0, 0.0, 0.0), [{"tz": 0.5}])[0][1]
    fit = gr.optimize(points, reference, GRID, bounds, rounds=30)
    return spark.createDataFrame([(round(start, 3), round(fit.rmse, 1))], "before double, after double")


QUERIES = {
    "to_float": to_float, "valid_rows": valid_rows, "line_means": line_means, "world_window": world_window, "stereo_overlap": stereo_overlap, "edge_blanks": edge_blanks, "valid_disparity": valid_disparity,
    "spacing_median": spacing_median, "spacing_top": spacing_top, "converged": converged, "best_scale": best_scale, "best_pose": best_pose, "stitch_is_sane": stitch_is_sane, "region_tries": region_tries,
    "pyramid_levels": pyramid_levels, "file_stems": file_stems, "hamming_nearest": hamming_nearest, "matches_sorted": matches_sorted, "image_crop": image_crop, "keypoint_cells": keypoint_cells, "unstable_terrain": unstable_terrain, "curvature_round_trip": curvature_round_trip, "dem_fit": dem_fit,
}

_D = "CAST({} AS DOUBLE)".format
_S = "s AS (SELECT s_suppkey AS k, s_nationkey AS nation, s_acctbal AS bal FROM supplier)"
_MAP = f"{_D(0.002)} * {{x}} + {_D(0.0003)} * {{y}} + 30", f"{_D(-0.0002)} * {{x}} + {_D(0.0021)} * {{y}} + 42"
_CORNERS = "(VALUES (1, 0, 0), (2, 1, 0), (3, 1, 1), (4, 0, 1)) t(corner, right_, low_)"


def _footprint(name: str, width: int, height: int, m: str) -> str:
    """Bounds in the world of the image corners."""
    return f"""{name} AS (SELECT pair, min(a * u + b * v + c) AS x0, max(a * u + b * v + c) AS x1, min(d * u + e * v + f) AS y0, max(d * u + e * v + f) AS y1 FROM {m}, (VALUES (1, -1), ({width}, -1), (1, -{height}), ({width}, -{height})) t(u, v) GROUP BY pair)"""


def _side(name: str, side: str, width: int, height: int, m: str) -> str:
    return f"""{name} AS (SELECT pair, '{side}' AS side, greatest(1, least(least(ax, bx), {width})) AS x0, greatest(1, least(least(ay, by_), {height})) AS y0, greatest(1, least(greatest(ax, bx), {width})) AS x1, greatest(1, least(greatest(ay, by_), {height})) AS y1 FROM (
      SELECT pair, floor(abs((e * (x0 - c) - b * (y0 - f)) / (a * e - b * d))) AS ax, floor(abs((a * (y0 - f) - d * (x0 - c)) / (a * e - b * d))) AS ay, floor(abs((e * (x1 - c) - b * (y1 - f)) / (a * e - b * d))) AS bx, floor(abs((a * (y1 - f) - d * (x1 - c)) / (a * e - b * d))) AS by_ FROM o JOIN {m} USING (pair)))"""


SQL = {
    "to_float": f"{with_sql('img')}, v AS (SELECT side, r, c, CASE WHEN side = 'F' THEN val * 260 - 2 ELSE val * CAST('1.5' AS DOUBLE) - CAST('0.25' AS DOUBLE) END AS val FROM img), m AS (SELECT side, max(val) AS m FROM v GROUP BY side) SELECT side, r, c, CASE WHEN val IS NOT NULL THEN round(greatest(0, least(1, CASE WHEN m > 1 THEN val / 255 ELSE val END)), 9) END AS val FROM v JOIN m USING (side)",
    "valid_rows": f"{with_sql('dref')}, q AS (SELECT r FROM dref GROUP BY r HAVING avg(CASE WHEN coalesce(val, 0) > 150 THEN 1.0 ELSE 0.0 END) > {_D(0.4)}), n AS (SELECT count(*) AS n, min(r) AS a, max(r) + 1 AS b FROM q) SELECT least_ AS least, CASE WHEN n >= least_ THEN a ELSE 0 END AS first, CASE WHEN n >= least_ THEN b ELSE 40 END AS last FROM n, (VALUES (1000), (3)) t(least_)",
    "line_means": f"{with_sql('dref')}, v AS (SELECT r, c, CASE WHEN val * {_D(1.5)} > 250 THEN 0 ELSE val * {_D(1.5)} END AS val FROM dref), h AS (SELECT r, avg(val) AS h FROM v GROUP BY r), w AS (SELECT c, avg(val) AS w FROM v GROUP BY c) SELECT v.r, v.c, round(least(h, w), 6) AS val FROM v JOIN h ON h.r = v.r JOIN w ON w.c = v.c",
    "world_window": f"""WITH {_S}, w AS (SELECT k, CAST(k * 10 AS DOUBLE) AS x0, CAST(400 AS DOUBLE) AS y0, CAST(1000 AS DOUBLE) - k AS x1, CAST(nation * 30 AS DOUBLE) AS y1 FROM s),
      p AS (SELECT k, corner, CASE WHEN right_ = 1 THEN greatest(x0, x1) ELSE least(x0, x1) END AS u, -CASE WHEN low_ = 1 THEN greatest(y0, y1) ELSE least(y0, y1) END AS v FROM w, {_CORNERS})
      SELECT k AS "window", corner, round({_MAP[0].format(x="u", y="v")}, 7) AS x, round({_MAP[1].format(x="u", y="v")}, 7) AS y FROM p""",
    "stereo_overlap": f"""WITH {_S}, lm AS (SELECT k AS pair, {_D(0.002)} AS a, {_D(0.0003)} AS b, {_D(30)} AS c, {_D(-0.0002)} AS d, {_D(0.0021)} AS e, {_D(42)} AS f FROM s),
      rm AS (SELECT k AS pair, {_D(0.002)} AS a, {_D(0.0003)} * 2 AS b, {_D(30)} + k % 40 / {_D(10)} - 1 AS c, {_D(-0.0002)} AS d, {_D(0.0021)} AS e, {_D(42)} + nation / {_D(10)} - 1 AS f FROM s),
      {_footprint("l", 3000, 2000, "lm")}, {_footprint("r", 2800, 2100, "rm")}, o AS (SELECT pair, greatest(l.x0, r.x0) AS x0, least(l.x1, r.x1) AS x1, greatest(l.y0, r.y0) AS y0, least(l.y1, r.y1) AS y1 FROM l JOIN r USING (pair)),
      {_side("ls", "l", 3000, 2000, "lm")}, {_side("rs", "r", 2800, 2100, "rm")}
      SELECT pair, side, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(greatest(x1, x0 + 1) AS INT) AS x1, CAST(greatest(y1, y0 + 1) AS INT) AS y1 FROM (SELECT * FROM ls UNION ALL SELECT * FROM rs)""",
    "edge_blanks": f"""{with_sql("dref").replace("WITH", "WITH RECURSIVE")}, b AS (SELECT r, c FROM dref WHERE val < 145), walk(r, c) AS (SELECT r, c FROM b WHERE r IN (0, 39) OR c IN (0, 39) UNION SELECT b.r, b.c FROM walk w JOIN b ON abs(b.r - w.r) <= 1 AND abs(b.c - w.c) <= 1)
      SELECT DISTINCT CAST(r + dy.range - 1 AS INT) AS r, CAST(c + dx.range - 1 AS INT) AS c FROM walk, range(3) dy, range(3) dx WHERE r + dy.range - 1 BETWEEN 0 AND 39 AND c + dx.range - 1 BETWEEN 0 AND 39""",
    "valid_disparity": f"{with_sql('dref')} SELECT r, c, CASE WHEN r >= 3 AND val BETWEEN 130 AND 170 THEN round(val, 9) END AS val FROM dref",
    "spacing_median": f"{with_sql('geo')}, p AS (SELECT abs(lat - lag(lat) OVER (ORDER BY id)) AS step FROM geo) SELECT round(greatest(quantile_cont(step, 0.5) * 111320 * 2, 1), 6) AS resolution FROM p WHERE step IS NOT NULL",
    "spacing_top": f"{with_sql('geo')}, p AS (SELECT abs(round(lat * 24) - lag(round(lat * 24)) OVER (ORDER BY id)) AS step FROM geo), n AS (SELECT step, count(*) AS n FROM p WHERE step IS NOT NULL GROUP BY 1 ORDER BY n DESC, step LIMIT 3) SELECT round(greatest(avg(step), 1), 6) AS resolution FROM n",
    "converged": f"""WITH c AS (SELECT c_nationkey AS fit, c_custkey AS step, {_D(10)} / (c_custkey + 1) + c_custkey % 7 / {_D(100)} AS rmse FROM customer),
      w AS (SELECT *, count(*) OVER l AS n, max(rmse) OVER l - min(rmse) OVER l AS spread FROM c WINDOW l AS (PARTITION BY fit ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT fit, min(CASE WHEN n = 10 AND spread < {_D(0.1)} THEN step END) AS step FROM w GROUP BY fit""",
    "best_scale": "WITH n AS (SELECT p_partkey % 9 AS image, p_size % 11 AS scale, count(*) FILTER (p_retailprice > 1200) AS inliers FROM part GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY inliers DESC, scale) AS k FROM n) SELECT image, scale, inliers FROM o WHERE k = 1",
    "best_pose": f"WITH {_S}, o AS (SELECT nation, k AS pose, row_number() OVER (PARTITION BY nation ORDER BY abs(bal - 3000), k) AS n FROM s) SELECT nation, pose FROM o WHERE n = 1",
    "stitch_is_sane": f"WITH {_S} SELECT k, k % 13 / {_D(10)} + {_D(0.4)} BETWEEN {_D(0.7)} AND {_D(1.4)} AND abs(bal / 400) <= 15 AS sane FROM s",
    "region_tries": f"""WITH {_S}, t AS (SELECT k % 20 AS region, CAST(floor(k / {_D(20)}) AS BIGINT) AS attempt, abs(bal) / 100 AS rmse FROM s), d AS (SELECT *, coalesce(min(rmse) OVER (PARTITION BY region ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 25, false) AS done FROM t)
      SELECT region, attempt, round(rmse, 6) AS rmse, row_number() OVER (PARTITION BY region ORDER BY rmse, attempt) = 1 AS best FROM d WHERE NOT done""",
    "pyramid_levels": f"{with_sql('href')}, a AS (SELECT CAST(floor(r / 2.0) AS INT) AS r, CAST(floor(c / 2.0) AS INT) AS c, avg(val) AS val FROM href GROUP BY 1, 2), b AS (SELECT CAST(floor(r / 5.0) AS INT) AS r, CAST(floor(c / 5.0) AS INT) AS c, avg(val) AS val FROM a GROUP BY 1, 2) SELECT 1 AS level, r, c, round(val, 4) AS val FROM a UNION ALL SELECT 2, r, c, round(val, 4) FROM b",
    "file_stems": "SELECT p_partkey AS image, 'D3C-' || p_partkey || '_a' AS stem, 'D3C-' || p_partkey AS strip FROM part",
    "hamming_nearest": f"{with_sql('codes')}, p AS (SELECT a.label, a.id AS qid, b.id AS tid, CAST(len(list_filter(range(1, 65), lambda i: (a.v[i] > 0) <> (b.v[i] > 0))) AS INT) AS dist FROM codes a JOIN codes b USING (label) WHERE a.id % 2 = 0 AND b.id % 2 = 1), o AS (SELECT *, row_number() OVER (PARTITION BY label, qid ORDER BY dist, tid) AS n FROM p) SELECT label, qid, tid, dist FROM o WHERE n = 1",
    "matches_sorted": f"{with_sql('codes')} SELECT a.id AS qid, b.id AS tid, CAST(len(list_filter(range(1, 65), lambda i: (a.v[i] > 0) <> (b.v[i] > 0))) AS INT) AS dist FROM codes a JOIN codes b USING (label) WHERE a.id % 2 = 0 AND b.id % 2 = 1",
    "image_crop": f"{with_sql('img')} SELECT side, r - 10 AS r, c - 4 AS c, round(val, 9) AS val FROM img WHERE r BETWEEN 10 AND 59 AND c BETWEEN 4 AND 39",
    "keypoint_cells": f"WITH {_S}, p AS (SELECT CAST(k * 37 % 1000 AS DOUBLE) AS x, bal / 10 AS y FROM s) SELECT CAST(floor(x / 180) AS INT) AS kx, CAST(floor(y / 140) AS INT) AS ky, count(*) AS n FROM p WHERE x >= 0 AND x < 900 AND y >= 0 AND y < 700 GROUP BY 1, 2",
    "unstable_terrain": f"""{with_sql("dref")}, e AS (SELECT * FROM (VALUES {", ".join(f"({k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for k, ring in POLYGONS.items() for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))}) t(k, x1, y1, x2, y2)),
      i AS (SELECT r, c, k FROM dref, e WHERE (y1 > 3900 - r * 100) <> (y2 > 3900 - r * 100) AND c * 100 < (x2 - x1) * (3900 - r * 100 - y1) / (y2 - y1) + x1 GROUP BY r, c, k HAVING count(*) % 2 = 1)
      SELECT r, c, round(val, 6) AS val FROM dref d WHERE EXISTS (SELECT 1 FROM i WHERE (i.r - d.r) * (i.r - d.r) + (i.c - d.c) * (i.c - d.c) <= 9)""",
    "curvature_round_trip": f"{with_sql('tgt')} SELECT id, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z FROM tgt",
}
