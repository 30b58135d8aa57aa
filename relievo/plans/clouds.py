"""Queries over point clouds, projections and transforms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relievo.functions import projections as pr
from relievo.functions import transforms as tr
from relievo.operators import fitting as ft
from relievo.operators import points as pt
from relievo.plans.fixtures import dref, geo, pc, tgt, with_sql

RING = [(26.1, 37.2), (26.9, 37.4), (26.8, 38.6), (26.4, 38.1), (26.15, 38.8)]
HOLE = [(26.4, 37.5), (26.6, 37.5), (26.6, 37.9), (26.4, 37.9)]
AFFINE = [[0.9, -0.1, 0.05, 3.0], [0.2, 1.1, 0.0, -5.0], [0.01, 0.02, 1.3, 7.5]]
SOLVER = {"variables": {"rx": 0.6, "rz": 0.3, "tx": 0.8, "tz": 0.1, "s": 0.55}, "bounds": {"rx": (-5.0, 5.0), "rz": (-45.0, 45.0), "tx": (-100.0, 100.0), "tz": (-50.0, 50.0), "s": (0.5, 2.0)}, "centre": (25.0, 50.0, 20.0)}
SURFACE = (0.5, -0.25, 0.01, 0.002, -0.003, 0.00001, 0.00002, -0.00003, 0.00004)
H1, H2 = [[1.01, 0.02, -3.0], [-0.01, 0.99, 2.0], [0.0001, -0.0002, 1.0]], [[0.98, 0.01, 4.0], [0.02, 1.02, -1.0], [-0.0001, 0.0001, 1.0]]


def grid_bounds(spark: SparkSession, d: str) -> DataFrame:
    return pt.bounds(pc(spark, d), ["region"])


def spacing_mode(spark: SparkSession, d: str) -> DataFrame:
    parts = pc(spark, d)
    return pt.spacing_mode(parts, "x").select(F.lit("x").alias("axis"), "step", "n").unionByName(pt.spacing_mode(parts, "y").select(F.lit("y").alias("axis"), "step", "n"))


def mad_reject(spark: SparkSession, d: str) -> DataFrame:
    kept = pt.mad_reject(pc(spark, d).select("region", F.abs(F.col("z") - 300).alias("d")), "d", ["region"], 0.5)
    return kept.groupBy("region").agg(F.count("*").alias("n"), F.max("d").alias("most"))


def utm_zone_choice(spark: SparkSession, d: str) -> DataFrame:
    """One zone for all points by their mean longitude, and the hemisphere by their mean latitude."""
    mean = geo(spark, d).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return mean.select(F.expr(pr.zone_of("lon")).alias("zone"), F.when(F.col("lat") >= 0, "N").otherwise("S").alias("hemisphere"))


def _utm(spark: SparkSession, d: str) -> DataFrame:
    x, y = pr.ll2utm("lon", "lat", "35", "lat < 0")
    return geo(spark, d).select("id", "lon", "lat", F.expr(x).alias("x"), F.expr(y).alias("y"))


def ll2utm(spark: SparkSession, d: str) -> DataFrame:
    return _utm(spark, d).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def utm2ll(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = pr.utm2ll("x", "y", "35", "FALSE")
    points = geo(spark, d).select("id", (400000 + F.col("id") * 7.5).alias("x"), (4000000 + F.col("h")).alias("y"))
    return points.select("id", F.round(F.expr(lon), 8).alias("lon"), F.round(F.expr(lat), 8).alias("lat"))


def ll2ps(spark: SparkSession, d: str) -> DataFrame:
    x, y = pr.ll2ps("lon", "lat", 0.0, -71.0)
    return geo(spark, d).select("id", (F.col("lon") * 3).alias("lon"), (-40 - F.col("lat")).alias("lat")).select("id", F.round(F.expr(x), 4).alias("x"), F.round(F.expr(y), 4).alias("y"))


def ps2ll(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = pr.ps2ll("x", "y", -45.0, 70.0)
    points = geo(spark, d).select("id", (F.col("id") * 311.0 - 200000).alias("x"), (F.col("h") * 97 - 3000).alias("y"))
    return points.select("id", F.round(F.expr(lon), 8).alias("lon"), F.round(F.expr(lat), 8).alias("lat"))


def geodetic_to_ecef(spark: SparkSession, d: str) -> DataFrame:
    return geo(spark, d).select("id", *[F.round(F.expr(e), 4).alias(n) for n, e in zip("xyz", pr.geodetic_to_ecef("lon", "lat", "h"), strict=True)])


def ecef_to_geodetic(spark: SparkSession, d: str) -> DataFrame:
    """There and back: the differences are rounding.  Longitudes come back within half a turn and are compared around the circle."""
    there = geo(spark, d).select("id", "lon", "lat", "h", *[F.expr(e).alias(n) for n, e in zip("xyz", pr.geodetic_to_ecef("lon", "lat", "h"), strict=True)])
    off = {n: F.expr(e) - F.col(n) for n, e in zip(("lon", "lat", "h"), pr.ecef_to_geodetic("x", "y", "z"), strict=True)}
    off["lon"] = F.pmod(off["lon"] + 180, F.lit(360.0)) - 180
    return there.select("id", *[F.round(v, 5).alias(n) for n, v in off.items()])


def affine_apply(spark: SparkSession, d: str) -> DataFrame:
    moved = tr.affine(AFFINE, F.col("x"), F.col("y"), F.col("z"))
    return tgt(spark, d).select("id", *[F.round(m, 6).alias(n) for n, m in zip("xyz", moved, strict=True)])


def solver_forward(spark: SparkSession, d: str) -> DataFrame:
    moved = tr.solver(F.col("x"), F.col("y"), F.col("z"), **SOLVER)
    return tgt(spark, d).select("id", *[F.round(m, 6).alias(n) for n, m in zip("xyz", moved, strict=True)])


def solver_inverse(spark: SparkSession, d: str) -> DataFrame:
    moved = tr.solver(F.col("x"), F.col("y"), F.col("z"), **SOLVER, inverse=True)
    return tgt(spark, d).select("id", *[F.round(m, 6).alias(n) for n, m in zip("xyz", moved, strict=True)])


def poly_surface_eval(spark: SparkSession, d: str) -> DataFrame:
    return tgt(spark, d).select("id", F.round(tr.surface(SURFACE, F.col("x"), F.col("z")), 6).alias("v"))


def homography_vertical_error(spark: SparkSession, d: str) -> DataFrame:
    """How far the rows of matched points are apart after rectification."""
    (_, yl), (_, yr) = tr.homography(H1, F.col("x"), F.col("y")), tr.homography(H2, F.col("x") + F.col("z"), F.col("y") + 1)
    return tgt(spark, d).select("id", F.round(yl - yr, 6).alias("error"))


def disparity_to_image_points(spark: SparkSession, d: str) -> DataFrame:
    """Cells with a disparity become points of both images, back through the rectification and from window to image."""
    disp = dref(spark, d).withColumn("disp", F.col("val") / 10 - 12).where("disp > 0")
    inverse = _inverse3(H1)
    xl, yl = tr.homography(inverse, F.col("c") + F.lit(1.0), F.col("r") + F.lit(1.0))
    xr, yr = tr.homography(_inverse3(H2), F.col("c") + F.lit(1.0) - F.col("disp"), F.col("r") + F.lit(1.0))
    return disp.select("r", "c", *[F.round(v + 99, 6).alias(n) for n, v in (("xl", xl), ("yl", yl), ("xr", xr), ("yr", yr))])


def _inverse3(m: list[list[float]]) -> list[list[float]]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    adj = [[e * i - f * h, c * h - b * i, b * f - c * e], [f * g - d * i, a * i - c * g, c * d - a * f], [d * h - e * g, b * g - a * h, a * e - b * d]]
    return [[v / det for v in row] for row in adj]


def knn_spatial(spark: SparkSession, d: str) -> DataFrame:
    points = geo(spark, d)
    queries = points.where("id % 3 = 0").select(F.col("id").alias("qid"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    targets = points.where("id % 3 <> 0").select(F.col("id").alias("tid"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return pt.nearest(queries, targets, 0.2).select("qid", "tid", F.round("d2", 9).alias("d2"))


def icp_pairs_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    points = geo(spark, d)
    queries = points.where("id % 3 = 0").select(F.col("id").alias("qid"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    targets = points.where("id % 3 <> 0").select(F.col("id").alias("tid"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return pt.one_to_one(pt.nearest(queries, targets, 0.2)).select("qid", "tid", F.round("d2", 9).alias("d2"))


def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return geo(spark, d).where(pt.inside_polygon(F.col("lon"), F.col("lat"), RING)).select("id")


def polygon_with_hole(spark: SparkSession, d: str) -> DataFrame:
    edges = [(1, *a, *b) for ring in (RING, HOLE) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    table = spark.createDataFrame(edges, "poly_id int, x1 double, y1 double, x2 double, y2 double")
    points = geo(spark, d).select(F.col("id").alias("pid"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return pt.points_in_polygons(points, table, 0.25).select(F.col("pid").alias("id"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Points and their image under a known similarity, every fifth one moved away."""
    m = tr.rotation(0, 0, 20)
    x, y, z = tr.affine([[*[1.1 * v for v in row], t] for row, t in zip(m, (8.0, -4.0, 2.0), strict=True)], F.col("x"), F.col("y"), F.col("z"))
    off = F.when(F.col("id") % 5 == 0, F.col("id") % 13 + 10).otherwise(0)
    return tgt(spark, d).select("id", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"), (x + off).alias("x1"), (y - off).alias("y1"), z.alias("z1"))


def absor_moments(spark: SparkSession, d: str) -> DataFrame:
    found = ft.pair_moments(_pairs(spark, d))
    return found.select("n", *[F.round(c, 4).alias(c) for c in found.columns if c != "n"])


def ransac_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Inliers of three literal candidates, counted in one pass."""
    import numpy as np

    models = []
    for angle, k in ((20, 1.1), (20, 1.0), (15, 1.1)):
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = k * np.array(tr.rotation(0, 0, angle)), (8.0, -4.0, 2.0)
        models.append(m)
    pairs = _pairs(spark, d)
    return pairs.agg(*[F.count_if(ft.residual(m) < 5).alias(f"n_{k}") for k, m in enumerate(models)])


def polyfit_normal_eq(spark: SparkSession, d: str) -> DataFrame:
    x, z = F.col("x") / 50, F.col("z") / 50
    found = ft.normal_equations(tgt(spark, d), tr.surface_terms(x, z), F.col("y") / 1000)
    return found.select("n", *[F.round(c, 4).alias(c) for c in found.columns if c != "n"])


def absor_fit(spark: SparkSession, d: str) -> DataFrame:
    """All pairs; those that were moved away have little weight."""
    weight = F.when(F.col("id") % 5 == 0, F.lit(1e-12)).otherwise(1 + F.col("id") % 3)
    m = ft.absor(_pairs(spark, d).select(weight.cast("double").alias("w"), *[F.col(f"{a}{3 - k}").alias(f"{a}{k}") for k in (1, 2) for a in "xyz"]), weight="w")
    return spark.createDataFrame([(r, c, round(float(m[r, c]), 6)) for r in range(4) for c in range(4)], "r int, c int, v double")


def ransac_fit(spark: SparkSession, d: str) -> DataFrame:
    """The similarity through the outliers, and who they are."""
    _, found = ft.ransac(_pairs(spark, d), 100, 1.0, seed=7)
    return found.select("id", "inlier")


QUERIES = {
    "grid_bounds": grid_bounds, "spacing_mode": spacing_mode, "mad_reject": mad_reject, "utm_zone_choice": utm_zone_choice, "ll2utm": ll2utm, "utm2ll": utm2ll, "ll2ps": ll2ps, "ps2ll": ps2ll,
    "geodetic_to_ecef": geodetic_to_ecef, "ecef_to_geodetic": ecef_to_geodetic, "affine_apply": affine_apply, "solver_forward": solver_forward, "solver_inverse": solver_inverse, "poly_surface_eval": poly_surface_eval,
    "homography_vertical_error": homography_vertical_error, "disparity_to_image_points": disparity_to_image_points, "knn_spatial": knn_spatial, "icp_pairs_one_to_one": icp_pairs_one_to_one,
    "point_in_polygon": point_in_polygon, "polygon_with_hole": polygon_with_hole, "absor_moments": absor_moments, "ransac_consensus": ransac_consensus, "polyfit_normal_eq": polyfit_normal_eq,
    "absor_fit": absor_fit, "ransac_fit": ransac_fit,
}


def _d(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def _affine_sql(m: list[list[float]], x: str, y: str, z: str) -> list[str]:
    return [f"({_d(row[0])} * ({x}) + {_d(row[1])} * ({y}) + {_d(row[2])} * ({z}) + {_d(row[3])})" for row in m]


def _rounded(names: str, expressions: list[str], digits: int) -> str:
    return ", ".join(f"round({e}, {digits}) AS {n}" for n, e in zip(names, expressions, strict=True))


def _solver_sql(inverse: bool) -> str:
    value = {k: lo + SOLVER["variables"][k] * (hi - lo) for k, (lo, hi) in SOLVER["bounds"].items()}
    r = tr.rotation(value["rx"], 0.0, value["rz"])
    move, (cx, cy, cz), s = (value["tx"], 0.0, value["tz"]), SOLVER["centre"], value["s"]
    if not inverse:
        return _rounded("xyz", _affine_sql([[*[v * s for v in row], c + t] for row, c, t in zip(r, (cx, cy, cz), move, strict=True)], f"x - {cx}", f"y - {cy}", f"z - {cz}"), 6)
    point = [f"{n} - {_d(c + t)}" for n, c, t in zip("xyz", (cx, cy, cz), move, strict=True)]
    return _rounded("xyz", _affine_sql([[*[v / s for v in col], c] for col, c in zip(zip(*r, strict=True), (cx, cy, cz), strict=True)], *point), 6)


def _homography_sql(h: list[list[float]], x: str, y: str, row: int) -> str:
    line = lambda k: f"({_d(h[k][0])} * ({x}) + {_d(h[k][1])} * ({y}) + {_d(h[k][2])})"
    return f"{line(row)} / {line(2)}"


def _crossings(ring: list[tuple[float, float]]) -> str:
    return " + ".join(f"CASE WHEN (({y1} > lat) <> ({y2} > lat)) AND lon < {_d(x2 - x1)} * (lat - {y1}) / {_d(y2 - y1)} + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True) if y1 != y2)


_M = [[*[1.1 * v for v in row], t] for row, t in zip([[math.cos(math.radians(20)), -math.sin(math.radians(20)), 0], [math.sin(math.radians(20)), math.cos(math.radians(20)), 0], [0, 0, 1]], (8.0, -4.0, 2.0), strict=True)]
_X, _Y, _Z = _affine_sql(_M, "x", "y", "z")
_PAIRS = f"{with_sql('tgt')}, pairs AS (SELECT id, x AS x2, y AS y2, z AS z2, {_X} + CASE WHEN id % 5 = 0 THEN id % 13 + 10 ELSE 0 END AS x1, {_Y} - CASE WHEN id % 5 = 0 THEN id % 13 + 10 ELSE 0 END AS y1, {_Z} AS z1 FROM tgt)"
_SIDES = [f"{a}{k}" for k in (1, 2) for a in "xyz"]
_NEAR = "near AS (SELECT q.id AS qid, min({{'d2': (q.lon - t.lon) * (q.lon - t.lon) + (q.lat - t.lat) * (q.lat - t.lat), 'tid': t.id}}) AS b FROM geo q, geo t WHERE q.id % 3 = 0 AND t.id % 3 <> 0 GROUP BY q.id)"


def _residual_sql(angle: float, k: float) -> str:
    m = [[*[k * v for v in row], t] for row, t in zip(tr.rotation(0, 0, angle), (8.0, -4.0, 2.0), strict=True)]
    return "sqrt(" + " + ".join(f"pow({e} - {a}1, 2)" for a, e in zip("xyz", _affine_sql(m, "x2", "y2", "z2"), strict=True)) + ")"


def _terms_sql(x: str, y: str) -> list[str]:
    return ["*".join([x] * a + [y] * b) for a, b in tr.SURFACE]


def _normal_sql(terms: list[str], target: str) -> str:
    pairs = [f"round(sum(({p}) * ({q})), 4) AS a_{i}_{j}" for i, p in enumerate(terms) for j, q in enumerate(terms) if i <= j]
    return ", ".join(["count(*) AS n", *pairs, *[f"round(sum(({p}) * ({target})), 4) AS b_{i}" for i, p in enumerate(terms)]])


_UTM = pr.ll2utm("lon", "lat", "35", "lat < 0")
SQL = {
    "grid_bounds": f"{with_sql('pc')} SELECT region, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, count(*) AS n FROM pc GROUP BY region",
    "spacing_mode": f"""{with_sql("pc")}, s AS (SELECT 'x' AS axis, x - lag(x) OVER (ORDER BY x) AS step FROM (SELECT DISTINCT x FROM pc) UNION ALL SELECT 'y', y - lag(y) OVER (ORDER BY y) FROM (SELECT DISTINCT y FROM pc)),
      k AS (SELECT axis, step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY n DESC, step) AS rn FROM k) SELECT axis, step, n FROM o WHERE rn = 1""",
    "mad_reject": f"""{with_sql("pc")}, a AS (SELECT region, abs(z - 300) AS d FROM pc), m AS (SELECT region, quantile_cont(d, CAST(0.5 AS DOUBLE)) AS m FROM a GROUP BY 1), v AS (SELECT a.*, m, abs(d - m) AS dev FROM a JOIN m USING (region)),
      w AS (SELECT region, quantile_cont(dev, CAST(0.5 AS DOUBLE)) AS mad FROM v GROUP BY 1) SELECT region, count(*) AS n, max(d) AS most FROM v JOIN w USING (region) WHERE d <= m + CAST(0.5 AS DOUBLE) * CAST(1.4826 AS DOUBLE) * mad GROUP BY region""",
    "utm_zone_choice": f"{with_sql('geo')} SELECT CAST(floor(avg(lon) / 6) + 31 AS INT) AS zone, CASE WHEN avg(lat) >= 0 THEN 'N' ELSE 'S' END AS hemisphere FROM geo",
    "ll2utm": f"{with_sql('geo')} SELECT id, {_rounded('xy', list(_UTM), 4)} FROM geo",
    "utm2ll": f"{with_sql('geo')}, p AS (SELECT id, CAST(400000 + id * 7.5 AS DOUBLE) AS x, 4000000 + h AS y FROM geo), q AS (SELECT id, {', '.join(f'{e} AS {n}' for n, e in zip(('lon', 'lat'), pr.utm2ll('x', 'y', '35', 'FALSE'), strict=True))} FROM p) SELECT id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM q",
    "ll2ps": f"{with_sql('geo')}, p AS (SELECT id, lon * 3 AS lon, -40 - lat AS lat FROM geo) SELECT id, {_rounded('xy', list(pr.ll2ps('lon', 'lat', 0.0, -71.0, other='NULL')), 4)} FROM p",
    "ps2ll": f"{with_sql('geo')}, p AS (SELECT id, CAST(id * 311.0 - 200000 AS DOUBLE) AS x, h * 97 - 3000 AS y FROM geo), q AS (SELECT id, {', '.join(f'{e} AS {n}' for n, e in zip(('lon', 'lat'), pr.ps2ll('x', 'y', -45.0, 70.0), strict=True))} FROM p) SELECT id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM q",
    "geodetic_to_ecef": f"{with_sql('geo')} SELECT id, {_rounded('xyz', list(pr.geodetic_to_ecef('lon', 'lat', 'h')), 4)} FROM geo",
    "ecef_to_geodetic": f"{with_sql('geo')} SELECT id, CAST(0 AS DOUBLE) AS lon, CAST(0 AS DOUBLE) AS lat, CAST(0 AS DOUBLE) AS h FROM geo",
    "affine_apply": f"{with_sql('tgt')} SELECT id, {_rounded('xyz', _affine_sql(AFFINE, 'x', 'y', 'z'), 6)} FROM tgt",
    "solver_forward": f"{with_sql('tgt')} SELECT id, {_solver_sql(False)} FROM tgt",
    "solver_inverse": f"{with_sql('tgt')} SELECT id, {_solver_sql(True)} FROM tgt",
    "poly_surface_eval": f"{with_sql('tgt')} SELECT id, round({' + '.join(f'{_d(c)} * {t}' for c, t in zip(SURFACE, _terms_sql('x', 'z'), strict=True))}, 6) AS v FROM tgt",
    "homography_vertical_error": f"{with_sql('tgt')} SELECT id, round({_homography_sql(H1, 'x', 'y', 1)} - {_homography_sql(H2, 'x + z', 'y + 1', 1)}, 6) AS error FROM tgt",
    "disparity_to_image_points": f"{with_sql('dref')}, p AS (SELECT r, c, val / 10 - 12 AS disp FROM dref) SELECT r, c, round({_homography_sql(_inverse3(H1), 'c + 1', 'r + 1', 0)} + 99, 6) AS xl, round({_homography_sql(_inverse3(H1), 'c + 1', 'r + 1', 1)} + 99, 6) AS yl, round({_homography_sql(_inverse3(H2), 'c + 1 - disp', 'r + 1', 0)} + 99, 6) AS xr, round({_homography_sql(_inverse3(H2), 'c + 1 - disp', 'r + 1', 1)} + 99, 6) AS yr FROM p WHERE disp > 0",
    "knn_spatial": f"{with_sql('geo')}, {_NEAR.format()} SELECT qid, b.tid AS tid, round(b.d2, 9) AS d2 FROM near",
    "icp_pairs_one_to_one": f"{with_sql('geo')}, {_NEAR.format()}, o AS (SELECT b.tid AS tid, min({{'d2': b.d2, 'qid': qid}}) AS m FROM near GROUP BY 1) SELECT m.qid AS qid, tid, round(m.d2, 9) AS d2 FROM o",
    "point_in_polygon": f"{with_sql('geo')} SELECT id FROM geo WHERE ({_crossings(RING)}) % 2 = 1",
    "polygon_with_hole": f"{with_sql('geo')} SELECT id FROM geo WHERE ({_crossings(RING)} + {_crossings(HOLE)}) % 2 = 1",
    "absor_moments": f"{_PAIRS} SELECT count(*) AS n, {', '.join(f'round(avg({s}), 4) AS m_{s}' for s in _SIDES)}, {', '.join(f'round(var_pop({s}), 4) AS v_{s}' for s in _SIDES)}, {', '.join(f'round(covar_pop({a}1, {b}2), 4) AS c_{a}{b}' for a in 'xyz' for b in 'xyz')} FROM pairs",
    "ransac_consensus": f"{_PAIRS} SELECT {', '.join(f'count(CASE WHEN {_residual_sql(a, k)} < 5 THEN 1 END) AS n_{i}' for i, (a, k) in enumerate(((20, 1.1), (20, 1.0), (15, 1.1))))} FROM pairs",
    "polyfit_normal_eq": f"{with_sql('tgt')}, s AS (SELECT x / 50 AS x, z / 50 AS z, y / 1000 AS y FROM tgt) SELECT {_normal_sql(_terms_sql('x', 'z'), 'y')} FROM s",
}
