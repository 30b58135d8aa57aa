"""Queries over descriptors, windows and images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relievo.operators import cleanup as cl
from relievo.operators import fitting as ft
from relievo.operators import matching as mt
from relievo.operators import nearest as ne
from relievo.operators import rasters as ra
from relievo.operators import windows as wi
from relievo.plans.fixtures import dref, href, read, tgt, vectors, with_sql


def _codes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    codes = vectors(spark, d).select("id", "label", mt.sign_bits(F.col("v")).alias("code"))
    return codes.where("id % 2 = 0"), codes.where("id % 2 = 1")


def hamming_mutual_nn(spark: SparkSession, d: str) -> DataFrame:
    return ne.mutual_codes(*_codes(spark, d), ["label"])


def hamming_topk(spark: SparkSession, d: str) -> DataFrame:
    return ne.closest_codes(*_codes(spark, d), ["label"], 10)


def hamming_any_label(spark: SparkSession, d: str) -> DataFrame:
    """Nearest codes over the whole table, by bands of their bits."""
    left, right = (x.withColumn("label", F.lit(0)) for x in _codes(spark, d))
    return ne.nearest_codes(left, right, ["label"], few=1 << 10).select("qid", "tid", "dist")


def euclid_nn(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("id", "label", F.col("v").alias("vec"))
    return mt.euclidean_nearest(v.where("id % 3 = 0"), v.where("id % 3 <> 0"), ["label"]).select("label", "qid", "tid", F.round("d2", 6).alias("d2"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), F.col("s_suppkey").alias("window"), F.col("s_acctbal").alias("bal"))


def roi_windows(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d)
    left, right = w.withColumn("points", F.floor("bal").cast("long")), w.withColumn("points", F.floor(F.col("bal") - 1000).cast("long"))
    return mt.roi_windows(left, right, [0, 2, 3])


def window_status_filter(spark: SparkSession, d: str) -> DataFrame:
    """Windows with a result, in order, and how many of a region are missing."""
    w = _windows(spark, d).withColumn("rmse", F.when(F.col("bal") > 0, F.col("bal") / 100))
    return w.groupBy("region").agg(F.count("*").alias("windows"), F.count("rmse").alias("done"), F.count_if(F.col("rmse") <= 25).alias("good"), F.round(F.min("rmse"), 6).alias("least"))


def _images(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("image"), (F.col("p_size") * 100 + 37).alias("rows"), (F.col("p_size") * 70 + 11).alias("cols"))


def block_index(spark: SparkSession, d: str) -> DataFrame:
    return wi.blocks(_images(spark, d), 900)


#: Images to their common plane.
LEFT, RIGHT = [[1.0, 0.01, 30.0], [-0.02, 1.0, 12.0], [0.0, 0.0, 1.0]], [[1.0, 0.0, 5.0], [0.0, 1.0, -8.0], [0.000001, 0.0, 1.0]]


def compute_windows(spark: SparkSession, d: str) -> DataFrame:
    i = _images(spark, d)
    rois = i.select(F.col("image").alias("roi"), F.lit(10).alias("x0"), F.lit(20).alias("y0"), (F.col("cols") * 3 - 5).alias("x1"), (F.col("rows") * 3 - 9).alias("y1"), (F.col("cols") * 3).alias("width"), (F.col("rows") * 3).alias("height"), (F.col("cols") * 3 - 40).alias("right_width"), (F.col("rows") * 3 + 25).alias("right_height"))
    return wi.compute_windows(rois, LEFT, RIGHT, 2200, 150)


def axis_vectors(spark: SparkSession, d: str) -> DataFrame:
    grids = read(spark, d, "nation").select(F.col("n_nationkey").alias("grid"), F.lit(30.0).alias("x0"), (31.0 + F.col("n_nationkey")).alias("x1"), F.lit(38.0).alias("y0"), F.lit(40.0).alias("y1"), (F.col("n_nationkey") + 2).alias("cols"), (F.col("n_nationkey") * 2 + 3).alias("rows"))
    return wi.axis_vectors(grids).select("grid", "axis", "k", F.round("v", 9).alias("v"))


def image_sort_order(spark: SparkSession, d: str) -> DataFrame:
    place = read(spark, d, "supplier").select(F.col("s_suppkey").alias("image"), ((F.col("s_suppkey") * 37) % 101).cast("double").alias("x"), (F.col("s_nationkey") * 1.5).alias("y"))
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    corners = place.select("image", corner(0.0, 3.0).alias("nw"), corner(4.0, 4.0).alias("ne"), corner(4.5, 1.0).alias("se"), corner(0.5, 0.0).alias("sw"))
    return wi.sort_images(corners).select("image", F.round("along", 6).alias("along"))


def keypoint_extrema_rank(spark: SparkSession, d: str) -> DataFrame:
    return mt.keypoint_extrema(dref(spark, d), size=8, stride=2, passes=3, top=10)


def _slopes(spark: SparkSession, d: str) -> DataFrame:
    moved = dref(spark, d).select("r", (F.col("c") + 1).alias("c"), (F.col("val") + 5).alias("moved"))
    return ra.slope_aspect(dref(spark, d), 30.0, 20.0).join(moved, ["r", "c"]).select((F.col("val") - F.col("moved")).alias("d"), "slope", "aspect")


def nuth_kaab_normal_eq(spark: SparkSession, d: str) -> DataFrame:
    terms = [F.cos(F.radians("aspect")), F.sin(F.radians("aspect")), F.lit(1.0)]
    found = ft.normal_equations(ft.nuth_kaab_rows(_slopes(spark, d)), terms, F.col("y"))
    return found.select("n", *[F.round(c, 4).alias(c) for c in found.columns if c != "n"])


def nuth_kaab_fit(spark: SparkSession, d: str) -> DataFrame:
    shift = ft.nuth_kaab(_slopes(spark, d), 30.0, 20.0)
    return spark.createDataFrame([tuple(round(float(v), 6) for v in shift)], "dx double, dy double, dz double")


def components_clean(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the regions of high cells, by 4-connectivity."""
    return cl.regions(dref(spark, d).where("val > 250")).groupBy("size").agg(F.count_distinct("region").alias("regions"))


def raster_clean(spark: SparkSession, d: str) -> DataFrame:
    return cl.clean(href(spark, d), small_gap=2, small_island=3).select("r", "c", F.round("val", 6).alias("val"))


def inpaint(spark: SparkSession, d: str) -> DataFrame:
    return cl.inpaint(href(spark, d)).select("r", "c", F.round("val", 3).alias("val"))


def mesh_denoise(spark: SparkSession, d: str) -> DataFrame:
    return cl.mesh_denoise(dref(spark, d), 30.0, 20.0).select("r", "c", F.round("val", 4).alias("val"))


#: Two cameras, 100 apart.
P1 = np.array([[1000.0, 0, 320, 0], [0, 1000, 240, 0], [0, 0, 1, 0]])
P2 = np.array([[1000.0, 0, 320, -100000], [0, 1000, 240, 0], [0, 0, 1, 0]])


def triangulate(spark: SparkSession, d: str) -> DataFrame:
    """Points seen by both cameras come back."""
    points = tgt(spark, d).select("id", "x", (F.col("y") / 100).alias("y"), (F.col("z") + 100).alias("z"))
    seen = points.select("id", *[(F.lit(float(f)) * F.col(a) / F.col("z") + F.lit(float(c)) - F.lit(b) / F.col("z")).alias(n) for n, f, a, c, b in (("xl", 1000, "x", 320, 0.0), ("yl", 1000, "y", 240, 0.0), ("xr", 1000, "x", 320, 100000.0), ("yr", 1000, "y", 240, 0.0))])
    return ft.triangulate(seen, P1, P2).select("id", *[F.round(c, 4).alias(c) for c in "xyz"])


def block_process(spark: SparkSession, d: str) -> DataFrame:
    """A kernel on tiles with a halo: the mean of the cells to the left and right."""
    def kernel(tile: np.ndarray) -> np.ndarray:
        wide = np.pad(tile, ((0, 0), (1, 1)), mode="edge")
        return (wide[:, :-2] + wide[:, 2:]) / 2

    found = wi.block_process(dref(spark, d), 16, 1, kernel)
    return found.select("r", "c", F.round(F.col("val").cast(T.DoubleType()), 9).alias("val"))


QUERIES = {
    "hamming_mutual_nn": hamming_mutual_nn, "hamming_topk": hamming_topk, "hamming_any_label": hamming_any_label, "euclid_nn": euclid_nn, "roi_windows": roi_windows, "window_status_filter": window_status_filter, "block_index": block_index,
    "compute_windows": compute_windows, "axis_vectors": axis_vectors, "image_sort_order": image_sort_order, "keypoint_extrema_rank": keypoint_extrema_rank, "nuth_kaab_normal_eq": nuth_kaab_normal_eq,
    "nuth_kaab_fit": nuth_kaab_fit, "components_clean": components_clean, "raster_clean": raster_clean, "inpaint": inpaint, "mesh_denoise": mesh_denoise, "triangulate": triangulate, "block_process": block_process,
}

_CODES = f"{with_sql('codes')}, h AS (SELECT id, label, v FROM codes)"
_PAIRS = f"{_CODES}, p AS (SELECT a.label, a.id AS qid, b.id AS tid, CAST(len(list_filter(range(1, 65), lambda i: (a.v[i] > 0) <> (b.v[i] > 0))) AS INT) AS dist FROM h a JOIN h b USING (label) WHERE a.id % 2 = 0 AND b.id % 2 = 1)"
_WIN = "WITH w AS (SELECT n_regionkey AS region, s_suppkey AS window_id, s_acctbal AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_IMAGES = "WITH i AS (SELECT p_partkey AS image, p_size * 100 + 37 AS rows_, p_size * 70 + 11 AS cols FROM part)"
_AROUND_SLOPES = """h0 AS (SELECT *, lag(val) OVER (PARTITION BY r ORDER BY c) AS w0, lead(val) OVER (PARTITION BY r ORDER BY c) AS e0 FROM dref),
      h AS (SELECT r, c, val, CASE WHEN c = 0 THEN 2 * val - e0 ELSE w0 END AS w, CASE WHEN c = 39 THEN 2 * val - w0 ELSE e0 END AS e FROM h0),
      v0 AS (SELECT *, lag(val) OVER (PARTITION BY c ORDER BY r) AS n0, lead(val) OVER (PARTITION BY c ORDER BY r) AS s0 FROM h),
      nb AS (SELECT r, c, val, (e - w) / 60.0 AS p, (CASE WHEN r = 0 THEN 2 * val - s0 ELSE n0 END - CASE WHEN r = 39 THEN 2 * val - n0 ELSE s0 END) / 40.0 AS q FROM v0),
      sl AS (SELECT r, c, val, degrees(atan(sqrt(p * p + q * q))) AS slope, degrees(atan2(p, q)) + 180 AS aspect FROM nb),
      df AS (SELECT s.val - (m.val + 5) AS d, slope, aspect FROM sl s JOIN dref m ON m.r = s.r AND m.c + 1 = s.c),
      cut AS (SELECT quantile_cont(d, CAST(0.02 AS DOUBLE)) AS lo, quantile_cont(d, CAST(0.98 AS DOUBLE)) AS hi FROM df WHERE d IS NOT NULL AND slope IS NOT NULL),
      nk AS (SELECT *, d / tan(radians(slope)) AS y, cos(radians(aspect)) AS t0, sin(radians(aspect)) AS t1, 1.0 AS t2 FROM df, cut WHERE d BETWEEN lo AND hi AND slope > 5 AND slope < 75)"""

SQL = {
    "hamming_mutual_nn": f"{_PAIRS}, a AS (SELECT *, row_number() OVER (PARTITION BY label, qid ORDER BY dist, tid) AS x, row_number() OVER (PARTITION BY label, tid ORDER BY dist, qid) AS y FROM p) SELECT label, qid, tid, dist FROM a WHERE x = 1 AND y = 1",
    "hamming_topk": f"{_PAIRS}, a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, qid, tid) AS rank FROM p) SELECT * FROM a WHERE rank <= 10",
    "hamming_any_label": f"{_CODES}, p AS (SELECT a.id AS qid, b.id AS tid, CAST(len(list_filter(range(1, 65), lambda i: (a.v[i] > 0) <> (b.v[i] > 0))) AS INT) AS dist FROM h a, h b WHERE a.id % 2 = 0 AND b.id % 2 = 1), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS x FROM p) SELECT qid, tid, dist FROM o WHERE x = 1",
    "euclid_nn": f"{_CODES}, p AS (SELECT a.label, a.id AS qid, b.id AS tid, list_sum(list_transform(range(1, 65), lambda i: (CAST(a.v[i] AS DOUBLE) - CAST(b.v[i] AS DOUBLE)) * (CAST(a.v[i] AS DOUBLE) - CAST(b.v[i] AS DOUBLE)))) AS d2 FROM h a JOIN h b USING (label) WHERE a.id % 3 = 0 AND b.id % 3 <> 0), o AS (SELECT *, row_number() OVER (PARTITION BY label, qid ORDER BY d2, tid) AS x FROM p) SELECT label, qid, tid, round(d2, 6) AS d2 FROM o WHERE x = 1",
    "roi_windows": f'{_WIN} SELECT region, window_id AS "window", CAST(floor(bal) AS BIGINT) AS left_points, CAST(floor(bal - 1000) AS BIGINT) AS right_points FROM w WHERE floor(bal) > 0 AND floor(bal - 1000) > 0 AND region IN (0, 2, 3)',
    "window_status_filter": f"{_WIN}, s AS (SELECT region, CASE WHEN bal > 0 THEN bal / 100 END AS rmse FROM w) SELECT region, count(*) AS windows, count(rmse) AS done, count(CASE WHEN rmse <= 25 THEN 1 END) AS good, round(min(rmse), 6) AS least FROM s GROUP BY region",
    "block_index": f"""{_IMAGES}, n AS (SELECT *, greatest(1, CAST(ceil(rows_ / 900.0) AS INT)) AS ny, greatest(1, CAST(ceil(cols / 900.0) AS INT)) AS nx FROM i)
      SELECT image, CAST(a.range AS INT) AS ty, CAST(b.range AS INT) AS tx, CAST(round_even(rows_ * a.range / ny, 0) AS INT) AS r0, CAST(round_even(rows_ * (a.range + 1) / ny, 0) AS INT) AS r1, CAST(round_even(cols * b.range / nx, 0) AS INT) AS c0, CAST(round_even(cols * (b.range + 1) / nx, 0) AS INT) AS c1
      FROM n, range(10) a, range(10) b WHERE a.range < ny AND b.range < nx""",
    # RIGHT takes (x, y) to ((x + 5) / w, (y - 8) / w) with w = 1 + x / 1000000, so a point (u, v) of the plane is seen at x = (u - 5) / (1 - u / 1000000) and y = v * w + 8.
    "compute_windows": f"""{_IMAGES}, q AS (SELECT image AS roi, 10 AS x0, 20 AS y0, cols * 3 - 5 AS x1, rows_ * 3 - 9 AS y1, cols * 3 AS width, rows_ * 3 AS height, cols * 3 - 40 AS rw, rows_ * 3 + 25 AS rh FROM i),
      n AS (SELECT *, greatest(1, CAST(round_even((x1 - x0 + 1) / CAST(2200 AS DOUBLE), 0) AS INT)) AS nx, greatest(1, CAST(round_even((y1 - y0 + 1) / CAST(2200 AS DOUBLE), 0) AS INT)) AS ny FROM q),
      l AS (SELECT roi, rw, rh, CAST(a.range * ny + b.range + 1 AS INT) AS "window", greatest(1, round_even(x0 + (x1 - x0) * CAST(a.range AS DOUBLE) / nx, 0) - 150) AS ax, greatest(1, round_even(y0 + (y1 - y0) * CAST(b.range AS DOUBLE) / ny, 0) - 150) AS ay,
        least(width, round_even(x0 + (x1 - x0) * CAST(a.range + 1 AS DOUBLE) / nx, 0) + 150) AS bx, least(height, round_even(y0 + (y1 - y0) * CAST(b.range + 1 AS DOUBLE) / ny, 0) + 150) AS by_ FROM n, range(12) a, range(12) b WHERE a.range < nx AND b.range < ny),
      u AS (SELECT *, ax + CAST('0.01' AS DOUBLE) * ay + 30 AS ua, CAST('-0.02' AS DOUBLE) * ax + ay + 12 AS va, bx + CAST('0.01' AS DOUBLE) * by_ + 30 AS ub, CAST('-0.02' AS DOUBLE) * bx + by_ + 12 AS vb FROM l),
      x AS (SELECT *, (ua - 5) / (1 - ua / CAST(1000000 AS DOUBLE)) AS pa, (ub - 5) / (1 - ub / CAST(1000000 AS DOUBLE)) AS pb FROM u),
      r AS (SELECT *, greatest(1, pa) AS cx, greatest(1, va * (1 + pa / CAST(1000000 AS DOUBLE)) + 8) AS cy, least(rw, pb) AS dx, least(rh, vb * (1 + pb / CAST(1000000 AS DOUBLE)) + 8) AS dy FROM x),
      s AS (SELECT *, least(bx - ax, dx - cx) - 1 AS sx, least(by_ - ay, dy - cy) - 1 AS sy FROM r)
      SELECT roi, "window", {", ".join(f"CAST(round_even(({a} + {b}) / 2 {sign} s{k} / 2, 0) AS INT) AS {name}" for name, a, b, sign, k in (("lx0", "ax", "bx", "-", "x"), ("ly0", "ay", "by_", "-", "y"), ("lx1", "ax", "bx", "+", "x"), ("ly1", "ay", "by_", "+", "y"), ("rx0", "cx", "dx", "-", "x"), ("ry0", "cy", "dy", "-", "y"), ("rx1", "cx", "dx", "+", "x"), ("ry1", "cy", "dy", "+", "y")))} FROM s""",
    "axis_vectors": """WITH g AS (SELECT n_nationkey AS grid, 30.0 AS x0, CAST(31.0 + n_nationkey AS DOUBLE) AS x1, n_nationkey + 2 AS cols, n_nationkey * 2 + 3 AS rows_ FROM nation)
      SELECT grid, 'x' AS axis, CAST(k.range AS INT) AS k, round(CAST(x0 AS DOUBLE) + (k.range + CAST(0.5 AS DOUBLE)) * (x1 - CAST(x0 AS DOUBLE)) / cols, 9) AS v FROM g, range(30) k WHERE k.range < cols
      UNION ALL SELECT grid, 'y', CAST(k.range AS INT), round(CAST(40 AS DOUBLE) - (k.range + CAST(0.5 AS DOUBLE)) * CAST(2 AS DOUBLE) / rows_, 9) FROM g, range(60) k WHERE k.range < rows_""",
    "image_sort_order": """WITH p AS (SELECT s_suppkey AS image, CAST((s_suppkey * 37) % 101 AS DOUBLE) AS x, s_nationkey * 1.5 AS y FROM supplier)
      SELECT image, round(((x + 2.25) * 4 + (y + 2) * 1) / sqrt(CAST(17 AS DOUBLE)), 6) AS along FROM p""",
    "keypoint_extrema_rank": f"""{with_sql("dref")}, s AS (SELECT * FROM (VALUES (8), (12), (18)) t(size)),
      x AS (SELECT size, a.range AS wy, b.range AS wx, r, c, val FROM dref, s, range(20) a, range(20) b WHERE val IS NOT NULL AND r BETWEEN a.range * 2 AND a.range * 2 + size - 1 AND c BETWEEN b.range * 2 AND b.range * 2 + size - 1),
      o AS (SELECT *, row_number() OVER (PARTITION BY size, wy, wx ORDER BY val, r, c) AS lo, row_number() OVER (PARTITION BY size, wy, wx ORDER BY val DESC, r, c) AS hi FROM x),
      k AS (SELECT 'low' AS kind, r, c FROM o WHERE lo = 1 UNION ALL SELECT 'high', r, c FROM o WHERE hi = 1), n AS (SELECT kind, r, c, count(*) AS n FROM k GROUP BY ALL),
      z AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, r, c) AS rank FROM n) SELECT * FROM z WHERE rank <= 10""",
    "nuth_kaab_normal_eq": f"{with_sql('dref')}, {_AROUND_SLOPES} SELECT count(*) AS n, {', '.join(f'round(sum(t{i} * t{j}), 4) AS a_{i}_{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f'round(sum(t{i} * y), 4) AS b_{i}' for i in range(3))} FROM nk",
    "components_clean": f"""{with_sql("dref").replace("WITH", "WITH RECURSIVE")}, m AS (SELECT r, c, r * 40 + c AS id FROM dref WHERE val > 250),
      walk(id, r, c, root) AS (SELECT id, r, c, id FROM m UNION SELECT m.id, m.r, m.c, w.root FROM walk w JOIN m ON m.id IN (w.id - 40, w.id - 1, w.id + 1, w.id + 40) AND abs(m.c - w.c) <= 1), top AS (SELECT id, min(root) AS region FROM walk GROUP BY id),
      s AS (SELECT region, count(*) AS size FROM top GROUP BY region) SELECT size, count(*) AS regions FROM s GROUP BY size""",
    "triangulate": f"{with_sql('tgt')} SELECT id, round(x, 4) AS x, round(y / 100, 4) AS y, round(z + 100, 4) AS z FROM tgt",
    "block_process": f"{with_sql('dref')}, h AS (SELECT r, c, val, lag(val) OVER (PARTITION BY r ORDER BY c) AS w, lead(val) OVER (PARTITION BY r ORDER BY c) AS e FROM dref) SELECT r, c, round((coalesce(w, CASE WHEN c = 0 THEN val END) + coalesce(e, CASE WHEN c = 39 THEN val END)) / 2, 9) AS val FROM h",
}
