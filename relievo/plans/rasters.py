"""Queries over rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relievo.operators import points as pt
from relievo.operators import rasters as ra
from relievo.plans.fixtures import SQL as VIEWS
from relievo.plans.fixtures import dref, href, img, pc, ref, with_sql

AROUND = [name for name, _, _ in ra.AROUND]
#: Windows over dense rasters, and the neighbours that they give.
_ALONG, _DOWN = "(PARTITION BY r ORDER BY c)", "(PARTITION BY c ORDER BY r)"


def _around_sql(source: str) -> str:
    return f"""h AS (SELECT *, lag(val) OVER {_ALONG} AS w, lead(val) OVER {_ALONG} AS e FROM {source}),
      nb AS (SELECT *, lag(val) OVER {_DOWN} AS n, lag(w) OVER {_DOWN} AS nw, lag(e) OVER {_DOWN} AS ne, lead(val) OVER {_DOWN} AS s, lead(w) OVER {_DOWN} AS sw, lead(e) OVER {_DOWN} AS se FROM h)"""


_EXTENDED = f"""h0 AS (SELECT *, lag(val) OVER {_ALONG} AS w0, lead(val) OVER {_ALONG} AS e0 FROM dref),
      h AS (SELECT r, c, val, CASE WHEN c = 0 THEN 2 * val - e0 ELSE w0 END AS w, CASE WHEN c = 39 THEN 2 * val - w0 ELSE e0 END AS e FROM h0),
      v0 AS (SELECT *, lag(val) OVER {_DOWN} AS n0, lead(val) OVER {_DOWN} AS s0 FROM h),
      nb AS (SELECT r, c, val, w, e, CASE WHEN r = 0 THEN 2 * val - s0 ELSE n0 END AS n, CASE WHEN r = 39 THEN 2 * val - n0 ELSE s0 END AS s FROM v0)"""


def dem_diff_rmse_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """Grid the points, join the reference, trim to the 5-95 % quantiles, RMSE per region."""
    grid = pc(spark, d).groupBy("region", (F.col("y") % 40).cast("int").alias("r"), (F.col("x") % 40).cast("int").alias("c")).agg((F.sum(F.col("z").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("z"))
    diff = grid.join(ref(spark, d), ["r", "c"]).select("region", (F.col("val") - F.col("z")).alias("d"))
    kept = pt.trim(diff, "d", 0.05, 0.95, ["region"])
    return kept.groupBy("region").agg(F.count("*").alias("n"), F.round(F.sqrt(F.sum(F.col("d") * F.col("d")) / F.count("*")), 4).alias("rmse"))


def grid_points_mean(spark: SparkSession, d: str) -> DataFrame:
    found = ra.grid_points(pc(spark, d), **ra.grid_of(pc(spark, d), 50.0, 7.0), keys=["region"])
    return found.select("region", "r", "c", F.round("val", 9).alias("val"), "n")


def mask_nulls_dem(spark: SparkSession, d: str) -> DataFrame:
    shifted = dref(spark, d).withColumn("val", F.col("val") * 100 - 5000)
    return ra.mask_nulls(shifted, "dem")


def mask_nulls_list(spark: SparkSession, d: str) -> DataFrame:
    return ra.mask_nulls(dref(spark, d).withColumn("val", F.round("val", 0)), [140.0, 150.0, 160.0])


def max_delta_cut(spark: SparkSession, d: str) -> DataFrame:
    """Points farther than 200 from the reference lose their height."""
    z = pc(spark, d).select("region", "z", (F.col("y") % 40).cast("int").alias("r"), (F.col("x") % 40).cast("int").alias("c"))
    met = z.join(ref(spark, d), ["r", "c"], "left").withColumn("kept", F.when(F.abs(F.col("z") - F.col("val")) <= 200, F.col("z")))
    return met.groupBy("region").agg(F.count("*").alias("points"), F.count("kept").alias("kept"))


def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the raster of which a third at least has points above 600."""
    high = pc(spark, d).where("z > 600").select((F.col("y") % 40).cast("int").alias("r"), (F.col("x") % 40).cast("int").alias("c")).distinct().withColumn("has", F.lit(1.0))
    cells = dref(spark, d).select("r", "c").join(high, ["r", "c"], "left").withColumnRenamed("has", "val")
    return pt.coverage(cells, ["r"]).where("share >= 1.0 / 3").select("r", "filled", F.round("share", 6).alias("share"))


def nan_coverage(spark: SparkSession, d: str) -> DataFrame:
    return pt.coverage(href(spark, d)).select("cells", "filled", F.round("share", 6).alias("share"))


def neighbors8(spark: SparkSession, d: str) -> DataFrame:
    return ra.neighbors8(href(spark, d)).select("r", "c", "val", *AROUND)


def surface_normals(spark: SparkSession, d: str) -> DataFrame:
    return ra.surface_normals(dref(spark, d), 30.0, 20.0).select("r", "c", *[F.round(n, 6).alias(n) for n in ("nx", "ny", "nz")])


def slope_aspect(spark: SparkSession, d: str) -> DataFrame:
    return ra.slope_aspect(dref(spark, d), 30.0, 20.0).select("r", "c", F.round("slope", 4).alias("slope"), F.round("aspect", 4).alias("aspect"))


def median3x3(spark: SparkSession, d: str) -> DataFrame:
    return ra.median3x3(href(spark, d)).select("r", "c", F.round("val", 9).alias("val"))


def dilate_cross(spark: SparkSession, d: str) -> DataFrame:
    return ra.dilate(dref(spark, d).withColumn("val", F.col("val") > 165)).where("val").select("r", "c")


def gap_fill_mean3x3(spark: SparkSession, d: str) -> DataFrame:
    return ra.gap_fill(href(spark, d)).select("r", "c", F.round("val", 9).alias("val"))


def wiener3x3(spark: SparkSession, d: str) -> DataFrame:
    return ra.wiener3x3(dref(spark, d)).select("r", "c", F.round("val", 4).alias("val"))


def _side(spark: SparkSession, d: str, side: str) -> DataFrame:
    return img(spark, d).where(F.col("side") == side).select("r", "c", "val")


def histogram_cdf(spark: SparkSession, d: str) -> DataFrame:
    return ra.histogram(img(spark, d), keys=["side"]).select("side", "bin", "n", F.round("cdf", 6).alias("cdf"))


def histogram_match(spark: SparkSession, d: str) -> DataFrame:
    return ra.histogram_match(_side(spark, d, "F"), _side(spark, d, "O")).select("r", "c", F.round("val", 6).alias("val"), F.round("matched", 6).alias("matched"))


def clahe_tiles(spark: SparkSession, d: str) -> DataFrame:
    return ra.clahe_tiles(_side(spark, d, "F"), 16, 32, 0.03).select("ty", "tx", "bin", F.round("cdf", 6).alias("cdf"))


def clahe(spark: SparkSession, d: str) -> DataFrame:
    return ra.clahe(_side(spark, d, "F"), 16, 32, 0.03).select("r", "c", F.round("val", 6).alias("val"))


def _targets(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return spark.range(rows).select(F.col("id").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"))


def _resampled(method: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        row, col = F.col("r") * 0.75 - 1.1, F.col("c") * 0.8 - 0.33
        return ra.resample(href(spark, d), _targets(spark, 56, 52), row, col, method).select("r", "c", F.round("val", 9).alias("val"))

    return query


def resample_affine(spark: SparkSession, d: str) -> DataFrame:
    row, col = F.col("r") * 0.7 + F.col("c") * 0.2 + 1.3, F.col("c") * 0.6 - F.col("r") * 0.1 + 5.2
    return ra.resample(dref(spark, d), _targets(spark, 40, 40), row, col).select("r", "c", F.round("val", 9).alias("val"))


def pyramid_half(spark: SparkSession, d: str) -> DataFrame:
    return ra.pyramid(href(spark, d), 2).select("r", "c", F.round("val", 4).alias("val"))


def merge_halves_coalesce(spark: SparkSession, d: str) -> DataFrame:
    left = _side(spark, d, "F").withColumn("val", F.when(F.col("c") < 40, F.col("val")).otherwise(0.0))
    return ra.merge(left, _side(spark, d, "O").where("c >= 30")).select("r", "c", F.round("val", 6).alias("val"))


def mask_union(spark: SparkSession, d: str) -> DataFrame:
    cells = dref(spark, d)
    return cells.where("val > 160").select("r", "c").union(cells.where("r < c").select("r", "c")).distinct()


def mask_except(spark: SparkSession, d: str) -> DataFrame:
    cells = dref(spark, d)
    return cells.where("val > 140").select("r", "c").join(cells.where("r < c").select("r", "c"), ["r", "c"], "left_anti")


QUERIES = {
    "dem_diff_rmse_trimmed": dem_diff_rmse_trimmed, "grid_points_mean": grid_points_mean, "mask_nulls_dem": mask_nulls_dem, "mask_nulls_list": mask_nulls_list, "max_delta_cut": max_delta_cut,
    "coverage_gate": coverage_gate, "nan_coverage": nan_coverage, "neighbors8": neighbors8, "surface_normals": surface_normals, "slope_aspect": slope_aspect, "median3x3": median3x3,
    "dilate_cross": dilate_cross, "gap_fill_mean3x3": gap_fill_mean3x3, "wiener3x3": wiener3x3, "histogram_cdf": histogram_cdf, "histogram_match": histogram_match, "clahe_tiles": clahe_tiles, "clahe": clahe,
    "resample_bilinear": _resampled("linear"), "resample_nearest": _resampled("nearest"), "resample_affine": resample_affine, "pyramid_half": pyramid_half, "merge_halves_coalesce": merge_halves_coalesce,
    "mask_union": mask_union, "mask_except": mask_except,
}


def _bilinear_sql(source: str, targets: str, row: str, col: str) -> str:
    return f"""{with_sql(source)}, t AS (SELECT CAST(a.range AS INT) AS r, CAST(b.range AS INT) AS c FROM {targets}),
      p AS (SELECT r, c, {row} AS y, {col} AS x FROM t), q AS (SELECT *, CAST(floor(y) AS INT) AS i, CAST(floor(x) AS INT) AS j FROM p),
      k AS (SELECT q.r, q.c, (CASE WHEN dy.range = 1 THEN y - i ELSE 1 - (y - i) END) * (CASE WHEN dx.range = 1 THEN x - j ELSE 1 - (x - j) END) AS w, i + dy.range AS rr, j + dx.range AS cc FROM q, range(2) dy, range(2) dx),
      m AS (SELECT k.r, k.c, w, val FROM k LEFT JOIN {source} s ON s.r = k.rr AND s.c = k.cc WHERE w > 0)
      SELECT r, c, CASE WHEN count(val) = count(*) THEN round(sum(w * val), 9) END AS val FROM m GROUP BY r, c"""


_BIN = "CAST(least(greatest(floor(val * 256), 0), 255) AS INT)"
_TILES = f"""{with_sql("img")}, cells AS (SELECT CAST(floor(r / 16.0) AS INT) AS ty, CAST(floor(c / 16.0) AS INT) AS tx, r, c, CAST(least(greatest(floor(val * 32), 0), 31) AS INT) AS bin FROM img WHERE side = 'F'),
      counts AS (SELECT ty, tx, bin, count(*) AS n FROM cells GROUP BY ALL), tiles AS (SELECT ty, tx, sum(n) AS total FROM counts GROUP BY ALL),
      whole AS (SELECT ty, tx, total, CAST(b.range AS INT) AS bin, coalesce(n, 0) AS n FROM tiles CROSS JOIN range(32) b LEFT JOIN counts USING (ty, tx) WHERE counts.bin = b.range OR counts.bin IS NULL),
      every AS (SELECT t.ty, t.tx, t.total, CAST(b.range AS INT) AS bin FROM tiles t, range(32) b), filled AS (SELECT e.*, coalesce(n, 0) AS n FROM every e LEFT JOIN counts k ON k.ty = e.ty AND k.tx = e.tx AND k.bin = e.bin),
      clipped AS (SELECT *, least(CAST(n AS DOUBLE), greatest(1.0, CAST(0.03 AS DOUBLE) * total)) AS kept FROM filled),
      dealt AS (SELECT *, kept + (total - sum(kept) OVER (PARTITION BY ty, tx)) / 32 AS dealt FROM clipped),
      lut AS (SELECT ty, tx, bin, sum(dealt) OVER (PARTITION BY ty, tx ORDER BY bin) / total AS cdf FROM dealt)"""
_TILES = _TILES.replace(_TILES[_TILES.index("      whole AS") : _TILES.index("      every AS")], "")

SQL = {
    "dem_diff_rmse_trimmed": f"""WITH {VIEWS["pc"]}, {VIEWS["ref"]},
      grid AS (SELECT region, CAST(y % 40 AS INT) AS r, CAST(x % 40 AS INT) AS c, CAST(sum(CAST(z AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS z FROM pc GROUP BY 1, 2, 3),
      diff AS (SELECT region, val - z AS d FROM grid JOIN ref USING (r, c)),
      cut AS (SELECT region, quantile_cont(d, 0.05) AS lo, quantile_cont(d, 0.95) AS hi FROM diff GROUP BY 1)
      SELECT region, count(*) AS n, round(sqrt(sum(d * d) / count(*)), 4) AS rmse FROM diff JOIN cut USING (region) WHERE d BETWEEN lo AND hi GROUP BY 1""",
    "grid_points_mean": f"""{with_sql("pc")}, e AS (SELECT min(x) AS x0, max(y) AS y0 FROM pc), g AS (SELECT region, z, CAST(round((x - x0) / CAST(50 AS DOUBLE)) AS INT) AS c, CAST(round((y0 - y) / CAST(7 AS DOUBLE)) AS INT) AS r FROM pc, e)
      SELECT region, r, c, round(avg(z), 9) AS val, count(z) AS n FROM g GROUP BY region, r, c""",
    "mask_nulls_dem": f"{with_sql('dref')} SELECT r, c, CASE WHEN val * 100 - 5000 BETWEEN -500 AND 9000 THEN val * 100 - 5000 END AS val FROM dref",
    "mask_nulls_list": f"{with_sql('dref')} SELECT r, c, CASE WHEN round(val, 0) NOT IN (140, 150, 160) THEN round(val, 0) END AS val FROM dref",
    "max_delta_cut": f"""{with_sql("pc", "ref")} SELECT region, count(*) AS points, count(CASE WHEN abs(z - val) <= 200 THEN 1 END) AS kept
      FROM pc LEFT JOIN ref ON ref.r = pc.y % 40 AND ref.c = pc.x % 40 GROUP BY region""",
    "coverage_gate": f"""{with_sql("pc", "dref")}, high AS (SELECT DISTINCT y % 40 AS r, x % 40 AS c FROM pc WHERE z > 600), s AS (SELECT d.r, count(h.c) AS filled, count(h.c) / count(*) AS share FROM dref d LEFT JOIN high h ON h.r = d.r AND h.c = d.c GROUP BY d.r)
      SELECT r, filled, round(share, 6) AS share FROM s WHERE share >= 1.0 / 3""",
    "nan_coverage": f"{with_sql('href')} SELECT count(*) AS cells, count(val) AS filled, round(count(val) / count(*), 6) AS share FROM href",
    "neighbors8": f"{with_sql('href')}, {_around_sql('href')} SELECT r, c, {', '.join(('val', *AROUND))} FROM nb",
    "surface_normals": f"{with_sql('dref')}, {_EXTENDED}, g AS (SELECT r, c, (e - w) / 60.0 AS p, (n - s) / 40.0 AS q FROM nb) SELECT r, c, round(-p / sqrt(1 + p * p + q * q), 6) AS nx, round(-q / sqrt(1 + p * p + q * q), 6) AS ny, round(1 / sqrt(1 + p * p + q * q), 6) AS nz FROM g",
    "slope_aspect": f"{with_sql('dref')}, {_EXTENDED}, g AS (SELECT r, c, (e - w) / 60.0 AS p, (n - s) / 40.0 AS q FROM nb) SELECT r, c, round(degrees(atan(sqrt(p * p + q * q))), 4) AS slope, round(degrees(atan2(p, q)) + 180, 4) AS aspect FROM g",
    "median3x3": f"""{with_sql("href")}, o AS (SELECT h.r, h.c, least(greatest(CASE WHEN h.r + a.range - 1 < 0 THEN 0 WHEN h.r + a.range - 1 > 39 THEN 39 ELSE h.r + a.range - 1 END, 0), 39) AS rr, CASE WHEN h.c + b.range - 1 < 0 THEN 0 WHEN h.c + b.range - 1 > 39 THEN 39 ELSE h.c + b.range - 1 END AS cc
        FROM href h, range(3) a, range(3) b WHERE val IS NOT NULL), m AS (SELECT o.r, o.c, quantile_cont(s.val, CAST(0.5 AS DOUBLE)) AS val FROM o JOIN href s ON s.r = o.rr AND s.c = o.cc GROUP BY o.r, o.c)
      SELECT r, c, round(m.val, 9) AS val FROM href LEFT JOIN m USING (r, c)""",
    "dilate_cross": f"{with_sql('dref')}, k AS (SELECT r, c FROM dref WHERE val > 165), g AS (SELECT r, c FROM k UNION SELECT r - 1, c FROM k UNION SELECT r + 1, c FROM k UNION SELECT r, c - 1 FROM k UNION SELECT r, c + 1 FROM k) SELECT r, c FROM g WHERE r BETWEEN 0 AND 39 AND c BETWEEN 0 AND 39",
    "gap_fill_mean3x3": f"""{with_sql("href")}, {_around_sql("href")}, a AS (SELECT r, c, val, list_filter([{", ".join(AROUND)}], lambda x: x IS NOT NULL) AS l FROM nb)
      SELECT r, c, round(coalesce(val, list_avg(l)), 9) AS val FROM a""",
    "wiener3x3": f"""{with_sql("dref")}, {_around_sql("dref")}, l AS (SELECT r, c, val, ({" + ".join(f"coalesce({n}, 0)" for n in ("val", *AROUND))}) / 9 AS m, ({" + ".join(f"coalesce({n}, 0) * coalesce({n}, 0)" for n in ("val", *AROUND))}) / 9 AS q FROM nb),
      v AS (SELECT *, q - m * m AS var FROM l), noise AS (SELECT avg(var) AS noise FROM v WHERE val IS NOT NULL)
      SELECT r, c, CASE WHEN val IS NOT NULL THEN round(m + CASE WHEN var > noise THEN (var - noise) / var ELSE 0 END * (val - m), 4) END AS val FROM v, noise""",
    "histogram_cdf": f"{with_sql('img')}, b AS (SELECT side, {_BIN} AS bin, count(*) AS n FROM img GROUP BY 1, 2) SELECT side, bin, n, round(sum(n) OVER (PARTITION BY side ORDER BY bin) / sum(n) OVER (PARTITION BY side), 6) AS cdf FROM b",
    "histogram_match": f"""{with_sql("img")}, b AS (SELECT side, {_BIN} AS bin, count(*) AS n FROM img GROUP BY 1, 2), h AS (SELECT side, bin, sum(n) OVER (PARTITION BY side ORDER BY bin) / sum(n) OVER (PARTITION BY side) AS cdf FROM b),
      seg AS (SELECT cdf, (bin + 0.5) / 256 AS v, lead(cdf) OVER (ORDER BY cdf) AS cdf1, lead((bin + 0.5) / 256) OVER (ORDER BY cdf) AS v1 FROM h WHERE side = 'O'),
      lut AS (SELECT h.bin, CASE WHEN s.cdf IS NULL THEN (SELECT min((bin + 0.5) / 256) FROM h WHERE side = 'O') WHEN s.cdf1 IS NULL THEN s.v ELSE s.v + (s.v1 - s.v) * (h.cdf - s.cdf) / (s.cdf1 - s.cdf) END AS matched
        FROM h LEFT JOIN seg s ON h.cdf >= s.cdf AND h.cdf < coalesce(s.cdf1, 2) WHERE h.side = 'F')
      SELECT r, c, round(val, 6) AS val, round(matched, 6) AS matched FROM img JOIN lut ON lut.bin = {_BIN} WHERE side = 'F'""",
    "clahe_tiles": f"{_TILES} SELECT ty, tx, bin, round(cdf, 6) AS cdf FROM lut",
    "clahe": f"""{_TILES}, p AS (SELECT r, c, bin, (r + 0.5) / 16 - 0.5 AS fy, (c + 0.5) / 16 - 0.5 AS fx FROM cells),
      k AS (SELECT r, c, bin, CAST(greatest(0, least(floor(fy) + dy.range, 3)) AS INT) AS ty, CAST(greatest(0, least(floor(fx) + dx.range, 3)) AS INT) AS tx,
        (CASE WHEN dy.range = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN dx.range = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w FROM p, range(2) dy, range(2) dx)
      SELECT r, c, round(sum(w * cdf) / sum(w), 6) AS val FROM k JOIN lut USING (ty, tx, bin) GROUP BY r, c""",
    "resample_bilinear": _bilinear_sql("href", "range(56) a, range(52) b", "(r * CAST('0.75' AS DOUBLE) - CAST('1.1' AS DOUBLE))", "(c * CAST('0.8' AS DOUBLE) - CAST('0.33' AS DOUBLE))"),
    "resample_nearest": f"""{with_sql("href")}, t AS (SELECT CAST(a.range AS INT) AS r, CAST(b.range AS INT) AS c FROM range(56) a, range(52) b)
      SELECT t.r, t.c, round(s.val, 9) AS val FROM t LEFT JOIN href s ON s.r = ceil((t.r * CAST('0.75' AS DOUBLE) - CAST('1.1' AS DOUBLE)) - 0.5) AND s.c = ceil((t.c * CAST('0.8' AS DOUBLE) - CAST('0.33' AS DOUBLE)) - 0.5)""",
    "resample_affine": _bilinear_sql("dref", "range(40) a, range(40) b", "(r * CAST('0.7' AS DOUBLE) + c * CAST('0.2' AS DOUBLE) + CAST('1.3' AS DOUBLE))", "(c * CAST('0.6' AS DOUBLE) - r * CAST('0.1' AS DOUBLE) + CAST('5.2' AS DOUBLE))"),
    "pyramid_half": f"{with_sql('href')} SELECT CAST(floor(r / 2.0) AS INT) AS r, CAST(floor(c / 2.0) AS INT) AS c, round(avg(val), 4) AS val FROM href GROUP BY 1, 2",
    "merge_halves_coalesce": f"""{with_sql("img")}, a AS (SELECT r, c, CASE WHEN c < 40 THEN val ELSE 0 END AS a FROM img WHERE side = 'F'), b AS (SELECT r, c, val AS b FROM img WHERE side = 'O' AND c >= 30)
      SELECT r, c, round(coalesce(CASE WHEN a <> 0 THEN a END, b, a), 6) AS val FROM a FULL JOIN b USING (r, c)""",
    "mask_union": f"{with_sql('dref')} SELECT r, c FROM dref WHERE val > 160 UNION SELECT r, c FROM dref WHERE r < c",
    "mask_except": f"{with_sql('dref')} SELECT r, c FROM dref WHERE val > 140 EXCEPT SELECT r, c FROM dref WHERE r < c",
}
