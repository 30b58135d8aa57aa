"""Queries over raster files in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relievo.lineage import shared_folder
from relievo.plans.fixtures import side, terrain, with_sql
from relievo.sources import geotiff

#: Centre of the first cell, and the size of a cell.
X0, Y0, STEP = 26.0, 39.0, 1 / 64


def geotiff_window(spark: SparkSession, d: str) -> DataFrame:
    """The middle of a raster that was written as files of tiles, one for each of four regions of rows, and read back by a window and a filter."""
    n, folder = side(spark, d), shared_folder(spark, "geotiff")
    tall = -(-n // 4)
    cells = terrain(spark, d).select(geotiff.dem_name(F.floor(F.col("r") / tall), F.lit(1)).alias("name"), (F.col("r") % tall).cast("int").alias("r"), "c", "val")
    k = F.col("id")
    grids = spark.range(-(-n // tall)).select(geotiff.dem_name(k, F.lit(1)).alias("name"), F.least(F.lit(tall), n - k * tall).cast("int").alias("rows"), F.lit(n).alias("cols"), F.lit(X0).alias("x0"), (Y0 - k * tall * STEP).alias("y0"), F.lit(STEP).alias("dx"), F.lit(STEP).alias("dy"))
    geotiff.write_geotiff(cells, grids, folder, "float64", nodata=-9999.0, tile=32)
    a, b = n // 4, 3 * n // 4
    window = (X0 + a * STEP, Y0 - b * STEP, X0 + b * STEP, Y0)
    found = geotiff.read_geotiff(spark, folder, window).where(F.col("y") <= Y0 - a * STEP)
    return found.select(((Y0 - F.col("y")) / STEP).cast("int").alias("r"), "c", "val")


QUERIES = {"geotiff_window": geotiff_window}
SQL = {
    "geotiff_window": f"""{with_sql("terrain")}, inner_cells AS (SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM (SELECT unnest(range(n // 4, 3 * n // 4 + 1)) AS r, n FROM side) CROSS JOIN (SELECT unnest(range(n // 4, 3 * n // 4 + 1)) AS c FROM side))
      SELECT r, c, val FROM inner_cells LEFT JOIN terrain USING (r, c)""",
}
