"""The streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relievo.streaming.gridding import grid_stream, run_available


def grid_points_stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    # a pattern, as the streaming reader takes a plain path for a folder
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")
    points = events.select((F.col("user_id") % 50).cast("double").alias("x"), (F.col("event_id") % 40).cast("double").alias("y"), F.col("value").alias("z"))
    return run_available(spark, grid_stream(points, 0.0, 40.0, 5.0, 4.0)).select("r", "c", "n", F.round("val", 6).alias("val"))


QUERIES = {"grid_points_stream": grid_points_stream}
SQL = {
    "grid_points_stream": "WITH p AS (SELECT CAST(round((40.0 - event_id % 40) / 4) AS INT) AS r, CAST(round((user_id % 50) / 5.0) AS INT) AS c, value FROM events) SELECT r, c, count(value) AS n, round(avg(value), 6) AS val FROM p GROUP BY r, c",
}
