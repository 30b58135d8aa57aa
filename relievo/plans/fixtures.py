"""Point clouds, rasters and tables derived from the star tables, and the same as SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relievo.operators import rasters as ra

SQL = {
    "pc": "pc AS (SELECT l_partkey AS x, l_suppkey AS y, l_extendedprice / 100 AS z, l_returnflag AS region FROM lineitem)",
    "ref": "ref AS (SELECT CAST(o_orderkey % 40 AS INT) AS r, CAST(o_custkey % 40 AS INT) AS c, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1000 AS val FROM orders GROUP BY 1, 2)",
    "cells": "cells AS (SELECT CAST(a.range AS INT) AS r, CAST(b.range AS INT) AS c FROM range(40) a, range(40) b)",
    "dref": "dref AS (SELECT r, c, val FROM cells LEFT JOIN ref USING (r, c))",
    "href": "href AS (SELECT r, c, CASE WHEN (r * 7 + c * 3) % 11 <> 0 THEN val END AS val FROM dref)",
    "img": "img AS (SELECT l_linestatus AS side, CAST(l_orderkey % 64 AS INT) AS r, CAST(l_partkey % 64 AS INT) AS c, floor(avg(l_quantity) * 5) / 255 AS val FROM lineitem GROUP BY 1, 2, 3)",
    "side": "side AS (SELECT CAST(greatest(8, floor(sqrt(count(*)))) AS INT) AS n FROM orders)",
    "terrain": "terrain AS (SELECT CAST(o_orderkey % n AS INT) AS r, CAST(o_custkey % n AS INT) AS c, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1000 * CAST('1.4142135623730951' AS DOUBLE) AS val FROM orders, side GROUP BY 1, 2)",
    "geo": "geo AS (SELECT c_custkey AS id, 26 + c_custkey / 1500.0 AS lon, 37 + c_nationkey / 12.0 AS lat, c_acctbal AS h FROM customer)",
    "tgt": "tgt AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice - 900 AS y, CAST(p_partkey % 50 AS DOUBLE) AS z FROM part)",
    "codes": "codes AS (SELECT vec_id AS id, label, embedding AS v FROM embeddings)",
}
#: What the views above read from.
_NEEDS = {"dref": ("cells", "ref"), "href": ("cells", "ref", "dref"), "terrain": ("side",)}


def with_sql(*names: str) -> str:
    """WITH clauses for fixtures, in order, each once."""
    found: dict[str, None] = {}
    for name in names:
        for need in (*_NEEDS.get(name, ()), name):
            found[need] = None
    return "WITH " + ", ".join(SQL[n] for n in found)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pc(spark: SparkSession, d: str) -> DataFrame:
    """Points: x, y, z and region from lineitem."""
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), (F.col("l_extendedprice") / 100).alias("z"), F.col("l_returnflag").alias("region"))


def ref(spark: SparkSession, d: str) -> DataFrame:
    """Mean order price on a 40 x 40 grid."""
    cell = [(F.col("o_orderkey") % 40).cast("int").alias("r"), (F.col("o_custkey") % 40).cast("int").alias("c")]
    return read(spark, d, "orders").groupBy(*cell).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*") / 1000).alias("val"))


def dref(spark: SparkSession, d: str) -> DataFrame:
    return ra.dense(ref(spark, d), 40, 40)


def href(spark: SparkSession, d: str) -> DataFrame:
    """With holes."""
    return dref(spark, d).withColumn("val", F.when((F.col("r") * 7 + F.col("c") * 3) % 11 != 0, F.col("val")))


def img(spark: SparkSession, d: str) -> DataFrame:
    """Two images of 64 x 64."""
    cell = [F.col("l_linestatus").alias("side"), (F.col("l_orderkey") % 64).cast("int").alias("r"), (F.col("l_partkey") % 64).cast("int").alias("c")]
    return read(spark, d, "lineitem").groupBy(*cell).agg((F.floor(F.avg("l_quantity") * 5) / 255).alias("val"))


def side(spark: SparkSession, d: str) -> int:
    """Rows and columns of ``terrain``: one cell an order."""
    return max(8, math.isqrt(read(spark, d, "orders").count()))


def terrain(spark: SparkSession, d: str) -> DataFrame:
    """Mean order price on a square grid that grows with the table; some cells are empty.  Its unit is irrational, so that means do not lie halfway between two roundings."""
    n = side(spark, d)
    cell = [(F.col("o_orderkey") % n).cast("int").alias("r"), (F.col("o_custkey") % n).cast("int").alias("c")]
    return read(spark, d, "orders").groupBy(*cell).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*") / 1000 * 1.4142135623730951).alias("val"))


def geo(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (26 + F.col("c_custkey") / 1500.0).alias("lon"), (37 + F.col("c_nationkey") / 12.0).alias("lat"), F.col("c_acctbal").alias("h"))


def tgt(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - 900).alias("y"), (F.col("p_partkey") % 50).cast("double").alias("z"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
