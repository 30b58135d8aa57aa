"""Every query of the terrain engine, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relievo.plans import clouds, files, images, matches, rasters, solves, stages, streams, tiled

GROUPS = (rasters, clouds, matches, images, stages, streams, files, tiled, solves)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for group in GROUPS for name, query in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.SQL.items()}
