"""Polygons of shapefiles as edges, with a bounding box pushed to the reader."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

POLYGONS = (5, 15, 25)  # fixed values: polygon, with z, with m


def polygon_edges(content: bytes, box: tuple[float, float, float, float] | None = None) -> Iterator[tuple]:
    """poly_id, ring, seq, x1, y1, x2, y2 of the polygons that meet ``box`` (x0, y0, x1, y1)."""
    if struct.unpack_from(">i", content, 0)[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 12 <= len(content):
        number, words = struct.unpack_from(">2i", content, at)
        if struct.unpack_from("<i", content, at + 8)[0] in POLYGONS:
            lx, ly, hx, hy, parts, points = struct.unpack_from("<4d2i", content, at + 12)
            if box is None or (lx <= box[2] and hx >= box[0] and ly <= box[3] and hy >= box[1]):
                starts = [*struct.unpack_from(f"<{parts}i", content, at + 52), points]
                xy = struct.unpack_from(f"<{2 * points}d", content, at + 52 + 4 * parts)
                for ring, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
                    for seq, k in enumerate(range(a, b - 1)):
                        yield number, ring, seq, *xy[2 * k : 2 * k + 4]
        at += 8 + 2 * words


def read_polygons(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """path, poly_id, ring, seq, x1, y1, x2, y2."""
    names = ["poly_id", "ring", "seq", "x1", "y1", "x2", "y2"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                out = pd.DataFrame(list(polygon_edges(content, box)), columns=names)
                out.insert(0, "path", name)
                yield out

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "path string, poly_id int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
