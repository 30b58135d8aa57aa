"""Listing files, and image arrays saved by numpy."""

from __future__ import annotations

import io
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relievo.sources import geotiff


def list_files(spark: SparkSession, folder: str, suffix: str, ignore_case: bool = True) -> DataFrame:
    """path and length of the files below ``folder`` whose names end in ``suffix``, in order; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    path = F.lower("path") if ignore_case else F.col("path")
    return files.where(path.endswith(suffix.lower() if ignore_case else suffix)).orderBy("path")


def read_images(spark: SparkSession, path: str, tile: int = 512) -> DataFrame:
    """Tiles of the arrays ``Image`` in .npz files: path, ty, tx, h, w, dtype, data, and the 3 x 3 ``transform`` from the 4 x 4 one without its z."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                saved = np.load(io.BytesIO(content))
                image = saved["Image"]
                matrix = saved["Transform"][np.ix_([0, 1, 3], [0, 1, 3])].ravel().tolist() if "Transform" in saved else None
                for r in range(0, image.shape[0], tile):
                    cuts = [image[r : r + tile, c : c + tile] for c in range(0, image.shape[1], tile)]
                    yield pd.DataFrame({"path": name, "ty": r // tile, "tx": range(len(cuts)), "h": [x.shape[0] for x in cuts], "w": [x.shape[1] for x in cuts], "dtype": str(image.dtype), "data": [np.ascontiguousarray(x).tobytes() for x in cuts], "transform": [matrix] * len(cuts)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "path string, ty int, tx int, h int, w int, dtype string, data binary, transform array<double>")


def check_input(spark: SparkSession, path: str) -> None:
    """An error unless a GeoTIFF or shapefile is in geographic WGS 84; a shapefile without a .prj is only warned about."""
    low = path.lower()
    if low.endswith(".tif"):
        epsg = geotiff.header(geotiff.Ranges(path))["epsg"]
        if epsg != 4326:
            raise ValueError(f"{path} has EPSG:{epsg}, EPSG:4326 is asked for")
    elif low.endswith(".shp"):
        folder, _, name = path.rpartition("/")
        beside = spark.read.format("binaryFile").option("pathGlobFilter", f"{name[:-4]}.[pP][rR][jJ]").load(folder or ".").select("content").first()
        if beside is None:
            warnings.warn(f"{path} has no .prj file, WGS 84 is assumed", stacklevel=2)
        elif "WGS" not in bytes(beside["content"]).decode(errors="replace").upper():
            raise ValueError(f"{path} is not in WGS 84")
    else:
        raise ValueError(f"{path} is neither a .tif nor a .shp file")


def check_shapes(spark: SparkSession, folder: str) -> None:
    """``check_input`` for all shapefiles below a folder; it is an error if there are none."""
    found = [row["path"] for row in list_files(spark, folder, ".shp").select("path").collect()]  # a row a file of a folder that a user names
    if not found:
        raise ValueError(f"no shapefile in {folder}")
    for path in found:
        check_input(spark, path)
