"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one of our own if there is only this machine, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, sized: bool = True) -> DataFrame:
    """The same rows with their lineage cut: written to the checkpoint folder that all executors share.

    A checkpoint keeps the planner's estimate of its size, and joins multiply estimates: in a loop
    the digits of this number grow by a factor a round until planning takes minutes.  Without
    ``sized`` the estimate is dropped.
    """
    spark = df.sparkSession
    shared(spark)
    found = df.checkpoint(eager=True)
    return found if sized else DataFrame(spark._jsparkSession.createDataFrame(found._jdf.toJavaRDD(), found._jdf.schema()), spark)
