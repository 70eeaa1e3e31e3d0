"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only where none is set and Spark itself is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quarrymill/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str, rows: int = 20_000) -> DataFrame:
    """df dealt by key to tasks of about so many rows: one row group of a file is one task, whatever its rows cost.

    For what is read as it is, whose rows the footers count; what is computed goes on top, so that it is not computed here.
    """
    tasks = math.ceil(df.count() / rows)
    return df.repartition(tasks, key) if tasks > 1 else df


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: its lineage ends here, and a lost executor costs a read."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
