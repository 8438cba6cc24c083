"""Folders that the driver and all executors see."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, set for the context too. Only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
            root = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(root)
        held = sc._jsc.sc().getCheckpointDir()
    return spark.conf.get("spark.checkpoint.dir", None) or held.get()


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder there."""
    return f"{checkpoint_root(spark).rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: the plan ends here and a lost executor repeats nothing before it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
