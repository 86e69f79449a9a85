"""Iteration over DataFrames: each round's table is written to the shared folder, so plans stay short and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; a local session without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if not _LOCAL:
            _LOCAL.append(tempfile.TemporaryDirectory(prefix="runweave-"))
        root = _LOCAL[0].name
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared(spark)}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
