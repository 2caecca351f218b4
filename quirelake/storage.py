"""The shared folder that the cluster names, and intermediate tables kept there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where the session is local and names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder: on a cluster it must be one that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="quirelake-")


def kept(df: DataFrame, label: str) -> DataFrame:
    """A table written to the shared folder as Parquet and read again: computed once, whatever executors are lost."""
    uri = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)
