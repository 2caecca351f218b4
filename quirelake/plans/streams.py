"""Streaming queries over the event log, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder
from ..streaming import ingest
from .registry import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # The glob gives the stream reader a folder to list, whether the table is a file or a folder of files.
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/[e]vents.parquet")


@query("SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS accesses FROM events GROUP BY ALL")
def access_log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily accesses by user: in update mode a batch gives the windows it changed, and the last count of a window stands.

    The watermark lets the state of past days go.
    """
    events = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = ingest.access_windows(events).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "user_id", "accesses")
    out = f"{shared_folder(spark)}/accesses-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table/batch={number}")

    counted.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return ingest.latest(spark, f"{out}/table", ["user_id", "day"], "accesses").select("user_id", "day", "accesses")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def ingested_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of their user's row, taken in as a stream: of every user the newest."""
    out = f"{shared_folder(spark)}/ingested-{uuid.uuid4().hex}"
    rows = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "value")
    ingest.upsert_stream(rows, f"{out}/table", ["user_id"], "event_id", f"{out}/state").awaitTermination()
    return ingest.latest(spark, f"{out}/table", ["user_id"], "event_id")
