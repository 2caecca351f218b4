"""Structured Streaming: pages arriving as files, and accesses that keep them alive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def page_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """Parquet files of pages as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def upsert_stream(pages: DataFrame, table_path: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's newest row of every key (the largest ``order``) as a delta of its own.

    Nothing that is there is rewritten: what a batch costs follows the batch, not the table. A batch that runs again
    overwrites its own delta, so a restart neither loses nor repeats rows. latest() reads the table, compact() folds it.
    """

    def apply(batch: DataFrame, number: int) -> None:
        newest(batch, keys, order).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of every key: the one with the largest ``order``; of equal ones any, as they are the same version."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r"))
    return best.select("r.*")


def latest(spark: SparkSession, table_path: str, keys: list[str], order: str) -> DataFrame:
    """The table as it is: of every key the newest row of all deltas; a later batch wins among equals."""
    deltas = spark.read.option("basePath", table_path).parquet(f"{table_path}/batch=*")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("batch").desc()))
    return deltas.withColumn("_place", place).filter("_place = 1").drop("_place", "batch")


def compact(spark: SparkSession, table_path: str, target: str, keys: list[str], order: str) -> None:
    """Write the newest rows as the first delta of a new table."""
    latest(spark, table_path, keys, order).write.mode("overwrite").parquet(f"{target}/batch=-1")


def access_windows(events: DataFrame, *, at: str = "ts", key: str = "user_id", window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Accesses by key and window. On a stream, a window's state goes once the watermark has passed its end, and rows later
    than that are dropped; in append mode each window is given once, when it is complete."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("window"), key).agg(F.count("*").alias("accesses"), F.max(at).alias("last"))
