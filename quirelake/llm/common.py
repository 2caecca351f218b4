"""Helpers shared by the training-data operators: tables, shared storage, checkpoints, ordering."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import time
import types
import uuid
from itertools import chain
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Java regex for a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch on its way to Python, and rows of a batch that is read from Parquet.
ARROW_BYTES, PARQUET_ROWS = 4 << 20, 512
_BATCH_SETTING, _READ_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, _UPPER, _UPPER.lower())


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def id_crc(column: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where unset (tests), a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder: on a cluster it must be one that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quirelake-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def checkpoint(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut the lineage at a copy in the shared folder, which outlives any executor; in at most so many files."""
    ensure_checkpoint_dir(df.sparkSession)
    return (df if parts is None else df.coalesce(parts)).checkpoint(eager=True)


def narrow_files(df: DataFrame) -> int:
    """In how many files to keep a table of ids, hashes and numbers about the rows of a table of texts."""
    return -(-splits_of(df) // 8)


def packed(df: DataFrame) -> DataFrame:
    """The rows as one column `row`, beside which a helper's columns can have any name; `row.*` gives them back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def splits_of(df: DataFrame) -> int:
    """How many partitions a table is read in: no intermediate table of it needs more files than that."""
    return max(1, df.rdd.getNumPartitions())


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder's URI in the shared storage (not yet created)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint behind a size check: above the limit the join shuffles instead."""
    return F.broadcast(df) if rows <= limit else df


def open_fs(uri: str):
    """(filesystem, path) for executors' own files; plain paths and file: are local mounts of the shared folder."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, name: str, write) -> int:
    """Write one file under a private name, then move it to its final name; returns its length.

    Reruns of a task (lost executors, speculation) each write a private file and
    replace the final one with equal bytes, so readers never see half a file.
    """
    filesystem, folder = open_fs(uri)
    filesystem.create_dir(folder, recursive=True)
    private = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with filesystem.open_output_stream(private) as out:
        write(out)
        length = out.tell()
    filesystem.move(private, f"{folder}/{name}")
    return length


def bound_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of this session exceed ARROW_BYTES but by its last row, and no batch read from Parquet PARQUET_ROWS:
    default batches of whole texts take tens of megabytes several times over, in the JVM and in Python. A session that
    asks for less keeps its own bounds."""
    asked = re.fullmatch(r"(\d+)b?", spark.conf.get(_BATCH_SETTING))
    if asked is None or int(asked[1]) > ARROW_BYTES:
        spark.conf.set(_BATCH_SETTING, f"{ARROW_BYTES}b")
    if int(spark.conf.get(_READ_SETTING)) > PARQUET_ROWS:
        spark.conf.set(_READ_SETTING, PARQUET_ROWS)


def computed(df: DataFrame, run, schema: str, label: str) -> DataFrame:
    """df.mapInArrow(run, schema), computed once: each task writes what it yields to one Parquet file of the shared folder,
    from Python and under its final name only when whole, and the files are read again. Tasks without rows write none."""
    spark = df.sparkSession
    uri = scratch_dir(spark, label)

    def write(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        found = (b for b in run(batches) if b.num_rows)
        first, rows = next(found, None), 0
        if first is not None:

            def put(out):
                nonlocal rows
                with pq.ParquetWriter(out, first.schema) as writer:
                    for batch in chain([first], found):
                        writer.write_batch(batch)
                        rows += batch.num_rows

            publish(uri, f"part-{TaskContext.get().partitionId():06d}.parquet", put)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    if not df.mapInArrow(write, "rows long").agg(F.sum("rows")).first()[0]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(uri)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by its tasks."""
    module = sys.modules.get("_quirelake_worker")
    if module is None:
        module = sys.modules["_quirelake_worker"] = types.ModuleType("_quirelake_worker")
    return module.__dict__.setdefault(name, {})


def next_ids(ids: DataFrame, id_col: str, carry: list[str], prefix: str = "next_") -> DataFrame:
    """Each row with the id and the carried columns of its follower in ascending id order; the last row's
    follower is the first row. Only narrow rows move: ids are dealt by range, each range finds its own
    followers, and one row a range closes the seams. Nulls come first; equal ids are ordered by the carried columns.
    """
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(id_col).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in carry]]
    ranged = checkpoint(ids.select(id_col, *carry).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(*order)
    row = F.struct(F.lit(True).alias("some"), F.col(id_col), *[F.col(c) for c in carry])
    led = ranged.withColumn("_follower", F.lead(row).over(within))
    firsts = ranged.groupBy("_part").agg(F.min(F.struct(F.col(id_col), *[F.col(c) for c in carry])).alias("_min"))
    seam = Window.orderBy("_part")
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("_part", F.coalesce(F.lead("_min").over(seam), F.first("_min").over(every)).alias("_seam"))
    joined = led.join(F.broadcast(firsts), "_part")  # a row a range: as many as shuffle partitions

    def pick(c: str) -> Column:
        return F.when(F.col("_follower").isNotNull(), F.col("_follower")[c]).otherwise(F.col("_seam")[c]).alias(prefix + c)

    return joined.select(id_col, *carry, pick(id_col), *[pick(c) for c in carry])


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder as Parquet and read it again: compact, and pruned by column."""
    uri = scratch_dir(df.sparkSession, label)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def sweep(spark: SparkSession, hours: float = 24.0) -> int:
    """Delete what operators left in the shared folder and nothing has written to for so long; returns how many folders.

    Tables, shards and archives stay when a job ends, since a DataFrame that it returned may still read them.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    filesystem = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found, before = 0, time.time() * 1000 - hours * 3_600_000
    for status in filesystem.listStatus(folder) if filesystem.exists(folder) else ():
        own = re.fullmatch(r"[a-z]+(-[a-z]+)*-[0-9a-f]{32}", status.getPath().getName())
        if own and status.isDirectory() and status.getModificationTime() < before:
            found += bool(filesystem.delete(status.getPath(), True))
    return found
