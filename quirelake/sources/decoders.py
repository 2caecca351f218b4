"""Where page decoders plug in. None is installed here; pages can also come from tables (see adapters)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A decoder takes a file's bytes and gives (page number from 0, text) pairs; it may raise.
Decoder = Callable[[bytes], Iterable[tuple[int, str]]]

PAGE_SCHEMA = "file_path string, page_num long, mtime double, text string, error string"


def plain_text(content: bytes) -> Iterable[tuple[int, str]]:
    """A decoder for text files: form feeds part the pages."""
    return enumerate(content.decode("utf-8").split("\f"))


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files as (path, modificationTime, length, content), read by Spark from any store it knows."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def decode(files: DataFrame, decoder: Decoder) -> DataFrame:
    """Pages of the files. A file that can't be decoded gives one row with an error; it never fails the task."""

    def run(batches):
        import pyarrow as pa

        names = ["file_path", "page_num", "mtime", "text", "error"]
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string()]
        for batch in batches:
            for path, mtime, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    rows = [(path, number, mtime, text, None) for number, text in decoder(content)]
                except Exception as problem:  # noqa: BLE001  (a poison file must not stop the others)
                    rows = [(path, None, mtime, None, f"{type(problem).__name__}: {problem}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", F.unix_micros("modificationTime").cast("double").alias("mtime"), "content").mapInArrow(run, PAGE_SCHEMA)
