"""The data model over the driver's tables: pages, sections, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import kept


def page_numbers(documents: DataFrame) -> DataFrame:
    """(file_path, page_num, page_id): one document is one page of the file its source names. Carries no text.

    Ids are dealt by ranges of (file, id), so that a large file is numbered by many tasks: within a range by the rows
    before, and from there by the file's rows in earlier ranges.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = documents.select(F.col("source").alias("file_path"), F.col("doc_id").alias("page_id"))
    ranged = kept(ids.repartitionByRange(parts, "file_path", "page_id").withColumn("part", F.spark_partition_id()), "page-ids")
    within = F.row_number().over(Window.partitionBy("part", "file_path").orderBy("page_id"))
    counts = ranged.groupBy("part", "file_path").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file_path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("part").alias("o_part"), F.col("file_path").alias("o_file"), earlier.alias("offset"))  # a row a range and file
    numbered = ranged.withColumn("n", within).join(offsets, (F.col("part") == F.col("o_part")) & F.col("file_path").eqNullSafe(F.col("o_file")))
    return numbered.select("file_path", (F.col("n") + F.col("offset") - 1).cast("long").alias("page_num"), "page_id")


def numbers_of(documents: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """hits with (file_path, page_num) of their pages, by counting the smaller ids of their files. hits: a short list."""
    ids = documents.select(F.col("source").alias("file_path"), F.col("doc_id").alias("page_id"))
    wanted = F.broadcast(hits.select(F.col(key).alias("w_id")))
    spots = ids.join(wanted, F.col("page_id") == F.col("w_id")).select(F.col("file_path").alias("s_file"), F.col("w_id").alias("s_id"))
    placed = ids.join(F.broadcast(spots), F.col("file_path").eqNullSafe(F.col("s_file")))
    counted = placed.groupBy("s_file", "s_id").agg(F.count_if(F.col("page_id") < F.col("s_id")).alias("page_num"))
    return counted.select(F.col("s_file").alias("file_path"), "page_num", F.col("s_id").alias("s_id")).join(F.broadcast(hits), F.col("s_id") == F.col(key)).drop("s_id")


def pages(documents: DataFrame) -> DataFrame:
    """(file_path, page_num, page_id, text); numbers are found on ids alone and joined to the texts."""
    texts = documents.select(F.col("doc_id").alias("t_id"), "text")
    return page_numbers(documents).join(texts, F.col("page_id") == F.col("t_id")).drop("t_id")


PAGES_SQL = "pages AS (SELECT source AS file_path, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_num, doc_id AS page_id, text FROM documents)"


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]+)", 1)


def html_sections(pages_html: DataFrame) -> DataFrame:
    """(section_key, file_path, title, text) of raw web pages: heading and paragraphs."""
    paragraphs = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)), "\n")
    return pages_html.select(F.col("page_id").alias("section_key"), host(F.col("url")).alias("file_path"), F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1).alias("title"), paragraphs.alias("text"))


SECTIONS_SQL = r"sections AS (SELECT page_id AS section_key, regexp_extract(url, '^https?://([^/?#]+)', 1) AS file_path, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS title, array_to_string(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), chr(10)) AS text FROM pages)"


def page_lines(documents: DataFrame) -> DataFrame:
    """(file_path, page_id, line_no, line): a line of a document plays the text block of a page."""
    return documents.select(F.col("source").alias("file_path"), F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES_SQL = "lines AS (SELECT file_path, page_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM (SELECT source AS file_path, doc_id AS page_id, string_split(text, chr(10)) AS parts FROM documents))"
