"""Page ranges, byte caps, chunks, upserts, expiry: reading and upkeep of the stored tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_page_ranges(requests: DataFrame, *, key: str, spec: str, total: str) -> DataFrame:
    """(key, ord, page) with 0-based pages of specifications like `1-3,5`; null means all. The first of equal pages
    stays, pages outside the document and parts that aren't numbers are dropped."""
    parts = F.when(F.col(spec).isNull(), F.array(F.concat(F.lit("1-"), F.col(total).cast("string")))).otherwise(F.split(spec, ","))
    pieces = requests.select(key, total, F.posexplode(parts).alias("o", "part")).withColumn("part", F.regexp_replace("part", r"\s+", ""))
    good = pieces.filter(F.rlike("part", F.lit(r"^\d+(-\d+)?$")))
    low = F.split_part("part", F.lit("-"), F.lit(1)).cast("long")
    high = F.least(F.when(F.contains("part", F.lit("-")), F.split_part("part", F.lit("-"), F.lit(2)).cast("long")).otherwise(low), F.col(total))
    pages = good.select(key, total, "o", low.alias("low"), high.alias("high")).filter("low <= high and high >= 1").select(key, "o", F.posexplode(F.sequence(F.greatest("low", F.lit(1)), "high")).alias("i", "p"))
    first = pages.groupBy(key, (F.col("p") - 1).alias("page")).agg(F.min(F.struct("o", "i")).alias("at"))
    return first.select(key, F.row_number().over(Window.partitionBy(key).orderBy("at")).cast("long").alias("ord"), "page")


def _reached(sized: DataFrame, by: str, order: str, cap: int, span: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(parts that may lie within the cap, parts that can't) of sized(by, order, size), `order` being a number.

    Sizes are summed by spans of the order before any row is sorted, so that of a long file only the spans up to the one
    in which the cap is passed meet in a task.
    """
    spanned = sized.withColumn("span", F.floor(F.col(order) / span))
    sums = spanned.groupBy(by, "span").agg(F.sum("size").alias("span_size"))
    before = F.coalesce(F.sum("span_size").over(Window.partitionBy(by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = sums.withColumn("before", before).filter(F.col("before") <= cap).select(F.col(by).alias("n_by"), F.col("span").alias("n_span"))
    same = F.col(by).eqNullSafe(F.col("n_by")) & (F.col("span") == F.col("n_span"))
    return spanned.join(near, same, "left_semi").drop("span"), spanned.join(near, same, "left_anti").drop("span")


def byte_cap(parts: DataFrame, *, by: str, order: str, size: Column, cap: int, separator: int = 2) -> DataFrame:
    """(by, order, size, running, kept): whole parts while the running bytes stay within the cap; the first overflow stops.

    The separator counts for a part that something non-empty precedes. Far beyond the cap `running` is null.
    """
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near, far = _reached(parts.select(by, order, size.cast("long").alias("size")), by, order, cap)
    # A separator stands before every part that follows the first non-empty one.
    something = F.coalesce(F.sum("size").over(before), F.lit(0)) > 0
    costed = near.withColumn("cost", F.col("size") + F.when(something, separator).otherwise(0)).withColumn("running", F.sum("cost").over(upto))
    settled = costed.withColumn("kept", F.bool_and(F.col("running") <= cap).over(upto)).select(by, order, "size", "running", "kept")
    return settled.unionByName(far.select(by, order, "size", F.lit(None).cast("long").alias("running"), F.lit(False).alias("kept")))


def first_kept_cap(parts: DataFrame, *, by: str, order: str, cost: Column, cap: int) -> DataFrame:
    """As byte_cap without separators, but the first part is always kept."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near, far = _reached(parts.select(by, order, cost.cast("long").alias("size")), by, order, cap)
    running = near.withColumn("running", F.sum("size").over(upto))
    kept = (F.row_number().over(Window.partitionBy(by).orderBy(order)) == 1) | F.bool_and(F.col("running") <= cap).over(upto)
    settled = running.withColumn("kept", kept).select(by, order, "size", "running", "kept")
    return settled.unionByName(far.select(by, order, "size", F.lit(None).cast("long").alias("running"), F.lit(False).alias("kept")))


def read_window(start: int, total: Column, max_pages: int = 50) -> Column:
    """struct(start_page, stop_page, next_page), 1-based; past the end an empty window at total + 1."""
    first = F.least(F.lit(max(1, start)).cast("long"), total + 1)
    last = F.least(first + max_pages - 1, total)
    return F.struct(first.alias("start_page"), last.alias("stop_page"), F.when(last < total, last + 1).alias("next_page"))


def chunks(texts: DataFrame, *, key: str, text: str, max_tokens: int = 4000, overlap_tokens: int = 200) -> DataFrame:
    """(key, chunk, start, stop, body): pieces of 4 * max_tokens characters that end at a sentence if one ends in their last 500."""
    if not 0 <= overlap_tokens < max_tokens:
        raise ValueError("the overlap must be smaller than a chunk")
    size, overlap = 4 * max_tokens, 4 * overlap_tokens
    sentence_end = re.compile(r"[.!?](?=[ \n\t])")

    def cut(text: str | None):
        body, start = text or "", 0
        while start < len(body):
            stop = start + size
            if stop < len(body):
                # The last sentence that ends in the window's last 499 characters.
                ends = [m.end() for m in sentence_end.finditer(body, max(stop - 499, start + 1), stop + 1) if m.end() <= stop]
                stop = ends[-1] if ends else stop
            stop = min(stop, len(body))
            yield start, stop
            start = len(body) if stop == len(body) else max(stop - overlap, start + 1)

    key_type = texts.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(cut(body))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * len(found), batch.column(0).type), pa.array(range(len(found)), pa.int64()), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64()), pa.array([body[a:b] for a, b in found])],
                        ["key", "chunk", "start", "stop", "body"],
                    )

    cut_up = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {key_type}, chunk long, start long, stop long, body string")
    return cut_up.withColumnRenamed("key", key)


def coverage(pages: DataFrame, *, least_chars: int = 100, most: int = 50) -> DataFrame:
    """What the pages(file_path, page, text_chars, raster_images) of each file hold, and its first pages to recognise: those
    with an image and few characters. Candidates are cut by rank before they come together."""
    text, raster = F.col("text_chars") > 0, F.col("raster_images") > 0
    wanted = raster & (F.col("text_chars") < least_chars)
    sums = [F.count_if(text).alias("pages_with_text"), F.count_if(~text & raster).alias("image_only"), F.count_if(~text & ~raster).alias("empty"), F.count_if(raster).alias("raster_pages"), F.sum("text_chars").cast("long").alias("chars"), (F.count_if(wanted) > most).alias("truncated")]
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy("page"))
    first = pages.filter(wanted).select("file_path", "page").withColumn("r", rank).filter(F.col("r") <= most)
    listed = first.groupBy(F.col("file_path").alias("c_file")).agg(F.array_join(F.sort_array(F.collect_list("page")), ",").alias("ocr_candidates"))
    joined = pages.groupBy("file_path").agg(*sums).join(listed, F.col("file_path").eqNullSafe(F.col("c_file")), "left").drop("c_file")
    return joined.withColumn("ocr_candidates", F.coalesce("ocr_candidates", F.lit("")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones that no new row replaces; a null key is a key like any other."""
    fresh = new.select(*[F.col(k).alias(f"n_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"n_{k}"))
    return new.unionByName(old.join(fresh, same, "left_anti"))


def expired(rows: DataFrame, *, at: str, now: Column, hours: int = 24) -> DataFrame:
    return rows.filter(F.col(at) < now - F.make_interval(hours=F.lit(hours)))
