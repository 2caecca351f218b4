"""Upkeep of stored rows, projections of a document's facts, and the limits that requests are held to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least and the greatest value of each request field.
LIMITS = {"max_results": (1, 100), "context_chars": (10, 2000), "pages": (1, 500), "ocr_pages": (1, 20), "render_pages": (1, 5), "dpi": (72, 400)}
#: Entries of a table of contents given in full, hidden spans listed, and the characters of one.
TOC_INLINE, SPANS_LISTED, SPAN_CHARS = 50, 200, 200
#: The metadata fields, and what they are called.
METADATA = {"title": "title", "author": "author", "subject": "subject", "keywords": "keywords", "creator": "creator", "producer": "producer", "creationDate": "creation_date", "modDate": "modification_date", "format": "format", "encryption": "encryption"}


def get_rows(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows of the wanted keys; a key that isn't stored gives none."""
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi")


def replace_file(old: DataFrame, new: DataFrame, file: str = "file_path") -> DataFrame:
    """All rows of the files that `new` has are replaced, also where the file has fewer rows now."""
    return old.join(new.select(file).distinct(), file, "left_anti").unionByName(new)


def valid_rows(rows: DataFrame, files: DataFrame, *, file: str = "file_path", mtime: str = "mtime") -> DataFrame:
    """rows with `valid`: whether they were made from the file as it is now; rows of a file that is gone aren't valid."""
    now = files.select(F.col(file).alias("n_file"), F.col(mtime).alias("n_mtime"))
    joined = rows.join(now, F.col(file) == F.col("n_file"), "left")
    return joined.withColumn("valid", F.coalesce(F.col(mtime) == F.col("n_mtime"), F.lit(False))).drop("n_file", "n_mtime")


def image_rows(old: DataFrame, new: DataFrame, pages: DataFrame, *, page: str = "page", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(the rows to keep, the paths that no row names any more) after the given pages' images were read again.

    A page that was read and has no image keeps one row without a path: it is known to be empty, not unread.
    """
    read = pages.select(page).distinct()
    empty = read.join(new.select(page).distinct(), page, "left_anti").select(page, F.lit(None).cast("string").alias(path))
    kept = old.join(read, page, "left_anti").select(page, path).unionByName(new.select(page, path)).unionByName(empty)
    gone = old.select(path).filter(F.col(path).isNotNull()).join(kept.select(path).filter(F.col(path).isNotNull()).distinct(), path, "left_anti").distinct()
    return kept, gone


def swept(renders: DataFrame, files: DataFrame, *, now: Column, hours: int = 24) -> DataFrame:
    """renders(file_path, mtime, ...) with `reason`: `expired` (no access of the file for so long), `stale` (the file changed
    or is gone), or null for those that stay. files: (file_path, mtime, accessed_at)."""
    known = files.select(F.col("file_path").alias("n_file"), F.col("mtime").alias("n_mtime"), "accessed_at")
    joined = renders.join(known, F.col("file_path") == F.col("n_file"), "left")
    expired = F.col("accessed_at") < now - F.make_dt_interval(hours=F.lit(hours))
    stale = F.col("n_file").isNull() | (F.col("mtime") != F.col("n_mtime"))
    return joined.withColumn("reason", F.when(F.coalesce(expired, F.lit(False)), "expired").when(stale, "stale")).drop("n_file", "n_mtime", "accessed_at")


def cleared(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables without rows, a row a table: name, cleared)."""
    counts = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("cleared")).select(F.lit(name).alias("name"), "cleared")
        counts = one if counts is None else counts.unionAll(one)
    return {name: rows.limit(0) for name, rows in tables.items()}, counts


def metadata(fields: Column) -> list[Column]:
    """A map of a file's raw metadata as columns; what is missing is empty."""
    return [F.coalesce(F.try_element_at(fields, F.lit(raw)), F.lit("")).alias(name) for raw, name in METADATA.items()]


def toc_entries(toc: DataFrame, *, file: str = "file_path", order: str = "ord", inline: int = TOC_INLINE) -> DataFrame:
    """(file, toc, entries): the entries as (level, title, page) in order, given only if there are at most ``inline``, and how
    many there are. No more than that come together, whatever the length of a table."""
    listed = toc.filter(F.col(order) < inline).groupBy(file).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "level", "title", "page"))).alias("e"))
    counts = toc.groupBy(F.col(file).alias("c_file")).agg(F.count("*").alias("entries"))
    entries = F.transform("e", lambda x: F.struct(x["level"].alias("level"), x["title"].alias("title"), x["page"].alias("page")))
    return counts.join(listed, F.col("c_file") == F.col(file), "left").select(F.col("c_file").alias(file), F.when(F.col("entries") <= inline, entries).alias("toc"), "entries")


def basename(path: Column) -> Column:
    """What stands after the last slash: the only part of a stored path that is shown."""
    return F.substring_index(path, "/", -1)


def text_is_cached(source: Column, text: Column) -> Column:
    """Whether a stored text answers a request for recognised text: recognised ones do, extracted ones unless empty."""
    return F.coalesce((source == "ocr") | (source == "extracted") & (F.char_length(text) > 0), F.lit(False))


def page_texts(wanted: DataFrame, cached: DataFrame, extracted: DataFrame, *, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, text, origin) of the wanted pages: the stored text, else the one extracted now."""
    have = cached.select(F.col(key).alias("h_key"), F.col(text).alias("h_text"))
    fresh = extracted.join(have.select("h_key"), F.col(key) == F.col("h_key"), "left_anti").select(F.col(key).alias("x_key"), F.col(text).alias("x_text"))
    joined = wanted.select(key).join(have, F.col(key) == F.col("h_key"), "left").join(fresh, F.col(key) == F.col("x_key"), "left")
    return joined.select(key, F.coalesce("h_text", "x_text").alias(text), F.when(F.col("h_key").isNotNull(), "cached").otherwise("extracted").alias("origin"))


def read_totals(pages: DataFrame, *, by: str = "file_path") -> DataFrame:
    """Sums over pages(file_path, chars, images, tables, hit) of a read."""
    return pages.groupBy(by).agg(F.sum("chars").cast("long").alias("chars"), F.sum("images").cast("long").alias("images"), F.sum("tables").cast("long").alias("tables"), F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("cache_misses"))


def listed_spans(spans: DataFrame, *, file: str = "file_path", order: list[str], text: str = "text", most: int = SPANS_LISTED, chars: int = SPAN_CHARS) -> DataFrame:
    """(file, rank, text, spans_truncated): each file's first spans, cut to so many characters, and whether any is missing or cut.

    A rank limit cuts the spans before they come together.
    """
    from pyspark.sql.window import Window

    first = Window.partitionBy(file).orderBy(*order)
    ranked = spans.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most)
    more = spans.groupBy(F.col(file).alias("m_file")).agg((F.count("*") > most).alias("more"), F.bool_or(F.char_length(text) > chars).alias("cut"))
    joined = ranked.join(more, F.col(file) == F.col("m_file"))
    return joined.select(file, F.col("rank").cast("long").alias("rank"), F.substring(F.col(text), 1, chars).alias(text), (F.col("more") | F.col("cut")).alias("spans_truncated"))


def clamped(value: Column, field: str) -> Column:
    low, high = LIMITS[field]
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def cache_through(wanted: DataFrame, cached: DataFrame, compute, key: str) -> tuple[DataFrame, DataFrame]:
    """(the rows of all wanted keys, those among them that had to be computed and are to be stored).

    compute: from a table of keys to rows of cached's columns; it sees only the keys that aren't stored.
    """
    keys = wanted.select(key).distinct()
    fresh = compute(keys.join(cached.select(key), key, "left_anti")).select(*cached.columns)
    return cached.join(keys, key, "left_semi").unionByName(fresh), fresh


def index_pages(pages: DataFrame, tokens: Column, key: str = "page_id") -> DataFrame:
    """(key, word, tf): the inverted index of pages."""
    return pages.select(key, F.explode(tokens).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))


def update_index(index: DataFrame, pages: DataFrame, tokens: Column, key: str = "page_id") -> DataFrame:
    """The index after pages were written again: all of their old entries go, also for words they no longer have."""
    return index.join(pages.select(key).distinct(), key, "left_anti").unionByName(index_pages(pages, tokens, key))
