"""Reading, paging, upkeep and text queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import paging as pg
from ..sources import adapters as ad
from .registry import Literal, query, table

CAP = 50_000
_CAPPED = f"""{ad.PAGES_SQL}, z AS (SELECT file_path, page_num, strlen(text) AS size FROM pages),
    c AS (SELECT *, size + CASE WHEN coalesce(sum(size) OVER (PARTITION BY file_path ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 2 ELSE 0 END AS cost FROM z),
    r AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY file_path ORDER BY page_num) AS BIGINT) AS running FROM c),
    k AS (SELECT *, bool_and(running <= {CAP}) OVER (PARTITION BY file_path ORDER BY page_num) AS kept FROM r)"""


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    numbers = ad.page_numbers(docs)
    sizes = docs.select(F.col("doc_id").alias("d"), F.octet_length("text").alias("bytes"))
    return pg.byte_cap(numbers.join(sizes, F.col("page_id") == F.col("d")), by="file_path", order="page_num", size=F.col("bytes"), cap=CAP)


@query(f"WITH {_CAPPED} SELECT file_path, page_num, running FROM k WHERE kept")
def byte_capped_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(spark, sf_dir).filter("kept").select("file_path", "page_num", "running")


@query(f"WITH {_CAPPED} SELECT file_path, count(*) FILTER (kept) AS returned, count(*) AS available, min(page_num) FILTER (NOT kept) + 1 AS next_page, coalesce(max(running) FILTER (kept), 0) AS returned_bytes FROM k GROUP BY file_path")
def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = F.when(~F.col("kept"), F.col("page_num"))
    return _capped(spark, sf_dir).groupBy("file_path").agg(F.count_if("kept").alias("returned"), F.count("*").alias("available"), (F.min(dropped) + 1).alias("next_page"), F.coalesce(F.max(F.when(F.col("kept"), F.col("running"))), F.lit(0)).alias("returned_bytes"))


_STARTS = Literal("start long", (-3,), (1,), (40,), (1000,))


@query(f"""WITH {_STARTS.cte('s')}, t AS (SELECT source AS file_path, count(*) AS total FROM documents GROUP BY source), a AS (SELECT file_path, start AS asked, total, least(greatest(start, 1), total + 1) AS start_page FROM t, s)
    SELECT file_path, asked, start_page, least(start_page + 19, total) AS stop_page, CASE WHEN least(start_page + 19, total) < total THEN least(start_page + 19, total) + 1 END AS next_page FROM a""")
def read_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("file_path")).agg(F.count("*").alias("total"))
    windows = [totals.select("file_path", F.lit(s).cast("long").alias("asked"), pg.read_window(s, F.col("total"), 20).alias("w")) for (s,) in _STARTS.rows]
    whole = windows[0]
    for w in windows[1:]:
        whole = whole.unionAll(w)
    return whole.select("file_path", "asked", "w.*")


@query(f"""WITH {ad.SECTIONS_SQL}, c AS (SELECT section_key, file_path, sum(least(strlen(title), 2048) + 80) OVER (PARTITION BY file_path ORDER BY section_key) AS running, row_number() OVER (PARTITION BY file_path ORDER BY section_key) AS n FROM sections)
    SELECT section_key, file_path, CAST(running AS BIGINT) AS running FROM c WHERE n = 1 OR running <= 300""")
def section_byte_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = ad.html_sections(table(spark, sf_dir, "pages"))
    capped = pg.first_kept_cap(sections, by="file_path", order="section_key", cost=F.least(F.octet_length("title"), F.lit(2048)) + 80, cap=300)
    return capped.filter("kept").select("section_key", "file_path", "running")


@query("SELECT doc_id, substr(text, 1, n) AS cut, strlen(substr(text, 1, n)) AS bytes FROM (SELECT doc_id, text, list_max(list_filter(range(0, 102), lambda i: strlen(substr(text, 1, i)) <= 101)) AS n FROM documents)")
def utf8_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "documents").select("doc_id", tx.utf8_truncate(F.col("text"), 101).alias("cut"))
    return cut.select("doc_id", "cut", F.octet_length("cut").cast("long").alias("bytes"))


_SPECS = Literal("id long, spec string, total long", (0, "1-3,5,8-10", 10), (1, "1,5,10", 10), (2, None, 4), (3, "3,1-4,2", 10), (4, "9-15,0,x", 10), (5, " 2 - 4 , 7", 10))


@query(f"""WITH {_SPECS.cte('s')}, p AS (SELECT id, total, unnest(range(len(string_split(x, ',')))) AS o, replace(unnest(string_split(x, ',')), ' ', '') AS part FROM (SELECT id, total, coalesce(spec, '1-' || total) AS x FROM s)),
    g AS (SELECT id, o, CAST(string_split(part, '-')[1] AS BIGINT) AS low, least(CAST(string_split(part, '-')[-1] AS BIGINT), total) AS high FROM p WHERE regexp_matches(part, '^\\d+(-\\d+)?$')),
    e AS (SELECT id, o, unnest(range(greatest(low, 1), high + 1)) AS n FROM g WHERE high >= 1), f AS (SELECT id, n - 1 AS page, min(o * 100000 + n) AS at0 FROM e GROUP BY id, n)
    SELECT id, page, row_number() OVER (PARTITION BY id ORDER BY at0) AS ord FROM f""")
def page_range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.parse_page_ranges(_SPECS.df(spark), key="id", spec="spec", total="total")


@query()
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pg.chunks(table(spark, sf_dir, "documents"), key="doc_id", text="text", max_tokens=400, overlap_tokens=20)
    return cut.select("doc_id", "chunk", "start", "stop", F.sha2("body", 256).alias("body_sha256"))


@query("SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT source AS file_path, count(*) * 800 AS estimated_tokens, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(sum(strlen(text)) / 1048576.0, 2) AS size_mb, CAST(4 * ((sum(strlen(text)) + 2) // 3) AS BIGINT) AS base64_bytes, substr(sha256(source), 1, 16) AS path_hash FROM documents GROUP BY source")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.octet_length("text"))
    sized = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("file_path")).agg((F.count("*") * 800).alias("estimated_tokens"), total.alias("bytes"))
    return sized.select("*", F.round(F.col("bytes") / 1048576, 2).alias("size_mb"), (4 * F.floor((F.col("bytes") + 2) / 3)).alias("base64_bytes"), F.substring(F.sha2(F.col("file_path"), 256), 1, 16).alias("path_hash"))


_BOXES = "len(string_split(html, 'class=\"ad\"')) - 1"


@query(f"""WITH {ad.SECTIONS_SQL}, p AS (SELECT file_path, section_key AS page, length(text) AS chars, {_BOXES} AS raster FROM sections JOIN pages ON page_id = section_key), c AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY page) AS r FROM p WHERE raster > 0 AND chars < 2000)
    SELECT file_path, count(*) FILTER (chars > 0) AS pages_with_text, count(*) FILTER (chars = 0 AND raster > 0) AS image_only, count(*) FILTER (chars = 0 AND raster = 0) AS empty, count(*) FILTER (raster > 0) AS raster_pages, CAST(sum(chars) AS BIGINT) AS chars,
      coalesce((SELECT string_agg(page, ',' ORDER BY page) FROM c WHERE c.file_path = p.file_path AND r <= 50), '') AS ocr_candidates, count(*) FILTER (raster > 0 AND chars < 2000) > 50 AS truncated FROM p GROUP BY file_path""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages by host: their advertisements play the raster images, and a page of under 2000 characters with one is a
    candidate for recognition."""
    raw = table(spark, sf_dir, "pages").select(F.col("page_id").alias("p"), (F.size(F.split("html", 'class="ad"')) - 1).alias("raster_images"))
    texts = ad.html_sections(table(spark, sf_dir, "pages")).select("file_path", F.col("section_key").alias("page"), F.char_length("text").alias("text_chars"))
    return pg.coverage(texts.join(raw, F.col("page") == F.col("p")).drop("p"), least_chars=2000)


@query("SELECT count(*) AS pages, count(DISTINCT source) AS files, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (length(text) < 100) AS short_pages, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS blocks FROM documents")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.char_length("text")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("pages"), F.countDistinct("source").alias("files"), F.sum(size).cast("long").alias("chars"), F.count_if(size < 100).alias("short_pages"), F.sum(F.size(F.split("text", "\n"))).cast("long").alias("blocks"))


@query("SELECT source AS file_path, count(*) FILTER (vec_id IS NOT NULL) AS indexed, count(*) AS total FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY source")
def index_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id")
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(vectors, F.col("doc_id") == F.col("vec_id"), "left")
    return joined.groupBy(F.col("source").alias("file_path")).agg(F.count("vec_id").alias("indexed"), F.count("*").alias("total"))


@query("SELECT doc_id AS page_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND regexp_matches(text, '\\S')")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a vector that have text to embed."""
    pages = table(spark, sf_dir, "documents").filter(F.rlike("text", F.lit(r"\S"))).select(F.col("doc_id").alias("page_id"))
    return pages.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id")), "page_id", "left_anti")


@query("SELECT d.doc_id AS page_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'extracted' ELSE 'cached' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id)")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached values, and those computed for what is missing."""
    cached = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("hit"))
    joined = table(spark, sf_dir, "documents").select("doc_id").join(cached, "doc_id", "left")
    return joined.select(F.col("doc_id").alias("page_id"), F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(F.col("hit"), "cached").otherwise("extracted").alias("origin"))


@query("WITH l AS (SELECT user_id, max(ts) AS accessed_at FROM events GROUP BY user_id) SELECT user_id, accessed_at < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOURS AS expired FROM l")
def ttl_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp_ntz").alias("accessed_at"))
    limit = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(24))
    return last.select("user_id", (F.col("accessed_at") < limit).alias("expired"))


@query("WITH n AS (SELECT doc_id, 'new' AS state FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id + 1000000, 'new' FROM documents WHERE doc_id < 5) SELECT doc_id AS page_id, state FROM n UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def upsert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    fresh = ids.filter("doc_id % 10 = 0").unionAll(ids.filter("doc_id < 5").select((F.col("doc_id") + 1000000).alias("doc_id")))
    return pg.upsert(ids.withColumn("state", F.lit("old")), fresh.withColumn("state", F.lit("new")), ["doc_id"]).withColumnRenamed("doc_id", "page_id")


_OLD = Literal("page long, path string", (0, "a.png"), (0, "b.png"), (1, "c.png"), (2, "d.png"))
_NEW = Literal("page long, path string", (0, "b.png"), (0, "e.png"), (2, "d.png"))


@query(f"WITH {_OLD.cte('o')}, {_NEW.cte('n')} SELECT path FROM o EXCEPT SELECT path FROM n")
def orphan_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _OLD.df(spark).select("path").subtract(_NEW.df(spark).select("path"))


@query("SELECT source AS file_path, count(*) AS pages FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY source")
def invalidate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("src1",), ("src2",)], "source string")
    return table(spark, sf_dir, "documents").join(gone, "source", "left_anti").groupBy(F.col("source").alias("file_path")).agg(F.count("*").alias("pages"))


@query("SELECT d.doc_id AS page_id, coalesce(CASE WHEN l.quality = 0 THEN 'ocr' END, 'extracted') AS origin FROM documents d LEFT JOIN labels l USING (doc_id)")
def source_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "ocr").alias("o"))
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select(F.col("doc_id").alias("page_id"), F.coalesce("o", F.lit("extracted")).alias("origin"))


@query("SELECT source AS file_path, bool_or(coalesce(toxic = 1, FALSE)) AS any_flagged, count(*) FILTER (toxic = 1) AS flagged_pages, bool_and(toxic IS NOT NULL) AS all_scanned FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def hidden_flag_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page flag (here the toxic label) attached by a left join and rolled up; null means not computed."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return joined.groupBy(F.col("source").alias("file_path")).agg(F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("any_flagged"), F.count_if(F.col("toxic") == 1).alias("flagged_pages"), F.bool_and(F.col("toxic").isNotNull()).alias("all_scanned"))


@query("SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''), ' ')) AS digest FROM documents")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.norm_text(F.col("text"))).alias("digest"))


@query(f"WITH {ad.LINES_SQL}, s AS (SELECT page_id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(line, '[0-9]+', '#', 'g')), '\\s+'), lambda x: x <> ''), ' ') AS sig FROM lines) SELECT sig, count(DISTINCT page_id) AS pages FROM s GROUP BY sig HAVING count(DISTINCT page_id) >= 5")
def signature_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = ad.page_lines(table(spark, sf_dir, "documents")).select("page_id", tx.signature(F.col("line")).alias("sig")).distinct()
    return signed.groupBy("sig").agg(F.count("*").alias("pages")).filter("pages >= 5")


_MOJIBAKE = Literal("id long, body string", (0, "plain text"), (1, "x֐y᳿z"), (2, "กข thai"), (3, "日本語"), (4, ""))


@query(f"WITH {_MOJIBAKE.cte('t')} SELECT id, regexp_replace(body, '[\\x{{0590}}-\\x{{1CFF}}]', '', 'g') AS kept FROM t")
def mojibake_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _MOJIBAKE.df(spark).select("id", tx.without_mojibake(F.col("body")).alias("kept"))


@query("SELECT page_id, len(t) AS tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id AS page_id, list_filter(string_split_regex(regexp_replace(lower(regexp_replace(text, '\\\\[a-zA-Z]+', ' ', 'g')), '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS t FROM documents)")
def alnum_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stream of tokens of every page, as a count and a digest."""
    cut = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.inline(F.array(F.struct(tx.alnum_tokens(F.col("text")).alias("t")))))
    return cut.select("page_id", F.size("t").cast("long").alias("tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("SELECT 'paged documents' AS model, 10 AS max_results, 200 AS context_chars, 500 AS max_pages, FALSE AS pdf_decoder, FALSE AS ocr")
def server_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What this engine can do, as one row; decoders are pluggable and absent here."""
    return spark.range(1).select(F.lit("paged documents").alias("model"), F.lit(10).alias("max_results"), F.lit(200).alias("context_chars"), F.lit(500).alias("max_pages"), F.lit(False).alias("pdf_decoder"), F.lit(False).alias("ocr"))
