"""Upkeep, projections and limits over the stored tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings
from ..functions import text as tx
from ..operators import upkeep as op
from ..sources import adapters as ad
from .access import allowed
from .registry import Literal, query, table

NOW = "2024-01-30 12:00:00"


@query("SELECT doc_id AS page_id, source AS file_path, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def bulk_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages by a list of keys: those of the vectors with one label."""
    wanted = table(spark, sf_dir, "embeddings").filter("label = 3").select(F.col("vec_id").alias("page_id"))
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("file_path"), F.md5("text").alias("digest"))
    return op.get_rows(pages, wanted, ["page_id"])


@query(f"""WITH {ad.SECTIONS_SQL}, n AS (SELECT section_key, file_path, 'new' AS state FROM sections WHERE ends_with(file_path, '.com') AND length(title) > 30)
    SELECT * FROM n UNION ALL SELECT section_key, file_path, 'old' FROM sections WHERE file_path NOT IN (SELECT file_path FROM n)""")
def replace_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some files' sections are found again, fewer than before; no old one of these files stays."""
    sections = ad.html_sections(table(spark, sf_dir, "pages"))
    fresh = sections.filter(F.endswith("file_path", F.lit(".com")) & (F.char_length("title") > 30))
    named = [x.select("section_key", "file_path", F.lit(s).alias("state")) for x, s in ((sections, "old"), (fresh, "new"))]
    return op.replace_file(*named)


_FILES = "files AS (SELECT source AS file_path, max(n_chars) AS mtime FROM documents WHERE source <> 'src7' GROUP BY source)"


@query(f"WITH {_FILES} SELECT doc_id AS page_id, coalesce(n_chars = mtime, FALSE) AS valid FROM documents d LEFT JOIN files f ON f.file_path = d.source")
def cache_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are valid whose stored time is the file's; here a file's time is the length of its longest page, one file is gone."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("file_path"), F.col("n_chars").alias("mtime"))
    files = rows.filter("file_path <> 'src7'").groupBy("file_path").agg(F.max("mtime").alias("mtime"))
    return op.valid_rows(rows, files).select("page_id", "valid")


OLD_IMAGES = Literal("page long, path string", (0, "a.png"), (0, "b.png"), (1, "c.png"), (2, "d.png"), (3, None), (4, "b.png"))
NEW_IMAGES = Literal("page long, path string", (0, "b.png"), (0, "e.png"), (3, "f.png"))
READ = Literal("page long", (0,), (1,), (3,), (5,))
_IMAGES = f"""{OLD_IMAGES.cte('o')}, {NEW_IMAGES.cte('n')}, {READ.cte('r')}, k AS (SELECT * FROM o WHERE page NOT IN (SELECT page FROM r) UNION ALL SELECT * FROM n UNION ALL SELECT page, NULL FROM r WHERE page NOT IN (SELECT page FROM n))"""


@query(f"WITH {_IMAGES} SELECT page, path, path IS NULL AS known_empty FROM k")
def image_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the pages read again; pages 1 and 5 are then known to have none."""
    kept, _ = op.image_rows(OLD_IMAGES.df(spark), NEW_IMAGES.df(spark), READ.df(spark))
    return kept.select("page", "path", F.col("path").isNull().alias("known_empty"))


@query(f"WITH {_IMAGES} SELECT DISTINCT path FROM o WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM k WHERE path IS NOT NULL)")
def image_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.image_rows(OLD_IMAGES.df(spark), NEW_IMAGES.df(spark), READ.df(spark))[1]


@query(f"""WITH f AS (SELECT user_id, max(event_id) AS mtime, max(ts) AS accessed_at FROM events WHERE user_id % 50 <> 0 GROUP BY user_id)
    SELECT event_id, CASE WHEN accessed_at < TIMESTAMP '{NOW}' - INTERVAL 24 HOURS THEN 'expired' WHEN f.user_id IS NULL OR event_id <> mtime THEN 'stale' END AS reason FROM events e LEFT JOIN f ON f.user_id = e.user_id""")
def render_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a render of its user's file as of that event; files of every fiftieth user are gone."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    renders = events.select("event_id", F.col("user_id").alias("file_path"), F.col("event_id").alias("mtime"))
    files = events.filter("user_id % 50 <> 0").groupBy(F.col("user_id").alias("file_path")).agg(F.max("event_id").alias("mtime"), F.max("ts").alias("accessed_at"))
    return op.swept(renders, files, now=F.lit(NOW).cast("timestamp_ntz")).select("event_id", "reason")


@query("SELECT 'pages' AS name, count(*) AS cleared, 0::BIGINT AS left_over FROM documents UNION ALL SELECT 'vectors', count(*), 0::BIGINT FROM embeddings")
def clear_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, counts = op.cleared({"pages": table(spark, sf_dir, "documents").select("doc_id"), "vectors": table(spark, sf_dir, "embeddings").select("vec_id")})
    rest = left["pages"].unionAll(left["vectors"]).agg(F.count("*").alias("left_over"))
    return counts.join(F.broadcast(rest), how="cross")


_META = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, '' AS author, '' AS subject, '' AS keywords, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS creator, '' AS producer, '' AS creation_date, '' AS modification_date, 'html' AS format, '' AS encryption"


@query(f"SELECT page_id, {_META} FROM pages")
def metadata_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten fields under their names, empty where the page has none."""
    raw = F.map_from_arrays(F.array(F.lit("title"), F.lit("creator"), F.lit("format")), F.array(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), F.regexp_extract("html", '<html lang="([^"]*)"', 1), F.lit("html")))
    return table(spark, sf_dir, "pages").select("page_id", *op.metadata(raw))


@query(f"""WITH {ad.PAGES_SQL}, t AS (SELECT file_path, page_num AS ord, 1 + page_num % 3 AS level, string_split(text, ' ')[1] AS title, page_num + 1 AS page FROM pages WHERE page_num < 40 + length(file_path) * 4)
    SELECT file_path, CASE WHEN count(*) <= 50 THEN CAST(sum(level) AS BIGINT) END AS levels, CASE WHEN count(*) <= 50 THEN string_agg(title || '@' || page, ',' ORDER BY ord) END AS listed, count(*) AS entries FROM t GROUP BY file_path""")
def toc_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of a file's first pages as its table of contents, which isn't given beyond 50 entries."""
    pages = ad.pages(table(spark, sf_dir, "documents")).filter("page_num < 40 + length(file_path) * 4")
    toc = pages.select("file_path", F.col("page_num").alias("ord"), (1 + F.col("page_num") % 3).alias("level"), F.get(F.split("text", " "), F.lit(0)).alias("title"), (F.col("page_num") + 1).alias("page"))
    listed = op.toc_entries(toc)
    return listed.select("file_path", F.aggregate("toc", F.lit(0).cast("long"), lambda s, x: s + x["level"]).alias("levels"), F.array_join(F.transform("toc", lambda x: F.concat(x["title"], F.lit("@"), x["page"].cast("string"))), ",").alias("listed"), "entries")


@query("SELECT page_id, string_split(url, '/')[-1] AS image_id FROM pages")
def image_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", op.basename(F.col("url")).alias("image_id"))


@query("SELECT doc_id AS page_id, coalesce(CASE quality WHEN 0 THEN TRUE WHEN 1 THEN length(text) > 0 END, FALSE) AS cached FROM documents LEFT JOIN labels USING (doc_id)")
def ocr_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label stands for where its stored text comes from: 0 recognised, 1 extracted, none not stored."""
    source = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), F.when(F.col("quality") == 0, "ocr").when(F.col("quality") == 1, "extracted").alias("origin"))
    joined = table(spark, sf_dir, "documents").select("doc_id", "text").join(source, F.col("doc_id") == F.col("l_id"), "left")
    return joined.select(F.col("doc_id").alias("page_id"), op.text_is_cached(F.col("origin"), F.col("text")).alias("cached"))


@query("SELECT doc_id AS page_id, md5(CASE WHEN l.doc_id IS NULL THEN text ELSE 'stored: ' || text END) AS digest, CASE WHEN l.doc_id IS NULL THEN 'extracted' ELSE 'cached' END AS origin FROM documents LEFT JOIN labels l USING (doc_id)")
def merged_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pages are stored, with a mark that shows it; the others are extracted now."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    stored = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi").withColumn("text", F.concat(F.lit("stored: "), F.col("text")))
    return op.page_texts(docs.select("page_id"), stored, docs).select("page_id", F.md5("text").alias("digest"), "origin")


_COUNTED = "doc_id % 3 AS images, (contains(text, chr(10)))::INT AS tables"


@query(f"""WITH p AS (SELECT source AS file_path, length(text) AS chars, {_COUNTED}, vec_id IS NOT NULL AS hit FROM documents LEFT JOIN embeddings ON doc_id = vec_id)
    SELECT file_path, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(images) AS BIGINT) AS images, CAST(sum(tables) AS BIGINT) AS tables, count(*) FILTER (hit) AS cache_hits, count(*) FILTER (NOT hit) AS cache_misses FROM p GROUP BY file_path""")
def read_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"))
    pages = table(spark, sf_dir, "documents").join(vectors, F.col("doc_id") == F.col("v"), "left")
    return op.read_totals(pages.select(F.col("source").alias("file_path"), F.char_length("text").alias("chars"), (F.col("doc_id") % 3).alias("images"), F.contains("text", F.lit("\n")).cast("int").alias("tables"), F.col("v").isNotNull().alias("hit")))


@query(f"""WITH {ad.LINES_SQL}, s AS (SELECT * FROM lines WHERE length(line) >= 3), m AS (SELECT file_path, count(*) > 200 OR bool_or(length(line) > 200) AS spans_truncated FROM s GROUP BY file_path)
    SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY page_id, line_no) AS rank, substr(line, 1, 200) AS text, spans_truncated FROM s JOIN m USING (file_path) QUALIFY rank <= 200""")
def listed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for hidden spans: the first 200 of a file, 200 characters of each."""
    spans = ad.page_lines(table(spark, sf_dir, "documents")).filter(F.char_length("line") >= 3).withColumnRenamed("line", "text")
    return op.listed_spans(spans, order=["page_id", "line_no"])


_LIMITED = ", ".join(f"greatest({low}, least({high}, v)) AS {name}" for name, (low, high) in op.LIMITS.items())


@query(f"WITH r AS (SELECT doc_id AS request, n_chars - 300 AS v FROM documents) SELECT request, {_LIMITED} FROM r")
def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever is asked for, each field stays within its limits."""
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request"), (F.col("n_chars") - 300).alias("v"))
    return asked.select("request", *[op.clamped(F.col("v"), name).alias(name) for name in op.LIMITS])


_TOML = """
[paths]
allow = ["*.example.com", "*.example.org"]
deny = ["m.*", "*.th.*"]
[embedding]
model = "small"
[limits]
max_response_bytes = 3000000
"""


@query(r"""SELECT page_id, NOT (regexp_matches(h, '^m\..*$') OR regexp_matches(h, '^.*\.th\..*$')) AND (regexp_matches(h, '^.*\.example\.com$') OR regexp_matches(h, '^.*\.example\.org$')) AS allowed, 'small' AS model, 2000000 AS answer_bytes FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS h FROM pages)""")
def configured_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts by the rules of a settings text; its answer size is beyond the greatest one."""
    given = settings.parse(_TOML)
    host = F.lower(ad.host(F.col("url")))
    rule = allowed(host, list(given.allow), list(given.deny))
    return table(spark, sf_dir, "pages").select("page_id", rule.alias("allowed"), F.lit(given.model).alias("model"), F.lit(given.answer_bytes).alias("answer_bytes"))


@query("SELECT d.doc_id AS page_id, CASE WHEN l.doc_id IS NOT NULL THEN l.toxic = 1 ELSE contains(lower(text), 'idiot') END AS flagged, l.doc_id IS NULL AS computed FROM documents d LEFT JOIN labels l USING (doc_id)")
def flag_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page flags: the stored ones (labels), the others computed from the text, and only those."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).alias("flagged"))
    whole, fresh = op.cache_through(docs, stored, lambda keys: docs.join(keys, "page_id", "left_semi").select("page_id", F.contains(F.lower("text"), F.lit("idiot")).alias("flagged")), "page_id")
    marks = fresh.select(F.col("page_id").alias("f"), F.lit(True).alias("computed"))
    return whole.join(marks, F.col("page_id") == F.col("f"), "left").select("page_id", "flagged", F.coalesce("computed", F.lit(False)).alias("computed"))


_INDEXED = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s\-]', ' ', 'g'), '\s+'), lambda x: x <> '')"


@query(f"""WITH n AS (SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN text ELSE 'rewritten ' || substr(text, 1, 50) END AS text FROM documents LEFT JOIN labels l USING (doc_id)), w AS (SELECT doc_id, unnest({_INDEXED.format('text')}) AS word FROM n)
    SELECT doc_id AS page_id, count(*) AS tokens, count(DISTINCT word) AS words, count(*) FILTER (word = 'rewritten') AS rewritten FROM w GROUP BY doc_id""")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word index after labelled pages were written again with another, shorter text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    changed = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi")
    changed = changed.select("page_id", F.concat(F.lit("rewritten "), F.substring("text", 1, 50)).alias("text"))
    index = op.update_index(op.index_pages(docs, tx.word_tokens(F.col("text"))), changed, tx.word_tokens(F.col("text")))
    return index.groupBy("page_id").agg(F.sum("tf").alias("tokens"), F.count("*").alias("words"), F.coalesce(F.sum(F.when(F.col("word") == "rewritten", F.col("tf"))), F.lit(0)).alias("rewritten"))
