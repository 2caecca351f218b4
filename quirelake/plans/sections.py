"""Section, heading and boilerplate queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import sections as op
from ..sources import adapters as ad
from .registry import Literal, query, table

TOC = Literal("file_path string, ord long, level long, title string, page long", ("a", 0, 1, "Intro", 1), ("a", 1, 2, "Scope", 1), ("a", 2, 2, "Terms", 3), ("a", 3, 1, "Method", 4), ("a", 4, 2, "Data", 5), ("a", 5, 1, "End", 9), ("b", 0, 1, "One", 1), ("b", 1, 3, "Deep", 2), ("b", 2, 1, "Two", 2))
TOTALS = Literal("file_path string, total long", ("a", 10), ("b", 3))
_SPANS = f"""{TOC.cte('toc')}, {TOTALS.cte('tot')}, spans AS (SELECT file_path, ord, title, page AS start_page,
    coalesce((SELECT arg_min(l.page, l.ord) FROM toc l WHERE l.file_path = t.file_path AND l.ord > t.ord AND l.level <= t.level) - 1, total) AS end_page FROM toc t JOIN tot USING (file_path))"""


def _spans(spark: SparkSession) -> DataFrame:
    return op.toc_sections(TOC.df(spark), TOTALS.df(spark))


@query(f"WITH {_SPANS} SELECT * FROM spans")
def toc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark)


@query(f"WITH {_SPANS} SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans i WHERE i.file_path = s.file_path AND i.ord <> s.ord AND i.start_page > s.start_page AND i.start_page <= s.end_page)")
def leaf_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.leaf_sections(_spans(spark))


_BY_TEN = "SELECT file_path, page_num // 10 AS ord, 'part' AS title, min(page_num) + 1 AS start_page, max(page_num) + 1 AS end_page FROM pages GROUP BY file_path, page_num // 10"


@query(f"WITH {ad.PAGES_SQL}, s AS ({_BY_TEN}) SELECT s.file_path, ord, start_page, end_page, md5(string_agg(text, chr(10) ORDER BY page_num)) AS digest FROM s JOIN pages p ON s.file_path = p.file_path AND page_num + 1 BETWEEN start_page AND end_page GROUP BY ALL")
def section_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    numbers = ad.page_numbers(docs)
    tens = numbers.groupBy("file_path", F.floor(F.col("page_num") / 10).alias("ord")).agg((F.min("page_num") + 1).alias("start_page"), (F.max("page_num") + 1).alias("end_page"))
    return op.section_text(tens, ad.pages(docs)).select("file_path", "ord", "start_page", "end_page", F.md5("text").alias("digest"))


LINES = Literal("file_path string, page long, ord long, line string", ("a", 1, 0, "Abstract"), ("a", 1, 1, "some body text"), ("a", 1, 2, "1 Introduction"), ("a", 2, 0, "2.1 Method. And more; things"), ("a", 3, 0, "Appendix B tables"), ("a", 3, 1, "chapter 7"), ("b", 1, 0, "  References  "), ("b", 2, 0, "References to nothing"), ("b", 2, 1, "Section 12 of it"), ("b", 2, 2, "3 lower"))
_HEADING_SQL = op.HEADING.replace("'", "''")


@query(f"""WITH {LINES.cte('l')}, {TOTALS.cte('tot')}, b AS (SELECT *, regexp_replace(regexp_replace(line, '^\\s+', ''), '\\s+$', '') AS bare FROM l), h AS (SELECT * FROM b WHERE regexp_matches(bare, '{_HEADING_SQL}') AND length(line) <= 200)
    SELECT file_path, page AS start_page, ord, CASE WHEN bare <> '' AND length(bare) <= 120 AND NOT contains(regexp_replace(bare, '[.:]$', ''), '. ') AND NOT contains(regexp_replace(bare, '[.:]$', ''), '; ') THEN bare END AS title,
      coalesce(lead(page) OVER (PARTITION BY file_path ORDER BY page, ord) - 1, total) AS end_page FROM h JOIN tot USING (file_path)""")
def regex_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.regex_sections(LINES.df(spark), TOTALS.df(spark))


@query(f"WITH {ad.SECTIONS_SQL}, n AS (SELECT *, regexp_matches(title, '{_HEADING_SQL}') AS heading FROM sections) SELECT section_key, heading, length(text) AS chars FROM n WHERE file_path NOT IN (SELECT 'none') ORDER BY section_key")
def section_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of files without a table of contents: all of the web pages, which have none."""
    with_toc = TOC.df(spark).select("file_path").distinct()
    sections = ad.html_sections(table(spark, sf_dir, "pages")).join(with_toc, "file_path", "left_anti")
    return sections.select("section_key", F.rlike("title", F.lit(op.HEADING)).alias("heading"), F.char_length("text").cast("long").alias("chars"))


SPANS = Literal(
    "file_path string, page long, ord long, page_height double, y0 double, y1 double, text string, font string, flags long",
    ("a", 1, 0, 800.0, 50.0, 70.0, "1 Introduction", "Times-Bold", 16), ("a", 1, 1, 800.0, 75.0, 87.0, "Plain body text goes on here", "Times", 0), ("a", 1, 2, 800.0, 90.0, 102.0, "and on, and on", "Times", 0),
    ("a", 1, 3, 800.0, 150.0, 162.0, "RELATED WORK", "Times", 0), ("a", 1, 4, 800.0, 170.0, 182.0, "More of the body text", "Times", 0), ("a", 2, 0, 800.0, 40.0, 52.0, "Running Head Of Pages", "Arial", 0), ("a", 2, 1, 800.0, 300.0, 312.0, "last words of the body", "Times", 0),
    ("b", 1, 0, 600.0, 300.0, 310.0, "Only Line-B", "Foo-B", 0), ("b", 1, 1, 600.0, 330.0, 340.0, "   ", "Bar", 4),
)
_FEATURES = f"""{SPANS.cte('l')}, faces AS (SELECT file_path, font, flags & 16 AS b, count(*) AS n, min(page * 1000 + ord) AS f FROM l GROUP BY ALL), body AS (SELECT file_path, font AS body_font, b <> 0 AS body_bold FROM faces QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY n DESC, f) = 1),
    p AS (SELECT l.*, body_font, body_bold, lag(y1) OVER (PARTITION BY l.file_path, page ORDER BY ord) AS prev, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS bare FROM l JOIN body USING (file_path)),
    w AS (SELECT *, list_filter(list_filter(string_split_regex(bare, '\\s+'), lambda x: x <> ''), lambda x: regexp_matches(x, '\\p{{L}}')) AS words FROM p),
    s AS (SELECT file_path, page, ord, bare <> '' AND (font <> body_font OR ((flags & 16) <> 0) <> body_bold) AS face_delta, bare <> '' AND ((flags & 16) <> 0 OR contains(font, 'Bold') OR contains(font, '-B') OR contains(font, '.B')) AS bold_marker,
      bare <> '' AND coalesce(y0 - prev >= 1.5 * greatest(y1 - y0, 1.0), TRUE) AS whitespace_above, bare <> '' AND y0 < 0.15 * page_height AS top_of_page, bare <> '' AND regexp_matches(bare, '{_HEADING_SQL}') AS regex_match,
      bare <> '' AND ((upper(bare) = bare AND lower(bare) <> bare) OR (len(words) > 0 AND len(list_filter(words, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= 0.6 * len(words))) AS title_case_or_caps, bare <> '' AND length(bare) <= 80 AS short_line FROM w),
    f AS (SELECT *, face_delta::INT * 2 + bold_marker::INT * 2 + whitespace_above::INT + top_of_page::INT + regex_match::INT * 3 + title_case_or_caps::INT + short_line::INT AS score FROM s)"""


@query(f"WITH {_FEATURES} SELECT * FROM f")
def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.line_features(SPANS.df(spark)).select("file_path", "page", "ord", *op.WEIGHTS, "score")


@query(f"WITH {_FEATURES} SELECT f.file_path, f.page, f.ord, text, score FROM f JOIN l ON l.file_path = f.file_path AND l.page = f.page AND l.ord = f.ord WHERE score >= 4")
def heading_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.line_features(SPANS.df(spark)).filter(F.col("score") >= op.THRESHOLD).select("file_path", "page", "ord", "text", "score")


@query(f"WITH {_FEATURES} SELECT * FROM body")
def body_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.body_fingerprint(SPANS.df(spark))


TOC_A = Literal(TOC.schema, *[r for r in TOC.rows if r[0] == "a"])
_TOC_A = f"""{TOC_A.cte('toc')}, {TOTALS.cte('tot')}, spans AS (SELECT file_path, ord, title, page AS start_page,
    coalesce((SELECT arg_min(l.page, l.ord) FROM toc l WHERE l.file_path = t.file_path AND l.ord > t.ord AND l.level <= t.level) - 1, total) AS end_page FROM toc t JOIN tot USING (file_path))"""
_CLEAN = "length(bare) <= 120 AND NOT contains(regexp_replace(bare, '[.:]$', ''), '. ') AND NOT contains(regexp_replace(bare, '[.:]$', ''), '; ')"


@query(f"""WITH {_TOC_A}, {_FEATURES}, h AS (SELECT w.file_path, w.page, w.ord, w.bare FROM f JOIN w ON w.file_path = f.file_path AND w.page = f.page AND w.ord = f.ord WHERE score >= 4 AND bare <> '' AND length(bare) <= 200 AND w.file_path NOT IN (SELECT file_path FROM toc))
    SELECT file_path, ord, title, start_page, end_page, 'toc' AS title_source FROM spans UNION ALL
    SELECT file_path, row_number() OVER o - 1, CASE WHEN {_CLEAN} THEN bare END, page, coalesce(lead(page) OVER o - 1, total), CASE WHEN {_CLEAN} THEN 'heading_detected' END FROM h JOIN tot USING (file_path) WINDOW o AS (PARTITION BY file_path ORDER BY page, ord)""")
def derived_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File a by its table of contents, file b by its headings, as one table."""
    return op.derived_sections(TOC_A.df(spark), SPANS.df(spark), TOTALS.df(spark))


CANDIDATES = Literal("file_path string, page long, ord long, text string, y double", ("a", 1, 0, "1", 10), ("a", 1, 1, "Introduction", 30), ("a", 1, 2, "2.", 100), ("a", 1, 3, "3.1", 120), ("a", 1, 4, "Method", 140), ("a", 1, 5, "4", 200), ("a", 1, 6, "Too far", 300), ("a", 1, 7, "5", 700), ("a", 2, 0, "Other page", 10), ("b", 1, 0, "7", 5))
MERGED = Literal("file_path string, page long, ord long, text string", ("a", 1, 0, "1 Introduction"), ("a", 1, 2, "2. 3.1"), ("a", 1, 4, "Method"), ("a", 1, 5, "4"), ("a", 1, 6, "Too far"), ("a", 1, 7, "5"), ("a", 2, 0, "Other page"), ("b", 1, 0, "7"))


@query(f"WITH {MERGED.cte('m')} SELECT * FROM m")
def merge_split_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected rows are literal in the SQL: SQL windows would repeat this operator's own reasoning."""
    return op.merge_split_headings(CANDIDATES.df(spark)).select("file_path", "page", "ord", "text")


SHARE = 0.1
_BARE = f"{ad.LINES_SQL}, bare AS (SELECT file_path, page_id, line_no, regexp_replace(regexp_replace(line, '^\\s+', ''), '\\s+$', '') AS line FROM lines), tot AS (SELECT file_path, count(DISTINCT page_id) AS total FROM bare GROUP BY file_path), rep AS (SELECT file_path, line, count(DISTINCT page_id) AS pages FROM bare WHERE line <> '' GROUP BY ALL), boiler AS (SELECT file_path, line, pages FROM rep JOIN tot USING (file_path) WHERE pages >= {SHARE} * total)"


@query(f"WITH {_BARE} SELECT * FROM boiler")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.repeated_lines(ad.page_lines(table(spark, sf_dir, "documents")), SHARE)


@query(f"WITH {_BARE} SELECT page_id, count(*) AS kept FROM bare b WHERE NOT EXISTS (SELECT 1 FROM boiler x WHERE x.file_path = b.file_path AND x.line = b.line) GROUP BY page_id")
def strip_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ad.page_lines(table(spark, sf_dir, "documents"))
    return op.strip_lines(lines, op.repeated_lines(lines, SHARE)).groupBy("page_id").agg(F.count("*").alias("kept"))


@query(f"WITH {ad.LINES_SQL}, bare AS (SELECT DISTINCT page_id, file_path, regexp_replace(regexp_replace(line, '^\\s+', ''), '\\s+$', '') AS line FROM lines) SELECT file_path, count(*) FILTER (regexp_matches(line, '(?i)^((page\\s*)?\\d+|[ivxlc]+)$')) AS page_numbers, count(*) FILTER (len(list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')) BETWEEN 1 AND 3) AS short_lines FROM bare GROUP BY file_path")
def naive_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a filter of single lines would take: page numbers and lines of at most three words."""
    bare = ad.page_lines(table(spark, sf_dir, "documents")).select("page_id", "file_path", tx.strip(F.col("line")).alias("line")).distinct()
    words = F.size(tx.split_words(F.col("line")))
    return bare.groupBy("file_path").agg(F.count_if(F.rlike("line", F.lit(r"(?i)^((page\s*)?\d+|[ivxlc]+)$"))).alias("page_numbers"), F.count_if(words.between(1, 3)).alias("short_lines"))


_RUN_PAGES = Literal("file_path string, total long", ("h", 6), ("p", 6), ("r", 12), ("n", 5))
_RUN_ROWS = Literal(
    "file_path string, page long, text string, y0 double, y1 double",
    *[("h", p, "The Same Header", 0.05, 0.08) for p in (1, 2, 3, 5)], *[("p", p, "Odd Side", 0.05, 0.08) for p in (1, 3)], *[("r", p, "Section Header", 0.05, 0.08) for p in (4, 5, 6)],
    *[("n", p, f"Page {p}", 0.9, 0.95) for p in (1, 2, 3, 4, 5)], *[("n", p, f"body {p}", 0.4, 0.5) for p in (1, 2)], ("r", 1, "Once", 0.05, 0.08), ("h", 1, "The Same Header", 0.4, 0.5),
)


@query(f"""WITH {_RUN_ROWS.cte('b')}, {_RUN_PAGES.cte('t')}, s AS (SELECT DISTINCT file_path, page, array_to_string(list_filter(string_split_regex(lower(regexp_replace(text, '[0-9]+', '#', 'g')), '\\s+'), lambda x: x <> ''), ' ') AS sig, CASE WHEN y0 < 0.15 THEN 'top' WHEN y1 > 0.85 THEN 'bot' END AS band FROM b),
    i AS (SELECT *, page - row_number() OVER (PARTITION BY file_path, sig, band ORDER BY page) AS island FROM s WHERE band IS NOT NULL), r AS (SELECT file_path, sig, band, island, count(*) AS n, count(*) FILTER (page % 2 = 1) AS odd FROM i GROUP BY ALL),
    w AS (SELECT file_path, sig, band, sum(n) AS n, sum(odd) AS odd, max(n) AS run FROM r GROUP BY ALL),
    j AS (SELECT file_path, sig, band, n >= 0.6 * total AS by_share, odd >= 0.6 * ceil(total / 2) OR (total >= 2 AND n - odd >= 0.6 * floor(total / 2)) AS by_parity, run >= 3 AS by_run FROM w JOIN t USING (file_path)) SELECT * FROM j WHERE by_share OR by_parity OR by_run""")
def boilerplate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("y0") < 0.15, "top").when(F.col("y1") > 0.85, "bot")
    signed = _RUN_ROWS.df(spark).select("file_path", "page", tx.signature(F.col("text")).alias("sig"), band.alias("band")).filter("band is not null")
    return op.boilerplate_runs(signed, _RUN_PAGES.df(spark))


@query(f"""WITH {ad.LINES_SQL}, s AS (SELECT DISTINCT file_path, page_id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(line, '[0-9]+', '#', 'g')), '\\s+'), lambda x: x <> ''), ' ') AS sig FROM lines),
    c AS (SELECT file_path, sig, count(*) AS pages FROM s WHERE sig <> '' GROUP BY ALL), t AS (SELECT source AS file_path, count(*) AS total FROM documents GROUP BY source)
    SELECT file_path, count(*) FILTER (pages >= 0.3 * total) AS covered, count(*) FILTER (pages >= 2 AND pages < 0.25 * total) AS suspects, max(pages) AS most FROM c JOIN t USING (file_path) GROUP BY file_path""")
def boilerplate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without labels: how many line signatures cover how much of a file."""
    docs = table(spark, sf_dir, "documents")
    signed = ad.page_lines(docs).select("file_path", "page_id", tx.signature(F.col("line")).alias("sig")).filter("sig <> ''").distinct()
    counts = signed.groupBy("file_path", "sig").agg(F.count("*").alias("pages"))
    totals = docs.groupBy(F.col("source").alias("file_path")).agg(F.count("*").alias("total"))
    n, share = F.col("pages"), F.col("total")
    return counts.join(totals, "file_path").groupBy("file_path").agg(F.count_if(n >= 0.3 * share).alias("covered"), F.count_if((n >= 2) & (n < 0.25 * share)).alias("suspects"), F.max("pages").alias("most"))


_NUMBERED = "regexp_matches(line, '(?i)^\\s*(page\\s+)?\\d+(\\s*(of|/)\\s*\\d+)?\\s*$')"
_PAGED = f"""{ad.LINES_SQL}, paged AS (SELECT file_path, page_id, line_no, line FROM lines UNION ALL SELECT DISTINCT file_path, page_id, 1000000, CASE WHEN page_id % 3 = 0 THEN 'Page ' || page_id || ' of 99' WHEN page_id % 3 = 1 THEN page_id || '' ELSE 'no number' END FROM lines),
    bare AS (SELECT DISTINCT file_path, page_id, regexp_replace(regexp_replace(line, '^\\s+', ''), '\\s+$', '') AS line FROM paged), held AS (SELECT *, {_NUMBERED} AS numbers FROM bare WHERE line <> ''), tot AS (SELECT file_path, count(DISTINCT page_id) AS total FROM bare GROUP BY file_path),
    often AS (SELECT file_path, line FROM held JOIN tot USING (file_path) WHERE NOT numbers GROUP BY file_path, line HAVING count(*) >= 0.5 * any_value(total)), fam AS (SELECT file_path FROM held JOIN tot USING (file_path) WHERE numbers GROUP BY file_path HAVING count(DISTINCT page_id) >= 0.5 * any_value(total)),
    boiler AS (SELECT * FROM often UNION SELECT file_path, line FROM held WHERE numbers AND file_path IN (SELECT file_path FROM fam))"""


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines with a last line more: a page number, in one of two forms, on two pages of three."""
    lines = ad.page_lines(table(spark, sf_dir, "documents")).withColumn("line_no", F.col("line_no").cast("long"))
    page = F.col("page_id").cast("string")
    number = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Page "), page, F.lit(" of 99"))).when(F.col("page_id") % 3 == 1, page).otherwise("no number")
    footers = table(spark, sf_dir, "documents").select(F.col("source").alias("file_path"), F.col("doc_id").alias("page_id")).distinct()
    return lines.unionByName(footers.select("file_path", "page_id", F.lit(1000000).cast("long").alias("line_no"), number.alias("line")))


@query(f"WITH {_PAGED} SELECT * FROM boiler")
def boilerplate_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on half of a file's pages, and its page numbers in all their forms."""
    return op.boilerplate(_paged(spark, sf_dir))


@query(f"""WITH {_PAGED}, kept AS (SELECT * FROM paged p WHERE NOT EXISTS (SELECT 1 FROM boiler x WHERE x.file_path = p.file_path AND x.line = regexp_replace(regexp_replace(p.line, '^\\s+', ''), '\\s+$', '')))
    SELECT d.doc_id AS page_id, md5(coalesce(string_agg(line, chr(10) ORDER BY line_no), '')) AS digest FROM documents d LEFT JOIN kept ON kept.page_id = d.doc_id GROUP BY d.doc_id""")
def stripped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text without its file's boilerplate, joined again."""
    lines = _paged(spark, sf_dir)
    return op.stripped_texts(lines, op.boilerplate(lines)).select("page_id", F.md5("text").alias("digest"))
