"""Search queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import search as op
from ..sources import adapters as ad
from .registry import Literal, query, table

QUERY = "estion thintion"
PROBE = 7

_TOKENS = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s\-]', ' ', 'g'), '\s+'), lambda x: x <> '')"


def _bm25_sql(source: str, key: str, extra: str = "") -> str:
    """CTEs ending in bm25(key, extra, score) over source(key, text) for QUERY."""
    words = QUERY.split()
    tf = ", ".join(f"len(list_filter(toks, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(words)))
    return f"""toks AS (SELECT {key}{extra}, {_TOKENS.format("text")} AS toks FROM {source}),
        counted AS (SELECT {key}{extra}, len(toks) AS dl, {tf} FROM toks WHERE len(toks) > 0),
        stats AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM counted),
        bm25 AS (SELECT {key}{extra}, {score} AS score FROM counted, stats)"""


def _keyword(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return op.top(op.bm25(table(spark, sf_dir, "documents"), QUERY, key="doc_id"), k, "doc_id")


@query(f"""WITH {ad.PAGES_SQL}, {_bm25_sql("documents", "doc_id")}
    SELECT file_path, page_num, round(score, 4) AS score FROM bm25 JOIN pages ON page_id = doc_id WHERE score > 0 ORDER BY round(bm25.score, 9) DESC, doc_id LIMIT 10""")
def keyword_bm25_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ad.numbers_of(table(spark, sf_dir, "documents"), _keyword(spark, sf_dir, 10), "doc_id")
    return placed.select("file_path", "page_num", F.round("score", 4).alias("score"))


_DOT = f"list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {PROBE}))"


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return op.semantic(vectors, vectors.filter(F.col("vec_id") == PROBE))


@query(f"SELECT vec_id AS page_id, round({_DOT}, 4) AS score, round({_DOT}, 4) < 0.5 AS low_confidence FROM embeddings ORDER BY round({_DOT}, 9) DESC, vec_id LIMIT 10")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = op.top(_semantic(spark, sf_dir), 10, "vec_id")
    return hits.select(F.col("vec_id").alias("page_id"), F.round("score", 4).alias("score"), (F.round("score", 4) < 0.5).alias("low_confidence"))


_ARMS = f"""{_bm25_sql("documents", "doc_id")},
    kw AS (SELECT doc_id AS page, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25 WHERE score > 0 QUALIFY rank <= 30),
    sem AS (SELECT vec_id AS page, {_DOT} AS score, row_number() OVER (ORDER BY round({_DOT}, 9) DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 30)"""


def _arms(spark: SparkSession, sf_dir: str, width: int = op.candidate_width(10)) -> DataFrame:
    """(arm, page, score, rank) of both arms, each cut to its candidates."""
    kw = op.ranked(_keyword(spark, sf_dir, width), "doc_id").select(F.lit("keyword").alias("arm"), F.col("doc_id").alias("page"), "score", "rank")
    sem = op.ranked(op.top(_semantic(spark, sf_dir), width, "vec_id"), "vec_id").select(F.lit("semantic").alias("arm"), F.col("vec_id").alias("page"), "score", "rank")
    return kw.unionAll(sem)


@query(f"""WITH {_ARMS}
    SELECT coalesce(kw.page, sem.page) AS page_id, round(coalesce(1.0 / (60 + kw.rank), 0) + coalesce(1.0 / (60 + sem.rank), 0), 4) AS rrf, round(sem.score, 4) AS semantic_score,
      kw.page IS NOT NULL AS keyword_hit, kw.page IS NULL AND coalesce(sem.score, 0) < 0.5 AS low_confidence
    FROM kw FULL JOIN sem ON kw.page = sem.page ORDER BY round(coalesce(1.0 / (60 + kw.rank), 0) + coalesce(1.0 / (60 + sem.rank), 0), 9) DESC, 1 LIMIT 10""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = _arms(spark, sf_dir)
    fused = arms.groupBy("page").agg(F.sum(1.0 / (op.RRF_K + F.col("rank"))).alias("rrf"), F.max(F.when(F.col("arm") == "semantic", F.col("score"))).alias("sem"), F.bool_or(F.col("arm") == "keyword").alias("hit"))
    best = op.top(fused, 10, "page", "rrf")
    return best.select(F.col("page").alias("page_id"), F.round("rrf", 4).alias("rrf"), F.round("sem", 4).alias("semantic_score"), F.col("hit").alias("keyword_hit"), (~F.col("hit") & (F.coalesce("sem", F.lit(0.0)) < 0.5)).alias("low_confidence"))


@query(f"SELECT count(*) AS hits, count(*) FILTER (low) AS low_hits, count(*) > 0 AND bool_and(low) AS all_low FROM (SELECT round({_DOT}, 4) < 0.5 AS low FROM embeddings ORDER BY round({_DOT}, 9) DESC, vec_id LIMIT 10)")
def low_confidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = op.top(_semantic(spark, sf_dir), 10, "vec_id").select((F.round("score", 4) < 0.5).alias("low"))
    return hits.agg(F.count("*").alias("hits"), F.count_if("low").alias("low_hits"), F.coalesce(F.bool_and("low"), F.lit(False)).alias("all_low"))


LISTS = Literal("q string, arm string, rank long, page long", ("a", "kw", 1, 4), ("a", "kw", 2, 9), ("a", "sem", 1, 9), ("a", "sem", 2, 4), ("a", "sem", 3, 2), ("b", "kw", 1, 5), ("b", "sem", 1, 3), ("c", "sem", 1, 8), ("c", "sem", 2, 1))


@query(f"WITH {LISTS.cte('l')}, f AS (SELECT q, page, sum(1.0 / (60 + rank)) AS rrf FROM l GROUP BY ALL) SELECT q, page, round(rrf, 4) AS rrf, row_number() OVER (PARTITION BY q ORDER BY round(rrf, 9) DESC, page) AS place FROM f")
def rrf_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = op.fuse(LISTS.df(spark), by=["q"])
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.round("rrf", 9).desc(), "page"))
    return fused.select("q", "page", F.round("rrf", 4).alias("rrf"), place.cast("long").alias("place"))


@query(r"""WITH s AS (SELECT doc_id, text, lower(text) AS low, length(text) AS n, instr(lower(text), 'estion') - 1 AS pos FROM documents WHERE contains(lower(text), 'estion') AND contains(lower(text), 'thintion')),
    c AS (SELECT *, greatest(pos - 100, 0) AS a0, least(pos + 6 + 100, n) AS b0 FROM s),
    d AS (SELECT *, greatest(a0 - 50, 0) AS f, substr(text, greatest(a0 - 50, 0) + 1, a0 - greatest(a0 - 50, 0)) AS l, instr(substr(text, b0 + 1, 50), ' ') AS r FROM c),
    e AS (SELECT *, CASE WHEN a0 > 0 AND contains(l, ' ') AND f + length(l) - instr(reverse(l), ' ') > 0 THEN f + length(l) - instr(reverse(l), ' ') + 1 ELSE a0 END AS a, CASE WHEN b0 < n AND r > 0 THEN b0 + r - 1 ELSE b0 END AS b FROM d)
    SELECT doc_id AS page_id, pos AS position, 0.0::DOUBLE AS score, regexp_replace(regexp_replace(CASE WHEN a > 0 THEN '...' ELSE '' END || substr(text, a + 1, b - a) || CASE WHEN b < n THEN '...' ELSE '' END, '^\s+', ''), '\s+$', '') AS excerpt FROM e ORDER BY 1 LIMIT 20""")
def token_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = docs.filter(tx.contains_all(F.col("text"), QUERY.split())).orderBy("doc_id").limit(20)
    at = F.instr(F.lower("text"), F.lit("estion")) - 1
    return hits.select(F.col("doc_id").alias("page_id"), at.cast("long").alias("position"), F.lit(0.0).alias("score"), tx.search_excerpt(F.col("text"), "estion", 200).alias("excerpt"))


@query("SELECT doc_id AS page_id, len(string_split(lower(text), 'estion')) - 1 + len(string_split(lower(text), 'thintion')) - 1 AS occurrences FROM documents WHERE len(string_split(lower(text), 'estion')) - 1 + len(string_split(lower(text), 'thintion')) - 1 > 0")
def page_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    counted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), (tx.count_substring(low, "estion") + tx.count_substring(low, "thintion")).cast("long").alias("occurrences"))
    return counted.filter("occurrences > 0")


@query(f"""WITH {ad.SECTIONS_SQL}, titled AS (SELECT section_key, file_path, title, title || chr(10) || text AS text FROM sections), {_bm25_sql("titled", "section_key", ", file_path, title")}
    SELECT section_key, file_path, title, round(score, 4) AS score FROM bm25 WHERE score > 0 ORDER BY round(bm25.score, 9) DESC, section_key LIMIT 10""")
def section_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = ad.html_sections(table(spark, sf_dir, "pages"))
    hits = op.top(op.bm25(sections.withColumn("text", F.concat_ws("\n", "title", "text")), QUERY, key="section_key"), 10, "section_key")
    return sections.drop("text").join(F.broadcast(hits), "section_key").select("section_key", "file_path", "title", F.round("score", 4).alias("score"))


@query(f"""WITH {ad.SECTIONS_SQL}, {_bm25_sql("sections", "section_key")},
    kw AS (SELECT section_key AS s, row_number() OVER (ORDER BY round(score, 9) DESC, section_key) AS rank FROM bm25 WHERE score > 0 QUALIFY rank <= 20),
    sem AS (SELECT vec_id AS s, row_number() OVER (ORDER BY round({_DOT}, 9) DESC, vec_id) AS rank FROM embeddings WHERE vec_id IN (SELECT section_key FROM sections) QUALIFY rank <= 20)
    SELECT coalesce(kw.s, sem.s) AS section_key, round(coalesce(1.0 / (60 + kw.rank), 0) + coalesce(1.0 / (60 + sem.rank), 0), 4) AS rrf FROM kw FULL JOIN sem ON kw.s = sem.s
    ORDER BY round(coalesce(1.0 / (60 + kw.rank), 0) + coalesce(1.0 / (60 + sem.rank), 0), 9) DESC, 1 LIMIT 10""")
def hybrid_section_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = ad.html_sections(table(spark, sf_dir, "pages"))
    kw = op.ranked(op.top(op.bm25(sections, QUERY, key="section_key"), 20, "section_key"), "section_key").select(F.col("section_key").alias("page"), "rank")
    vectors = table(spark, sf_dir, "embeddings")
    own = vectors.join(table(spark, sf_dir, "pages").select("page_id"), F.col("vec_id") == F.col("page_id"), "left_semi")
    sem = op.ranked(op.top(op.semantic(own, vectors.filter(F.col("vec_id") == PROBE)), 20, "vec_id"), "vec_id").select(F.col("vec_id").alias("page"), "rank")
    return op.top(op.fuse(kw.unionAll(sem)), 10, "page", "rrf").select(F.col("page").alias("section_key"), F.round("rrf", 4).alias("rrf"))


CJK_TEXT = Literal("id long, body string", (0, "機械学習は機械の学習です"), (1, "the 機械 of learning 学習"), (2, "no ideographs here"), (3, "データ分析と機械学習の基礎 part 2"), (4, "학습 데이터"), (5, ""))
_CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
_CJK_SPLIT = f"array_to_string(list_filter(string_split_regex(regexp_replace(body, '({_CJK})', ' \\1 ', 'g'), '\\s+'), lambda x: x <> ''), ' ')"


@query(f"WITH {CJK_TEXT.cte('t')} SELECT id, {_CJK_SPLIT} AS split, regexp_matches(body, '{_CJK}') AS has_cjk FROM t")
def cjk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CJK_TEXT.df(spark).select("id", tx.cjk_split(F.col("body")).alias("split"), tx.has_cjk(F.col("body")).alias("has_cjk"))


@query(f"WITH {CJK_TEXT.cte('t')}, s AS (SELECT id, body, {_CJK_SPLIT} AS split FROM t) SELECT id, split FROM s WHERE contains(' ' || split || ' ', ' 機 械 学 習 ') AND contains(body, '機械学習')")
def cjk_phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = CJK_TEXT.df(spark).select("id", "body", tx.cjk_split(F.col("body")).alias("split"))
    hits = split.filter(F.contains(F.concat(F.lit(" "), F.col("split"), F.lit(" ")), F.lit(" 機 械 学 習 ")))
    return hits.filter(F.contains("body", F.lit("機械学習"))).select("id", "split")  # the phrase must be contiguous in the text itself


@query(f"""WITH {CJK_TEXT.cte('t')}, a AS (SELECT id, body, instr(body, '機械学習') - 1 AS pos, length(body) AS n FROM t), b AS (SELECT *, greatest(pos - 3, 0) AS x, least(pos + 4 + 3, n) AS y FROM a WHERE pos >= 0)
    SELECT id, CASE WHEN x > 0 THEN '...' ELSE '' END || substr(body, x + 1, y - x) || CASE WHEN y < n THEN '...' ELSE '' END AS excerpt FROM b""")
def cjk_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CJK_TEXT.df(spark).select("id", tx.cjk_excerpt(F.col("body"), F.lit("機械学習"), 10).alias("excerpt")).filter("excerpt is not null")


ASKED = Literal("id long, q string", (0, "graph attention"), (1, 'say "hello" (now)*'), (2, '"" ()'), (3, "col:value ^boost"), (4, "  spaced   out "), (5, "機械 learning"))


@query(f"""WITH {ASKED.cte('t')}, w AS (SELECT id, list_filter(list_transform(string_split_regex(q, '\\s+'), lambda x: regexp_replace(x, '["()*:^]', '', 'g')), lambda x: x <> '') AS w FROM t)
    SELECT id, CASE WHEN len(w) = 0 THEN '"__nothing_matches__"' ELSE array_to_string(list_transform(w, lambda x: '"' || x || '"'), ' ') END AS match FROM w""")
def query_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ASKED.df(spark).select("id", tx.escape_query(F.col("q")).alias("match"))


_CJK_WORD = f"trim(regexp_replace(array_to_string(list_filter(string_split_regex(regexp_replace(w, '({_CJK})', ' \\1 ', 'g'), '\\s+'), lambda x: x <> ''), ' '), '[\"()*:^]', '', 'g'))"


@query(f"""WITH {ASKED.cte('t')}, u AS (SELECT id, unnest(range(len(string_split_regex(q, '\\s+')))) AS n, unnest(string_split_regex(q, '\\s+')) AS w FROM t), p AS (SELECT id, n, {_CJK_WORD} AS w FROM u)
    SELECT t.id, coalesce(string_agg('"' || p.w || '"', ' ' ORDER BY n), '"__nothing_matches__"') AS match FROM t LEFT JOIN p ON p.id = t.id AND p.w <> '' GROUP BY t.id""")
def query_escape_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ASKED.df(spark).select("id", tx.escape_query_cjk(F.col("q")).alias("match"))


STEMMED = "Onth ande"


@query()
def porter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text search on Porter stems: every word must occur; the stemmer has no SQL form, the tests hold it to SQLite's index."""
    hits = op.top(op.full_text(table(spark, sf_dir, "documents"), STEMMED, key="doc_id"), 10, "doc_id")
    return hits.select(F.col("doc_id").alias("page_id"), F.round("score", 4).alias("score"))


@query()
def file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within one file: statistics of the whole table, the file's best pages with snippets."""
    docs = table(spark, sf_dir, "documents")
    hits = op.top(op.full_text(docs, STEMMED, key="doc_id", file="source", only="src3"), 5, "doc_id")
    texts = docs.select(F.col("doc_id").alias("t_id"), "text").join(F.broadcast(hits), F.col("t_id") == F.col("doc_id")).select("doc_id", "source", "score", "text")
    return op.snippets(texts, STEMMED, context_chars=100).select(F.col("doc_id").alias("page_id"), F.col("source").alias("file_path"), F.round("score", 4).alias("score"), "snippet")


@query(f"""WITH {_bm25_sql("documents", "doc_id", ", source")}
    SELECT source AS file_path, doc_id AS page_id, round(score, 4) AS score, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25 WHERE bm25.score > 0 QUALIFY rank <= 3""")
def keyword_topk_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best pages of every file, by the whole table's statistics."""
    docs = table(spark, sf_dir, "documents")
    hits = op.bm25(docs, QUERY, key="doc_id")
    placed = docs.select(F.col("doc_id").alias("d"), F.col("source").alias("file_path")).join(hits, F.col("d") == F.col("doc_id"))
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy(F.round("score", 9).desc(), "doc_id"))
    return placed.withColumn("rank", rank).filter("rank <= 3").select("file_path", F.col("doc_id").alias("page_id"), F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {ad.LINES_SQL}, s AS (SELECT *, contains(lower(line), 'estion')::INT + contains(lower(line), 'thintion')::INT AS sc FROM lines WHERE length(line) >= 1 AND regexp_matches(line, '\\S'))
    SELECT page_id, line_no AS block, sc::BIGINT AS score, CASE WHEN length(line) <= 2000 THEN line END AS paragraph FROM s WHERE sc > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY sc DESC, line_no) = 1""")
def best_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.best_paragraph(ad.page_lines(table(spark, sf_dir, "documents")), QUERY, by=["page_id"], order="line_no", text="line")
    return found.select("page_id", F.col("block").cast("long").alias("block"), F.col("score").cast("long").alias("score"), "paragraph")


HITS = Literal("page long, block long, pos long, score double, excerpt string", (1, 3, 1, 0.5, "a"), (1, 3, 2, 0.9, "b"), (2, 1, 3, 0.4, "c"), (1, 4, 4, 0.3, "d"), (2, 1, 5, 0.2, "e"))


@query(f"WITH {HITS.cte('h')} SELECT page, block, min(pos) AS pos, max(score) AS score, arg_max(excerpt, score) AS excerpt FROM h GROUP BY page, block")
def excerpt_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HITS.df(spark).groupBy("page", "block").agg(F.min("pos").alias("pos"), F.max("score").alias("score"), F.max_by("excerpt", "score").alias("excerpt"))


@query(f"""WITH {ad.LINES_SQL}, o AS (SELECT *, coalesce(sum(length(line) + 2) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lines)
    SELECT page_id, line_no AS block, start FROM o WHERE 300 >= start AND 300 < start + length(line)""")
def paragraph_for_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block at character offset 300 of the blocks joined by blank lines."""
    before = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    sized = ad.page_lines(table(spark, sf_dir, "documents")).select("page_id", "line_no", F.char_length("line").alias("n"))
    placed = sized.withColumn("start", F.coalesce(F.sum(F.col("n") + 2).over(before), F.lit(0)))
    return placed.filter("300 >= start and 300 < start + n").select("page_id", F.col("line_no").cast("long").alias("block"), F.col("start").cast("long").alias("start"))


def route(text: Column) -> Column:
    """The arm that a query goes to by its look: names and codes to keywords, the rest to vectors."""
    return F.when(F.rlike(text, F.lit(r"[A-Z0-9\-]{4,}")), "keyword").otherwise("semantic")


ROUTED = Literal("id long, q string", (0, "GPT-4"), (1, "how does attention work"), (2, "RFC2119 terms"), (3, "ABC"), (4, "the X-12 model"))


@query(f"WITH {ROUTED.cte('t')} SELECT id, CASE WHEN regexp_matches(q, '[A-Z0-9\\-]{{4,}}') THEN 'keyword' ELSE 'semantic' END AS route FROM t")
def route_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ROUTED.df(spark).select("id", route(F.col("q")).alias("route"))


_BLOCK_SCORE = "(contains(lower(line), 'estion')::INT + contains(lower(line), 'thintion')::INT)"


@query(f"""WITH {ad.LINES_SQL}, {_bm25_sql("documents", "doc_id")}, m AS (SELECT page_id, score, trim(substr(text, greatest(instr(lower(text), 'estion') - 10, 1), 40), E' \t\n\r\f\x0b') AS fragment FROM (SELECT doc_id AS page_id, bm25.score, text FROM bm25 JOIN documents USING (doc_id) WHERE bm25.score > 0 ORDER BY round(bm25.score, 9) DESC, doc_id LIMIT 20)),
    l AS (SELECT page_id, line_no AS block, line, regexp_replace(regexp_replace(line, '^\\s+', ''), '\\s+$', '') AS bare, {_BLOCK_SCORE} AS hits FROM lines WHERE page_id IN (SELECT page_id FROM m)),
    own AS (SELECT page_id, arg_min(block, block) AS block, arg_min(bare, block) AS bare FROM (SELECT m.page_id, l.block, l.bare FROM m JOIN l ON l.page_id = m.page_id AND contains(l.line, m.fragment) WHERE m.fragment <> '') GROUP BY page_id),
    most AS (SELECT page_id, block, line, bare FROM l WHERE hits > 0 AND length(bare) >= 1 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY hits DESC, block) = 1),
    long AS (SELECT page_id, block, line, bare FROM l WHERE hits > 0 AND length(bare) >= 80 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY hits DESC, block) = 1),
    c AS (SELECT m.page_id, round(m.score, 4) AS score, fragment, CASE WHEN length(own.bare) <= 2000 THEN own.block WHEN length(most.line) <= 2000 THEN most.block END AS b1, CASE WHEN length(own.bare) <= 2000 THEN own.bare WHEN length(most.line) <= 2000 THEN most.bare END AS t1,
      CASE WHEN length(long.line) <= 2000 THEN long.block END AS b2, CASE WHEN length(long.line) <= 2000 THEN long.bare END AS t2 FROM m LEFT JOIN own ON own.page_id = m.page_id LEFT JOIN most ON most.page_id = m.page_id LEFT JOIN long ON long.page_id = m.page_id)
    SELECT page_id, CAST(CASE WHEN length(t1) < 80 AND b2 IS NOT NULL THEN b2 ELSE b1 END AS BIGINT) AS block, score, md5(coalesce(CASE WHEN length(t1) < 80 AND b2 IS NOT NULL THEN t2 ELSE t1 END, '...' || fragment || '...')) AS digest FROM c""")
def excerpt_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 pages' excerpts, 40 characters around the first hit, replaced by the blocks they stand in."""
    docs = table(spark, sf_dir, "documents")
    hits = _keyword(spark, sf_dir, 20)
    at = F.greatest(F.instr(F.lower("text"), F.lit("estion")) - 10, F.lit(1))
    texts = docs.select(F.col("doc_id").alias("page"), "text").join(F.broadcast(hits), F.col("page") == F.col("doc_id"))
    matches = texts.select("page", "score", F.concat(F.lit("..."), tx.strip(F.substring(F.col("text"), at, F.lit(40))), F.lit("...")).alias("excerpt"))
    blocks = ad.page_lines(docs).select(F.col("page_id").alias("page"), F.col("line_no").cast("long").alias("block"), F.col("line").alias("text"))
    found = op.upgraded_excerpts(matches, blocks, QUERY)
    return found.select(F.col("page").alias("page_id"), "block", F.round("score", 4).alias("score"), F.md5("excerpt").alias("digest"))


CJK_SECTIONS = Literal("file_path string, section_id long, title string, body string", ("a", 0, "機械学習 入門", "基礎の説明"), ("a", 1, "応用", "機械学習の応用例"), ("b", 0, None, "機械学習だけ"), ("b", 1, "別の話", "関係ない"))


@query(f"WITH {CJK_SECTIONS.cte('t')} SELECT file_path, section_id, title FROM t WHERE contains(coalesce(title || ' ', '') || body, '機械学習')")
def cjk_section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections found in an index of split characters, shown with the titles that they have."""
    sections = CJK_SECTIONS.df(spark)
    index = sections.select("file_path", "section_id", tx.cjk_split(F.coalesce("title", F.lit(""))).alias("title"), tx.cjk_split(F.concat_ws(" ", "title", "body")).alias("split"))
    hits = index.filter(F.contains(F.concat(F.lit(" "), F.col("split"), F.lit(" ")), F.lit(" 機 械 学 習 "))).select("file_path", "section_id", F.when(F.col("title") != "", F.col("title")).alias("title"))
    return op.titled_hits(hits, sections)


@query(f"""WITH {_ARMS}, f AS (SELECT coalesce(kw.page, sem.page) AS page, coalesce(1.0 / (60 + kw.rank), 0) + coalesce(1.0 / (60 + sem.rank), 0) AS score FROM kw FULL JOIN sem ON kw.page = sem.page ORDER BY round(coalesce(1.0 / (60 + kw.rank), 0) + coalesce(1.0 / (60 + sem.rank), 0), 9) DESC, 1 LIMIT 10), t AS (SELECT page, score FROM kw ORDER BY rank LIMIT 10)
    SELECT 'all' AS given, page AS page_id, round(score, 4) AS score, 'hybrid' AS search_mode, NULL AS reason FROM f UNION ALL SELECT 'no model', page, round(score, 4), 'keyword', 'no embedding model' FROM t
    UNION ALL SELECT 'no vectors', page, round(score, 4), 'keyword', 'no page has a vector' FROM t UNION ALL SELECT 'no probe', page, round(score, 4), 'keyword', 'the query has no vector' FROM t""")
def search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search with all it needs, and without a model, without vectors, without a vector for the query."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    probe = vectors.filter(F.col("vec_id") == PROBE)
    cases = {"all": (vectors, probe), "no model": (None, None), "no vectors": (vectors.limit(0), probe), "no probe": (vectors, probe.limit(0))}
    whole = None
    for name, given in cases.items():
        found = op.auto_search(docs, QUERY, *given).select(F.lit(name).alias("given"), F.col("doc_id").alias("page_id"), F.round("score", 4).alias("score"), "search_mode", "reason")
        whole = found if whole is None else whole.unionAll(found)
    return whole


_LONGER = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 3))"


@query(f"""WITH v AS (SELECT vec_id, {_LONGER} AS e FROM embeddings), s AS (SELECT v.vec_id, list_dot_product(v.e, p.e) / sqrt(list_dot_product(v.e, v.e) * list_dot_product(p.e, p.e)) AS score FROM v, (SELECT e FROM v WHERE vec_id = {PROBE}) p ORDER BY round(score, 9) DESC, vec_id LIMIT 10)
    SELECT vec_id AS page_id, round(score, 4) AS score, substr(text, 1, 200) AS excerpt FROM s LEFT JOIN documents ON doc_id = vec_id""")
def semantic_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of any length, brought to length 1; a hit's excerpt is the start of its page."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)).alias("embedding"))
    hits = op.top(op.semantic(vectors, vectors.filter(F.col("vec_id") == PROBE), normalise=True), 10, "vec_id")
    starts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.substring("text", 1, 200).alias("excerpt"))
    return F.broadcast(hits).join(starts, F.col("vec_id") == F.col("d"), "left").select(F.col("vec_id").alias("page_id"), F.round("score", 4).alias("score"), "excerpt")


@query(f"""WITH {_ARMS}, f AS (SELECT coalesce(kw.page, sem.page) AS page, kw.page IS NOT NULL AS hit, coalesce(1.0 / (60 + kw.rank), 0) + coalesce(1.0 / (60 + sem.rank), 0) AS rrf FROM kw FULL JOIN sem ON kw.page = sem.page ORDER BY round(rrf, 9) DESC, 1 LIMIT 10)
    SELECT page AS page_id, round(rrf, 4) AS rrf, CASE WHEN hit THEN substr(text, greatest(least(CASE WHEN instr(lower(text), 'estion') > 0 THEN instr(lower(text), 'estion') ELSE 100000 END, CASE WHEN instr(lower(text), 'thintion') > 0 THEN instr(lower(text), 'thintion') ELSE 100000 END) - 20, 1), 60) ELSE substr(text, 1, 60) END AS excerpt FROM f LEFT JOIN documents ON doc_id = page""")
def hybrid_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits: the text around the first query word where keywords found the page, else its start."""
    arms = _arms(spark, sf_dir)
    fused = arms.groupBy("page").agg(F.sum(1.0 / (op.RRF_K + F.col("rank"))).alias("rrf"), F.bool_or(F.col("arm") == "keyword").alias("hit"))
    best = op.top(fused, 10, "page", "rrf")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "text")
    low = F.lower("text")
    first = F.least(*[F.when(F.instr(low, F.lit(w)) > 0, F.instr(low, F.lit(w))).otherwise(100000) for w in QUERY.split()])
    around = F.substring(F.col("text"), F.greatest(first - 20, F.lit(1)), F.lit(60))
    joined = F.broadcast(best).join(texts, F.col("page") == F.col("d"), "left")
    return joined.select(F.col("page").alias("page_id"), F.round("rrf", 4).alias("rrf"), F.when(F.col("hit"), around).otherwise(F.substring("text", 1, 60)).alias("excerpt"))
