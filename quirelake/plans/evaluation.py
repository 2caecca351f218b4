"""Evaluation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import evaluation as op
from ..operators import search as se
from ..sources import adapters as ad
from ..storage import kept
from . import search as searches
from .registry import Literal, query, table

_GRADES = "g AS (SELECT query, doc_id AS page, CAST(quality AS BIGINT) AS grade FROM labels, (SELECT DISTINCT query FROM h) q)"
_LISTS = f"{searches._ARMS}, h AS (SELECT 'keyword' AS query, rank, page FROM kw UNION ALL SELECT 'semantic', rank, page FROM sem), {_GRADES}"
_METRICS = """
    got AS (SELECT query, sum(coalesce(grade, 0) / log2(rank + 1)) AS dcg, min(rank) FILTER (grade > 0) AS first_hit, count(*) FILTER (grade > 0) AS found FROM h LEFT JOIN g USING (query, page) WHERE rank <= {k} GROUP BY query),
    ideal AS (SELECT query, coalesce(sum(grade / log2(r + 1)) FILTER (r <= {k}), 0) AS idcg, count(*) FILTER (grade > 0) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC) AS r FROM g) GROUP BY query)"""
_RATED = "round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 4) AS ndcg, round(coalesce(1.0 / first_hit, 0), 4) AS mrr, round(CASE WHEN relevant > 0 THEN found / relevant ELSE 0 END, 4) AS recall"


def _hits_and_grades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hits = searches._arms(spark, sf_dir).select(F.col("arm").alias("query"), F.col("rank").cast("long").alias("rank"), "page")
    labels = table(spark, sf_dir, "labels").select(F.explode(F.array(F.lit("keyword"), F.lit("semantic"))).alias("query"), F.col("doc_id").alias("page"), F.col("quality").cast("long").alias("grade"))
    return hits, labels


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


@query(f"WITH {_LISTS}, {_METRICS.format(k=10)} SELECT query, {_RATED}, first_hit FROM got JOIN ideal USING (query)")
def ndcg_mrr_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, grades = _hits_and_grades(spark, sf_dir)
    return _rounded(op.retrieval_metrics(hits, grades, 10), "ndcg", "mrr", "recall")


KS = (10, 30, 60, 120)
_WIDE = searches._ARMS.replace("rank <= 30", f"rank <= {max(KS)}")
_FUSED = "fused AS (SELECT coalesce(kw.page, sem.page) AS page, row_number() OVER (ORDER BY round(coalesce(1.0 / (60 + kw.rank), 0) + coalesce(1.0 / (60 + sem.rank), 0), 9) DESC, coalesce(kw.page, sem.page)) AS rank FROM kw FULL JOIN sem ON kw.page = sem.page)"


@query(f"""WITH {_WIDE}, {_FUSED}, h AS (SELECT 'keyword' AS query, rank, page FROM kw UNION ALL SELECT 'semantic', rank, page FROM sem UNION ALL SELECT 'hybrid', rank, page FROM fused WHERE rank <= {max(KS)} UNION ALL SELECT 'router', rank, page FROM sem),
    {_GRADES}, r AS (SELECT count(*) AS relevant FROM labels WHERE quality > 0), ks AS (SELECT unnest({list(KS)}) AS k), m AS (SELECT query, k, rank, coalesce(grade, 0) > 0 AS good FROM h JOIN ks ON rank <= k LEFT JOIN g USING (query, page))
    SELECT query, CAST(k AS BIGINT) AS k, count(*) FILTER (good) AS found, round(count(*) FILTER (good) / any_value(relevant), 4) AS recall, round(coalesce(max(1.0 / rank) FILTER (good), 0), 4) AS mrr FROM m, r GROUP BY query, k""")
def k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arms at four cut-offs: keyword, semantic, both fused, and the arm that the router picks (here semantic)."""
    arms = searches._arms(spark, sf_dir, max(KS)).select(F.col("arm").alias("query"), F.col("rank").cast("long").alias("rank"), "page")
    fused = se.ranked(se.top(se.fuse(arms), max(KS), "page", "rrf"), "page", "rrf").select(F.lit("hybrid").alias("query"), F.col("rank").cast("long").alias("rank"), "page")
    routed = arms.filter(F.col("query") == searches.route(F.lit(searches.QUERY))).withColumn("query", F.lit("router"))
    good = table(spark, sf_dir, "labels").filter("quality > 0").select(F.col("doc_id").alias("page"), F.lit(True).alias("good"))
    hits = arms.unionByName(fused).unionByName(routed).join(good, "page", "left").withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in KS]))).filter("rank <= k")
    found = hits.groupBy("query", "k").agg(F.count_if("good").alias("found"), F.round(F.coalesce(F.max(F.when(F.col("good"), 1.0 / F.col("rank"))), F.lit(0.0)), 4).alias("mrr"))
    relevant = good.agg(F.count("*").alias("relevant"))
    return found.join(F.broadcast(relevant), how="cross").select("query", "k", "found", F.round(op.ratio(F.col("found"), F.col("relevant")), 4).alias("recall"), "mrr")


_NGRAMS = "CASE WHEN len({t}) >= 5 THEN list_distinct(list_transform(range(1, len({t}) - 3), lambda i: array_to_string(list_slice({t}, i, i + 4), ' '))) ELSE [] END"
_PAIRS = f"pairs AS (SELECT doc_id, item_id, {searches._TOKENS.format('d.text')} AS dt, {searches._TOKENS.format('b.text')} AS bt FROM documents d CROSS JOIN (SELECT count(DISTINCT item_id) AS n FROM benchmark) c JOIN (SELECT *, dense_rank() OVER (ORDER BY item_id) AS place FROM benchmark WHERE item_id IS NOT NULL) b ON doc_id % n = place - 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one benchmark item, all items in turn: a fixed pairing to measure, not a search.

    The item's place in order of its id is the document's id modulo the table's own number of items.
    """
    items = table(spark, sf_dir, "benchmark").select("item_id", tx.word_tokens(F.col("text")).alias("bt"))
    places = table(spark, sf_dir, "benchmark").filter("item_id IS NOT NULL").select(F.col("item_id").alias("p_id")).distinct()
    places = places.select("p_id", F.row_number().over(Window.orderBy("p_id")).alias("place"))
    placed = items.join(places, F.col("item_id") == F.col("p_id")).drop("p_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.word_tokens(F.col("text")).alias("dt"))
    n = F.broadcast(places.agg(F.count("*").alias("n")))
    return docs.join(n, F.col("n") > 0).join(placed, F.pmod("doc_id", "n") == F.col("place") - 1).select("doc_id", "item_id", "dt", "bt")


@query(f"""WITH {_PAIRS}, n AS (SELECT doc_id, item_id, {_NGRAMS.format(t='dt')} AS dn, {_NGRAMS.format(t='bt')} AS bn FROM pairs)
    SELECT doc_id, item_id, CAST(len(list_intersect(dn, bn)) AS BIGINT) AS shared, round(CASE WHEN len(bn) > 0 THEN len(list_intersect(dn, bn)) / len(bn) ELSE 0 END, 4) AS recall, round(CASE WHEN len(dn) > 0 THEN len(list_intersect(dn, bn)) / len(dn) ELSE 0 END, 4) AS precision FROM n""")
def ngram_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = _pairs(spark, sf_dir).select("doc_id", "item_id", tx.ngram_hashes(F.col("dt"), 5).alias("dn"), tx.ngram_hashes(F.col("bt"), 5).alias("bn"))
    shared = F.size(F.array_intersect("dn", "bn"))
    return grams.select("doc_id", "item_id", shared.cast("long").alias("shared"), F.round(op.ratio(shared, F.size("bn")), 4).alias("recall"), F.round(op.ratio(shared, F.size("dn")), 4).alias("precision"))


@query(f"WITH {_PAIRS} SELECT doc_id, item_id, round(len(list_intersect(list_distinct(dt), list_distinct(bt))) / len(list_distinct(bt)), 4) AS coverage FROM pairs WHERE len(bt) > 0")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).filter(F.size("bt") > 0)
    return pairs.select("doc_id", "item_id", F.round(F.size(F.array_intersect("dt", "bt")) / F.size(F.array_distinct("bt")), 4).alias("coverage"))


@query(f"""WITH {_PAIRS}, f AS (SELECT doc_id, word, count(*) AS f FROM (SELECT doc_id, unnest(dt) AS word FROM pairs) GROUP BY ALL), g AS (SELECT doc_id, word, count(*) AS g FROM (SELECT doc_id, unnest(bt) AS word FROM pairs) GROUP BY ALL)
    SELECT doc_id, round(sum(least(coalesce(f, 0), g)) / sum(g), 4) AS recall FROM g LEFT JOIN f USING (doc_id, word) GROUP BY doc_id""")
def word_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of an item's words, with repetition, that its document holds."""
    pairs = _pairs(spark, sf_dir).filter(F.size("bt") > 0)
    return pairs.select("doc_id", F.round(op.multiset_recall(F.col("dt"), F.col("bt")), 4).alias("recall"))


@query(f"WITH {searches._ARMS}, a AS (SELECT list(page) AS k FROM kw WHERE rank <= 10), b AS (SELECT list(page) AS s FROM sem WHERE rank <= 10) SELECT CAST(len(list_intersect(k, s)) AS BIGINT) AS shared, round(len(list_intersect(k, s)) / len(list_distinct(list_concat(k, s))), 4) AS jaccard FROM a, b")
def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = searches._arms(spark, sf_dir).filter("rank <= 10")
    both = arms.agg(F.collect_list(F.when(F.col("arm") == "keyword", F.col("page"))).alias("k"), F.collect_list(F.when(F.col("arm") == "semantic", F.col("page"))).alias("s"))
    shared, union = F.size(F.array_intersect("k", "s")), F.size(F.array_union("k", "s"))
    return both.select(shared.cast("long").alias("shared"), F.round(op.ratio(shared, union, 1.0), 4).alias("jaccard"))


@query(f"WITH {searches._ARMS}, {ad.PAGES_SQL} SELECT file_path, page_num // 10 AS section, min(rank) AS rank FROM kw JOIN pages ON page_id = page GROUP BY ALL")
def page_to_section_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pages make a section; a section has the rank of its best page."""
    ranked = se.ranked(searches._keyword(spark, sf_dir, 30), "doc_id").select(F.col("doc_id").alias("page"), F.col("rank").cast("long").alias("rank"))
    placed = ad.numbers_of(table(spark, sf_dir, "documents"), ranked, "page")
    return placed.groupBy("file_path", F.floor(F.col("page_num") / 10).alias("section")).agg(F.min("rank").alias("rank"))


_SECTIONS = f"""{ad.PAGES_SQL}, pt AS (SELECT file_path, page_num + 1 AS page, text, {searches._TOKENS.format('text')} AS words FROM pages), tot AS (SELECT file_path, count(*) AS total FROM pt GROUP BY file_path),
    sec AS (SELECT file_path, (page - 1) // 3 AS section, min(page) AS first, max(page) AS last, arg_max(page, len(list_distinct(words)) * 1000000 - page) AS start, any_value(total) AS total FROM pt JOIN tot USING (file_path) GROUP BY ALL HAVING sum(length(text)) >= 1000)"""
_READS = f"""{_SECTIONS}, near AS (SELECT s.*, unnest(range(greatest(1, least(first, start - 10)), least(total, greatest(last, start + 10)) + 1)) AS page FROM sec s),
    st AS (SELECT *, CASE WHEN page = start THEN 0 WHEN page > start THEN page - start + least(page - start - 1, start - 1) ELSE start - page + least(start - page, total - start) END AS step, page BETWEEN first AND last AS own FROM near),
    w AS (SELECT st.file_path, section, own, CASE WHEN step <= 10 THEN step END AS step, unnest(list_distinct(words)) AS word FROM st JOIN pt ON pt.file_path = st.file_path AND pt.page = st.page WHERE own OR step <= 10),
    f AS (SELECT file_path, section, word, min(step) AS step FROM w GROUP BY ALL HAVING bool_or(own)), n AS (SELECT file_path, section, count(*) AS n FROM f GROUP BY ALL),
    c AS (SELECT n.file_path, n.section, k, count(*) FILTER (step <= k) / any_value(n) AS share FROM n JOIN f USING (file_path, section), (SELECT unnest(range(0, 11)) AS k) GROUP BY n.file_path, n.section, k),
    reads AS (SELECT file_path, section, coalesce(min(k) FILTER (share >= 0.95 AND k < 10), 10) AS reads, round(coalesce(min(share) FILTER (share >= 0.95), max(share)), 4) AS covered FROM c GROUP BY ALL)"""


def _sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pages with their words, sections of three pages and 1000 characters or more): a section is hit on its page with the
    most distinct words."""
    pages = ad.pages(table(spark, sf_dir, "documents")).select("file_path", (F.col("page_num") + 1).alias("page"), "text")
    pages = kept(pages.withColumn("words", tx.word_tokens(F.col("text"))), "page-words")
    totals = pages.groupBy(F.col("file_path").alias("t_file")).agg(F.count("*").alias("total"))
    facts = pages.select("file_path", "page", F.floor((F.col("page") - 1) / 3).alias("section"), F.char_length("text").alias("chars"), F.size(F.array_distinct("words")).alias("distinct"))
    found = facts.groupBy("file_path", "section").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.max_by("page", F.struct("distinct", -F.col("page"))).alias("start"), F.sum("chars").alias("chars"))
    return pages, found.filter("chars >= 1000").drop("chars").join(totals, F.col("file_path").eqNullSafe(F.col("t_file"))).drop("t_file")


@query(f"WITH {_READS} SELECT * FROM reads")
def agent_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.agent_reads(*_sections(spark, sf_dir)), "covered")


@query(f"WITH {_READS} SELECT file_path, count(*) AS sections, round(avg(reads), 4) AS mean_reads, round(avg((reads = 0)::INT), 4) AS no_extra FROM reads GROUP BY file_path")
def agent_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = op.agent_reads(*_sections(spark, sf_dir))
    return reads.groupBy("file_path").agg(F.count("*").alias("sections"), F.round(F.avg("reads"), 4).alias("mean_reads"), F.round(F.avg((F.col("reads") == 0).cast("int")), 4).alias("no_extra"))


_WORDS_OF = searches._TOKENS.format("string_agg(text, chr(10) ORDER BY page)")


@query(f"""WITH {_SECTIONS}, gold AS (SELECT s.file_path, section, start, {_WORDS_OF} AS t FROM sec s JOIN pt ON pt.file_path = s.file_path AND pt.page BETWEEN first AND last GROUP BY ALL),
    hit AS (SELECT file_path, (page - 1) // 2 AS pair, {_WORDS_OF} AS t FROM pt GROUP BY ALL),
    g AS (SELECT gold.file_path, section, {_NGRAMS.format(t='gold.t')} AS gn, {_NGRAMS.format(t='pt.words')} AS pn, {_NGRAMS.format(t='hit.t')} AS sn FROM gold JOIN pt ON pt.file_path = gold.file_path AND pt.page = start JOIN hit ON hit.file_path = gold.file_path AND pair = (start - 1) // 2),
    m AS (SELECT file_path, len(list_intersect(gn, pn)) / len(gn) AS page_recall, len(list_intersect(gn, sn)) / len(gn) AS section_recall FROM g WHERE len(gn) > 0)
    SELECT file_path, count(*) AS sections, round(avg(page_recall), 4) AS page_recall, round(avg(section_recall), 4) AS section_recall, round(avg(section_recall - page_recall), 4) AS gain FROM m GROUP BY file_path""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a section's 5-grams the page that was hit holds, and the two-page section around it that was found."""
    pages, sections = _sections(spark, sf_dir)
    p = pages.select(F.col("file_path").alias("p_file"), F.col("page").alias("p"), "words")

    def words_of(groups: DataFrame, keys: list[str]) -> DataFrame:
        """The words of the pages first..last in order: words are joined, not texts, since no word goes beyond its page."""
        listed = groups.withColumn("p_at", F.explode(F.sequence("first", "last"))).join(p, F.col("file_path").eqNullSafe(F.col("p_file")) & (F.col("p_at") == F.col("p")))
        gathered = listed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "words"))).alias("w"))  # two or three pages
        return gathered.select(*keys, tx.ngram_hashes(F.flatten(F.transform("w", lambda x: x["words"])), 5).alias("grams"))

    gold = words_of(sections, ["file_path", "section", "start"])
    low = 2 * F.floor((F.col("start") - 1) / 2) + 1
    found = words_of(sections.withColumn("first", low).withColumn("last", F.least(low + 1, F.col("total"))), ["file_path", "section"])
    found = found.select(F.col("file_path").alias("f_file"), F.col("section").alias("f_section"), F.col("grams").alias("section_grams"))
    page = p.select("p_file", "p", tx.ngram_hashes(F.col("words"), 5).alias("page_grams"))
    joined = gold.filter(F.size("grams") > 0).join(found, F.col("file_path").eqNullSafe(F.col("f_file")) & (F.col("section") == F.col("f_section"))).join(page, F.col("file_path").eqNullSafe(F.col("p_file")) & (F.col("start") == F.col("p")))
    shares = [(F.size(F.array_intersect("grams", c)) / F.size("grams")).alias(n) for c, n in (("page_grams", "page_recall"), ("section_grams", "section_recall"))]
    rated = joined.select("file_path", *shares).withColumn("gain", F.col("section_recall") - F.col("page_recall"))
    return rated.groupBy("file_path").agg(F.count("*").alias("sections"), *[F.round(F.avg(c), 4).alias(c) for c in ("page_recall", "section_recall", "gain")])


GOLD = Literal("doc string, page long", ("a", 1), ("a", 1), ("a", 5), ("a", 9), ("b", 2), ("d", 4))
FOUND = Literal("doc string, page long", ("a", 2), ("a", 5), ("a", 20), ("b", 2), ("c", 3))
_F1 = f"""{GOLD.cte('g0')}, {FOUND.cte('d0')}, g AS (SELECT DISTINCT * FROM g0), d AS (SELECT DISTINCT * FROM d0), docs AS (SELECT doc FROM g UNION SELECT doc FROM d),
    c AS (SELECT doc, (SELECT count(*) FROM d WHERE d.doc = docs.doc AND EXISTS (SELECT 1 FROM g WHERE g.doc = d.doc AND abs(g.page - d.page) <= 1)) AS tp, (SELECT count(*) FROM g WHERE g.doc = docs.doc AND EXISTS (SELECT 1 FROM d WHERE g.doc = d.doc AND abs(g.page - d.page) <= 1)) AS m,
      (SELECT count(*) FROM g WHERE g.doc = docs.doc) AS ng, (SELECT count(*) FROM d WHERE d.doc = docs.doc) AS nd FROM docs),
    r AS (SELECT doc, tp, nd - tp AS fp, ng - m AS fn, CASE WHEN nd > 0 AND ng > 0 THEN tp / nd ELSE 0 END AS precision, CASE WHEN ng > 0 THEN m / ng ELSE 0 END AS recall FROM c),
    f AS (SELECT doc, tp, fp, fn, round(precision, 4) AS precision, round(recall, 4) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 4) AS f1 FROM r)"""


@query(f"WITH {_F1} SELECT * FROM f")
def boundary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.boundary_f1(GOLD.df(spark), FOUND.df(spark)), "precision", "recall", "f1")


@query(f"WITH {_F1} SELECT count(*) AS docs, min(f1) AS worst_f1, round(avg(f1), 4) AS mean_f1 FROM f")
def boundary_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _rounded(op.boundary_f1(GOLD.df(spark), FOUND.df(spark)), "f1")
    return rated.agg(F.count("*").alias("docs"), F.min("f1").alias("worst_f1"), F.round(F.avg("f1"), 4).alias("mean_f1"))


CONFUSION = Literal("name string, tp long, fp long, fn long", ("some", 3, 1, 2), ("nothing", 0, 0, 0), ("missed", 0, 0, 4), ("noise", 0, 5, 0))


@query(f"WITH {CONFUSION.cte('t')}, r AS (SELECT name, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM t) SELECT name, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM r")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing to find or nothing found counts as perfect here."""
    p, r = op.ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), op.ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    rated = CONFUSION.df(spark).select("name", p.alias("precision"), r.alias("recall"))
    return _rounded(rated.withColumn("f1", op.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))), "precision", "recall", "f1")


EXCERPTS = Literal("id long, category string, answer string, snippet string, paragraph string", (0, "prose", "alpha beta", "x alpha beta y", "alpha beta"), (1, "prose", "gamma", "no", "the gamma ray"), (2, "structured", "delta", "delta", "nothing"), (3, "structured", "eps", "eps", "eps"))


@query(f"WITH {EXCERPTS.cte('t')}, c AS (SELECT category, contains(paragraph, answer)::INT AS p, contains(snippet, answer)::INT AS s FROM t) SELECT coalesce(category, 'all') AS category, round(avg(p), 4) AS paragraph_rate, round(avg(s), 4) AS snippet_rate, count(*) FILTER (s = 1 AND p = 0) AS regressions FROM c GROUP BY ROLLUP (category)")
def excerpt_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = EXCERPTS.df(spark).select("category", F.contains("paragraph", "answer").cast("int").alias("p"), F.contains("snippet", "answer").cast("int").alias("s"))
    rolled = held.rollup("category").agg(F.round(F.avg("p"), 4).alias("paragraph_rate"), F.round(F.avg("s"), 4).alias("snippet_rate"), F.count_if((F.col("s") == 1) & (F.col("p") == 0)).alias("regressions"))
    return rolled.withColumn("category", F.coalesce("category", F.lit("all")))


MODELS = Literal("model string, mrr double, p50 double", ("base", 0.60, 40.0), ("big", 0.70, 90.0), ("good", 0.66, 50.0), ("good2", 0.66, 45.0), ("bad", 0.30, 30.0))
VERDICT = f"{MODELS.cte('t')}, b AS (SELECT mrr AS m0, p50 AS l0 FROM t WHERE model = 'base'), j AS (SELECT model, mrr - m0 >= 0.05 AS lifts, p50 / l0 <= 1.5 AS fast, mrr, p50 FROM t, b WHERE model <> 'base')"


@query(f"WITH {VERDICT} SELECT coalesce((SELECT model FROM j WHERE lifts AND fast ORDER BY mrr DESC, p50 LIMIT 1), (SELECT 'too slow: ' || model FROM j WHERE lifts ORDER BY mrr DESC, p50 LIMIT 1), 'no challenger') AS verdict, (SELECT count(*) FROM j WHERE lifts) AS lifting")
def model_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = MODELS.df(spark)
    base = models.filter("model = 'base'").select(F.col("mrr").alias("m0"), F.col("p50").alias("l0"))
    judged = models.filter("model <> 'base'").join(F.broadcast(base), how="cross").withColumn("lifts", F.col("mrr") - F.col("m0") >= 0.05).withColumn("fast", F.col("p50") / F.col("l0") <= 1.5)
    key = F.struct(-F.col("mrr"), F.col("p50"))
    good, slow = F.min_by("model", F.when(F.col("lifts") & F.col("fast"), key)), F.min_by("model", F.when(F.col("lifts"), key))
    return judged.agg(F.coalesce(good, F.concat(F.lit("too slow: "), slow), F.lit("no challenger")).alias("verdict"), F.count_if("lifts").alias("lifting"))


SCORES = Literal("grain string, cls string, mrr double", ("page", "lexical", 0.93), ("page", "semantic", 0.50), ("section", "lexical", 0.63), ("section", "semantic", 0.70))


@query(f"WITH {SCORES.cte('t')}, p AS (SELECT max(mrr) FILTER (grain = 'page' AND cls = 'lexical') AS pl, max(mrr) FILTER (grain = 'section' AND cls = 'lexical') AS sl, max(mrr) FILTER (grain = 'page' AND cls = 'semantic') AS ps, max(mrr) FILTER (grain = 'section' AND cls = 'semantic') AS ss FROM t) SELECT ss - ps >= 0.05 AS lifts_semantic, sl >= pl - 0.02 AS keeps_lexical, (ss - ps >= 0.05) AND (sl >= pl - 0.02) AS passes FROM p")
def section_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(grain: str, cls: str):
        return F.max(F.when((F.col("grain") == grain) & (F.col("cls") == cls), F.col("mrr")))

    sums = SCORES.df(spark).agg(of("page", "lexical").alias("pl"), of("section", "lexical").alias("sl"), of("page", "semantic").alias("ps"), of("section", "semantic").alias("ss"))
    lifts, keeps = F.col("ss") - F.col("ps") >= 0.05, F.col("sl") >= F.col("pl") - 0.02
    return sums.select(lifts.alias("lifts_semantic"), keeps.alias("keeps_lexical"), (lifts & keeps).alias("passes"))


BEFORE = Literal("id string, score double", ("a", 0.5), ("b", 0.7), ("c", 0.9), ("d", 0.1))
AFTER = Literal("id string, score double", ("a", 0.6), ("b", 0.7), ("c", 0.5), ("e", 1.0))
_DIFF = f"{BEFORE.cte('b')}, {AFTER.cte('a')}"


@query(f"WITH {_DIFF}, j AS (SELECT b.score AS old, coalesce(a.score, 0) AS new FROM b LEFT JOIN a USING (id)) SELECT count(*) FILTER (new > old) AS wins, count(*) FILTER (new < old) AS losses, count(*) FILTER (new = old) AS ties FROM j")
def win_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = AFTER.df(spark).withColumnRenamed("score", "new")
    paired = BEFORE.df(spark).join(new, "id", "left").withColumn("new", F.coalesce("new", F.lit(0.0)))
    return paired.agg(F.count_if(F.col("new") > F.col("score")).alias("wins"), F.count_if(F.col("new") < F.col("score")).alias("losses"), F.count_if(F.col("new") == F.col("score")).alias("ties"))


@query(f"WITH {_DIFF} SELECT coalesce(b.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'missing' WHEN b.id IS NULL THEN 'new' WHEN a.score < b.score - 0.02 THEN 'regressed' ELSE 'ok' END AS state FROM b FULL JOIN a USING (id)")
def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = AFTER.df(spark).withColumnRenamed("score", "new")
    joined = BEFORE.df(spark).join(new, "id", "full")
    return joined.select("id", F.when(F.col("new").isNull(), "missing").when(F.col("score").isNull(), "new").when(F.col("new") < F.col("score") - 0.02, "regressed").otherwise("ok").alias("state"))


VOTES = Literal("page long, vote string", (1, "ok"), (1, "ok"), (1, "bad"), (2, "ok"), (2, "bad"), (3, "bad"), (4, "ok"), (4, "bad"), (4, "odd"))


@query(f"WITH {VOTES.cte('t')}, c AS (SELECT page, vote, count(*) AS n FROM t GROUP BY ALL) SELECT page, CASE WHEN max(n) * 2 > sum(n) THEN arg_max(vote, n) ELSE 'error' END AS verdict FROM c GROUP BY page")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = VOTES.df(spark).groupBy("page", "vote").agg(F.count("*").alias("n"))
    return counts.groupBy("page").agg(F.when(F.max("n") * 2 > F.sum("n"), F.max_by("vote", "n")).otherwise("error").alias("verdict"))


_OTHER = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(x * 16) / 16)"
_UNIT = "sqrt(list_dot_product({0}, {0}))"


@query(f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS a, {_OTHER} AS b FROM embeddings), p AS (SELECT list_dot_product(a, b) / ({_UNIT.format('a')} * {_UNIT.format('b')}) AS cos FROM v),
    q AS (SELECT min(vec_id) AS probe FROM v GROUP BY label), s AS (SELECT probe, v.vec_id, list_dot_product(o.a, v.a) / {_UNIT.format('v.a')} AS sa, list_dot_product(o.b, v.b) / {_UNIT.format('v.b')} AS sb FROM q JOIN v o ON o.vec_id = probe, v WHERE v.vec_id <> probe),
    r AS (SELECT probe, vec_id, row_number() OVER (PARTITION BY probe ORDER BY round(sa, 9) DESC, vec_id) AS ra, row_number() OVER (PARTITION BY probe ORDER BY round(sb, 9) DESC, vec_id) AS rb FROM s), o AS (SELECT probe, count(*) FILTER (ra <= 5 AND rb <= 5) / 5.0 AS overlap FROM r GROUP BY probe)
    SELECT round(min(cos), 4) AS least, round(quantile_cont(cos, 0.1), 4) AS p10, round(median(cos), 4) AS middle, round(avg(cos), 4) AS mean, count(*) AS vectors, (SELECT round(avg(overlap), 4) FROM o) AS overlap5 FROM p""")
def embedding_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two backends, the second one with coarser numbers: how alike a text's vectors are, and how many of the five nearest
    vectors of each label's first vector are the same."""
    other = F.transform("embedding", lambda x: F.floor(x.cast("double") * 16) / 16)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("a"), other.alias("b"))

    def length(c: str) -> Column:
        return F.sqrt(se.dot(F.col(c), F.col(c)))

    cos = vectors.select((se.dot(F.col("a"), F.col("b")) / (length("a") * length("b"))).alias("cos"))
    facts = cos.agg(F.round(F.min("cos"), 4).alias("least"), F.round(F.percentile("cos", 0.1), 4).alias("p10"), F.round(F.percentile("cos", 0.5), 4).alias("middle"), F.round(F.avg("cos"), 4).alias("mean"), F.count("*").alias("vectors"))
    first = vectors.groupBy("label").agg(F.min_by(F.struct("vec_id", "a", "b"), "vec_id").alias("p")).select(F.col("p.vec_id").alias("probe"), F.col("p.a").alias("pa"), F.col("p.b").alias("pb"))
    pairs = vectors.join(F.broadcast(first), F.col("vec_id") != F.col("probe"))  # the probes are one a label, a stated set against all rows
    scored = pairs.select("probe", "vec_id", (se.dot(F.col("pa"), F.col("a")) / length("a")).alias("sa"), (se.dot(F.col("pb"), F.col("b")) / length("b")).alias("sb"))

    def nearest(score: str, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.round(score, 9).desc(), "vec_id"))
        return scored.select("probe", "vec_id", score).withColumn("r", rank).filter("r <= 5").select(F.col("probe").alias(f"{name}_probe"), F.col("vec_id").alias(f"{name}_id"))

    x, y = nearest("sa", "x"), nearest("sb", "y")
    shared = x.join(y, (F.col("x_probe") == F.col("y_probe")) & (F.col("x_id") == F.col("y_id")), "left").groupBy("x_probe").agg((F.count("y_id") / 5.0).alias("overlap"))
    return facts.join(F.broadcast(shared.agg(F.round(F.avg("overlap"), 4).alias("overlap5"))), how="cross")


ORDERS = Literal("id long, got string, want string", (0, "one two three four", "one two three four"), (1, "three four one two", "one two three four"), (2, "", "x"), (3, "a b c", "a c b"))


@query()
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity of two token sequences by matching blocks; it has no SQL form."""

    def run(batches):
        import difflib

        import pyarrow as pa

        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            found = [difflib.SequenceMatcher(None, a.split()[:1500], b.split()[:1500], autojunk=False).ratio() for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "ratio"])

    return _rounded(ORDERS.df(spark).mapInArrow(run, "id long, ratio double"), "ratio")
