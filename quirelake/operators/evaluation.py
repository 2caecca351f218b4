"""Retrieval and detection metrics as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole; a stated value for an empty whole."""
    return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(F.lit(empty))


def retrieval_metrics(hits: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """(query, ndcg, mrr, recall, first_hit) from hits(query, rank, page) and grades(query, page, grade); linear gain."""
    graded = hits.filter(F.col("rank") <= k).join(grades, ["query", "page"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    got = graded.groupBy("query").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first_hit"), F.count_if(F.col("grade") > 0).alias("found"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("grade").desc()))
    best = grades.withColumn("_r", place)
    ideal = best.groupBy("query").agg(F.coalesce(F.sum(F.when(F.col("_r") <= k, F.col("grade") / F.log2(F.col("_r") + 1))), F.lit(0.0)).alias("idcg"), F.count_if(F.col("grade") > 0).alias("relevant"))
    joined = got.join(ideal, "query", "left")
    return joined.select("query", ratio(F.col("dcg"), F.coalesce("idcg", F.lit(0.0))).alias("ndcg"), F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr"), ratio(F.col("found"), F.coalesce("relevant", F.lit(0))).alias("recall"), F.col("first_hit"))


def boundary_f1(gold: DataFrame, found: DataFrame, tolerance: int = 1) -> DataFrame:
    """(doc, tp, fp, fn, precision, recall, f1) of start pages within a tolerance, by semi-joins both ways."""
    g, d = gold.select("doc", "page").distinct(), found.select("doc", "page").distinct()

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.select(F.col("doc").alias("o"), F.col("page").alias("p"))
        return left.join(other, (F.col("doc") == F.col("o")) & (F.abs(F.col("page") - F.col("p")) <= tolerance), "left_semi")

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc").agg(F.count("*").alias(name))

    docs = g.select("doc").union(d.select("doc")).distinct()
    joined = docs
    for df, name in ((near(d, g), "tp"), (near(g, d), "matched"), (g, "n_gold"), (d, "n_found")):
        joined = joined.join(counted(df, name), "doc", "left")
    filled = joined.fillna(0)
    precision, recall = ratio(F.col("tp"), F.col("n_found")), ratio(F.col("matched"), F.col("n_gold"))
    rated = filled.select("doc", "tp", (F.col("n_found") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("matched")).alias("fn"), F.when(F.col("n_gold") > 0, precision).otherwise(0.0).alias("precision"), recall.alias("recall"))
    return rated.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def walk_step(page: Column, start: Column, total: Column) -> Column:
    """The place of a page (from 1) in a walk N, N+1, N-1, N+2, ... from its start, 0 for the start itself; pages outside
    the document take no place."""
    away = F.abs(page - start)
    forward, back = away + F.least(away - 1, start - 1), away + F.least(away, total - start)
    return F.when(page == start, F.lit(0)).when(page > start, forward).otherwise(back).cast("long")


def agent_reads(pages: DataFrame, sections: DataFrame, *, max_reads: int = 10, enough: float = 0.95) -> DataFrame:
    """(file_path, section, reads, covered): how many further pages are read from a hit until the pages hold enough of the
    section's distinct words; max_reads if they never do.

    pages: (file_path, page, words), words being an array; sections: (file_path, section, first, last, start, total).
    A section's words come from its own pages, and each word is covered at the first step whose page has it: so one
    aggregate a section and word, and one a section, settle every walk at once.
    """
    p = pages.select(F.col("file_path").alias("p_file"), F.col("page").alias("p_page"), F.array_distinct("words").alias("p_words"))
    near = F.sequence(F.greatest(F.lit(1), F.least("first", F.col("start") - max_reads)), F.least("total", F.greatest("last", F.col("start") + max_reads)))
    reach = sections.withColumn("at", F.explode(near)).withColumn("step", walk_step(F.col("at"), F.col("start"), F.col("total")))
    own = F.col("at").between(F.col("first"), F.col("last"))
    read = reach.withColumn("own", own).filter(own | (F.col("step") <= max_reads)).join(p, F.col("file_path").eqNullSafe(F.col("p_file")) & (F.col("at") == F.col("p_page")))
    words = read.select("file_path", "section", "own", F.when(F.col("step") <= max_reads, F.col("step")).alias("step"), F.explode("p_words").alias("word"))
    first = words.groupBy("file_path", "section", "word").agg(F.bool_or("own").alias("own"), F.min("step").alias("step")).filter("own")
    steps = first.groupBy("file_path", "section").agg(F.count("*").alias("n"), *[F.count_if(F.col("step") <= k).alias(f"by{k}") for k in range(max_reads + 1)])
    shares = [F.col(f"by{k}") / F.col("n") for k in range(max_reads + 1)]
    reads, covered = F.lit(max_reads), shares[max_reads]
    for k in reversed(range(max_reads)):
        reads, covered = F.when(shares[k] >= enough, k).otherwise(reads), F.when(shares[k] >= enough, shares[k]).otherwise(covered)
    return steps.select("file_path", "section", reads.cast("long").alias("reads"), covered.alias("covered"))


def multiset_recall(found: Column, gold: Column) -> Column:
    """The share of an array's words, with repetition, that another array holds as often; 0 for no words. No row moves."""
    def held(word: Column) -> Column:
        return F.least(F.size(F.filter(found, lambda x: x == word)), F.size(F.filter(gold, lambda x: x == word)))

    return ratio(F.aggregate(F.array_distinct(gold), F.lit(0), lambda s, word: s + held(word)), F.size(gold))
