"""Sections: from tables of contents, from headings, and their texts; repeated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

#: Fixed value: what a heading looks like without any layout.
HEADING = r"^(?:\d+(?:\.\d+)*\s+[A-Z]|(?i:Chapter|Section|Part)\s+\d+|(?i:Abstract|References|Acknowledgements?|Acknowledgments?|Bibliography)\s*$|Appendix\s+[A-Z])"
#: Fixed value: a number that waits for its title.
NUMBER_ONLY = r"^\d+(\.\d+)*\.?$"
#: The weights of a line's signals, and the least sum of a heading.
WEIGHTS = {"face_delta": 2, "bold_marker": 2, "whitespace_above": 1, "top_of_page": 1, "regex_match": 3, "title_case_or_caps": 1, "short_line": 1}
THRESHOLD = 4


def toc_sections(toc: DataFrame, totals: DataFrame) -> DataFrame:
    """(file_path, ord, title, start_page, end_page) from (file_path, ord, level, title, page) and (file_path, total).

    A section ends before the first later entry of its level or a higher one; the last at the document's end. An entry is
    listed under its own level and each one below it, and in the list of a level its follower is the next entry of that
    level or a higher one: no entry meets all others of its file.
    """
    deepest = F.broadcast(toc.agg(F.max("level").alias("deepest")))  # one row
    listed = toc.join(deepest, how="cross").withColumn("under", F.explode(F.sequence("level", "deepest")))
    after = F.lead("page").over(Window.partitionBy("file_path", "under").orderBy("ord"))
    ends = listed.withColumn("next", after).filter(F.col("under") == F.col("level"))
    return ends.join(totals, "file_path").select("file_path", "ord", "title", F.col("page").alias("start_page"), F.coalesce(F.col("next") - 1, F.col("total")).alias("end_page"))


def leaf_sections(sections: DataFrame) -> DataFrame:
    """Sections within which no other starts: the next start after a section's own lies beyond its end."""
    later = Window.partitionBy("file_path").orderBy("start_page").rangeBetween(1, Window.unboundedFollowing)
    after = sections.withColumn("after", F.min("start_page").over(later))
    return after.filter(F.col("after").isNull() | (F.col("after") > F.col("end_page"))).drop("after")


def section_text(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """With the text of pages start..end (1-based) joined by line breaks; empty where start > end."""
    texts = pages.select(F.col("file_path").alias("f"), (F.col("page_num") + 1).alias("p"), "text")
    joined = sections.join(texts, (F.col("file_path") == F.col("f")) & F.col("p").between(F.col("start_page"), F.col("end_page")), "left")
    gathered = joined.groupBy(*sections.columns).agg(F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "text")))).alias("parts"))
    return gathered.select(*sections.columns, F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))


def clean_heading(text: Column) -> Column:
    bare = tx.strip(text)
    inner = F.when(F.rlike(bare, F.lit(r"[.:]$")), F.substring(bare, F.lit(1), F.char_length(bare) - 1)).otherwise(bare)
    return (bare != "") & (F.char_length(bare) <= 120) & ~F.contains(inner, F.lit(". ")) & ~F.contains(inner, F.lit("; "))


def regex_sections(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """Sections by the heading pattern alone from lines(file_path, page, ord, line): each ends before the next starts."""
    heads = lines.filter(F.rlike(tx.strip(F.col("line")), F.lit(HEADING)) & (F.char_length("line") <= 200)).join(totals, "file_path")
    after = F.lead("page").over(Window.partitionBy("file_path").orderBy("page", "ord"))
    title = F.when(clean_heading(F.col("line")), tx.strip(F.col("line")))
    return heads.select("file_path", "page", "ord", title.alias("title"), F.coalesce(after - 1, F.col("total")).alias("end_page")).withColumnRenamed("page", "start_page")


def looks_bold(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(F.lit(16)) != 0) | F.contains(font, F.lit("Bold")) | F.contains(font, F.lit("-B")) | F.contains(font, F.lit(".B"))


def title_case_or_caps(text: Column) -> Column:
    bare = tx.strip(text)
    words = F.filter(tx.split_words(bare), lambda w: F.rlike(w, F.lit(r"\p{L}")))
    upper = F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{Lu}")))
    caps = (F.upper(bare) == bare) & (F.lower(bare) != bare)
    return (bare != "") & (caps | (F.size(words) > 0) & (F.size(upper) >= 0.6 * F.size(words)))


def body_fingerprint(lines: DataFrame) -> DataFrame:
    """(file_path, body_font, body_bold): the most frequent face among the lines' longest spans, the first seen on ties."""
    faces = lines.groupBy("file_path", "font", F.col("flags").bitwiseAND(F.lit(16)).alias("b")).agg(F.count("*").alias("n"), F.min(F.struct("page", "ord")).alias("first"))
    best = faces.groupBy("file_path").agg(F.min(F.struct((-F.col("n")).alias("k"), "first", "font", "b")).alias("m"))
    return best.select("file_path", F.col("m.font").alias("body_font"), (F.col("m.b") != 0).alias("body_bold"))


def line_features(lines: DataFrame) -> DataFrame:
    """The seven signals of lines(file_path, page, ord, page_height, y0, y1, text, font, flags) and their weighted sum."""
    before = F.lag("y1").over(Window.partitionBy("file_path", "page").orderBy("ord"))
    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    faced = lines.withColumn("_prev", before).join(body_fingerprint(lines), "file_path")
    bare = tx.strip(F.col("text"))
    bold = F.col("flags").bitwiseAND(F.lit(16)) != 0
    signals = {
        "face_delta": (F.col("font") != F.col("body_font")) | (bold != F.col("body_bold")),
        "bold_marker": looks_bold(F.col("font"), F.col("flags")),
        "whitespace_above": F.coalesce(F.col("y0") - F.col("_prev") >= 1.5 * height, F.lit(True)),
        "top_of_page": F.col("y0") < 0.15 * F.col("page_height"),
        "regex_match": F.rlike(bare, F.lit(HEADING)),
        "title_case_or_caps": title_case_or_caps(F.col("text")),
        "short_line": F.char_length(bare) <= 80,
    }
    score = F.lit(0)
    for name, weight in WEIGHTS.items():
        score = score + F.when(F.col(name) & (bare != ""), weight).otherwise(0)
    marked = faced.select(*lines.columns, *[(s & (bare != "")).alias(n) for n, s in signals.items()])
    return marked.withColumn("score", score)


def detected_sections(lines: DataFrame, totals: DataFrame, *, max_chars: int = 200) -> DataFrame:
    """(file_path, ord, title, start_page, end_page, title_source) from the lines' signals: headings of at most so many
    characters, numbers joined to their titles; each section ends before the next starts. A heading whose shape isn't
    clean starts a section without a title."""
    heads = line_features(lines).filter((F.col("score") >= THRESHOLD) & (tx.strip(F.col("text")) != "") & (F.char_length(tx.strip(F.col("text"))) <= max_chars))
    merged = merge_split_headings(heads.select("file_path", "page", "ord", tx.strip(F.col("text")).alias("text"), F.col("y0").alias("y"))).join(totals, "file_path")
    after = F.lead("page").over(Window.partitionBy("file_path").orderBy("page", "ord"))
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("page", "ord")) - 1
    clean = clean_heading(F.col("text"))
    named = merged.select("file_path", place.cast("long").alias("place"), F.when(clean, F.col("text")).alias("title"), F.col("page").alias("start_page"), F.coalesce(after - 1, F.col("total")).alias("end_page"), F.when(clean, "heading_detected").alias("title_source"))
    return named.withColumnRenamed("place", "ord")


def derived_sections(toc: DataFrame, lines: DataFrame, totals: DataFrame) -> DataFrame:
    """Sections by the table of contents for files that have one, by headings for all others, as one table."""
    listed = toc_sections(toc, totals).withColumn("title_source", F.lit("toc"))
    others = lines.join(toc.select("file_path").distinct(), "file_path", "left_anti")
    return listed.unionByName(detected_sections(others, totals))


def merge_split_headings(candidates: DataFrame, max_gap: float = 50.0) -> DataFrame:
    """A bare number joined to the next candidate of its page if that is near; both are used up.

    Consumption alternates within a run of numbers, so a line's place in its run decides: the candidates that could
    merge with their follower form runs, and every second of a run, from the first, does.
    """
    order = Window.partitionBy("file_path").orderBy("page", "ord")
    bare = tx.strip(F.col("text"))
    can = F.rlike(bare, F.lit(NUMBER_ONLY)) & (F.lead("page").over(order) == F.col("page")) & (F.abs(F.lead("y").over(order) - F.col("y")) <= max_gap)
    marked = candidates.withColumn("_can", F.coalesce(can, F.lit(False))).withColumn("_next", F.lead(bare).over(order)).withColumn("_n", F.row_number().over(order))
    marked = marked.withColumn("_break", F.max(F.when(~F.col("_can"), F.col("_n"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    takes = F.col("_can") & ((F.col("_n") - F.coalesce(F.col("_break"), F.lit(0))) % 2 == 1)
    marked = marked.withColumn("_takes", takes).withColumn("_taken", F.coalesce(F.lag("_takes").over(order), F.lit(False)))
    merged = F.when(F.col("_takes"), F.concat(bare, F.lit(" "), F.col("_next"))).otherwise(F.col("text"))
    return marked.filter(~F.col("_taken")).select("file_path", "page", "ord", merged.alias("text"), "y")


def repeated_lines(lines: DataFrame, share: float) -> DataFrame:
    """(file_path, line, pages): stripped lines on at least that share of a file's pages."""
    bare = lines.select("file_path", "page_id", tx.strip(F.col("line")).alias("line"))
    totals = bare.groupBy("file_path").agg(F.countDistinct("page_id").alias("total"))
    counts = bare.filter("line <> ''").distinct().groupBy("file_path", "line").agg(F.count("*").alias("pages"))
    return counts.join(totals, "file_path").filter(F.col("pages") >= share * F.col("total")).select("file_path", "line", "pages")


#: Fixed value: a line that only numbers its page.
PAGE_NUMBER = r"(?i)^\s*(page\s+)?\d+(\s*(of|/)\s*\d+)?\s*$"


def boilerplate(lines: DataFrame, share: float = 0.5) -> DataFrame:
    """(file_path, line): stripped lines on at least that share of a file's pages, and, if page numbers of any form are on
    as many, all of their forms."""
    bare = lines.select("file_path", "page_id", tx.strip(F.col("line")).alias("line"))
    totals = bare.groupBy(F.col("file_path").alias("t_file")).agg(F.countDistinct("page_id").alias("total"))
    held = bare.filter("line <> ''").distinct().withColumn("numbers", F.rlike("line", F.lit(PAGE_NUMBER)))
    family = F.when(F.col("numbers"), F.lit(0)).otherwise(F.xxhash64("line"))  # all page numbers of a file count as one line
    pages = held.groupBy("file_path", "numbers", family.alias("family")).agg(F.countDistinct("page_id").alias("pages"))
    often = pages.join(totals, F.col("file_path") == F.col("t_file")).filter(F.col("pages") >= share * F.col("total"))
    often = often.select(F.col("file_path").alias("o_file"), F.col("numbers").alias("o_numbers"), F.col("family").alias("o_family"))
    same = (F.col("file_path") == F.col("o_file")) & (F.col("numbers") == F.col("o_numbers")) & (family == F.col("o_family"))
    return held.join(often, same, "left_semi").select("file_path", "line").distinct()


def stripped_texts(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(page_id, text): every page's lines but the repeated ones, joined again; a page of nothing else is empty."""
    kept = strip_lines(lines, repeated).select(F.col("page_id").alias("k_page"), F.struct("line_no", "line").alias("l"))
    gathered = kept.groupBy("k_page").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    joined = lines.select("page_id").distinct().join(gathered, F.col("page_id") == F.col("k_page"), "left")
    return joined.select("page_id", F.coalesce(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("")).alias("text"))


def strip_lines(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """The lines that aren't repeated ones."""
    keys = repeated.select(F.col("file_path").alias("f"), F.col("line").alias("l"))
    return lines.join(keys, (F.col("file_path") == F.col("f")) & (tx.strip(F.col("line")) == F.col("l")), "left_anti")


def boilerplate_runs(signed: DataFrame, totals: DataFrame, *, share: float = 0.6, least_run: int = 3) -> DataFrame:
    """(file_path, sig, band, by_share, by_parity, by_run) from signed(file_path, page, sig, band) and (file_path, total).

    Islands of consecutive pages come from page minus row number.
    """
    seen = signed.select("file_path", "sig", "band", "page").distinct()
    island = F.col("page") - F.row_number().over(Window.partitionBy("file_path", "sig", "band").orderBy("page"))
    runs = seen.withColumn("island", island).groupBy("file_path", "sig", "band", "island").agg(F.count("*").alias("n"), F.count_if(F.col("page") % 2 == 1).alias("odd"))
    whole = runs.groupBy("file_path", "sig", "band").agg(F.sum("n").alias("n"), F.sum("odd").alias("odd"), F.max("n").alias("run")).join(totals, "file_path")
    odd_total, even_total = F.ceil(F.col("total") / 2), F.floor(F.col("total") / 2)
    parity = (odd_total >= 1) & (F.col("odd") >= share * odd_total) | (even_total >= 1) & (F.col("n") - F.col("odd") >= share * even_total)
    judged = whole.select("file_path", "sig", "band", (F.col("n") >= share * F.col("total")).alias("by_share"), parity.alias("by_parity"), (F.col("run") >= least_run).alias("by_run"))
    return judged.filter("by_share or by_parity or by_run")
