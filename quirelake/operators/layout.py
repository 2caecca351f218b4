"""Page geometry: columns, writing modes, vertical text, rules, hidden text, tables, renders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: English phrases that are counted in hidden text.
PHRASES = ("ignore previous instructions", "ignore all previous instructions", "disregard the above", "disregard previous", "system prompt", "you are now", "new instructions", "do not tell the user")
#: Why a span can't be seen.
REASONS = ("invisible_render", "tiny_font", "transparent", "white_on_white", "offpage")


def overlap(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), zero) * F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), zero)


def _boxes_of(spans: DataFrame, boxes: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Spans joined to the boxes of their page, the share of a span that a box covers, and the span's area."""
    b = boxes.select(*[F.col(c).alias(f"b_{c}") for c in boxes.columns])
    joined = spans.join(b, (F.col("file_path") == F.col("b_file_path")) & (F.col("page") == F.col("b_page")), "left")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    shared = overlap(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "b_x0", "b_y0", "b_x1", "b_y1")])
    return joined, F.coalesce(shared / F.when(area > 0, area), F.lit(0.0)), area


def covered_by_image(spans: DataFrame, images: DataFrame, share: float = 0.8) -> DataFrame:
    """(span_id, covered)"""
    joined, part, _ = _boxes_of(spans, images)
    return joined.groupBy("span_id").agg(F.bool_or(part >= share).alias("covered"))


def background(spans: DataFrame, fills: DataFrame, share: float = 0.5) -> DataFrame:
    """(span_id, light): of the fills that cover the span, the last painted decides; none means a white page."""
    joined, part, _ = _boxes_of(spans, fills)
    last = joined.groupBy("span_id").agg(F.max_by("b_color", F.when(part >= share, F.col("b_ord"))).alias("bg"))
    return last.select("span_id", F.coalesce(F.forall("bg", lambda c: c >= 0.85), F.lit(True)).alias("light"))


def hidden_spans(spans: DataFrame, images: DataFrame, fills: DataFrame, pages: DataFrame, *, min_chars: int = 3) -> DataFrame:
    """(span_id, file_path, page, text, reasons) of the spans that can't be seen.

    Fills are joined only for white spans, images only for spans rendered invisibly.
    """
    long = spans.filter(F.char_length("text") >= min_chars)
    painted, clear = F.col("type").isin(0, 2), F.col("opacity") <= 0.05
    white = painted & ~clear & F.forall("color", lambda c: c >= 0.95)
    on = background(long.filter(white), fills)
    under = covered_by_image(long.filter(F.col("type") == 3), images)
    sized = pages.select(F.col("file_path").alias("p_file"), F.col("page").alias("p_page"), "width", "height")
    joined = long.join(on, "span_id", "left").join(under, "span_id", "left").join(sized, (F.col("file_path") == F.col("p_file")) & (F.col("page") == F.col("p_page")), "left")
    zero = F.lit(0.0)
    seen = overlap(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), zero, zero, F.col("width"), F.col("height"))
    tests = ((F.col("type") == 3) & ~F.coalesce("covered", F.lit(False)), F.col("size") <= 1.0, painted & clear, white & F.coalesce("light", F.lit(False)), seen <= 0)
    reasons = F.filter(F.array(*[F.when(t, n) for n, t in zip(REASONS, tests, strict=True)]), lambda r: r.isNotNull())
    return joined.select("span_id", "file_path", "page", "text", reasons.alias("reasons")).filter(F.size("reasons") > 0)


def trust_rollup(hidden: DataFrame) -> DataFrame:
    """A row a file: runs, characters, pages, and a count for each reason."""
    counts = [F.count_if(F.array_contains("reasons", r)).alias(r) for r in REASONS]
    return hidden.groupBy("file_path").agg(F.count("*").alias("runs"), F.sum(F.char_length("text")).cast("long").alias("chars"), F.array_join(F.sort_array(F.collect_set("page")), ",").alias("pages"), *counts)


def injection_hits(hidden: DataFrame, phrases: tuple[str, ...] = PHRASES) -> DataFrame:
    """(file_path, hits): the phrases that a file's hidden text holds, with or without spaces."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "span_id", "text"))), lambda s: s["text"]), " ")
    joined = hidden.groupBy("file_path").agg(text.alias("t"))
    plain = F.array_join(F.filter(F.split(F.lower("t"), r"\s+"), lambda w: w != ""), " ")
    found = F.lit(0)
    for p in dict.fromkeys(" ".join(p.lower().split()) for p in phrases):
        found = found + (F.contains("n", F.lit(p)) | F.contains(F.replace("n", F.lit(" "), F.lit("")), F.lit(p.replace(" ", "")))).cast("int")
    return joined.select("file_path", plain.alias("n")).select("file_path", found.cast("long").alias("hits"))


def writing_mode(glyphs: DataFrame) -> DataFrame:
    """(page_id, mode) by the vote of the glyphs' directions."""
    votes = glyphs.groupBy("page_id").agg(F.count_if("vertical").alias("v"), F.count("*").alias("n"), F.bool_or(F.rlike("text", F.lit(r"[\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"))).alias("cjk"))
    share = F.col("v") / F.col("n")
    return votes.select("page_id", F.when(~F.col("cjk") | (F.col("v") < 30) | (share < 0.2), "horizontal").when(share >= 0.8, "vertical").otherwise("mixed").alias("mode"))


def oriented(lines: DataFrame) -> DataFrame:
    """Lines with their writing direction (dx, dy) as glyph rows: `vertical` where they run down rather than across; blank
    ones are left out."""
    return lines.filter(F.rlike("text", F.lit(r"\S"))).withColumn("vertical", F.abs("dy") > F.abs("dx")).drop("dx", "dy")


def single_column(blocks: DataFrame) -> DataFrame:
    """(page_id, single): at least two text blocks, of which 60 % span 60 % of the text's width."""
    text = blocks.filter((F.col("kind") == 0) & F.rlike("text", F.lit(r"\S")))
    span = text.groupBy("page_id").agg(F.count("*").alias("n"), (F.max("x1") - F.min("x0")).alias("w"))
    wide = text.join(span, "page_id").groupBy("page_id", "n", "w").agg(F.count_if(F.col("x1") - F.col("x0") >= 0.6 * F.col("w")).alias("wide"))
    return wide.select("page_id", ((F.col("n") >= 2) & (F.col("w") > 0) & (F.col("wide") >= 0.6 * F.col("n"))).alias("single"))


def multi_column(boxes: DataFrame) -> DataFrame:
    """(page_id, multi): 2 to 16 boxes have a quarter of the tallest one's height."""
    tallest = F.max(F.col("y1") - F.col("y0")).over(Window.partitionBy("page_id"))
    tall = boxes.withColumn("h", F.col("y1") - F.col("y0")).withColumn("top", tallest)
    return tall.groupBy("page_id").agg(((F.count("*") > 1) & (F.max("top") > 0) & F.count_if(F.col("h") >= 0.25 * F.col("top")).between(2, 16)).alias("multi"))


def page_text(blocks: DataFrame, columns: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, text): blocks by box where the page has several columns and isn't plainly single, else from top to bottom."""
    flags = single_column(blocks).join(multi_column(boxes), "page_id", "left").select(F.col("page_id").alias("p"), (~F.col("single") & F.coalesce("multi", F.lit(False))).alias("by_box"))
    placed = blocks.filter("kind = 0").join(columns, ["page_id", "block_no"], "left").join(flags, F.col("page_id") == F.col("p"), "left")
    box = F.when(F.col("by_box"), F.coalesce("box_no", F.lit(1 << 20))).otherwise(F.lit(0))
    key = F.struct(box.cast("long").alias("box"), F.round("y0").alias("y"), F.col("x0").alias("x"), F.col("block_no").alias("b"), F.col("text").alias("t"))
    return placed.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda s: s["t"]), "\n\n").alias("text"))


def texts_by_mode(glyphs: DataFrame, pages: DataFrame, blocks: DataFrame, columns: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, mode, text): vertical and mixed pages by tiers and columns from right to left, all others by their blocks."""
    modes = writing_mode(glyphs)
    upright = modes.filter(F.col("mode") != "horizontal").select(F.col("page_id").alias("m_page"), "mode")
    down = vertical_reorder(glyphs.join(upright, F.col("page_id") == F.col("m_page"), "left_semi"), pages)
    down = down.join(upright, F.col("page_id") == F.col("m_page")).select("page_id", "mode", "text")
    across = page_text(blocks.join(upright, F.col("page_id") == F.col("m_page"), "left_anti"), columns, boxes)
    return down.unionByName(across.select("page_id", F.lit("horizontal").alias("mode"), "text"))


def table_rows(cells: Column) -> Column:
    """struct(header, rows) of an array of rows of cells: the first row is the header, a missing cell is empty."""
    filled = F.transform(cells, lambda row: F.transform(row, lambda c: F.coalesce(c, F.lit(""))))
    return F.struct(F.get(filled, F.lit(0)).alias("header"), F.slice(filled, F.lit(2), F.greatest(F.size(filled), F.lit(1))).alias("rows"))


def valley_tiers(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, tiers): where vertical text has gutters across the page, as heights from the top.

    A page's glyphs are counted in bins in one aggregate; the scan over a page's few hundred bins is a task's own.
    """
    vertical = glyphs.filter("vertical").join(pages, "page_id")
    unit = F.expr("percentile(y1 - y0, 0.5)")
    facts = vertical.groupBy("page_id", "height").agg(unit.alias("unit")).filter("unit > 0 and height > 0").withColumn("bins", F.greatest(F.lit(20), F.floor(F.col("height") / (F.col("unit") * 0.8)).cast("int")))
    width = F.col("height") / F.col("bins")
    low, high = F.greatest(F.floor(F.col("y0") / width), F.lit(0)), F.least(F.floor(F.col("y1") / width), F.col("bins") - 1)
    filled = vertical.drop("height").join(facts, "page_id").filter(low <= high).select("page_id", "unit", "bins", width.alias("w"), F.explode(F.sequence(low, high)).alias("bin"))
    counts = filled.groupBy("page_id", "unit", "bins", "w", "bin").agg(F.count("*").alias("n"))
    gathered = counts.groupBy("page_id", "unit", "bins", "w").agg(F.expr("percentile(n, 0.5)").alias("median"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    cover = F.transform(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    covered = gathered.withColumn("cov", cover)
    # An interior valley is a maximal run of low bins with more than half the median on both sides.
    low_bin = F.filter(F.sequence(F.lit(0), F.col("bins") - 1), lambda i: F.get("cov", i) < 0.35 * F.col("median"))
    starts = F.filter("low", lambda i: ~F.array_contains("low", i - 1))
    stops = F.filter("low", lambda i: ~F.array_contains("low", i + 1))
    runs = F.zip_with("starts", "stops", lambda a, b: F.struct(a.alias("a"), (b + 1).alias("b")))
    enough = 0.5 * F.col("median")
    inner = F.filter(runs, lambda r: F.exists(F.slice("cov", F.lit(1), r["a"]), lambda c: c > enough) & F.exists(F.slice("cov", r["b"] + 1, F.col("bins")), lambda c: c > enough))
    bounds = F.transform(inner, lambda r: (r["a"] + r["b"]) / 2 * F.col("w"))
    spaced = F.aggregate("bounds", F.array().cast("array<double>"), lambda kept, b: F.when((F.size(kept) == 0) | (b - F.element_at(kept, -1) > 2 * F.col("unit")), F.concat(kept, F.array(b))).otherwise(kept))
    return covered.withColumn("low", low_bin).withColumn("starts", starts).withColumn("stops", stops).withColumn("bounds", bounds).select("page_id", "unit", spaced.alias("tiers"))


def vertical_reorder(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, text): vertical glyphs by tiers, in columns from right to left; horizontal ones as one region; regions by their top."""
    tiers = valley_tiers(glyphs, pages)
    joined = glyphs.join(tiers, "page_id", "left")
    middle = (F.col("y0") + F.col("y1")) / 2
    tier = F.size(F.filter(F.coalesce("tiers", F.array().cast("array<double>")), lambda b: b <= middle))
    column = -F.bround((F.col("x0") + F.col("x1")) / 2 / (F.col("unit") * 0.7))
    region = F.when(F.col("vertical"), tier).otherwise(F.lit(-1))
    key = F.when(F.col("vertical"), F.struct(column.alias("a"), F.col("y0").alias("b"), F.col("ord").alias("o"), F.col("text").alias("t"))).otherwise(F.struct(F.bround("y0").alias("a"), F.col("x0").alias("b"), F.col("ord").alias("o"), F.col("text").alias("t")))
    parts = joined.groupBy("page_id", region.alias("region")).agg(F.min("y0").alias("top"), F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda s: s["t"]), "\u0001").alias("t"))
    text = F.when(F.col("region") < 0, F.replace("t", F.lit("\u0001"), F.lit("\n"))).otherwise(F.replace("t", F.lit("\u0001"), F.lit("")))
    ordered = parts.withColumn("text", text).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("top", "region", "text"))).alias("r"))
    return ordered.select("page_id", F.array_join(F.transform("r", lambda s: s["text"]), "\n\n").alias("text"))


def rules(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, kind, pos, y0, y1): long thin drawings as horizontal or vertical rules."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kind = F.when((w > 0.30 * F.col("width")) & (h < 3), "h").when((h > 0.25 * F.col("height")) & (w < 3), "v")
    marked = drawings.join(pages, "page_id").withColumn("kind", kind).filter("kind is not null")
    return marked.select("page_id", "kind", F.when(F.col("kind") == "h", F.col("y0")).otherwise(F.col("x0")).alias("pos"), "y0", "y1")


def rule_segments(glyphs: DataFrame, ruled: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, place, n, text): regions between rules in reading order: bands downwards, in a band from right to left."""
    heights = ruled.filter("kind = 'h'").groupBy("page_id").agg(F.sort_array(F.collect_list("pos")).alias("hs"))
    none = F.array().cast("array<double>")
    based = pages.join(heights, "page_id", "left")
    edges = F.aggregate(F.coalesce("hs", none), F.array(F.lit(0.0)), lambda kept, y: F.when(y - F.element_at(kept, -1) >= 20, F.concat(kept, F.array(y))).otherwise(kept))
    bands = based.withColumn("edges", edges).select("page_id", F.posexplode("edges").alias("band", "top"), "edges", "height")
    bands = bands.select("page_id", "band", "top", F.coalesce(F.get("edges", F.col("band") + 1), F.col("height")).alias("bottom"))
    walls = ruled.filter("kind = 'v'").select(F.col("page_id").alias("r_page"), F.bround("pos").alias("x"), F.col("y0").alias("r0"), F.col("y1").alias("r1"))
    walled = bands.join(walls, (F.col("page_id") == F.col("r_page")) & (F.col("r0") < F.col("bottom") - 5) & (F.col("r1") > F.col("top") + 5), "left")
    banded = walled.groupBy("page_id", "band", "top", "bottom").agg(F.sort_array(F.collect_set("x")).alias("xs"))
    y, x = (F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2
    placed = glyphs.join(banded, "page_id").filter((y >= F.col("top")) & (y < F.col("bottom"))).withColumn("col", F.size(F.filter("xs", lambda w: w <= x)))
    regions = placed.groupBy("page_id", "band", "col").agg(F.avg(x).alias("cx"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "").alias("text"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("band", F.col("cx").desc()))
    return regions.select("page_id", place.cast("long").alias("place"), "n", "text")


def fit_dpi(dpi: Column, target: Column, size: Column) -> Column:
    return F.greatest(F.lit(72).cast("long"), F.floor(dpi * F.sqrt(target / size)))


def render_budget(requests: DataFrame, budget: int) -> DataFrame:
    """(request, page, target, used, fits) of pages rendered in turn within a byte budget a request.

    Each page may use an equal share of what is left; a page's cost at a resolution follows its area. The allocation
    is sequential by nature, and a request has few pages, so it runs on the request's own ordered array.
    """
    page = F.array_sort(F.collect_list(F.struct("ord", "page", "size", "floor_size")))
    gathered = requests.groupBy("request").agg(page.alias("ps"))
    out = "array<struct<page:bigint,target:bigint,used:bigint,fits:boolean>>"
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.size("ps").cast("long").alias("n"), F.array().cast(out).alias("done"))

    def step(state: Column, p: Column) -> Column:
        target = F.floor(state["left"] / state["n"])
        used = F.when(p["size"] <= target, p["size"]).when(p["floor_size"] <= target, p["floor_size"]).otherwise(F.lit(0).cast("long"))
        row = F.struct(p["page"].alias("page"), target.alias("target"), used.alias("used"), (used > 0).alias("fits"))
        return F.struct((state["left"] - used).alias("left"), (state["n"] - 1).alias("n"), F.concat(state["done"], F.array(row)).alias("done"))

    return gathered.select("request", F.inline(F.aggregate("ps", start, step, lambda s: s["done"])))
