"""Search: BM25, vectors, rank fusion, fallback search, excerpts."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

K1, B, RRF_K = 1.5, 0.75, 60


def query_words(query: str) -> list[str]:
    """The query in the same tokens as the texts, with repetition."""
    return re.sub(r"[^\w\s\-]", " ", query.lower()).split()


def bm25(docs: DataFrame, query: str, *, key: str = "page_id", text: str = "text", scope: list[str] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(key, scope columns, score) of the texts that hold a query word; texts without words count for nothing, rows of one
    key count as one text. scope: columns whose values have statistics of their own (else the whole table's)."""
    wanted, scope = Counter(query_words(query)), scope or []
    if not wanted:
        return docs.select(key, *scope, F.lit(0.0).alias("score")).limit(0)

    def facts(tokens: Column) -> Column:
        counts = [(F.size(tokens) - F.size(F.array_remove(tokens, F.lit(w)))).cast("long").alias(f"tf{i}") for i, w in enumerate(wanted)]
        return F.struct(F.size(tokens).cast("long").alias("dl"), *counts)

    # A generator, below which no filter can be pushed: so a text is cut into words once.
    words = F.filter(F.array(tx.word_tokens(F.col(text))), lambda t: F.size(t) > 0)
    counted = docs.select(key, *scope, F.inline(F.transform(words, facts)))
    return _scored(counted, list(wanted.values()), key, scope, k1, b, lambda n, df: F.log((n - df + 0.5) / (df + 0.5) + 1)).drop("tfs")


def _scored(counted: DataFrame, repeats: list[int], key: str, scope: list[str], k1: float, b: float, idf) -> DataFrame:
    """(key, scope, score, tfs) from counted(key, scope, dl, tf0, tf1, ...).

    Texts without a hit are summed up before the shuffle, by task; hits and these sums make the statistics, and the
    hits are scored by them, from one exchange that both sides read.
    """
    tfs = [f"tf{i}" for i in range(len(repeats))]
    hit = F.lit(False)
    for c in tfs:
        hit = hit | (F.col(c) > 0)
    named = counted.withColumn("hit", hit).withColumn("h_key", F.when(F.col("hit"), F.col(key)))
    sums = [F.sum("dl").alias("dl"), F.count("*").alias("n"), F.max("hit").alias("is_hit"), *[F.sum(c).alias(c) for c in tfs]]
    small = named.groupBy(*scope, "hit", "h_key").agg(*sums)
    facts = [F.sum(F.when(F.col("is_hit"), 1).otherwise(F.col("n"))).alias("texts"), F.sum("dl").alias("all_dl"), *[F.count_if(F.col(c) > 0).alias(f"df{i}") for i, c in enumerate(tfs)]]
    if scope:
        stats = small.groupBy(*[F.col(c).alias(f"s_{c}") for c in scope]).agg(*facts)
        joined = small.join(stats, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in scope])
    else:
        joined = small.join(F.broadcast(small.agg(*facts)), how="cross")  # one row
    joined = joined.filter(F.col("is_hit") & (F.col("n") > 0))
    score, avgdl = F.lit(0.0), F.col("all_dl") / F.col("texts")
    for i, times in enumerate(repeats):
        tf = F.col(f"tf{i}")
        score = score + times * idf(F.col("texts"), F.col(f"df{i}")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / avgdl))
    return joined.select(F.col("h_key").alias(key), *scope, score.alias("score"), F.array(*tfs).alias("tfs")).filter("score > 0")


def _folded() -> tuple[str, str]:
    """Latin letters with marks, and what they are without."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folded()


def text_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, Latin letters without their marks: the words of the full-text index."""
    plain = F.translate(F.lower(F.translate(text, _MARKED, _PLAIN)), _MARKED, _PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def query_phrases(query: str) -> list[list[str]]:
    """The query's words, each a phrase of stems: words that punctuation divides must stand side by side."""
    cleaned = [re.sub(tx.RESERVED, "", w) for w in query.split()]
    tokens = [re.findall(r"[^\W_]+", w.translate(str.maketrans(_MARKED, _PLAIN)).lower()) for w in cleaned]
    return [[tx.porter_stem(t) for t in phrase] for phrase in tokens if phrase]


def full_text(docs: DataFrame, query: str, *, key: str = "page_id", text: str = "text", file: str | None = None, only: str | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, file, score) of the texts that hold every word of the query, by Porter stems.

    Statistics are those of the whole table; ``only`` keeps the hits of one file (a value of the column ``file``)
    afterwards. A word that more than half of the texts hold weighs next to nothing, not less than nothing.
    """
    phrases, shown = query_phrases(query), [file] if file else []
    if not phrases:
        return docs.select(key, *shown, F.lit(0.0).alias("score")).limit(0)
    starts = sorted({s[: max(1, len(s) - 1)] for p in phrases for s in p})
    single, stem = all(len(p) == 1 for p in phrases), tx.porter_stem

    def begins(t: Column) -> Column:
        # A stem's words begin as the stem does, but for its last letter.
        found = F.lit(False)
        for s in starts:
            found = found | F.startswith(t, F.lit(s))
        return found

    def facts(tokens: Column) -> Column:
        sent = F.filter(tokens, begins) if single else F.when(F.exists(tokens, begins), tokens)
        return F.struct(F.size(tokens).cast("long").alias("dl"), sent.alias("tokens"))

    def run(batches):
        import pyarrow as pa

        known: dict[str, str] = {}

        def count(tokens: list[str] | None) -> list[int]:
            if len(known) > 200_000:
                known.clear()
            stems = [known.get(t) or known.setdefault(t, stem(t)) for t in tokens or ()]
            return [sum(stems[i : i + len(p)] == p for i in range(len(stems) - len(p) + 1)) for p in phrases]

        for batch in batches:
            found = [count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([f[i] for f in found], pa.int64()) for i in range(len(phrases))]], [*batch.schema.names[:2], *[f"tf{i}" for i in range(len(phrases))]])

    named = docs.select(key, F.inline(F.transform(F.array(text_tokens(F.coalesce(F.col(text), F.lit("")))), facts)))
    counted = named.mapInArrow(run, f"`{key}` {named.schema[key].dataType.simpleString()}, dl long" + "".join(f", tf{i} long" for i in range(len(phrases))))
    scored = _scored(counted, [1] * len(phrases), key, [], k1, b, lambda n, df: F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6)))
    whole = scored.filter(F.forall("tfs", lambda t: t > 0)).drop("tfs")
    if not file:
        return whole
    files = docs.select(F.col(key).alias("f_key"), file)
    files = files if only is None else files.filter(F.col(file) == only)
    return whole.join(files, F.col(key) == F.col("f_key")).select(key, file, "score")


def snippets(hits: DataFrame, query: str, *, text: str = "text", context_chars: int = 200) -> DataFrame:
    """hits with `snippet`: the window of context_chars // 5 words (4 to 64) with the most of the query's words, best at the
    start of the text or a sentence. hits: a short list of texts that hold every word of the query."""
    phrases, width, stem = query_phrases(query), max(4, min(64, context_chars // 5)), tx.porter_stem
    at = hits.columns.index(text)
    folding = str.maketrans(_MARKED, _PLAIN)

    def cut(body: str) -> str:
        places = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", body)]
        stems = [stem(body[i:j].translate(folding).lower()) for i, j in places]
        found = sorted((i, k) for k, p in enumerate(phrases) for i in range(len(stems) - len(p) + 1) if stems[i : i + len(p)] == p)
        sentences = [k for k, (i, _) in enumerate(places) if k == 0 or re.search(r"[.:][ \t\r\n]+$", body[:i])]

        def value(start: int) -> tuple[int, int]:
            """(score, the start that centres what the window holds)."""
            inside = [(i, k) for i, k in found if start <= i < start + width]
            score = sum(1000 if k not in {other for _, other in inside[:n]} else 1 for n, (_, k) in enumerate(inside))
            last = inside[-1][0] + len(phrases[inside[-1][1]])
            centred = inside[0][0] - int((width - (last - inside[0][0])) / 2)
            return score, max(0, min(centred, len(stems) - width))

        best, start = 0, 0
        for i, _ in found:
            score, centred = value(i)
            if score > best:
                best, start = score, centred
            earlier = [s for s in sentences if s <= i]
            if earlier and earlier[-1] < i and len(stems) > width and found and any(earlier[-1] <= f < earlier[-1] + width for f, _ in found):
                score = value(earlier[-1])[0] + (120 if earlier[-1] == 0 else 100)
                if score > best:
                    best, start = score, earlier[-1]
        if not places:
            return body
        stop = start + width
        head = "..." + body[places[start][0] :] if start > 0 else body
        cut_off = len(head) - (len(body) - places[stop - 1][1]) if stop < len(places) else len(head)
        return head[:cut_off] + ("..." if stop < len(places) else "")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = pa.array([None if t is None else cut(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "snippet"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema)
    return hits.mapInArrow(run, f"{schema}, snippet string")


def top(hits: DataFrame, k: int, key: str, score: str = "score") -> DataFrame:
    """The k best by score, ties by key. Scores are compared at 9 digits, where the order of summing can't show."""
    return hits.orderBy(F.round(score, 9).desc(), key).limit(k)


def ranked(hits: DataFrame, key: str, score: str = "score") -> DataFrame:
    """With the 1-based rank; for lists that are already cut to their top."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.round(score, 9).desc(), key)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def candidate_width(max_results: int) -> int:
    """How many hits of each list are fused for so many results."""
    return min(3 * max_results, 100)


def semantic(vectors: DataFrame, probe: DataFrame, *, key: str = "vec_id", vector: str = "embedding", normalise: bool = False) -> DataFrame:
    """(key, score): dot products with the one vector of probe; of vectors brought to length 1 first, if asked for."""
    one = F.broadcast(probe.select(F.col(vector).alias("_probe")))
    score = dot(F.col(vector), F.col("_probe"))
    if normalise:
        length = F.sqrt(dot(F.col(vector), F.col(vector)) * dot(F.col("_probe"), F.col("_probe")))
        score = F.when(length > 0, score / length).otherwise(0.0)
    return vectors.join(one, how="cross").select(key, score.alias("score"))


def fuse(lists: DataFrame, *, by: list[str] | None = None, key: str = "page", k: int = RRF_K) -> DataFrame:
    """(by, key, rrf) of ranked lists (by, arm, rank, key): the sum of 1 / (k + rank) over the lists that have the key."""
    by = by or []
    return lists.groupBy(*by, key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def best_paragraph(blocks: DataFrame, query: str, *, by: list[str], order: str, text: str, min_chars: int = 1, cap: int = 2000) -> DataFrame:
    """(by, block, score, paragraph): the block with the most query tokens, the first on ties; null text if too long."""
    words = [w.strip(".,;:!?\"'()[]{}") for w in query.lower().split()]
    low, score = F.lower(F.col(text)), F.lit(0)
    for w in [w for w in words if w]:
        score = score + F.contains(low, F.lit(w)).cast("int")
    scored = blocks.filter(F.char_length(tx.strip(F.col(text))) >= min_chars).withColumn("_s", score).filter("_s > 0")
    best = scored.groupBy(*by).agg(F.max_by(F.struct(F.col(order).alias("block"), F.col(text).alias("t")), F.struct(F.col("_s"), -F.col(order))).alias("b"), F.max("_s").alias("score"))
    return best.select(*by, F.col("b.block").alias("block"), "score", F.when(F.char_length("b.t") <= cap, F.col("b.t")).alias("paragraph"))


def upgraded_excerpts(matches: DataFrame, blocks: DataFrame, query: str, *, min_chars: int = 80, cap: int = 2000) -> DataFrame:
    """(page, block, score, excerpt) of matches(page, score, excerpt): each excerpt becomes the block it stands in.

    The first block that holds the excerpt, less its dots, if that block isn't too long; else the block with the most query
    words. If the choice is shorter than min_chars, the best block of at least as many is taken where there is one. Matches
    of one block become one, with the best score. Without a block the excerpt stays. matches: a short list;
    blocks: (page, block, text).
    """
    listed = matches.withColumn("fragment", tx.strip(F.replace("excerpt", F.lit("..."), F.lit(""))))
    wanted = F.broadcast(matches.select(F.col("page").alias("w_page")).distinct())
    held = blocks.join(wanted, F.col("page") == F.col("w_page")).drop("w_page")
    b = held.select(F.col("page").alias("b_page"), F.col("block").alias("b_block"), F.col("text").alias("b_text"))
    inside = F.broadcast(listed.filter("fragment <> ''")).join(b, (F.col("page") == F.col("b_page")) & F.contains("b_text", F.col("fragment")))
    first = inside.groupBy("page", "fragment").agg(F.min_by(F.struct(F.col("b_block").alias("block"), tx.strip(F.col("b_text")).alias("text")), "b_block").alias("own"))
    first = first.select(F.col("page").alias("o_page"), F.col("fragment").alias("o_fragment"), F.when(F.char_length("own.text") <= cap, F.col("own")).alias("own"))

    def best(least: int, name: str) -> DataFrame:
        found = best_paragraph(held, query, by=["page"], order="block", text="text", min_chars=least, cap=cap)
        return found.select(F.col("page").alias(f"{name}_page"), F.when(F.col("paragraph").isNotNull(), F.struct("block", tx.strip(F.col("paragraph")).alias("text"))).alias(name))

    joined = listed.join(first, (F.col("page") == F.col("o_page")) & (F.col("fragment") == F.col("o_fragment")), "left")
    joined = joined.join(best(1, "most"), F.col("page") == F.col("most_page"), "left").join(best(min_chars, "long"), F.col("page") == F.col("long_page"), "left")
    choice = F.coalesce("own", "most")
    chosen = F.when((F.char_length(choice["text"]) < min_chars) & F.col("long").isNotNull(), F.col("long")).otherwise(choice)
    placed = joined.withColumn("c", chosen)
    plain = placed.filter("c IS NULL").select("page", F.lit(None).cast("long").alias("block"), "score", "excerpt")
    upgraded = placed.filter("c IS NOT NULL").groupBy("page", F.col("c.block").cast("long").alias("block")).agg(F.max("score").alias("score"), F.first("c.text").alias("excerpt"))
    return upgraded.unionByName(plain)


def titled_hits(hits: DataFrame, sections: DataFrame) -> DataFrame:
    """Section hits (file_path, section_id, title, ...) with the titles as they stand in sections, where these have one: an
    index that holds texts split into characters gives back split titles."""
    own = sections.select(F.col("file_path").alias("s_file"), F.col("section_id").alias("s_id"), F.col("title").alias("s_title"))
    joined = hits.join(own, (F.col("file_path") == F.col("s_file")) & (F.col("section_id") == F.col("s_id")), "left")
    return joined.select(*[F.coalesce("s_title", "title").alias(c) if c == "title" else F.col(c) for c in hits.columns])


def auto_search(docs: DataFrame, query: str, vectors: DataFrame | None, probe: DataFrame | None, *, key: str = "doc_id", k: int = 10, width: int = 30) -> DataFrame:
    """(key, score, search_mode, reason): keyword and vector ranks fused; where there is no model or it gives no vectors,
    the keyword ranks alone, and the reason why."""
    hits = top(bm25(docs, query, key=key), width, key)
    if vectors is None or probe is None:
        reason = "no embedding model"
    elif probe.isEmpty():
        reason = "the query has no vector"
    elif vectors.isEmpty():
        reason = "no page has a vector"
    else:
        lists = [ranked(hits, key).select(F.col(key).alias("page"), "rank"), ranked(top(semantic(vectors, probe), width, "vec_id"), "vec_id").select(F.col("vec_id").alias("page"), "rank")]
        fused = top(fuse(lists[0].unionAll(lists[1])), k, "page", "rrf")
        return fused.select(F.col("page").alias(key), F.col("rrf").alias("score"), F.lit("hybrid").alias("search_mode"), F.lit(None).cast("string").alias("reason"))
    return top(hits, k, key).select(key, "score", F.lit("keyword").alias("search_mode"), F.lit(reason).alias("reason"))
