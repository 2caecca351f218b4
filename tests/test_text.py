"""Text functions and operators on small values."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as tx
from quirelake.operators import layout, paging, search, sections
from quirelake.plans import layout as geometry
from quirelake.sources import decoders


def fts_stems(words):
    """Stems by the full-text tokenizer of the standard library's database."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(w, tokenize='porter ascii')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    out = {}
    for w in words:
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (w,))
        out[w] = con.execute("SELECT term FROM v").fetchone()[0]
    return out


def test_porter_stems():
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing failing filing happy sky relational conditional rational digitizer radically differently analogously operator feudalism decisiveness hopefulness formality sensitivity sensibility triplicate formative formalize electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate effective probate rate cease controlling roll managing management managed running run generalization oscillators".split()
    want = fts_stems(words)
    assert {w: tx.porter_stem(w) for w in words} == want


@pytest.mark.parametrize("limit", range(0, 14))
def test_utf8_truncate(spark, limit):
    texts = ["aé日本😀z", "", "plain", "😀😀😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.utf8_truncate(F.col("t"), limit).alias("c"))
    assert {r.t: r.c for r in df.collect()} == {t: t.encode()[:limit].decode(errors="ignore") for t in texts}


def test_escape_cjk_phrases(spark):
    df = spark.createDataFrame([("機械 learning",), ("()",)], "q string").select(tx.escape_query_cjk(F.col("q")).alias("m"))
    assert [r.m for r in df.collect()] == ['"機 械" "learning"', tx.NO_MATCH]


def test_bm25_prefers_frequent(spark):
    pages = [(i, "alpha " * (10 if i == 4 else 1 if i == 0 else 0) + "filler words here") for i in range(6)]
    hits = search.top(search.bm25(spark.createDataFrame(pages, "page_id long, text string"), "alpha"), 5, "page_id").collect()
    assert [r.page_id for r in hits] == [4, 0]


def test_bm25_stems(spark):
    pages = spark.createDataFrame([(0, "management of risk"), (1, "managing it"), (2, "nothing")], "page_id long, text string")
    assert {r.page_id for r in search.full_text(pages, "managed").collect()} == {0, 1}
    assert search.bm25(pages, "managed").count() == 0 == search.bm25(pages, "  ").count()


def test_chunks_cover_the_text(spark):
    text = "One sentence here. " * 200
    rows = paging.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k long, t string"), key="k", text="t", max_tokens=100, overlap_tokens=10).orderBy("chunk").collect()
    assert {r.k for r in rows} == {1} and rows[0].start == 0 and rows[-1].stop == len(text)
    assert all(a.stop - 40 == b.start and a.body.endswith(".") for a, b in zip(rows, rows[1:], strict=False))
    with pytest.raises(ValueError):
        paging.chunks(spark.range(1), key="id", text="id", max_tokens=5, overlap_tokens=5)


def test_byte_cap_stops_at_first_overflow(spark):
    parts = spark.createDataFrame([("f", i, n) for i, n in enumerate([0, 40, 70, 5])], "f string, o long, n long")
    kept = paging.byte_cap(parts, by="f", order="o", size=F.col("n"), cap=100).orderBy("o").collect()
    assert [r.kept for r in kept] == [True, True, False, False] and [r.running for r in kept] == [0, 40, 112, 119]


def test_several_headings_on_a_page_have_empty_text(spark):
    s = spark.createDataFrame([("f", 0, 2, 1)], "file_path string, ord long, start_page long, end_page long")
    pages = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b")], "file_path string, page_num long, text string")
    assert sections.section_text(s, pages).first().text == ""


def test_vertical_text_reads_in_columns(spark):
    got = {r.page_id: r.text for r in layout.vertical_reorder(geometry.GLYPHS.df(spark), geometry.GLYPH_PAGES.df(spark)).collect()}
    # Two tiers; in each the columns at x 160, 100 and 40, from the top.
    column = {(x, y): chr(0x4E00 + i) for i, (p, x, y) in enumerate(geometry._COLUMNS) if p == "v"}
    tiers = ["".join(column[x, y] for x in (160, 100, 40) for y in ys) for ys in (range(10, 120, 10), range(180, 290, 10))]
    assert got["v"] == "\n\n".join(tiers) and got["h"] == "one\ntwo\n三"


def test_rule_segments_lose_no_glyph(spark):
    pages, glyphs = geometry.GLYPH_PAGES.df(spark), geometry.GLYPHS.df(spark)
    parts = layout.rule_segments(glyphs, layout.rules(geometry.DRAWINGS.df(spark), pages), pages)
    assert parts.agg(F.sum("n")).first()[0] == glyphs.count()


def test_poison_file_gives_a_row(spark, tmp_path):
    (tmp_path / "good.txt").write_bytes(b"one\x0ctwo")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    rows = decoders.decode(decoders.read_files(spark, str(tmp_path), "*.txt"), decoders.plain_text).collect()
    assert sorted((r.page_num, r.text) for r in rows if r.error is None) == [(0, "one"), (1, "two")]
    assert sum(r.error is not None for r in rows) == 1
