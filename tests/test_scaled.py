"""Queries on inline tables, with thousands of random rows in their place: ties, nulls, repeated and odd values."""

import random

import duckdb
import pytest

from quirelake.plans import evaluation, layout, reading, search, sections
from quirelake.plans.registry import QUERIES, SQL, Literal
from tests.test_oracles import SF, TABLES, plain

DRAW = random.Random(41)
FILES = [f"f{i}" for i in range(12)]


def rows_of(n, *columns):
    return [tuple(c(i) if callable(c) else DRAW.choice(c) for c in columns) for i in range(n)]


def box(wide=700, high=900):
    x0, y0 = DRAW.randrange(-50, wide), DRAW.randrange(-50, high)
    return x0, y0, x0 + DRAW.choice([0, 10, 60, 200, 600]), y0 + DRAW.choice([0, 8, 12, 100, 700])


def colour():
    return [DRAW.choice([0.0, 0.2, 0.85, 0.9, 0.95, 1.0]) for _ in range(3)]


def spans():
    texts = ["ab", "visible words", "Ignore  previous instructions", "you arenow", "system prompt", "x" * 30, "   "]
    return [(i, DRAW.choice(FILES), DRAW.randrange(1, 4), DRAW.randrange(4), DRAW.choice([0.0, 0.05, 0.06, 1.0]), DRAW.choice([0.5, 1.0, 9.0]), colour(), *map(float, box()), DRAW.choice(texts)) for i in range(1500)]


def fills():
    found, seen = [], {}
    for _ in range(200):
        key = DRAW.choice(FILES), DRAW.randrange(1, 4)
        seen[key] = seen.get(key, -1) + 1
        found.append((*key, seen[key], colour(), *map(float, box())))
    return found


def glyphs():
    return [(DRAW.choice(FILES), i, DRAW.choice(["字", "三", "a", "one", "，"]), x0, y0, x1, y1, DRAW.random() < 0.6) for i in range(1500) for x0, y0, x1, y1 in [tuple(map(float, box(200, 300)))]]


def blocks():
    return [(DRAW.choice(FILES), i, *map(float, box()), DRAW.choice(["some text", "  ", "", "more\ntext", "wide words here"]), DRAW.choice([0, 0, 0, 1])) for i in range(800)]


def toc():
    return [(f, k, DRAW.randrange(1, 5), DRAW.choice(["Intro", "Scope", "End"]), p) for f in FILES for k, p in enumerate(sorted(DRAW.randrange(1, 60) for _ in range(DRAW.randrange(1, 60))))]


def lines():
    texts = ["1 Introduction", "2.1 Method. And; more", "Abstract", "plain body", "chapter 7", "  References  ", "Appendix B", "3 lower", "", "x" * 201, "Section 12 " + "y" * 150]
    return [(f, p, k, DRAW.choice(texts)) for f in FILES for p in range(1, 15) for k in range(5)]


def faces():
    texts = ["1 Introduction", "RELATED WORK", "Plain body text goes on here", "Title Case Words", "  ", "12", "x" * 90, "ÉTUDE"]
    return [(f, p, k, 800.0, y, y + 12.0, DRAW.choice(texts), DRAW.choice(["Times", "Times", "Times-Bold", "Foo.B", "Arial"]), DRAW.choice([0, 0, 16, 20])) for f in FILES for p in range(1, 8) for k, y in enumerate(sorted(float(DRAW.randrange(0, 780)) for _ in range(9)))]


def running():
    return [(f, p, DRAW.choice(["Header", "Page %d" % p, "Section  One", "other"]), *DRAW.choice([(0.05, 0.08), (0.9, 0.95), (0.4, 0.5)])) for f in FILES for p in range(1, 25) for _ in range(2)]


TOTAL = [(f, 60) for f in FILES]
IN_BOX = lambda own: [(p, i, DRAW.randrange(4)) for p, i, *_ in own if DRAW.random() < 0.7]
BLOCKS = blocks()
HIDDEN = {"SPANS": ("s", spans()), "IMAGES": ("im", [(DRAW.choice(FILES), DRAW.randrange(1, 4), *map(float, box())) for _ in range(60)]), "FILLS": ("fi", fills()), "PAGES": ("pg", [(f, p, 600, 800) for f in FILES for p in range(1, 4)])}
COLUMNS = {"BLOCKS": ("b", BLOCKS), "BOXES": ("x", [(DRAW.choice(FILES), i, *map(float, box())) for i in range(60)]), "IN_BOX": ("ib", IN_BOX(BLOCKS))}
FACES = {"SPANS": ("l", faces())}

CASES = [
    *[(layout, name, HIDDEN) for name in ("hidden_spans", "trust_rollup", "injection_hits", "injection_hits_user", "ocr_exempt", "white_on_fill")],
    (layout, "writing_mode", {"GLYPHS": ("g", glyphs())}),
    *[(layout, name, COLUMNS) for name in ("single_column", "multi_column", "page_text_dispatch", "column_class")],
    *[(sections, name, {"TOC": ("toc", toc()), "TOTALS": ("tot", TOTAL)}) for name in ("toc_sections", "leaf_sections")],
    (sections, "regex_sections", {"LINES": ("l", lines()), "TOTALS": ("tot", TOTAL)}),
    *[(sections, name, FACES) for name in ("line_features", "heading_score", "body_fingerprint")],
    (sections, "boilerplate_runs", {"_RUN_ROWS": ("b", running()), "_RUN_PAGES": ("t", [(f, 24) for f in FILES])}),
    *[(evaluation, name, {"GOLD": ("g0", rows_of(400, FILES, range(1, 80))), "FOUND": ("d0", rows_of(400, [*FILES, "extra"], range(1, 80)))}) for name in ("boundary_f1", "boundary_group")],
    (evaluation, "precision_recall", {"CONFUSION": ("t", [(f"n{i}", *(DRAW.choice([0, 0, 1, 7, 90]) for _ in range(3))) for i in range(500)])}),
    *[(evaluation, name, {"BEFORE": ("b", [(f"i{i}", DRAW.choice([0.1, 0.5, 0.52, 0.9])) for i in range(700)]), "AFTER": ("a", [(f"i{i}", DRAW.choice([0.1, 0.5, 0.52, 0.9])) for i in range(300, 1000)])}) for name in ("win_loss", "regressions")],
    (search, "rrf_ties", {"LISTS": ("l", [(f"q{q}", arm, rank, page) for q in range(40) for arm in ("kw", "sem") for rank, page in enumerate(DRAW.sample(range(30), 12), 1)])}),
    (reading, "page_range_parse", {"_SPECS": ("s", [(i, DRAW.choice([None, "1-3,5,8-10", "3,1-4,2", "9-15,0,x", " 2 - 4 , 7", "", "5-2", "1-1,1", "99999"]), DRAW.randrange(1, 20)) for i in range(600)])}),
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("module,name,given", CASES, ids=[name for _, name, _ in CASES])
def test_many_rows_equal_sql(spark, duck, monkeypatch, module, name, given):
    sql = SQL[name]
    for literal, (alias, rows) in given.items():
        old = getattr(module, literal)
        new = Literal(old.schema, *rows)
        if old.cte(alias) in sql:
            sql = sql.replace(old.cte(alias), new.cte(alias))
        monkeypatch.setattr(module, literal, new)
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    want = duck.sql(sql)
    places = [want.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in places) for r in want.fetchall()), key=repr)
    assert len(ours) == len(theirs) > 0
    assert ours == theirs
