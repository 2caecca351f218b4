"""Full-text search and snippets against SQLite's full-text index."""

import random
import sqlite3

import pytest

from quirelake.operators import search as op
from quirelake.plans.search import STEMMED, file_search

SF = "/root/testdata/sf0.01"


def index(rows):
    connection = sqlite3.connect(":memory:")
    try:
        connection.execute("CREATE VIRTUAL TABLE t USING fts5(file UNINDEXED, page UNINDEXED, text, tokenize = 'porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text index")
    connection.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    return connection


def asked(query):
    return " ".join(f'"{w}"' for w in query.split())


def test_scores_equal_the_index(spark):
    rows = [(r.source, r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [("made", 10**6, "Managing managers manage well-known Cafés. RFC-2119 it is: a well known café"), ("made", 10**6 + 1, "managed known, well"), ("made", 10**6 + 2, "")]
    connection = index(rows)
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string")
    for query in (STEMMED, "managing", "cafe well-known", "RFC-2119", "the", "manager nowhere", "les anderen"):
        for file in (None, "src3", "made"):
            where = "" if file is None else f" AND file = '{file}'"
            want = {page: -score for page, score in connection.execute(f"SELECT page, bm25(t) FROM t WHERE t MATCH ?{where}", [asked(query)])}
            got = {r.doc_id: r.score for r in op.full_text(docs, query, key="doc_id", file="source", only=file).collect()}
            assert got.keys() == want.keys(), query
            assert all(abs(got[k] - want[k]) <= 1e-6 + 1e-9 * want[k] for k in want), query
    assert op.full_text(docs, ' "() ', key="doc_id").count() == 0


def test_snippets_equal_the_index(spark):
    draw = random.Random(3)
    words = ["alpha", "beta", "gammas", "delta", "one", "two", "three", "four", "x-y", "Ünder"]
    texts = [" ".join(draw.choice(words) + draw.choice(["", "", "", ".", ":", ",", "\n"]) for _ in range(draw.randrange(1, 60))) for _ in range(150)]
    rows = [("f", k, t) for k, t in enumerate(texts)]
    connection = index(rows)
    for query in ("alpha", "beta gamma", "one two", "x-y under"):
        for chars in (5, 40, 400):
            want = dict(connection.execute("SELECT page, snippet(t, 2, '', '', '...', ?) FROM t WHERE t MATCH ?", [max(4, min(64, chars // 5)), asked(query)]))
            hits = spark.createDataFrame([(k, texts[k]) for k in want], "doc_id long, text string")
            got = {r.doc_id: r.snippet for r in op.snippets(hits, query, context_chars=chars).collect()}
            assert got == want


def test_file_search(spark):
    rows = [(r.source, r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = list(index(rows).execute("SELECT page, round(-bm25(t), 4), snippet(t, 2, '', '', '...', 20) FROM t WHERE t MATCH ? AND file = 'src3' ORDER BY round(bm25(t), 9), page LIMIT 5", [asked(STEMMED)]))
    got = sorted((-r.score, r.page_id, r.snippet) for r in file_search(spark, SF).collect())
    assert want and [(p, s) for _, p, s in got] == [(p, s) for p, _, s in want]
