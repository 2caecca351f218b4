"""Mixing, WARC archives and chat formatting: contracts, round trips and defined results."""

import base64
import gzip
import hashlib
import io
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quirelake.llm import chat, mixing, warc
from quirelake.llm.queries import op8_mixing, op9_warc, op10_chat, quality_weights

SF = "/root/testdata/sf0.001"


def slow_targets(sizes):
    """By the contract's words: share by weight, hold at three times the size, share the excess again until none is above."""
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, target, open_ = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = float(total)
    while True:
        whole = sum(weight[n] for n in open_)
        share = {n: left * weight[n] / whole for n in open_}
        above = [n for n in open_ if share[n] > 3 * sizes[n] + 1e-9]
        if not above:
            return target | share
        for n in above:
            target[n] = 3.0 * sizes[n]
            open_.discard(n)
            left -= target[n]


def check_mix(rows):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = slow_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
    for source, target in want.items():
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) / 2 + 1e-6


def test_mixing_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op8_mixing(spark, SF).collect()
    assert {r.doc_id: r.size for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0d]+", d.text or "")) for i, d in docs.items()}
    assert sorted(map(tuple, got)) == sorted(map(tuple, op8_mixing(spark, SF).collect()))


def test_mixing_query_equals_slow_selection(spark):
    """The whole query against a sort of every source by its keys."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = quality_weights(spark, sf).groupBy("doc_id").agg(F.max("quality").alias("q"))
    key = mixing.es_key(F.col("doc_id"), F.xxhash64("text"), F.coalesce("q", F.lit(1.0)), 17)
    rows = docs.join(scores, "doc_id", "left").select("doc_id", "source", key.alias("key"), mixing.word_count(F.col("text")).alias("size")).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = {}
    for source, target in slow_targets(sizes).items():
        epochs = min(3, int(target / sizes[source] + 1e-12))
        budget, upto = target - epochs * sizes[source], 0
        for r in sorted((r for r in rows if r.source == source), key=lambda r: r.key):
            upto += r.size
            want[r.doc_id] = (epochs + (budget > 0 and upto - r.size / 2 < budget)) * r.size
    assert {r.doc_id: r.taken for r in op8_mixing(spark, sf).collect()} == want


@pytest.mark.parametrize("edge_rows", [0, 3, 100_000])
def test_mixing_contract(spark, edge_rows):
    draw = random.Random(4)
    rows = [(i, " ".join(["w"] * draw.choice([1, 2, 5, 40, 300])), "c") for i in range(60)] + [(100 + i, "w w w", "a") for i in range(5)] + [(200, "", "b"), (201, None, "b"), (300, "lone word", None), (301, "x " * 20_000, "d"), (None, "w w", "e"), (5, "same", "f"), (5, "same", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("doc_id", "doc_id")
    got = mixing.mix(docs, edge_rows=edge_rows).collect()
    assert len(got) == len(rows)
    check_mix(got)
    if edge_rows == 100_000:
        repeated = mixing.repeat_by_mix(docs, mixing.mix(docs))
        assert repeated.columns == docs.columns
        assert repeated.filter("source = 'c'").count() == sum(r.copies for r in got if r.source == "c")
        assert mixing.mix(docs.limit(0)).count() == 0
    else:
        assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs).collect()))


def test_equal_rows_come_as_often_as_the_mix_holds_them(spark):
    """400 equal rows of 5 words and a source that takes most of the whole: a target of 3,200 words, 640 copies."""
    rows = [(7, "a b c d e", "x", "row", 1) for _ in range(400)] + [(1000 + i, "w " * 1200, "y", "n", 2) for i in range(1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, n long").repartition(7)
    mixed = mixing.mix(docs, weights=(3200.0, 0.0001))
    target = {r.source: r.target for r in mixed.collect()}["x"]
    assert abs(target - 3200) < 1
    out = mixing.repeat_by_mix(docs, mixed)
    assert out.columns == docs.columns
    assert out.filter("source = 'x'").count() * 5 == 3200


def test_quality_is_preferred(spark):
    docs = spark.createDataFrame([(i, "w w", "ab"[i < 1000]) for i in range(2000)], "doc_id long, text string, source string")
    quality = spark.createDataFrame([(i, 5.0 if i % 2 else 1.0) for i in range(2000)], "doc_id long, quality double")
    chosen = [r for r in mixing.mix(docs, quality=quality).collect() if r.source == "b" and r.copies]
    assert 560 < len(chosen) < 580  # 2 / 7 of the whole is 4 / 7 of the source
    assert sum(r.doc_id % 2 for r in chosen) > 0.6 * len(chosen)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def slow_archive(rows):
    first = {}
    for page_id, html in rows:
        first.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, html in rows:
        least = min(first[html or ""])
        out.append((page_id, len((html or "").encode()), digest(html), "response" if page_id == least else "revisit", None if page_id == least else least))
    return sorted(out)


def test_warc_query(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(tuple(r) for r in op9_warc(spark, SF).collect()) == slow_archive(rows)


def test_warc_defined_results(spark):
    rows = [(4, "u", "<p>same é</p>", 1), (2, None, "<p>same é</p>", 2), (9, "http://x/ y\r\nz", "", 3), (8, "u", None, 4), (7, "u", "a\x1f\x8b\x08b" * 5, 5), (6, "u", "long " * 300_000, 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    found = warc.archive_round_trip(pages)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()))
    assert got == slow_archive([(r[0], r[2]) for r in rows])
    none = warc.archive_round_trip(pages, revisit_bytes=10**9)
    assert {r.record_type for r in none.collect()} == {"response"}
    twice = [r.record_type for r in warc.archive_round_trip(pages.filter("page_id = 7").unionAll(pages.filter("page_id = 7"))).collect()]
    assert sorted(twice) == ["response", "revisit"]
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("step", [1, 37, 1000, 10**9])
def test_every_split_owns_its_records(step):
    """Any cut into ranges reads each record once, also past bytes that look like a member and past damage."""
    members = [warc.record("response", i, "http://x", f"body {i} ".encode() * (i * 40 % 90), "D") for i in range(12)]
    trap = warc.record("response", 99, "u", gzip.compress(b"not a record") + warc.GZIP_MAGIC * 3, "D")
    data = b"".join([*members[:5], trap, warc.GZIP_MAGIC + b"junk", *members[5:]])
    got = []
    for start in range(0, len(data), step):
        got += [warc._urn(r["fields"]["WARC-Record-ID"]) for _, r in warc.records_in_range(io.BytesIO(data), start, min(start + step, len(data)), len(data))]
    assert got == [*range(5), 99, *range(5, 12)]


def slow_chat(turns):
    whole = "".join(f"{role}\n{text}\n" for role, text in turns)
    loss = "".join(text for role, text in turns if role == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_query(spark):
    talks = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op10_chat(spark, SF).collect()}
    assert got == {k: slow_chat(v) for k, v in talks.items()}


PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "&", "&amp;", "&lt;", "&lsb;", "\n", "[/INST]</s>", "[INST] ", "<", "[", "]", "😀", "é", "assistant", " ", "\\", "&nl;", "$1", ""]


def test_chat_round_trip(spark):
    draw = random.Random(6)
    rows = [(c, t, draw.choice(["user", "assistant", "system", "odd\nrole", "", None, "[/INST]</s>"]), None if draw.random() < 0.05 else "".join(draw.choice(PARTS) for _ in range(draw.randrange(8))), "x") for c in range(300) for t in range(draw.randrange(1, 5))]
    rows += [(None, 0, "user", "hi", "x"), (900, 1, "user", "same", "x"), (900, 1, "user", "same", "x"), (901, None, "assistant", "long " * 50_000 + "</s>", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_conversations(table)
    got = {r.conv_id: r for r in chat.digests(done).collect()}
    talks = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (repr(r[0]), -1 if r[1] is None else r[1])):
        talks.setdefault(conv, []).append((role or "", text or ""))
    for conv, turns in talks.items():
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == slow_chat(turns), json.dumps(turns)
    for r in done.collect():
        assert r.formatted.startswith(chat.OPEN) and r.formatted.endswith(chat.CLOSE)
        texts = [text for role, text in talks[r.conv_id] if role == "assistant"]
        spans = [r.formatted[s.start : s.stop] for s in r.loss_spans]
        assert [s.replace("&lt;", "<").replace("&lsb;", "[").replace("&nl;", "\n").replace("&amp;", "&") for s in spans] == texts
    assert chat.digests(chat.format_conversations(table.limit(0))).count() == 0


def test_clashing_columns_and_string_ids(spark):
    """Columns with the names that helpers use, and ids that are texts."""
    from quirelake.llm import decontamination, resemblance, simhash

    rows = [("a", "one two three four five six seven", "s", 1), ("b", "one two three four five six seven", "s", 2), ("", "other words entirely here and there now", "t", 3), (None, "x " * 50, "t", 4)]
    names = ["doc_id", "text", "source", "row"]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, row long").selectExpr(*names, *[f"{k} AS `{n}`" for k, n in enumerate(("id", "digest", "m_id", "n", "k_id", "_bad_id", "item", "fp", "copies", "part", "key", "component", "m_sum"))])
    for find in (simhash.near_duplicates, resemblance.near_duplicates):
        kept = simhash.keep_one(docs, find=find)
        assert kept.columns == docs.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, ("a", "", None)))
    items = spark.createDataFrame([("i", "words entirely here and there now")], "item_id string, text string")
    clean = decontamination.remove_contaminated(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {"a", "b", None}
    mixed = mixing.mix(docs)
    out = mixing.repeat_by_mix(docs, mixed)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixed.collect())


def test_long_texts(spark):
    from quirelake.llm import sstable, toxicity
    from quirelake.llm.queries import tokenizer_path

    text = "some rather long words " * 40_000
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, text + "x" * 200_000)], "doc_id long, text string")
    sizes = {r.doc_id: r.n_tokens for r in sstable.token_table(docs, tokenizer_path()).collect()}
    assert sizes[1] > 160_000 and sizes[3] > sizes[1]
    model = toxicity.fit_rows(["good day", "bad idiot"] * 5, [0, 1] * 5)
    assert len(toxicity.score(docs, model).collect()) == 3
    html = spark.createDataFrame([(1, "u", text), (2, "v", text)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_round_trip(html).collect()}
    assert got[1].record_type == "response" and got[2].refers_to == 1 and got[2].payload_bytes == len(text)


def test_equal_pages_have_one_response(spark):
    rows = [(1, "b", "same"), (1, "a", "same"), (2, "c", "same"), (None, "d", "same"), (None, "e", "lone"), (None, "f", "lone"), (3, "g", None), (4, "h", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for limit in (10**6, 0):  # broadcast, and the shuffle beyond the size check
        got = warc.assign_revisits(pages, broadcast_rows=limit).collect()
        assert sorted((r.url, r.revisit, r.refers_to) for r in got) == [("a", False, None), ("b", True, 1), ("c", True, 1), ("d", True, 1), ("e", False, None), ("f", True, None), ("g", False, None), ("h", True, 3)]
    short = warc.assign_revisits(pages, revisit_bytes=5).collect()
    assert len(short) == len(rows) and not any(r.revisit for r in short)


def test_sweep(spark):
    from quirelake.llm.common import stored, sweep

    table = stored(spark.range(3), "swept")
    assert table.count() == 3
    sweep(spark, 1.0)
    assert table.count() == 3
    assert sweep(spark, -1.0) >= 1


def test_rows_without_a_conversation(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "c")]
    got = chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted((r.conv_id is None, r.n_turns) for r in got) == [(False, 1), (True, 1), (True, 1), (True, 1)]
