"""Decontamination and weighted fingerprints against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

from quirelake.llm import decontamination, fingerprints
from quirelake.llm.queries import op3_decontamination, op6_fingerprints

SF = "/root/testdata/sf0.001"


def shingle_set(text, n=5):
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def slow_contaminated(docs, items, threshold=0.8):
    found = {}
    for doc_id, text in docs:
        own = shingle_set(text)
        for item_id, item in items:
            parts = shingle_set(item)
            if parts and len(parts & own) / len(parts) >= threshold - 1e-9:
                found[doc_id, item_id] = max(found.get((doc_id, item_id), 0), round(len(parts & own) / len(parts), 6))
    return found


def test_query_equals_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
        got = {(r.doc_id, r.item_id): round(r.containment, 6) for r in op3_decontamination(spark, sf).collect()}
        assert got == slow_contaminated(docs, items)


def test_partial_items_in_long_documents(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(draw.randrange(3, 60)))) for i in range(40)] + [(40, None), (41, "..."), (41, "two words"), (None, "an item with no id at all here")]
    docs = []
    for i, (_, text) in enumerate(items[:40]):
        words = text.split()
        for share in (0.7, 0.8, 0.9, 1.0):
            part = words[: max(1, math.ceil(len(words) * share))]
            docs.append((100 * i + int(share * 10), " ".join([*(word() for _ in range(3000 if i % 9 == 0 else 50)), *part, *(word() for _ in range(40))]).upper()))
    docs += [(9001, None), (9002, ""), (9003, "Two, words!"), (9003, "other"), (None, "so an item with no id at all here it is")]
    d, b = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item string"), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc int")
    want = slow_contaminated(docs, items)
    for limit in (10**6, 0):  # broadcast, and the shuffle beyond the size check
        got = {(r.doc_id, r.item_id): round(r.containment, 6) for r in decontamination.contaminated(d, b, broadcast_rows=limit).collect()}
        assert got == want
    kept = decontamination.remove_contaminated(d, b)
    assert kept.columns == d.columns
    bad = {k for k, _ in want}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in docs if i not in bad), key=repr)
    assert decontamination.contaminated(d.limit(0), b).count() == 0 == decontamination.contaminated(d, b.limit(0)).count()


def weights(text):
    counts = Counter(w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").lower()) if w)
    return {w: 1 + math.log(n) for w, n in counts.items()}


def jaccard(a, b):
    x, y = weights(a), weights(b)
    both = x.keys() | y.keys()
    return sum(min(x.get(w, 0), y.get(w, 0)) for w in both) / sum(max(x.get(w, 0), y.get(w, 0)) for w in both) if both else 1.0


def test_fingerprint_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in op6_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    errors, prints = [], {}
    for (doc_id, text), (_, following) in zip(docs, [*docs[1:], docs[0]], strict=True):
        half, row = len(text) // 2, got[doc_id]
        edited = text[: len(text) - half] + following[:half]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [row.near_edited - jaccard(text, edited), row.near_next - jaccard(text, following)]
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
    # The texts share their frequent words and with them the draws, so the errors aren't independent.
    assert abs(sum(errors) / len(errors)) < 0.05
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.5 / math.sqrt(fingerprints.SAMPLES) * 1.2


def test_likeness_is_unbiased(spark):
    """Pairs of texts with words and counts of their own: the mean error is that of independent samples."""
    draw, docs = random.Random(5), []
    for k in range(150):
        words = [f"{k}x{i}" for i in range(40)]
        for side in range(2):
            docs.append((2 * k + side, " ".join(w for w in words if draw.random() < 0.7 for _ in range(draw.choice([1, 1, 1, 2, 5, 20])))))
    got = {r.doc_id: r.near_next for r in fingerprints.compare_edits(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    errors = [got[i] - jaccard(a, docs[i + 1][1]) for i, a in docs[::2]]
    assert abs(sum(errors) / len(errors)) < 3.5 * 0.5 / math.sqrt(fingerprints.SAMPLES * len(errors))


def test_fingerprint_defined_results(spark):
    rows = [(1, "Alpha beta\tgamma", 1), (2, None, 2), (3, "", 3), (None, "lone", 4), (1, "alpha beta gamma", 5), (1, "alpha beta gamma", 6)]
    got = fingerprints.compare_edits(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((repr(r.doc_id), r.n_chars) for r in got) == [("1", 16), ("1", 16), ("1", 16), ("2", 0), ("3", 0), ("None", 4)]
    of_one = {r.fingerprint for r in got if r.doc_id == 1}
    assert len(of_one) == 1 and len({r.fingerprint for r in got if r.doc_id in (2, 3)}) == 1
    assert next(r for r in got if r.doc_id == 2).near_next == 1.0
    single = spark.createDataFrame([(7, "only one")], "doc_id long, text string")
    row = fingerprints.compare_edits(single).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"onlyonly").hexdigest()
    assert fingerprints.compare_edits(single.limit(0)).count() == 0


def test_string_ids_tell_null_from_empty(spark):
    rows = [("", "one two"), (None, "three four five"), ("a", "six"), ("a:b=", "seven"), ("=", "eight")]
    got = fingerprints.compare_edits(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(((r.doc_id, r.n_chars) for r in got), key=repr) == sorted(((i, len(t)) for i, t in rows), key=repr)
    order = [r for _, r in sorted(((i is not None, i or ""), (i, t)) for i, t in rows)]
    edited = {i: t[: len(t) - len(t) // 2] + after[: len(t) // 2] for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True)}
    assert {r.doc_id: r.edited_sha256 for r in got} == {i: hashlib.sha256(e.encode()).hexdigest() for i, e in edited.items()}


def test_long_text(spark):
    text = " ".join(f"w{i}" for i in range(30_000))
    got = fingerprints.compare_edits(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert {r.near_next for r in got} == {1.0}
