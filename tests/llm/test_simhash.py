"""SimHash: fingerprints and components against brute force."""

import random
from itertools import combinations

import numpy as np
import xxhash

from quirelake.llm import simhash
from quirelake.llm.queries import op4_simhash


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(ids, fps, bits=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= bits:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: min(groups[find(i)]) for i in range(len(fps))}


def test_cover_loses_no_four_positions():
    triples = simhash.cover()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    ids, fps = [r.doc_id for r in docs], [slow_fingerprint(r.text) for r in docs]
    want = slow_components(ids, fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op4_simhash(spark, sf).collect()}
    assert got == {i: (f"{fp:016x}", want[i]) for i, fp in zip(ids, fps, strict=True)}


def near_group(count, seed):
    """Fingerprints in a few tight groups, so that posting lists are long."""
    draw = random.Random(seed)
    found = set()
    centres = [draw.getrandbits(64) for _ in range(3)]
    while len(found) < count:
        fp = draw.choice(centres)
        for _ in range(draw.randrange(0, 7)):
            fp ^= 1 << draw.randrange(64)
        found.add(fp)
    return sorted(found)


def components_of(spark, fps, **options):
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    classes = spark.createDataFrame([(s,) for s in signed], "fp long")
    rooted = {r.node: r.root for r in simhash.components(simhash.links(classes, **options)).collect()}
    groups = {}
    for s in signed:
        groups.setdefault(rooted.get(s, s), set()).add(s)
    return sorted(map(sorted, groups.values()))


def test_long_postings_are_refined_and_blocked(spark):
    fps = near_group(500, 8)
    ids = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = {}
    for i, root in slow_components(ids, fps).items():
        want.setdefault(root, set()).add(i)
    want = sorted(map(sorted, want.values()))
    for options in ({}, {"refine_above": 8}, {"refine_above": 3, "block": 5}):
        assert components_of(spark, fps, **options) == want


def test_components_equal_union_find_in_one_task_and_in_many(spark):
    draw = random.Random(4)
    chain = [(i, i + 1) for i in range(-300, 300)]
    edges = [(draw.randrange(1000, 3000), draw.randrange(1000, 3000)) for _ in range(1200)] + chain + [(5000, k) for k in range(4000, 4400)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for per_task in (250_000, 400, 60):
        got = simhash.components(table, per_task=per_task).collect()
        assert sorted((r.node, r.root) for r in got) == sorted((x, find(x)) for x in linked)
    assert simhash.components(table.limit(0)).count() == 0


def test_defined_results(spark):
    rows = [(3, None, "a"), (1, "", "b"), (2, " \t\n", "c"), (9, "one two", "d"), (9, "one two", "d"), (None, "one two", "e"), (None, "quite other words stand here", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = sorted(((r.doc_id, r.fp, r.component) for r in simhash.near_duplicates(docs).collect()), key=repr)
    two = int(np.uint64(slow_fingerprint("one two")).astype(np.int64))
    other = int(np.uint64(slow_fingerprint("quite other words stand here")).astype(np.int64))
    assert got == sorted([(3, 0, 1), (1, 0, 1), (2, 0, 1), (9, two, 9), (9, two, 9), (None, two, 9), (None, other, None)], key=repr)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([(1, "", "b"), (9, "one two", "d"), (None, "quite other words stand here", "f")], key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.keep_one(docs.limit(0)).count()


def test_long_text_is_whole():
    text = "word " * 50_000 + "end"
    assert simhash.simhash(text) == slow_fingerprint(text)
