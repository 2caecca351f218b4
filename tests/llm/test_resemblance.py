"""The pipeline's near-duplicate stage against all pairs' Jaccard similarity of 5-word shingles."""

import zlib
from itertools import combinations

import numpy as np
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from quirelake.llm import mixing, resemblance, toxicity
from quirelake.llm.queries import quality_weights, tokenizer_path
from tests.llm.test_pairs import slow_contaminated


def slow_kept(rows, least=0.8):
    """Ids of the smallest of each component of pairs at a similarity of at least 0.8."""
    sets = {}
    for r in rows:
        words = (r.text or "").lower().split()
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i for i in sets if find(i) == i}


def test_stage_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == slow_kept(docs.collect())


def test_lightly_edited_copies_go(spark):
    words = [f"w{i}" for i in range(300)]
    edited = [*words[:60], "x", *words[61:150], "y", *words[151:240], "z", *words[241:]]
    far = [w if i % 12 else "q" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(far)), (4, None), (5, " ")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3, 4]


def test_long_lists_stay_linked(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*base[: k % 200], f"x{k}", *base[k % 200 + 1 :]])) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == [0]


def test_long_lists_lose_no_link(spark):
    """Chains of pairs at the threshold inside one long posting list, which its neighbours and its forest don't show."""
    draw = np.random.default_rng(3)
    common, groups, rows = [f"c{i}" for i in range(400)], 40, []
    for g in range(groups):
        words = [*common, *[f"g{g}w{i}" for i in range(56)]]
        for _ in range(6):
            own = list(words)
            for at in draw.integers(400, len(own), 2):
                own[at] = f"x{len(rows)}y{at}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == slow_kept(docs.collect())


def test_crossing_members_and_links_equal_all_pairs(spark):
    draw = np.random.default_rng(6)
    base = draw.integers(0, 256, 48).astype(np.uint8)
    marks, sets = [], []
    for _ in range(60):
        own = base.copy()
        changed = draw.choice(48, draw.integers(0, 30), replace=False)
        own[changed] = draw.integers(0, 256, len(changed))
        marks.append(own)
        sets.append(sorted({*draw.choice(100, draw.integers(82, 100), replace=False).tolist()}))
    classes = spark.createDataFrame([(k, [7], m.tobytes()) for k, m in enumerate(marks)], "fp long, keys array<long>, marks binary")
    root = [0 if k < 25 else k % 7 + 30 if k < 50 else k for k in range(60)]
    rooted = spark.createDataFrame(list(enumerate(root)), "node long, root long")
    lists = resemblance.postings(classes).selectExpr("key AS list").distinct()
    apart = [(a, b) for a, b in combinations(range(60), 2) if root[a] != root[b]]
    want = {x for a, b in apart if (marks[a] == marks[b]).sum() >= resemblance.LEAST for x in (a, b)}
    every = spark.createDataFrame([(1, k, root[k]) for k in range(60)], "key long, fp long, root long")
    shingles = spark.createDataFrame(list(enumerate(sets)), "fp long, shingles array<long>")
    similar = [(a, b) for a, b in apart if len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.85]
    assert 0 < len(want) < 60 and 0 < len(similar) < len(apart)
    for block in (1024, 7):
        assert {r.fp for r in resemblance.crossing(classes, lists, rooted, block=block).collect()} == want
        links = {tuple(sorted(map(int, r))) for r in resemblance.crossing_links(every, shingles, similarity=0.85, block=block).collect()}
        assert links <= set(similar) and groups(links, root) == groups(similar, root)


def groups(links, root):
    """The components that links make of roots."""
    parent = {r: r for r in root}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(root[a])] = find(root[b])
    found = {}
    for r in root:
        found.setdefault(find(r), set()).add(r)
    return sorted(map(sorted, found.values()))


def test_a_long_list_gives_a_spanning_forest():
    keys, marks = np.zeros(100, np.int64), np.zeros((100, 48), np.uint8)
    pairs = resemblance.list_pairs(keys, marks)
    assert len(pairs) == 99


def test_stage_goes_by_simhash(spark):
    """The index holds the majority bits of the distinct shingles, and posts two bytes of each word at their places."""
    text = " ".join(f"w{i % 40}" for i in range(90))
    row = resemblance.sketches(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    words = text.encode().split()
    hashes = {xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), 42) for i in range(len(words) - 4)}
    slow = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert row.word % 2**64 == slow == int.from_bytes(row.marks[:8], "little")
    wide = resemblance.wide_hashes(np.array(sorted(hashes), np.uint64))
    whole = [sum(1 << b for b in range(64) if sum(int(h) >> b & 1 for h in column) * 2 > len(hashes)).to_bytes(8, "little") for column in wide.T]
    assert b"".join(whole)[: len(row.marks)] == row.marks and len(row.keys) == len(whole)
    for k, key in enumerate(row.keys):
        low, high = key >> 19 & 7, key >> 16 & 7
        assert key >> 22 == k and low < high and (key >> 8 & 255, key & 255) == (whole[k][low], whole[k][high])


def test_pairs_at_the_threshold_share_a_list():
    draw = np.random.default_rng(8)
    for size in [5, 12, 40, 200] * 100:
        hashes = draw.integers(0, 1 << 63, 5 * (size // 4), np.uint64) * np.uint64(2) + np.uint64(1)
        common, own = hashes[: size // 4 * 4], hashes[size // 4 * 4 :]
        (x, a), (y, b) = (resemblance.fingerprint(np.concatenate([common, part])) for part in np.split(own, [len(own) // 2]))
        x, y = x[None, : resemblance.MARKS], y[None, : resemblance.MARKS]
        assert (a == b).any() and (x == y).sum() >= resemblance.SHARED and resemblance.differing(x.copy(), y.copy())[0] <= resemblance.MARK_BITS


def test_near_copies_give_few_pairs(spark):
    """All 600 texts are alike in pairs; what the lists give grows with the texts, not with their pairs."""
    base = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join([*base[: k % 400], f"x{k}", *base[k % 400 + 1 :]])) for k in range(600)]
    classes = resemblance.sketches(spark.createDataFrame(rows, "doc_id long, text string")).select("fp", "keys", "word", "marks")
    assert resemblance.candidates(classes).filter("a is not null").count() < 600 * 24


def scattered(count, size=90, changes=8):
    """Texts of one origin at similarities on both sides of 0.8: most pairs are alike, few are linked."""
    draw = np.random.default_rng(12)
    rows = []
    for k in range(count):
        words = [f"w{i}" for i in range(size)]
        for at in draw.choice(size, draw.integers(1, changes), replace=False):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    return rows


def test_a_text_is_verified_once_however_many_lists_it_is_in(spark, monkeypatch):
    """The members that come with their sets grow with the texts, not with the lists that texts have in common."""
    rows, came = scattered(300), []
    links = resemblance.crossing_links

    def watched(members, sets, **options):
        came.append((members.count(), members.select("fp").distinct().count()))
        return links(members, sets, **options)

    monkeypatch.setattr(resemblance, "crossing_links", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == slow_kept(docs.collect())
    assert len(came) == 1 and came[0][0] == came[0][1] > 50


def test_lists_too_long_for_a_task_lose_no_link(spark):
    docs = spark.createDataFrame(scattered(200), "doc_id long, text string")
    for longest in (8, 70):  # lists from that length on are made good one by one
        found = resemblance.near_duplicates(docs, longest=longest).collect()
        assert {r.doc_id for r in found if r.doc_id == r.component} == slow_kept(docs.collect()), longest
    classes = resemblance.sketches(docs).select("fp", "keys", "marks")
    assert not resemblance.candidates(classes, 8).filter("list is not null").isEmpty()


def test_reached_rows_are_the_components_of_near_pairs():
    draw = np.random.default_rng(4)
    marks = np.repeat(draw.integers(0, 256, (12, 24)), 12, 0).astype(np.uint8)
    marks ^= (draw.random((*marks.shape, 8)) < 0.12).dot(1 << np.arange(8)).astype(np.uint8)
    near = [(i, j) for i, j in combinations(range(len(marks)), 2) if sum(int(x).bit_count() for x in marks[i] ^ marks[j]) <= 36]
    i, j = resemblance.reached(marks, 36)
    assert (j < i).all() and groups(zip(i.tolist(), j.tolist(), strict=True), range(len(marks))) == groups(near, range(len(marks)))
    assert 12 < len(groups(near, range(len(marks)))) < 144 and [len(x) for x in resemblance.reached(marks[:0], 36)] == [0, 0]


def test_whole_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    toxic = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    rows = [r for r in docs.orderBy("doc_id").collect() if r.doc_id not in toxic]
    kept = slow_kept(rows)
    assert {1, 177} & toxic == set() and 1 in kept and 177 not in kept  # 9 bits apart, similarity 0.83
    rows = [r for r in rows if r.doc_id in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, _ in slow_contaminated([(r.doc_id, r.text) for r in rows], items)}
    rows = [r for r in rows if r.doc_id not in leaked]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(rows, docs.schema), quality=quality_weights(spark, sf)).collect()}
    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for r in rows:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for _ in range(copies[r.doc_id]):
            want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(want)
