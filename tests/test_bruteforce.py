"""Queries without SQL, held to slow computations of the same."""

import hashlib
from statistics import median

from quirelake.plans import layout, reading
from quirelake.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def test_chunks(spark):
    size, overlap, want = 1600, 80, []
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text, start, n = row.text or "", 0, 0
        while start < len(text):
            stop = min(start + size, len(text))
            if stop < len(text):
                places = [i for i in range(max(start + 1, stop - 499), stop) if text[i] in ".!?" and text[i + 1] in " \n\t"]
                stop = places[-1] + 1 if places else stop
            want.append((row.doc_id, n, start, stop, hashlib.sha256(text[start:stop].encode()).hexdigest()))
            n, start = n + 1, max(stop - overlap, start + 1) if stop < len(text) else len(text)
    assert sorted(tuple(r) for r in reading.chunk_text(spark, SF).collect()) == sorted(want)


def test_chunk_bounds(spark):
    """A sentence end 500 characters back is out of the window, one 499 back is in it."""
    from quirelake.operators.paging import chunks

    texts = [(k, ("x" * (1600 - back) + ". " + "b" * 3000)) for k, back in enumerate((500, 499, 1, 0))]
    got = {r.doc_id: r.stop for r in chunks(spark.createDataFrame(texts, "doc_id long, text string"), key="doc_id", text="text", max_tokens=400, overlap_tokens=20).filter("chunk = 0").collect()}
    assert got == {0: 1600, 1: 1102, 2: 1600, 3: 1600}


def test_render_budget(spark):
    want = []
    for request in {r[0] for r in layout.REQUESTS.rows}:
        own, left = sorted(r for r in layout.REQUESTS.rows if r[0] == request), 1000
        for k, (_, _, page, size, floor_size) in enumerate(own):
            target = left // (len(own) - k)
            used = size if size <= target else floor_size if floor_size <= target else 0
            left -= used
            want.append((request, page, target, used, used > 0))
    assert sorted(tuple(r) for r in layout.render_budget(spark, SF).collect()) == sorted(want)


def slow_tiers(page):
    height = {p: h for p, _, h in layout.GLYPH_PAGES.rows}[page]
    own = [r for r in layout.GLYPHS.rows if r[0] == page and r[7]]
    if not own:
        return None
    unit = median(r[6] - r[4] for r in own)
    bins = max(20, int(height / (unit * 0.8)))
    width, cover = height / bins, [0] * bins
    for r in own:
        for b in range(max(0, int(r[4] // width)), min(bins - 1, int(r[6] // width)) + 1):
            cover[b] += 1
    middle = median(c for c in cover if c)
    tiers, k = [], 0
    while k < bins:
        stop = k
        while stop < bins and cover[stop] < 0.35 * middle:
            stop += 1
        if stop > k and any(c > middle / 2 for c in cover[:k]) and any(c > middle / 2 for c in cover[stop:]):
            y = (k + stop) / 2 * width
            if not tiers or y - tiers[-1] > 2 * unit:
                tiers.append(y)
        k = max(stop, k + 1)
    return ",".join(f"{y:.2f}" for y in tiers)


def test_valley_tiers(spark):
    want = {p: t for p in ("v", "m", "h", "f") if (t := slow_tiers(p)) is not None}
    assert {r.page_id: r.tiers for r in layout.valley_tiers(spark, SF).collect()} == want and any(want.values())


def test_rule_segments(spark):
    sizes, want = {p: (w, h) for p, w, h in layout.GLYPH_PAGES.rows}, []
    for page, (w, h) in sizes.items():
        across = sorted(d[2] for d in layout.DRAWINGS.rows if d[0] == page and d[3] - d[1] > 0.3 * w and d[4] - d[2] < 3)
        down = [d for d in layout.DRAWINGS.rows if d[0] == page and d[4] - d[2] > 0.25 * h and d[3] - d[1] < 3]
        edges = [0.0]
        for y in across:
            if y - edges[-1] >= 20:
                edges.append(y)
        place = 0
        for top, bottom in zip(edges, [*edges[1:], h], strict=True):
            walls = sorted({round(d[1]) for d in down if d[2] < bottom - 5 and d[4] > top + 5})
            regions = {}
            for r in sorted((r for r in layout.GLYPHS.rows if r[0] == page), key=lambda r: r[1]):
                x, y = (r[3] + r[5]) / 2, (r[4] + r[6]) / 2
                if top <= y < bottom:
                    regions.setdefault(sum(wall <= x for wall in walls), []).append((x, r[2]))
            for own in sorted(regions.values(), key=lambda own: -sum(x for x, _ in own) / len(own)):
                place += 1
                want.append((page, place, len(own), "".join(t for _, t in own)))
    assert sorted(tuple(r) for r in layout.rule_segments(spark, SF).collect()) == sorted(want)


def test_vertical_reorder(spark):
    got = {r.page_id: r.text for r in QUERIES["vertical_reorder"](spark, SF).collect()}
    assert {p: got[p] for p, _, _ in layout._READ_DOWN.rows} == {p: t for p, _, t in layout._READ_DOWN.rows}
    assert got["h"] == "one\ntwo\n三" and got["f"] == "字" * 5


def test_reading_order(spark):
    """The share of words in matching blocks, worked out by hand."""
    got = {r.id: r.ratio for r in QUERIES["reading_order"](spark, SF).collect()}
    assert got == {0: 1.0, 1: 0.5, 2: 0.0, 3: 0.6667}
