"""Near duplicates by SimHash with a byte-position inverted index and count filtering.

A fingerprint has 64 bits, in 8 bytes. Two fingerprints that differ in at most 4 bits differ in at most 4 bytes, so
they share at least 4 of 8 positional bytes: the guaranteed minimum. The index posts a fingerprint under triples of
its positional bytes; the 20 triples used form a cover, so any 4 shared positions contain one of them and
no pair is lost. In a posting list the shared positional bytes of a pair are tallied, pairs below the minimum
are dropped, and the rest are verified by their differing bits.

Equal fingerprints are one class before anything else, so copies cost nothing. A posting list longer than
``refine_above`` is posted again under each further byte (pairs that reach the minimum share one of those too); what
is still longer is compared in pairs of blocks, in tasks of their own. A task gives a spanning forest of the links it
finds, never all pairs, and the forests' components are the components of all links, found by contractions within
tasks and alternating star contractions across them, with a checkpoint a round.

Defined results: a null or blank text has fingerprint zero and is linked like any other; fewer words than a shingle
make one shingle of all of them; repeated rows each get a row; a null id is kept, and counts for a component's
smallest id only if it has no other; very long texts are read whole; an empty table gives no rows; further columns are
ignored, and keep_one() passes them on whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpoint, computed, narrow_files, packed, splits_of

BYTES = 8
#: Three groups of positions: a triple is posted if it lies within a group or has two in one and one in the next.
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def cover() -> list[tuple[int, ...]]:
    """Triples of positions of which every set of four positions contains one."""
    group = {p: g for g, members in enumerate(_GROUPS) for p in members}
    kept = []
    for triple in combinations(range(BYTES), 3):
        count = [sum(group[p] == g for p in triple) for g in range(3)]
        if 3 in count or any(count[g] == 2 and count[(g + 1) % 3] == 1 for g in range(3)):
            kept.append(triple)
    return kept


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """The hash of each shingle of a whole text, in its order; none for a blank text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def simhash(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of a whole text, as an unsigned 64-bit number."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    columns = np.array(hashes, "<u8").view(np.uint8).reshape(-1, BYTES)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS_OF for k in range(BYTES)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, digest, fp) for every row, computed once; fp is the fingerprint as a signed long, digest a hash of the text as it
    stands."""
    id_type = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = np.array([simhash(t, shingle) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["id", "digest", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    return computed(rows, run, f"id {id_type}, digest long, fp long", "fingerprints")


# --- links within posting lists -------------------------------------------------------------------------------------


class _Forest:
    """Union-find over row numbers; keeps the links that joined two trees."""

    def __init__(self, size: int):
        self.parent, self.kept = list(range(size)), []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.kept.append((a, b))


def _verified(a: np.ndarray, b: np.ndarray, max_bits: int, least: int) -> np.ndarray:
    """Which pairs reach the tally of shared positional bytes and differ in at most max_bits bits."""
    differ = np.bitwise_xor(a, b)
    tally = (differ.view(np.uint8).reshape(*differ.shape, BYTES) == 0).sum(-1)
    near = tally >= least
    near[near] = np.bitwise_count(differ[near]) <= max_bits
    return near


def run_links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links in short runs of equal keys (the arrays are sorted by key), a spanning forest a run.

    The pairs at distance 1, 2, ... in the arrays are compared together, all runs at once.
    """
    forest, least, gap = _Forest(len(keys)), BYTES - max_bits, 1
    live = np.arange(len(keys))
    while True:
        live = live[live < len(keys) - gap]
        live = live[keys[live] == keys[live + gap]]
        if not len(live):
            return forest.kept
        for i in live[_verified(np.ascontiguousarray(fps[live]), np.ascontiguousarray(fps[live + gap]), max_bits, least)].tolist():
            forest.link(i, i + gap)
        gap += 1


def block_links(left: np.ndarray, right: np.ndarray, max_bits: int, step: int = 256) -> list[tuple[int, int]]:
    """A spanning forest of the links among two blocks of fingerprints, and within them."""
    both = np.concatenate([left, right])
    forest, least = _Forest(len(both)), BYTES - max_bits
    for at in range(0, len(both), step):
        rows = both[at : at + step]
        a, b = np.broadcast_arrays(rows[:, None], both[None, at:])
        for i, j in zip(*np.nonzero(_verified(np.ascontiguousarray(a), np.ascontiguousarray(b), max_bits, least)), strict=True):
            if j > i:
                forest.link(at + int(i), at + int(j))
    return forest.kept


def _posting_links(posted: DataFrame, max_bits: int, longest: int) -> DataFrame:
    """(a, b, subset, key) from (subset, key, fp) dealt by key: links of short lists as (a, b), and the members of
    longer ones as (a, null, subset, key)."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("subset", pa.int64()), ("key", pa.int64())])

        def settle(subset, key, fp):
            mark = np.flatnonzero((np.diff(key) != 0) | (np.diff(subset) != 0)) + 1
            edges = np.concatenate([[0], mark, [len(key)]])
            sizes = np.diff(edges)
            run_of = np.repeat(np.arange(len(sizes)), sizes)
            long = (sizes > longest)[run_of]
            short = ~long & (sizes > 1)[run_of]
            f = fp[short]
            links = np.array(run_links(run_of[short], f.view(np.uint64), max_bits), np.int64).reshape(-1, 2)
            if len(links):
                yield pa.RecordBatch.from_arrays([pa.array(f[links[:, 0]]), pa.array(f[links[:, 1]]), pa.nulls(len(links), pa.int64()), pa.nulls(len(links), pa.int64())], schema=schema)
            if long.any():
                yield pa.RecordBatch.from_arrays([pa.array(fp[long]), pa.nulls(int(long.sum()), pa.int64()), pa.array(subset[long]), pa.array(key[long])], schema=schema)

        rest, overlong = [], None
        for batch in batches:
            part = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if overlong is not None:  # a list known to be too long passes through
                same = (part[0] == overlong[0]) & (part[1] == overlong[1])
                stop = len(same) if same.all() else int(np.argmin(same))
                if stop:
                    yield pa.RecordBatch.from_arrays([pa.array(part[2][:stop]), pa.nulls(stop, pa.int64()), pa.array(part[0][:stop]), pa.array(part[1][:stop])], schema=schema)
                part = [p[stop:] for p in part]
                if not len(part[0]):
                    continue
                overlong = None
            columns = [np.concatenate([r, p]) for r, p in zip(rest, part, strict=True)] if rest else part
            differs = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            if cut:
                yield from settle(*[c[:cut] for c in columns])
            rest = [c[cut:] for c in columns]
            if len(rest[0]) > longest:
                overlong = (rest[0][0], rest[1][0])
                yield from settle(*rest)
                rest = []
        if rest and len(rest[0]):
            yield from settle(*rest)

    dealt = posted.repartition("subset", "key").sortWithinPartitions("subset", "key")
    return computed(dealt, run, "a long, b long, subset long, key long", "postings")


def _byte(column, position: int):
    return F.shiftrightunsigned(column, 8 * position).bitwiseAND(F.lit(255))


def _key(column, positions: tuple[int, ...]):
    key = F.lit(0).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(column, p))
    return key


def links(classes: DataFrame, *, max_bits: int = 4, refine_above: int = 64, block: int = 2048, files: int | None = None) -> DataFrame:
    """(a, b) between distinct fingerprints of classes(fp): spanning forests of all links at most max_bits apart."""
    if max_bits > 4:
        raise ValueError("the index guarantees 4 shared bytes, so at most 4 differing bits")
    fp = F.col("fp")
    triples = cover()
    posted = classes.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("subset"), _key(fp, t).alias("key")) for i, t in enumerate(triples)])).alias("p"), "fp")
    first = _posting_links(posted.select("p.subset", "p.key", "fp"), max_bits, refine_above)
    found = first.filter(F.col("b").isNotNull()).select("a", "b")
    overlong = first.filter(F.col("b").isNull())
    if overlong.isEmpty():
        return found

    # Again under each further byte; the fourth position goes with the triple, so lists of one quadruple meet.
    choices = F.lit(None)
    for i, t in enumerate(triples):
        further = [tuple(sorted((*t, p))) for p in range(BYTES) if p not in t]
        options = F.array(*[F.struct(F.lit(sum(1 << p for p in q)).cast("long").alias("subset"), _key(F.col("a"), q).alias("key")) for q in further])
        choices = F.when(F.col("subset") == i, options) if i == 0 else choices.when(F.col("subset") == i, options)
    again = overlong.select(F.explode(choices).alias("p"), F.col("a").alias("fp")).select("p.subset", "p.key", "fp").distinct()
    second = _posting_links(again, max_bits, block)
    found = found.unionAll(second.filter(F.col("b").isNotNull()).select("a", "b"))
    overlong = second.filter(F.col("b").isNull())
    if overlong.isEmpty():
        return found

    # Still longer: split into blocks, and compare every two blocks in a task of their own.
    blocks = overlong.groupBy("subset", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    member = overlong.select("subset", "key", F.col("a").alias("fp")).join(blocks, ["subset", "key"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pairs = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = pairs.select("subset", "key", "fp", F.least("i", "other").alias("i"), F.greatest("i", "other").alias("j"))

    def compare(key, group):
        import pyarrow as pa

        fps = np.unique(group.column("fp").to_numpy()).view(np.uint64)
        kept = np.array(block_links(fps, fps[:0], max_bits), np.int64).reshape(-1, 2)
        signed = fps.view(np.int64)
        return pa.table({"a": signed[kept[:, 0]], "b": signed[kept[:, 1]]})

    # Kept, so that no task runs two Python workers at once.
    return found.unionAll(checkpoint(pairs.groupBy("subset", "key", "i", "j").applyInArrow(compare, "a long, b long"), files))


# --- components -----------------------------------------------------------------------------------------------------


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of edges a-b that aren't the smallest of their component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def contracted(edges: DataFrame, held: int) -> DataFrame:
    """Edges (u, v) with the same components, computed once: each task turns the edges it has, at most some ``held`` at a time, into stars."""

    def run(batches):
        import pyarrow as pa

        u = v = np.zeros(0, np.int64)
        for batch in batches:
            u, v = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((u, v)))
            if len(u) >= held:
                u, v = stars(u, v)
                if len(u) >= held // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    u = v = np.zeros(0, np.int64)
        u, v = stars(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return computed(edges, run, "u long, v long", "edges")


def components(edges: DataFrame, *, per_task: int = 250_000, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges(a, b), root being the smallest node of its component.

    Each round, tasks of about ``per_task`` edges turn what they hold into stars, which shrinks the edges without a
    shuffle; where that is more than one task, a large-star and a small-star step follow, in which a hub's neighbours
    are never gathered, only its minimum. Edges that fit a task are settled by the first of these.
    """
    held = 8 * per_task
    edges = contracted(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), held)
    count, state = edges.count(), None
    for _ in range(max_rounds):
        tasks = max(1, -(-count // per_task))
        edges = contracted(edges.coalesce(tasks), held)
        if tasks == 1:
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        joined = large.join(lower, F.col("u") == F.col("x"))
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lower.select(F.col("x").alias("u"), F.col("m").alias("v")))
        edges = checkpoint(small.filter("u <> v").distinct(), tasks)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, count = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(id, digest, fp, component) for every row: component is the smallest id reachable over links."""
    files = splits_of(docs)
    marked = fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle)
    classes = marked.groupBy("fp").agg(F.min("id").alias("least"))
    return named_components(marked, classes, components(links(classes.select("fp"), max_bits=max_bits, files=files)), id_col).coalesce(files)


def named_components(marked: DataFrame, classes: DataFrame, rooted: DataFrame, id_col: str) -> DataFrame:
    """(id, digest, fp, component) from marked(id, digest, fp), classes(fp, least) and the roots of linked fingerprints."""
    placed = classes.join(rooted, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("c_fp"), "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "c_root")
    named = placed.join(smallest, F.col("root") == F.col("c_root")).select("c_fp", "component")
    return marked.join(named, F.col("fp") == F.col("c_fp")).select(F.col("id").alias(id_col), "digest", "fp", "component")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates) -> DataFrame:
    """One document of every component: the row with the smallest id. All columns stay.

    Rows are named by id and text. Of rows equal in both one stays; rows without an id stay if their component has none.
    """
    found = checkpoint(find(docs, id_col=id_col, text_col=text_col), narrow_files(docs))
    first = found.filter(F.col(id_col).eqNullSafe(F.col("component"))).groupBy(F.col(id_col).alias("k_id"), F.col("digest").alias("k_digest")).agg(F.count("*").alias("k_n"))
    keyed = packed(docs).withColumn("text", F.xxhash64(F.col("row")[text_col])).withColumn("id", F.col("row")[id_col])
    joined = keyed.join(first.select("k_id", "k_digest"), F.col("id").eqNullSafe(F.col("k_id")) & (F.col("text") == F.col("k_digest")), "left_semi")
    if not first.filter("k_n > 1").isEmpty():
        joined = joined.dropDuplicates(["id", "text"])
    return joined.select("row.*").coalesce(splits_of(docs))
