"""Near duplicates by the exact Jaccard similarity of word shingles, from SimHash candidates.

A text's set is its distinct 5-word shingles, lower-cased as for SimHash. Equal sets are one class. Sets at a similarity of
0.8 are vectors at a cosine of at least 2 * 0.8 / 1.8, so a bit of their SimHash differs with a probability of at most 0.152:
9.7 of 64 bits, too many for the byte index of 64 bits and 4 differences. So a class has a wide fingerprint, 128 words of
64 bits (8 positional bytes), each bit the majority of the shingles' bits, the first word being the SimHash of 64 bits.

- Index: a class is posted once a word, under the two positional bytes whose votes are the most decided: those seldom
  differ. A pair at 0.8 shares such a list with a probability of 0.07 a word, so it shares none of 128 with one of 1e-4.
- In a posting list every member meets the 64 before it, and the first; pairs that differ in more than 64 bits of the first
  three words are dropped. Of the others a list gives a spanning forest of the most alike. Where that is not all of them, and
  where a list has over 65 members, the list is open: it gives its forest only in the first 16 words, as the lists of a group
  of near copies are much the same in every word, and all its pairs are never given.
- Groups: what the pairs of an open list connect is one group, over all lists, so any further pair lies within a group, and
  a class is in one group however many lists it is in. Lists of over 4,096 members aren't searched to the end in one task:
  they are named instead.
- Count filter and Hamming check: the positional bytes that a pair shares are tallied over 6 words, and pairs with fewer
  than 2 of 48 or more than 110 of 384 differing bits are dropped (a pair at 0.8 shares 12.9 and differs in 58).
- What is left is verified on the shingle sets themselves, so no link is below the threshold.

Then the groups and the named lists are made good, in pairs of blocks, each in a task of its own. First the count filter and
the Hamming check alone find the members that pass them with a member of another component; then these come with their
shingle sets, and a task verifies all their pairs by a matrix product and gives a spanning forest of the links it finds. Pairs
within the largest component of a group have nothing to add and aren't dealt, so a large group of copies costs little; no
step gives all pairs of a group.

Defined results: as for SimHash; null and blank texts have one common set.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded_broadcast, checkpoint, computed, narrow_files, splits_of
from .simhash import BYTES, _Forest, components, named_components, shingle_hashes, stars

#: Words of a fingerprint; bytes that are kept of it for the tally, and the least tally where a caller names none.
WORDS, MARKS, LEAST = 128, 48, 24
#: Bytes of the marks that are posted; what a pair at 0.8 keeps to: differing bits of these, shared bytes and differing bits
#: of the marks.
LEAD, LEAD_BITS, SHARED, MARK_BITS = 3 * BYTES, 64, 2, 110
NEIGHBOURS, FORESTS = 64, 16
_MIX = np.random.default_rng(17).integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x0101010101010101)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64))


def wide_hashes(hashes: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits a hash, the first being the hash itself."""
    x = hashes[:, None] * _MIX
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x[:, 0] = hashes
    return x


def added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ones, twos) of three votes a bit."""
    ab = a ^ b
    return ab ^ c, (a & b) | (ab & c)


def votes(hashes: np.ndarray, step: int = 7 * 64) -> np.ndarray:
    """How many hashes set each bit of the wide fingerprint: 8 bits by WORDS * BYTES positional bytes."""
    found = np.zeros((8, WORDS * BYTES), np.int64)
    for at in range(0, len(hashes), step):
        wide = wide_hashes(hashes[at : at + step])
        if len(wide) % 7:
            wide = np.concatenate([wide, np.zeros((7 - len(wide) % 7, WORDS), np.uint64)])
        a, b, c, d, e, f, g = wide.reshape(7, -1, WORDS)  # seven votes a bit become ones, twos and fours
        x, p = added(a, b, c)
        y, q = added(d, e, f)
        ones, r = added(x, y, g)
        for weight, votes_of in zip((1, 2, 4), (ones, *added(p, q, r)), strict=True):
            for bit in range(8):  # a byte of a lane holds 255 votes
                found[bit] += weight * np.add.reduce((votes_of >> np.uint64(bit)) & _LANES, axis=0).astype("<u8").view(np.uint8).astype(np.int64)
    return found


def fingerprint(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, keys) of a set: the positional bytes of its wide SimHash, and a key a word of its two most decided bytes."""
    ones = votes(hashes)
    margin = np.abs(2 * ones - len(hashes)).astype(np.float32) / np.float32(max(1, len(hashes)) ** 0.5)
    marks = np.packbits(ones * 2 > len(hashes), axis=0, bitorder="little")[0]
    doubt = np.exp(-margin).sum(0).reshape(WORDS, BYTES)
    row = np.arange(WORDS)
    first = doubt.argmin(1)
    doubt[row, first] = np.inf
    second = doubt.argmin(1)
    low, high = np.minimum(first, second), np.maximum(first, second)
    place = (row * BYTES + low) * BYTES + high
    by_word = marks.reshape(WORDS, BYTES)
    return marks, (place << 16 | by_word[row, low].astype(np.int64) << 8 | by_word[row, high]).astype(np.int32)


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, digest, fp, keys, word, marks) for every row: fp is a hash of the set, keys its posting lists, word the first
    word and marks the first bytes of its fingerprint."""
    id_type = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            fps, keys, marks = [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_set(text, shingle)
                whole, lists = fingerprint(hashes)
                fps.append(xxhash.xxh64_intdigest(hashes.tobytes(), 42))
                keys.append(lists)
                marks.append(whole[:MARKS])
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * WORDS), flat)
            word = np.array([m[:BYTES] for m in marks], np.uint8).reshape(-1, BYTES).view("<i8")[:, 0]
            columns = [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), lists, pa.array(word), pa.array([m.tobytes() for m in marks], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "fp", "keys", "word", "marks"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    return computed(rows, run, f"id {id_type}, digest long, fp long, keys array<int>, word long, marks binary", "sketches")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of bytes, along the last axis."""
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64)).sum(-1, dtype=np.int64)


def list_pairs(keys: np.ndarray, marks: np.ndarray, rest: list[int] | None = None) -> np.ndarray:
    """A spanning forest of the candidate pairs (i, j) of rows with equal keys, by the differing bits of their marks; the
    arrays are sorted by key. Keys of lists that may have further candidates are added to ``rest``."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1]).astype(np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    first, number = np.repeat(starts, sizes), np.repeat(np.arange(len(sizes)), sizes)
    most = LEAD_BITS * marks.shape[1] // LEAD
    pairs, apart = [], []

    def meet(i, j):
        bits = differing(marks[i], marks[j])
        near = bits <= most
        pairs.append(np.stack([i[near], j[near]], 1))
        apart.append(bits[near])

    late = np.flatnonzero(np.arange(len(keys)) - first > NEIGHBOURS)
    meet(first[late], late)
    live = np.arange(len(keys))
    for gap in range(1, NEIGHBOURS + 1):
        live = live[live < len(keys) - gap]
        live = live[keys[live] == keys[live + gap]]
        if not len(live):
            break
        meet(live, live + gap)
    pairs, forest = np.concatenate(pairs), _Forest(len(keys))
    for i, j in pairs[np.argsort(np.concatenate(apart), kind="stable")].tolist():
        forest.link(i, j)
    kept = np.array(forest.kept, np.int64).reshape(-1, 2)
    if rest is not None:
        given, near = (np.bincount(number[p[:, 0]], minlength=len(sizes)) for p in (kept, np.unique(pairs, axis=0)))
        rest.extend(keys[starts[(given < near) | (sizes > NEIGHBOURS + 1)]].tolist())
    return kept


def reached(marks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): each row that steps of at most ``most`` differing bits connect to an earlier row, and the earliest it is from;
    a row meets those that are not reached yet."""
    rest, own, first = np.arange(len(marks)), [], []
    while len(rest):
        seed, rest = rest[0], rest[1:]
        ahead = [seed]
        while ahead and len(rest):
            near = differing(marks[rest], marks[ahead.pop()]) <= most
            found, rest = rest[near], rest[~near]
            own.append(found)
            first.append(np.full(len(found), seed))
            ahead.extend(found.tolist())
    return np.concatenate([np.zeros(0, np.int64), *own]), np.concatenate([np.zeros(0, np.int64), *first])


def postings(classes: DataFrame, *more) -> DataFrame:
    """(key, fp, more) of classes(fp, keys, more): a row a list."""
    return classes.select(F.explode("keys").alias("key"), "fp", *more).withColumn("key", F.col("key").cast("long"))


def candidates(classes: DataFrame, longest: int = 4096, held: int = 2_000_000) -> DataFrame:
    """(a, b, list, u, v) from classes(fp, keys, marks), computed once: pairs a < b; edges u-v, which connect what else the
    lists may link; and the keys of lists of over ``longest`` members, whose pairs neither of these cover."""

    def run(batches):
        import pyarrow as pa

        names = ["a", "b", "list", "u", "v"]
        u = v = np.zeros(0, np.int64)

        def rows(**columns):
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[n]) if n in columns else pa.nulls(size, pa.int64()) for n in names], names)

        def settle(keys, fps, marks):
            nonlocal u, v
            named = []
            pairs = list_pairs(keys, marks, named)
            found, of = np.array(named, np.int64), keys[pairs[:, 0]]
            still_open = np.isin(of, found)
            given = pairs[(of >> 22 < FORESTS) | ~still_open]  # a key begins with its word
            a, b = fps[given[:, 0]], fps[given[:, 1]]
            yield rows(a=np.minimum(a, b), b=np.maximum(a, b))
            edges = [pairs[still_open]]
            starts, ends = np.searchsorted(keys, found), np.searchsorted(keys, found, "right")
            yield rows(list=found[ends - starts > longest])
            for at, end in zip(starts.tolist(), ends.tolist(), strict=True):
                if NEIGHBOURS + 1 < end - at <= longest:
                    edges.append(np.stack(reached(marks[at:end], LEAD_BITS), 1) + at)
            edges = np.concatenate(edges)
            u, v = np.concatenate([u, fps[edges[:, 0]]]), np.concatenate([v, fps[edges[:, 1]]])
            if len(u) >= held:
                u, v = stars(u, v)
                if len(u) >= held // 2:
                    yield rows(u=u, v=v)
                    u = v = np.zeros(0, np.int64)

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), byte_rows(batch.column(2), LEAD)]
            whole = part if rest is None else [np.concatenate([r, p]) for r, p in zip(rest, part, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            if cut:
                yield from settle(*[w[:cut] for w in whole])
            rest = [w[cut:] for w in whole]
            if len(rest[0]) > longest:  # the first and the last of a long list meet those that follow
                yield from settle(*rest)
                rest = [np.concatenate([r[:1], r[-NEIGHBOURS:]]) for r in rest]
        if rest is not None:
            yield from settle(*rest)
        yield rows(**dict(zip("uv", stars(u, v), strict=True)))

    posted = postings(classes, F.substring("marks", 1, LEAD).alias("lead")).repartition("key").sortWithinPartitions("key", "fp")
    found = computed(posted, run, "a long, b long, list long, u long, v long", "candidates")
    return found.filter("a IS NOT NULL").distinct().unionAll(found.filter("a IS NULL"))


def byte_rows(column, width: int = MARKS) -> np.ndarray:
    """An array of binary values of one width, a row a value."""
    import pyarrow as pa

    joined = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(joined):
        return np.zeros((0, width), np.uint8)
    _, offsets, data = joined.buffers()
    start = int(np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(joined.type) else np.int32)[joined.offset])
    return np.frombuffer(data, np.uint8, len(joined) * width, start).reshape(-1, width)


def tallied(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the count filter and the Hamming check on the marks of classes(fp, marks)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = byte_rows(batch.column(2)), byte_rows(batch.column(3))
            near = ((x == y).sum(1) >= SHARED) & (differing(x, y) <= MARK_BITS)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    left, right = classes.select(F.col("fp").alias("a"), F.col("marks").alias("x")), classes.select(F.col("fp").alias("b"), F.col("marks").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def alike_members(left: np.ndarray, right: np.ndarray, left_roots: np.ndarray, right_roots: np.ndarray, least: int, most: int, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two arrays of marks share ``least`` bytes with a row of the other that has another root, and differ
    from it in at most ``most`` bits."""
    a, b = np.zeros(len(left), bool), np.zeros(len(right), bool)
    for at in range(0, len(left), step):
        part, apart = left[at : at + step], left_roots[at : at + step, None] != right_roots[None]
        i, j = np.nonzero(apart & ((part[:, None] == right[None]).sum(-1) >= least))
        near = differing(part[i], right[j]) <= most
        a[at + i[near]] = True
        b[j[near]] = True
    return a, b


def set_links(left: list[np.ndarray], right: list[np.ndarray], left_roots: np.ndarray, right_roots: np.ndarray, similarity: float, step: int = 4096) -> list[tuple[int, int]]:
    """Links (i, j) of two lists of sets at a similarity or above, a spanning forest between their roots."""
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(v) for v in x])) for x in (left, right)]
    common = np.intersect1d(*[values for values, _ in sides])
    placed = []
    for values, rows in sides:
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        held = common[at] == values if len(common) else np.zeros(len(values), bool)
        order = np.argsort(at[held], kind="stable")
        placed.append((at[held][order], rows[held][order]))
    shared = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), step):
        parts = []
        for (columns, rows), x in zip(placed, (left, right), strict=True):
            i, j = np.searchsorted(columns, [at, at + step])
            part = np.zeros((len(x), step), np.float32)
            part[rows[i:j], columns[i:j] - at] = 1
            parts.append(part)
        shared += parts[0] @ parts[1].T
    sizes = np.array([len(x) for x in left], np.float64)[:, None] + np.array([len(x) for x in right], np.float64)[None]
    near = (shared / (sizes - shared) >= similarity) & (left_roots[:, None] != right_roots[None])
    roots, place = np.unique(np.concatenate([left_roots, right_roots]), return_inverse=True)
    forest, kept = _Forest(len(roots)), []
    for i, j in np.argwhere(near).tolist():
        before = len(forest.kept)
        forest.link(int(place[i]), int(place[len(left) + j]))
        if len(forest.kept) > before:
            kept.append((i, j))
    return kept


def block_pairs(members: DataFrame, carried: DataFrame, block: int, broadcast_rows: int = 100_000) -> DataFrame:
    """(key, i, j, own, fp, root, ...) of members(key, fp, root) and what carried(fp, ...) has on them: each two blocks of a
    key meet under (key, i, j), own being the row's block. Keys of one component are left out, and blocks of the largest
    component don't meet each other."""
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    keys = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"), F.count("*").alias("roots")).filter("roots > 1")
    keys = checkpoint(keys.select(F.col("key").alias("l_key"), "main", F.ceil(F.col("most") / block).cast("int").alias("n_main"), F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("n_rest")), 1)
    held = members.join(bounded_broadcast(keys, keys.count(), broadcast_rows), F.col("key") == F.col("l_key"))
    spot, rest = F.xxhash64("fp"), F.col("root") != F.col("main")
    own = F.when(rest, F.col("n_main") + F.pmod(spot, F.col("n_rest"))).otherwise(F.pmod(spot, F.col("n_main"))).cast("int")
    others = F.sequence(F.when(rest, F.lit(0)).otherwise(F.col("n_main")), F.col("n_main") + F.col("n_rest") - 1)
    placed = held.select("key", "fp", "root", own.alias("own"), others.alias("others"))
    dealt = placed.join(carried.withColumnRenamed("fp", "c_fp"), F.col("fp") == F.col("c_fp")).drop("c_fp").withColumn("other", F.explode("others"))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("others", "other")


def with_roots(members: DataFrame, rooted: DataFrame, files: int | None) -> DataFrame:
    """(key, fp, root) of members(key, fp), kept; a class without a link is its own root."""
    return checkpoint(members.join(rooted, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "fp").alias("root")), files)


def crossing(
    classes: DataFrame, lists: DataFrame, rooted: DataFrame, *, least: int = LEAST, most: int = 8 * MARKS, block: int = 1024, broadcast_rows: int = 100_000, files: int | None = None
) -> DataFrame:
    """(key, fp, root) of the members of the given lists that share ``least`` bytes with one of another component in their
    list, and differ from it in at most ``most`` bits."""
    chosen = lists.select(F.col("list").alias("l_key")).distinct()
    members = postings(classes).join(bounded_broadcast(chosen, chosen.count(), broadcast_rows), F.col("key") == F.col("l_key")).select("key", "fp")
    return alike(with_roots(members, rooted, files), classes, least=least, most=most, block=block)


def alike(members: DataFrame, classes: DataFrame, *, least: int, most: int, block: int = 1024) -> DataFrame:
    """Those of members(key, fp, root) that share ``least`` bytes of the marks of classes(fp, marks) with one of their key and
    of another component, and differ from it in at most ``most`` bits."""

    def compare(key, group):
        import pyarrow as pa

        own, fps, roots = (group.column(c).to_numpy() for c in ("own", "fp", "root"))
        marks = byte_rows(group.column("marks"))
        left, right = np.flatnonzero(own == key[1].as_py()), np.flatnonzero(own == key[2].as_py())
        a, b = alike_members(marks[left], marks[right], roots[left], roots[right], least, most)
        found = np.unique(np.concatenate([left[a], right[b]]))
        return pa.table({"key": pa.array(np.full(len(found), key[0].as_py(), np.int64)), "fp": fps[found], "root": roots[found]})

    return block_pairs(members, classes.select("fp", "marks"), block).groupBy("key", "i", "j").applyInArrow(compare, "key long, fp long, root long").distinct()


def crossing_links(members: DataFrame, sets: DataFrame, *, similarity: float, block: int = 512) -> DataFrame:
    """(a, b): links between members(key, fp, root) of a key and of different components, verified on sets(fp, shingles)."""

    def compare(key, group):
        import pyarrow as pa

        own, fps, roots = (group.column(c).to_numpy() for c in ("own", "fp", "root"))
        shingles = group.column("shingles").combine_chunks()
        bounds, values = shingles.offsets.to_numpy(), shingles.values.to_numpy()
        left, right = np.flatnonzero(own == key[1].as_py()), np.flatnonzero(own == key[2].as_py())
        x, y = ([values[bounds[k] : bounds[k + 1]] for k in side.tolist()] for side in (left, right))
        pairs = np.array(set_links(x, y, roots[left], roots[right], similarity) if x and y else [], np.int64).reshape(-1, 2)
        return pa.table({"a": fps[left[pairs[:, 0]]], "b": fps[right[pairs[:, 1]]]})

    return block_pairs(members, sets, block).groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def sets_of(docs: DataFrame, classes: DataFrame, needed: DataFrame, *, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(fp, shingles) of the classes(fp, r) needed(n_fp), each read from the row that r names."""
    chosen = classes.join(needed.distinct(), F.col("fp") == F.col("n_fp")).select("fp", F.col("r.id").alias("r_id"), F.col("r.digest").alias("r_digest"))
    bound_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, shingle).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["fp", "shingles"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, F.col("id").eqNullSafe(F.col("r_id")) & (F.xxhash64("text") == F.col("r_digest")))
    sets = computed(texts.select("fp", "text"), run, "fp long, shingles array<long>", "shingles")
    # Rows of one id and text give one set each.
    return sets if sets.groupBy("fp").count().filter("count > 1").isEmpty() else sets.dropDuplicates(["fp"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets(fp, shingles) reach the similarity."""
    left, right = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("sizes"))
    return both.filter(F.col("shared") / (F.col("sizes") - F.col("shared")) >= similarity).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, longest: int = 4096) -> DataFrame:
    """(id, digest, fp, component) for every row: component is the smallest id reachable over links. Lists of over ``longest``
    members are made good one by one, shorter ones by group."""
    files, few = splits_of(docs), narrow_files(docs)
    options = {"id_col": id_col, "text_col": text_col, "shingle": shingle}
    marked = sketches(docs, id_col=id_col, text_col=text_col, shingle=shingle)
    classes = marked.groupBy("fp").agg(F.min("id").alias("least"), F.min(F.struct("id", "digest")).alias("r"))
    posted = marked.select("fp", "keys", "marks").dropDuplicates(["fp"])
    found = checkpoint(candidates(posted, longest), few)
    lists, edges = found.filter("list IS NOT NULL").select("list"), found.filter("u IS NOT NULL").select(F.col("u").alias("a"), F.col("v").alias("b"))
    pairs = checkpoint(tallied(found.filter("a IS NOT NULL").select("a", "b"), posted), few)
    rooted = components(verified(pairs, sets_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("n_fp")), **options), similarity))
    if not edges.isEmpty() or not lists.isEmpty():
        groups = with_roots(components(edges).select(F.col("root").alias("key"), F.col("node").alias("fp")), rooted, few)
        members = alike(groups, posted, least=SHARED, most=MARK_BITS)
        if not lists.isEmpty():
            members = members.unionAll(crossing(posted, lists, rooted, least=SHARED, most=MARK_BITS, files=few))
        members = checkpoint(members, few)
        if not members.isEmpty():
            # Kept, so that no task runs two Python workers at once.
            links = checkpoint(crossing_links(members, sets_of(docs, classes, members.select(F.col("fp").alias("n_fp")), **options), similarity=similarity), files)
            rooted = components(links.unionAll(rooted.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return named_components(marked, classes.select("fp", "least"), rooted, id_col).coalesce(files)
