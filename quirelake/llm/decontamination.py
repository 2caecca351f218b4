"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Texts are lower-cased, everything but letters and digits becomes a space, and their 5-word shingles are compared. A
document is contaminated by an item if it holds at least ``threshold`` of the item's distinct shingles.

Search: items are partitioned by size (powers of two of their shingle count). An item's sketch is its bottom-k
MinHash: the shingles with the k smallest hashes, k being set by its partition so that a document which
holds the threshold share of any item of that size must hold a member of the sketch (k is one more than the shingles
that may be missing from the largest item of the partition). The sketch is probed against every shingle of the
document, as in the containment form of MinHash: a signature of the document itself would be useless here,
since the Jaccard similarity of a short item and a long document tends to zero. Documents with fewer shingles than
the item's share are passed over. Candidates are then verified on the shingles themselves, not their hashes.

Only DataFrame functions are used. The sketches and the candidate pairs, 16 bytes a row, are broadcast while their number
is within ``broadcast_rows``, the items' shingles while their texts are within ``broadcast_bytes``; beyond that they are
joined by a shuffle. Documents are exploded to hashes and never gathered.

Defined results: null or wordless texts and items have no shingles and match nothing; an item or document with
fewer words than a shingle has one, all its words, which only an equally short document can hold; repeated items and
rows give one row for a pair of ids, with the highest containment; very long documents are read whole; null ids are kept
as ids; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded_broadcast, checkpoint, let, narrow_files, packed

SHINGLE = 5
THRESHOLD = 0.8
#: Sketch rows (16 bytes each before overhead) up to which the sketches are broadcast, and candidates likewise.
BROADCAST_ROWS = 1_000_000
#: Bytes of the items' texts up to which their shingles, some five times as many, are broadcast.
BROADCAST_BYTES = 1 << 23


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), "")


def _windows(text: Column, build, n: int) -> Column:
    """build(words, first place) over the places of a text at which n words start; one for fewer words, none for none."""
    return let(words(text), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: build(w, i))))


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """The shingles of a text, as strings; null without words."""
    return _windows(text, lambda w, i: F.array_join(F.slice(w, i, n), " "), n)


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of the same; fewer words hash with nulls in the missing places."""
    return _windows(text, lambda w, i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(n)]), n)


def sketches(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(item, least, hash): the bottom-k sketch of every item; least: the shingles a document needs to reach the threshold."""
    hashed = items.select(F.col(id_col).alias("item"), F.array_sort(F.array_distinct(shingle_hashes(F.col(text_col)))).alias("h"))
    size = F.size("h")
    upper = F.pow(F.lit(2), F.floor(F.log2(size.cast("double")) + 1e-9) + 1) - 1
    k = (F.floor(upper * (1 - threshold) + 1e-9) + 1).cast("int")
    return hashed.filter(size > 0).select("item", F.ceil(size * threshold - 1e-9).cast("long").alias("least"), F.explode(F.slice("h", F.lit(1), k)).alias("hash"))


def candidates(docs: DataFrame, sketch: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc, item) pairs of which the document is long enough and holds a member of the item's sketch."""
    hashed = docs.select(F.col(id_col).alias("doc"), shingle_hashes(F.col(text_col)).alias("h"))
    probes = hashed.select("doc", F.size("h").alias("n"), F.explode("h").alias("d_hash"))
    joined = probes.join(bounded_broadcast(sketch, sketch.count(), broadcast_rows), F.col("d_hash") == F.col("hash"))
    return joined.filter(F.col("n") >= F.col("least")).select("doc", "item").distinct()


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, item, containment) of every pair at or above the threshold."""
    bound_batches(docs.sparkSession)
    sketch = checkpoint(sketches(items, id_col=item_col, text_col=text_col, threshold=threshold))
    found = checkpoint(candidates(docs, sketch, id_col=id_col, text_col=text_col, broadcast_rows=broadcast_rows), narrow_files(docs))
    parts = items.select(F.col(item_col).alias("item_"), F.array_distinct(shingles(F.col(text_col))).alias("item_shingles")).filter(F.size("item_shingles") > 0)
    size = items.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    pairs = bounded_broadcast(found, found.count(), broadcast_rows)
    texts = docs.select(F.col(id_col).alias("doc_"), F.col(text_col).alias("text_"))
    held = texts.join(pairs, F.col("doc_").eqNullSafe(F.col("doc"))).join(bounded_broadcast(parts, size, broadcast_bytes), F.col("item").eqNullSafe(F.col("item_")))
    share = F.size(F.array_intersect("item_shingles", shingles(F.col("text_")))) / F.size("item_shingles")
    exact = held.select("doc", "item", share.alias("containment")).filter(F.col("containment") >= threshold - 1e-9)
    return exact.groupBy(F.col("doc").alias(id_col), F.col("item").alias(item_col)).agg(F.max("containment").alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The documents that hold no item; all columns stay."""
    found = contaminated(docs, items, id_col=id_col)
    bad = checkpoint(found.select(F.col(id_col).alias("_bad_id")).distinct(), narrow_files(docs))
    clean = packed(docs).join(bounded_broadcast(bad, bad.count(), BROADCAST_ROWS), F.col("row")[id_col].eqNullSafe(F.col("_bad_id")), "left_anti")
    return clean.select("row.*")
