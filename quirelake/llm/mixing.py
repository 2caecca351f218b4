"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: every source has a share of the whole size by its weight, held at ``max_epochs`` times its own size; what
is cut off goes to the others by weight until none is above. In closed form: a source's target is
min(level * weight, cap), and the level comes from prefix sums over sources sorted by cap / weight.

Selection: a source gives floor(target / size) complete epochs of all its documents. What is left of its target is
filled from documents in the order of the exponential key -ln(u) / quality, u being a hash of the document, with
prefix sums of their sizes against the budget; the document on the edge is taken if that brings the source nearer.

The prefix sums are in levels, so that no task holds a source: keys are numbers of 60 bits, sizes are summed by source
and the leading ten of them (before the shuffle), the cell in which a source's budget ends is cut by the next ten bits,
and so on until the cells on the edge are small; only the documents of these are sorted.

Defined results: a null text has size 0, a very long one counts all its words; a null id is an id like any other; a null
source is a source of its own, last in order; a source of size 0 has target 0 and no epochs; repeated rows are documents
of their own with equal keys, of which ties are broken by the row's place; an empty table gives no rows; columns beyond
id, text and source stay out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, bound_batches, bounded_broadcast, checkpoint, narrow_files, packed, splits_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Bits of a document's place in the order of its source, and by how many of them a level cuts.
PLACE_BITS, LEVEL_BITS = 60, 10
#: A source's documents on the edge are sorted in one task up to this number; more are cut by another level.
EDGE_ROWS = 100_000
#: Sources up to this number are broadcast with their targets; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row a source.

    Weights repeat over the sources in code point order, null last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), place + 1)).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    total = F.sum("source_size").over(Window.partitionBy())
    rising = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    # With the sources before this one at their caps, the level at which the rest uses the whole total.
    level = (F.col("_total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    filled = weighted.withColumn("_total", total.cast("double")).withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("w") <= F.col("cap"))
    # The first open source in that order; of equal ratios the first has the highest level.
    first_open = F.min(F.when(F.col("_open"), F.struct((F.col("cap") / F.col("w")).alias("ratio"), (-F.col("_level")).alias("fall")))).over(Window.partitionBy())
    return filled.withColumn("_final", -first_open["fall"]).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("_final") * F.col("w"), F.col("cap"))).alias("target"))


def es_key(id_column: Column, extra: Column, quality: Column, seed: int) -> Column:
    """The exponential key: -ln(u) / quality with u from a hash of the row."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_column, extra), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / quality


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    edge_rows: int = EDGE_ROWS,
    seed: int = 17,
) -> DataFrame:
    """(id, digest, size, source, source_size, target, copies, taken) for every row of docs.

    copies: how often the mix holds the document; taken = copies * size. digest tells rows of one id apart.
    quality: (id, quality) with positive numbers; documents without one weigh 1.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    weight = F.lit(1.0)
    if quality is not None:
        scores = quality.select(F.col(id_col).alias("_qid"), F.col("quality").alias("_q")).groupBy("_qid").agg(F.max("_q").cast("double").alias("_q"))
        slim = slim.join(scores, F.col("id") == F.col("_qid"), "left")
        weight = F.greatest(F.coalesce(F.col("_q"), F.lit(1.0)), F.lit(1e-6))
    key = es_key(F.col("id"), F.col("digest"), weight, seed)
    # 1 - exp(-key) is a monotone image of the key in (0, 1) that spreads the documents evenly.
    place = F.least(((1 - F.exp(-key)) * float(1 << PLACE_BITS)).cast("long"), F.lit((1 << PLACE_BITS) - 1))
    files = narrow_files(docs)
    slim = checkpoint(slim.select("id", "digest", "source", "size", key.alias("key"), place.alias("place"), F.monotonically_increasing_id().alias("row")), files)

    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, max_epochs=max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(max_epochs))).otherwise(F.lit(0)).cast("int")
    targets = targets.withColumn("epochs", epochs).withColumn("budget", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    known = ["p_source", "source_size", "target", "epochs", "budget"]
    everything = (F.lit(0).cast("long").alias("low"), F.lit(1 << PLACE_BITS).alias("width"), F.lit(0).cast("long").alias("before"))
    plan = checkpoint(targets.withColumnRenamed("source", "p_source").select(*known, *everything), files)
    n_sources = plan.count()
    of_source = F.col("source").eqNullSafe(F.col("p_source"))
    on_edge = (F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.col("width"))
    for level in range(1, PLACE_BITS // LEVEL_BITS + 1):
        shift = PLACE_BITS - level * LEVEL_BITS
        sources = bounded_broadcast(plan, n_sources, BROADCAST_SOURCES)
        edge = slim.join(sources, of_source).filter(on_edge)
        cells = edge.groupBy("source", F.shiftright("place", shift).alias("cell")).agg(F.sum("size").alias("cell_size"), F.count("*").alias("cell_rows"))
        running = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = cells.withColumn("upto", F.sum("cell_size").over(running)).join(sources, of_source)  # at most 1024 rows a source
        past = ends.filter(F.col("before") + F.col("upto") > F.col("budget"))
        last = past.groupBy("source").agg(F.min(F.struct("cell", (F.col("before") + F.col("upto") - F.col("cell_size")).alias("before"), "cell_rows")).alias("e"))
        found, nowhere = plan.join(bounded_broadcast(last, n_sources, BROADCAST_SOURCES), of_source, "left"), F.col("e").isNull()
        plan = found.select(
            *known, F.when(nowhere, 1 << PLACE_BITS).otherwise(F.shiftleft("e.cell", shift)).alias("low"), F.when(nowhere, 0).otherwise(1 << shift).cast("long").alias("width"),
            F.coalesce("e.before", "before").alias("before"), F.coalesce("e.cell_rows", F.lit(0)).alias("edge_rows"),
        )
        plan = checkpoint(plan, files)
        if (plan.agg(F.max("edge_rows")).first()[0] or 0) <= edge_rows:
            break

    rows = slim.join(bounded_broadcast(plan, n_sources, BROADCAST_SOURCES), of_source)
    inner = rows.filter(~on_edge).withColumn("chosen", (F.col("place") < F.col("low")) & (F.col("budget") > 0))
    order = Window.partitionBy("source").orderBy("place", "key", "id", "digest", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = rows.filter(on_edge).withColumn("_upto", F.col("before") + F.sum("size").over(order))
    # Nearer with the document than without it: more than half of it is within the budget.
    outer = outer.withColumn("chosen", (F.col("_upto") - F.col("size") / 2.0 < F.col("budget")) & (F.col("budget") > 0)).drop("_upto")
    copies = F.col("epochs") + F.col("chosen").cast("int")
    done = inner.unionByName(outer).withColumn("copies", F.least(copies, F.lit(max_epochs)))
    return done.select(F.col("id").alias(id_col), "digest", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeat_by_mix(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as often as the mix holds them; all columns of docs, no others.

    Rows are joined by id and text. Of rows equal in both, the first take one copy more than the others, so that
    together they come as often as the mix holds them.
    """
    files = splits_of(docs)
    copies = mixed.groupBy(F.col(id_col).alias("m_id"), F.col("digest").alias("m_digest")).agg(F.sum("copies").alias("m_sum"), F.count("*").alias("m_rows")).filter("m_sum > 0")
    named = packed(docs)
    held = F.col("row")[id_col].eqNullSafe(F.col("m_id")) & (F.xxhash64(F.col("row")[text_col]) == F.col("m_digest"))
    each = named.join(copies.filter("m_rows = 1"), held).select("row", F.col("m_sum").alias("n"))
    several = copies.filter("m_rows > 1")
    if not several.isEmpty():
        # Numbered within each partition of the rows, and from there by the partitions' counts.
        equal = checkpoint(named.join(several, held).withColumn("part", F.spark_partition_id()), files)
        key = ["m_id", "m_digest"]
        counts = equal.groupBy(*key, "part").agg(F.count("*").alias("own"))
        before = F.coalesce(F.sum("own").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        earlier = counts.select(*[F.col(c).alias(f"c_{c}") for c in (*key, "part")], before.alias("earlier"))
        number = F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.lit(0))) + F.col("earlier")
        joined = equal.join(earlier, F.col("m_id").eqNullSafe(F.col("c_m_id")) & (F.col("m_digest") == F.col("c_m_digest")) & (F.col("part") == F.col("c_part")))
        extra = (number <= F.pmod("m_sum", "m_rows")).cast("long")
        each = each.unionAll(joined.select("row", (F.floor(F.col("m_sum") / F.col("m_rows")) + extra).alias("n")))
    repeated = each.filter("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return repeated.select("row.*").coalesce(files)
