"""Document fingerprints by consistent weighted sampling.

A text is a weighted set of terms: its lower-cased words between ASCII white space, each weighing 1 + ln(count). For
each of ``samples`` independent samples every term draws r and c from Gamma(2, 1) and b from U(0, 1), all fixed by the
term and the sample, and with weight S gives t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1). The sample is
the pair (term, t) with the smallest a, kept as 32 bits of its hash. Two texts agree in a sample with a probability equal
to their generalised Jaccard similarity, the sum of smaller weights over the sum of larger ones, so the share of
equal samples estimates it with a standard error of at most 0.5 / sqrt(samples).

The gamma draws come from a table of 16,384 draws over a low-discrepancy grid, of which a hash of term and sample
picks two (for r and for c): a logarithm a draw would be most of the cost. Only DataFrame functions are used. A row
counts its own terms, and minima are taken before the shuffle, so what is shuffled is a signature a text.

Defined results: a null or wordless text has no terms and the fingerprint of all ones; two such are wholly alike; very
long texts count all their words; rows of equal id and text are copies of one document and each get its row, rows of equal
id and other text are documents of their own, ordered by a hash of the text; null ids come first, and an empty id is
another than a null one; an empty table gives no rows; the only document of a table is its own follower; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, next_ids, stored

SAMPLES = 64
_TABLE_BITS = 14
_LOW32 = 0xFFFFFFFF


def gamma_table(spark: SparkSession) -> DataFrame:
    """One row: `one` = 0 and `gammas`, draws from Gamma(2, 1) as -ln(u v) over a grid whose v is the bit-reversed u."""
    size = 1 << _TABLE_BITS

    def draw(i: Column) -> Column:
        reversed_bits = F.lit(0).cast("long")
        for bit in range(_TABLE_BITS):
            reversed_bits = reversed_bits.bitwiseOR(F.shiftleft(F.shiftright(i, bit).bitwiseAND(F.lit(1)), _TABLE_BITS - 1 - bit))
        return -F.log((i + 0.5) / size) - F.log((reversed_bits + 0.5) / size)

    draws = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), draw)
    return spark.range(1).select(F.col("id").cast("int").alias("one"), draws.alias("gammas"), F.transform(draws, lambda g: F.log(g)).alias("log_gammas"))


def weighted_terms(text: Column) -> Column:
    """Array of (term, log_weight): the distinct words of a text as hashes, with ln(1 + ln(count))."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    hashes = F.sort_array(F.transform(F.array_remove(F.split(plain, " "), ""), lambda w: F.xxhash64(w)))

    def runs(a: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: (i == F.size(a)) | (F.get(a, i - 1) != F.get(a, i)))

        def pairs(e: Column) -> Column:
            def one(end: Column, k: Column) -> Column:
                count = end - F.coalesce(F.get(e, k - 1), F.lit(0))
                return F.struct(F.get(a, end - 1).alias("term"), F.log(1 + F.log(count.cast("double"))).alias("log_weight"))

            return F.transform(e, one)

        return let(ends, pairs)

    return let(hashes, lambda a: F.when(F.size(a) > 0, runs(a)))


def _sample(i: int) -> Column:
    """The packed minimum of sample i: ln a in the high 32 bits (in order), 32 bits of the hash of (term, t) in the low."""
    h = F.xxhash64(F.col("term").bitwiseXOR(F.lit((i + 1) * 0x0101010101010101 % (1 << 63))))
    mask = F.lit((1 << _TABLE_BITS) - 1)
    r = F.get(F.col("gammas"), h.bitwiseAND(mask).cast("int"))
    log_c = F.get(F.col("log_gammas"), F.shiftrightunsigned(h, 16).bitwiseAND(mask).cast("int"))
    b = F.shiftrightunsigned(h, 48) / 65536.0
    t = F.floor(F.col("log_weight") / r + b)
    log_a = log_c - r * (t.cast("double") - b + 1.0)
    # ln a lies well within (-512, 512), so this fits 31 bits and the sign bit stays clear.
    ordered = F.shiftleft(((log_a + 512.0) * 2097152.0).cast("long"), 32)
    return F.min(F.when(F.col("term").isNotNull(), ordered.bitwiseOR(F.shiftrightunsigned(h, 8).bitwiseXOR(F.shiftleft(t, 9)).bitwiseAND(F.lit(_LOW32)))))


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, signature) from (keys, text): an array of `samples` numbers of 32 bits for every key."""
    table = F.broadcast(gamma_table(texts.sparkSession))  # one row of 1 MB, whatever the input
    terms = texts.select(*keys, F.inline_outer(weighted_terms(F.col("text")))).withColumn("zero", F.lit(0))
    drawn = terms.join(table, F.col("zero") == F.col("one"))
    least = drawn.groupBy(*keys).agg(*[_sample(i).alias(f"m{i}") for i in range(samples)])
    # The low 32 bits, as a signed int; without terms all of them are set.
    return least.select(*keys, F.array(*[F.coalesce(F.shiftright(F.shiftleft(F.col(f"m{i}"), 32), 32), F.lit(-1)).cast("int") for i in range(samples)]).alias("signature"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / float(samples)


def as_hex(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(_LOW32)))), 8, "0")), "")


def edited_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, next_key, n, rows, text, edited) of every document and its follower in ascending order of the id.

    The edited text has the last floor(n_chars / 2) code points replaced by as many of the next document's first, or
    all it has. Only ids and lengths are ordered; of a next document only the part in question moves.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    documents = base.select("id", "digest", F.char_length("text").alias("n")).groupBy("id", "digest", "n").agg(F.count("*").alias("rows"))
    chained = next_ids(documents, "id", ["digest", "n", "rows"])

    # One string names a document: a struct's fields would differ in nullability on both sides of a join, and the
    # casts that follow keep Spark from using the shuffled texts twice.
    def key(prefix: str = "") -> Column:
        own = F.coalesce(F.concat(F.lit("="), F.col(f"{prefix}id").cast("string")), F.lit(""))  # a null id has no mark
        return F.concat(own, F.lit(":"), F.col(f"{prefix}digest").cast("string"))

    links = chained.select(key().alias("key"), key("next_").alias("next_key"), "n", "rows")
    keyed = base.select(key().alias("key"), "text")
    if not base.groupBy("id", "digest").count().filter("count > 1").isEmpty():
        keyed = keyed.dropDuplicates(["key"])
    half = F.floor(F.col("n") / 2).cast("int")
    parts = keyed.join(links.select(F.col("key").alias("before"), F.col("next_key").alias("key"), "n", "rows"), "key")
    parts = parts.select(F.col("before").alias("key"), F.col("key").alias("next_key"), F.substring(F.col("text"), F.lit(1), half).alias("part"), "n", "rows")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - half), F.col("part"))
    return keyed.join(parts, "key").select("key", "next_key", "n", "rows", "text", edited.alias("edited"))


def compare_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every document."""
    pairs = edited_pairs(docs, id_col=id_col, text_col=text_col)
    own = F.struct(F.lit(0).alias("which"), F.col("text").alias("text"))
    other = F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"))
    facts = pairs.select("key", "next_key", "rows", F.col("n").cast("long").alias("n"), F.unhex(F.sha2("edited", 256)).alias("sha"), F.explode(F.array(own, other)).alias("v"))
    names = ["key", "next_key", "rows", "n", "sha"]
    signed = signatures(facts.select(*names, "v.which", "v.text"), [*names, "which"], samples)
    both = signed.groupBy(*names).agg(*[F.max(F.when(F.col("which") == k, F.col("signature"))).alias(c) for k, c in ((0, "own"), (1, "edited"))])
    both = stored(both, "signatures")  # read twice below; the draws are made once
    follower = both.select(F.col("key").alias("f_key"), F.col("own").alias("following"))
    joined = both.join(follower, F.col("next_key") == F.col("f_key"))
    digest_chars = F.char_length(F.substring_index("key", ":", -1))
    own = F.substring(F.col("key"), F.lit(1), F.char_length("key") - digest_chars - 1)
    doc_id = F.when(own != "", F.substring(own, F.lit(2), F.char_length(own))).cast(docs.schema[id_col].dataType)
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return copies.select(
        doc_id.alias(id_col), F.col("n").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"),
        as_hex(F.col("own")).alias("fingerprint"), as_hex(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), samples).alias("near_edited"), likeness(F.col("own"), F.col("following"), samples).alias("near_next"),
    )
