"""Language identification by compression: the language whose dictionary compresses a text best.

Learning gathers a raw-content zstandard dictionary for each language from a bounded sample of its rows: whole texts in
the order of a hash of id and text, until ``dictionary_bytes`` are full, each text at most an eighth of that (if a language
has no text so short, its shortest), equal texts once. Every language with training rows is learned; many languages share
``all_bytes``, so their dictionaries get smaller. Dictionaries and texts are lower-cased, and everything but letters becomes
single spaces. A text is cut into blocks of ``block_bytes``, so that a long text doesn't become its own dictionary, every
block is compressed with every dictionary, and the language with the smallest sum wins. A text is rejected when the
runner-up is within ``margin`` (share of its bytes) of the winner.

Defined results: a null text or one without a letter gets `und`, score 0 and is rejected; without any learned language
every text does; ties go to the language with more training rows; very long texts are read whole; repeated rows each get
a row; ids may be null; an empty table gives no rows; columns beyond the id and the text are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_crc

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    """Lower-cased letters with single spaces, one at either end."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def training_rows(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """The fold to learn from: a language is given and the crc32 of the id leaves a remainder other than 1 by 3."""
    return docs.filter((id_crc(F.col(id_col)) % 3 != 1) & F.col(lang_col).isNotNull())


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dictionary_bytes: int = 300_000, all_bytes: int = 1 << 25, rows_per_language: int = 1000) -> dict[str, bytes]:
    """Language to dictionary, the most frequent language first. Of a language at most about ``rows_per_language`` sizes and
    ``dictionary_bytes`` of texts reach the driver."""
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    size, draw = F.octet_length(text_col), F.xxhash64(F.lit(29), F.col(id_col), F.col(text_col))
    facts = [F.count("*").alias("n"), F.min(F.struct(size.alias("size"), draw.alias("h"))).alias("shortest")]
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(*facts).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return {}
    room = min(dictionary_bytes, max(1024, all_bytes // len(counts)))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, rows_per_language / r["n"])) for r in counts], "r_lang string, rate double")
    unit = F.shiftrightunsigned(draw, 11).cast("double") / float(1 << 53)
    drawn = rows.select(F.col(lang_col).alias("lang"), draw.alias("h"), size.alias("size"), unit.alias("unit")).filter(F.col("size") <= room // 8)
    drawn = drawn.join(F.broadcast(rates), F.col("lang") == F.col("r_lang")).filter("unit < rate")  # a row a language
    held: dict[str, int] = {}
    chosen: set[int] = set()
    for row in sorted(drawn.select("lang", "h", "size").distinct().collect()):
        if held.get(row["lang"], 0) < room:
            held[row["lang"]] = held.get(row["lang"], 0) + row["size"]
            chosen.add(row["h"])
    chosen |= {r["shortest"]["h"] for r in counts if r["lang"] not in held}
    wanted = docs.sparkSession.createDataFrame([(h,) for h in chosen], "c long")
    found = rows.join(F.broadcast(wanted), draw == F.col("c")).select(F.col(lang_col).alias("lang"), F.col("c").alias("h"), F.col(text_col).alias("text")).distinct()
    parts: dict[str, dict[str, None]] = {}
    for row in sorted(found.collect()):
        parts.setdefault(row["lang"], {})[row["text"]] = None
    return {r["lang"]: "".join(normalise(t) for t in parts[r["lang"]]).encode("utf-8", "surrogatepass") for r in counts if r["lang"] in parts}


class Classifier:
    """Compressors with one dictionary a language."""

    def __init__(self, dictionaries: dict[str, bytes], *, level: int = 6, block_bytes: int = 1024, margin: float = 0.01):
        import zstandard

        self.languages, self.block_bytes, self.margin = list(dictionaries), block_bytes, margin
        self.compress = []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> np.ndarray:
        data = normalise(text).encode("utf-8", "surrogatepass")
        blocks = [data[at : at + self.block_bytes] for at in range(0, len(data), self.block_bytes)]
        return np.array([sum([len(c(b)) for b in blocks]) for c in self.compress], np.int64)

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, relative margin to the runner-up, rejected)."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(text)
        best = int(sizes.argmin())
        # Code lengths as probabilities; a byte saved counts as one bit of evidence, since blocks hide part of the gain.
        score = float(1.0 / np.exp2(-np.minimum(sizes - sizes[best], 1000.0)).sum())
        rest = np.delete(sizes, best)
        gap = float((rest.min() - sizes[best]) / rest.min()) if len(rest) else 1.0
        return self.languages[best], score, gap, gap < self.margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.01) -> DataFrame:
    """(id, lang_pred, score, margin, rejected) for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        classify = Classifier(dictionaries, margin=margin)
        for batch in batches:
            found = list(map(classify, batch.column(1).to_pylist()))
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["id", "lang_pred", "score", "margin", "rejected"])

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, lang_pred string, score double, margin double, rejected boolean")
    return named.withColumnRenamed("id", id_col)
