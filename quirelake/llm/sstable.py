"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their id. Its parts, in this order:

- data blocks: entries (shared key bytes, further key bytes, value bytes, as varints; the further key; the value),
  where a key is the id as 8 big-endian bytes with the sign bit flipped, so that byte order is numeric order, and is
  stored less the prefix it shares with the entry before; the first entry of a block shares nothing. Blocks close at
  ``block_bytes`` and are compressed with zstandard, with a crc32 of the compressed bytes after them.
- a value is a document's ids: one byte for their width (2 or 4), then the ids in little-endian order.
- a sparse index: for each block its last key, offset and length; a Bloom filter over the keys; a JSON summary.
- a footer of fixed size: offset and length of the three, and a magic number.

Writing: documents are dealt by ranges of the id and sorted, a task writes one shard after the other, each up to a size,
and a shard appears under its final name only when whole, so a task that runs again replaces it. Reading: a task a shard, block by block, or one
key by a binary search of the sparse index after the Bloom filter.

Defined results: null texts count as empty (the end id alone); repeated ids stay as entries of their own, ordered by
a hash of the text; very long texts are entries like any other; a null id is stored as the smallest key and read back as null; an empty table has no shards and no rows;
columns beyond the id and the text are ignored.
"""

from __future__ import annotations

import bisect
import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, computed, open_fs, publish, scratch_dir, worker_cache
from .words import SHORT, Table, distinct_keys, joined, short_keys, spans, text_buffer

MAGIC = b"QLSST\x00\x01\n"
FOOTER = "<6Q8s"
#: Distinct pieces whose ids a Python worker keeps, of some 60 bytes each; beyond them it starts afresh.
CACHED_PIECES = 500_000


# --- encoding -------------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The byte-level pre-tokenizer never lets a token run from a non-space character into following white space, so a
    text can be cut before each space or line break that follows a non-space character without changing its ids.
    The library then encodes each distinct piece once. Texts stay UTF-8 in one buffer and are cut, looked up and put
    together in numpy: pieces of up to 15 bytes are keys of a table of arrays; longer ones are few and go through a
    dict. New pieces that start with a space are encoded many in a row and told apart by the tokens that start with a
    space, of which a piece has one, its first.
    """

    def __init__(self, path: str, end_id: int | None = 0):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(k) or "").startswith("\u0120") for k in range(size)])
        self.end = [] if end_id is None else [end_id]
        self._forget()

    def _forget(self) -> None:
        """An empty table; place 0 is the end of a text."""
        self.long: dict[bytes, int] = {}
        self.count, self.used = 1, len(self.end)
        self.first, self.sizes, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, "<u4")
        self.sizes[0], self.ids[: self.used] = self.used, self.end
        self.table = Table()

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Store the ids of new pieces, one after the other; returns the pieces' places."""
        places = np.arange(self.count, self.count + len(sizes))
        while len(self.first) < self.count + len(sizes):
            self.first, self.sizes = np.concatenate([self.first, self.first]), np.concatenate([self.sizes, self.sizes])
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.first[places], self.sizes[places] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.count, self.used = self.count + len(sizes), self.used + len(ids)
        return places

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The places of new pieces, given by their place in the data."""
        flat = data[spans(starts, lengths)]
        edges = np.concatenate([[0], np.cumsum(lengths)])
        blank = np.add.reduceat((flat <= 32) | (flat == ord("<")), edges[:-1])
        plain = (flat[edges[:-1]] == 32) & (blank == 1)
        rows = np.flatnonzero(plain)
        found = np.zeros(len(starts), np.int64)
        own = [rows[at : at + 400] for at in range(0, len(rows), 400)]
        rest = [np.flatnonzero(~plain)]
        text = [data[spans(starts[g], lengths[g])].tobytes().decode("utf-8") for g in own]
        for group, ids in zip(own, self._encode(text), strict=True):
            marks = np.flatnonzero(self.spaced[ids])
            if len(marks) == len(group):
                found[group] = self._keep(ids, np.diff(np.append(marks, len(ids))))
            else:
                rest.append(group)
        single = np.concatenate(rest)
        raw = flat.tobytes()
        each = self._encode([raw[edges[k] : edges[k + 1]].decode("utf-8") for k in single.tolist()])
        if each:
            found[single] = self._keep(np.concatenate(each), np.array([len(e) for e in each]))
        return found

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of the texts in them) of the texts between the bounds in a buffer of UTF-8."""
        if self.count > CACHED_PIECES:
            self._forget()
        starts = piece_starts(data, bounds)
        lengths = np.diff(np.append(starts, bounds[-1]))
        short = lengths <= SHORT
        at, n = starts[short], lengths[short]
        low, high = short_keys(data, at, n)
        known = self.table.find(low, high)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            first, number = distinct_keys(low[missing], high[missing])
            first = missing[first]
            places = self._learn(data, at[first], n[first])
            self.table.add(low[first], high[first], places)
            known[missing] = places[number]
        places = np.zeros(len(starts), np.int64)
        places[short] = known
        long = np.flatnonzero(~short)
        if len(long):
            raw = [data[a : a + k].tobytes() for a, k in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)]
            fresh = list(dict.fromkeys(r for r in raw if r not in self.long))
            for at in range(0, len(fresh), 1000):
                some = fresh[at : at + 1000]
                each = self._encode([r.decode("utf-8") for r in some])
                self.long.update(zip(some, self._keep(np.concatenate(each), np.array([len(e) for e in each])).tolist(), strict=True))
            places[long] = [self.long[r] for r in raw]
        # Place 0, the end, after the pieces of every text.
        upto = np.searchsorted(starts, bounds[1:])
        places = np.insert(places, upto, 0)
        sizes = self.sizes[places]
        ids = self.ids[spans(self.first[places], sizes)]
        ends = np.cumsum(sizes)[upto + np.arange(len(upto))] if len(upto) else upto
        return ids, np.concatenate([[0], ends])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids with the end id, as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode(*joined(texts))
        return [ids[i:j].tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start: at every text that isn't empty, and at each space or line break after a character other than white space."""
    at = np.flatnonzero((data[1:] == 32) | (data[1:] == 10)) + 1
    before = data[at - 1]
    at, before = at[before > 32], before[before > 32]
    # White space outside of ASCII: U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000.
    odd = np.flatnonzero(before >= 0x80)
    c, b, a = (data[np.maximum(at[odd] - k, 0)].astype(np.int64) for k in (1, 2, 3))
    pair, triple = b << 8 | c, a << 16 | b << 8 | c
    wide = ((triple >= 0xE28080) & (triple <= 0xE2808A)) | np.isin(triple, (0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080))
    marked = np.zeros(len(data), bool)
    marked[at] = True
    marked[at[odd[wide | (pair == 0xC285) | (pair == 0xC2A0)]]] = False
    marked[bounds[:-1][np.diff(bounds) > 0]] = True
    return np.flatnonzero(marked)


# --- the file format ------------------------------------------------------------------------------------------------


def key_bytes(doc_id: int | None) -> bytes:
    return struct.pack(">Q", 0 if doc_id is None else (doc_id + (1 << 63)) & ((1 << 64) - 1)) + (b"" if doc_id is None else b"\x01")


def key_id(key: bytes) -> int | None:
    return None if len(key) == 8 else struct.unpack(">Q", key[:8])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def pack_ids(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def unpack_ids(value: bytes) -> bytes:
    return value[1:] if value[0] == 4 else np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes()


class Bloom:
    """A Bloom filter with double hashing; about 1 in 100 absent keys pass at 10 bits a key."""

    def __init__(self, bits: np.ndarray, probes: int = 7):
        self.bits, self.probes = bits, probes

    @staticmethod
    def _places(keys: list[bytes], size: int, probes: int) -> np.ndarray:
        import xxhash

        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        return ((a[:, None] + b[:, None] * np.arange(probes, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: list[bytes], bits_per_key: int = 10) -> Bloom:
        flags = np.zeros(max(64, -(-len(keys) * bits_per_key // 8) * 8), np.uint8)
        if keys:
            flags[cls._places(keys, len(flags), 7)] = 1
        return cls(np.packbits(flags, bitorder="little"))

    def may_have(self, key: bytes) -> bool:
        places = self._places([key], len(self.bits) * 8, self.probes)[0]
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in places)


class ShardWriter:
    """Writes sorted (key, ids) entries to an open stream."""

    def __init__(self, out, block_bytes: int = 1 << 16):
        import zstandard

        self.out, self.block_bytes, self.compressor = out, block_bytes, zstandard.ZstdCompressor(level=1)
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []
        self.entries = self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value, shared = pack_ids(ids), 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if key != self.last or not self.keys:
            self.keys.append(key)
        self.last, self.entries, self.tokens = key, self.entries + 1, self.tokens + len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            packed = self.compressor.compress(bytes(self.block))
            self.index.append((self.last, self.out.tell(), len(packed) + 4))
            self.out.write(packed + struct.pack("<I", zlib.crc32(packed)))
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        parts = [b"".join(_varint(len(k)) + k + struct.pack("<QQ", o, n) for k, o, n in self.index), Bloom.of(self.keys).bits.tobytes(), json.dumps({"entries": self.entries, "tokens": self.tokens}).encode()]
        places = []
        for part in parts:
            places += [self.out.tell(), len(part)]
            self.out.write(part)
        self.out.write(struct.pack(FOOTER, *places, MAGIC))


class Shard:
    """An open shard: iteration in key order, or the entries of one id."""

    def __init__(self, source):
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        tail = struct.calcsize(FOOTER)
        *places, magic = struct.unpack(FOOTER, self._at(source.size() - tail, tail))
        if magic != MAGIC:
            raise ValueError("not a shard: its footer has another magic number")
        raw, bloom, summary = (self._at(*places[i : i + 2]) for i in (0, 2, 4))
        self.bloom, self.summary = Bloom(np.frombuffer(bloom, np.uint8)), json.loads(summary)
        self.index, at = [], 0
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QQ", raw, at + n)))
            at += n + 16

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def _block(self, k: int):
        packed = self._at(*self.index[k][1:])
        if zlib.crc32(packed[:-4]) != struct.unpack("<I", packed[-4:])[0]:
            raise ValueError(f"block {k} is damaged: its checksum differs")
        data, at, key = self.decompressor.decompress(packed[:-4]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            yield key, unpack_ids(data[at + more : at + more + size])
            at += more + size

    def __iter__(self):
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, doc_id: int | None) -> list[bytes]:
        key = key_bytes(doc_id)
        if not self.bloom.may_have(key):
            return []
        found, k = [], bisect.bisect_left([last for last, _, _ in self.index], key)
        while k < len(self.index):
            for got, ids in self._block(k):
                if got == key:
                    found.append(ids)
                elif got > key:
                    return found
            k += 1
        return found


# --- Spark ----------------------------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, uri: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, tasks: int | None = None, shard_bytes: int = 1 << 28) -> DataFrame:
    """Encode and write; returns the manifest (task, shard, path, entries, tokens, bytes), a row a shard, already computed.

    A task closes a shard at ``shard_bytes`` and starts the next. Documents are dealt by ranges of the id and a hash of the
    text, so that rows of one id can lie in several tasks.
    """
    count = tasks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound_batches(docs.sparkSession)

    def entries(batches):
        encode = worker_cache("encoders").setdefault((tokenizer, end_id), None)
        if encode is None:
            encode = worker_cache("encoders")[tokenizer, end_id] = Encoder(tokenizer, end_id)
        for batch in batches:
            # In slices, so that few ids are held at once.
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, ends = encode.encode(*text_buffer(part.column(1)))
                for doc_id, i, j in zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    yield key_bytes(doc_id), ids[i:j]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, shard, rest = TaskContext.get().partitionId(), 0, entries(batches)
        first = next(rest, None)
        while first is not None:
            state = {}

            def write(out, first=first, state=state):
                writer, entry = ShardWriter(out), first
                while entry is not None and (writer.entries == 0 or out.tell() < shard_bytes):
                    writer.add(*entry)
                    entry = next(rest, None)
                writer.close()
                state.update(entries=writer.entries, tokens=writer.tokens, following=entry)

            name = f"shard-{task:06d}-{shard:04d}.sst"
            size = publish(uri, name, write)
            yield pa.RecordBatch.from_pydict({"task": [task], "shard": [shard], "path": [f"{uri}/{name}"], "entries": [state["entries"]], "tokens": [state["tokens"]], "bytes": [size]})
            first, shard = state["following"], shard + 1

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = picked.withColumn("digest", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_first(), F.col("digest")]
    dealt = keyed.repartitionByRange(count, *order).sortWithinPartitions(*order, "text").select("id", "text")
    return computed(dealt, run, "task long, shard long, path string, entries long, tokens long, bytes long", "manifest")


def read_shards(manifest: DataFrame, *, id_col: str = "doc_id", task_bytes: int = 4 << 20) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every entry, read back from the files; start counts the ids of all entries before it.

    A task reads shards of about ``task_bytes``.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                filesystem, place = open_fs(path)
                rows: dict[str, list] = {"id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                with filesystem.open_input_file(place) as source:
                    for key, ids in Shard(source):
                        for column, value in zip(rows.values(), (key_id(key), start, len(ids) // 4, zlib.crc32(ids)), strict=True):
                            column.append(value)
                        start += len(ids) // 4
                        if len(rows["id"]) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows.values()], list(rows))
                            rows = {k: [] for k in rows}
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows.values()], list(rows))

    before = F.coalesce(F.sum("tokens").over(Window.orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = manifest.withColumn("start", before)  # a row a shard
    tasks = max(1, -(-(manifest.agg(F.sum("bytes")).first()[0] or 0) // task_bytes))
    found = starts.select("path", "start").repartition(tasks).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumnRenamed("id", id_col)


def token_table(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids to shards in the shared folder and read them back."""
    uri = scratch_dir(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, uri, tokenizer, id_col=id_col, text_col=text_col), id_col=id_col)
