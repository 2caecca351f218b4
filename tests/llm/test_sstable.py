"""Token shards: exact round trips against the tokenizer, lookups, and the defined results."""

import io
import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quirelake.llm import sstable
from quirelake.llm.queries import op7_sstable, tokenizer_path

ODD = ["a", "é", " ", "\n", "\t", "  ", "\x1c", "don't", "'s", "<|endoftext|>", "12", "日本", "!?", "\r\n", " \n", "x", "\0"]


class Buffer(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def reference(texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [np.array([*e.ids, 0], "<u4").tobytes() for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_the_library():
    draw = random.Random(3)
    texts = [None, "", *["".join(draw.choice(ODD) for _ in range(draw.randrange(40))) for _ in range(3000)]]
    assert sstable.Encoder(tokenizer_path())(texts) == reference(texts)


def test_encoder_with_a_small_cache(monkeypatch):
    monkeypatch.setattr(sstable, "CACHED_PIECES", 50)
    encode = sstable.Encoder(tokenizer_path())
    for k in range(20):
        texts = [f"word{k} other{k + 1} the same\nline {i}" for i in range(7)]
        assert encode(texts) == reference(texts)


def test_shard_round_trip_and_lookup():
    keys = sorted([None, -5, -1, 0, 3, 3, *range(10, 4000, 7), 2**40], key=lambda k: sstable.key_bytes(k))
    out = Buffer()
    writer = sstable.ShardWriter(out, block_bytes=200)
    values = [struct.pack("<I", i) * (i % 5) + (struct.pack("<I", 70_000) if i % 3 == 0 else b"") for i in range(len(keys))]
    for key, ids in zip(keys, values, strict=True):
        writer.add(sstable.key_bytes(key), np.frombuffer(ids, "<u4"))
    writer.close()
    shard = sstable.Shard(out)
    assert [(sstable.key_id(k), v) for k, v in shard] == list(zip(keys, values, strict=True))
    for key in keys:
        assert shard.get(key) == [v for k, v in zip(keys, values, strict=True) if k == key]
    assert shard.get(11) == [] and shard.get(2**41) == []
    assert sum(shard.bloom.may_have(sstable.key_bytes(k)) for k in range(10**6, 10**6 + 1000)) < 50


def test_damage_is_found():
    out = Buffer()
    writer = sstable.ShardWriter(out)
    writer.add(sstable.key_bytes(1), np.array([9], "<u4"))
    writer.close()
    raw = bytearray(out.getvalue())
    raw[3] ^= 255
    with pytest.raises(ValueError):
        list(sstable.Shard(Buffer(bytes(raw))))


def test_defined_results(spark):
    rows = [(5, "b c", 1), (5, "a", 2), (None, "x", 3), (7, None, 4), (6, "", 5), (5, "a", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = [tuple(r) for r in sstable.token_table(docs, tokenizer_path()).orderBy("start", "doc_id").collect()]
    order = [(None, "x"), (5, "a"), (5, "a"), (5, "b c"), (6, ""), (7, "")]
    ids, start, want = reference([t for _, t in order]), 0, []
    for (key, _), raw in zip(order, ids, strict=True):
        want.append((key, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    assert got == want
    assert sstable.token_table(docs.limit(0), tokenizer_path()).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    start, want = 0, []
    for row, raw in zip(docs, reference([r.text for r in docs]), strict=True):
        want.append((row.doc_id, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    assert [tuple(r) for r in op7_sstable(spark, sf).orderBy("doc_id").collect()] == want
