"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: of equal payloads of at least ``revisit_bytes`` the row with the smallest id becomes a response record, the others
revisit records that point at it. Only (digest, id) pairs are grouped; the digests that occur more than once are kept, and
broadcast to the rows while they are at most ``broadcast_rows``, so that payloads aren't shuffled whatever digest is hot;
beyond that the join shuffles, and Spark splits its hot keys. A task writes a .warc.gz file with one gzip member a record,
under its final name only when whole.

Reading: files are cut into byte ranges, a task a range, whatever records lie where. A task scans its range for the
gzip magic number, validates each candidate by inflating its first bytes to a WARC header, then inflates the whole
member with its checksum, and owns the records whose member starts inside the range; the last one may end beyond it.
After a member the next starts at once, so scanning is needed only at the front of a range and past damage.

Defined results: a null payload counts as empty, a very long one is a record like any other; payloads under revisit_bytes
are always responses; of rows equal in payload and id one, with the first url, becomes the response; a null id is written as such and is the smallest only among nulls; an empty table writes no
files and reads no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, bounded_broadcast, checkpoint, computed, narrow_files, open_fs, publish, scratch_dir

GZIP_MAGIC = b"\x1f\x8b\x08"
_HEADER = re.compile(rb"WARC/1\.[01]\r\n")
_CHUNK = 1 << 16


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP headers of its page and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20]", "%20", url or "urn:none")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if kind == "revisit" else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> dict | None:
    """A record's fields, payload and revisit facts; None if it isn't a whole record."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark or not _HEADER.match(head):
        return None
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    length = int(fields["Content-Length"])
    if len(rest) != length + 4:
        return None
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    stated = re.search(rb"(?i)\r\nContent-Length: (\d+)", http)
    return {"fields": fields, "payload": payload, "stated": int(stated[1]) if stated else len(payload)}


def _urn(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def records_in_range(source, start: int, stop: int, size: int):
    """(member start, record) of the members that start in [start, stop) of an open file of that size."""
    at = start
    while at < stop:
        source.seek(at)
        window = source.read(min(_CHUNK, size - at))
        hit = window.find(GZIP_MAGIC)
        if hit < 0:
            if at + len(window) >= size:
                return
            at += max(1, len(window) - len(GZIP_MAGIC) + 1)  # a magic number may lie across two windows
            continue
        at += hit
        if at >= stop:
            return
        end, data = _inflate(source, at, size)
        found = parse(data) if end else None
        if found is None:  # the bytes of the magic number inside a member, or damage
            at += 1
            continue
        yield at, found
        at = end


def _inflate(source, at: int, size: int) -> tuple[int, bytes]:
    """(end, content) of the gzip member at a place, or (0, b'') if there is none that holds a WARC header."""
    source.seek(at)
    unpacker, parts, place, checked = zlib.decompressobj(31), [], at, False
    try:
        while not unpacker.eof:
            chunk = source.read(min(_CHUNK, size - place))
            if not chunk:
                return 0, b""
            place += len(chunk)
            parts.append(unpacker.decompress(chunk))
            if not checked:
                first = b"".join(parts)[:10]
                if len(first) == 10 or unpacker.eof:
                    if not _HEADER.match(first):
                        return 0, b""
                    checked = True
        return place - len(unpacker.unused_data), b"".join(parts)
    except zlib.error:
        return 0, b""


def assign_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0, broadcast_rows: int = 500_000) -> DataFrame:
    """(id, url, payload, revisit, refers_to): refers_to is set for the rows that revisit another."""
    bound_batches(pages.sparkSession)
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    # Short payloads have a key of their own that no group has, and don't meet in one task.
    digest = F.when(F.octet_length("payload") >= revisit_bytes, F.unhex(F.sha1(F.col("payload").cast("binary"))))
    base = base.withColumn("digest", F.coalesce(digest, F.concat(F.lit("-"), F.xxhash64("id", "payload").cast("string")).cast("binary"))).withColumn("long", digest.isNotNull())
    counts = base.filter("long").groupBy("digest", "id").agg(F.count("*").alias("c"))
    first = counts.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "c")).alias("f"), F.sum("c").alias("n")).filter("n > 1")
    first = checkpoint(first.select(F.col("digest").alias("d"), F.col("f.id").alias("first_id"), F.col("f.c").alias("same")), narrow_files(pages))
    joined = base.join(bounded_broadcast(first, first.count(), broadcast_rows), F.col("digest") == F.col("d"), "left")
    later = F.col("d").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    columns = ["id", "url", "payload", "revisit", F.when(F.col("revisit"), F.col("first_id")).alias("refers_to")]
    if first.filter("same > 1").isEmpty():
        return joined.withColumn("revisit", later).select(*columns)
    # Rows of one payload and id: all but one revisit it.
    tied = F.coalesce(F.col("same") > 1, F.lit(False)) & ~later
    number = F.row_number().over(Window.partitionBy("digest").orderBy("url"))
    apart = joined.filter(~tied).withColumn("revisit", later).select(*columns)
    return apart.unionByName(joined.filter(tied).withColumn("revisit", number > 1).select(*columns))


def write_archives(assigned: DataFrame, uri: str) -> DataFrame:
    """Write (id, url, payload, revisit, refers_to) rows; returns the files as (path, bytes, records), already computed."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name, count = f"pages-{TaskContext.get().partitionId():06d}.warc.gz", 0

        def write(out):
            nonlocal count
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    for page_id, url, html, revisit, refers in zip(*[c.to_pylist() for c in batch.slice(at, 500).columns], strict=True):
                        payload = html.encode("utf-8", "surrogatepass")
                        out.write(record("revisit" if revisit else "response", page_id, url, payload, payload_digest(payload), refers))
                        count += 1

        size = publish(uri, name, write)
        if count:
            yield pa.RecordBatch.from_pydict({"path": [f"{uri}/{name}"], "bytes": [size], "records": [count]})

    bound_batches(assigned.sparkSession)
    return computed(assigned, run, "path string, bytes long, records long", "manifest")


def read_archives(files: DataFrame, *, split_bytes: int = 8 << 20) -> DataFrame:
    """Every record of the files (path, bytes): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""

    def run(batches):
        import pyarrow as pa

        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        for batch in batches:
            for path, start, stop, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                filesystem, place = open_fs(path)
                rows, held = [], 0
                with filesystem.open_input_file(place) as source:
                    for _, got in records_in_range(source, start, stop, size):
                        fields, response = got["fields"], got["fields"]["WARC-Type"] == "response"
                        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if response and payload_digest(got["payload"]) != stated:
                            raise ValueError(f"{path}: the payload of {fields['WARC-Record-ID']} differs from its digest")
                        rows.append((_urn(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], len(got["payload"]) if response else got["stated"], stated, fields["WARC-Type"], _urn(fields.get("WARC-Refers-To")), got["payload"]))
                        held += len(got["payload"])
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    splits = files.filter("bytes > 0").select("path", "bytes", starts.alias("start"))
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("stop"), "bytes")
    tasks = max(1, splits.count())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return splits.repartition(tasks, "path", "start").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, *, revisit_bytes: int = 0) -> DataFrame:
    """Write the pages to the shared folder and read the archives back."""
    uri = scratch_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(assign_revisits(pages, revisit_bytes=revisit_bytes), uri))
