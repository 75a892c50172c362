"""WARC archives through a table of record chunks.

``chunks`` turns each payload into rows (record, chunk number, bytes) with the running length
and SHA-1 so far, a chunk at a time: no task holds more of a payload than the column value it
was given and one chunk. ``write_archives`` writes each chunk as one WARC record; a payload of
several chunks is a segmented record of the WARC standard (a first record and continuations
with segment numbers). Files are written by Spark's text writer: a record's last blank lines
are its line separator, gzip its compression, and a task that is run again replaces its file.
``read_archives`` streams the files, inflating and parsing piece by piece, and carries a
digest over the segments of a record.

Of records with equal payloads of at least ``min_bytes`` that with the largest key is the
response; the others are revisits that name it and store no payload.

Edge cases: a null payload is empty; a null key is written as the word null and loses to any
other key, and payloads that only null keys have are responses; rows equal in key and payload
are all written, and are all responses if their key is the largest; control characters in a
url are escaped and a null url is left out; an empty table gives an empty archive, which reads
as no rows; further columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
END = b"\r\n\r\n"
PIECE = 1 << 16

CHUNKS = (
    "key string, url string, chunk int, chunks int, data binary, payload_bytes bigint, so_far string, "
    "role string, refers_to string"
)
RECORDS = (
    "key string, url string, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to string, segments int"
)


def base32_sha1(state) -> str:
    return base64.b32encode(state.digest()).decode()


def _payload(value) -> memoryview:
    return memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")


def payload_digests(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, payload_bytes, payload_digest) of each row; the digest takes a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for value in batch.column("_payload"):
                data, state = _payload(value), hashlib.sha1()
                for at in range(0, len(data), PIECE):
                    state.update(data[at : at + PIECE])
                sizes.append(len(data))
                digests.append(base32_sha1(state))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                ["_key", "payload_bytes", "payload_digest"],
            )

    slim = df.select(F.col(key).alias("_key"), F.col(payload).cast("binary").alias("_payload"))
    kind = slim.schema["_key"].dataType.simpleString()
    return slim.mapInArrow(run, f"_key {kind}, payload_bytes bigint, payload_digest string")


def roles(df: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """(key, payload_bytes, payload_digest, refers_to): refers_to is null for responses.

    The largest key of a digest is an aggregate that combines before its shuffle; the join
    that brings it back is between rows without payloads.
    """
    rows = payload_digests(df, key, payload)
    largest = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(
        F.max("_key").alias("_largest")
    )
    joined = rows.join(largest, ["payload_digest", "payload_bytes"], "left")
    other = F.col("_largest").isNotNull() & ~F.col("_largest").eqNullSafe(F.col("_key"))
    return joined.select(
        "_key", "payload_bytes", "payload_digest", F.when(other, F.col("_largest")).alias("refers_to")
    )


def chunks(
    df: DataFrame, key: str, url: str, payload: str, chunk_bytes: int = CHUNK_BYTES, refers_to: str | None = None
) -> DataFrame:
    """The chunk table: one row for each ``chunk_bytes`` of a payload, at least one a record.

    ``so_far`` is the digest of the payload up to and with the chunk, ``payload_bytes`` the
    whole length. A record with a value in ``refers_to`` is a revisit: one chunk without data,
    whose ``so_far`` is the digest of the whole payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "url", "chunk", "chunks", "data", "payload_bytes", "so_far", "role", "refers_to"]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), *[pa.string()] * 3]
        rows, held = [], 0

        def flush():
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for i in range(batch.num_rows):
                data = _payload(batch.column("_payload")[i])
                name, place, refers = (batch.column(c)[i].as_py() for c in ("_key", "_url", "_refers"))
                count, state = max(1, -(-len(data) // chunk_bytes)), hashlib.sha1()
                for k in range(count):
                    part = data[k * chunk_bytes : (k + 1) * chunk_bytes]
                    state.update(part)
                    if refers is None:
                        rows.append(
                            (name, place, k, count, bytes(part), len(data), base32_sha1(state), "response", None)
                        )
                        held += len(part)
                    elif k == count - 1:
                        rows.append((name, place, 0, 1, b"", len(data), base32_sha1(state), "revisit", refers))
                    if held > 4 * chunk_bytes or len(rows) >= 4096:
                        if rows:
                            yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    slim = df.select(
        F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("_key"),
        F.col(url).alias("_url"),
        F.col(payload).cast("binary").alias("_payload"),
        (F.col(refers_to).cast("string") if refers_to else F.lit(None).cast("string")).alias("_refers"),
    )
    return slim.mapInArrow(run, CHUNKS)


_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _escaped(text: str) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f%]", lambda m: b"%%%02X" % m[0][0], text.encode("utf-8", "surrogatepass"))


def _record(row: dict) -> bytes:
    """One WARC record, without the two line breaks that end it."""
    name, number = _escaped(row["key"]).decode(), row["chunk"] + 1
    first = row["chunk"] == 0
    block = (_HTTP % row["payload_bytes"] if first else b"") + row["data"]
    head = [
        ("WARC-Type", row["role"] if first else "continuation"),
        ("WARC-Record-ID", f"<urn:record:{name}>" if first else f"<urn:record:{name}:{number}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
    ]
    if first and row["url"] is not None:
        head.append(("WARC-Target-URI", _escaped(row["url"]).decode()))
    if first and row["chunks"] == 1:
        head.append(("WARC-Payload-Digest", f"sha1:{row['so_far']}"))
    if row["refers_to"] is not None:
        head.append(("WARC-Refers-To", f"<urn:record:{_escaped(row['refers_to']).decode()}>"))
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    if row["chunks"] > 1:
        head.append(("WARC-Segment-Number", str(number)))
        if not first:
            head.append(("WARC-Segment-Origin-ID", f"<urn:record:{name}>"))
        if number == row["chunks"]:
            head.append(("WARC-Segment-Total-Length", str(row["payload_bytes"])))
            head.append(("WARC-Payload-Digest", f"sha1:{row['so_far']}"))
    head.append(("Content-Type", "application/http;msgtype=response" if first else "application/octet-stream"))
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    return b"WARC/1.1\r\n" + lines + b"\r\n" + block


def write_archives(table: DataFrame, path: str) -> None:
    """Write a chunk table as gzipped WARC files, a file for each partition.

    A partition of a scan has at most ``spark.sql.files.maxPartitionBytes`` of input, so that
    bounds a file; chunks of one record follow each other in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = [_record(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["value"])

    records = table.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def _inflated(content: memoryview) -> Iterator[bytes]:
    """The bytes of a file, gzipped (in one or many members) or plain, piece by piece."""
    if bytes(content[:2]) != b"\x1f\x8b":
        for at in range(0, len(content), PIECE):
            yield bytes(content[at : at + PIECE])
        return
    at, inflate = 0, zlib.decompressobj(31)
    while at < len(content):
        data = bytes(content[at : at + PIECE])
        at += len(data)
        while data:
            piece = inflate.decompress(data, 4 * PIECE)
            if piece:
                yield piece
            if inflate.eof:
                data, inflate = inflate.unused_data, zlib.decompressobj(31)
            else:
                data = inflate.unconsumed_tail


class _Stream:
    """Lines and blocks of a file, holding a few pieces of it."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held, self.at = self.held[self.at :] + piece, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (found := self.held.find(mark, self.at)) < 0:
            if not self._more():
                return None
        out, self.at = self.held[self.at : found], found + len(mark)
        return out

    def block(self, length: int) -> Iterator[bytes]:
        while length:
            if self.at == len(self.held) and not self._more():
                raise ValueError("an archive ends inside a record")
            part = self.held[self.at : self.at + length]
            self.at += len(part)
            length -= len(part)
            yield part


def _plain(uri: str | None) -> str | None:
    if uri is None:
        return None
    inner = uri.removeprefix("<").removesuffix(">").removeprefix("urn:record:")
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), inner.encode()).decode("utf-8", "replace")


def parse_archive(content: memoryview) -> Iterator[dict]:
    """The logical records of one file, segments joined: header values, length and digest."""
    stream, state, open_record = _Stream(_inflated(content)), None, None
    while (head := stream.until(END)) is not None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        block, kind = stream.block(int(fields["content-length"])), fields["warc-type"]
        if kind == "continuation":
            if open_record is None or fields["warc-segment-origin-id"] != open_record["id"]:
                raise ValueError("a continuation does not follow its record")
            open_record["segments"] += 1
        else:
            if open_record is not None:
                raise ValueError(f"record {open_record['id']} lacks segments")
            state = hashlib.sha1()
            open_record = {"id": fields["warc-record-id"], "kind": kind, "length": 0, "segments": 1}
            open_record |= {"url": fields.get("warc-target-uri"), "refers": fields.get("warc-refers-to")}
            http, rest = b"", b""
            for part in block:
                http += part
                if END in http:
                    http, rest = http.split(END, 1)
                    break
            sized = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
            open_record["stated"] = int(sized[1]) if sized else None
            state.update(rest)
            open_record["length"] = len(rest)
        for part in block:
            state.update(part)
            open_record["length"] += len(part)
        if b"".join(stream.block(len(END))) != END:
            raise ValueError(f"record {open_record['id']} does not end where it says")
        total = fields.get("warc-segment-total-length")
        if "warc-segment-number" in fields and total is None:
            continue
        digest = base32_sha1(state)
        stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind != "revisit" and ((stated and stated != digest) or (total and int(total) != open_record["length"])):
            raise ValueError(f"record {open_record['id']} does not have the payload it states")
        yield {
            "key": _plain(open_record["id"]),
            "url": _plain(open_record["url"]),
            "payload_bytes": open_record["stated"] if kind == "revisit" else open_record["length"],
            "payload_digest": stated if kind == "revisit" else digest,
            "record_type": open_record["kind"],
            "refers_to": _plain(open_record["refers"]),
            "segments": open_record["segments"],
        }
        open_record = None
    if open_record is not None:
        raise ValueError(f"record {open_record['id']} lacks segments")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, read with Spark's file reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("key", pa.string()),
                ("url", pa.string()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("record_type", pa.string()),
                ("refers_to", pa.string()),
                ("segments", pa.int32()),
            ]
        )
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for row in parse_archive(memoryview(content.as_buffer())):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def archive_pages(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    chunk_bytes: int = CHUNK_BYTES,
) -> None:
    """Write every row of ``pages`` as a response or a revisit."""
    decided = roles(pages, key, payload, min_bytes).select(
        F.col("_key").alias("_role_key"), F.col("refers_to").alias("_refers_to"), "payload_digest"
    )
    decided = decided.groupBy("_role_key", "payload_digest").agg(F.max("_refers_to").alias("_refers_to"))
    hexes = F.sha1(F.coalesce(F.col(payload).cast("binary"), F.lit(b"")))
    keyed = pages.select(key, url, payload).withColumn("_sha1", hexes)
    decided = decided.select("_role_key", "_refers_to", _hex_of_base32(F.col("payload_digest")).alias("_role_sha1"))
    same = F.col(key).eqNullSafe(F.col("_role_key")) & (F.col("_sha1") == F.col("_role_sha1"))
    ready = keyed.join(decided, same).select(key, url, payload, "_refers_to")
    write_archives(chunks(ready, key, url, payload, chunk_bytes, "_refers_to"), path)


def _hex_of_base32(column):
    """The lower-case hexadecimal form of an upper-case base32 SHA-1 (32 characters)."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for at in range(1, 32, 4):
        value = F.lit(0)
        for i in range(4):
            value = value * 32 + F.instr(F.lit(alphabet), F.substring(column, at + i, 1)) - 1
        parts.append(F.lpad(F.lower(F.hex(value)), 5, "0"))
    return F.concat(*parts)
