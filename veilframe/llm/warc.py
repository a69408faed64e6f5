"""WARC archives as chunked record tables.

A payload is never copied as a whole: chunks are views of the source batch's memory.  It travels as rows (record identifier,
chunk number, compressed chunk, SHA-1 and length so far), is written to an archive chunk by chunk and is read back the
same way.  The last chunk row of a record carries the digest of the whole payload.

Archives are written by Python tasks through ``pyarrow.fs`` to a folder that driver and executors share (any file
system that pyarrow knows by URI).  A task writes to a name of its own and then renames, so a lost or
repeated attempt leaves no partial archive.  Each record is one gzip member.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, shared_path, spread_join

#: Bytes of a payload chunk, and bytes that are read from an archive at once.
CHUNK = 64 << 10
#: Smaller payloads are always stored in full.
LEAST_REVISIT = 1000
#: What ends a record.
END = b"\r\n\r\n"

CHUNK_SCHEMA = "record_id string, page_id {kind}, url string, record_type string, refers_to {kind}, chunk_no long, data binary, bytes_so_far long, sha1_so_far string, payload_bytes long, payload_digest string, last boolean"


def id_kind(kind: str) -> str:
    """Ids travel as longs or as strings."""
    return "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "string"


def payload_view(value: pa.Scalar) -> memoryview:
    """A text's UTF-8 bytes where they are; nothing is copied."""
    return memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")


def identifier(page_id: object, digest: str) -> str:
    return hashlib.md5(f"{'' if page_id is None else page_id}:{digest}".encode()).hexdigest()


def record_key() -> Column:
    """``identifier`` as an expression over ``page_id`` and ``digest``."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest"))


def roles(digests: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``(record_id, record_type, refers_to)`` for the distinct records of ``digests(page_id, digest, size)``.

    Of records with equal payloads of at least ``least`` bytes the one with the largest id is the response.  Groups
    of copies are combined before they meet, and a large group is split when it is looked up.  Records without id
    are never referred to.
    """
    rows = digests.select("page_id", "digest", "size").distinct()
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = spread_join(rows, groups.drop("size"), "digest", "page_id", "left", digests)
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("largest")), F.col("largest"))
    return found.select(record_key().alias("record_id"), F.when(refers.isNotNull(), "revisit").otherwise("response").alias("record_type"), refers.alias("refers_to"))


def payload_chunks(pages: DataFrame, id_col: str, url_col: str, payload_col: str, chunk: int = CHUNK) -> DataFrame:
    """Compressed chunk rows of every payload, each with the length and SHA-1 so far (a null payload is one empty chunk)."""
    names = ("record_id", "row_id", "page_id", "url", "chunk_no", "data", "bytes_so_far", "sha1_so_far", "payload_bytes", "digest")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            held = 0
            for page, url, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = payload_view(text)
                starts = range(0, max(1, len(payload)), chunk)
                # the record's identifier needs the whole digest, so the chunks are read once before they are cut
                whole, running = hashlib.sha1(), hashlib.sha1()
                for at in starts:
                    whole.update(payload[at : at + chunk])
                digest = whole.hexdigest()
                record, source_row = identifier(page, digest), source_row + 1
                for number, at in enumerate(starts):
                    part = payload[at : at + chunk]
                    running.update(part)
                    data = zlib.compress(part, 1)
                    held += len(data)
                    for column, value in zip(rows, (record, source_row, page, url, number, data, at + len(part), running.hexdigest(), len(payload), digest), strict=True):
                        column.append(value)
                    if held > 8 << 20:
                        yield batch_of(rows, names, batch.column(0).type)
                        rows, held = [[] for _ in names], 0
            yield batch_of(rows, names, batch.column(0).type)

    kind = id_kind(pages.schema[id_col].dataType.simpleString())
    source = pages.select(pages[id_col].cast(kind).alias("p"), pages[url_col].alias("u"), pages[payload_col].alias("t"))
    return map_arrow(source, cut, f"record_id string, row_id long, page_id {kind}, url string, chunk_no long, data binary, bytes_so_far long, sha1_so_far string, payload_bytes long, digest string")


def batch_of(rows: list[list], names: tuple[str, ...], page_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"page_id": page_type, "refers_to": page_type, "data": pa.binary(), "chunk_no": pa.int64(), "row_id": pa.int64(), "payload_bytes": pa.int64(), "bytes_so_far": pa.int64(), "last": pa.bool_()}
    return pa.RecordBatch.from_pydict({n: pa.array(r, kinds.get(n, pa.string())) for n, r in zip(names, rows, strict=True)})


def _one_line(value: object) -> str:
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in str(value))


def record_head(row: dict, date: str) -> bytes:
    """The record's header lines and the HTTP header that begins its block."""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(row['record_id'])}>", f"WARC-Date: {date}"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_one_line(row['url'])}")
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {quote(str(row['page_id']), safe='')}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['digest'])).decode()}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.UUID(identifier(row['refers_to'], row['digest']))}>", f"X-Refers-To-Page-Id: {quote(str(row['refers_to']), safe='')}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT, date: str = "2000-01-01T00:00:00Z", chunk: int = CHUNK) -> DataFrame:
    """Write a WARC record per row of ``pages``; returns the manifest ``(path, n_records, n_bytes)``, a written table.

    A null payload is empty, a null url or id is left out of the record's headers.  Rows that are equal in id and payload
    are one record each, of the same type.  Ids are longs (any integer type) or strings (any other), which are written
    percent-encoded; of a url's characters those that no header line can hold are.
    """
    payload = F.coalesce(pages[payload_col], F.lit(""))
    kind = id_kind(pages.schema[id_col].dataType.simpleString())
    digests = materialize(pages.select(pages[id_col].cast(kind).alias("page_id"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("size")), "digests")
    # rows of one id and payload are split by row, so however many there are, they are not one task's work
    records = digests.select(record_key().alias("record_id"))
    rows = spread_join(payload_chunks(pages, id_col, url_col, payload_col, chunk), roles(digests, least), "record_id", "row_id", counted=records).where("record_type = 'response' or chunk_no = 0")
    columns = ("record_id", "row_id", "page_id", "url", "chunk_no", "data", "bytes_so_far", "sha1_so_far", "payload_bytes", "digest", "record_type", "refers_to")
    rows = rows.select(*columns).sortWithinPartitions("record_id", "row_id", "chunk_no")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        final = f"{root}/part-{task.partitionId():05d}.warc.gz"
        own = f"{root}/.{task.partitionId():05d}-{task.taskAttemptId()}.tmp"
        n, now, squeeze, number = 0, None, None, 0
        with store.open_output_stream(own, compression=None) as out:
            for row in rows_of(batches):
                if now != (row["record_id"], row["row_id"]):
                    if squeeze:
                        out.write(squeeze.compress(END) + squeeze.flush())
                    now, squeeze, n = (row["record_id"], row["row_id"]), zlib.compressobj(6, wbits=31), n + 1
                    out.write(squeeze.compress(record_head(row, date)))
                    number = 0
                if row["chunk_no"] != number or (row["bytes_so_far"] == row["payload_bytes"]) != (row["sha1_so_far"] == row["digest"]):
                    raise ValueError(f"chunk {number} of record {row['record_id']} is missing or damaged")
                number += 1
                if row["record_type"] == "response":
                    out.write(squeeze.compress(zlib.decompress(row["data"])))
            if squeeze:
                out.write(squeeze.compress(END) + squeeze.flush())
            size = out.tell()
        if n:
            store.move(own, final)
            yield pa.RecordBatch.from_pydict({"path": pa.array([final]), "n_records": pa.array([n]), "n_bytes": pa.array([size])})
        else:
            store.delete_file(own)

    return materialize(map_arrow(rows, write, "path string, n_records long, n_bytes long"), "manifest")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The batches' rows, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


@dataclass
class Head:
    record_id: str
    page_id: str | None
    url: str | None
    record_type: str
    refers_to: str | None
    digest: str
    payload_bytes: int


def read_records(source: Iterator[bytes], chunk: int = CHUNK) -> Iterator[tuple[Head, int, bytes, int, str, bool]]:
    """(head, chunk number, chunk, bytes so far, SHA-1 so far, last) of an archive's gzip members, as a stream."""
    buffer, inflate = b"", zlib.decompressobj(wbits=31)

    def plain() -> Iterator[bytes]:
        nonlocal inflate
        for data in source:
            while data:
                out = inflate.decompress(data, chunk)
                if out:
                    yield out
                data = inflate.unconsumed_tail
                if inflate.eof:
                    data, inflate = inflate.unused_data, zlib.decompressobj(wbits=31)

    stream = plain()

    def head_lines() -> list[bytes] | None:
        """The lines up to the first empty one; they are as long as their url."""
        nonlocal buffer
        found, seen = bytearray(buffer.lstrip(b"\r\n")), 0
        while (end := found.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(found)
            more = next(stream, None)
            if more is None:
                if found.strip():
                    raise ValueError("a record ends within its header")
                return None
            found += more if found else more.lstrip(b"\r\n")
        buffer = bytes(found[end + 4 :])
        return bytes(found[:end]).split(b"\r\n")

    def fields(lines: list[bytes]) -> dict[str, str]:
        return {k.strip().lower(): v.removeprefix(" ") for k, _, v in (line.decode().partition(":") for line in lines[1:])}

    while (lines := head_lines()) is not None:
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        warc = fields(lines)
        left = int(warc["content-length"])
        http_size, http = _http_head(buffer)
        while http_size < 0:
            more = next(stream, None)
            if more is None:
                raise ValueError("a record ends within its block")
            buffer += more
            http_size, http = _http_head(buffer)
        buffer, left = buffer[http_size:], left - http_size
        own, other = (v if v is None else unquote(v) for v in (warc.get("x-page-id"), warc.get("x-refers-to-page-id")))
        head = Head(warc["warc-record-id"][10:-1].replace("-", ""), own, warc.get("warc-target-uri"), warc["warc-type"], other, base64.b32decode(warc["warc-payload-digest"][5:]).hex(), int(fields(http)["content-length"]))
        sha, n, number = hashlib.sha1(), 0, 0
        while True:
            while len(buffer) < min(left, chunk):
                more = next(stream, None)
                if more is None:
                    raise ValueError("a record ends within its payload")
                buffer += more
            data, buffer = buffer[: min(left, chunk)], buffer[min(left, chunk) :]
            left -= len(data)
            n += len(data)
            sha.update(data)
            yield head, number, data, n, sha.hexdigest(), left == 0
            number += 1
            if not left:
                break


def _http_head(buffer: bytes) -> tuple[int, list[bytes]]:
    end = buffer.find(b"\r\n\r\n")
    return (-1, []) if end < 0 else (end + 4, buffer[:end].split(b"\r\n"))


def read_chunks(manifest: DataFrame, folder: str, kind: str = "bigint", with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The archives of a manifest as a table of chunk rows.

    ``payload_bytes`` and ``payload_digest`` are what the record's headers state; ``bytes_so_far`` and
    ``sha1_so_far`` are computed from what was read.  A response whose payload has another digest or length is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = ("record_id", "page_id", "url", "record_type", "refers_to", "chunk_no", "data", "bytes_so_far", "sha1_so_far", "payload_bytes", "payload_digest", "last")
        page_type = pa.int64() if kind == "bigint" else pa.string()

        def id_of(value: str | None) -> object:
            return value if value is None or pa.types.is_string(page_type) else int(value)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[list] = [[] for _ in names]
                held = 0
                with store.open_input_stream(path, compression=None) as f:
                    for head, number, data, n, sha, last in read_records(iter(lambda f=f: f.read(CHUNK), b""), chunk):
                        if last and head.record_type == "response" and (sha != head.digest or n != head.payload_bytes):
                            raise ValueError(f"record {head.record_id} in {path} is damaged")
                        values = (head.record_id, id_of(head.page_id), head.url, head.record_type, id_of(head.refers_to), number, data if with_data else None, n, sha, head.payload_bytes, head.digest, last)
                        for column, value in zip(rows, values, strict=True):
                            column.append(value)
                        held += len(data) if with_data else 200
                        if held > 8 << 20:
                            yield batch_of(rows, names, page_type)
                            rows, held = [[] for _ in names], 0
                yield batch_of(rows, names, page_type)

    n = manifest.count()
    files = manifest.select("path").repartition(max(1, n), "path") if n > 1 else manifest.select("path")
    return map_arrow(files, read, CHUNK_SCHEMA.format(kind=kind))


def archive_report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` as WARC archives in the shared folder and read them back.

    One row per page: the id column, ``payload_bytes``, ``payload_digest`` (lower-case hexadecimal SHA-1), both of
    the full payload, ``record_type`` and ``refers_to``.

    Null payloads are empty.  Rows without id are never referred to; repeated rows are records of their own, of the same
    type.  Further columns are ignored, so their names cannot clash.  An empty table gives an empty table.
    """
    folder = shared_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, id_col, url_col, payload_col)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = read_chunks(manifest, folder, id_kind(kind), with_data=False).where("last")
    return rows.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
