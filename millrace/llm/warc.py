"""WARC archives written from and read into a table of record chunks."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import files
from millrace.llm.common import MOST_KEYS, fresh_dir, joined, map_arrow, stored

#: Bytes of a payload in one row of the record table, and in one step of reading.
CHUNK = 1 << 16
LEVEL = 3
#: An archive that has grown beyond this is closed and a new one begun.
ARCHIVE = 1 << 30
#: Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """Of pages (page_id, key, size) those that revisit another: page_id, key, response, a row for each. Payloads stay where they are.

    Common payloads are hot keys: they are counted on the map side, and their pages meet the count without a shuffle.
    """
    large = stored(pages.where(F.col("size") >= least).select("page_id", "key"), "large")
    groups = large.groupBy("key").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response is not null")
    met = joined(large, stored(groups, "payloads"), ["key"], "n", large.count())
    return met.where("page_id is null or page_id <> response").select("page_id", "key", "response").distinct()


def record_table(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Pages as rows of (page_id, url, payload_bytes, payload_digest, record_type, refers_to, chunks, chunk_no, chunk).

    The payload is the html in UTF-8 (null: empty) and is cut into chunks, so no later step holds a whole one. Of
    payloads with at least `least` bytes that are equal (by SHA-256) the record with the largest page_id is the response
    and others revisit it, without a payload of their own; they have one empty chunk, as have empty payloads. Which ones revisit is found by ids and hashes alone. That list is broadcast if it
    has at most MOST_KEYS rows, so that payloads aren't moved; beyond that pages are shuffled once, by page_id and hash, so that copies of a payload don't meet in one task.

    Repeated rows of the largest page_id are responses each, null page_ids revisit but are never referred to; null urls are written as a fixed one. Digests are SHA-1, in
    hexadecimal. Other columns aren't looked at, whatever their names. An empty table gives no rows.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", body.alias("body"))
    size, key = F.octet_length("body").cast("long"), F.sha2("body", 256)
    again = stored(revisits(pages.select("page_id", key.alias("key"), size.alias("size")), least), "revisits")
    few = F.broadcast(again) if again.count() <= MOST_KEYS else again
    keyed = pages.withColumn("key", F.when(size >= least, key))
    rows = keyed.join(few, keyed.page_id.eqNullSafe(few.page_id) & (keyed.key == few.key), "left").select(keyed.page_id, "url", "body", "response")
    revisit = F.col("response").isNotNull()
    held = F.when(revisit, F.lit(b"")).otherwise(F.col("body"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(held) / CHUNK)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(held, i * CHUNK + 1, F.lit(CHUNK)))
    rows = rows.select(
        "page_id",
        "url",
        size.alias("payload_bytes"),
        F.sha1("body").alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("response").alias("refers_to"),
        count.alias("chunks"),
        cut.alias("cut"),
    )
    return rows.select(*[c for c in rows.columns if c != "cut"], F.posexplode("cut").alias("chunk_no", "chunk"))


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{page_id if page_id is not None else uuid.uuid4().hex}>"


def page_of(name: str | None) -> int | None:
    last = (name or "").strip("<>").rpartition(":")[2]
    return int(last) if last.lstrip("-").isdigit() and len(last) < 21 else None


def head_of(row: dict) -> bytes:
    """A record's header and the HTTP header that begins its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    here = row["payload_bytes"] if row["record_type"] == "response" else 0
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", record_name(row["page_id"])),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(row["url"] or "urn:none", safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(http) + here),
    ]
    if row["refers_to"] is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(row["refers_to"]))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def write_archives(records: DataFrame, out_dir: str | None = None, most: int = ARCHIVE) -> DataFrame:
    """Write a record table into gzipped archives, a member for each record: the manifest (path, records).

    A record's chunks are consecutive rows, as record_table() gives them; where one is missing or out of place a ValueError names its page. They are compressed as they come and carry a running SHA-1,
    which has to agree with the header in the end. Archives get names of their own and only those of tasks that succeeded are in the manifest. Null page_ids get
    names of their own, repeated rows are records each, and no records give no archives.
    """
    out_dir = out_dir or fresh_dir(records.sparkSession, "warc")
    files.make_dir(out_dir)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunks", "chunk_no", "chunk"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, at, press, digest, page, due = None, "", 0, 0, None, None, None, 0
        for batch in batches:
            heads = batch.select(names[:-1]).to_pylist()
            for row, chunk in zip(heads, batch.column(8), strict=True):
                chunk = chunk.as_py()
                if row["chunk_no"] != due or (due and row["page_id"] != page):
                    raise ValueError(f"page {row['page_id']}: chunk {row['chunk_no']} comes where chunk {due} of page {page if due else 'any'} should")
                page, due = row["page_id"], (due + 1) % row["chunks"]
                if out is None:
                    path, n, at = f"{out_dir}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.write_to(path)
                if row["chunk_no"] == 0:
                    press, digest = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), hashlib.sha1()
                    at += out.write(press.compress(head_of(row))) or 0
                digest.update(chunk)
                raw = press.compress(chunk)
                if row["chunk_no"] + 1 == row["chunks"]:
                    if row["record_type"] == "response" and digest.hexdigest() != row["payload_digest"]:
                        raise ValueError(f"page {row['page_id']}: its chunks don't give its digest")
                    raw += press.compress(END) + press.flush()
                    n += 1
                out.write(raw)
                at += len(raw)
                if at >= most and row["chunk_no"] + 1 == row["chunks"]:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})
        if due:
            raise ValueError(f"page {page}: it ends before chunk {due}")
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return stored(map_arrow(records.select(*names), write, "path string, records long"), "archives")


def records_of(stream) -> Iterator[tuple[dict[str, str], int, Iterator[bytes]]]:
    """Of an uncompressed WARC stream each record's fields, length its HTTP header states, and payload in pieces (to be used up)."""
    while line := stream.readline():
        if line.strip() != VERSION:
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while line := stream.readline().rstrip(b"\r\n"):
            k, _, v = line.decode().partition(": ")
            fields[k] = v
        left, stated = int(fields["Content-Length"]), 0
        while line := stream.readline():
            left -= len(line)
            if line.lower().startswith(b"content-length:"):
                stated = int(line.partition(b":")[2])
            if line == b"\r\n":
                break

        def payload(left: int = left) -> Iterator[bytes]:
            while left:
                piece = stream.read(min(CHUNK, left))
                if not piece:
                    raise EOFError("a record is cut short")
                left -= len(piece)
                yield piece

        yield fields, stated, payload()
        if stream.read(len(END)) != END:
            raise ValueError("a record isn't where its length says")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The archives of a manifest as a record table, without urls; each row has the SHA-1 of the record's payload as far as it goes.

    The last row of a record has last = true and the full payload's digest: of a response the one that its bytes gave,
    which has to agree with its header, of a revisit the header's. `payload_bytes` is likewise counted or stated. Records of null page_ids have none again; an empty
    manifest gives no rows.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, chunk_no int, last boolean" + ", chunk binary" * with_payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()] + [pa.binary()] * with_payload
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(path: str) -> Iterator[tuple]:
        with files.read_from(path) as raw, gzip.GzipFile(fileobj=raw) as stream:
            for fields, stated, payload in records_of(stream):
                kind, page, to = fields["WARC-Type"], page_of(fields["WARC-Record-ID"]), page_of(fields.get("WARC-Refers-To"))
                header = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                digest, n, held = hashlib.sha1(), 0, None
                k = 0
                for piece in payload:
                    if held is not None:
                        yield (page, n, digest.hexdigest(), kind, to, k, False, *[held] * with_payload)
                        k += 1
                    digest.update(piece)
                    n, held = n + len(piece), piece
                if kind == "response" and (digest.hexdigest() != header or n != stated):
                    raise ValueError(f"page {page}: payload and header disagree")
                yield (page, stated, header, kind, to, k, True, *[held or b""] * with_payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    part.append(row)
                    if len(part) >= (64 if with_payload else 4096):
                        yield flush()
                        part.clear()
        if part:
            yield flush()

    return map_arrow(manifest.select("path").repartition(max(1, min(manifest.count(), 20_000))), read, schema)
