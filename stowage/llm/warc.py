"""WARC archives: a writer with revisit records, and a sequential reader.

The reader streams an archive: one gzip member per record, decompressed incrementally; a record's block is framed by its
Content-Length; the block and payload digests are verified. Nothing but one record is held at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, cut, modest, publish, rows, scratch, store

#: Bytes read at once, and the compressed size after which a task starts another archive.
CHUNK, ROLL = 1 << 16, 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, length: int, sha1: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member. payload None: a revisit of refers_to, whose block is the header of the full response."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + (payload or b"")
    named = lambda k: f"<{URN}{'' if k is None else k}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {named(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[^!-~]', lambda m: ''.join(f'%{c:02X}' for c in m[0].encode()), url or '')}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {named(refers_to)}"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + press.flush()


def members(f: BinaryIO) -> Iterator[Iterator[bytes]]:
    """For each gzip member, an iterator of its plain bytes; it must be used up before the next."""
    rest = b""

    def one() -> Iterator[bytes]:
        nonlocal rest
        press = zlib.decompressobj(31)
        while not press.eof:
            rest = press.unconsumed_tail or rest or f.read(CHUNK)
            if not rest:
                raise ValueError("the archive ends within a member")
            data = rest
            rest = b""
            if out := press.decompress(data, CHUNK):
                yield out
        rest = press.unused_data

    while rest or (rest := f.read(CHUNK)):
        yield one()


def headers(data: bytes) -> tuple[bytes, dict[str, str]]:
    first, *lines = data.split(b"\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}


def read_records(f: BinaryIO) -> Iterator[dict]:
    """The records of an open archive in order; ValueError where one is broken."""
    for member in members(f):
        held = bytearray()
        for part in member:
            held += part
            if (end := held.find(b"\r\n\r\n")) >= 0:
                break
        else:
            raise ValueError("a record without a header's end")
        version, head = headers(bytes(held[:end]))
        if not version.startswith(b"WARC/1."):
            raise ValueError(f"not a record: {version[:20]!r}")
        del held[: end + 4]
        length = int(head["content-length"])
        sha = hashlib.sha1()
        fed = 0
        while len(held) <= length + 4 and (part := next(member, None)) is not None:  # no more than the length says, and a chunk
            held += part
        if len(held) != length + 4 or held[length:] != b"\r\n\r\n":
            raise ValueError("Content-Length doesn't frame the block")
        del held[length:]
        sha.update(held)
        if (said := head.get("warc-block-digest")) and said != f"sha1:{base64.b32encode(sha.digest()).decode()}":
            raise ValueError("the block doesn't match its digest")
        fed = held.find(b"\r\n\r\n")
        _, http = headers(bytes(held[:fed])) if fed >= 0 else (b"", {})
        payload = bytes(held[fed + 4 :]) if fed >= 0 else bytes(held)
        kind, sha1 = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response" and sha1 and digest(payload) != sha1:
            raise ValueError("the payload doesn't match its digest")
        number = lambda x: int(m[1]) if (m := re.fullmatch(rf"<{URN}(-?\d+)>", x or "")) else None
        yield {"page_id": number(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": kind, "payload": payload if kind == "response" else None, "payload_bytes": len(payload) if kind == "response" else int(http.get("content-length", 0)), "payload_digest": sha1, "refers_to": number(head.get("warc-refers-to"))}


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", least: int = 0) -> DataFrame:
    """Write a record per row to archives in folder; return their manifest (path, records), cut from its lineage.

    The payload is body in UTF-8 (null: empty). Among rows with equal payloads of at least `least` bytes the one with the
    smallest key is a response and the others revisit it; rows that repeat its key are responses too, and so are all
    where no key is known. An empty table writes no archive. Only digests that occur twice are joined back, so a payload
    is shuffled only if there are too many of them to broadcast; a digest with a large share of the rows is split then.
    """
    modest(pages.sparkSession)
    text = F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8")
    own = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).cast("string").alias("url"), text.alias("body"), F.unhex(F.sha1(text)).alias("sha1"))
    firsts = cut(own.filter(F.octet_length("body") >= least).groupBy("sha1").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    refers = F.when((F.octet_length("body") >= least) & ~F.col("first").eqNullSafe(F.col("key")), F.col("first"))

    def written(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = store(folder)
        task = TaskContext.get()
        done, out, n = [], None, 0

        def close() -> None:
            out.close()
            name = f"{task.partitionId():06d}-{len(done):04d}.warc.gz"
            publish(where, f"{root}/.{task.taskAttemptId()}", f"{root}/{name}")
            done.append((f"{folder}/{name}", n))

        for b in found:
            for k, u, payload, sha1, refers_to in rows(b):
                if out is None:
                    out, n = where.open_output_stream(f"{root}/.{task.taskAttemptId()}"), 0
                out.write(record(k, u, payload if refers_to is None else None, len(payload), base64.b32encode(sha1).decode(), refers_to))
                n += 1
                if out.tell() >= ROLL:
                    close()
                    out = None
        if out:
            close()
        yield from batches(done, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    joined = own.join(firsts, "sha1", "left").select("key", "url", "body", "sha1", refers.alias("refers_to"))
    return cut(joined.mapInArrow(written, "path string, records bigint"))


def read_archives(manifest: DataFrame, key: str = "page_id", payloads: bool = True) -> DataFrame:
    """key, url, record_type, payload (null in revisits), payload_bytes, payload_digest and refers_to of every record.

    Lengths and digests are those of the full payload. Keys come from record ids of this module's form, else null.
    """
    fields = [("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for b in found:
                for (path,) in rows(b):
                    where, name = store(path)
                    with where.open_input_stream(name, compression=None) as f:
                        for r in read_records(f):
                            yield r["page_id"], r["url"], r["record_type"], r["payload"] if payloads else None, r["payload_bytes"], r["payload_digest"], r["refers_to"]

        yield from batches(made(), pa.schema(fields))

    return manifest.select("path").mapInArrow(read, "key bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint").withColumnRenamed("key", key)


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write pages to a folder of the shared store and read the archives back, payloads left out."""
    return read_archives(write_archives(pages, scratch(spark, "warc"), **options), payloads=False)
