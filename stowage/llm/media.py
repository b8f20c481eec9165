"""Media columns in the Ogg container.

Writer: 8-bit mono samples, cut into packets that go round-robin to the container's logical streams; packets are laced
into pages of at most 255 lacing values, every page with its CRC-32 and the granule position (samples of its stream so
far). Reader: pages are checked against their CRC, packets reassembled from the lacing values and continued pages,
streams told apart by serial number, and each packet's time derived from its page's granule position; packets of all
streams are put in order by time. An unreadable value gives an error, not an exception.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, modest, rows

#: Samples per unit, units per packet, samples a second, logical streams.
UNIT, PACKET_UNITS, RATE, STREAMS = 192, 5, 8000, 2
PAGE, HEAD = struct.Struct("<4sBBqIII"), struct.Struct("<8sBBIII")
#: Fixed values of the container: the flags of a page, and what an identification packet starts with here.
CONTINUED, FIRST, LAST, IDENT = 1, 2, 4, b"\x7fPCM8\0\0\0"
_REVERSED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def page_crc(page: bytes) -> int:
    """The container's CRC-32 (polynomial 0x04c11db7, not reflected, from 0), by way of zlib's reflected one."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "big").translate(_REVERSED), "little")


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """data and bytes 32 up to a positive multiple of unit."""
    return data + b" " * (max(unit, -(-len(data) // unit) * unit) - len(data))


def pages(packets: list[bytes], serial: int, granules: list[int]) -> list[tuple[int, bytes]]:
    """(granule position before which it is due, page) of one logical stream's packets; the first has a page of its own."""
    out, table, body, flags, done, due = [], bytearray(), [], FIRST, -1, 0

    def flush(last: bool) -> None:
        nonlocal table, body, flags, done
        head = PAGE.pack(b"OggS", 0, flags | LAST * last, done, serial, len(out), 0) + bytes([len(table)]) + bytes(table)
        page = head + b"".join(body)
        out.append((due, page[:22] + page_crc(page).to_bytes(4, "little") + page[26:]))
        table, body, flags, done = bytearray(), [], 0, -1

    for k, packet in enumerate(packets):
        lacing = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while lacing:
            if len(table) == 255:
                flush(False)
                flags = CONTINUED * (at > 0)
                due = granules[k - 1] if k else 0
            part, lacing = lacing[: 255 - len(table)], lacing[255 - len(table) :]
            table += part
            body.append(packet[at : at + sum(part)])
            at += sum(part)
        done = granules[k]
        if k == 0 or k == len(packets) - 1:
            flush(k == len(packets) - 1)
            due = granules[k]
    return out


def encode(payload: bytes, streams: int = STREAMS, rate: int = RATE, packet: int = UNIT * PACKET_UNITS) -> bytes:
    """The container of a payload of 8-bit samples; equal payloads give equal bytes."""
    seed, parts = zlib.crc32(payload), []
    for s in range(streams):
        own = [payload[a : a + packet] for a in range(s * packet, len(payload), streams * packet)]
        ends = np.cumsum([0, *map(len, own)]).tolist()
        head = HEAD.pack(IDENT, s, streams, rate, packet, len(payload) & 0xFFFFFFFF)
        parts += [(k > 0, due, s, page) for k, (due, page) in enumerate(pages([head, *own], seed ^ (s * 0x9E3779B1 & 0xFFFFFFFF), ends))]
    return b"".join(x[3] for x in sorted(parts, key=lambda x: x[:3]))


def parse(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(serial, flags, granule position, sequence, lacing values, body) of each page; ValueError where one is broken."""
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or at + 27 > len(media):
            raise ValueError(f"no page at {at}")
        _, version, flags, granule, serial, sequence, crc = PAGE.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + media[at + 26]]
        end = at + 27 + media[at + 26] + sum(lacing)
        if version or len(lacing) < media[at + 26] or end > len(media):
            raise ValueError(f"truncated page at {at}")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at {at}")
        yield serial, flags, granule, sequence, lacing, media[at + 27 + len(lacing) : end]
        at = end


def decode(media: bytes) -> tuple[bytes, dict]:
    """The payload, and facts of the container: pages, streams, packets, rate, seconds."""
    found: dict[int, dict] = {}
    n = 0
    for serial, flags, granule, sequence, lacing, body in parse(media):
        n += 1
        if flags & FIRST and serial not in found:
            found[serial] = {"packets": [], "ends": [], "held": b"", "next": 0, "over": False}
        if serial not in found or found[serial]["next"] != sequence or bool(flags & CONTINUED) != bool(found[serial]["held"]):
            raise ValueError(f"page {sequence} of stream {serial} is out of place")
        s = found[serial]
        s["next"], s["over"] = sequence + 1, bool(flags & LAST)
        at, first, run = 0, len(s["packets"]), 0
        for v in lacing:
            run += v
            if v < 255:
                s["packets"].append(s["held"] + body[at : at + run])
                s["held"], at, run = b"", at + run, 0
        s["held"] += body[at:]
        end = granule  # of the last packet that ends here; the others' ends follow backwards
        ends = []
        for p in reversed(s["packets"][max(first, 1) :]):
            ends.append(end)
            end -= len(p)
        s["ends"] += ends[::-1]
    out = []
    for s in found.values():
        magic, number, streams, rate, packet, total = HEAD.unpack(s["packets"][0])
        if magic != IDENT or not s["over"] or s["held"] or streams != len(found):
            raise ValueError("a stream is cut off")
        # a stream's own clock stands still while others have their turn
        out += [((end - len(p)) // packet * streams + number, p) for p, end in zip(s["packets"][1:], s["ends"], strict=True)]
    out.sort(key=lambda x: x[0])
    payload = b"".join(p for _, p in out)
    if not found or len(payload) & 0xFFFFFFFF != total:
        raise ValueError("samples are missing")
    return payload, {"pages": n, "streams": len(found), "packets": len(out), "rate": rate, "seconds": len(payload) / rate}


def features(payload: bytes, facts: dict) -> str:
    """Facts of the container and of its samples, as one line."""
    x = np.frombuffer(payload, np.uint8)
    total, squares, crossings, before = 0, 0, 0, 0
    for at in range(0, len(x), 1 << 20):
        part = x[at : at + (1 << 20)].astype(np.int32) - 128
        total += int(part.sum())
        squares += int((part * part).sum(dtype=np.int64))
        up = part >= 0
        crossings += int(np.count_nonzero(up[1:] != up[:-1])) + (at > 0 and bool(up[0]) != before)
        before = bool(up[-1])
    n = max(1, len(x))
    return f"ogg pages={facts['pages']} streams={facts['streams']} packets={facts['packets']} seconds={facts['seconds']:.3f} mean={total / n:.4f} rms={(squares / n) ** 0.5:.4f} crossings={crossings}"


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8 bytes of the whole text, null: 0) and media (its padded payload in the container).

    Null, empty and repeated rows each give a row; an empty table gives none; other columns are dropped.
    """

    def stored(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.int64()

        def made(b: pa.RecordBatch) -> Iterator[tuple]:
            for k, t in rows(b):
                data = (t or "").encode()
                yield k, len(data), encode(pad(data))

        for b in found:
            kind = b.schema.field(0).type
            yield from batches(made(b), pa.schema([("key", kind), ("n_bytes", pa.int64()), ("media", pa.binary())]))

    modest(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(stored, f"key {kind}, n_bytes bigint, media binary").withColumnRenamed("key", key)


def read_media(stored: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ("n_bytes",), media: str = "media") -> DataFrame:
    """key, keep, media, payload, feature and error of every row; payload and feature are null where error isn't."""

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            schema = pa.schema([*b.schema, ("payload", pa.binary()), ("feature", pa.string()), ("error", pa.string())])

            def made(b: pa.RecordBatch = b) -> Iterator[tuple]:
                for row in rows(b, 64):
                    try:
                        payload, facts = decode(row[-1] or b"")
                        yield *row, payload, features(payload, facts), None
                    except (ValueError, struct.error, IndexError, KeyError) as e:
                        yield *row, None, None, str(e)

            yield from batches(made(), schema)

    df = stored.select(key, *keep, F.col(media).alias("media"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(read, f"{kinds}, payload binary, feature string, error string")
