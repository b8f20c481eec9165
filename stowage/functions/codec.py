"""The block codec: framed blocks that are plain, deflated or encrypted."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import salsa20

#: The magic, the flag of the block table, and the most bytes that a value may decode to.
MAGIC, TABLE, MOST = b"BLTE", 0x0F, 512 << 20


class CodecError(ValueError):
    """code: bad_frame, bad_block, hash_mismatch, missing_key, unsupported or too_large."""

    def __init__(self, code: str, what: str):
        super().__init__(what)
        self.code = code


def block_table(data: bytes) -> tuple[int, list[tuple[int, int | None, bytes]]]:
    """(where blocks start, [(stored size, plain size or None, MD5 or zeros)])."""
    if len(data) < 8 or data[:4] != MAGIC:
        raise CodecError("bad_frame", "no frame")
    (header,) = struct.unpack_from(">I", data, 4)
    if not header:
        return 8, [(len(data) - 8, None, bytes(16))]
    if len(data) < 12 or data[8] != TABLE:
        raise CodecError("bad_frame", "no block table")
    count = int.from_bytes(data[9:12], "big")
    if not count or header != 12 + 24 * count or header > len(data):
        raise CodecError("bad_frame", f"a table of {count} blocks in {header} bytes")
    return header, [(a, b, h) for a, b, h in struct.iter_unpack(">II16s", data[12:header])]


def inflate(data: bytes, most: int) -> bytes:
    press = zlib.decompressobj()
    try:
        out = press.decompress(data, most + 1)
    except zlib.error as e:
        raise CodecError("bad_block", str(e)) from None
    if len(out) > most:
        raise CodecError("too_large", f"more than {most} bytes")
    if not press.eof:
        raise CodecError("bad_block", "a deflated block is cut off")
    return out


def decrypt(data: bytes, number: int, keys: Mapping[int, bytes]) -> bytes:
    """The plain bytes of an encrypted block; the block's number goes into the nonce, key names are little-endian."""
    if len(data) < 9 or data[0] != 8:
        raise CodecError("bad_block", "no key name")
    (name,) = struct.unpack_from("<Q", data, 1)
    width = data[9] if len(data) > 9 else 0
    if width not in (4, 8) or len(data) < 11 + width:
        raise CodecError("bad_block", "no nonce")
    nonce = bytearray(data[10 : 10 + width].ljust(8, b"\0"))
    for k in range(4):
        nonce[k] ^= number >> 8 * k & 0xFF
    if data[10 + width : 11 + width] != b"S":
        raise CodecError("unsupported", f"cipher {data[10 + width : 11 + width]!r}")
    if name not in keys:
        raise CodecError("missing_key", f"{name:016X}")
    return salsa20(keys[name], bytes(nonce), data[11 + width :])


def block(data: bytes, number: int, keys: Mapping[int, bytes], most: int = MOST) -> bytes:
    kind = data[:1]
    if kind == b"N":
        return data[1:]
    if kind == b"Z":
        return inflate(data[1:], most)
    if kind == b"E":
        return block(decrypt(data[1:], number, keys), number, keys, most)
    raise CodecError("unsupported" if kind == b"F" else "bad_block", f"block type {kind!r}")


def decode(data: bytes, ekey: bytes | None = None, keys: Mapping[int, bytes] | None = None, most: int = MOST) -> bytes:
    """The content of a frame; with ekey, header and blocks are held against their hashes. The cap holds for what comes
    out, not only for what the table says."""
    at, blocks = block_table(data)
    if sum(b[1] or 0 for b in blocks) > most:
        raise CodecError("too_large", f"more than {most} bytes")
    if ekey is not None and hashlib.md5(data[:at] if at > 8 else data).digest()[:9] != ekey[:9]:
        raise CodecError("hash_mismatch", "the header")
    out, made = [], 0
    for k, (size, _, md5) in enumerate(blocks):
        part = data[at : at + size]
        if len(part) < size:
            raise CodecError("bad_block", f"block {k} is cut off")
        if ekey is not None and any(md5) and hashlib.md5(part).digest() != md5:
            raise CodecError("hash_mismatch", f"block {k}")
        out.append(block(part, k, keys or {}, most - made))
        made += len(out[-1])
        if made > most:
            raise CodecError("too_large", f"more than {most} bytes")
        at += size
    return b"".join(out)


def encode(parts: list[bytes], modes: str = "Z", keys: Mapping[int, bytes] | None = None) -> bytes:
    """A frame of parts, each in its mode (N, Z or E; the last mode holds for the rest); E takes the first key."""
    stored = []
    for k, part in enumerate(parts):
        mode = modes[min(k, len(modes) - 1)]
        body = b"N" + part if mode != "Z" else b"Z" + zlib.compress(part)
        if mode == "E":
            name, key = next(iter((keys or {}).items()))
            nonce = bytes(x ^ y for x, y in zip(b"\1\2\3\4", struct.pack("<I", k), strict=True)) + bytes(4)
            body = b"E\x08" + struct.pack("<Q", name) + b"\x04\1\2\3\4S" + salsa20(key, nonce, body)
        stored.append(body)
    table = b"".join(struct.pack(">II", len(s), len(p)) + hashlib.md5(s).digest() for s, p in zip(stored, parts, strict=True))
    return MAGIC + struct.pack(">I", 12 + len(table)) + bytes([TABLE]) + len(parts).to_bytes(3, "big") + table + b"".join(stored)


def sniff_decode(data: bytes, ekey: bytes | None = None, keys: Mapping[int, bytes] | None = None) -> bytes:
    """A static container's value: a frame, a zlib stream, or an error."""
    if data[:2] == b"BL":
        return decode(data, ekey, keys)
    if data[:1] == b"\x78":
        return inflate(data, MOST)
    raise CodecError("bad_frame", "neither a frame nor deflated")


def decoded(blobs: DataFrame, column: str = "blob", ekey: str | None = None, keys: DataFrame | None = None, sniff: bool = False, most: int = MOST) -> DataFrame:
    """blobs with data and error (a code) in column's place; a bad value is a row with an error and never ends the job.

    keys(key_name, key) is a user's key file: it is collected, and refused beyond 100,000 rows.
    """
    known: dict[int, bytes] = {}
    if keys is not None:
        found = keys.select("key_name", "key").limit(100_001).collect()
        if len(found) > 100_000:
            raise ValueError("too many keys to broadcast")
        known = {r[0] & (2**64 - 1): bytes(r[1]) for r in found}
    rest = [c for c in blobs.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                ek = part.column(len(rest) + 1).to_pylist()
                data, errors = [], []
                for k, blob in enumerate(part.column(len(rest)).to_pylist()):
                    try:
                        if blob is None:
                            raise CodecError("bad_frame", "no value")
                        data.append(sniff_decode(blob, ek[k], known) if sniff else decode(blob, ek[k], known, most))
                        errors.append(None)
                    except CodecError as e:
                        data.append(None)
                        errors.append(e.code)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(rest))), pa.array(data, pa.binary()), pa.array(errors, pa.string())], [*rest, "data", "error"])

    own = blobs.select(*rest, column, (F.col(ekey) if ekey else F.lit(None).cast("binary")).alias("_ekey"))
    kinds = ", ".join(f"`{c}` {blobs.schema[c].dataType.simpleString()}" for c in rest)
    return own.mapInArrow(run, f"{kinds}{', ' if kinds else ''}data binary, error string")


def decode_distinct(rows: DataFrame, blobs: DataFrame, key: str = "ekey", **options) -> DataFrame:
    """rows with data and error of their key's blob: each distinct blob is decoded once, then joined back."""
    wanted = blobs.join(rows.select(key).distinct(), key, "left_semi").dropDuplicates([key])
    return rows.join(decoded(wanted, **options), key, "left")
