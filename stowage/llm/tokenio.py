"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds one frame per document (its ids as little-endian unsigned 32-bit integers), in ascending key order, and then
a skippable frame with the seek table: for each document its key, whether the key is null, the compressed and the plain
size and the XXH64 of the plain bytes; the file ends in the number of entries, the table's size and a magic number. Any
zstandard tool can decompress the whole file; a reader of single documents seeks to their frames only.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import batches, cut, modest, publish, rows, scratch, store, trim
from .tok import encoder

ENTRY, TAIL, SKIP, MAGIC = struct.Struct("<q?QQQ"), struct.Struct("<QQ8s"), struct.Struct("<II"), b"STOWIDS1"
#: The magic number of a skippable frame.
SKIPPABLE = 0x184D2A5E
#: Documents per file, and most files; larger inputs get larger files.
FILE_DOCS, MOST_FILES = 4096, 1 << 16


def entry(key: int | None, packed: int, plain: int, digest: int) -> bytes:
    return ENTRY.pack(key or 0, key is None, packed, plain, digest & (2**64 - 1))


def seal(entries: list[bytes]) -> bytes:
    """The seek table as a skippable frame."""
    table = b"".join(entries)
    return SKIP.pack(SKIPPABLE, len(table) + TAIL.size) + table + TAIL.pack(len(entries), len(table), MAGIC)


class Numbers:
    """The file of each row: ends are the keys that end equal shares of the rows, nulls how many files null keys need. A key
    that ends several shares has that many files of its own, behind that of the smaller keys of its first share."""

    def __init__(self, ends: list[int], nulls: int):
        self.bounds, times = np.unique(np.asarray(ends, np.int64), return_counts=True)
        self.nulls, self.own = nulls, np.where(times > 1, times, 0)
        self.base = nulls + np.arange(len(times) + 1) + np.concatenate([[0], np.cumsum(self.own)]).astype(np.int64)
        self.files = int(self.base[-1]) + 1

    def of(self, key: int | None, digest: int) -> int:
        """Files of one key take equal ranges of the signed 64-bit digests."""
        u = digest + (1 << 63)
        if key is None:
            return u * self.nulls >> 64
        at = int(np.searchsorted(self.bounds, key, "left"))
        if at < len(self.bounds) and self.own[at] and self.bounds[at] == key:
            return int(self.base[at]) + 1 + (u * int(self.own[at]) >> 64)
        return int(self.base[at])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, key: str = "doc_id", text: str = "text", file_docs: int = FILE_DOCS) -> DataFrame:
    """Write the ids of every whole text, end_id after each, to files in folder; return their manifest.

    Files follow each other in ascending key order; null keys come first, equal keys (repeated rows) in the order of
    their ids' hashes. A key that holds more than a file's share of the rows, null included, is dealt into as many files
    as it needs by that hash, so that only rows alike in key and text always share a file. A null or empty text is end_id
    alone. Documents are encoded and compressed before the one shuffle, so
    only frames move; a file is streamed and never held whole. The manifest (file, path, n_docs, n_ids) has a row per
    file, none for an empty table, and is cut from its lineage. Other columns are dropped; keys that aren't integers are
    refused (TypeError), as the format has 64-bit keys.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"the file format's keys are 64-bit integers; {key} is {docs.schema[key].dataType.simpleString()}")
    modest(docs.sparkSession)
    spark = docs.sparkSession
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col(key).isNull())).first()
    files = max(1, min(MOST_FILES, -(-n // file_docs)))
    ends = docs.agg(F.percentile_approx(F.col(key).cast("bigint"), [k / files for k in range(1, files)], 10 * files)).first()[0] if files > 1 else []
    numbers = Numbers(ends or [], -(-nulls * files // max(n, 1)))
    end = np.asarray([end_id], "<u4").tobytes()

    def framed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        own, press = encoder(tokenizer, False), zstandard.ZstdCompressor(level=1, write_checksum=True)
        schema = pa.schema([("file", pa.int32()), ("key", pa.int64()), ("size", pa.int64()), ("digest", pa.int64()), ("frame", pa.binary())])

        def made() -> Iterator[tuple]:
            for b in found:
                for k, t in rows(b):
                    ids = own.encode(t) + end
                    digest = int.from_bytes(xxhash.xxh64(ids).digest(), "big", signed=True)
                    yield numbers.of(k, digest), k, len(ids), digest, press.compress(ids)

        yield from batches(made(), schema)
        trim()

    def written(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = store(folder)
        attempt = TaskContext.get().taskAttemptId()
        done, out, at = [], None, None

        def close() -> None:
            out.write(seal(entries))
            out.close()
            publish(where, temporary, f"{root}/{at:08d}.ids")
            done.append((at, f"{folder}/{at:08d}.ids", len(entries), ids))

        for b in found:
            for file, k, size, digest, frame in rows(b):
                if file != at:
                    if out:
                        close()
                    at, entries, ids = file, [], 0
                    temporary = f"{root}/.{at:08d}.{attempt}"
                    out = where.open_output_stream(temporary)
                out.write(frame)
                entries.append(entry(k, len(frame), size, digest))
                ids += size // 4
        if out:
            close()
        yield from batches(done, pa.schema([("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
        trim()

    return cut(
        docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
        .mapInArrow(framed, "file int, key bigint, size bigint, digest bigint, frame binary")
        .repartitionById(numbers.files, "file")
        .sortWithinPartitions("file", F.col("key").asc_nulls_first(), "digest")
        .mapInArrow(written, "file int, path string, n_docs bigint, n_ids bigint")
    )


def seek_table(f: pa.NativeFile) -> list[tuple[int | None, int, int, int, int]]:
    """(key, offset, compressed size, plain size, digest) of each document of an open file."""
    size = f.size()
    f.seek(size - TAIL.size)
    n, length, magic = TAIL.unpack(f.read(TAIL.size))
    if magic != MAGIC or length != n * ENTRY.size:
        raise ValueError("not a token-id file, or a truncated one")
    f.seek(size - TAIL.size - length)
    out, at = [], 0
    for key, null, packed, plain, digest in ENTRY.iter_unpack(f.read(length)):
        out.append((None if null else key, at, packed, plain, digest))
        at += packed
    return out


def read_token_files(manifest: DataFrame, key: str = "doc_id", wanted: Iterable[int] | None = None) -> DataFrame:
    """key, start (ids before the document in all files), n_tokens and ids of every document, or of the wanted keys.

    Only the frames of wanted documents are read and decompressed. A frame that doesn't match its checksum raises.
    """
    keys = None if wanted is None else frozenset(wanted)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # over at most MOST_FILES rows

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        plainly = zstandard.ZstdDecompressor()

        def made() -> Iterator[tuple]:
            for b in found:
                for path, base in rows(b):
                    where, name = store(path)
                    with where.open_input_file(name) as f:
                        start = base
                        for k, at, packed, plain, digest in seek_table(f):
                            if keys is None or k in keys:
                                f.seek(at)
                                ids = plainly.decompress(f.read(packed), max_output_size=plain)
                                if len(ids) != plain or xxhash.xxh64_intdigest(ids) != digest:
                                    raise ValueError(f"{path}: the frame at {at} doesn't match its checksum")
                                yield k, start, plain // 4, ids
                            start += plain // 4

        yield from batches(made(), pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]))
        trim()

    based = manifest.select("path", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    spread = cut(based).repartition(max(1, min(manifest.sparkSession.sparkContext.defaultParallelism * 4, MOST_FILES)), "file")
    return spread.select("path", "base").mapInArrow(read, "key bigint, start bigint, n_tokens bigint, ids binary").withColumnRenamed("key", key)


def round_trip(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Write docs to a folder of the shared store and read it back."""
    return read_token_files(write_token_files(docs, scratch(spark, "ids"), **options))
