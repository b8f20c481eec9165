"""Reading blocks out of data files, local and static."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import be_uint, bits

#: Fixed value: the header before a block in a data file.
BLOCK_HEADER = 30


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def read_blocks(located: DataFrame, folders: list[str], header: int = BLOCK_HEADER) -> DataFrame:
    """located(ekey9, storage, archive, offset, size, ...) with blob and error: the bytes behind each block's header.

    Rows are brought together by data file and sorted by offset, so a task opens each of its files once and reads forward;
    a file that is hot is spread over several tasks by offset. A block that can't be read is a row with an error.
    """
    columns = located.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in located.schema)
    at = {c: columns.index(c) for c in ("storage", "archive", "offset", "size")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for b in batches:
            for start in range(0, b.num_rows, 64):
                part = b.slice(start, 64)
                data, errors = [], []
                for storage, archive, offset, size in zip(*(part.column(at[c]).to_pylist() for c in ("storage", "archive", "offset", "size")), strict=True):
                    blob, error = None, None
                    try:
                        if storage is None or not 0 <= storage < len(folders):
                            raise ValueError("unknown_storage")
                        if size < header:
                            raise ValueError("short_block")
                        wanted = f"{folders[storage]}/data.{archive:03d}"
                        if wanted != name:
                            where, path = _open(wanted)
                            name, file = wanted, where.open_input_file(path)
                        if file is None:
                            raise OSError
                        file.seek(offset + header)
                        blob = file.read(size - header)
                        if len(blob) < size - header:
                            blob, error = None, "short_block"
                    except ValueError as e:
                        error = str(e)
                    except OSError:
                        name, file, error = wanted, None, "missing_file"
                    data.append(blob)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(columns))), pa.array(data, pa.binary()), pa.array(errors, pa.string())], [*columns, "blob", "error"])

    spread = F.floor(F.col("offset") / F.lit(256 << 20))
    return located.repartition("storage", "archive", spread).sortWithinPartitions("storage", "archive", "offset").mapInArrow(run, f"{kinds}, blob binary, error string")


def check_layouts(layouts: list[tuple[int, int, int, int, int]], index_bits: int) -> None:
    """(layout, chunk, archive, offset bits, flags) must fit: indices in range, fields within the 56 bits below the top
    byte."""
    if not 0 <= index_bits <= 8:
        raise ValueError(f"index bits {index_bits}")
    for layout, chunk, archive, offset, _ in layouts:
        if layout >= 1 << index_bits:
            raise ValueError(f"layout {layout} beyond {index_bits} bits")
        if min(chunk, archive, offset) < 0 or index_bits + chunk + archive + offset > 56:
            raise ValueError(f"layout {layout} takes more than 56 bits")


def static_location(ekey: Column, layouts: list[tuple[int, int, int, int, int]], index_bits: int) -> Column:
    """STRUCT<layout, chunk, archive, byte_offset> from the key's last eight bytes; null without a layout for it.

    Fields follow each other downwards from bit 56: layout, chunk, archive, offset; a layout's flags other than 0 scale
    the offset. Everything is a shift and a mask.
    """
    check_layouts(layouts, index_bits)
    value = be_uint(ekey, 9, 8)
    layout = bits(value, 56 - index_bits, index_bits)
    out = None
    for number, chunk, archive, offset, flags in layouts:
        a = 56 - index_bits - chunk
        b = a - archive
        c = b - offset
        own = F.struct(
            F.lit(number).alias("layout"),
            bits(value, a, chunk).alias("chunk"),
            bits(value, b, archive).alias("archive"),
            (bits(value, c, offset) * (flags or 1)).alias("byte_offset"),
            F.lit(offset == 0).alias("loose"),
            F.lit(flags).alias("flags"),
        )
        out = F.when(layout == number, own) if out is None else out.when(layout == number, own)
    return out if out is not None else F.lit(None)


def candidate_files(location: Column) -> Column:
    """The files a static location may be in, in the order to try."""
    folder = F.format_string("%03d/", location["chunk"])
    plain, padded = F.lower(F.hex(location["archive"])), F.lpad(F.lower(F.hex(location["archive"])), 4, "0")
    padded = F.when(F.length(plain) > 4, plain).otherwise(padded)
    loose = F.array(*[F.concat(folder, F.lit(p), n, F.lit(f"-{k}.dat")) for p, n in (("", plain), ("0x", padded)) for k in ("child", "payload")])
    return F.when(location["loose"], loose).otherwise(F.array(F.concat(folder, F.lit("0x"), padded, F.when(location["flags"] == 0, "-meta.dat").otherwise("-payload.dat"))))


def static_frame(data: bytes) -> int:
    """How many bytes the frame at the start of data has, by its block table; a frame without one has no known end."""
    from ..functions.codec import CodecError, block_table

    at, blocks = block_table(data)
    if at == 8:
        raise CodecError("bad_frame", "a frame without a table")
    return at + sum(b[0] for b in blocks)


def read_static(located: DataFrame, folder: str) -> DataFrame:
    """located(file candidates as array `files`, byte_offset) with blob and error: still encoded bytes of the first
    candidate that exists; a frame is read to its own end, anything else to the file's."""
    columns = located.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in located.schema)
    files_at, offset_at = columns.index("files"), columns.index("byte_offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.codec import CodecError

        where, root = _open(folder)
        for b in batches:
            data, errors = [], []
            for names, offset in zip(b.column(files_at).to_pylist(), b.column(offset_at).to_pylist(), strict=True):
                blob, error = None, "missing_file"
                for name in names or []:
                    if where.get_file_info(f"{root}/{name}").type == pafs.FileType.File:
                        with where.open_input_file(f"{root}/{name}") as f:
                            f.seek(offset)
                            head = f.read(12)
                            try:
                                if head[:4] == b"BLTE":
                                    header = int.from_bytes(head[4:8], "big")
                                    head += f.read(max(0, header - 12))
                                    blob = head + f.read(static_frame(head) - len(head))
                                else:
                                    blob = head + f.read()
                                error = None
                            except CodecError as e:
                                blob, error = None, e.code
                        break
                data.append(blob)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(columns))), pa.array(data, pa.binary()), pa.array(errors, pa.string())], [*columns, "blob", "error"])

    return located.mapInArrow(run, f"{kinds}, blob binary, error string")


def remote_blobs(wanted: DataFrame, mirrors: list[str], cache: str | None = None, key: str = "ekey", most: int = 512 << 20) -> DataFrame:
    """wanted with data and error from mirrors of a content store (`aa/bb/<key>` below each): the cache first, then the
    mirrors in order, and what one of them had is put into the cache under its final name at once. Mirrors are folders of
    any file system, not hosts."""
    columns = wanted.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema)
    at = columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for b in batches:
            data, errors = [], []
            for k in b.column(at).to_pylist():
                blob, error = None, "not_found"
                name = f"{k.hex()[:2]}/{k.hex()[2:4]}/{k.hex()}" if k else None
                for place in [*([cache] if cache else []), *mirrors] if name else []:
                    where, root = _open(place)
                    info = where.get_file_info(f"{root}/{name}")
                    if info.type != pafs.FileType.File:
                        continue
                    if info.size > most:
                        error = "too_large"
                        continue
                    with where.open_input_file(f"{root}/{name}") as f:
                        blob, error = f.read(), None
                    if cache and place != cache:
                        kept, top = _open(cache)
                        kept.create_dir(f"{top}/{name.rpartition('/')[0]}", recursive=True)
                        temporary = f"{top}/{name}.{uuid.uuid4().hex}"
                        with kept.open_output_stream(temporary) as out:
                            out.write(blob)
                        kept.move(temporary, f"{top}/{name}")
                    break
                data.append(blob)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(columns))), pa.array(data, pa.binary()), pa.array(errors, pa.string())], [*columns, "data", "error"])

    return wanted.mapInArrow(run, f"{kinds}, data binary, error string")


def known_layouts(table: DataFrame) -> list[tuple[int, int, int, int, int]]:
    """key_layouts() as the list that static_location() takes; more than their index bits can tell apart is an error."""
    found = [tuple(r) for r in table.limit(257).collect()]
    if len(found) > 256:
        raise ValueError("more than 256 layouts")
    return found
