"""Byte formats of manifests and indices: parsers from bytes to tuples, and writers to go round with.

Parsers are pure Python with numpy; they raise Malformed where a structure is broken, never anything else for bad bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np

from ..functions.columns import CONTENT_KNOWN, LOCALE_ALL, LOCALE_RETAIL
from ..functions.hashing import name_hashes


class Malformed(ValueError):
    """Bytes that don't follow their format."""


def need(ok: bool, what: str) -> None:
    if not ok:
        raise Malformed(what)


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fdid_hashes(ids: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes of file data ids."""
    h = np.full(len(ids), 0xCBF29CE484222325, np.uint64)
    for k in range(4):
        h = (h ^ (ids.astype(np.uint64) >> np.uint64(8 * k) & np.uint64(0xFF))) * np.uint64(FDID_PRIME)
    return h


#: Fixed value: the multiplier of the file data id's hash.
FDID_PRIME = 0x1000001B3

# Local index: 18-byte records behind a padded header.

IDX = np.dtype([("ekey9", "V9"), ("high", "u1"), ("low", ">u4"), ("size", "<u4")])


def local_index(data: bytes) -> Iterator[tuple[bytes, int, int, int]]:
    """(ekey9, archive, offset, size) of every record."""
    need(len(data) >= 16, "index header")
    (header,) = struct.unpack_from("<I", data)
    start = (8 + header + 15) // 16 * 16
    need(start + 8 <= len(data), "index header")
    (size,) = struct.unpack_from("<I", data, start)
    need(size % IDX.itemsize == 0, f"{size} bytes of entries aren't whole records")
    need(start + 8 + size <= len(data), "index entries")
    r = np.frombuffer(data, IDX, size // IDX.itemsize, start + 8)
    archive = r["high"].astype(np.int64) << 2 | r["low"].astype(np.int64) >> 30
    keys = [data[a : a + 9] for a in range(start + 8, start + 8 + size, IDX.itemsize)]
    yield from zip(keys, archive.tolist(), (r["low"].astype(np.int64) & 0x3FFFFFFF).tolist(), r["size"].tolist(), strict=True)


def write_local_index(records: list[tuple[bytes, int, int, int]]) -> bytes:
    body = b"".join(k + bytes([a >> 2]) + struct.pack(">I", (a & 3) << 30 | o) + struct.pack("<I", s) for k, a, o, s in records)
    return struct.pack("<II", 8, 0) + b"\0" * 8 + struct.pack("<II", len(body), 0) + body


# Archive index: pages of entries, their hashes, a table of contents, a footer.

FOOTER = struct.Struct("<16sB2sBBBBBI8s")


def archive_footer(data: bytes) -> dict:
    need(len(data) >= FOOTER.size, "footer")
    _, version, reserved, page_kb, offset, size, key, check, count, _ = FOOTER.unpack(data[-FOOTER.size :])
    need(version == 1 and reserved == b"\0\0" and check == 8, "footer version")
    need(1 <= key <= 16 and offset <= 8 and 1 <= size <= 4, "footer widths")
    item = key + size + offset
    need(page_kb << 10 >= item, "page below one item")
    return {"key_bytes": key, "size_bytes": size, "offset_bytes": offset, "item": item, "page": page_kb << 10, "count": count}


def archive_index(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(ekey, size, offset) of every entry; a zero key ends a page."""
    f = archive_footer(data)
    pages = (len(data) - FOOTER.size) // (f["page"] + 16)
    k, s = f["key_bytes"], f["size_bytes"]
    for start in range(0, pages * f["page"], f["page"]):
        for at in range(start, start + f["page"] - f["item"] + 1, f["item"]):
            key = data[at : at + k]
            if not any(key):
                break
            yield key.ljust(16, b"\0"), int.from_bytes(data[at + k : at + k + s], "big"), signed(int.from_bytes(data[at + k + s : at + f["item"]], "big"))


def write_archive_index(entries: list[tuple[bytes, int, int]], page_kb: int = 4, key_bytes: int = 16, size_bytes: int = 4, offset_bytes: int = 4) -> bytes:
    items = [e[:key_bytes] + s.to_bytes(size_bytes, "big") + o.to_bytes(offset_bytes, "big") for e, s, o in entries]
    per = (page_kb << 10) // max(1, key_bytes + size_bytes + offset_bytes)
    pages = [b"".join(items[a : a + per]).ljust(page_kb << 10, b"\0") for a in range(0, len(items), per)]
    return b"".join(pages) + b"\0" * 16 * len(pages) + FOOTER.pack(b"\0" * 16, 1, b"\0\0", page_kb, offset_bytes, size_bytes, key_bytes, 8, len(items), b"\0" * 8)


# Encoding table.

ENC = struct.Struct(">2sBBBHHIIBI")


def encoding(data: bytes) -> Iterator[tuple[int, bytes, list[bytes], int]]:
    """(ordinal, ckey, ekeys, size) of every entry of the content-key pages, whose size the header gives."""
    need(len(data) >= ENC.size, "encoding header")
    magic, version, _, _, page_kb, _, pages, _, _, spec = ENC.unpack_from(data)
    need(magic == b"EN" and version == 1, "encoding magic or version")
    need(page_kb > 0 or pages == 0, "encoding page size")
    start, n = ENC.size + spec + pages * 32, 0
    for p in range(pages):
        page = data[start + p * (page_kb << 10) : start + (p + 1) * (page_kb << 10)]
        at = 0
        while at < len(page) and page[at]:
            count, end = page[at], at + 22 + 16 * page[at]
            if end > len(page):
                break
            yield n, page[at + 6 : at + 22], [page[a : a + 16] for a in range(at + 22, end, 16)], int.from_bytes(page[at + 1 : at + 6], "big")
            n, at = n + 1, at + 22 + 16 * count


def write_encoding(entries: list[tuple[bytes, list[bytes], int]], page_kb: int = 4) -> bytes:
    pages, now = [], b""
    for ckey, ekeys, size in entries:
        item = bytes([len(ekeys)]) + size.to_bytes(5, "big") + ckey + b"".join(ekeys)
        if len(now) + len(item) > page_kb << 10:
            pages.append(now)
            now = b""
        now += item
    pages += [now] if now else []
    body = b"".join(p.ljust(page_kb << 10, b"\0") for p in pages)
    return ENC.pack(b"EN", 1, 16, 16, page_kb, page_kb, len(pages), 0, 0, 0) + b"\0" * 32 * len(pages) + body


# Roots. Rows are (name_hash signed, entry_ord, file_data_id or None, path or None, ckey, locale, content).

RootRow = tuple[int, int, int | None, str | None, bytes, int, int]


def flat_root(data: bytes) -> Iterator[RootRow]:
    need(len(data) % 28 == 0, "flat root isn't whole records")
    for n, at in enumerate(range(0, len(data), 28)):
        yield struct.unpack_from("<q", data, at + 16)[0], n, None, None, data[at : at + 16], LOCALE_RETAIL, 0


def manifest_header(data: bytes) -> tuple[int, int]:
    """(version, header size): a size field of 24 and a version of 1 or 2 tell the newer forms."""
    need(len(data) >= 12, "manifest header")
    size, version = struct.unpack_from("<II", data, 4)
    return (version, size) if size == 0x18 and version in (1, 2) else (0, 12)


def manifest_root(data: bytes) -> Iterator[RootRow]:
    """Blocks of deltas, keys and perhaps hashes; a block that the data cut off ends it, one without a locale is wrong."""
    version, at = manifest_header(data)
    need(len(data) >= at, "manifest header")
    n, flags = 0, 17 if version == 2 else 12
    while at + flags <= len(data):
        if version == 2:
            count, locale, c1, c2, c3 = struct.unpack_from("<IIIIB", data, at)
            content = c1 | c2 | c3 << 17
        else:
            count, content, locale = struct.unpack_from("<III", data, at)
        need(locale != 0, "a block without a locale")
        at += flags
        content &= CONTENT_KNOWN
        named = not content & 0x10000000
        if at + count * (28 if named else 20) > len(data):
            break
        delta = np.frombuffer(data, "<i4", count, at).astype(np.int64)
        ids = (np.cumsum(delta) + np.arange(count)) & 0xFFFFFFFF
        keys = at + 4 * count
        at = keys + 16 * count
        if named:
            hashes = np.frombuffer(data, "<i8", count, at)
            at += 8 * count
        else:
            hashes = fdid_hashes(ids).view(np.int64)
        for k in range(count):
            yield int(hashes[k]), n, int(ids[k]), None, data[keys + 16 * k : keys + 16 * k + 16], locale, content
            n += 1


def write_manifest_root(blocks: list[tuple[int, int, list[tuple[int, bytes, int | None]]]], version: int = 0) -> bytes:
    """blocks of (locale, content, [(file_data_id, ckey, hash or None)])."""
    out = b"TSFM" + struct.pack("<II", 0x18, version) + b"\0" * 12 if version else b"TSFM" + struct.pack("<II", 0, 0)
    for locale, content, rows in blocks:
        head = struct.pack("<IIIIB", len(rows), locale, content, 0, 0) if version == 2 else struct.pack("<III", len(rows), content, locale)
        ids = [r[0] for r in rows]
        deltas = [i - (p + 1) for i, p in zip(ids, [-1, *ids[:-1]], strict=True)]
        out += head + struct.pack(f"<{len(rows)}i", *deltas) + b"".join(r[1] for r in rows)
        if not content & 0x10000000:
            out += struct.pack(f"<{len(rows)}q", *[r[2] for r in rows])
    return out


def cstring(data: bytes, at: int) -> tuple[str, int]:
    end = data.find(b"\0", at)
    need(end >= 0, "a string without an end")
    return data[at:end].decode("utf-8", "replace"), end + 1


def install(data: bytes) -> tuple[list[tuple[str, int, bytes]], list[tuple[str, bytes, int]]]:
    """(tags of (name, kind, bits), entries of (name, ckey, size))."""
    need(len(data) >= 10 and data[:2] == b"IN" and data[3] == 16, "install header")
    n_tags, n = struct.unpack_from(">HI", data, 4)
    at, width, tags, entries = 10, -(-n // 8), [], []
    for _ in range(n_tags):
        name, at = cstring(data, at)
        need(at + 2 + width <= len(data), "install tag")
        tags.append((name, int.from_bytes(data[at : at + 2], "big"), data[at + 2 : at + 2 + width]))
        at += 2 + width
    for _ in range(n):
        name, at = cstring(data, at)
        need(at + 20 <= len(data), "install entry")
        entries.append((name, data[at : at + 16], int.from_bytes(data[at + 16 : at + 20], "big")))
        at += 20
    return tags, entries


def install_root(data: bytes) -> Iterator[RootRow]:
    _, entries = install(data)
    hashes = name_hashes([e[0].encode() for e in entries]).view(np.int64)
    for k, (name, ckey, _) in enumerate(entries):
        yield int(hashes[k]), k, None, name, ckey, LOCALE_ALL, 0


def install_files(data: bytes) -> Iterator[tuple[str, bytes, int, list[str]]]:
    """(name, ckey, size, tags) of every entry: what the root form leaves out."""
    tags, entries = install(data)
    for k, (name, ckey, size) in enumerate(entries):
        yield name, ckey, size, [t for t, _, bits in tags if bits[k // 8] >> (7 - k % 8) & 1]


def write_install(tags: list[tuple[str, int, bytes]], entries: list[tuple[str, bytes, int]]) -> bytes:
    out = b"IN\x01\x10" + struct.pack(">HI", len(tags), len(entries))
    out += b"".join(t.encode() + b"\0" + struct.pack(">H", kind) + bits for t, kind, bits in tags)
    return out + b"".join(n.encode() + b"\0" + k + struct.pack(">I", s) for n, k, s in entries)


#: The magic of the newer table of contents, and the most groups.
TOC_MAGIC, TOC_GROUPS = 0xBCDE6611, 300


def contents(data: bytes) -> Iterator[tuple[int, int, int, str]]:
    """(ordinal, group, id, name) of every record of the table of contents."""
    need(len(data) >= 8, "contents header")
    newer = struct.unpack_from("<I", data)[0] == TOC_MAGIC
    at = 4 if newer else 0
    (groups,) = struct.unpack_from("<i", data, at)
    need(0 <= groups <= TOC_GROUPS, f"{groups} groups")
    base = at + 4 + groups * (16 if newer else 12) + 4
    need(base <= len(data), "contents header")
    counts = struct.unpack_from(f"<{groups}i", data, at + 4)
    offsets = struct.unpack_from(f"<{groups}i", data, at + 4 + 4 * groups)
    n = 0
    for count, offset in zip(counts, offsets, strict=True):
        if count > 0:
            start = base + offset
            need(0 <= start and start + 12 * count <= len(data), "contents records")
            for group, number, name in struct.iter_unpack("<iii", data[start : start + 12 * count]):
                need(0 <= start + 12 * count + name <= len(data), "contents names")
                text = data[start + 12 * count + name :].split(b"\0", 1)[0]
                yield n, group, number, text.decode("utf-8", "replace")
                n += 1


def write_contents(groups: dict[int, list[tuple[int, str]]], newer: bool = True) -> bytes:
    total = max(groups, default=-1) + 1
    counts, offsets, body = [], [], b""
    for g in range(total):
        rows = groups.get(g, [])
        names, starts = b"", []
        for _, name in rows:
            starts.append(len(names))
            names += name.encode() + b"\0"
        counts.append(len(rows))
        offsets.append(len(body))
        body += b"".join(struct.pack("<iii", g, number, s) for (number, _), s in zip(rows, starts, strict=True)) + names
    head = (struct.pack("<Ii", TOC_MAGIC, total) if newer else struct.pack("<i", total)) + struct.pack(f"<{total}i", *counts) + struct.pack(f"<{total}i", *offsets)
    return head + b"\0" * (4 * total * (2 if newer else 1)) + b"\0" * 4 + body


# Virtual file system root: a prefix tree of names, spans, and a table of encoding keys.

VFS = struct.Struct(">4sBBBBIIIIIIIHII")
#: The magic, a value's folder bit, its size bits, the most spans.
VFS_MAGIC, FOLDER, FOLDER_SIZE, SPANS = b"TVFS", 0x80000000, 0x7FFFFFFF, 224


def vfs_header(data: bytes) -> tuple[int, bytes, bytes, bytes, int]:
    """(key size, path table, span table, container table, width of an offset into it)."""
    need(len(data) >= VFS.size, "file system header")
    magic, version, _, key, _, _, po, ps, vo, vs, co, cs, _, _, _ = VFS.unpack_from(data)
    need(magic == VFS_MAGIC and version == 1, "file system magic or version")
    for o, s in ((po, ps), (vo, vs), (co, cs)):
        need(o + s <= len(data), "file system table")
    return key, data[po : po + ps], data[vo : vo + vs], data[co : co + cs], max(1, (cs.bit_length() + 7) // 8)


def vfs_files(data: bytes) -> Iterator[tuple[str, bytes, int, int]]:
    """(path, first span's ekey, spans, length of the first span) of every file, nested manifests not followed."""
    key, table, spans, keys, width = vfs_header(data)
    todo: list[tuple[int, int, bytes]] = []
    at, end = 0, len(table)
    if end >= 5 and table[0] == 0xFF:
        need(bool(int.from_bytes(table[1:5], "big") & FOLDER), "the root isn't a folder")
        at = 5
    prefix, path = b"", b""
    todo.append((at, end, prefix))
    while todo:
        at, end, path = todo.pop()
        prefix = path
        while at < end:
            if table[at] == 0:
                path += b"/"
                at += 1
            if at < end and table[at] != 0xFF:
                n = table[at]
                need(at + 1 + n <= end, "a name runs over")
                path += table[at + 1 : at + 1 + n]
                at += 1 + n
            if at < end and table[at] == 0:
                path += b"/"
                at += 1
            if at >= end:
                break
            if table[at] != 0xFF:
                if not path.endswith(b"/"):
                    path += b"/"
                continue
            need(at + 5 <= end, "a value runs over")
            value = int.from_bytes(table[at + 1 : at + 5], "big")
            at += 5
            if value & FOLDER:
                inner = at + (value & FOLDER_SIZE) - 4
                need(at <= inner <= end, "a folder runs over")
                todo.append((inner, end, prefix))  # what follows the folder, after it
                todo.append((at, inner, path))
                break
            if value < len(spans) and 0 < spans[value] <= SPANS:
                need(value + 9 + width <= len(spans), "a span runs over")
                where = int.from_bytes(spans[value + 9 : value + 9 + width], "big")
                need(where + key <= len(keys), "a key lies outside")
                yield path.decode("utf-8", "replace"), keys[where : where + min(key, 16)].ljust(16, b"\0"), spans[value], int.from_bytes(spans[value + 5 : value + 9], "big")
            path = prefix


def write_vfs(files: dict[str, tuple[bytes, int]], key: int = 9) -> bytes:
    """A file system of one folder per first component: {path: (ekey, spans)}."""
    keys = b"".join(e[:key] for e, _ in files.values())
    width = max(1, (len(keys).bit_length() + 7) // 8)
    spans, offsets = b"", {}
    for k, (path, (_, n)) in enumerate(files.items()):
        offsets[path] = len(spans)
        spans += bytes([n]) + (struct.pack(">II", 0, 1) + (k * key).to_bytes(width, "big")) * n
    tree: dict = {}
    for path in files:
        node = tree
        *folders, name = path.split("/")
        for f in folders:
            node = node.setdefault(f, {})
        node[name] = path

    def table(node: dict) -> bytes:
        out = b""
        for name, x in node.items():
            raw = name.encode()
            if isinstance(x, dict):
                inner = table(x)
                out += bytes([len(raw)]) + raw + b"\0\xff" + struct.pack(">I", FOLDER | len(inner) + 4) + inner
            else:
                out += bytes([len(raw)]) + raw + b"\xff" + struct.pack(">I", offsets[x])
        return out

    paths = table(tree)
    paths = b"\xff" + struct.pack(">I", FOLDER | len(paths) + 4) + paths
    at = VFS.size
    head = VFS.pack(VFS_MAGIC, 1, at, key, 0, 0, at, len(paths), at + len(paths), len(spans), at + len(paths) + len(spans), len(keys), 8, 0, 0)
    return head + paths + spans + keys


def root_kind(data: bytes) -> str:
    """What a root blob is, by its first bytes: text, trie, manifest, vfs, install, flat or empty, in this order."""
    sample = data[:2048]
    if sample and b"|" in sample and all(b in b"\n\r\t" or 0x20 <= b <= 0x7E for b in sample):
        return "text"
    for kind, magics in (("trie", (b"MNDX",)), ("manifest", (b"TSFM",)), ("vfs", (VFS_MAGIC,)), ("install", (b"IN\x01\x10",))):
        if data[:4] in magics:
            return kind
    return "flat" if data and len(data) % 28 == 0 else "empty"


ROOTS: dict[str, Callable[[bytes], Iterator[RootRow]]] = {"flat": flat_root, "manifest": manifest_root, "install": install_root}
