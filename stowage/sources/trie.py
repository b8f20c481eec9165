"""The trie root: three succinct name tries and chains of entries.

A trie's shape is one bit string (for every node, in level order, a 1 per child and a 0): the k-th 1 is node k, the run
after the k-th 0 holds node k's children. Labels are a byte, or a string in a shared pool, or a path of a nested trie read
from a node up to the root. One unpacked bit array with its running sums answers every rank and select.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import LOCALE_ALL, package_locale
from ..functions.hashing import name_hash
from ..operators.resolve import first_wins, longest_prefix
from .binary import table_function
from .formats import Malformed, need

#: The magics, the bits of an entry that name its package, the bit that ends a chain.
ROOT_MAGIC, TRIE_MAGIC, PACKAGE, LAST = b"MNDX", b"MAR\0", 0x00FFFFFF, 0x80000000
#: Deepest nesting and longest name that are followed.
NESTED, LONGEST = 8, 4096


class Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def ints(self, n: int, kind: str = "<i4") -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        need(n >= 0 and self.at + size <= len(self.data), "a trie is cut off")
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += size
        return out

    def int(self) -> int:
        return int(self.ints(1)[0])

    def array(self, kind: str = "<u4", width: int = 1) -> np.ndarray:
        """A byte count and so many bytes."""
        size = self.int()
        item = np.dtype(kind).itemsize * width
        need(size >= 0 and size % item == 0, "an array isn't whole")
        return self.ints(size // item * width, kind).reshape(-1, width) if width > 1 else self.ints(size // item, kind)


class Bits:
    """A bit string with rank and select; the file's own tables for them are passed over."""

    def __init__(self, r: Reader):
        words = r.array()
        self.total, self.valid = r.int(), r.int()
        r.array("<i4", 3), r.array("<i4"), r.array("<i4")
        self.bits = np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)
        self.ranks = np.concatenate([[0], np.cumsum(self.bits)])
        self.ones = np.flatnonzero(self.bits)
        self.zeros = np.flatnonzero(~self.bits)

    def __contains__(self, k: int) -> bool:
        return 0 <= k < len(self.bits) and bool(self.bits[k])

    def rank(self, k: int) -> int:
        return int(self.ranks[k])


class Trie:
    def __init__(self, r: Reader, depth: int = 0):
        need(depth < NESTED, "tries are nested too deeply")
        self.shape, self.files, self.long = Bits(r), Bits(r), Bits(r)
        self.low = r.array("u1")
        self.high, self.width = r.array(), r.int()
        r.ints(3)  # a mask that follows from the width, and a 64-bit count
        self.pool = r.array("u1").tobytes()
        self.ends = Bits(r)
        self.inner = Trie(r, depth + 1) if self.long.valid and not self.pool else None
        self.shortcuts = r.array("<i4", 3)
        self.top = r.int()
        r.int()

    def offset(self, node: int) -> int:
        """Where a node's long label is: its low byte, and packed high bits by rank."""
        need(node < len(self.low), "a label lies outside")
        bit = self.long.rank(node) * self.width
        need((bit + self.width + 7) // 8 <= 4 * len(self.high), "a label lies outside")
        word = int.from_bytes(self.high.tobytes()[bit // 32 * 4 : bit // 32 * 4 + 8], "little") >> bit % 32
        return (word & (1 << self.width) - 1) << 8 | int(self.low[node])

    def pooled(self, at: int) -> bytes:
        """The pool's string from a place on: up to a zero byte, or up to and with a marked end."""
        need(0 <= at <= len(self.pool), "a string lies outside")
        if not self.ends.total:
            return self.pool[at:].split(b"\0", 1)[0]
        k = int(np.searchsorted(self.ends.ones, at))
        return self.pool[at : int(self.ends.ones[k]) + 1 if k < len(self.ends.ones) else len(self.pool)]

    def long_label(self, at: int) -> bytes:
        return self.inner.upward(at) if self.inner else self.pooled(at)

    def label(self, node: int) -> bytes:
        if node in self.long:
            return self.long_label(self.offset(node))
        need(node < len(self.low), "a label lies outside")
        return bytes([int(self.low[node])])

    def upward(self, node: int) -> bytes:
        """The labels from a node to the root, as nested tries hold their strings back to front."""
        out = b""
        while len(out) <= LONGEST:
            parent, child, at = self.shortcuts[node & len(self.shortcuts) - 1].tolist() if len(self.shortcuts) else (0, -1, 0)
            if child == node:
                out += bytes([at & 0xFF]) if at & 0xFFFFFF00 == 0xFFFFFF00 else self.long_label(at)
                node = parent
                if not node:
                    return out
            else:
                out += self.label(node)
                if node <= self.top:
                    return out
                need(node < len(self.shape.ones), "a node lies outside")
                node = int(self.shape.ones[node]) - node - 1
        raise Malformed("a name doesn't end")

    def names(self) -> Iterator[tuple[int, str]]:
        """(index, name) of every file, depth first."""
        todo = [(0, b"")]
        steps = 0
        while todo:
            node, name = todo.pop()
            steps += 1
            need(steps <= len(self.shape.bits) + 1 and len(name) <= LONGEST, "a trie runs in a circle")
            if node in self.files:
                yield self.files.rank(node), name.decode("utf-8", "replace")
            if node >= len(self.shape.zeros):
                continue
            start = int(self.shape.zeros[node]) + 1
            end = int(self.shape.zeros[node + 1]) if node + 1 < len(self.shape.zeros) else len(self.shape.bits)
            first = start - node - 1
            todo += [(k, name + self.label(k)) for k in reversed(range(first, first + end - start))]


def trie_at(data: bytes, at: int) -> Trie:
    need(data[at : at + 4] == TRIE_MAGIC, "no trie")
    return Trie(Reader(data, at + 4))


HEADER = struct.Struct("<4sii")
COLUMNS = "kind string, idx bigint, path string, package_id bigint, ckey binary, size bigint"


def trie_root(data: bytes) -> Iterator[tuple]:
    """Rows of one blob: `package`, `name` and `file` with idx and path, `entry` with idx (the chain), package_id and ckey."""
    need(len(data) >= HEADER.size, "root header")
    magic, header, form = HEADER.unpack_from(data)
    need(magic == ROOT_MAGIC and form in (1, 2), "root magic or version")
    r = Reader(data, HEADER.size + 8 * (header == 2))
    infos, count, size, start, total, valid, _ = r.ints(7).tolist()
    need(count == 3, f"{count} tries")
    for k, kind in enumerate(("package", "name", "file")):
        at = int(Reader(data, infos + size * k + 12).ints(1)[0])
        yield from ((kind, n, path, None, None, None) for n, path in trie_at(data, at).names())
    need(start >= 0 and start + 24 * total <= len(data), "entries")
    link = 0
    for flags, ckey, length in struct.iter_unpack("<I16si", data[start : start + 24 * max(0, total)]):
        if link < max(1, valid):
            yield "entry", link, None, flags & PACKAGE, ckey, length
        link += flags >> 31


def trie_entries(files: DataFrame, strict: bool = False) -> DataFrame:
    """(path, package_id, status, name_hash, ckey, locale, content) of every file in trie roots' blobs (file, blob).

    status is ok, no_package, no_name, name_missing or entry_missing: a file's package is the longest that is a prefix,
    what follows it is looked up among the names, whose index is a chain of entries, and of that the package's first.
    Numbers of packages, names and chains are a file's own, so each root is resolved by itself.
    """
    rows = table_function(files, trie_root, COLUMNS, strict=strict).filter("error is null")
    packages = rows.filter("kind = 'package'").select("file", F.col("idx").alias("package_id"), F.col("path").alias("package"))
    names = first_wins(rows.filter("kind = 'name'").select("file", "path", "idx"), ["file", "path"], ["idx"]).select("file", F.col("path").alias("_name"), F.col("idx").alias("link"))
    entries = first_wins(rows.filter("kind = 'entry'").withColumn("seq", F.monotonically_increasing_id()).select("file", F.col("idx").alias("link"), "package_id", "ckey", "seq"), ["file", "link", "package_id"], ["seq"]).drop("seq")
    own = longest_prefix(rows.filter("kind = 'file'").select("file", "path"), packages, on=["file"])
    own = own.join(packages, ["file", "package_id"], "left")
    rest = F.substring("path", F.length("package") + 2, F.length("path"))
    own = own.withColumn("_rest", F.when(F.length("package") + 1 < F.length("path"), rest))
    exact = own.join(names.withColumnRenamed("_name", "_rest"), ["file", "_rest"], "left")
    lower = names.withColumnsRenamed({"file": "_file", "_name": "_low", "link": "_link"})
    both = exact.join(lower, (F.col("file") == lower["_file"]) & (F.lower("_rest") == lower["_low"]) & exact["link"].isNull(), "left").withColumn("link", F.coalesce("link", "_link")).drop("_file", "_low", "_link")
    found = both.join(entries, ["file", "link", "package_id"], "left")
    status = F.when(F.col("package").isNull(), "no_package").when(F.col("_rest").isNull(), "no_name").when(F.col("link").isNull(), "name_missing").when(F.col("ckey").isNull(), "entry_missing").otherwise("ok")
    locale = F.when(F.col("package").isNotNull(), package_locale(F.col("package"))).otherwise(F.lit(LOCALE_ALL))
    return found.select("path", "package_id", status.alias("status"), name_hash(F.col("path")).alias("name_hash"), "ckey", locale.cast("bigint").alias("locale"), F.lit(0).cast("bigint").alias("content"))


def diagnostics(entries: DataFrame) -> DataFrame:
    """(status, files): how far files came."""
    return entries.groupBy("status").agg(F.count("*").alias("files"))


# Writers, to go round with.


def _array(body: bytes) -> bytes:
    return struct.pack("<i", len(body)) + body


def _bits(ones: list[int], total: int) -> bytes:
    words = np.zeros(-(-max(total, 1) // 512) * 512, np.uint8)
    words[ones] = 1
    return _array(np.packbits(words, bitorder="little").tobytes()) + struct.pack("<ii", total, len(ones)) + _array(b"") * 3


def write_trie(names: dict[str, int] | list[str], pool: bool = True) -> bytes:
    """A trie of names in level order; nodes with one child and no file of their own are drawn together into long labels
    if pool is set. File numbers follow from the order of nodes: names_in_order() of the result tells them."""
    tree: dict = {}
    for name in names:
        node = tree
        for c in name.encode():
            node = node.setdefault(c, {})
        node[None] = True

    def gather(c: int, node: dict) -> tuple[bytes, dict]:
        label = bytes([c])
        while pool and len(node) == 1 and None not in node:
            c, node = next(iter(node.items()))
            label += bytes([c])
        return label, node

    shape, labels, is_file, level = [1, 0], [b""], [None in tree], [tree]
    while level:
        below = []
        for node in level:
            for c in sorted(k for k in node if k is not None):
                label, child = gather(c, node[c])
                shape.append(1)
                labels.append(label)
                is_file.append(None in child)
                below.append(child)
            shape.append(0)
        level = below
    strings, long, low, high = b"", [], bytearray(len(labels)), []
    for k, label in enumerate(labels):
        if len(label) > 1:
            long.append(k)
            low[k] = len(strings) & 0xFF
            high.append(len(strings) >> 8)
            strings += label + b"\0"
        elif label:
            low[k] = label[0]
    width = max(1, max(high, default=0).bit_length())
    packed = sum(h << k * width for k, h in enumerate(high)).to_bytes(-(-(len(high) * width + 64) // 32) * 4, "little")
    n = len(labels)
    out = TRIE_MAGIC + _bits([k for k, b in enumerate(shape) if b], len(shape)) + _bits([k for k in range(n) if is_file[k]], n) + _bits(long, n)
    out += _array(bytes(low)) + _array(packed) + struct.pack("<iIq", width, (1 << width) - 1, len(high))
    out += _array(strings or (b"\0" if long else b"")) + _bits([], 0) + _array(b"") + struct.pack("<ii", 0, 0)
    return out


def names_in_order(trie: bytes) -> list[str]:
    return [name for _, name in sorted(trie_at(trie, 0).names())]


def write_trie_root(packages: list[str], files: dict[str, list[tuple[str, bytes]]], stripped: list[str]) -> bytes:
    """files: the name within packages -> [(package, ckey)]; every package's file is its path, a slash, the name."""
    first, second = write_trie(packages), write_trie(stripped)
    third = write_trie([f"{p}/{n}" for n, own in files.items() for p, _ in own])
    number = {p: k for k, p in enumerate(names_in_order(first))}
    entries, chains = b"", 0
    for name in names_in_order(second):
        own = files.get(name, [(None, bytes(16))])
        for k, (package, ckey) in enumerate(own):
            flags = (number[package] if package is not None else PACKAGE) | (LAST if k == len(own) - 1 else 0)
            entries += struct.pack("<I16si", flags, ckey, 1)
        chains += 1
    tries, infos = (first, second, third), HEADER.size + 28
    at, rows, body = infos + 20 * 3, b"", b""
    for k, t in enumerate(tries):
        rows += struct.pack("<5i", k, len(t), 0, at + len(body), 0)
        body += t
    return HEADER.pack(ROOT_MAGIC, 1, 1) + struct.pack("<7i", infos, 3, 20, at + len(body), len(entries) // 24, chains, 24) + rows + body + entries
