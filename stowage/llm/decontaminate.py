"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a document that has as many words as an item, at every position, is a candidate; a document of fewer words
than an item is one window itself. Its fingerprint has two 64-bit words, each a SimHash of its weighted shingles by hashes
of its own; an item is a candidate if either word is within `radius` bits. A multi-index of Hamming blocks finds all of
those: of two halves that differ in r bits in all, one differs in at most its share (shares and the number of halves add
up to r + 1), and so for the two blocks of a half. Lookups are by block, halves are compared next, so that fewer than 1 %
of unrelated items are left (tested). Then the exact weighted similarity of the shingles decides. A window without a
shingle of any item has similarity 0, so fingerprints are only made of windows that hold one.

Recall: at a similarity of just 0.8 a word differs in 9.7 bits on average, with a deviation of 2.9: more than 16 in one of
110 cases, and in both words in one of 12,000; above 0.85 in none of a million.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches, cut, modest, rows, sieve

#: Words per shingle, least similarity, radius in bits, bytes of items per pass.
WORDS, LEAST, RADIUS, BLOCK_BYTES = 5, 0.8, 16, 16 << 20
#: Fewest and most bits of the marks of a benchmark that needs several passes (64 MB at most); item sizes up to how many
#: times the least of a group are tested together.
FEWEST_MARKS, MOST_MARKS, GROUP = 1 << 20, 1 << 29, 1.5
#: Words handled at once; positions whose windows are fingerprinted at once; lookups that a block remembers.
SLAB, AT_ONCE, REMEMBERED = 1 << 18, 1 << 13, 4096
word_list = re.compile(r"\w+").findall


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, for bits that are as good as random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def full_hashes(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width word numbers from each of starts."""
    h = np.zeros(len(starts), np.uint64)
    for k in range(width):
        h = mixed(h * np.uint64(31) + ids[starts + k].astype(np.uint64) + np.uint64(k))
    return h


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width word numbers."""
    return full_hashes(ids, np.arange(max(0, len(ids) - width + 1)), width)


def prints(weights: np.ndarray) -> np.ndarray:
    """Fingerprints from the summed signs of each of 128 bits: a row of two words each."""
    return np.packbits(weights > 0, axis=1).view(">u8").reshape(-1, 2).astype(np.uint64)


def signs(h: np.ndarray) -> np.ndarray:
    both = np.stack([h, mixed(h ^ np.uint64(0x9E3779B97F4A7C15))], 1)
    return np.unpackbits(both.astype(">u8").view(np.uint8), axis=1).reshape(-1, 128).astype(np.int32) * 2 - 1


def shares(radius: int) -> tuple[int, int]:
    """Most bits that either of two parts may differ in, so that one is within if the whole is within the radius."""
    return radius // 2, (radius - 1) // 2


class Hamming:
    """All words of a list within a radius of a word, by 16-bit blocks of 32-bit halves."""

    def __init__(self, words: np.ndarray, radius: int):
        self.words, self.radius = words, radius
        self.halves = []
        for k, most in enumerate(shares(radius)):
            half = (words >> np.uint64(32 * k)).astype(np.uint32)
            parts = []
            for j, reach in enumerate(shares(most)):
                block = (half >> np.uint32(16 * j)).astype(np.uint16)
                order = np.argsort(block, kind="stable")
                values, starts = np.unique(block[order], return_index=True)
                parts.append((16 * j, reach, values, np.split(order, starts[1:]) if len(values) else [], {}))
            self.halves.append((32 * k, most, half, parts))

    def candidates(self, f: int) -> np.ndarray:
        """Places of words of which a half is within its share."""
        found = []
        for shift, most, half, parts in self.halves:
            own = f >> shift & 0xFFFFFFFF
            for low, reach, values, holders, known in parts:
                v = own >> low & 0xFFFF
                at = known.get(v)
                if at is None:
                    near = np.flatnonzero(np.bitwise_count(values ^ np.uint16(v)) <= reach)
                    at = np.concatenate([holders[k] for k in near]) if len(near) else np.zeros(0, np.int64)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[v] = at
                if len(at):
                    found.append(at[np.bitwise_count(half[at] ^ np.uint32(own)) <= most])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def near(self, f: int) -> np.ndarray:
        may = self.candidates(f)
        return may[np.bitwise_count(self.words[may] ^ np.uint64(f)) <= self.radius]


def similarity(a: Counter, b: Counter) -> float:
    """The weighted Jaccard similarity, a shingle's weight being how often it occurs."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class Index:
    """The items of one pass."""

    def __init__(self, items: list[tuple], width: int, radius: int, least: float):
        self.width, self.least = width, least
        split = [(k, word_list(t.lower())) for k, t in items if t]
        split = [(k, w) for k, w in split if w]
        #: Word numbers from 1; other words are 0 and in no item's shingle.
        self.known: dict[str, int] = {w: n for n, w in enumerate(dict.fromkeys(x for _, ws in split for x in ws), 1)}
        ids = [np.array([self.known[w] for w in ws]) for _, ws in split]
        self.keys = [k for k, _ in split]
        self.sizes = np.array([len(x) for x in ids], np.int64)
        #: An item of fewer words than a shingle is one shingle.
        own = [shingle_hashes(x, min(width, len(x))) for x in ids]
        self.counts = [Counter(h.tolist()) for h in own]
        self.prints = np.concatenate([prints(signs(h).sum(axis=0, keepdims=True)) for h in own]) if own else np.zeros((0, 2), np.uint64)
        self.words = [Hamming(self.prints[:, k], radius) for k in range(2)]
        #: For each shingle width, the items' shingles in order, and which item sizes each occurs in.
        self.anchors: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for k in sorted({min(width, len(x)) for x in ids}):
            sizes: dict[int, set[int]] = {}
            for h, x in zip(own, ids, strict=True):
                if min(width, len(x)) == k:
                    for v in h.tolist():
                        sizes.setdefault(v, set()).add(len(x))
            order = sorted(sizes)
            self.anchors[k] = np.array(order, np.uint64), [sorted(sizes[v]) for v in order]

    def near(self, f: list[int]) -> np.ndarray:
        """All items of which a word is within the radius of a fingerprint's."""
        return np.union1d(*(w.near(x) for w, x in zip(self.words, f, strict=True)))

    def whole_matches(self, ids: np.ndarray, found: dict[int, float]) -> None:
        """A text of fewer words than some items, as one window."""
        larger = self.sizes[self.sizes > len(ids)]
        for k in {min(self.width, int(n)) for n in larger if len(ids) >= self.least * (n - self.width)}:
            if len(ids) >= k:
                h = shingle_hashes(ids, k)
                own = Counter(h.tolist())
                for item in self.near(prints(signs(h).sum(axis=0, keepdims=True))[0].tolist()).tolist():
                    if self.sizes[item] > len(ids) and min(self.width, self.sizes[item]) == k and (x := similarity(own, self.counts[item])) >= self.least:
                        found[item] = max(x, found.get(item, 0.0))

    def slab_matches(self, ids: np.ndarray, found: dict[int, float]) -> None:
        known = ids > 0
        for k, (anchors, sizes) in self.anchors.items():
            n = len(ids) - k + 1
            if n <= 0:
                continue
            full = known[:n].copy()
            for j in range(1, k):
                full &= known[j : j + n]
            full = np.flatnonzero(full)
            if not len(full):
                continue
            own = full_hashes(ids, full, k)
            at = np.searchsorted(anchors, own)
            at[at == len(anchors)] = 0
            hit = anchors[at] == own
            if not hit.any():
                continue
            h = shingle_hashes(ids, k)
            held: dict[int, list[int]] = {}
            for start, a in zip(full[hit].tolist(), at[hit].tolist(), strict=True):
                for size in sizes[a]:
                    held.setdefault(size, []).append(start)
            for size, hits in held.items():
                n = size - k + 1  # shingles of a window
                starts = np.unique((np.array(hits)[:, None] - np.arange(n)).ravel())
                starts = starts[(starts >= 0) & (starts + size <= len(ids))]
                for a in range(0, len(starts), AT_ONCE):
                    self.windows(h, starts[a : a + AT_ONCE], n, size, found)

    def windows(self, h: np.ndarray, starts: np.ndarray, n: int, size: int, found: dict[int, float]) -> None:
        own, at = np.unique((starts[:, None] + np.arange(n)).ravel(), return_inverse=True)
        total = np.concatenate([np.zeros((1, 128), np.int32), np.cumsum(signs(h[own]), axis=0, dtype=np.int32)])
        first = at.reshape(-1, n)[:, 0]
        for f, s in zip(prints(total[first + n] - total[first]).tolist(), starts.tolist(), strict=True):
            may = self.near(f)
            for item in may[self.sizes[may] == size].tolist():
                if found.get(item, 0.0) < 1.0:
                    x = similarity(Counter(h[s : s + n].tolist()), self.counts[item])
                    if x >= self.least and x > found.get(item, 0.0):
                        found[item] = x

    def matches(self, text: str | None) -> dict[int, float]:
        """For each item of which a window of the whole text is a near copy, the best similarity."""
        found: dict[int, float] = {}
        if not text or not self.keys:
            return found
        words = word_list(text.lower())
        known = self.known
        ids = np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
        longest = int(self.sizes.max())
        if 0 < len(ids) < longest:
            self.whole_matches(ids, found)
        for a in range(0, max(1, len(ids) - longest + 1), SLAB):
            self.slab_matches(ids[a : a + SLAB + longest - 1], found)
        return found


def word_hashes(text: str) -> np.ndarray:
    from xxhash import xxh64_intdigest as hashed

    words = word_list(text.lower())
    return np.fromiter((hashed(w) for w in words), np.uint64, len(words))


def may_hold(benchmark: DataFrame, text: str, width: int, least: float):
    """A test of one text that holds for all with a near copy of an item, and else mostly for texts that quote as much as
    the smallest item: its shingles are looked up in a bitmap of all items'. A window as similar as `least` to an item of its size has at most 1 - least of its shingles
    outside the item, and so has every part of it: for a group of item sizes a window of the least size is looked for that
    lacks no more than the largest may. The bitmap has 16 bits a shingle, MOST_MARKS at most; beyond that more texts pass.
    """

    def marked(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for b in found:
                for (t,) in rows(b):
                    if t and len(words := word_hashes(t)):
                        k = min(width, len(words))
                        for h in shingle_hashes(words, k).view(np.int64).tolist():
                            yield k, len(words) - k + 1, h

        yield from batches(made(), pa.schema([("k", pa.int32()), ("n", pa.int64()), ("h", pa.int64())]), most_rows=1 << 16)

    marks = cut(benchmark.select(F.col(text)).mapInArrow(marked, "k int, n bigint, h bigint"))
    group = F.floor(F.log("n") / float(np.log(GROUP)))
    sizes = [tuple(r) for r in marks.groupBy("k", group.alias("g")).agg(F.min("n").alias("low"), F.max("n").alias("high")).select("k", "low", "high").collect()]
    bits = min(MOST_MARKS, max(FEWEST_MARKS, 1 << (16 * marks.count()).bit_length()))
    near = sieve(marks, "h", bits)
    longest = max((k + high - 1 for k, _, high in sizes), default=0)

    def test(t: str | None) -> bool:
        words = word_hashes(t) if t and sizes else np.zeros(0, np.uint64)
        for k in sorted({k for k, _, _ in sizes}):
            if len(words) < k:
                continue
            hit = near(shingle_hashes(words, k).view(np.int64))
            if len(words) < longest and hit.sum() >= least * len(hit) - 1e-6:
                return True
            total = np.append(0, np.cumsum(hit))
            for own, low, high in sizes:
                if own == k and len(hit) >= low and (total[low:] - total[:-low]).max() >= low - (1 - least) * high - 1e-6:
                    return True
        return False

    return test


def parted(docs: DataFrame, at: int, test) -> tuple[DataFrame, DataFrame]:
    """The rows of docs of which column number `at` passes the test, written once, and the others."""

    def taken(wanted: bool) -> DataFrame:
        def part(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in found:
                for a in range(0, b.num_rows, 256):
                    own = b.slice(a, 256)
                    yield own.filter(pa.array([test(t) == wanted for t in own.column(at).to_pylist()], pa.bool_()))

        return docs.mapInArrow(part, docs.schema)

    return cut(taken(True)), taken(False)


def several(benchmark: DataFrame, text: str, most: int) -> int:
    """How many passes of at most about `most` bytes the items need."""
    return -(-(benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0) // most) or 1


def item_passes(benchmark: DataFrame, key: str, text: str, n: int) -> Iterator[list[tuple]]:
    """The items in n lists of about the same size, each fetched when it is asked for."""
    for k in range(n):
        part = benchmark if n == 1 else benchmark.filter(F.pmod(F.xxhash64(key, text), F.lit(n)) == k)
        yield [tuple(r) for r in part.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text)).distinct().collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WORDS, least: float = LEAST, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, item, similarity): a row for each row of docs and item of which it holds a near copy; clean rows give none.

    Words are runs of letters, digits and underscores, lower-cased. Items go to the executors in passes of at most about
    block_bytes of text each. The documents are read once, and nothing is shuffled: if there are several passes, a scan
    first writes those that may hold an item (see may_hold()), and the passes read these. Null and empty texts
    or items match nothing; an item of fewer words than a shingle is one shingle; items that are the same text are each
    reported, with keys of any type; repeated rows are reported as often as they come, null keys with a null. Other columns are dropped.
    """
    modest(docs.sparkSession)
    spark = docs.sparkSession
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    out, n = None, several(benchmark, item_text, block_bytes)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if n > 1:
        docs, _ = parted(docs, 1, may_hold(benchmark, item_text, width, least))
    for items in item_passes(benchmark, item, item_text, n):
        shared = spark.sparkContext.broadcast(items)

        def made(found: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, width, radius, least)
            for b in found:
                hits = ((k, index.keys[i], x) for k, t in rows(b) for i, x in sorted(index.matches(t).items()))
                yield from batches(hits, pa.schema([b.schema.field(0), ("item", item_type), ("similarity", pa.float64())]))

        part = docs.mapInArrow(made, f"key {kinds[0]}, item {kinds[1]}, similarity double")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("key").alias(key), F.col("item").alias(item), "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, **options) -> DataFrame:
    """docs without the rows that hold a near copy of an item; all columns, whatever their names, stay as they are. With
    several passes (see contaminated()) the documents are read twice: for those that may hold an item, and for the rest."""
    modest(docs.sparkSession)
    spark = docs.sparkSession
    at, n, rest = docs.columns.index(text), several(benchmark, item_text, block_bytes), None
    made = (options.get("width", WORDS), options.get("radius", RADIUS), options.get("least", LEAST))
    if n > 1:
        docs, rest = parted(docs, at, may_hold(benchmark, item_text, made[0], made[2]))
    for items in item_passes(benchmark, item, item_text, n):
        shared = spark.sparkContext.broadcast(items)

        def kept(found: Iterator[pa.RecordBatch], shared=shared, made=made) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, *made)
            for b in found:
                for a in range(0, b.num_rows, 256):
                    part = b.slice(a, 256)
                    yield part.filter(pa.array([not index.matches(t) for t in part.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs if rest is None else docs.union(rest)
