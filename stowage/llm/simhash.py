"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints link if they differ in at most `radius` bits. Each distinct fingerprint emits all variants within half
the radius; two of them meet in a variant if and only if they are within the radius. Variants are shuffled by their low
bits: a fingerprint travels once to every bucket that holds one of its variants, and the bucket's task writes out just
those variants, so a shuffle row stands for a ball's whole share of a bucket. In a bucket equal variants are found by
sorting; every pair that shares one is within the radius, so a chain from the group's first member to each other says all
there is to say of it, and a forest per bucket is what leaves the task. Exact copies are one fingerprint from the start.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, modest, rows, sieve, trim
from .components import connected
from .shingles import LEAST, SHINGLE, among, differing, in_order, may_be, parities, partners, prefix, shingle_set, similar, weighed_set, word_hashes, words_of

#: Words per shingle, seed and radius of the defaults; white space that parts words; variants written out at once.
WORDS, SEED, RADIUS, AT_ONCE = 4, 42, 4, 1 << 22
#: Shingles hashed at once, and rows whose bits are added up as bytes.
BLOCK, LANES = 1 << 16, 255


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of h (unsigned 64-bit) have each bit set, bit 63 first."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
    full = len(bits) // LANES * LANES
    sums = bits[:full].reshape(-1, LANES, 8).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return sums + bits[full:].sum(axis=0, dtype=np.uint64).view(np.uint8).astype(np.int64)


def fingerprint(text: str | None, width: int = WORDS, seed: int = SEED) -> int:
    """A bit is 1 if set in over half of the hashes of the shingles; 0 for a text without words or null."""
    from xxhash import xxh64_intdigest as hashed

    words = words_of(text) if text else []
    if not words:
        return 0
    if len(words) <= width:
        return hashed(b" ".join(words), seed)
    sums, n = np.zeros(64, np.int64), len(words) - width + 1
    for first in range(0, n, BLOCK):
        part = words[first : first + BLOCK + width - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = [0, *ends[: len(part) - width].tolist()]
        h = [hashed(line[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
        sums += bit_sums(np.array(h, np.uint64))
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WORDS, seed: int = SEED) -> DataFrame:
    """(key, h, fp) of every row: a hash of the text, and the fingerprint's 64 bits as a signed integer."""

    def made(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            schema = pa.schema([b.schema.field(0), ("h", pa.int64()), ("fp", pa.int64())])
            yield from batches(((k, h, (f := fingerprint(t, width, seed)) - (f >> 63 << 64)) for k, h, t in rows(b)), schema)

    modest(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text")).mapInArrow(made, f"key {kind}, h bigint, fp bigint")


@functools.cache
def flips(bits: int, low: int, high: int) -> np.ndarray:
    """All masks of exactly `bits` set bits from low up to high, exclusive."""
    masks = np.zeros(1, np.uint64)
    tops = np.full(1, low)
    for _ in range(bits):
        grown = [(m | np.uint64(1 << j), j + 1) for m, t in zip(masks, tops, strict=True) for j in range(t, high)]
        masks = np.array([g[0] for g in grown], np.uint64)
        tops = np.array([g[1] for g in grown])
    return masks


def ball_masks(half: int, width: int, spent: int) -> np.ndarray:
    """What a fingerprint is flipped with above the bucket's bits, if `spent` flips went to those."""
    return np.concatenate([flips(k, width, 64) for k in range(half - spent + 1)])


def bucket_forest(fps: np.ndarray, bucket: int, width: int, half: int) -> np.ndarray:
    """Pairs of places in fps that span what the fingerprints that reach this bucket have in common here: (the first of
    its group, other). Each of fps is there once."""
    low = np.uint64((1 << width) - 1)
    spent = np.bitwise_count((fps ^ np.uint64(bucket)) & low)
    groups = [(fps[spent == s] & ~low | np.uint64(bucket), np.flatnonzero(spent == s), ball_masks(half, width, s)) for s in range(half + 1)]
    total = sum(len(i) * len(m) for _, i, m in groups)
    passes = -(-total // AT_ONCE)
    parent = np.arange(len(fps))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return int(k)

    def variants(p: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for base, index, masks in groups:
            step = max(1, AT_ONCE // (4 * max(1, len(masks))))
            for a in range(0, len(base), step):
                v = (base[a : a + step, None] ^ masks).ravel()
                at = np.arange(len(v))
                if passes > 1:  # by a hash, so that neither one pass nor one value of some bits gets most of them
                    at = np.flatnonzero((v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(passes) == p)
                    v = v[at]
                yield v, index[a + at // len(masks)]

    for p in range(passes):
        made = np.concatenate([v for v, _ in variants(p)])
        made.sort()
        twice = np.unique(made[1:][made[1:] == made[:-1]])
        del made
        if not len(twice):
            continue
        seen = np.zeros(1 << 20, bool)
        shift = np.uint64(44)
        mixed = lambda v: v * np.uint64(0xD6E8FEB86659FD93) >> shift
        seen[mixed(twice)] = True
        first = np.full(len(twice), -1)
        for v, index in variants(p):
            may = np.flatnonzero(seen[mixed(v)])
            at = np.searchsorted(twice, v[may])
            at[at == len(twice)] = 0
            hit = twice[at] == v[may]
            at, index = at[hit], index[may[hit]]
            new = first[at] < 0
            first[at[new][::-1]] = index[new][::-1]
            for x, y in np.unique(np.stack([first[at], index], 1), axis=0).tolist():
                if x != y and (rx := root(x)) != (ry := root(y)):
                    parent[max(rx, ry)] = min(rx, ry)
    roots = np.array([root(k) for k in range(len(fps))], np.int64)
    moved = np.flatnonzero(roots != np.arange(len(fps)))
    return np.stack([roots[moved], moved], 1)


def runs(parts: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """The rows of sorted batches by what is in their first `keys` columns, all integers without nulls: (values, slices)."""
    now, held = None, []
    for b in parts:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist(), b.num_rows]
        for x, y in itertools.pairwise(cuts):
            at = tuple(int(c[x]) for c in cols)
            if at != now:
                if held:
                    yield now, held
                now, held = at, []
            held.append(b.slice(x, y - x))
    if held:
        yield now, held


def gathered(parts: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """The columns of batches, joined until there are `most` rows or no more; none is empty."""
    held, n = [], 0
    for b in itertools.chain(parts, [None]):
        if b is not None and b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= most or b is None and n:
            yield [np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(held[0].num_columns)]
            held, n = [], 0


def links(distinct: DataFrame, n: int, radius: int = RADIUS, per_bucket: int = 2048, crowd: int = 4096) -> DataFrame:
    """(a, b) for distinct fingerprints fp: pairs that span every group linked within radius bits, none of them wrong.

    n, the number of fingerprints, sets how many low bits make a bucket: about per_bucket are of its own. A bucket that
    more than twice the mean number reach (and `crowd`) is dealt into parts, each two of which meet in a task, so that no
    task holds more than about twice the mean. Such buckets are less than half of all, 2^20 at most, and are broadcast.
    """
    if radius % 2:
        raise ValueError("an even radius is needed: every pair that meets in a variant must be within it")
    half = radius // 2
    width = min(20, max(6, (max(1, n) // per_bucket).bit_length()))
    masks = [int(m) for k in range(half + 1) for m in flips(k, 0, width)]
    sent = distinct.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("m")).select(F.col("m").bitwiseXOR(F.col("fp").bitwiseAND((1 << width) - 1)).cast("int").alias("bucket"), "fp")
    most = max(crowd, 2 * n * len(masks) >> width)
    crowded = cut(sent.groupBy("bucket").count().filter(F.col("count") > most).select("bucket", F.ceil(F.col("count") * 2 / most).cast("int").alias("parts")))
    if crowded.take(1):
        dealt = sent.join(F.broadcast(crowded), "bucket", "left").withColumn("x", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
        met = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda y: y != F.col("x")))
        sent = dealt.withColumn("y", F.explode(met)).select("bucket", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "fp")
    else:
        sent = sent.select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for (bucket, _, _), held in runs(parts, 3):
                fps = np.sort(np.concatenate([b.column(3).to_numpy() for b in held]))
                yield from map(tuple, fps[bucket_forest(fps.view(np.uint64), bucket, width, half)].tolist())
            trim()

        yield from batches(made(), pa.schema([("a", pa.int64()), ("b", pa.int64())]), most_rows=1 << 16)

    deal = ["bucket", "i", "j"]
    return sent.repartition(*deal).sortWithinPartitions(*deal).mapInArrow(found, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = WORDS, seed: int = SEED) -> DataFrame:
    """(key, fingerprint, component_id) of every row: 16 lower-case hex digits, and the smallest key reachable by links.

    Texts are whole; a null text or one without words has fingerprint zero and links like any other. Repeated rows come
    out as often as they came in, null keys too (they link, but name a component only if it has no other key: then it is
    null). Other columns are dropped; an empty table gives no rows. radius must be even.
    """
    own = cut(fingerprints(docs, key, text, width, seed))
    groups = cut(own.groupBy("fp").agg(F.min("key").alias("first")))
    found = connected(links(groups.select("fp"), groups.count(), radius))
    rooted = cut(groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = cut(rooted.join(least, "root").select("fp", "component_id"))
    return own.join(classes, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Removing near copies: fingerprints within the radius first, then an exact way for the pairs that they leave.

#: Texts sampled for how common shingles are, least count that tells one, and from which count its texts are dealt out.
SAMPLE, COMMON, HOT = 8192, 4, 32
#: Members up to which a bucket gives all its pairs; texts of a block of a larger one; ranks of partners taken first and
#: how many times as far each next round goes.
SMALL, BLOCK_TEXTS, FIRST, FURTHER = 8, 2048, 4, 64
#: Groups of fewer texts are dealt into blocks of about FEW_TEXTS, up to FEW_BLOCKS of them, for the sake of more tasks;
#: where all pairs would give more than MOST_TASKS such blocks, these are larger, as each text goes to a row of blocks.
FEW_TEXTS, FEW_BLOCKS, MOST_TASKS = 128, 16, 1024
#: Rounds in which shingles of large buckets go to the end of the order; rows of such buckets, and their share of the texts,
#: that make one worth while; and shingles of a round. What is left goes to blocks.
ROUNDS, WORTH, SHARE, MOST_LATE = 4, 1 << 12, 0.25, 1 << 18
PAIR = "a bigint, b bigint"


def text_hash(text: str) -> F.Column:
    """A hash of the text; 0 for null and for texts without words."""
    return F.when(F.col(text).rlike(r"[^ \t-\r]"), F.xxhash64(F.col(text))).otherwise(F.lit(0).cast("bigint"))


def common_shingles(texts: DataFrame, n: int, width: int = SHINGLE) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Shingles that are common in a sample of about SAMPLE distinct of n texts (h, text), in order, and their counts; and
    words that are common there, with weights that grow with the logarithm of their counts. They only set the order in
    which prefix() takes shingles and how buckets are dealt: any order finds the same pairs. This one keeps passages that
    many texts hold apart, and takes shingles of rare words first: a sample doesn't show a shingle that one text in some
    thousands has, and its bucket would grow with the input, but its words are common ones."""

    def shingled(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for (t,) in rows(b):
                own = word_hashes(t)
                for word, (w, n) in ((False, np.unique(in_order(own, width), return_counts=True)), (True, np.unique(own, return_counts=True))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), word)), pa.array(w.view(np.int64)), pa.array(n if word else np.ones(len(w), np.int64))], ["word", "w", "n"])

    sample = texts.filter(F.pmod(F.xxhash64("h"), F.lit(max(1, n // SAMPLE))) == 0).groupBy("h").agg(F.first("text").alias("text"))
    counts = cut(sample.select("text").mapInArrow(shingled, "word boolean, w bigint, n bigint").groupBy("word", "w").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON))

    def most(word: bool) -> tuple[np.ndarray, np.ndarray]:
        found = np.array([tuple(r) for r in counts.filter(F.col("word") == word).select("w", "n").orderBy(F.desc("n"), "w").limit(1 << 16).collect()], np.int64).reshape(-1, 2)
        w = found[:, 0].copy().view(np.uint64)
        order = np.argsort(w)
        return w[order], found[order, 1]

    words, times = most(True)
    return most(False), (words, np.rint(8 * np.log2(times)).astype(np.int64))


def prints_of(texts: DataFrame, shared, width: int, least: float) -> DataFrame:
    """(h, n, fp, bits, p) of (h, text): size, SimHash, parities and prefix of a text's shingle set; a text that a task has
    seen before is left out there, so that a hot one comes once a task. shared: common_shingles() as a broadcast."""

    def made(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own() -> Iterator[tuple]:
            seen: set[int] = set()
            common, words = shared.value
            for b in found:
                for h, t in rows(b):
                    if h not in seen:
                        seen.add(h)
                        s, weights = weighed_set(t, words, width)
                        fp = np.packbits(2 * bit_sums(s) > len(s)).view(">i8")[0]
                        yield h, len(s), int(fp), parities(s).tobytes(), prefix(s, common, least, weights).tobytes()

        yield from batches(own(), pa.schema([("h", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("bits", pa.binary()), ("p", pa.binary())]))

    return texts.mapInArrow(made, "h bigint, n int, fp bigint, bits binary, p binary")


def postings(prints: DataFrame, hot: np.ndarray, wanted: bool, near=None) -> DataFrame:
    """(w, h, n) for every shingle w of the prefixes that is hot, or isn't, as wanted; near: a sieve that w must pass too."""

    def spread(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for a in range(0, b.num_rows, 256):
                h, n, p = (c.to_pylist() for c in b.slice(a, 256).columns)
                w, many = np.frombuffer(b"".join(p), np.uint64), [len(x) // 8 for x in p]
                at = np.flatnonzero((among(w, hot) == wanted) & (near(w) if near else True))
                cols = w[at].view(np.int64), np.repeat(np.array(h, np.int64), many)[at], np.repeat(np.array(n, np.int32), many)[at]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["w", "h", "n"])

    return prints.select("h", "n", "p").mapInArrow(spread, "w bigint, h bigint, n int")


def without(posted: DataFrame, taken: np.ndarray, near=None) -> DataFrame:
    """Rows whose w, the first column, isn't one of these shingles; near: a sieve that w must pass too."""

    def left(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            w = b.column(0).to_numpy().view(np.uint64)
            yield b.filter(pa.array(~among(w, taken) & (near(w) if near else True)))

    return posted.mapInArrow(left, posted.schema)


def bucket_pairs(w: np.ndarray, h: np.ndarray, n: np.ndarray, least: float = LEAST) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """For rows in order of (w, n) with whole buckets w: all pairs of h from a bucket of up to SMALL members, if their sizes
    n allow the similarity (False); the rows (w, h) of a larger bucket (True)."""
    members = np.diff(np.append(np.flatnonzero(np.append(True, w[1:] != w[:-1])), len(w)))
    members = np.repeat(members, members)
    yield w[members > SMALL], h[members > SMALL], True
    for d in range(1, min(SMALL, len(w))):
        at = np.flatnonzero((w[d:] == w[:-d]) & (n[:-d] >= least * n[d:] - 1e-9) & (members[d:] <= SMALL))
        yield np.minimum(h[at], h[at + d]), np.maximum(h[at], h[at + d]), False


def proposed(posted: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, many) of (w, h, n) rows, see bucket_pairs(); each once. A bucket is streamed: a task holds no more of it than
    tells that it is large."""

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for x, y, many in bucket_pairs(*cols, least):
                for k in range(0, len(x), 1 << 16):
                    a, b = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), many))], ["a", "b", "many"])

        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        large = None  # the bucket at the end, if it is known to be large
        for p in gathered(parts):
            cols = [np.concatenate([x, c]) for x, c in zip(held, p, strict=True)]
            again = np.append(False, (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1]))
            cols = [c[~again] for c in cols]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if large is not None:  # the rest of a bucket of which some rows have gone out
                k = int(np.searchsorted(cols[0], large, "right"))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0][:k]), pa.array(cols[1][:k]), pa.array(np.full(k, True))], ["a", "b", "many"])
                last, cols = max(0, last - k), [c[k:] for c in cols]
                if not len(cols[0]):
                    held = cols
                    continue
                large = None
            end = len(cols[0]) if len(cols[0]) - last > SMALL else last
            large = int(cols[0][-1]) if end > last else None
            yield from told([c[:end] for c in cols])
            held = [c[end:] for c in cols]
        yield from told(held)
        trim()

    return posted.repartition("w").sortWithinPartitions("w", "n", "h").mapInArrow(found, "a bigint, b bigint, many boolean").distinct()


def plausible(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b) that sizes and parities don't rule out; known: (h, n, bits)."""

    def may(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[int, int]]:
            for b in found:
                for a, o, n, m, x, y in rows(b):
                    if may_be(n, m, int(differing(np.frombuffer(x, np.uint64)[None], np.frombuffer(y, np.uint64)[None])[0, 0]), least):
                        yield a, o

        yield from batches(made(), pa.schema([("a", pa.int64()), ("b", pa.int64())]), most_rows=1 << 16)

    for c in "ab":
        pairs = pairs.join(known.select(F.col("h").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")), c)
    return pairs.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(may, PAIR)


def packed_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, z) of the wanted hashes' texts, compressed; each once, cut from its lineage. A bitmap of bounded size keeps most
    other texts out of the shuffle."""
    near = sieve(wanted, "h")

    def packed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[int, bytes]]:
            seen: set[int] = set()
            for b in found:
                at = np.flatnonzero(near(b.column(0).to_numpy()))
                for k in at.tolist():
                    h = b.column(0)[k].as_py()
                    if h not in seen:
                        seen.add(h)
                        yield h, zlib.compress(b" ".join(words_of(b.column(1)[k].as_py())), 1)

        yield from batches(made(), pa.schema([("h", pa.int64()), ("z", pa.binary())]))

    return cut(texts.mapInArrow(packed, "h bigint, z binary").join(wanted, "h", "left_semi").groupBy("h").agg(F.first("z").alias("z")))


def verified(pairs: DataFrame, texts: DataFrame, width: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(a, b, good) of pairs (a, b) of hashes of texts (h, text): whether the shingle sets are similar enough. Pairs are cut
    before, so a text in many pairs is split."""

    def judged(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            last, own = None, np.zeros(0, np.uint64)
            for r in found:
                for a, b, x, y in rows(r, 64):
                    if b != last:
                        last, own = b, shingle_set(zlib.decompress(y).decode("utf-8", "surrogatepass"), width)
                    yield a, b, similar(shingle_set(zlib.decompress(x).decode("utf-8", "surrogatepass"), width), own) >= least
            trim()

        yield from batches(made(), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("good", pa.bool_())]))

    stored = packed_texts(texts, cut(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()))
    for c in "ab":
        pairs = pairs.join(stored.select(F.col("h").alias(c), F.col("z").alias(f"z{c}")), c)
    return cut(pairs.select("a", "b", "za", "zb").mapInArrow(judged, PAIR + ", good boolean"), bare=True)


def mixed(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(w, h, root) of (w, h), and (w, hub, all) of the buckets w whose texts aren't all of one group: the largest group and
    how many texts there are."""
    rooted = cut(members.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")))
    groups = rooted.groupBy("w", "root").agg(F.count("*").alias("m"))
    hubs = groups.groupBy("w").agg(F.sum("m").alias("all"), F.max("m").alias("most"), F.max_by("root", F.struct("m", "root")).alias("hub")).filter("all > most")
    return rooted, cut(hubs.select("w", "hub", "all"))


def later(late: np.ndarray, counts: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """common with further shingles; of two counts the greater holds."""
    w, c = np.append(common[0], late), np.append(common[1], counts)
    order = np.lexsort((c, w))
    w, c = w[order], c[order]
    last = np.append(w[1:] != w[:-1], True) if len(w) else np.zeros(0, bool)
    return w[last], c[last]


def holding(members: DataFrame, late: np.ndarray) -> DataFrame:
    """(h) of (w, h): the texts of these buckets."""

    def held(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(among(b.column(0).to_numpy().view(np.uint64), late)))], ["h"])

    return cut(members.select("w", "h").mapInArrow(held, "h bigint").distinct())


def renewed(texts: DataFrame, affected: DataFrame, shared, taken: np.ndarray, width: int, least: float) -> DataFrame:
    """(w, h, n, late) of the affected texts h: the shingles that come into their prefixes as the order changes, and (late)
    those of the prefixes that are taken anyway. shared: the order before, the order now and the words' weights."""
    near = sieve(affected, "h")

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            seen: set[int] = set()
            before, now, words = shared.value
            for b in parts:
                for k in np.flatnonzero(near(b.column(0).to_numpy())).tolist():
                    h = b.column(0)[k].as_py()
                    if h not in seen:
                        seen.add(h)
                        s, weights = weighed_set(b.column(1)[k].as_py(), words, width)
                        p = prefix(s, now, least, weights)
                        late = among(p, taken)
                        for w, x in ((p[late], True), (np.setdiff1d(p[~late], prefix(s, before, least, weights), assume_unique=True), False)):
                            yield from ((w, h, len(s), x) for w in w.view(np.int64).tolist())

        yield from batches(made(), pa.schema([("w", pa.int64()), ("h", pa.int64()), ("n", pa.int32()), ("late", pa.bool_())]), most_rows=1 << 16)

    return cut(texts.mapInArrow(found, "w bigint, h bigint, n int, late boolean"))


def blocks(members: DataFrame, known: DataFrame, roots: DataFrame) -> DataFrame:
    """(w, i, j, first, out, h, n, bits) of (w, h): the tasks (w, i, j) in which each two texts of a bucket meet that aren't
    both of its largest group. Buckets with the same largest group are taken together, as copies share many shingles, and
    w names that group; what isn't of it is out. Block i of those (first) meets block j of all."""
    rooted, hubs = mixed(members, roots)
    texts = cut(rooted.join(hubs, "w").select(F.col("hub").alias("w"), "h", (F.col("root") != F.col("hub")).alias("out")).distinct())
    sizes = cut(texts.groupBy("w").agg(F.count("*").alias("nj"), F.count_if("out").alias("ni")))
    pairs = sizes.agg(F.sum(F.col("ni").cast("double") * F.col("nj"))).first()[0] or 0
    few = min(BLOCK_TEXTS, max(FEW_TEXTS, int((pairs / MOST_TASKS) ** 0.5)))
    parts = lambda n: F.greatest(F.ceil(n / BLOCK_TEXTS), F.least(F.ceil(n / few), F.lit(FEW_BLOCKS))).cast("int")
    sizes = sizes.select("w", parts(F.col("ni")).alias("ni"), parts(F.col("nj")).alias("nj"))
    placed = texts.join(sizes, "w").join(known.select("h", "n", "bits"), "h")
    at = lambda n: F.pmod(F.xxhash64("h"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.transform(every("ni"), lambda i: F.struct(i.alias("i"), at("nj").alias("j"), F.lit(False).alias("first")))
    also = F.transform(every("nj"), lambda j: F.struct(at("ni").alias("i"), j.alias("j"), F.lit(True).alias("first")))
    placed = placed.withColumn("t", F.explode(F.concat(own, F.when(F.col("out"), also).otherwise(F.slice(also, 1, 0)))))
    return cut(placed.select("w", "t.i", "t.j", "t.first", "out", "h", "n", "bits"))


def further(placed: DataFrame, roots: DataFrame, lo: int, hi: int, least: float) -> DataFrame:
    """(a, b): in each task of blocks(), the partners of ranks lo to hi of its texts that are out, where both aren't joined
    yet; (0, 0) if others are left for later rounds."""

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[int, int]]:
            for _, held in runs(parts, 3):
                first, out, h, n, root = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (3, 4, 5, 6, 7))
                bits = [np.frombuffer(x, np.uint64) for b in held for x in b.column(8).to_pylist()]
                if len(np.unique(root)) > 1:
                    mine, others = np.flatnonzero(first), np.flatnonzero(~first)
                    sides = [{"h": h[k], "n": n[k], "root": root[k], "out": out[k]} for k in (mine, others)]
                    pairs, more = partners(*sides, [bits[k] for k in mine], [bits[k] for k in others], lo, hi, least)
                    for x, y in pairs:
                        a, b = int(h[mine[x]]), int(h[others[y]])
                        yield min(a, b), max(a, b)
                    if more:
                        yield 0, 0
            trim()

        yield from batches(made(), pa.schema([("a", pa.int64()), ("b", pa.int64())]), most_rows=1 << 16)

    rooted = placed.join(roots, "h", "left").select("w", "i", "j", "first", "out", "h", "n", F.coalesce("root", "h").alias("root"), "bits")
    return rooted.repartition("w", "i", "j").sortWithinPartitions("w", "i", "j", "first", "h").mapInArrow(found, PAIR).distinct()


def text_links(texts: DataFrame, n: int, width: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(h, root) of every hash of texts (h, text) that has a link: a text linked by similarity >= least of shingle sets.

    Links come in three steps, and every one is verified on the whole texts. First, ball hashing: SimHash fingerprints
    within RADIUS bits, equal ones included. At a similarity of 0.8 fingerprints differ in 10 bits or so, so an exact way
    follows for the rest: two such texts share a shingle of their prefixes (see prefix()), and pairs of buckets of up to
    SMALL texts are all verified that sizes and parities don't rule out. Shingles of larger buckets that hold more than
    one group, such as a passage that many texts quote, then go to the end of the order, where the sample would have put
    them had it been larger: only texts that had them in their prefixes take other shingles, and only buckets of these are
    new. In the large buckets that remain (and those of shingles that are hot in a sample) every text outside the largest group is held against all others, in blocks: in each round its
    next partners, of those that may be similar and aren't joined yet, are verified, until none is left.
    """
    common, words = common_shingles(texts, n, width)
    shared = texts.sparkSession.sparkContext.broadcast((common, words))
    hot = common[0][common[1] >= HOT]
    prints = cut(prints_of(texts, shared, width, least))
    known = cut(prints.groupBy("h").agg(*[F.first(c).alias(c) for c in ("n", "fp", "bits")]))
    fps = cut(known.groupBy("fp").agg(F.min("h").alias("own")))
    near = links(fps.select("fp"), fps.count())
    for c in "ab":
        near = near.withColumnRenamed(c, "fp").join(fps, "fp").withColumnRenamed("own", c).drop("fp")
    equal = known.join(fps, "fp").filter("h <> own").select(F.col("own").alias("a"), F.col("h").alias("b"))
    found = cut(proposed(postings(prints, hot, False), least))
    pairs = near.select("a", "b").unionByName(equal).unionByName(found.filter("not many").select("a", "b"))
    pairs = cut(plausible(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), known, least))
    members = found.filter("many").select(F.col("a").alias("w"), F.col("b").alias("h"))
    if len(hot):
        members = members.unionByName(postings(prints, hot, True).select("w", "h").distinct())
    judged = verified(pairs, texts, width, least)
    roots = connected(judged.filter("good")).withColumnRenamed("node", "h")
    members, taken, extra = cut(members), hot, []
    for _ in range(ROUNDS):
        hubs = without(mixed(members, roots)[1].select("w", "all"), taken)
        if (hubs.agg(F.sum("all")).first()[0] or 0) < max(WORTH, SHARE * n):
            break
        late = hubs.orderBy(F.desc("all"), "w").limit(MOST_LATE).toArrow()
        counts = np.maximum(1, late.column(1).to_numpy() * SAMPLE // max(n, SAMPLE))
        late = late.column(0).to_numpy().view(np.uint64)
        before, common, late = common, later(late, counts, common), np.sort(late)
        taken = np.union1d(taken, late)
        fresh = renewed(texts, holding(members, late), texts.sparkSession.sparkContext.broadcast((before, common, words)), taken, width, least)
        new = fresh.filter("not late").select("w", "h", "n")
        near = sieve(new, "w")  # a bucket without a new row has given its pairs in a round before
        posted = postings(prints, taken, False, near).unionByName(new)
        for x in extra:
            posted = posted.unionByName(without(x, taken, near))
        extra.append(new)
        found = cut(proposed(posted, least))
        pairs = cut(plausible(found.filter("not many").select("a", "b").distinct().join(judged, ["a", "b"], "left_anti"), known, least), bare=True)
        if pairs.take(1):
            judged = judged.unionByName(verified(pairs, texts, width, least))
            roots = connected(judged.filter("good")).withColumnRenamed("node", "h")
        members = without(members, late).unionByName(fresh.filter("late").select("w", "h")).unionByName(found.filter("many").select(F.col("a").alias("w"), F.col("b").alias("h")))
        members = cut(members.distinct(), bare=True)
    placed = blocks(members, known, roots)
    lo, hi = 0, FIRST
    while placed.take(1):
        found = cut(further(placed, roots, lo, hi, least), bare=True)
        new = cut(found.filter("a <> b").join(judged, ["a", "b"], "left_anti"), bare=True)
        if new.take(1):
            judged = judged.unionByName(verified(new, texts, width, least))
            roots = connected(judged.filter("good")).withColumnRenamed("node", "h")
        if not found.filter("a = 0 and b = 0").take(1):
            break
        lo, hi = hi, hi * FURTHER
    return roots


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest key (null keys last), of equal keys that with
    the smallest text hash, of equal rows any one.

    Groups are what links of a Jaccard similarity of `least` or more of the texts' sets of `width`-word shingles join: all
    such links (see text_links()) but for collisions of 64-bit hashes, so recall is 1 whatever the edits and the keys'
    order; clean texts stay. Texts without words, null ones included, are copies of each other. Keys may be of any type
    that can be ordered. All columns, whatever their names, stay as they are; an empty table stays empty.
    """
    modest(docs.sparkSession)
    texts = docs.select(text_hash(text).alias("h"), F.col(text).alias("text")).filter("h <> 0")
    keys = cut(docs.select(F.col(key).alias("key"), text_hash(text).alias("h")).groupBy("key", "h").count())
    roots = text_links(texts, docs.count(), width, least)
    least_key = F.min(F.struct(F.col("key").isNull().alias("null"), "key", "h")).alias("w")
    told = cut(keys.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")))
    best = cut(told.groupBy("root").agg(least_key).select("root", F.col("w.key").alias("best"), F.col("w.h").alias("winner")))
    told = told.join(best, "root").withColumn("stays", F.col("key").eqNullSafe(F.col("best")) & (F.col("h") == F.col("winner")))
    told = cut(told.filter("not stays or count > 1").select("key", "h", "stays", F.xxhash64("key", "h").alias("c")))
    near = sieve(told, "c")

    @F.arrow_udf("boolean")
    def touched(c: pa.Array) -> pa.Array:
        return pa.array(near(c.to_numpy()))

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("key"), text_hash(text).alias("h"))
    whole = whole.withColumn("touched", touched(F.xxhash64("key", "h")))

    def same(one: DataFrame, other: DataFrame):
        return one["key"].eqNullSafe(other["key"]) & (one["h"] == other["h"])

    # only rows that the bitmap doesn't clear are shuffled: losers go, and rows that are repeated stay once
    some, again = whole.filter("touched"), told.filter("stays")
    once = some.join(told, same(some, told), "left_anti")
    one = some.join(again, same(some, again), "left_semi").dropDuplicates(["key", "h"])
    kept = whole.filter("not touched").unionByName(once).unionByName(one)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
