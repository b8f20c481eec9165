"""Quality from weak labels: heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Each labeller votes good, bad or nothing on a whole text. Labellers overlap and err; taking them to be independent given
the truth, expectation-maximisation estimates the share of good texts and each labeller's accuracy on good and bad ones
from the counts of vote patterns over all documents (a pattern is a number below 3 ** labellers, so the counts are of
bounded size). The posterior of a pattern is its documents' soft label. A linear scorer on hashed features learns these
labels on a bounded sample and then scores every whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, modest, rows, trim

#: Hash buckets of the scorer, most documents it learns from, longest text among them in bytes, bytes handled at once.
BUCKETS, SAMPLE, SAMPLE_BYTES, SLAB = 1 << 16, 6000, 1 << 15, 1 << 20
BAD, NONE, GOOD = 0, 1, 2
#: (fact, bad at or beyond, good at or within or None): the labellers; a fact that is bad when low has its bounds the
#: other way. Most see one defect only and say nothing of other texts; the last three look at a text as a whole, so that
#: every defect is in the view of two at least.
LABELLERS: tuple[tuple[str, float, float | None], ...] = (
    ("symbols", 0.03, None),
    ("capitals", 0.25, None),
    ("runs", 0.10, None),
    ("shouts", 0.10, None),
    ("bars", 0.10, None),
    ("common", 0.25, None),
    ("distinct", 0.35, 0.55),
    ("endings", 0.15, 0.02),
    ("letters", 0.45, 0.75),
)
#: Facts that are bad when low.
LOW = frozenset(("distinct", "letters"))
_KIND = np.zeros(256, np.uint8)
for _c in range(256):
    _KIND[_c] = 1 if chr(_c).islower() and _c < 128 or _c >= 128 else 2 if _c < 128 and chr(_c).isupper() else 3 if _c in b"#$%&*<>{}[]|\\~^" else 4 if _c in b" \t\n\r\v\f" else 0
#: Bytes with letters folded to their kind.
_FOLDED = np.where(_KIND == 1, 97, np.where(_KIND == 2, 65, np.arange(256))).astype(np.uint8)


def facts(text: str) -> dict[str, float]:
    """Shares that the labellers look at."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds, odd = np.zeros(5, np.int64), 0
    for at in range(0, len(data), SLAB):
        x = data[at : at + SLAB + 2]  # a word's end is told from the two bytes before it
        k = _KIND[x]
        kinds += np.bincount(k[:SLAB], minlength=5)
        last = np.flatnonzero((k[1:] == 4) & (k[:-1] != 4)) if at + SLAB < len(data) else np.append(np.flatnonzero((k[1:] == 4) & (k[:-1] != 4)), len(k) - 1)
        odd += int(np.count_nonzero((k[last] == 3) | (x[last] == 33) & (x[np.maximum(last, 1) - 1] == 33)))
    words = text.lower().split()
    n, size = max(1, len(words)), max(1, len(data) - int(kinds[4]))
    runs = sum(map(str.__eq__, words, words[1:]))
    # long texts repeat common words: the share is taken over what so many words could be
    often = Counter(words)
    distinct = len(often) / n ** (1 if n < 200 else 0.93) * (1 if n < 200 else 200**-0.07)
    return {
        "symbols": int(kinds[3]) / size,
        "capitals": int(kinds[2]) / size if size >= 40 else 0.0,
        "distinct": distinct,
        "runs": runs / n if runs > 2 else 0.0,
        "endings": odd / n,
        "common": max(often.values(), default=0) / n if n >= 20 else 0.0,
        "shouts": text.count("!!") / n,
        "bars": text.count(" | ") / n,
        "letters": int(kinds[1] + kinds[2]) / size,
    }


def votes(text: str | None) -> list[int]:
    """A vote per labeller; all NONE for a text without words."""
    if not text or text.isspace():
        return [NONE] * len(LABELLERS)
    found = facts(text)
    out = []
    for name, bad, good in LABELLERS:
        side = -1 if name in LOW else 1
        x = side * found[name]
        out.append(BAD if x >= side * bad else GOOD if good is not None and x <= side * good else NONE)
    return out


def pattern(v: list[int]) -> int:
    return sum(x * 3**k for k, x in enumerate(v))


@dataclass
class LabelModel:
    """The prior of good, and a labeller's chance of each vote on bad and on good texts: chance[labeller][truth][vote]."""

    prior: float
    chance: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability that a text with these votes is good."""
        v = patterns[:, None] // 3 ** np.arange(len(self.chance)) % 3
        odds = np.log(np.array([1 - self.prior, self.prior]))[:, None] + sum(np.log(c[:, v[:, k]]) for k, c in enumerate(self.chance))
        return 1 / (1 + np.exp(np.clip(odds[0] - odds[1], -50, 50)))


def estimate(counts: dict[int, int], rounds: int = 100, smooth: float = 1.0) -> LabelModel:
    """Expectation-maximisation over pattern counts, from votes taken at their word."""
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], np.float64)
    v = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good = np.where((v == BAD).any(axis=1), 0.1, np.where((v == GOOD).any(axis=1), 0.9, 0.5))
    model = LabelModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])
        prior = float((weight[1].sum() + smooth) / (n.sum() + 2 * smooth))
        chance = np.stack([np.stack([[weight[t][v[:, k] == x].sum() + smooth for x in range(3)] for t in range(2)]) for k in range(len(LABELLERS))])
        model = LabelModel(prior, chance / chance.sum(axis=2, keepdims=True))
        now = model.posterior(patterns)
        if len(now) == 0 or np.abs(now - good).max() < 1e-9:
            break
        good = now
    return model


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and shares of a text's features: its byte trigrams with letters folded to their kind in half of them."""
    total = np.zeros(BUCKETS, np.int64)
    data = text.encode("utf-8", "replace")
    for a in range(0, max(1, len(data)), SLAB):
        x = np.frombuffer(data[a : a + SLAB + 2], np.uint8)
        if len(x) > 2:
            both = np.stack([x, _FOLDED[x]]).astype(np.uint32)
            h = (both[:, :-2] * np.uint32(0x01000193) ^ both[:, 1:-1]) * np.uint32(0x01000193) ^ both[:, 2:]
            h = (h[:, :SLAB] * np.uint32(0x9E3779B1) + np.arange(2, dtype=np.uint32)[:, None]) >> np.uint32(16)
            total += np.bincount((h & np.uint32(BUCKETS - 1)).ravel(), minlength=BUCKETS)
    at = np.flatnonzero(total)
    share = np.sqrt(total[at].astype(np.float32))
    return at, share / (np.linalg.norm(share) or 1)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """The probability of good; 0 for null and for texts without words."""
        if not text or text.isspace():
            return 0.0
        at, share = hashed(text)
        return float(1 / (1 + np.exp(-np.clip(share @ self.weights[at] + self.bias, -50, 50))))


def learn_scorer(sample: list[tuple[str, float]], epochs: int = 6, rate: float = 4.0, seed: int = 11) -> Scorer:
    """Logistic regression on soft labels by stochastic gradient descent; rows of either class weigh the same in all."""
    sample = sorted(x for x in sample if x[0])
    seen = [(*hashed(t), y) for t, y in sample]
    mass = np.array([sum(1 - y for *_, y in seen), sum(y for *_, y in seen)]) + 1e-9
    weights, bias, rng = np.zeros(BUCKETS, np.float32), 0.0, np.random.default_rng(seed)
    steps, done = max(1, epochs * len(seen)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(seen)):
            at, share, y = seen[k]
            eta = rate * (1 - done / steps)
            done += 1
            p = 1 / (1 + np.exp(-np.clip(share @ weights[at] + bias, -50, 50)))
            g = (p - y) * len(seen) / 2 * (y / mass[1] + (1 - y) / mass[0])
            weights[at] -= np.float32(eta * g) * share
            bias -= eta * 0.1 * g
    return Scorer(weights, float(bias))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, least: float = 0.5) -> DataFrame:
    """(key, votes, posterior, score, keep) of every row.

    votes has a digit per labeller (0 bad, 1 none, 2 good); posterior is the label model's probability of good; score
    the linear scorer's; keep says that both together (their mean in log-odds) are at least `least`. A null text or one
    without words has no votes, posterior and score 0, and isn't kept. Repeated rows and null keys come out as often as
    they came in; other columns are dropped; an empty table gives no rows. Votes are counted over all rows; the scorer
    learns from about `sample` rows of at most sample_bytes, drawn by a hash over the whole table, half of them from the
    rows that the label model holds bad if there are so many.
    """
    modest(docs.sparkSession)
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    empty = F.col("text").isNull() | F.col("text").rlike(r"^\s*$")

    def voted(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            h = b.column(2).to_pylist()
            schema = pa.schema([b.schema.field(0), ("pattern", pa.int32()), ("blank", pa.bool_()), ("draw", pa.int64()), ("small", pa.bool_())])
            yield from batches(((k, pattern(votes(t)), not t or t.isspace(), h[i], len(t or "") <= sample_bytes // 4) for i, (k, t, _) in enumerate(rows(b))), schema)

    draw = F.xxhash64("text").alias("draw")
    labels = cut(own.select("key", "text", draw).mapInArrow(voted, f"key {kind}, pattern int, blank boolean, draw bigint, small boolean"))
    counted = labels.filter("not blank").groupBy("pattern").agg(F.count("*").alias("n"), F.count(F.when(F.col("small"), 1)).alias("small")).collect()
    counts = {r["pattern"]: r["n"] for r in counted}
    model = estimate(counts)
    good = dict(zip(sorted(counts), model.posterior(np.array(sorted(counts), np.int64)).tolist(), strict=True))
    sides = [sum(r["small"] for r in counted if (good[r["pattern"]] >= 0.5) == side) for side in (False, True)]
    share = [min(1.0, sample / 2 / max(1, n)) for n in sides]
    by_pattern = spark.sparkContext.broadcast(good)
    least_draw = [int(s * (1 << 30)) for s in share]

    def drawn(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for b in found:
                for t, h in rows(b):
                    if (h & ((1 << 30) - 1)) < max(least_draw):
                        y = by_pattern.value.get(pattern(votes(t)), 0.5)
                        if (h & ((1 << 30) - 1)) < least_draw[y >= 0.5]:
                            yield t, y

        yield from batches(made(), pa.schema([("text", pa.string()), ("good", pa.float64())]))

    some = own.filter(~empty & (F.length("text") <= sample_bytes // 4)).select("text", draw).mapInArrow(drawn, "text string, good double").distinct()
    scorer = spark.sparkContext.broadcast(learn_scorer([tuple(r) for r in some.collect()]))
    trim()

    def scored(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear, known = scorer.value, by_pattern.value

        def made(b: pa.RecordBatch) -> Iterator[tuple]:
            for k, t in rows(b):
                v = votes(t)
                blank = not t or t.isspace()
                p = 0.0 if blank else known.get(pattern(v), 0.5)
                s = linear.score(t)
                odds = 0.0 if blank else float(np.sqrt(p * s) / max(1e-12, np.sqrt(p * s) + np.sqrt((1 - p) * (1 - s))))
                yield k, "".join(map(str, v)), p, s, not blank and odds >= least

        for b in found:
            schema = pa.schema([b.schema.field(0), ("votes", pa.string()), ("posterior", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_())])
            yield from batches(made(b), schema)

    return own.mapInArrow(scored, f"key {kind}, votes string, posterior double, score double, keep boolean").withColumnRenamed("key", key)
