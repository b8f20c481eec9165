"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is its letters' character n-grams (over UTF-8 bytes, words parted by one space), hashed to buckets; the mean of
the buckets' embeddings goes through a linear layer and a softmax whose temperature is fitted on documents apart from
those it is trained on, and so is the score under which a prediction is rejected. Training is stochastic gradient descent
in numpy on a bounded sample, on the driver; for prediction embeddings and layer are one table of a row per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, modest, rows, trim

#: N-gram lengths in bytes, buckets, dimensions, bytes handled at once.
GRAMS, BUCKETS, DIM, SLAB = (2, 3, 4), 1 << 16, 16, 1 << 20
#: The sample: rows per language, the longest text in it, in bytes, and most languages.
SAMPLE, SAMPLE_BYTES, LANGS = 800, 1 << 14, 256
#: Share of the calibration documents whose right predictions may be rejected, and the most the limit may be.
REJECT, MOST_LIMIT = 0.001, 0.4
UNKNOWN = "und"
#: ASCII letters in lower case, bytes of other scripts' characters as they are, all else a space.
_FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def folded(text: str) -> bytes:
    """The text's words with a space around each. Latin-1's capitals are folded by way of their lower-case bytes."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" "


def buckets(data: bytes) -> Iterator[np.ndarray]:
    """The buckets of all n-grams, a slab at a time."""
    for a in range(0, max(1, len(data) - GRAMS[0] + 1), SLAB):
        x = np.frombuffer(data[a : a + SLAB + GRAMS[-1] - 1], np.uint8).astype(np.uint32)
        h = x.copy()
        for n in range(2, GRAMS[-1] + 1):
            h = h[: len(x) - n + 1] * np.uint32(0x01000193) ^ x[n - 1 :]
            if n in GRAMS:
                own = h[:SLAB]
                yield ((own * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(16)).astype(np.int64) % BUCKETS


@dataclass
class Model:
    """langs; a row of logits per bucket; what is added to their mean; the score below which a prediction is rejected."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    limit: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for b in buckets(folded(text)):
            # few distinct buckets take most of a long text
            total += np.bincount(b, minlength=BUCKETS) @ self.table if len(b) > BUCKETS else self.table[b].sum(axis=0)
            n += len(b)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The best language and its calibrated probability; UNKNOWN and 0 for null and for texts without a letter."""
        if not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        if not self.langs:
            return UNKNOWN, 0.0
        z = self.logits(text)
        p = np.exp(z - z.max())
        k = int(z.argmax())
        return self.langs[k], float(p[k] / p.sum())


def fit(sample: list[tuple[str, str]], epochs: int = 4, rate: float = 0.5, seed: int = 7) -> Model:
    """A model from (text, lang) rows; every fifth calibrates the temperature and the limit. The order doesn't matter."""
    langs = sorted({lang for _, lang in sample})
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    seen = []
    for text, lang in sorted(sample):
        found = [b for b in buckets(folded(text)) if len(b)]
        if found:
            index, n = np.unique(np.concatenate(found), return_counts=True)
            seen.append((index.astype(np.int32), (n / n.sum()).astype(np.float32), langs.index(lang)))
    held, learnt = seen[::5], [x for k, x in enumerate(seen) if k % 5] or seen
    steps, at = epochs * len(learnt), 0
    for _ in range(epochs):
        for k in rng.permutation(len(learnt)):
            index, share, y = learnt[k]
            eta = rate * (1 - at / steps)
            at += 1
            h = share @ emb[index]
            z = h @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            back = out @ g
            out -= eta * np.outer(h, g)
            bias -= eta * 0.1 * g
            emb[index] -= (eta * 20) * share[:, None] * back
    table = emb @ out
    raw = np.array([share @ table[index] + bias for index, share, _ in held]) if held else np.zeros((0, len(langs)))
    truth = np.array([y for _, _, y in held], np.int64)

    def loss(scale: float) -> float:
        z = raw * scale
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    scale = min(np.geomspace(0.05, 20, 60), key=loss) if len(raw) else 1.0
    z = raw * scale
    p = np.exp(z - z.max(axis=1, keepdims=True)) if len(raw) else z
    score = (p / p.sum(axis=1, keepdims=True)).max(axis=1) if len(raw) else np.zeros(0)
    right = score[raw.argmax(axis=1) == truth] if len(raw) else score
    limit = min(MOST_LIMIT, float(np.quantile(right, REJECT))) if len(right) else 0.0
    del seen, held, learnt
    trim()
    return Model(langs, (table * scale).astype(np.float32), bias * scale, limit)


def training_sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, most_langs: int = LANGS) -> list[tuple[str, str]]:
    """At most about per_lang rows of each of the most_langs most frequent languages (of equal frequency the first), drawn
    by a hash of key and text over the whole table; a text comes once for each language.

    Only rows that may be learnt from: lang known, crc32 of the key modulo 4 not 2, at most most_bytes of text.
    """
    fair = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key) & (F.octet_length(text) <= most_bytes))
    counts = {r[0]: r[1] for r in fair.groupBy(F.col(lang).alias("l")).count().orderBy(F.desc("count"), "l").limit(most_langs).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(1 << 30)) / (1 << 30)
    return [tuple(r) for r in fair.filter(draw < share[F.col(lang)]).select(F.col(text), F.col(lang)).distinct().collect()]


def held_out(key: str):
    """Whether crc32 of the key as text, modulo 4, is 2; a null key isn't."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, **options) -> Model:
    return fit(training_sample(docs, **options))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, rejected) of every row, from the whole text alone.

    A null text and one without a letter are UNKNOWN, score 0, rejected; others get a learned language, and are rejected
    if the score is below the model's limit. Repeated rows and null keys come out as often as they came in; other
    columns are dropped; an empty table gives no rows. Nothing is shuffled.
    """
    modest(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in found:
            schema = pa.schema([b.schema.field(0), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
            yield from batches(((k, *(p := own.predict(t)), p[0] == UNKNOWN or p[1] < own.limit) for k, t in rows(b)), schema)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(made, f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the rows whose language is rejected; all columns, whatever their names, stay as they are."""
    modest(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def kept(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in found:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                said = [own.predict(t) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array([x[0] != UNKNOWN and x[1] >= own.limit for x in said], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
