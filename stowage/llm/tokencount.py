"""Token counts with a whole-token shortcut.

Offline, each vocabulary string is encoded alone by the library; those that come out as one token are proved whole, and
words equal to them count one without a merge. Words are what stands between spaces: no piece of the vocabulary holds a
space mark after another character (checked when it is loaded), so no merge reaches over a word's start, and counts add
up. Only other words go through the library, once each while the bounded memo holds them.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest
from .tok import LONGEST, MEMO, slabs, tokenizer_path

MARK = "▁"


class Counter:
    """Counts of a sentencepiece BPE model with a dummy prefix and no other normalisation."""

    def __init__(self, name: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        path = tokenizer_path(name)
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        plain, own = spec.normalizer_spec, {p.type for p in spec.pieces}
        pieces = [p.piece for p in spec.pieces if p.type == 1]
        #: Counts may be added up word by word.
        self.additive = plain.add_dummy_prefix and not plain.remove_extra_whitespaces and not plain.precompiled_charsmap and 4 not in own and not any(MARK in p.lstrip(MARK) for p in pieces)
        words = [p[1:] for p in pieces if p[0] == MARK and len(p) > 1 and p[1] != MARK]
        self.whole = {w: 1 for w, ids in zip(words, self.lib.encode(words, num_threads=1), strict=True) if len(ids) == 1}
        self.known, self.old = dict(self.whole), {}

    def lib_counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.lib.encode(texts, num_threads=1)]

    def words(self, slab: str) -> list[str]:
        """Parts of which the library counts each alone as it does within the text; the first has the dummy prefix, a later one its own space."""
        if slab[0] != " " and slab[-1] != " " and "  " not in slab:
            return slab.split(" ")
        return [p[1:] for p in re.findall(r" +[^ ]+(?: +\Z)?", f" {slab}")] if slab.strip(" ") else [slab]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.additive or MARK in text:
            return self.lib_counts([text])[0]
        total = 0
        for k, slab in enumerate(slabs(text)):
            parts = self.words(slab[1:] if k else slab)  # a later slab starts with its word's own space
            known = self.known
            got = list(map(known.get, parts))
            if None in got:
                holes = [p for p, n in zip(parts, got, strict=True) if n is None]
                new = dict.fromkeys(holes)
                made = {p: self.old[p] for p in new if p in self.old}
                rest = [p for p in new if p not in made]
                made.update(zip(rest, self.lib_counts(rest), strict=True))
                got = [n for n in got if n is not None] + [made[p] for p in holes]
                if len(known) + len(made) > MEMO:
                    self.old, self.known = known, dict(self.whole)
                self.known.update(made if max(map(len, new)) <= LONGEST else {p: n for p, n in made.items() if len(p) <= LONGEST})
            total += sum(got)
        return total


@functools.cache
def counter(name: str) -> Counter:
    return Counter(name)


def count_tokens(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    A null or empty text has 0 bytes and 0 tokens; repeated rows and null keys come out as often as they came in; other
    columns are dropped; an empty table gives no rows. Texts are counted whole in slabs, with no shuffle.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for b in batches:
            n = pa.array([own.count(t) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["key", "n_bytes", "n_tokens"])

    modest(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    t = F.col(text)
    return (
        docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(t), F.lit(0)).cast("bigint").alias("n_bytes"), t.alias("text"))
        .mapInArrow(counted, f"key {kind}, n_bytes bigint, n_tokens bigint")
        .select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
