import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import packing, queries, tok, tokencount, tokenio
from stowage.llm.common import scratch
from stowage.session import table

LETTERS = [*map(chr, range(1, 256)), "\n", " ", " ", "Ω", "İ", "ﬁ", "中", "🙂", "́", "▁", "　"]
ODD = ["a\tb c", "a \n\n b  c \n", " a", "  ", "\n", "x\t y", "<|endoftext|> hi", "a<|startoftext|>", "It's <|ENDOFTEXT|>'s", "é İA ΑΣ", "a § b •", "▁a ▁ b", "ab " * 500_000]


def strings(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 60))) + rng.choice(["", " word, another word."]) for _ in range(n)]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_the_librarys(name, spaced):
    own = tok.encoder(name, spaced)
    for t in ODD + strings(3000):
        assert own.encode(t) == own.raw(t), t
    assert own.encode(None) == own.encode("") == b""


def test_memo_of_any_size_gives_the_same(monkeypatch):
    monkeypatch.setattr(tok, "MEMO", 5)
    monkeypatch.setattr(tok, "SLAB", 50)
    own = tok.Encoder("word_bpe_49k.json", False)
    for t in strings(200, 2):
        assert own.encode(t) == own.raw(t)


def test_counts_are_the_librarys(monkeypatch):
    own = tokencount.Counter("piece_bpe_32k.model")
    assert own.additive and own.whole
    for t in ODD + strings(3000, 3):
        assert own.count(t) == own.lib_counts([t])[0], t
    monkeypatch.setattr(tokencount, "MEMO", 5)
    for t in strings(200, 4):
        assert own.count(t) == own.lib_counts([t])[0]


def test_count_tokens(odd_docs, no_docs):
    found = tokencount.count_tokens(odd_docs).collect()
    assert len(found) == odd_docs.count() and found[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    lib = tokencount.counter("piece_bpe_32k.model")
    want = Counter((r.doc_id, len((r.text or "").encode()), lib.lib_counts([r.text])[0] if r.text else 0) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in found) and any(r.over_limit for r in found)
    assert tokencount.count_tokens(no_docs).collect() == []


def check_packing(pieces, texts, capacity):
    lib = tok.encoder("byte_bpe_50k.json", True)
    ids = {k: lib.raw(t) + b"\0\0\0\0" if t else b"\0\0\0\0" for k, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][4 * p.start : 4 * (p.start + p.length)])
        assert p.doc_tokens == len(ids[p.doc_id]) // 4
    for k, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own[:-1]]]).tolist()
        assert sum(p.length for p in own) == len(ids[k]) // 4
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own[:-1]]]).tolist()
        assert sum(p.length for p in own) <= capacity
    assert by_doc.keys() == texts.keys()
    return by_sequence


def test_packing_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    found = check_packing(queries.op2_packing(spark, sf_dir).collect(), texts, 1024)
    total = sum(p.length for own in found.values() for p in own)
    assert len(found) * 1024 - total < 1024 * 4  # less than a sequence per task


def test_packing_odd_rows(odd_docs, no_docs):
    once = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = packing.pack(once).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(pieces, {r.doc_id: r.text for r in once.collect()}, 1024)
    assert packing.pack(odd_docs).filter("doc_id is null").count() == 2
    assert packing.pack(odd_docs).filter("doc_id = 1").count() >= 2
    assert packing.pack(no_docs).collect() == []


def test_assign_balances_cost():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 900) for _ in range(400)] + [1024, 4096, 5000]
    pieces, used = packing.assign(lengths, 1024)
    load = Counter()
    for doc, start, n, sequence, offset in pieces:
        assert offset == load[sequence] and 0 < n <= 1024 and start >= 0 and doc < len(lengths)
        load[sequence] += n
    assert max(load.values()) <= 1024 and len(load) == used and used == -(-sum(lengths) // 1024)
    assert packing.assign([], 1024) == ([], 0)


def test_token_files(spark, odd_docs, no_docs):
    folder = scratch(spark, "ids")
    manifest = tokenio.write_token_files(odd_docs, folder, file_docs=3)
    rows = sorted(tokenio.read_token_files(manifest).collect(), key=lambda r: r.start)
    lib = tok.encoder("word_bpe_49k.json", False)
    want = Counter((r.doc_id, (lib.raw(r.text) if r.text else b"") + b"\1\0\0\0") for r in odd_docs.collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == want
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    some = tokenio.read_token_files(manifest, wanted=[4, 8]).collect()
    assert {r.doc_id for r in some} == {4, 8} and {(r.doc_id, r.start) for r in some} <= {(r.doc_id, r.start) for r in rows}
    assert tokenio.read_token_files(tokenio.write_token_files(no_docs, scratch(spark, "ids"))).collect() == []


def test_hot_keys_are_dealt_into_files(spark):
    """A null key and another hold a third of the rows each: files are alike in size, keys ascend over them."""
    rng = random.Random(23)
    rows = [((None, 500, rng.randrange(1000))[k % 3], f"text {k} of {rng.randrange(10**6)}") for k in range(3000)]
    manifest = tokenio.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark, "ids"), file_docs=100)
    assert manifest.count() > 25 and max(r.n_docs for r in manifest.collect()) < 250
    found = sorted(tokenio.read_token_files(manifest).collect(), key=lambda r: r.start)
    lib = tok.encoder("word_bpe_49k.json", False)
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == Counter((k, lib.raw(t) + b"\1\0\0\0") for k, t in rows)
    assert [r.doc_id or -1 for r in found] == sorted(-1 if k is None else k or -1 for k, _ in rows)
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found[:-1]]]).tolist()


def test_numbers_of_files():
    rng = random.Random(24)
    for ends in ([], [5], [1, 2, 2, 2, 7, 7, 9]):
        numbers = tokenio.Numbers(ends, 2)
        rows = sorted([(k, rng.getrandbits(64) - (1 << 63)) for k in range(11) for _ in range(200)])
        at = [numbers.of(None, -1 << 63), numbers.of(None, (1 << 63) - 1), *(numbers.of(*r) for r in rows)]
        assert at == sorted(at) and set(at) <= set(range(numbers.files)) and at[:2] == [0, 1]
    assert {numbers.of(2, d) for k, d in rows if k == 2} == {4, 5, 6} and numbers.of(1, 0) == 2 and numbers.of(3, 0) == 7


def test_token_files_are_plain_zstandard_and_checked(spark, odd_docs):
    import io

    import zstandard

    folder = scratch(spark, "ids")
    manifest = tokenio.write_token_files(odd_docs.filter("doc_id in (1, 3)"), folder)
    path = manifest.first().path.removeprefix("file://")
    data = open(path, "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert len(plain) == 4 * manifest.first().n_ids
    broken = bytearray(data)
    broken[12] ^= 255
    open(path, "wb").write(broken)
    with pytest.raises(Exception, match="."):
        tokenio.read_token_files(manifest).collect()
    with pytest.raises(ValueError, match="not a token-id file"):
        import pyarrow as pa

        tokenio.seek_table(pa.BufferReader(bytes(100)))


def test_registered_queries_against_the_library(spark, sf_dir):
    """op8 and op10 over a whole table, as registered, against the libraries text by text."""
    import public_tokenizers
    import sentencepiece
    import tokenizers

    docs = sorted((r.doc_id, r.text or "") for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    lib, pieces = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want, start = [], 0
    for k, t in docs:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op8_token_files(spark, sf_dir).collect()) == want
    counts = [(k, len(t.encode()), n, n > 4096) for k, t in docs for n in [len(pieces.encode(t))]]
    assert sorted(tuple(r) for r in queries.op10_token_counts(spark, sf_dir).collect()) == counts


def test_token_files_refuse_other_keys(spark, tmp_path):
    with pytest.raises(TypeError):
        tokenio.write_token_files(spark.createDataFrame([("a", "x")], "doc_id string, text string"), str(tmp_path))
