import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import pytest

from stowage.llm import media, queries, warc
from stowage.llm.common import scratch

PAGES = "page_id long, url string, html string, sha1 string, key long, first long, refers_to long"


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(3, "http://a/b c\r\nX: y", "<p>one</p>"), (1, None, "<p>one</p>"), (2, "u", None), (5, "u", ""), (4, "é", "ü" * 500_000), (None, "n", "<p>one</p>"), (1, "again", "<p>one</p>"), (9, "u", "alone")]
    return spark.createDataFrame([(*r, "s", 1, 2, 3) for r in rows], PAGES)


def test_round_trip(spark, pages):
    found = warc.read_archives(warc.write_archives(pages, scratch(spark, "warc"))).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in found) == Counter((r.page_id, len((r.html or "").encode()), digest(r.html)) for r in pages.collect())
    of = {(r.page_id, r.record_type, r.refers_to) for r in found}
    assert {(3, "revisit", 1), (1, "response", None), (2, "response", None), (5, "revisit", 2), (4, "response", None), (None, "revisit", 1), (9, "response", None)} == of
    texts = {digest(r.html): (r.html or "").encode() for r in pages.collect()}
    assert all(bytes(r.payload) == texts[r.payload_digest] if r.record_type == "response" else r.payload is None for r in found)


def test_small_payloads_are_all_responses(spark, pages):
    found = warc.read_archives(warc.write_archives(pages, scratch(spark, "warc"), least=1)).collect()
    assert {r.record_type for r in found if r.payload_bytes == 0} == {"response"}


def test_empty_table(spark, pages):
    assert warc.read_archives(warc.write_archives(pages.limit(0), scratch(spark, "warc"))).collect() == []


def test_one_member_per_record_and_damage():
    records = [warc.record(k, f"http://x/{k}", b"abc" * k, 3 * k, digest("abc" * k), None) for k in range(200)]
    data = b"".join(records)
    assert [r["payload"] for r in warc.read_records(io.BytesIO(data))] == [b"abc" * k for k in range(200)]
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 200
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_records(io.BytesIO(data[:-5])))
    plain = gzip.decompress(records[5])
    for old, new, said in ((b"abcabc", b"abdabc", "digest"), (b"Content-Length: 9", b"Content-Length: 7", "."), (b"WARC/1.1", b"XXXX/1.1", "not a record")):
        with pytest.raises(ValueError, match=said):
            list(warc.read_records(io.BytesIO(gzip.compress(plain.replace(old, new, 1) if old in plain else plain[:-3]))))


def test_op1_matches_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    sql = con.execute(queries.ORACLE_SQL["op1_warc"])
    assert Counter(sql.fetchall()) == Counter(tuple(r) for r in queries.op1_warc(spark, sf_dir).collect())


def slow_crc(page):
    crc = 0
    for b in page:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def test_container_round_trips():
    rng = random.Random(2)
    x = rng.randbytes(999)
    assert media.page_crc(x) == slow_crc(x)
    for n in (0, 1, 191, 192, 193, 959, 960, 961, 1920, 48_959, 48_960, 48_961, 300_000):
        for packet in (192, 255, 960, 100_000):
            payload = media.pad(rng.randbytes(n))
            stored = media.encode(payload, packet=packet)
            back, facts = media.decode(stored)
            assert back == payload and facts["streams"] == 2
            assert stored == media.encode(payload, packet=packet)


def test_any_flipped_bit_is_found():
    stored = media.encode(media.pad(b"abc" * 1000))
    rng = random.Random(3)
    for _ in range(300):
        broken = bytearray(stored)
        broken[rng.randrange(len(broken))] ^= 1 << rng.randrange(8)
        with pytest.raises((ValueError, media.struct.error)):
            media.decode(bytes(broken))
    with pytest.raises(ValueError):
        media.decode(stored[:-1])


def test_streams_are_told_apart_in_any_order():
    payload = media.pad(random.Random(4).randbytes(150_000))
    pages = []
    for serial, _, _, _, lacing, body in media.parse(stored := media.encode(payload)):
        size = 27 + len(lacing) + len(body)
        pages.append((serial, stored[:size]))
        stored = stored[size:]
    first = pages[0][0]
    shuffled = b"".join(p for s, p in pages if s != first) + b"".join(p for s, p in pages if s == first)
    assert media.decode(shuffled)[0] == payload


def test_op6_rows(spark, odd_docs, no_docs):
    found = media.read_media(media.store_media(odd_docs)).collect()
    want = Counter((r.doc_id, media.pad((r.text or "").encode())) for r in odd_docs.collect())
    assert Counter((r.doc_id, bytes(r.payload)) for r in found) == want
    assert all(r.error is None and r.feature.startswith("ogg pages=") for r in found)
    assert media.read_media(media.store_media(no_docs)).collect() == []
    bad = spark.createDataFrame([(1, 1, bytearray(b"junk")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert all(r.payload is None and r.error for r in media.read_media(bad).collect())


def test_op6_digests(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op6_media(spark, sf_dir).collect():
        payload = media.pad(texts[r.doc_id])
        stored = media.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), zlib.crc32(payload[-16:]))
        assert (r.payload_sha256, r.media_bytes, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), len(stored), hashlib.sha256(stored).hexdigest())
