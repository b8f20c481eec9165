import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.functions import codec, preview
from stowage.functions import columns as C
from stowage.functions.hashing import name_hash, name_hash_py, name_hashes, salsa20
from stowage.sources import formats
from stowage.sources.blocks import check_layouts, static_location

M = 0xFFFFFFFF


def rot(x, k):
    return (x << k | x >> (32 - k)) & M


def slow_hash(s):
    """The published lookup3, a word at a time."""
    d = s.replace("/", "\\").encode().upper()
    a = b = c = (0xDEADBEEF + len(d)) & M
    if not d:
        return c << 32 | b
    d += b"\0" * (-len(d) % 12)
    w = struct.unpack(f"<{len(d) // 4}I", d)
    for k in range(0, len(w) - 3, 3):
        a, b, c = (a + w[k]) & M, (b + w[k + 1]) & M, (c + w[k + 2]) & M
        a = (a - c) & M ^ rot(c, 4); c = (c + b) & M  # noqa: E702
        b = (b - a) & M ^ rot(a, 6); a = (a + c) & M  # noqa: E702
        c = (c - b) & M ^ rot(b, 8); b = (b + a) & M  # noqa: E702
        a = (a - c) & M ^ rot(c, 16); c = (c + b) & M  # noqa: E702
        b = (b - a) & M ^ rot(a, 19); a = (a + c) & M  # noqa: E702
        c = (c - b) & M ^ rot(b, 4); b = (b + a) & M  # noqa: E702
    a, b, c = (a + w[-3]) & M, (b + w[-2]) & M, (c + w[-1]) & M
    c = ((c ^ b) - rot(b, 14)) & M
    a = ((a ^ c) - rot(c, 11)) & M
    b = ((b ^ a) - rot(a, 25)) & M
    c = ((c ^ b) - rot(b, 16)) & M
    a = ((a ^ c) - rot(c, 4)) & M
    b = ((b ^ a) - rot(a, 14)) & M
    c = ((c ^ b) - rot(b, 24)) & M
    return c << 32 | b


def test_name_hashes(spark):
    rng = random.Random(1)
    names = ["", "a", "abcdefghijkl", "abcdefghijklm", "Interface/Icons/INV_Sword_04.blp"] + ["".join(rng.choice("aZ/\\é_9") for _ in range(rng.randrange(80))) for _ in range(300)]
    assert name_hashes([n.encode() for n in names]).tolist() == [slow_hash(n) for n in names]
    assert name_hash_py("a/B.c") == name_hash_py("A\\b.C")
    got = spark.createDataFrame([(n,) for n in [*names, None]], "p string").select("p", name_hash(F.col("p")).alias("h")).collect()
    assert [None if r.h is None else r.h % 2**64 for r in got] == [*[slow_hash(n) for n in names], None]


def test_published_key_streams():
    assert salsa20(bytes([0x80]) + bytes(31), bytes(8), bytes(16)).hex() == "e3be8fdd8beca2e3ea8ef9475b29a6e7"
    assert salsa20(bytes([0x80]) + bytes(15), bytes(8), bytes(16)).hex() == "4dfa5e481da23ea09a31022050859936"
    data = random.Random(1).randbytes(1000)
    assert salsa20(bytes(16), bytes(8), salsa20(bytes(16), bytes(8), data)) == data and salsa20(bytes(16), bytes(8), b"") == b""
    with pytest.raises(ValueError):
        salsa20(bytes(5), bytes(8), b"")


def test_fdid_hash(spark):
    def slow(n):
        h = 0xCBF29CE484222325
        for b in n.to_bytes(4, "little"):
            h = (b ^ h) * 0x1000001B3 % 2**64
        return h

    ids = [0, 1, 255, 256, 53183, 2**31, 2**32 - 1]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select(C.fdid_hash(F.col("i")).alias("h")).collect()
    assert [r.h % 2**64 for r in got] == [slow(i) for i in ids] == formats.fdid_hashes(np.array(ids)).tolist()


def test_bits(spark):
    one = spark.range(1)
    s = formats.signed
    cases = [(0xF000000000000000, 60, 4, 0xF), (0xFF, 0, 8, 0xFF), (0xDEADBEEFCAFEBABE, 16, 16, 0xCAFE), (0x123456789ABCDEF0, 0, 0, 0), (2**64 - 1, 0, 64, -1)]
    assert [one.select(C.bits(F.lit(s(v % 2**64)).cast("bigint"), a, n)).first()[0] for v, a, n, _ in cases] == [w for *_, w in cases]
    be = [one.select(C.be_uint(F.lit(bytearray(b"\xff" * 8)), 1, w)).first()[0] for w in (0, 1, 2, 4, 8)]
    assert be == [0, 255, 65535, 2**32 - 1, -1]
    assert one.select(C.le_uint(F.lit(bytearray(b"\1\2\3\4")), 1, 4)).first()[0] == 0x04030201


def test_static_location(spark):
    with pytest.raises(ValueError):
        check_layouts([(0, 30, 20, 10, 0)], 2)
    with pytest.raises(ValueError):
        check_layouts([(4, 1, 1, 1, 0)], 2)
    key = bytes(8) + (1 << 54 | 5 << 44 | 77 << 30 | 9).to_bytes(8, "big")
    got = spark.createDataFrame([(bytearray(key),)], "k binary").select(static_location(F.col("k"), [(1, 10, 14, 30, 4096)], 2).alias("w")).first().w
    assert (got.layout, got.chunk, got.archive, got.byte_offset) == (1, 5, 77, 9 * 4096)
    assert spark.createDataFrame([(bytearray(bytes(16)),)], "k binary").select(static_location(F.col("k"), [(1, 10, 14, 30, 0)], 2).alias("w")).first().w is None


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(C.key_from_hex(F.lit("aB" * 16))) == bytes([0xAB] * 16) and get(C.key_from_hex(F.lit("ab"))) is None and get(C.key_from_hex(F.lit("zz" * 16))) is None
    assert get(C.hash_hex(F.lit(-1).cast("bigint"))) == "F" * 16
    assert [get(C.size_text(F.lit(n))) for n in (5, 1280, 3 << 20)] == ["5 B", "1.2 KiB", "3.00 MiB"]
    assert get(C.sf_references(F.lit("SF_1 + SF_22*SF_1 - SF_"))) == ["SF_1", "SF_22", "SF_"]
    c, t = C.coefficient(F.lit("0.5 + 1.25 * Table(34, 2)"))
    assert (get(c), get(t)) == (1.25, 34)
    assert [get(C.sf_display(F.lit(x))) for x in ("", "0.25", "12", "0", "a+b")] == ["(empty)", "0.25  (25.0%)", "12", "0", "a+b"]
    assert get(C.package_locale(F.lit("x/frFR.SC2Assets/y"))) == 16 and get(C.package_locale(F.lit("base.stormdata"))) == C.LOCALE_ALL
    assert get(C.parse_locale(F.lit("frFR,deDE"))) == 48 and get(C.parse_locale(F.lit(""))) == C.LOCALE_ALL
    assert get(C.group_file(F.lit("a/B.WMO"), F.lit(7))) == "a/B_007.wmo"
    assert get(C.name_candidates(F.lit("data:x/y.dds"))) == ["data:x/y.dds", "x/y.dds", "y.dds"]
    assert get(C.hex_dump(F.lit(bytearray(range(18))))) == ["00000000  " + " ".join(f"{k:02X}" for k in range(16)), "00000010  10 11"]
    assert get(C.hex_dump(F.lit(bytearray()))) == []
    assert get(C.remote_path(F.lit(bytearray(b"\xab\xcd\xef")))) == "ab/cd/abcdef"
    assert get(C.is_zero_key(F.lit(bytearray(16)))) and not get(C.is_zero_key(F.lit(bytearray([0, 1]))))
    assert [get(C.formula_class(F.lit(x))) for x in ("a*Table(35,1)", "Attacks_Per_Second", "Affix static value", "Min(1)", "SF_1", "x")] == ["cooldown_scalar", "attack_speed", "unique_item_affix", "aoe_scaling", "sf_expression", "expression"]


KEYS = {0x1122334455667788: bytes(range(16))}


@pytest.mark.parametrize("modes", ["N", "Z", "E", "NZE"])
def test_codec_round_trip(modes):
    parts = [b"first" * 100, b"", bytes(2000)]
    blob = codec.encode(parts, modes, KEYS)
    import hashlib

    ekey = hashlib.md5(blob[: int.from_bytes(blob[4:8], "big")]).digest()
    assert codec.decode(blob, ekey, KEYS) == b"".join(parts)
    with pytest.raises(codec.CodecError) as e:
        codec.decode(blob, bytes(16), KEYS)
    assert e.value.code == "hash_mismatch"
    if "E" in modes:
        with pytest.raises(codec.CodecError) as e:
            codec.decode(blob)
        assert e.value.code == "missing_key"


def test_codec_hostile_input():
    good = codec.encode([b"abc" * 1000], "Z")
    for bad in (b"", b"BLT", b"XXXX" + good[4:], good[:-1], good[:20], b"BLTE\0\0\0\0X", b"BLTE\0\0\0\0", good[:8] + b"\0" + good[9:], b"BLTE\0\0\0\0F1"):
        with pytest.raises(codec.CodecError):
            codec.decode(bad)
    assert codec.decode(b"BLTE\0\0\0\0Nplain") == b"plain"
    with pytest.raises(codec.CodecError) as e:
        codec.decode(b"BLTE\0\0\0\0Z" + zlib.compress(bytes(10_000)), most=100)
    assert e.value.code == "too_large"
    rng = random.Random(1)
    for _ in range(500):
        broken = bytearray(good)
        for _ in range(rng.randrange(1, 5)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        try:
            codec.decode(bytes(broken))
        except codec.CodecError:
            pass
    assert codec.sniff_decode(zlib.compress(b"x")) == b"x"
    with pytest.raises(codec.CodecError):
        codec.sniff_decode(b"junk")


def test_codec_columns_isolate_errors(spark):
    rows = [(1, bytearray(codec.encode([b"hi"]))), (2, bytearray(b"junk")), (3, None)]
    got = codec.decoded(spark.createDataFrame(rows, "id int, blob binary")).collect()
    assert [(r.id, r.data, r.error) for r in got] == [(1, b"hi", None), (2, None, "bad_frame"), (3, None, "bad_frame")]


def test_text_preview():
    assert preview.text(b"x", "foo.txt") == "x" and preview.text(b'{"a": 1}', "unknown.bin") == '{"a": 1}'
    assert preview.text(bytes(range(256)) * 8) is None and preview.text(b"") is None
    assert preview.text("﻿a\r\nb\r\nc\0\0".encode(), "a.txt") == "a\nb\nc"
    assert "truncated" in preview.text(b"x" * (65536 + 1024), "a.txt")


def test_headers():
    head = b"MOVI" + struct.pack("<IHHIIIQQ", 3, 1, 2, 640, 480, 1, 7, 8) + bytes(128)
    got = preview.movie(head)
    assert (got["width"], got["height"], got["version"], got["flags"]) == (640, 480, 3, 2) and preview.movie(b"MOVI") is None and preview.movie(bytes(200)) is None
    wav = b"RIFF" + struct.pack("<I", 40) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176400, 4, 16) + b"data" + struct.pack("<I", 176400) + bytes(176400)
    assert preview.audio(wav) | {"seconds": 1.0} == {"codec": "WAV / PCM", "rate": 44100, "channels": 2, "bits": 16, "kbps": None, "seconds": 1.0}
    assert preview.mp3(b"\xff\xfb\x90\x00" + bytes(50))["kbps"] == 128
    ogg = b"OggS" + bytes(22) + b"\1" + b"\x1e" + b"\x01vorbis" + struct.pack("<IBIiii", 0, 2, 48000, 0, 160000, 0) + bytes(20)
    assert preview.ogg(ogg) == {"codec": "OGG Vorbis", "rate": 48000, "channels": 2, "bits": None, "kbps": 160, "seconds": None}


def blp(kind, alpha, form, width, height, body, palette=None):
    head = b"BLP2" + struct.pack("<IBBBBii", 1, kind, alpha, form, 0, width, height)
    at = len(head) + 128 + (1024 if palette is not None else 0)
    return head + struct.pack("<16I", at, *[0] * 15) + struct.pack("<16I", len(body), *[0] * 15) + (palette or b"") + body


def test_textures():
    palette = b"".join(bytes([k, 255 - k, 7, 0]) for k in range(256))
    pixels, w, h = preview.blp(blp(1, 0, 8, 2, 1, bytes([0, 255]), palette))
    assert (w, h, pixels) == (2, 1, bytes([7, 255, 0, 255, 7, 0, 255, 255]))
    assert preview.blp(blp(1, 1, 8, 2, 1, bytes([0, 0, 0b10]), palette))[0][3::4] == b"\0\xff"
    assert preview.blp(blp(1, 4, 8, 2, 1, bytes([0, 0, 0xA5]), palette))[0][3::4] == b"\x50\xa0"
    assert preview.blp(blp(1, 8, 8, 2, 1, bytes([0, 0, 9, 8]), palette))[0][3::4] == b"\x09\x08"
    assert preview.blp(blp(3, 8, 8, 1, 1, bytes([1, 2, 3, 4])))[0] == bytes([3, 2, 1, 4])
    red = struct.pack("<HHI", 0xF800, 0x001F, 0)
    pixels, w, h = preview.blp(blp(2, 0, 0, 4, 4, red))
    assert (w, h) == (4, 4) and pixels == bytes([255, 0, 0, 255]) * 16
    assert preview.blp(blp(2, 0, 0, 2, 2, red))[0] == bytes([255, 0, 0, 255]) * 4
    assert preview.blp(blp(2, 8, 7, 4, 4, bytes([128, 0]) + bytes(6) + red))[0][3::4] == bytes([128]) * 16
    assert preview.blp(blp(2, 8, 1, 4, 4, b"\xff" * 8 + red))[0][3::4] == b"\xff" * 16
    assert preview.blp(blp(2, 0, 0, 4, 4, red), 9)[1] == 4


def test_hostile_textures():
    good = blp(2, 0, 0, 4, 4, bytes(8))
    offsets = 20
    bad = [b"", b"BL", b"BLP9" + good[4:], good[:30], good[:4] + b"\2" + good[5:], good[:8] + b"\x09" + good[9:]]
    bad.append(good[:offsets] + struct.pack("<I", 2**32 - 8) + good[offsets + 4 :])
    bad.append(good[:offsets] + bytes(64) + good[offsets + 64 :])
    bad.append(good[: offsets + 64] + struct.pack("<I", 2**32 - 1) + good[offsets + 68 :])
    bad.append(good[:12] + struct.pack("<ii", 2**30, 2**30) + good[20:])
    bad.append(blp(1, 8, 8, 2, 2, bytes(4), bytes(1024)))
    for data in bad:
        with pytest.raises(formats.Malformed):
            preview.blp(data)
    assert preview.blp(blp(2, 0, 0, 8, 4, bytes(8) + b"\1"))[0][4 * 4 : 8 * 4] == bytes(16)  # a partial block stays zero


def test_pcx_and_png():
    head = bytearray(128)
    head[0], head[2], head[3], head[65] = 10, 1, 8, 1
    struct.pack_into("<4H", head, 4, 0, 0, 2, 1)
    struct.pack_into("<H", head, 66, 4)
    data = bytes(head) + b"\xc4\x05" + b"\x01\x02\x03\x00"
    pixels, w, h = preview.pcx(data)
    assert (w, h) == (3, 2) and pixels[:4] == bytes([5, 5, 5, 255]) and pixels[-4:] == bytes([3, 3, 3, 255])
    with pytest.raises(formats.Malformed):
        preview.pcx(data[:-1])
    png = preview.png(pixels, w, h)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(png[41 : 41 + struct.unpack(">I", png[33:37])[0]])[1:5] == pixels[:4]
    assert preview.palette_file(b"JASC-PAL\n0100\n2\n1 2 3\n4 5 6\n")[:6] == bytes([1, 2, 3, 4, 5, 6])
    assert len(preview.palette_file(bytes(1024))) == 768 and preview.palette_file(b"x") is None


def power(defs, formulas):
    a, b = b"\0".join(defs) + b"\0", b"\0".join(formulas) + b"\0"
    head = bytearray(0xA0)
    struct.pack_into("<I", head, 0, 0xDEADBEEF)
    struct.pack_into("<I", head, 16, 4242)
    struct.pack_into("<8I", head, 0x80, 0xA0, len(a), 0xA0 + len(a), len(b), 0, 0, 0, 0)
    return bytes(head) + a + b


def test_power_search():
    data = power([b"SF_0", b"SF_1"], [b"SF_0 * Table(34,1)", b"Table(35,2)", b"1+1"])
    got = list(preview.search_power(data))
    assert [m[0] for m in got] == ["power/4242", "sf_def/SF_0", "sf_def/SF_1", "formula/SF_0 * Table(34,1)", "formula/Table(35,2)", "formula/1+1"]
    assert [m[2] for m in got][3:] == ["damage formula", "cooldown formula", "formula"]
    assert [m[0] for m in preview.search_power(data, "sf_1")] == ["sf_def/SF_1"]
    for bad in (b"", bytes(200)):
        with pytest.raises(formats.Malformed):
            list(preview.search_power(bad))
    assert preview.preview("a.pow", bytes(300))[2] and preview.preview("x.txt", b"hi") == ("text", "hi", None)
    tail = b"abcdSF_1 * 2\0\0\0\0" + struct.pack("<If", 6, 0.5) + struct.pack("<II", 5, 8)
    assert [v for _, _, v in preview.formulas(tail)][0][:1] in ([], ["0.500000"])


def test_half_and_obj():
    assert preview.half(struct.pack("<2e", 1.5, -2.0)).tolist() == [1.5, -2.0]
    assert preview.normalised(b"\x7f\x81", "i1").tolist() == [1.0, -1.0]
    mesh = preview.obj(np.eye(3), np.array([[0, 0.25]] * 3), np.array([[0, 1, 2]]))
    assert "f 1/1 2/2 3/3" in mesh and "vt 0.000000 0.750000" in mesh
    assert preview.sides(4096 * 4) == [(128, 128)] and preview.sides(8192) == [(128, 64), (64, 128)]
