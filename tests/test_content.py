import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.functions import preview
from stowage.operators import content
from stowage.sources import formats

from .test_functions import blp, power


def test_content_search(spark):
    data = power([b"SF_0"], [b"Table(34,1)"])
    rows = [("a/B.POW", bytearray(data)), ("bad.pow", bytearray(b"xx")), ("c.txt", bytearray(b"SF_0"))]
    blobs = spark.createDataFrame(rows, "path string, blob binary")
    got = {(r.path, r.inner_path, r.kind) for r in content.content_search(blobs, "sf").collect() if r.error is None}
    assert got == {("a/B.POW", "sf_def/SF_0", "SF definition")}
    assert [r.path for r in content.content_search(blobs).collect() if r.error] == ["bad.pow"]
    assert [r[0] for r in blobs.select(content.searchable(F.col("path"))).collect()] == [True, True, False]
    content.register(r"\.txt$", lambda d, q: iter([("line/1", 0, "text")]))
    try:
        assert {r.path for r in content.content_search(blobs).collect() if r.error is None} == {"a/B.POW", "c.txt"}
    finally:
        content.SEARCHERS.pop()


def chunk(name, body):
    return name[::-1] + struct.pack("<I", len(body)) + body


def test_previews(spark):
    red = struct.pack("<HHI", 0xF800, 0x001F, 0)
    world = chunk(b"MVER", struct.pack("<I", 17)) + chunk(b"MOTX", b"a.blp\0b.blp\0") + chunk(b"MOHD", struct.pack("<9I6f", 2, 3, 0, 0, 0, 0, 1, 0, 0, -1, -2, -3, 1, 2, 3) + b"\0" * 4)
    creature = bytearray(0x70)
    creature[:4] = b"MD20"
    struct.pack_into("<III", creature, 4, 264, 4, 0x60)
    creature[0x60:0x64] = b"wolf"
    struct.pack_into("<I", creature, 0x3C, 99)
    tile = chunk(b"MVER", bytes(4)) + chunk(b"MCNK", struct.pack("<28I", *[0] * 28) + struct.pack("<f", 10.0) + bytes(12) + chunk(b"MCVT", np.arange(145, dtype="<f4").tobytes()))
    rows = {"t.blp": blp(2, 0, 0, 4, 4, red), "w.wmo": world, "c.m2": bytes(creature), "m_1_2.adt": tile, "n.txt": b"hello", "x.bin": bytes(range(256)), "w2.wmo": b"REVM\0\0\0\0"}
    got = {r.path: (r.plugin, r.made, r.error) for r in content.previews(spark.createDataFrame([(k, bytearray(v)) for k, v in rows.items()], "path string, blob binary")).collect()}
    assert got["t.blp"][:2] == ("blp", "4x4") and got["w.wmo"][:2] == ("world model", "3 groups, 2 materials") and got["c.m2"][:2] == ("creature", "wolf: 99 vertices, 0 bones")
    assert got["m_1_2.adt"][:2] == ("terrain", "1 chunks, 256 triangles") and got["n.txt"] == ("text", "hello", None) and got["x.bin"] == (None, None, None) and got["w2.wmo"][2]
    assert preview.terrain(tile) == {"chunks": 1, "vertices": 145, "triangles": 256, "low": 10.0, "high": 154.0}
    w = preview.world_model(world)
    assert (w["version"], w["textures"], w["low"], w["high"]) == (17, 2, [-1, -2, -3], [1, 2, 3])
    png = content.images(spark.createDataFrame([(1, bytearray(rows["t.blp"])), (2, bytearray(b"junk"))], "id int, blob binary")).collect()
    assert [(r.id, r.width, bool(r.png), bool(r.error)) for r in png] == [(1, 4, True, False), (2, None, False, True)]


def container(code, width, height, body):
    head = bytearray(0x2C)
    head[:5] = b"<DE(" + bytes([code])
    struct.pack_into("<II", head, 8, width, height)
    struct.pack_into("<I", head, 0x1C, 1)
    struct.pack_into("<II", head, 0x24, len(body), 4)
    return bytes(head) + body


def test_texture_containers():
    red = struct.pack("<HHI", 0xF800, 0x001F, 0)
    pixels, w, h, form = preview.texture(container(0x39, 4, 4, red))
    assert (w, h, form) == (4, 4, "BC1") and pixels == bytes([255, 0, 0, 255]) * 16
    assert preview.texture(container(0x3A, 4, 4, bytes([200, 0]) + bytes(6)))[0] == bytes([200, 200, 200, 255]) * 16
    flat = preview.channels((bytes([128, 0]) + bytes(6)) * 2, 4, 4, 2)
    assert flat[:2] == bytes([128, 128]) and flat[2] >= 254
    assert preview.texture_header(b"<DE(") is None and preview.texture_header(container(0x39, 0, 4, red)) is None
    with pytest.raises(formats.Malformed):
        preview.texture(b"junk")
    assert preview.bare_texture(bytes(9000), "x.tex") is None


def test_batches_and_files(spark):
    units = F.array(*[F.struct(F.lit(a).alias("layer"), F.lit(b).alias("section"), F.lit(c).alias("combo")) for a, b, c in ((0, 5, 0), (1, 6, 0), (0, 7, 1), (0, 8, 9))])
    got = spark.range(1).select(content.batch_materials(units, F.array(F.lit(2), F.lit(-1)), F.lit(3)).alias("m")).first().m
    assert [(b.section, b.material) for b in got] == [(5, 2), (7, 7), (8, 8)]
    files = content.material_files("m", "v 0 0 0\nf 1 1 1\nf 2 2 2\n", {3: b"png"}, [(3, 0, 1), (4, 1, 1)])
    assert set(files) == {"m.obj", "m.mtl", "m_3.png"} and b"usemtl material_4\nf 2 2 2" in files["m.obj"]
    wanted = spark.createDataFrame([(1, "A.skin"), (2, "no")], "key int, path string")
    blobs = spark.createDataFrame([("a.SKIN", bytearray(b"s"))], "path string, blob binary")
    assert {r.key: r.sibling for r in content.siblings(wanted, blobs, by="path").select("key", "sibling").collect()} == {1: b"s", 2: None}


def test_scaling_factors():
    """Entries by hand: a run of them, what isn't one, three of those in a row, and files cut short."""

    def entry(text, tag=0):
        return (text + b"\0").ljust(len(text) // 4 * 4 + 4, b"\0") + struct.pack("<I8x", tag)

    head = bytearray(0x270)
    struct.pack_into("<I", head, 0x78, 0x260)
    struct.pack_into("<I", head, 0x268, 0x270)
    none = bytes([7]) * 16
    body = entry(b"SF_0 * 2") + entry(b"", 6) + none + entry(b"Table(34,1)", 5) + none * 3 + entry(b"unseen")
    assert list(preview.scaling_factors(bytes(head) + body)) == [(0, "SF_0 * 2"), (1, ""), (3, "Table(34,1)")]
    assert list(preview.scaling_factors(bytes(head) + entry(b"a", 4) + entry(b"bcd"))) == [(1, "bcd")]
    many = list(preview.scaling_factors(bytes(head) + entry(b"abcd") * 90))
    assert len(many) == 80
    for n in (0, 100, 0x268, 0x270, 0x275):
        assert list(preview.scaling_factors((bytes(head) + body)[:n])) == []
    struct.pack_into("<I", head, 0x268, 0x100)
    assert list(preview.scaling_factors(bytes(head) + body)) == []


def test_inspected(spark):
    rows = {"a": blp(2, 0, 0, 4, 4, struct.pack("<HHI", 0xF800, 0x001F, 0)), "b": b"BLP2", "c": b"", "d": b"what", "e": None, "f": b"MD20"}
    got = {r.path: (r.kind, r.summary, r.error is None) for r in content.inspected(spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows.items()], "path string, blob binary")).collect()}
    assert got == {"a": ("blp", "4x4", True), "b": ("blp", None, False), "c": ("empty", None, True), "d": ("unknown", None, True), "e": (None, None, True), "f": ("creature", None, False)}
