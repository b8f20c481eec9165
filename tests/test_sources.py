import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stowage.functions import codec
from stowage.functions.hashing import name_hash_py
from stowage.plans import catalog
from stowage.sinks import export as K
from stowage.sources import binary, blocks, formats, text

key16, key9 = st.binary(min_size=16, max_size=16).filter(any), st.binary(min_size=9, max_size=9)


def numbered(spark, body):
    return text.split_lines(spark.createDataFrame([(body,)], "text string"))


def test_listfile(spark):
    body = "12;a/b.txt\n\n# no\nc.txt\nabc;d.txt\n 7 ;x\nA\\B.TXT\n12;again.txt\r\n99999999999;e"
    got = [(r.file_data_id, r.path) for r in text.listfile(numbered(spark, body)).orderBy("line_no").collect()]
    assert got == [(12, "a/b.txt"), (None, "c.txt"), (None, "abc;d.txt"), (None, "7 ;x"), (None, "A\\B.TXT"), (12, "again.txt"), (None, "99999999999;e")]
    names = {r.path for r in text.listfile_names(text.listfile(numbered(spark, body))).collect()}
    assert "A\\B.TXT" in names and "a/b.txt" not in names  # the same hash, the last line wins


def test_config(spark):
    body = "# c\n\na = 1 2\nb=\nroot = x\na = 3\nkey-layout-1 = 10 14 30 4096\nkey-layout-0 = 1 2 3\nkey-layout-2 = 1\nvfs-1 = q w\nvfs-root = z\n"
    table = text.config(numbered(spark, body))
    got = {r.key: r["values"] for r in table.collect()}
    assert got["a"] == ["3"] and got["b"] == [] and text.config_first(table, "root") == "x" and text.config_first(table, "b") is None
    assert [tuple(r) for r in text.key_layouts(table).collect()] == [(0, 1, 2, 3, 0), (1, 10, 14, 30, 4096)]
    assert [r.key for r in text.vfs_fields(table).collect()] == ["vfs-1"]
    with pytest.raises(text.BadConfig):
        text.config(numbered(spark, "novalue"))
    assert text.config(numbered(spark, "novalue\na = 1"), strict=False).filter("error is not null").count() == 1
    assert catalog.parse_config(text.config_text({"a": ["1", "2"]})) == {"a": ["1", "2"]}


def test_bar_table(spark):
    bar = text.bar_table(spark, "Product!STRING:0|Build Key!HEX:16\nwow| abc \n|def\nshort\n")
    assert bar.columns == ["row_no", "Product", "BuildKey"]
    assert [tuple(r)[1:] for r in bar.orderBy("row_no").collect()] == [("wow", "abc"), ("", "def"), ("short", None)]
    assert text.bar_value(bar, "Product", "wow", "BuildKey") == "abc" and text.bar_value(bar, "Nope", "x", "BuildKey") == "abc" and text.bar_value(bar, "Product", "zz", "BuildKey") is None
    assert text.bar_table(spark, "A!x\tB!y\n1\t2").columns == ["row_no", "A", "B"]
    with pytest.raises(text.BadConfig):
        text.bar_table(spark, "")
    assert catalog.products(text.bar_table(spark, "Product|CDNPath\n|tpr/osi\nwow|x")) == ["osi", "wow"]
    assert catalog.choose_product("wow_beta", ["d3", "wow"]) == "wow" and catalog.choose_product(None, ["d3"]) == "d3" and catalog.game_of("osib") == "DiabloIIResurrected"


def test_text_root_and_keys(spark):
    k = "ab" * 16
    rows = {r.path: (r.locale, bytes(r.ckey)) for r in text.text_root(numbered(spark, f"a.txt|{k}\nb.txt:frFR|{k}\nbad|zz\nnobar\n\nc:xx|{k}")).collect()}
    assert rows == {"a.txt": (0xFFFFFFFF, bytes.fromhex(k)), "b.txt": (16, bytes.fromhex(k)), "c": (0xFFFFFFFF, bytes.fromhex(k))}
    df = spark.createDataFrame([(bytearray(b"a|b\n"),), (bytearray(b"ab"),), (bytearray(b"a|\x01"),)], "b binary")
    assert [r[0] for r in df.select(text.looks_like_text_root(F.col("b"))).collect()] == [True, False, False]
    keys = text.key_file(numbered(spark, "# x\nFFFFFFFFFFFFFFFF " + k + "\n0000000000000001;" + k + "\nFF " + k + "\n0000000000000001 zz")).collect()
    assert sorted(r.key_name for r in keys) == [-1, 1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(key9, st.integers(0, 1023), st.integers(0, 2**30 - 1), st.integers(0, 2**32 - 1))))
def test_local_index_round_trip(records):
    assert list(formats.local_index(formats.write_local_index(records))) == records


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(key16, st.integers(0, 2**32 - 1), st.integers(0, 2**39)), max_size=400), st.sampled_from([0, 5, 8]))
def test_archive_index_round_trip(entries, width):
    want = [(k, s, o if width else 0) for k, s, o in entries]
    data = formats.write_archive_index([(k, s, o if width else 0) for k, s, o in entries], offset_bytes=width)
    assert list(formats.archive_index(data)) == want and formats.archive_footer(data)["count"] == len(entries)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(key16, st.lists(key16, min_size=1, max_size=4), st.integers(0, 2**40 - 1)), max_size=300), st.sampled_from([4, 8]))
def test_encoding_round_trip(entries, page):
    assert [(c, e, s) for _, c, e, s in formats.encoding(formats.write_encoding(entries, page))] == entries


@pytest.mark.parametrize("version", [0, 1, 2])
def test_manifest_root(version):
    a = [(5, b"a" * 16, 11), (9, b"b" * 16, -12), (3, b"c" * 16, 13)]
    b = [(100, b"d" * 16, None), (101, b"e" * 16, None)]
    data = formats.write_manifest_root([(2, 1, a), (16, 0x10000000, b)], version)
    rows = list(formats.manifest_root(data))
    assert [(r[0], r[2], r[4], r[5], r[6]) for r in rows[:3]] == [(11, 5, b"a" * 16, 2, 1), (-12, 9, b"b" * 16, 2, 1), (13, 3, b"c" * 16, 2, 1)]
    assert [r[2] for r in rows[3:]] == [100, 101] and rows[3][0] == formats.signed(int(formats.fdid_hashes(__import__("numpy").array([100]))[0]))
    assert len(list(formats.manifest_root(data[:-3]))) == 3  # a block that is cut off is left out
    with pytest.raises(formats.Malformed):
        list(formats.manifest_root(formats.write_manifest_root([(0, 0, a)], version)))


def test_other_roots():
    entries = [("a/b", b"k" * 16, 7), ("c", b"l" * 16, 8), ("d", b"m" * 16, 9)]
    data = formats.write_install([("win", 1, bytes([0b10100000])), ("mac", 2, bytes([0b01000000]))], entries)
    assert [(n, s, t) for n, _, s, t in formats.install_files(data)] == [("a/b", 7, ["win"]), ("c", 8, ["mac"]), ("d", 9, ["win"])]
    assert [r[0] for r in formats.install_root(data)] == [name_hash_py(n) for n, _, _ in entries]
    groups = {0: [(1, "x"), (2, "")], 3: [(9, "ü")]}
    for newer in (True, False):
        assert [r[1:] for r in formats.contents(formats.write_contents(groups, newer))] == [(0, 1, "x"), (0, 2, ""), (3, 9, "ü")]
    files = {"base/a.txt": (b"1" * 9, 1), "base/sub/b.txt": (b"2" * 9, 3), "top": (b"3" * 9, 1), "base2/c": (b"4" * 9, 1)}
    got = {p: (k[:9], n) for p, k, n, _ in formats.vfs_files(formats.write_vfs(files))}
    assert got == files
    assert [formats.root_kind(d) for d in (b"a|b", b"TSFM" + bytes(30), data, formats.write_vfs(files), bytes(56), b"\x01junk")] == ["text", "manifest", "install", "vfs", "flat", "empty"]


def test_hostile_bytes_are_malformed():
    rng = random.Random(1)
    goods = [
        (formats.local_index, formats.write_local_index([(bytes(range(9)), 1, 2, 3)] * 5)),
        (formats.archive_index, formats.write_archive_index([(bytes(range(1, 17)), 2, 3)] * 5)),
        (formats.encoding, formats.write_encoding([(b"c" * 16, [b"e" * 16], 5)] * 5)),
        (formats.manifest_root, formats.write_manifest_root([(2, 0, [(5, b"a" * 16, 11)] * 4)], 1)),
        (formats.install_root, formats.write_install([("t", 1, b"\xff")], [("n", b"k" * 16, 1)] * 3)),
        (formats.contents, formats.write_contents({0: [(1, "x")], 2: [(5, "yy")]})),
        (formats.vfs_files, formats.write_vfs({"a/b": (b"1" * 9, 1), "c": (b"2" * 9, 2)})),
        (formats.flat_root, bytes(56)),
    ]
    for parse, good in goods:
        list(parse(good))
        for _ in range(300):
            data = bytearray(good[: rng.randrange(len(good) + 1)] if rng.random() < 0.5 else good)
            for _ in range(rng.randrange(4) if data else 0):
                data[rng.randrange(len(data))] = rng.choice([0, 255, rng.randrange(256)])
            try:
                for _ in zip(parse(bytes(data)), range(10_000), strict=False):
                    pass
            except formats.Malformed:
                pass
    footer = formats.FOOTER
    for bad in ((2, 4, 4, 4, 16, 8), (1, 4, 4, 4, 16, 4), (1, 4, 4, 4, 0, 8), (1, 4, 9, 4, 16, 8), (1, 4, 4, 5, 16, 8), (1, 0, 4, 4, 16, 8)):
        version, page, offset, size, key, check = bad
        with pytest.raises(formats.Malformed):
            formats.archive_footer(footer.pack(bytes(16), version, b"\0\0", page, offset, size, key, check, 1, bytes(8)))


def test_parsed_keeps_what_could_be_read(spark):
    good = formats.write_archive_index([(bytes([k % 255 + 1] * 16), k, k) for k in range(300)])
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"junk")), ("c", None)], "file string, blob binary")
    rows = binary.parsed(files, "archive_index").collect()
    assert sum(r.file == "a" and r.error is None for r in rows) == 300 and {r.file for r in rows if r.error} == {"b", "c"}
    audit = binary.index_audit(files).first()
    assert (audit.files, audit.errors, audit.entries, audit.announced, audit.short) == (3, 2, 300, 300, 0)


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    """A whole archive: build table, configuration, data files, local indices, encoding table, root."""
    top = tmp_path_factory.mktemp("install")
    data = top / "DATA"
    contents = {"a/one.txt": b"one" * 100, "a/two.txt": b"two" * 2000, "b/three.bin": bytes(range(256)) * 40, "b/copy.txt": b"one" * 100}
    blocks_, index = b"", []

    def store(body, modes="Z"):
        nonlocal blocks_
        blob = codec.encode([body[:50], body[50:]], modes, {7: bytes(16)})
        ekey = hashlib.md5(blob[: int.from_bytes(blob[4:8], "big")]).digest()
        index.append((ekey[:9], 0, len(blocks_), len(blob) + 30))
        blocks_ += bytes(30) + blob
        return ekey

    ckey = {p: hashlib.md5(b).digest() for p, b in contents.items()}
    ekey = {k: store(contents[p], "E" if p == "b/three.bin" else "Z") for p, k in sorted(ckey.items()) if p != "b/copy.txt"}
    root = "".join(f"{p}|{k.hex()}\n" for p, k in ckey.items()).encode() + b"gone.txt|" + b"0" * 32 + b"\n"
    ckey["root"] = hashlib.md5(root).digest()
    ekey[ckey["root"]] = store(root)
    table = formats.write_encoding([(c, [e], 1) for c, e in ekey.items()])
    ekey_enc = store(table)
    for folder in ("data", "config/bb/bb", "indices"):
        (data / folder).mkdir(parents=True)
    (data / "data/data.000").write_bytes(blocks_)
    (data / "data/0000000001.idx").write_bytes(formats.write_local_index([(b"old" * 3, 0, 0, 0)]))
    (data / "data/0000000002.idx").write_bytes(formats.write_local_index(index[::2]))
    (data / "data/0100000001.idx").write_bytes(formats.write_local_index(index[1::2]))
    build = "bbbb" + "0" * 28
    (data / "config/bb/bb" / build).write_text(text.config_text({"root": [ckey["root"].hex()], "encoding": [hashlib.md5(table).hexdigest(), ekey_enc.hex()]}))
    (top / ".build.info").write_text(f"Product!STRING:0|BuildKey!HEX:16\nwow|{build}\n")
    return top, contents


def test_open_search_read_export(spark, archive, tmp_path):
    top, contents = archive
    keys = spark.createDataFrame([(7, bytearray(16))], "key_name long, key binary")
    opened = catalog.open_archive(spark, f"file://{top}", "wow", keys)
    assert {r.path for r in opened.find("a/*").collect()} == {"a/one.txt", "a/two.txt"}
    assert opened.entries.count() == 5 and opened.find("three").count() == 1
    got = {r.path: (r.data, r.error) for r in opened.contents().collect()}
    assert {p: d for p, (d, e) in got.items() if e is None} == contents and got["gone.txt"][1] == "encoding_not_found"
    out = tmp_path / "out"
    (out / "a").mkdir(parents=True)
    (out / "a/one.txt").write_bytes(b"there")
    report = {r.status: r.files for r in K.outcome(K.export(opened.contents(), f"file://{out}")).collect()}
    assert report == {"ok": 3, "exists": 1, "error": 1}
    assert (out / "a/one.txt").read_bytes() == b"there" and (out / "b/three.bin").read_bytes() == contents["b/three.bin"]
    assert not list(out.rglob("*.part"))
    K.export(opened.contents(), f"file://{out}", overwrite=True).collect()
    assert (out / "a/one.txt").read_bytes() == contents["a/one.txt"]
    flat = {r.target for r in K.export(opened.contents(), f"file://{out}/flat", flat=True).collect()}
    assert {"one.txt", "three.bin"} <= flat and {r.target for r in K.targets(opened.names).collect()} >= {"a/one.txt"}
    without = catalog.open_archive(spark, f"file://{top}")
    assert {r.path: r.error for r in without.contents().collect()}["b/three.bin"] == "missing_key"


def test_probe_and_discover(spark, archive):
    top, _ = archive
    found = {r.folder.rpartition("/")[2]: (r.passed, r.entries) for r in catalog.probe(spark, [f"file://{top}", f"file://{top}/nothing"]).collect()}
    assert found[top.name] == (True, 5) and found["nothing"] == (False, 0)
    assert (top.name, f"file://{top.parent}/{top.name}") in catalog.discover(spark, [f"file://{top.parent}"])
    assert catalog.folder_case(spark, f"file://{top}", "Data") == "DATA" and catalog.folder_case(spark, f"file://{top}", "no") == "no"
    with pytest.raises(Exception, match="."):
        catalog.probe(spark, [f"file://{top}/nothing"], fail_fast=True)


def test_bad_paths_stay_inside(spark, tmp_path):
    rows = [("../x", bytearray(b"1"), None), ("/abs/y", bytearray(b"2"), None), ("a/../../z", bytearray(b"3"), None), ("ok", None, "missing_file"), (None, bytearray(b"4"), None)]
    got = [r.status for r in K.export(spark.createDataFrame(rows, "path string, data binary, error string"), str(tmp_path)).collect()]
    assert got == ["bad_path", "ok", "bad_path", "missing_block", "bad_path"] and (tmp_path / "abs/y").read_bytes() == b"2"


def test_block_errors(spark, tmp_path):
    (tmp_path / "data.000").write_bytes(bytes(30) + b"abc")
    rows = [(1, 0, 0, 0, 33), (2, 0, 0, 0, 99), (3, 0, 5, 0, 33), (4, 9, 0, 0, 33), (5, 0, 0, 0, 3)]
    df = spark.createDataFrame(rows, "id int, storage int, archive int, offset int, size int")
    got = {r.id: (r.blob, r.error) for r in blocks.read_blocks(df, [f"file://{tmp_path}"]).collect()}
    assert got == {1: (b"abc", None), 2: (None, "short_block"), 3: (None, "missing_file"), 4: (None, "unknown_storage"), 5: (None, "short_block")}


def test_static_and_remote(spark, tmp_path):
    blob = codec.encode([b"static"])
    (tmp_path / "005").mkdir()
    (tmp_path / "005/0x004d-payload.dat").write_bytes(bytes(4096) + blob + b"after")
    key = bytes(8) + (1 << 54 | 5 << 44 | 77 << 30 | 1).to_bytes(8, "big")
    where = blocks.static_location(F.col("ekey"), [(1, 10, 14, 30, 4096)], 2)
    df = spark.createDataFrame([(bytearray(key),)], "ekey binary").select("ekey", where.alias("w"))
    df = df.select("ekey", blocks.candidate_files(F.col("w")).alias("files"), "w.byte_offset")
    assert bytes(blocks.read_static(df, f"file://{tmp_path}").first().blob) == blob
    mirror, cache = tmp_path / "mirror", tmp_path / "cache"
    k = bytes(range(16))
    (mirror / k.hex()[:2] / k.hex()[2:4]).mkdir(parents=True)
    (mirror / k.hex()[:2] / k.hex()[2:4] / k.hex()).write_bytes(b"remote")
    wanted = spark.createDataFrame([(bytearray(k),), (bytearray(16),)], "ekey binary")
    for places in ([str(tmp_path / "none"), str(mirror)], []):
        got = {bytes(r.ekey): (r.data, r.error) for r in blocks.remote_blobs(wanted, places, str(cache)).collect()}
        assert got == {k: (b"remote", None), bytes(16): (None, "not_found")}


def test_watched_folder(spark, tmp_path):
    from stowage.streaming.watch import watch_indices

    (tmp_path / "0000000001.idx").write_bytes(formats.write_local_index([(b"a" * 9, 1, 2, 3), (b"a" * 9, 1, 2, 3), (b"b" * 9, 1, 2, 3)]))
    stream = watch_indices(spark, str(tmp_path)).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        stream.processAllAvailable()
        (tmp_path / "0100000001.idx").write_bytes(formats.write_local_index([(b"b" * 9, 9, 9, 9), (b"c" * 9, 1, 2, 3)]))
        stream.processAllAvailable()
        assert sorted(bytes(r.ekey9)[:1] for r in spark.table("seen").collect()) == [b"a", b"b", b"c"]
    finally:
        stream.stop()
