"""Archives of every root kind, built on disk and opened."""

import hashlib

import pytest

from stowage.functions import codec
from stowage.functions.hashing import name_hash_py
from stowage.plans import catalog
from stowage.sources import formats, text, trie

FILES = {"dir/first.bin": b"first" * 90, "dir/sub/second.txt": b"second" * 500, "third.dat": bytes(range(256)) * 30}
ZERO = "0" * 32


class Builder:
    """An installation: what is stored goes to one data file and its index, or to an archive and that one's index."""

    def __init__(self, top):
        self.top, self.data = top, top / "Data"
        self.blocks, self.index, self.keys, self.config = b"", [], {}, {}
        self.indexed = []

    def store(self, body, archive=False):
        blob = codec.encode([body[:40], body[40:]], "NZ")
        ckey, ekey = hashlib.md5(body).digest(), hashlib.md5(blob[: int.from_bytes(blob[4:8], "big")]).digest()
        (self.indexed if archive else self.index).append((ekey, len(self.blocks), len(blob) + 30))
        self.blocks += bytes(30) + blob
        self.keys[ckey] = ekey
        return ckey, ekey

    def field(self, name, pair):
        self.config[name] = [pair[0].hex(), pair[1].hex()]

    def finish(self, archives=None):
        table = formats.write_encoding([(c, [e], 1) for c, e in self.keys.items()])
        self.field("encoding", self.store(table))
        build, cdn = "ab" + "1" * 30, "cd" + "2" * 30
        for folder in ("data", "config/ab/11", "config/cd/22", "indices"):
            (self.data / folder).mkdir(parents=True, exist_ok=True)
        (self.data / "data/data.000").write_bytes(self.blocks)
        (self.data / "data/0000000001.idx").write_bytes(formats.write_local_index([(e[:9], 0, o, n) for e, o, n in self.index]))
        (self.data / f"config/ab/11/{build}").write_text(text.config_text(self.config))
        (self.data / f"config/cd/22/{cdn}").write_text(text.config_text({"archives": ["aa11", "bb22"], "file-index": ["ee55", "10"]}))
        if self.indexed:
            (self.data / "indices/aa11.index").write_bytes(formats.write_archive_index([(e, n, o) for e, o, n in sorted(self.indexed)], offset_bytes=4))
            (self.data / "indices/bb22.index").write_bytes(b"malformed")
        (self.top / ".build.info").write_text(f"Product!STRING:0|BuildKey!HEX:16|CDNKey!HEX:16|CDNHosts!STRING:0|CDNPath!STRING:0\nwow|{build}|{cdn}|one.test two.test|tpr/x\n")
        return f"file://{self.top}"


def opened(spark, top, **options):
    return {r.path: bytes(r.data) for r in catalog.open_archive(spark, top, **options).contents().collect() if r.error is None}


@pytest.mark.parametrize("kind", ["install", "trie", "vfs_only", "vfs_beside_a_stub", "install_beside_a_stub"])
def test_roots(spark, tmp_path, kind):
    b = Builder(tmp_path)
    pairs = {p: b.store(d) for p, d in FILES.items()}
    want = FILES
    manifest = formats.write_install([("all", 1, b"\xff")], [(p, c, len(FILES[p])) for p, (c, _) in pairs.items()])
    if kind == "install":
        b.field("root", b.store(manifest))
    elif kind == "trie":
        b.field("root", b.store(trie.write_trie_root(["pack.Data"], {p: [("pack.Data", c)] for p, (c, _) in pairs.items()}, list(pairs))))
        want = {f"pack.Data/{p}": d for p, d in FILES.items()}
    elif kind.startswith("vfs"):
        inner = b.store(formats.write_vfs({p: (e, 1) for p, (_, e) in pairs.items()}))
        deeper = b.store(formats.write_vfs({"again": (inner[1], 1), "copy.bin": (pairs["third.dat"][1], 2)}))
        b.field("vfs-root", b.store(formats.write_vfs({"lower": (deeper[1], 1), "top.dat": (pairs["third.dat"][1], 1)})))
        b.field("vfs-1", inner)
        b.field("vfs-2", deeper)
        b.config["root"] = [ZERO]
        want = {f"lower/again/{p}": d for p, d in FILES.items()} | {"lower/copy.bin": FILES["third.dat"], "top.dat": FILES["third.dat"]}
    if kind.endswith("stub"):
        b.field("root", b.store(b"\x01a legacy stub"))
        if kind.startswith("install"):
            b.field("install", b.store(manifest))
    assert opened(spark, b.finish()) == want


def test_unknown_root_is_an_error(spark, tmp_path):
    b = Builder(tmp_path)
    b.field("root", b.store(b"\x01nothing that is known"))
    with pytest.raises(catalog.OpenError, match="kind empty"):
        catalog.open_archive(spark, b.finish())


def test_a_manifest_within_itself_ends(spark, tmp_path):
    """The root names a manifest whose key is its own prefix again: followed once."""
    b = Builder(tmp_path)
    pair = b.store(FILES["third.dat"])
    lower = b.store(formats.write_vfs({"x": (pair[1], 1)}))
    b.field("vfs-root", root := b.store(formats.write_vfs({"a": (lower[1], 1), "b": (pair[1], 1)})))
    b.field("vfs-1", lower)
    b.config["vfs-2"] = [root[0].hex(), root[1].hex()]
    assert set(opened(spark, b.finish())) == {"a/x", "b"}


def test_archive_indices_and_mirrors(spark, tmp_path):
    """What only an archive's index has is found; what is gone or broken locally comes from a mirror, a build's
    configuration too."""
    b = Builder(tmp_path / "here")
    pairs = {p: b.store(d, archive=p == "third.dat") for p, d in FILES.items()}
    lost = codec.encode([b"only far away"], "Z")
    ekey = hashlib.md5(lost[: int.from_bytes(lost[4:8], "big")]).digest()
    ckey = hashlib.md5(b"only far away").digest()
    b.keys[ckey] = ekey
    b.field("root", b.store("".join(f"{p}|{c.hex()}\n" for p, (c, _) in {**pairs, "far.txt": (ckey, ekey)}.items()).encode()))
    (tmp_path / "here").mkdir()
    top = b.finish()
    assert opened(spark, top) == FILES
    mirror = tmp_path / "mirror"
    (mirror / f"data/{ekey.hex()[:2]}/{ekey.hex()[2:4]}").mkdir(parents=True)
    (mirror / f"data/{ekey.hex()[:2]}/{ekey.hex()[2:4]}/{ekey.hex()}").write_bytes(lost)
    moved = tmp_path / "here/Data/config/ab/11"
    (mirror / "config/ab").mkdir(parents=True)
    moved.rename(mirror / "config/ab/11")
    with pytest.raises(catalog.OpenError):
        catalog.open_archive(spark, top)
    assert opened(spark, top, mirrors=[f"file://{mirror}"]) == FILES | {"far.txt": b"only far away"}


def test_numbered_names_of_a_table_of_contents(spark, tmp_path):
    b = Builder(tmp_path)
    toc = formats.write_contents({3: [(77, "Sword")], 5: [(78, " ")]})
    files = {"base/coretoc.dat": b.store(toc), "base/meta/77": b.store(b"blade" * 30), "base/child/78-2": b.store(b"part" * 30), "base/meta/99": b.store(b"other" * 30)}
    b.field("vfs-root", b.store(formats.write_vfs({p: (e, 1) for p, (_, e) in files.items()})))
    groups = spark.createDataFrame([(3, "Items", ".itm")], "grp int, group_name string, ext string")
    archive = catalog.open_archive(spark, b.finish(), groups=groups)
    got = {r.path: bytes(r.data) for r in archive.contents().collect()}
    assert set(got) == {"base/coretoc.dat", "base/meta/Items/Sword.itm", "base/child/Unknown/78-2", "base/meta/99"} and got["base/meta/Items/Sword.itm"] == b"blade" * 30
    assert {name_hash_py("base/meta/77"), name_hash_py("base/meta/Items/Sword.itm")} <= {r.name_hash for r in archive.entries.collect()}


def test_static_container(spark, tmp_path):
    """Keys that hold chunk, archive and offset; frames at offsets of a file, and a loose one."""
    place = tmp_path / "Data"
    (place / "001").mkdir(parents=True)
    whole, keys = b"", {}

    def key(layout, chunk, archive, offset, salt):
        bits = layout << 54 | chunk << 48 | archive << 38 | (offset << 8 if layout == 0 else 0)
        return salt * 8 + bytes([0]) + bits.to_bytes(7, "big")

    def put(body, salt):
        nonlocal whole
        blob = codec.encode([body], "Z")
        at = key(0, 1, 2, len(whole), salt)
        whole += blob
        return at

    keys["a/one"] = put(b"one" * 200, b"a")
    keys["a/two"] = put(b"two" * 300, b"b")
    keys["loose"] = key(1, 1, 7, 0, b"c")
    (place / "001/7-child.dat").write_bytes(codec.encode([b"loose" * 10], "Z"))
    root = put(formats.write_vfs({p: (k, 1) for p, k in keys.items()}, key=16), b"r")
    (place / "001/0x0002-meta.dat").write_bytes(whole)
    config = {"key-layout-index-bits": ["2"], "key-layout-0": ["6", "10", "30", "0"], "key-layout-1": ["6", "10", "0", "0"], "vfs-root": [ZERO, root.hex()]}
    (place / ".build.config").write_text(text.config_text(config))
    (tmp_path / ".build.info").write_text("not even a table")
    archive = catalog.open_archive(spark, f"file://{tmp_path}")
    assert archive.encoding is None and {r.path: bytes(r.data) for r in archive.contents().collect() if r.error is None} == {"a/one": b"one" * 200, "a/two": b"two" * 300, "loose": b"loose" * 10}


def test_inspect_and_places(spark, tmp_path):
    b = Builder(tmp_path)
    pairs = {p: b.store(d) for p, d in {"x/a.bin": b"MD20 is cut short" * 9, "x/b.txt": b"plain text" * 9}.items()}
    b.field("root", b.store(formats.write_install([("all", 1, b"\xff")], [(p, c, 9) for p, (c, _) in pairs.items()])))
    archive = catalog.open_archive(spark, b.finish())
    assert (archive.hosts, archive.remote_path, archive.file_index) == (["one.test", "two.test"], "tpr/x", "ee55")
    seen = [archive.inspect(p).first() for p in ("x/a.bin", "x/b.txt", "no")]
    assert [(r.kind, r.error is None) for r in seen] == [("creature", False), ("unknown", True), (None, False)]
