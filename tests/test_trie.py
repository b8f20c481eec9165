import random

import pytest

from stowage.operators import resolve
from stowage.sources import formats, trie


@pytest.mark.parametrize("pool", [True, False])
def test_names_round_trip(pool):
    rng = random.Random(1)
    for n in (0, 1, 5, 700):
        names = {"".join(rng.choice("ab/c.é") for _ in range(rng.randrange(1, 30))) for _ in range(n)}
        data = trie.write_trie(list(names), pool)
        found = list(trie.trie_at(data, 0).names())
        assert {p for _, p in found} == names and sorted(k for k, _ in found) == list(range(len(names)))


def test_root_resolution(spark):
    a, b, c = (bytes([k] * 16) for k in (1, 2, 3))
    packages = ["mods/core.stormmod/base.stormdata", "mods/core.stormmod/frFR.stormdata", "mods"]
    files = {"x/one.txt": [(packages[0], a), (packages[1], b)], "two.txt": [(packages[1], c)]}
    blob = trie.write_trie_root(packages, files, ["x/one.txt", "two.txt"])
    df = spark.createDataFrame([("r", bytearray(blob))], "file string, blob binary")
    rows = {r.path: r for r in trie.trie_entries(df).collect()}
    assert {p: (r.status, bytes(r.ckey), r.locale) for p, r in rows.items()} == {
        f"{packages[0]}/x/one.txt": ("ok", a, 0xFFFFFFFF), f"{packages[1]}/x/one.txt": ("ok", b, 16), f"{packages[1]}/two.txt": ("ok", c, 16)}
    assert [tuple(r) for r in trie.diagnostics(trie.trie_entries(df)).collect()] == [("ok", 3)]
    assert formats.root_kind(blob) == "trie"


def test_roots_are_resolved_by_themselves(spark):
    """Two roots whose numbers of packages, names and chains clash, and a path that both have."""
    a, b, c, d = (bytes([k] * 16) for k in (1, 2, 3, 4))
    own = [
        trie.write_trie_root(["base/en", "frFR.stormdata"], {"one": [("base/en", a)], "two": [("frFR.stormdata", b)]}, ["one", "two"]),
        trie.write_trie_root(["frFR.stormdata"], {"zero": [("frFR.stormdata", c)], "two": [("frFR.stormdata", d)]}, ["two", "zero"]),
        trie.write_trie_root(["base"], {"en/one": [("base", d)]}, ["en/one"]),
    ]
    df = spark.createDataFrame([(f"r{k}", bytearray(x)) for k, x in enumerate(own)], "file string, blob binary")
    found = sorted((r.path, r.status, bytes(r.ckey), r.locale) for r in trie.trie_entries(df, strict=True).collect())
    assert found == [("base/en/one", "ok", a, 0xFFFFFFFF), ("base/en/one", "ok", d, 0xFFFFFFFF), ("frFR.stormdata/two", "ok", b, 16), ("frFR.stormdata/two", "ok", d, 16), ("frFR.stormdata/zero", "ok", c, 16)]


@pytest.mark.parametrize("lengths", [0, 32])
def test_longest_prefix_within_a_file(spark, monkeypatch, lengths):
    monkeypatch.setattr(resolve, "MOST_LENGTHS", lengths)
    packages = spark.createDataFrame([("x", "a", 0), ("x", "a/b", 1), ("y", "a", 7), ("z", "q", 3)], "file string, package string, package_id int")
    paths = spark.createDataFrame([("x", "a/b/c"), ("y", "a/b/c"), ("y", "a/b/c"), ("z", "a/b/c")], "file string, path string")
    found = [tuple(r) for r in resolve.longest_prefix(paths, packages, on=["file"]).sort("file").collect()]
    assert found == [("x", "a/b/c", 1), ("y", "a/b/c", 7), ("y", "a/b/c", 7), ("z", "a/b/c", None)]


def test_hostile_tries_are_malformed():
    good = trie.write_trie_root(["p"], {"n": [("p", bytes(16))]}, ["n"])
    rng = random.Random(2)
    for _ in range(400):
        data = bytearray(good[: rng.randrange(len(good))] if rng.random() < 0.3 else good)
        for _ in range(rng.randrange(1, 4) if data else 0):
            data[rng.randrange(len(data))] = rng.choice([0, 255, rng.randrange(256)])
        try:
            for _ in zip(trie.trie_root(bytes(data)), range(5000), strict=False):
                pass
        except formats.Malformed:
            pass
