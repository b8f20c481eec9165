import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stowage.operators import resolve, search, sets, tree
from stowage.operators.unique import first_wins, last_wins
from stowage.plans import glob as G

PATHS = list(enumerate("world/audio/rain.ogg world/audio/birds.ogg world/music/theme.mid units/Orc_Raider.mdl units/Orc_Shaman.mdl units/Elf_Archer.mdl Textures/Wall_02.dds units/elves/readme".split(), 1))


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(PATHS, "name_hash long, path string").cache()


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(h, 0, bytearray([h] * 16), 2, 0) for h, _ in PATHS if h != 6] + [(1, 1, bytearray([99] * 16), 16, 8), (50, 0, bytearray([50] * 16), 0x10, 0x08000000)]
    return spark.createDataFrame(rows, "name_hash long, entry_ord int, ckey binary, locale long, content long").cache()


def ids(df):
    return sorted(r.name_hash for r in df.collect())


@pytest.mark.parametrize(
    ("query", "want"),
    [("world/audio", [1, 2]), ("*orc*.mdl", [4, 5]), ("units/*.mdl", [4, 5, 6]), ("**/*.dds", [7]), ("Textures/Wall_02.dds", [7]), ("*.none", []), ("/world/*", [1, 2, 3]), ("*.{ogg,mid}", [1, 2, 3]),
     ("units/[!O]*", [6, 8]), ("world/**/rain.ogg", [1]), ("units/**", [4, 5, 6, 8]), ("WORLD\\AUDIO", [1, 2]), ("ra?n.ogg", [1]), ("", list(range(1, 9)))],
)
def test_path_queries(names, query, want):
    parsed = G.PathQuery.parse(query)
    hit = names.filter(G.glob(F.col("path"), parsed.pattern)) if parsed.glob else search.literal(names, parsed)
    assert ids(hit) == want


def test_missing_literal_and_bad_globs(names, entries):
    with pytest.raises(G.NotFound):
        search.literal(names, G.PathQuery.parse("does/not/exist"))
    for bad in ("a[b", "a{b", "*\\", "[z-a]*"):
        with pytest.raises(G.BadPattern):
            G.PathQuery.parse(bad)
    assert search.by_text(entries, names, "a[b").collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text("ab/*?[]{},!-.", min_size=1, max_size=8))
def test_rewrites_match_the_regular_expression(spark, pattern):
    try:
        regex = G.to_regex(pattern)
    except G.BadPattern:
        return
    paths = spark.createDataFrame([(p,) for p in ("a", "b", "ab", "a/b", "a/b/a", "/a", "b.a", "B/A", "a-b", "", "aa/bb.ab")], "path string")
    import re

    got = {r.path for r in paths.filter(G.glob(F.col("path"), pattern)).collect()}
    assert got == {r.path for r in paths.collect() if re.search(regex, r.path)}


def test_search_fields(names, entries):
    q = search.SearchQuery
    assert [r.name_hash for r in search.search(entries, names, q().filename("AUDIO")).collect()] == [2, 1, 1]
    assert ids(search.search(entries, names, q().with_locale(16))) == [1, 50]
    assert ids(search.search(entries, names, q().with_locale(0))) == []
    assert ids(search.search(entries, names, q().with_content(0x08000000))) == [50]
    assert ids(search.search(entries, names, q(name_contains=""))) == [1, 1, 2, 3, 4, 5, 7, 8]  # null names never match
    assert ids(search.search(entries, names, q(ckey_hex="0303"))) == [3]
    assert ids(search.search(entries, names, q(hash_hex="000000000000003"))) == [50]
    assert ids(search.search(entries, names, q(hash_hex="xyz"))) == []
    found = search.search(entries, names, q(limit=3)).collect()
    assert [r.path for r in found] == sorted(p for h, p in PATHS if h != 6)[:3]
    assert search.search(entries, names, q()).collect()[-1].path is None
    assert ids(search.by_hash(entries, names, 1)) == [1, 1]
    assert ids(search.by_text(entries, names, "*.mdl")) == [4, 5]  # 6 has no entry
    assert search.exists(entries, name_hash=50) and not search.exists(entries, name_hash=6)


def test_hex_prefixes_are_ranges():
    assert G.hex_range("0") == (0, 2**60 - 1)
    assert G.hex_range("F") == (-(2**60), -1)
    assert G.hex_range("8000000000000000") == (-(2**63), -(2**63))


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 1, "b"), (2, None, "n"), (2, 0, "z")], "k int, o int, v string")
    assert {(r.k, r.v) for r in first_wins(df, ["k"], ["o"]).collect()} == {(1, "a"), (2, "n")}
    assert {(r.k, r.v) for r in last_wins(df, ["k"], ["o"]).collect()} == {(1, "c"), (2, "z")}


def test_selection_by_locale(entries):
    found = {r.name_hash: r.entry_ord for r in resolve.select_entries(entries, 16).collect()}
    assert found[1] == 1 and found[2] == 0


def test_resolve_errors(spark, names, entries):
    encoding = spark.createDataFrame([(bytearray([h] * 16), [bytearray([h + 100] * 16)], h) for h in (1, 2, 3)], "ckey binary, ekeys array<binary>, size long")
    index = spark.createDataFrame([(bytearray([h + 100] * 9), 0, 0, 10 * h, 7) for h in (1, 2)], "ekey9 binary, storage int, archive long, offset long, size long")
    found = {r.name_hash: (r.error, r.offset) for r in resolve.resolve(names, entries, encoding, index, 0xFFFFFFFF).collect()}
    assert found == {1: (None, 10), 2: (None, 20), 3: ("index_not_found", None), 4: ("encoding_not_found", None), 5: ("encoding_not_found", None), 6: ("name_not_found", None), 7: ("encoding_not_found", None), 8: ("encoding_not_found", None)}


def test_best_ekey_prefers_a_known_key(spark):
    a, b = bytes(range(16)), bytes(range(16, 32))
    encoding = spark.createDataFrame([(bytearray(b"x"), [bytearray(a), bytearray(b)], 1), (bytearray(b"y"), [bytearray(a)], 2)], "ckey binary, ekeys array<binary>, size long")
    assert {bytes(r.ckey): bytes(r.ekey) for r in resolve.best_ekey(encoding).collect()} == {b"x": a, b"y": a}
    keys = spark.createDataFrame([(int.from_bytes(b[:8], "little"),)], "key_name long")
    assert {bytes(r.ckey): bytes(r.ekey) for r in resolve.best_ekey(encoding, keys).collect()} == {b"x": b, b"y": a}


def test_longest_prefix_is_strict_and_keeps_repeats(spark):
    paths = spark.createDataFrame([("ab/c",), ("ab/c",), ("ab",), ("x",), ("abc",)], "path string")
    packages = spark.createDataFrame([("a", 1), ("ab", 2), ("ab/c", 3)], "package string, package_id int")
    assert sorted((r.path, r.package_id) for r in resolve.longest_prefix(paths, packages).collect() if r.package_id) == [("ab", 1), ("ab/c", 2), ("ab/c", 2), ("abc", 2)]
    assert resolve.longest_prefix(paths, packages.limit(0)).count() == 5
    many = spark.createDataFrame([("ab/c"[:1] + "x" * k, k) for k in range(50)] + [("ab", 99)], "package string, package_id int")
    assert sorted((r.path, r.package_id) for r in resolve.longest_prefix(paths, many).collect()) == [("ab", 0), ("ab/c", 99), ("ab/c", 99), ("abc", 99), ("x", None)]


def test_tree(spark):
    rows = [(1, "Base\\Sound//Foo.snd"), (2, "base/sound/FOO.SND"), (3, "BASE/x/y/z.txt"), (4, "top.txt"), (5, "//")]
    files = tree.tree_files(spark.createDataFrame(rows, "name_hash long, path string"), "name_hash")
    got = {("/".join(r.folder_key), r.file_key): r.name_hash for r in files.collect()}
    assert got == {("base/sound", "foo.snd"): 2, ("base/x/y", "z.txt"): 3, ("", "top.txt"): 4}
    assert {(r.folder, r.files) for r in tree.rollup(files).collect()} == {("", 3), ("base", 2), ("base/sound", 1), ("base/x", 1), ("base/x/y", 1)}
    assert {r.folder for r in tree.folder_paths(files).collect()} == {"base", "base/sound", "base/x", "base/x/y"}
    assert {(r.name, r.is_folder) for r in tree.children(files, []).collect()} == {("base", True), ("top.txt", False)}
    assert {r.name_hash for r in tree.walk(files, ["Base"]).collect()} == {2, 3}
    display = {"/".join(r.folder_key): r.display for r in tree.folder_names(spark.createDataFrame(rows, "name_hash long, path string"), "name_hash").collect()}
    assert display["base"] == "Base" and display["base/sound"] == "Sound"
    assert {r["rank"] for r in tree.listing(files, 1).collect()} == {1}


def test_sets(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "path string, ckey string")
    b = spark.createDataFrame([("q", "2"), ("r", "9"), ("s", "4")], "path string, ckey string")
    assert {(r.path, r.change) for r in sets.archive_diff(a, b).collect()} == {("p", "removed"), ("r", "changed"), ("s", "added")}
    assert {r.path for r in sets.toggle(a.select("path"), b.select("path")).collect()} == {"p", "s"}
    with pytest.raises(ValueError):
        sets.storage_union([], ["k"], [])


def test_listing_is_cut_before_the_shuffle(spark, names):
    plan = tree.listing(tree.tree_files(names))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_prefix_globs_reach_the_scan(spark, sf_dir):
    plan = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").filter(F.col("url").startswith("http://a"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in plan
