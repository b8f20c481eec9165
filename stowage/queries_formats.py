"""Queries that take the generic tables through a format's writer and reader, or a parser, and give the rows again."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec, preview
from .functions import columns as C
from .operators import content, resolve, search, tree
from .operators.unique import first_wins
from .queries import ROOT, query
from .session import table
from .sources import binary, blocks, formats, model, text, trie
from .sources.tables import root


def files(rows: DataFrame, by: list[str], build: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """(file, blob): a file per group of bounded size, written by build."""

    def made(key, pdf):
        return pd.DataFrame({"file": ["-".join(map(str, key))], "blob": [build(pdf)]})

    return rows.groupBy(*by).applyInPandas(made, "file string, blob binary")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dealt to groups of bounded size."""
    c = table(spark, sf_dir, "customer")
    return c.withColumns({"part": F.floor(F.col("c_custkey") / 2000), "k": F.unhex(F.md5("c_name"))})


@query("select upper(substr(md5(c_name), 1, 18)) as ekey9, cast(c_nationkey as bigint) as archive, c_custkey as \"offset\", cast(length(c_name) as bigint) as size from customer")
def local_index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files(_customers(spark, sf_dir), ["part"], lambda p: formats.write_local_index([(bytes(k[:9]), int(a), int(o), len(n)) for k, a, o, n in zip(p["k"], p["c_nationkey"], p["c_custkey"], p["c_name"], strict=True)]))
    return binary.parsed(made, "local_index", strict=True).select(F.hex("ekey9").alias("ekey9"), "archive", "offset", "size")


@query("select upper(md5(c_name)) as ekey, cast(length(c_name) as bigint) as size, c_custkey as \"offset\" from customer")
def archive_index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files(_customers(spark, sf_dir), ["part"], lambda p: formats.write_archive_index([(bytes(k), len(n), int(o)) for k, n, o in zip(p["k"], p["c_name"], p["c_custkey"], strict=True)], offset_bytes=5))
    return binary.parsed(made, "archive_index", strict=True).select(F.hex("ekey").alias("ekey"), "size", "offset")


@query("select upper(md5(c_name)) as ckey, upper(md5(c_name || 'e')) as ekey, cast(c_custkey % 2 + 1 as integer) as n, c_custkey as size from customer")
def encoding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _customers(spark, sf_dir).withColumn("e", F.unhex(F.md5(F.concat("c_name", F.lit("e")))))
    made = files(own, ["part"], lambda p: formats.write_encoding([(bytes(k), [bytes(e)] * (1 + int(o) % 2), int(o)) for k, e, o in zip(p["k"], p["e"], p["c_custkey"], strict=True)]))
    return binary.parsed(made, "encoding", strict=True).select(F.hex("ckey").alias("ckey"), F.hex(F.element_at("ekeys", 1)).alias("ekey"), F.size("ekeys").alias("n"), "size")


@query("select c_custkey * 1000003 as name_hash, c_custkey as file_data_id, upper(md5(c_name)) as ckey, cast(2 as bigint) as locale, cast(1 as bigint) as content from customer")
def manifest_root_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as deltas in blocks, and back."""
    made = files(_customers(spark, sf_dir), ["part"], lambda p: formats.write_manifest_root([(2, 1 | 0x2, [(int(i), bytes(k), int(i) * 1000003) for i, k in sorted(zip(p["c_custkey"], p["k"], strict=True))])], 2))
    return binary.root_entries(made, strict=True).select("name_hash", "file_data_id", F.hex("ckey").alias("ckey"), "locale", "content")


@query("select c_custkey as name_hash, upper(md5(c_name)) as ckey from customer")
def flat_root_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files(_customers(spark, sf_dir), ["part"], lambda p: b"".join(bytes(k) + int(i).to_bytes(8, "little") + bytes(4) for i, k in zip(p["c_custkey"], p["k"], strict=True)))
    return binary.parsed(made, "flat_root", strict=True).select("name_hash", F.hex("ckey").alias("ckey"))


@query("select 'customers/' || c_name as name, upper(md5(c_name)) as ckey, c_custkey as size, case when c_acctbal < 0 then 1 else 0 end as tagged from customer")
def install_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(p: pd.DataFrame) -> bytes:
        bits = bytearray(-(-len(p) // 8))
        for n, b in enumerate(p["c_acctbal"] < 0):
            bits[n // 8] |= b << 7 - n % 8
        return formats.write_install([("debt", 1, bytes(bits))], [(f"customers/{n}", bytes(k), int(i)) for n, k, i in zip(p["c_name"], p["k"], p["c_custkey"], strict=True)])

    return binary.parsed(files(_customers(spark, sf_dir), ["part"], build), "install_files", strict=True).select("name", F.hex("ckey").alias("ckey"), "size", F.size("tags").alias("tagged"))


@query("select cast(c_custkey as integer) as sno_id, c_nationkey as grp, c_name as name from customer")
def contents_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(p: pd.DataFrame) -> bytes:
        return formats.write_contents({int(g): [(int(i), n) for i, n in zip(q["c_custkey"], q["c_name"], strict=True)] for g, q in p.groupby("c_nationkey")})

    return binary.parsed(files(_customers(spark, sf_dir), ["part"], build), "contents", strict=True).select("sno_id", "grp", "name")


@query(f"with {ROOT} select path, upper(substr(ckey, 1, 18)) as ekey9 from root")
def vfs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths through a file system's prefix tree."""
    own = root(spark, sf_dir).select("path", F.unhex("ckey").alias("k"), F.floor(F.col("doc_id") / 2000).alias("part"))
    made = files(own, ["part"], lambda p: formats.write_vfs({n: (bytes(k), 1) for n, k in zip(p["path"], p["k"], strict=True)}))
    return binary.parsed(made, "vfs_files", strict=True).select("path", F.hex(F.substring("ekey", 1, 9)).alias("ekey9"))


@query(f"with {ROOT} select path, upper(ckey) as ckey, 'ok' as status, cast(case when lang = 'fr' then 16 else 4294967295 end as bigint) as locale from root")
def trie_root_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths through succinct tries: packages, names, entry chains; every path comes back by the joins."""
    own = root(spark, sf_dir).select("path", F.unhex("ckey").alias("k"), "lang", F.floor(F.col("doc_id") / 2000).alias("part"))

    def build(p: pd.DataFrame) -> bytes:
        package = [f"{'frFR' if x == 'fr' else 'base'}.StormData/{x}" for x in p["lang"]]
        found: dict[str, list] = {}
        for n, k, g in zip(p["path"], p["k"], package, strict=True):
            found.setdefault(n, []).append((g, bytes(k)))
        return trie.write_trie_root(sorted(set(package)), found, list(found))

    out = trie.trie_entries(files(own, ["part"], build), strict=True)
    return out.select(F.regexp_replace("path", "^[a-zA-Z]+\\.StormData/[a-z]+/", "").alias("path"), F.hex("ckey").alias("ckey"), "status", "locale")


@query("select cast(label as integer) as label, cast(embedding[1] as float) as x, cast(embedding[2] as float) as y, cast(embedding[3] as float) as z from embeddings")
def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through a self-describing model file with coded sections."""
    import struct

    own = table(spark, sf_dir, "embeddings").select("label", "embedding", F.floor(F.col("vec_id") / 500).alias("part"))

    def build(p: pd.DataFrame) -> bytes:
        w = model.Writer()
        types = w.type_list([("Rows", 3, [("Label", 19, None, 0), ("Position", 10, None, 3)], 0)])
        at = w.put(b"".join(struct.pack("<i3f", int(n), *map(float, e[:3])) for n, e in zip(p["label"], p["embedding"], strict=True)))
        place = w.put(struct.pack("<I", len(p)) + bytes(4))
        w.fix[0].append((place + 4, 0, at))
        return w.file(types, place, True)

    rows = model.flattened(files(own, ["part"], build), strict=True)
    at = F.element_at("ord", 2)
    each = rows.filter("path in ('Rows/Label', 'Rows/Position')").groupBy("file", at.alias("n")).agg(
        F.max(F.when(F.col("path") == "Rows/Label", F.col("i32_v"))).cast("int").alias("label"),
        *[F.max(F.when((F.col("path") == "Rows/Position") & (F.try_element_at("ord", F.lit(4)) == k), F.col("f32_v"))).alias(c) for k, c in enumerate("xyz")],
    )
    return each.select("label", "x", "y", "z")


@query("""with l as (select page_id, case page_id % 4 when 0 then page_id || ';' || url when 1 then '# ' || url when 2 then '  ' || url || ' ' else 'x' || page_id || ';' || url end as line from pages)
select page_id, case when page_id % 4 = 0 then page_id end as file_data_id, case when page_id % 4 = 0 then substr(line, length(page_id::varchar) + 2) else trim(line) end as path from l where page_id % 4 <> 1""")
def listfile_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listfile lines in all their forms; the comments are the parser's to drop."""
    k, url = F.col("page_id"), F.col("url")
    line = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(";"), url)).when(k % 4 == 1, F.concat(F.lit("# "), url)).when(k % 4 == 2, F.concat(F.lit("  "), url, F.lit(" "))).otherwise(F.concat(F.lit("x"), k.cast("string"), F.lit(";"), url))
    own = table(spark, sf_dir, "pages").select(k.alias("line_no"), line.alias("line"))
    return text.listfile(own).withColumnRenamed("line_no", "page_id")


@query(f"with {ROOT} select path, upper(ckey) as ckey, cast(case lang when 'fr' then 16 when 'de' then 32 else 4294967295 end as bigint) as locale from root where lang <> 'es'")
def text_root_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text root lines with and without locales; those with a bad key are passed over."""
    own = root(spark, sf_dir)
    code = F.when(F.col("lang") == "fr", ":frFR").when(F.col("lang") == "de", ":deDE").otherwise("")
    key = F.when(F.col("lang") == "es", "not a key").otherwise(F.col("ckey"))
    numbered = own.select(F.col("doc_id").alias("line_no"), F.concat("path", code, F.lit("|"), key).alias("line"))
    return text.text_root(numbered).select("path", F.hex("ckey").alias("ckey"), "locale")


@query("select cast(n as bigint) as key_name, upper(md5(cast(n as varchar))) as key from (select n_nationkey as n from nation)")
def key_file_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    lines = table(spark, sf_dir, "nation").select(F.explode(F.array(F.concat(F.lpad(F.hex(F.col("n_nationkey").cast("bigint")), 16, "0"), F.lit(" "), F.md5(k)), F.lit("# x"), F.lit("zz;zz"))).alias("line"))
    return text.key_file(lines).select("key_name", F.hex("key").alias("key"))


@query("""with e as (select event_type as key, event_id, cast(user_id as varchar) as v from events), m as (select key, max(event_id) as event_id from e group by key)
select key, v as value from m join e using (key, event_id)""")
def config_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.concat("event_type", F.lit(" = "), F.col("user_id").cast("string")).alias("line"))
    return text.config(lines).select("key", F.element_at("values", 1).alias("value"))


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = root(spark, sf_dir)
    entries = own.select(F.col("doc_id").alias("name_hash"), F.lit(0).alias("entry_ord"), F.unhex("ckey").alias("ckey"), "locale", F.lit(0).cast("bigint").alias("content"))
    names = own.filter("lang <> 'es'").select(F.col("doc_id").alias("name_hash"), "path")
    return entries, names, own.select((F.col("doc_id") + 7).alias("file_data_id"), F.col("doc_id").alias("name_hash"))


@query(f"with {ROOT} select doc_id as name_hash, case when lang <> 'es' then path end as path, doc_id + 7 as file_data_id, locale from root where locale & 144 <> 0")
def search_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by locale with name and id, null where there is none."""
    entries, names, fdids = _catalog(spark, sf_dir)
    return search.search(entries, names, search.SearchQuery(locale=144), fdids).select("name_hash", "path", "file_data_id", "locale")


@query(f"with {ROOT} select doc_id as name_hash, path from root where lang <> 'es' and lower(path) like '%/src4/%' and lower(path) like '%.txt'")
def search_text_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, names, _ = _catalog(spark, sf_dir)
    return search.by_text(entries, names, "**/src4/**/*.TXT").select("name_hash", "path")


@query(f"with {ROOT} select doc_id as name_hash, path from root where lang <> 'es' and contains(lower(path), 'c4/e')")
def search_text_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, names, _ = _catalog(spark, sf_dir)
    return search.by_text(entries, names, "C4/E").select("name_hash", "path")


@query(f"with {ROOT} select doc_id as name_hash, path from root where lang <> 'es' order by path, printf('%016X', doc_id) limit 25")
def search_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 in the total order: a top-k."""
    entries, names, _ = _catalog(spark, sf_dir)
    return search.search(entries, names, search.SearchQuery(name_contains="", limit=25)).select("name_hash", "path")


@query("""select p_partkey, case when contains(p_name, 'a') then 'Steam' else 'Battle.net' end as launcher, 'data.' || lpad(cast(p_size as varchar), 3, '0') as file,
'root_' || lpad(cast(p_size as varchar), 3, '0') || '.wmo' as group_file from part""")
def names_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = F.when(F.col("p_name").contains("a"), "/home/steamapps/x").otherwise("/games/x")
    return table(spark, sf_dir, "part").select("p_partkey", C.launcher(where).alias("launcher"), C.data_file(F.col("p_size")).alias("file"), C.group_file(F.lit("root.wmo"), F.col("p_size")).alias("group_file"))


@query("""with f as (select p_partkey, round(p_retailprice, 2) as v from part) select p_partkey, case when v < 10 and v <> round(v) then 'fraction' when v = round(v) then printf('%.0f', v) else 'number' end as shown,
cast(p_partkey % 90 as bigint) as table_id from f""")
def formula_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.round("p_retailprice", 2)
    shown = C.sf_display(v.cast("string"))
    kind = F.when(shown.endswith("%)"), "fraction").when(v == F.rint(v), shown).otherwise("number")
    _, number = C.coefficient(F.concat(v.cast("string"), F.lit(" * Table("), (F.col("p_partkey") % 90).cast("string"), F.lit(", 1)")))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("shown"), number.alias("table_id"))


@query("""select s_suppkey, case s_suppkey % 3 when 0 then 16 when 1 then 32 else 4294967295 end as locale, case s_suppkey % 3 when 0 then 'Data' when 1 then 'SC2Data' end as folder,
case s_suppkey % 3 when 0 then 'WoW' when 1 then 'SC2' else 'ZZZ' end as shown from supplier""")
def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    uid = F.when(k == 0, "wow").when(k == 1, "s2x").otherwise("zzz")
    path = F.when(k == 0, "mods/frFR.SC2Data").when(k == 1, "x.deDE.stormassets").otherwise("base.SC2Data")
    game = C.game_type(uid)
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.package_locale(path).alias("locale"), C.data_folder(game).alias("folder"), C.display_name(game, uid).alias("shown"))


@query("select doc_id, md5(text) as data_md5, 'local' as served_by from documents where lang <> 'de' union all select doc_id, md5(text || '!'), 'remote' from documents where lang = 'de'")
def remote_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A local failure of any kind is served by the other store if that has it."""
    d = table(spark, sf_dir, "documents")
    bad = F.col("lang") == "de"
    local = d.select("doc_id", F.when(~bad, F.col("text").cast("binary")).alias("data"), F.when(bad, "bad_block").alias("error"))
    remote = d.select("doc_id", F.concat("text", F.lit("!")).cast("binary").alias("data"), F.lit(None).cast("string").alias("error"))
    return resolve.fallback(local, remote, "doc_id").select("doc_id", F.md5("data").alias("data_md5"), "served_by")


@query("select source, md5(text) as data_md5 from documents")
def decode_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are stored and decoded once, and joined back to every path."""
    d = table(spark, sf_dir, "documents").select("source", F.md5("text").alias("ekey"), "text")

    def frames(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([codec.encode([x]) for x in part.column(1).to_pylist()], pa.binary())], ["ekey", "blob"])

    stored = first_wins(d.select("ekey", F.col("text").cast("binary").alias("b")), ["ekey"], [F.lit(0)]).mapInArrow(frames, "ekey string, blob binary")
    return codec.decode_distinct(d.select("source", "ekey"), stored).select("source", F.md5("data").alias("data_md5"))


@query("select 'SF definition' as kind, cast(count(*) as bigint) as matches from part where contains(lower(p_name), 'a') union all select 'formula', count(*) from part where contains(lower(p_type), 'a')")
def content_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of parts as strings of power files, and a search for a letter in all of them."""
    import struct

    own = table(spark, sf_dir, "part").withColumn("part", F.floor(F.col("p_partkey") / 500))

    def build(p: pd.DataFrame) -> bytes:
        a, b = (b"\0".join(x.encode() for x in p[c]) + b"\0" for c in ("p_name", "p_type"))
        head = bytearray(0xA0)
        struct.pack_into("<I", head, 0, preview.POWER)
        struct.pack_into("<4I", head, 0x80, 0xA0, len(a), 0xA0 + len(a), len(b))
        return bytes(head) + a + b

    blobs = files(own, ["part"], build).select(F.concat("file", F.lit(".pow")).alias("path"), "blob")
    return content.content_search(blobs, "A").filter("kind <> 'power id'").groupBy("kind").agg(F.count("*").alias("matches"))


@query("select 'text' as plugin, cast(count(*) as bigint) as blobs from pages where length(html) > 0")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = table(spark, sf_dir, "pages").filter("length(html) > 0").select("url", F.col("html").cast("binary").alias("blob"))
    return content.previews(blobs, "url").groupBy("plugin").agg(F.count("*").alias("blobs"))


@query(f"with {ROOT} select lower(source) as folder, source as display, cast(count(*) as bigint) as files from root group by 1, 2")
def folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the second level by the casing that came first, with how many files lie below."""
    own = root(spark, sf_dir).select("path", "doc_id")
    shown = tree.folder_names(own, "doc_id").filter(F.size("folder_key") == 2)
    below = own.select(F.element_at(tree.folder_of(F.col("path")), 2).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))
    return below.join(shown.select(F.element_at("folder_key", 2).alias("folder"), "display"), "folder").select("folder", "display", "files")


@query(f"""with {ROOT}, v as (select doc_id, cast('0x' || substr(ckey, 19, 14) as bigint) as b from root), w as (select doc_id, (b >> 44) & 4095 as chunk, (b >> 30) & 16383 as archive from v)
select doc_id, printf('%03d', chunk) || '/0x' || printf('%04x', archive) || '-meta.dat' as file from w""")
def static_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = blocks.static_location(F.unhex("ckey"), [(0, 12, 14, 30, 0)], 0)
    return root(spark, sf_dir).select("doc_id", F.element_at(blocks.candidate_files(where), 1).alias("file"))


@query("""with p as (select floor(c_custkey / 2000) as part, count(*) as n from customer group by 1)
select cast(count(*) as bigint) as files, cast(0 as bigint) as errors, cast(sum(n) as bigint) as entries, cast(sum(n) as bigint) as announced, cast(0 as bigint) as short from p""")
def index_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files(_customers(spark, sf_dir), ["part"], lambda p: formats.write_archive_index([(bytes(k), len(n), 0) for k, n in zip(p["k"], p["c_name"], strict=True)], offset_bytes=0))
    return binary.index_audit(made)


@query("select source, doc_id as decoded from documents")
def fdid_delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a manifest's blocks from their deltas."""
    own = table(spark, sf_dir, "documents").select("source", "doc_id", F.floor(F.col("doc_id") / 2000).alias("part"))
    made = files(own, ["source", "part"], lambda p: formats.write_manifest_root([(2, 0x10000000, [(i, bytes(16), None) for i in sorted(p["doc_id"])])], 1))
    return binary.root_entries(made, strict=True).select(F.element_at(F.split("file", "-"), 1).alias("source"), F.col("file_data_id").alias("decoded"))


@query("select event_type || '.' || event_id as key, cast(2 as integer) as n from events")
def kv_config_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.concat_ws(" ", F.concat("event_type", F.lit("."), "event_id"), F.lit("= "), F.col("user_id").cast("string"), F.lit(" "), F.col("event_id").cast("string"))
    return text.config(table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), lines.alias("line"))).select("key", F.size("values").alias("n"))


@query("select case page_id % 3 when 0 then 'audio' when 1 then 'chunked' else 'text' end as plugin, cast(count(*) as bigint) as blobs from pages where length(html) > 0 group by 1")
def content_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plug-in that claims a blob, by its first bytes."""
    k = F.col("page_id") % 3
    head = F.when(k == 0, "OggS").when(k == 1, "REVM").otherwise("")
    blobs = table(spark, sf_dir, "pages").filter("length(html) > 0").select(F.concat(F.lit("p"), "page_id").alias("name"), F.concat(head, "html").cast("binary").alias("blob"))
    return content.previews(blobs, "name").groupBy("plugin").agg(F.count("*").alias("blobs"))


@query("""select case page_id % 6 when 0 then 'creature' when 1 then 'world model' when 2 then 'blp' when 3 then 'texture' when 4 then 'unknown' else 'empty' end as kind,
  cast(count(*) as bigint) as blobs, cast(count_if(page_id % 6 < 4) as bigint) as refused from pages where length(html) > 0 group by 1""")
def inspect_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file is by its first bytes; the pages behind these are no files of their kinds."""
    k = F.col("page_id") % 6
    body = F.when(k < 4, F.concat(F.element_at(F.array(*map(F.lit, ("MD21", "REVM", "BLP2", "<DE("))), (F.least(k, F.lit(3)) + 1).cast("int")), "html")).when(k == 4, F.concat(F.lit("?"), "html")).otherwise("")
    blobs = table(spark, sf_dir, "pages").filter("length(html) > 0").select(F.concat(F.lit("p"), "page_id").alias("path"), body.cast("binary").alias("blob"))
    return content.inspected(blobs).groupBy("kind").agg(F.count("*").alias("blobs"), F.count("error").alias("refused"))


@query("""select 'c' || c_custkey || '.pow' as path, cast(0 as integer) as index, c_name as text from customer
union all select 'c' || c_custkey || '.pow', cast(2 as integer), c_mktsegment from customer""")
def scaling_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of power files: a customer's name, sixteen bytes that are none, and the segment."""
    head = bytearray(0x270)
    struct.pack_into("<I", head, 0x78, 0x260)
    struct.pack_into("<I", head, 0x268, 0x270)
    filled = lambda c: F.encode(F.rpad(F.col(c), F.floor(F.length(c) / 4).cast("int") * 4 + 4, "\0"), "UTF-8")
    tail, bad = F.lit(bytearray([5] + [0] * 11)), F.lit(bytearray([1] * 16))
    blob = F.concat(F.lit(head), filled("c_name"), tail, bad, filled("c_mktsegment"), tail)
    return content.factors(table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey", F.lit(".pow")).alias("path"), blob.alias("blob"))).select("path", "index", "text")
