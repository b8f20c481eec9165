"""The queries over the generic tables, one per operator or group of operators, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codec, preview
from .functions import columns as C
from .functions.hashing import name_hash, salsa20
from .operators import resolve, search, sets, tree
from .operators.unique import first_wins, last_wins
from .plans.glob import PathQuery, glob, hash_prefix
from .session import table
from .sinks.export import plan_status
from .sources import binary, formats
from .sources.tables import content, root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The root view of sources.tables in SQL.
ROOT = """root as (select doc_id, 'Corpus/' || source || '/' || lang || '/Doc_' || doc_id || '.txt' as path, md5(text) as ckey,
  cast(case lang when 'en' then 2 when 'fr' then 16 when 'de' then 32 when 'es' then 128 end as bigint) as locale,
  cast(octet_length(encode(text)) as bigint) as size, lang, source from documents)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"""with {ROOT}, hit as (select * from root where regexp_full_match(lower(path), '(?:/?|.*/)src1[0-3]/(?:fr|de)/.*\\.txt') and locale & 48 <> 0),
one as (select ckey, min_by(path, doc_id) as path, min_by(source, doc_id) as source, min_by(size, doc_id) as size from hit group by ckey)
select source as folder, cast(count(*) as bigint) as files, cast(sum(size) as bigint) as bytes from one group by source""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glob and locale mask, first path of each content key, rollup by folder."""
    hit = root(spark, sf_dir).filter(glob(F.col("path"), "**/src1[0-3]/{fr,de}/*.txt") & C.locale_matches(F.col("locale"), 48))
    one = first_wins(hit.select("ckey", "doc_id", "source", "size"), ["ckey"], ["doc_id"])
    return one.groupBy(F.col("source").alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(f"with {ROOT} select doc_id, path, locale from root where regexp_full_match(lower(path), '(?:/?|.*/)src1[0-3]/fr/.*\\.txt')")
def search_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return root(spark, sf_dir).filter(glob(F.col("path"), "**/src1[0-3]/fr/*.txt")).select("doc_id", "path", "locale")


@query(f"with {ROOT} select doc_id, path from root where lower(path) like 'corpus/src7/%' or lower(path) like '%/doc_17.txt'")
def search_glob_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs that become a prefix and a suffix, so nothing is matched as a regular expression."""
    p = F.col("path")
    return root(spark, sf_dir).filter(glob(p, "Corpus/src7/*") | glob(p, "**/Doc_17.txt")).select("doc_id", "path")


@query(f"with {ROOT} select doc_id, ckey from root where starts_with(ckey, 'a') and locale & 2 <> 0")
def search_mask_ckey_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.SearchQuery(ckey_hex="a", locale=2).predicate()
    own = root(spark, sf_dir).withColumns({"hexkey": F.col("ckey"), "ckey": F.unhex("ckey")})
    return own.filter(found).select("doc_id", F.col("hexkey").alias("ckey"))


@query("select page_id, url from pages where contains(lower(url), 'example.com') order by url, page_id limit 40")
def search_substring_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    found = own.filter(search.SearchQuery(name_contains="Example.COM").predicate())
    return found.orderBy("path", "page_id").limit(40).select("page_id", F.col("path").alias("url"))


def _fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.fdid_hash(F.col("doc_id")).alias("name_hash"))


#: The file data id's hash with 128-bit integers.
FNV = """fnv as (select doc_id, list_reduce([14695981039346656037::hugeint, doc_id & 255, (doc_id >> 8) & 255, (doc_id >> 16) & 255, (doc_id >> 24) & 255],
  lambda h, b: ((xor(h, b::hugeint) * 435 + xor(h, b::hugeint) % 4294967296 * 4294967296) % 18446744073709551616)) as h from documents)"""


@query(f"with {FNV} select doc_id, cast(case when h >= 9223372036854775808 then h - 18446744073709551616 else h end as bigint) as name_hash from fnv")
def fdid_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fnv(spark, sf_dir)


@query(f"with {FNV} select doc_id from fnv where starts_with(printf('%016X', h::uhugeint::ubigint), 'A5')")
def search_hash_prefix_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hex prefix of a hash as a range over signed bits."""
    return _fnv(spark, sf_dir).filter(hash_prefix(F.col("name_hash"), "a5")).select("doc_id")


@query(f"with {ROOT}, k as (select substr(ckey, 1, 18) as ekey9, doc_id, size, row_number() over (partition by substr(ckey, 1, 18) order by doc_id) as n from root) select ekey9, doc_id, size from k where n = 1")
def first_seen_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = root(spark, sf_dir).select(F.substring("ckey", 1, 18).alias("ekey9"), "doc_id", "size")
    return resolve.index_table(own, ["doc_id"])


@query(f"with {ROOT}, k as (select substr(ckey, 1, 18) as ekey9, doc_id, row_number() over (partition by substr(ckey, 1, 18) order by doc_id desc) as n from root) select ekey9, doc_id from k where n = 1")
def reverse_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_wins(root(spark, sf_dir).select(F.substring("ckey", 1, 18).alias("ekey9"), "doc_id"), ["ekey9"], ["doc_id"])


@query(f"with {ROOT} select doc_id % 97 as name_hash, arg_min(doc_id, (case when locale & 16 <> 0 then 0 else 1 end) * 1000000000 + doc_id) as entry_ord from root group by doc_id % 97")
def locale_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One variant per name: the first that fits the locale, else the first."""
    own = root(spark, sf_dir).select((F.col("doc_id") % 97).alias("name_hash"), F.col("doc_id").alias("entry_ord"), "locale")
    return resolve.select_entries(own, 16).select("name_hash", "entry_ord")


#: Encoding and index of the root view: a key's file holds the distinct keys before it, keys without a leading 'f' only.
CHAIN = f"""{ROOT}, enc as (select ckey, md5('e' || ckey) as ekey, max(size) as size from root where ckey not like 'f%' group by ckey),
idx as (select substr(ekey, 1, 18) as ekey9, cast(sum(size) over (order by ekey rows unbounded preceding) - size as bigint) as "offset", size as encoded_size from enc where ekey not like '0%')"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = root(spark, sf_dir)
    names = own.select("path", F.col("doc_id").alias("name_hash"))
    entries = own.filter("lang <> 'es'").select(F.col("doc_id").alias("name_hash"), F.lit(0).alias("entry_ord"), F.unhex("ckey").alias("ckey"), "locale", F.lit(0).alias("content"))
    enc = own.filter(~F.col("ckey").startswith("f")).groupBy("ckey").agg(F.max("size").alias("size")).withColumn("ekey", F.md5(F.concat(F.lit("e"), "ckey")))
    encoding = enc.select(F.unhex("ckey").alias("ckey"), F.array(F.unhex("ekey")).alias("ekeys"), "size")
    # offsets as a running sum by range: totals per first digit are summed first, so no task sees all keys
    part = enc.filter(~F.col("ekey").startswith("0")).withColumn("p", F.substring("ekey", 1, 2))
    totals = part.groupBy("p").agg(F.sum("size").alias("t"))
    base = totals.select("p", (F.sum("t").over(Window.orderBy("p")) - F.col("t")).alias("base"))  # at most 256 rows
    w = Window.partitionBy("p").orderBy("ekey").rowsBetween(Window.unboundedPreceding, 0)
    index = part.join(F.broadcast(base), "p").select(F.unhex(F.substring("ekey", 1, 18)).alias("ekey9"), (F.col("base") + F.sum("size").over(w) - F.col("size")).cast("bigint").alias("offset"), "size")
    return resolve.resolve(names, entries, encoding, index, 0xFFFFFFFF)


@query(f"""with {CHAIN} select path, case when r.lang = 'es' then null else upper(r.ckey) end as ckey, case when r.lang <> 'es' then upper(enc.ekey) end as ekey,
  case when r.lang <> 'es' then "offset" end as "offset", case when r.lang = 'es' then 'name_not_found' when enc.ekey is null then 'encoding_not_found' when "offset" is null then 'index_not_found' end as error
from root r left join enc using (ckey) left join idx on idx.ekey9 = substr(enc.ekey, 1, 18)""")
def resolve_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir).select("path", F.hex("ckey").alias("ckey"), F.hex("ekey").alias("ekey"), "offset", "error")


@query(f"""with {CHAIN}, r2 as (select case when r.lang = 'es' or enc.ekey is null then 'error' when "offset" is null then 'missing_block' when r.source = 'src7' then 'exists' else 'ok' end as status
from root r left join enc using (ckey) left join idx on idx.ekey9 = substr(enc.ekey, 1, 18)) select status, cast(count(*) as bigint) as count from r2 group by status""")
def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export would report, by status."""
    there = F.col("path").startswith("Corpus/src7/")
    return sets.count_by(_chain(spark, sf_dir).select(plan_status(F.col("error"), there).alias("status")))


@query("""with e as (select l_orderkey as ckey, l_linenumber as pos, upper(md5(l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey)) as ekey, l_partkey % 13 = 0 as known from lineitem),
k as (select *, row_number() over (partition by ckey order by known desc, pos, ekey) as n from e) select ckey, ekey from k where n = 1""")
def best_ekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an order's lines as keys the first that is known by its first eight bytes, else the first."""
    hexed = F.upper(F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ckey"), "l_linenumber", hexed.alias("ekey"), (F.col("l_partkey") % 13 == 0).alias("known"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "ekey"))), lambda x: F.unhex(x["ekey"]))
    encoding = own.groupBy("ckey").agg(listed.alias("ekeys"), F.count("*").alias("size"))
    names = own.filter("known").select(C.le_uint(F.unhex("ekey"), 1, 8).alias("key_name"))
    return resolve.best_ekey(encoding, names).select("ckey", F.hex("ekey").alias("ekey"))


@query(f"""with {ROOT}, pkg(package, package_id) as (values ('Corpus/', 1), ('Corpus/src1', 2), ('Corpus/src1/', 3), ('Corpus/src12/fr/', 4), ('corpus/src2', 5), ('Corpus/src2/en/Doc_', 6)),
m as (select doc_id, package_id, row_number() over (partition by doc_id order by length(package) desc) as n from root join pkg on starts_with(path, package) and length(package) < length(path))
select doc_id, package_id from m where n = 1""")
def longest_prefix_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = spark.createDataFrame([("Corpus/", 1), ("Corpus/src1", 2), ("Corpus/src1/", 3), ("Corpus/src12/fr/", 4), ("corpus/src2", 5), ("Corpus/src2/en/Doc_", 6)], "package string, package_id int")
    return resolve.longest_prefix(root(spark, sf_dir).select("doc_id", "path"), packages).select("doc_id", "package_id")


@query("""with l as (select l_orderkey as chain, l_linenumber as pos, l_partkey, l_suppkey, l_partkey % 5 as pkg, l_partkey % 3 = 0 as last from lineitem),
c as (select *, coalesce(sum(case when last then 1 else 0 end) over (partition by chain order by pos, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding), 0) as link from l),
m as (select *, row_number() over (partition by chain, link, pkg order by pos, l_partkey, l_suppkey) as n from c)
select chain, cast(link as bigint) as link, pkg, pos, l_partkey from m where n = 1""")
def entry_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that end at a terminator, and in each run the first row of a package."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_suppkey", (F.col("l_partkey") % 5).alias("pkg"))
    order = ["pos", "l_partkey", "l_suppkey"]
    linked = resolve.chains(own, "chain", order, F.col("l_partkey") % 3 == 0)
    return first_wins(linked, ["chain", "link", "pkg"], order).select("chain", "link", "pkg", "pos", "l_partkey")


@query(f"""with {ROOT}, ids as (select doc_id as file_data_id, doc_id * 7 as h from root where lang in ('en', 'fr'))
select path, coalesce(h, length(path)) as name_hash from root left join ids on ids.file_data_id = case when lang <> 'fr' then doc_id end""")
def listfile_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = root(spark, sf_dir)
    fdids = own.filter("lang in ('en', 'fr')").select(F.col("doc_id").alias("file_data_id"), (F.col("doc_id") * 7).alias("name_hash"))
    lines = own.select("path", F.when(F.col("lang") != "fr", F.col("doc_id")).alias("file_data_id"))
    return resolve.listfile_hashes(lines, fdids, F.length("path").cast("bigint")).select("path", "name_hash")


@query(f"with {ROOT} select doc_id, path from root where starts_with(lower(path), 'corpus/src3/de/')")
def path_query_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = PathQuery.parse("corpus/SRC3\\de/")
    return root(spark, sf_dir).filter(wanted.folder(tree.folder_of(F.col("path")))).select("doc_id", "path")


@query(f"with {ROOT} select doc_id, path from root where lower(path) = 'corpus/src5/en/doc_5.txt'")
def path_query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = PathQuery.parse("CORPUS\\src5/en/doc_5.TXT")
    return root(spark, sf_dir).select("doc_id", "path").filter(wanted.file(F.col("path")))


@query(f"""with {ROOT}, f as (select string_split(lower(path), '/') as p, size from root), a as (select p[1:i] as k, size from f, unnest(range(0, len(p))) as t(i))
select array_to_string(k, '/') as folder, cast(len(k) as integer) as depth, cast(count(*) as bigint) as files, cast(sum(size) as bigint) as bytes from a group by k""")
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = root(spark, sf_dir)
    return tree.rollup(own.withColumn("folder_key", tree.folder_of(F.col("path"))), "size")


@query(f"""with {ROOT}, f as (select string_split(lower(path), '/') as p from root), a as (select distinct p[1:i] as k from f, unnest(range(1, len(p))) as t(i)) select array_to_string(k, '/') as folder from a""")
def folder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.folder_paths(root(spark, sf_dir).select(tree.folder_of(F.col("path")).alias("folder_key")))


@query(f"with {ROOT} select case when lang = 'en' then lower(source) else lower(source) end as name, true as is_folder, cast(count(*) as bigint) as files from root group by 1")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.children(tree.tree_files(root(spark, sf_dir).select("path")), ["corpus"])


@query("""with u as (select list_filter(string_split(replace(lower(url), '\\', '/'), '/'), lambda x: x <> '') as p, url from pages), f as (select array_to_string(p[1:len(p) - 1], '/') as folder, p[len(p)] as file, max(url) as url from u group by 1, 2),
r as (select *, row_number() over (partition by folder order by file) as rank from f) select folder, file, rank from r where rank <= 200""")
def folder_children_top200(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 files of each folder of the URLs."""
    files = tree.tree_files(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))
    return tree.listing(files).select(F.array_join("folder_key", "/").alias("folder"), F.col("file_key").alias("file"), F.col("rank").cast("bigint").alias("rank"))


@query("""with u as (select list_filter(string_split(replace(lower(url), '\\', '/'), '/'), lambda x: x <> '') as p, url, page_id from pages)
select array_to_string(p, '/') as key, max(page_id) as page_id from u group by 1""")
def tree_dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tree.tree_files(table(spark, sf_dir, "pages").select(F.col("url").alias("path"), "page_id"), "page_id")
    return files.select(F.array_join(F.concat("folder_key", F.array("file_key")), "/").alias("key"), "page_id")


@query(f"""with {ROOT} select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'removed' else 'changed' end as change
from (select path, ckey from root where source < 'src15') a full join (select path, case when lang = 'de' then 'x' else ckey end as ckey from root where source >= 'src12') b on a.path = b.path
where a.path is null or b.path is null or a.ckey <> b.ckey""")
def archive_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = root(spark, sf_dir)
    new = own.filter("source >= 'src12'").withColumn("ckey", F.when(F.col("lang") == "de", "x").otherwise(F.col("ckey")))
    return sets.archive_diff(own.filter("source < 'src15'"), new)


@query(f"with {ROOT} select doc_id from root where doc_id in (select doc_id from labels where quality = 0)")
def selection_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = root(spark, sf_dir).select(F.col("doc_id").alias("name_hash"), F.explode(F.array(F.lit(1), F.lit(0))).alias("entry_ord"))
    chosen = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("name_hash"))
    return sets.export_selection(entries, chosen).filter("entry_ord = 0").select(F.col("name_hash").alias("doc_id"))


@query("select doc_id, case when toxic = 1 then 134217728 else 0 end + case when quality = 0 then 1 else 0 end as content from labels where toxic = 1 or quality = 0")
def content_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = content(spark, sf_dir).withColumn("content", C.known_content(F.col("content")))
    return own.filter(search.SearchQuery().with_content(0x08000001).predicate())


@query(f"""with {ROOT}, v as (select doc_id, cast('0x' || substr(ckey, 19, 14) as bigint) as b from root)
select doc_id, (b >> 54) & 3 as layout, (b >> 44) & 1023 as chunk, (b >> 30) & 16383 as archive, (b & 1073741823) * 4096 as byte_offset from v""")
def bitfield_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.blocks import static_location

    where = static_location(F.unhex("ckey"), [(k, 10, 14, 30, 4096) for k in range(4)], 2)
    return root(spark, sf_dir).select("doc_id", where.alias("w")).select("doc_id", F.col("w.layout").cast("bigint").alias("layout"), "w.chunk", "w.archive", "w.byte_offset")


@query("""with o as (select o_orderkey, (o_orderkey * 7919) % 256 as high, (o_custkey * 104729 + o_orderkey * 65537) % 4294967296 as low from orders)
select o_orderkey, (high << 2) | (low >> 30) as archive, low & 1073741823 as "offset" from o""")
def index_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 256).alias("high"), ((F.col("o_custkey") * 104729 + F.col("o_orderkey") * 65537) % 4294967296).alias("low"))
    archive, offset = C.unpack_location(F.col("high"), F.col("low"))
    return own.select("o_orderkey", archive.alias("archive"), offset.alias("offset"))


@query("""with t as (select p_partkey as sno_id, p_size % 25 as grp, case when p_partkey % 9 = 0 then ' ' else p_name end as name from part),
n as (select p_partkey as h, 'Base/' || case p_partkey % 3 when 0 then 'meta' when 1 then 'Child' else 'other' end || '/' || p_partkey || case when p_partkey % 2 = 0 then '-4' else '' end as path from part)
select h as name_hash, path as old_path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' || coalesce(n_name, 'Unknown') || '/' || case when trim(name) = '' then cast(sno_id as varchar) else name end || case when h % 2 = 0 then '-4' else '' end || coalesce('.' || lower(substr(n_name, 1, 3)), '') as path
from n join t on h = sno_id left join nation on n_nationkey = grp where h % 3 <> 2""")
def sno_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    toc = part.select(F.col("p_partkey").cast("int").alias("sno_id"), (F.col("p_size") % 25).alias("grp"), F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(F.col("p_name")).alias("name"))
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("grp"), F.col("n_name").alias("group_name"), F.concat(F.lit("."), F.lower(F.substring("n_name", 1, 3))).alias("ext"))
    k = F.col("p_partkey")
    folder = F.when(k % 3 == 0, "meta").when(k % 3 == 1, "Child").otherwise("other")
    names = part.select(k.alias("name_hash"), F.concat(F.lit("Base/"), folder, F.lit("/"), k.cast("string"), F.when(k % 2 == 0, "-4").otherwise("")).alias("path"))
    return resolve.rename_numbered(names, toc, groups)


@query("""with e as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) % 3 as axis from embeddings) select label, cast(axis as integer) as axis, min(v) as low, max(v) as high from e group by label, axis""")
def mesh_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds per axis, the vectors taken as coordinates of three axes in turn."""
    own = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "v"))
    return own.groupBy("label", ((F.col("k") + 1) % 3).cast("int").alias("axis")).agg(F.min("v").alias("low"), F.max("v").alias("high"))


@query("""with f as (select p_partkey, 'SF_' || p_partkey % 4 || ' * Table(' || (33 + p_partkey % 4) || ', SF_' || p_partkey % 4 || ') + SF_' || p_size as f from part)
select p_partkey, cast(len(list_distinct(regexp_extract_all(f, 'SF_[0-9]*'))) as integer) as refs, case when contains(f, 'Table(34,') then 'damage formula' when contains(f, 'Table(35,') then 'cooldown formula' else 'formula' end as kind,
case when contains(f, 'Table(35') then 'cooldown_scalar' else 'damage_scalar' end as class from f""")
def formula_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    f = F.concat(F.lit("SF_"), (k % 4).cast("string"), F.lit(" * Table("), (33 + k % 4).cast("string"), F.lit(", SF_"), (k % 4).cast("string"), F.lit(") + SF_"), F.col("p_size").cast("string"))
    own = table(spark, sf_dir, "part").select("p_partkey", f.alias("f"))
    return own.select("p_partkey", F.size(C.sf_references(F.col("f"))).alias("refs"), C.search_class(F.col("f")).alias("kind"), C.formula_class(F.col("f")).alias("class"))


@query("""select page_id, regexp_extract(url, '[^/\\\\]*$') as base, case when regexp_matches(lower(url), '\\.(blp|tex)$') then 'image' else 'other' end as kind from pages""")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.base_name(F.col("url")).alias("base"), C.file_class(F.col("url")).alias("kind"))


@query("""with s as (select doc_id, octet_length(encode(text)) as n from documents) select doc_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KiB', n / 1024.0) else printf('%.2f MiB', n / 1048576.0) end as size from s""")
def size_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.size_text(F.octet_length("text")).alias("size"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then 4294967295 when c_custkey % 3 = 1 then 18 else 32 end as locale from customer""")
def locale_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    codes = F.when(k == 0, "xx,??").when(k == 1, "enUS frFR").otherwise("dede|zz")
    return table(spark, sf_dir, "customer").select("c_custkey", C.parse_locale(codes).alias("locale"))


@query("""select s_suppkey, case s_suppkey % 5 when 0 then 'WorldOfWarcraft' when 1 then 'DiabloRTL2' when 2 then 'DiabloRTL' when 3 then 'StarCraft' end as game from supplier""")
def game_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    uid = F.when(k == 0, "wow_beta").when(k == 1, "drtl2x").when(k == 2, "drtl").when(k == 3, "s1").otherwise("zzz")
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.game_type(uid).alias("game"))


@query("""with s as (select c_custkey % 500 as k, 0 as storage, c_custkey as seq from customer where c_mktsegment < 'F' union all select c_custkey % 500, 1, c_custkey from customer where c_mktsegment >= 'F' union all select c_custkey % 500, 1, c_custkey + 7 from customer where c_acctbal < 0),
r as (select *, row_number() over (partition by k order by storage, seq) as n from s) select k, storage, seq from r where n = 1""")
def storage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = (F.col("c_custkey") % 500).alias("k")
    first = c.filter("c_mktsegment < 'F'").select(key, F.col("c_custkey").alias("seq"))
    second = c.filter("c_mktsegment >= 'F'").select(key, F.col("c_custkey").alias("seq")).unionByName(c.filter("c_acctbal < 0").select(key, (F.col("c_custkey") + 7).alias("seq")))
    return sets.storage_union([first, second], ["k"], ["seq"])


@query("""with a as (select o_custkey as h, min(o_orderpriority) as p from orders group by 1), b as (select c_custkey as h, c_name as p from customer) select coalesce(a.h, b.h) as name_hash, coalesce(a.p, b.p) as path from a full join b on a.h = b.h""")
def listfile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("name_hash")).agg(F.min("o_orderpriority").alias("path"))
    return sets.merge_names(a, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name_hash"), F.col("c_name").alias("path")))


@query("""with a as (select distinct doc_id % 300 as k from documents where lang = 'en'), b as (select distinct doc_id % 300 as k from documents where lang = 'fr') (select k from a except select k from b) union all (select k from b except select k from a)""")
def selection_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("k"), "lang")
    return sets.toggle(own.filter("lang = 'en'").select("k").distinct(), own.filter("lang = 'fr'").select("k").distinct())


@query(f"with {ROOT} select cast(count(*) as bigint) as entries, cast(count(distinct doc_id % 100) as bigint) as hashes, cast(sum(case when lang <> 'es' then 1 else 0 end) as bigint) as names from root")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = root(spark, sf_dir)
    return search.counts(own.select((F.col("doc_id") % 100).alias("name_hash")), own.filter("lang <> 'es'"))


@query()
def jenkins_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = root(spark, sf_dir)
    return own.select("path", name_hash(F.col("path")).alias("name_hash")).select("path", C.hash_hex(F.col("name_hash")).alias("hash"))


@query("select doc_id, octet_length(encode(text)) as n, md5(text) as data_md5, cast(null as varchar) as error from documents")
def blte_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through frames of plain, deflated and encrypted blocks and back."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("blob"))

    def frames(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                blobs = [codec.encode([x[:1000], x[1000:5000], x[5000:]], "NZE", {0x1122334455667788: bytes(range(16))}) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], ["doc_id", "blob"])

    keys = spark.createDataFrame([(0x1122334455667788, bytearray(range(16)))], "key_name bigint, key binary")
    back = codec.decoded(own.mapInArrow(frames, "doc_id bigint, blob binary"), keys=keys)
    return back.select("doc_id", F.octet_length("data").cast("bigint").alias("n"), F.md5("data").alias("data_md5"), "error")


@query("select doc_id, md5(text) as data_md5 from documents")
def salsa_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cipher applied twice gives the text again."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))

    def twice(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out = []
                for x in part.column(1).to_pylist():
                    hidden = salsa20(bytes(range(16)), b"12345678", x)
                    assert not x or hidden != x
                    out.append(salsa20(bytes(range(16)), b"12345678", hidden))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["doc_id", "b"])

    return own.mapInArrow(twice, "doc_id bigint, b binary").select("doc_id", F.md5("b").alias("data_md5"))


@query("select doc_id, true as is_text, cast(least(octet_length(encode(text)), 256) as bigint) as dumped from documents where octet_length(encode(text)) > 0")
def text_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b")).filter("octet_length(b) > 0")

    @F.pandas_udf("boolean")
    def is_text(data):
        return data.map(preview.looks_like_text)

    dumped = F.aggregate(C.hex_dump(F.col("b")), F.lit(0), lambda acc, row: acc + F.size(F.split(F.substring(row, 11, 100), " ")))
    return own.select("doc_id", is_text("b").alias("is_text"), dumped.cast("bigint").alias("dumped"))


@query()
def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive index files made of order lines of bounded size, parsed, and audited against their footers."""
    own = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 16).cast("int").alias("archive"), F.unhex(F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("ekey"), F.col("l_quantity").cast("bigint").alias("size"), F.col("l_partkey").alias("offset"))
    packed = own.withColumn("part", F.col("offset") % max(1, own.count() // 8000))

    def build(key, pdf):
        import pandas as pd

        rows = sorted(zip(map(bytes, pdf["ekey"]), pdf["size"], pdf["offset"], strict=True))
        return pd.DataFrame({"file": [f"{key[0]}-{key[1]}"], "blob": [formats.write_archive_index(rows)]})

    files = packed.groupBy("archive", "part").applyInPandas(build, "file string, blob binary")
    return binary.index_audit(files)


ORACLE_SQL["index_files"] = """with p as (select l_orderkey % 16 as a, l_partkey % greatest(1, (select count(*) // 8000 from lineitem)) as b, count(*) as n from lineitem group by 1, 2)
select cast(count(*) as bigint) as files, cast(0 as bigint) as errors, cast(sum(n) as bigint) as entries, cast(sum(n) as bigint) as announced, cast(0 as bigint) as short from p"""
