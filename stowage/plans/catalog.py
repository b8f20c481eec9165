"""Opening an archive: its configuration on the driver, its tables as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.columns import GAME_PREFIXES, LOCALE_ALL
from ..functions.hashing import name_hash
from ..operators import content, resolve, search
from ..operators.unique import first_wins
from ..sources import binary, blocks, formats, text, trie


class OpenError(ValueError):
    """An archive that can't be opened."""


def game_of(product: str) -> str | None:
    return next((g for p, g in GAME_PREFIXES if product.startswith(p)), None)


def entries_of(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what is in a folder, by Spark's own file system layer."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName(), s.isDirectory()) for s in store.listStatus(path)) if store.exists(path) else []


def folder_case(spark: SparkSession, parent: str, name: str) -> str:
    """The folder of that name: as it is written, else in any case, else the name that was asked for."""
    there = [n for n, d in entries_of(spark, parent) if d]
    return name if name in there else next((n for n in there if n.lower() == name.lower()), name)


def read_text(spark: SparkSession, path: str, most: int = 64 << 20) -> str:
    """A small file's text; by the file system layer, as Spark's readers pass over names that start with a dot."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        raise OpenError(f"no file {path}")
    if store.getFileStatus(place).getLen() > most:
        raise OpenError(f"more than {most} bytes: {path}")
    stream = store.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def parse_config(body: str) -> dict[str, list[str]]:
    """Key/value text of bounded size on the driver, by the rules of sources.text.config."""
    out = {}
    for line in body.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            key, mark, value = line.partition("=")
            if not mark:
                raise text.BadConfig(line)
            out[key.strip()] = value.split()
    return out


def products(info: DataFrame) -> list[str]:
    """The products of a bar table of builds: the Product column, else what follows `tpr/` in CDNPath."""
    rows = info.orderBy("row_no").collect()  # made of a text on the driver
    out = []
    for r in rows:
        d = r.asDict()
        m = re.search(r"tpr/([^/]+)", d.get("CDNPath") or "")
        out.append(d.get("Product") or (m[1] if m else ""))
    return [p for p in out if p]


def choose_product(wanted: str | None, have: list[str]) -> str:
    """Exactly the wanted product, else one that starts with it or that it starts with, else the first."""
    if not have:
        raise OpenError("no product")
    if wanted:
        for fits in (lambda p: p == wanted, lambda p: p.startswith(wanted) or wanted.startswith(p)):
            for p in have:
                if fits(p):
                    return p
    return have[0]


def discover(spark: SparkSession, parents: list[str]) -> list[tuple[str, str]]:
    """(label, folder) of installations one level below parents: folders with a `.build.info`; by label, each once."""
    out = set()
    for parent in parents:
        for name, is_folder in entries_of(spark, parent):
            if is_folder and any(n == ".build.info" for n, _ in entries_of(spark, f"{parent}/{name}")):
                out.add((name, f"{parent}/{name}"))
    return sorted(out)


@dataclass
class Archive:
    """The tables of an open archive. hosts and remote_path tell where its remote copy is, file_index is the key of an index
    of loose files there; a static container has none of them."""

    spark: SparkSession
    folders: list[str]
    entries: DataFrame
    names: DataFrame
    fdids: DataFrame
    encoding: DataFrame | None
    index: DataFrame | None
    store: Callable[[DataFrame], DataFrame]
    config: dict[str, list[str]] = field(default_factory=dict)
    locale: int = 0xFFFFFFFF
    keys: DataFrame | None = None
    hosts: list[str] = field(default_factory=list)
    remote_path: str = ""
    file_index: str | None = None

    def with_names(self, lines: DataFrame) -> Archive:
        """With a listfile's names added; names that are there stay."""
        from ..operators.sets import merge_names

        self.names = merge_names(self.names, text.listfile_names(text.listfile(lines)))
        return self

    def search(self, query: search.SearchQuery) -> DataFrame:
        return search.search(self.entries, self.names, query, self.fdids)

    def find(self, query: str, limit: int = 0) -> DataFrame:
        return search.by_text(self.entries, self.names, query, limit, self.fdids)

    def resolved(self, names: DataFrame | None = None) -> DataFrame:
        """Paths with keys, location and the first error; see operators.resolve.resolve."""
        known = self.keys.select("key_name") if self.keys is not None else None
        return resolve.resolve(self.names if names is None else names, self.entries, self.encoding, self.index, self.locale, known, self.encoding is None)

    def contents(self, names: DataFrame | None = None) -> DataFrame:
        """(path, data, error): every path's content; blobs are read once per key, decoded once, and joined back."""
        rows = self.resolved(names)
        done = self.store(rows.filter(F.col("ekey").isNotNull()).select("ekey").distinct())
        done = done.select("ekey", "data", F.col("error").alias("blob_error"))
        lost = F.when(F.col("data").isNull(), F.coalesce(rows["error"], F.col("blob_error")))
        return rows.join(done, "ekey", "left").select("path", "data", lost.alias("error"))


    def inspect(self, path: str | None = None, file_data_id: int | None = None) -> DataFrame:
        """(path, kind, summary, error) of the file of a path, or of those of an id; see operators.content.inspected."""
        if file_data_id is not None:
            named = self.fdids.filter(F.col("file_data_id") == file_data_id).select("name_hash").withColumn("path", F.lit(f"id {file_data_id}"))
        else:
            named = self.spark.createDataFrame([(path,)], "path string").select(name_hash(F.col("path")).alias("name_hash"), "path")
        got = self.contents(named)
        seen = content.inspected(got.select("path", F.col("data").alias("blob")))
        return seen.withColumnRenamed("error", "_e").join(got.select("path", F.col("error").alias("_g")), "path").select("path", "kind", "summary", F.coalesce("_g", "_e").alias("error"))

#: What serves blobs: (ekey) to (ekey, data, error), decoded, a row for each key.
Store = Callable[[DataFrame], DataFrame]


def local_store(index: DataFrame, folders: list[str], keys: DataFrame | None, mirrors: list[str] | None = None, cache: str | None = None) -> Store:
    """Blobs by the local index; on any failure, be it of the index, the read or the decoder, from the mirrors."""

    def load(wanted: DataFrame) -> DataFrame:
        located = wanted.select("ekey").withColumn("ekey9", F.substring("ekey", 1, 9)).join(index, "ekey9", "left")
        read = blocks.read_blocks(located.filter("offset is not null"), folders).select("ekey", "blob", F.col("error").alias("read_error"))
        done = codec.decoded(read, "blob", "ekey", keys).select("ekey", "data", F.coalesce("read_error", "error").alias("error"))
        here = done.unionByName(located.filter("offset is null").select("ekey", F.lit(None).cast("binary").alias("data"), F.lit("index_not_found").alias("error")))
        if not mirrors:
            return here
        far = blocks.remote_blobs(here.filter("error is not null").select("ekey"), [f"{m}/data" for m in mirrors], cache)
        far = codec.decoded(far.filter("error is null").select("ekey", F.col("data").alias("blob")), "blob", "ekey", keys)
        return resolve.fallback(here, far).select("ekey", "data", "error")

    return load


def static_store(folder: str, config: dict[str, list[str]], keys: DataFrame | None) -> Store:
    """Blobs of a static container, whose keys tell where they are."""
    index_bits = int(config["key-layout-index-bits"][0])
    numbered = ((int(m[1]), v) for k, v in config.items() if (m := re.fullmatch(r"key-layout-([0-9]+)", k)))
    layouts = sorted((n, *map(int, v[:3]), int(v[3]) if len(v) > 3 else 0) for n, v in numbered if len(v) >= 3)
    if not layouts:
        raise OpenError("no key layout")

    def load(wanted: DataFrame) -> DataFrame:
        where = blocks.static_location(F.col("ekey"), layouts, index_bits)
        placed = wanted.select("ekey", where.alias("_w")).select("ekey", F.col("_w.byte_offset").alias("byte_offset"), blocks.candidate_files(F.col("_w")).alias("files"))
        read = blocks.read_static(placed, folder).select("ekey", "blob", F.col("error").alias("read_error"))
        return codec.decoded(read, "blob", None, keys, sniff=True).select("ekey", "data", F.coalesce("read_error", "error").alias("error"))

    return load


def vfs_keys(config: dict[str, list[str]]) -> dict[str, bytes]:
    """The encoding keys of `vfs-root` and `vfs-<n>` fields."""
    hexes = re.compile("[0-9a-fA-F]{32}")
    own = {k: v for k, v in config.items() if re.fullmatch("vfs-(root|[0-9]+)", k) and len(v) > 1}
    return {k: bytes.fromhex(v[1]) for k, v in own.items() if hexes.fullmatch(v[0]) and hexes.fullmatch(v[1])}


def is_vfs_root(config: dict[str, list[str]]) -> bool:
    """Whether a build has a virtual file system and no other root."""
    return "vfs-root" in vfs_keys(config) and not (config.get("root") or ["0"])[0].strip("0")


def is_static(config: dict[str, list[str]]) -> bool:
    return bool(config.get("key-layout-index-bits")) and "encoding" not in config


def vfs_rows(spark: SparkSession, config: dict[str, list[str]], store: Store, encoding: DataFrame | None) -> DataFrame:
    """Root rows of a virtual file system; a key without a content key stands for it."""
    found = vfs_keys(config)
    if "vfs-root" not in found:
        raise OpenError("no virtual file system")
    root = spark.createDataFrame([(bytearray(found["vfs-root"]),)], "ekey binary")
    if not store(root).filter("error is null").take(1):
        raise OpenError("the virtual file system's root can't be read")
    nested = spark.createDataFrame([(bytearray(k[:9]), bytearray(k)) for k in found.values()], "ekey9 binary, full binary")
    files = binary.vfs_tree(store, root, nested).withColumn("ekey9", F.substring("ekey", 1, 9)).withColumn("entry_ord", F.monotonically_increasing_id())
    if encoding is not None:
        files = files.join(resolve.reverse_encoding(encoding.withColumn("_o", F.lit(0)), ["_o"]), "ekey9", "left")
    else:
        files = files.withColumn("ckey", F.lit(None).cast("binary"))
    none = F.lit(None).cast("bigint")
    return files.select(name_hash(F.col("path")).alias("name_hash"), "entry_ord", none.alias("file_data_id"), "path", F.coalesce("ckey", "ekey").alias("ckey"), F.lit(LOCALE_ALL).cast("bigint").alias("locale"), F.lit(0).cast("bigint").alias("content"), "ekey")


def renamed(rows: DataFrame, store: Store, groups: DataFrame | None) -> DataFrame:
    """Root rows with the names that a table of contents (`base/coretoc.dat`) has for numbered paths: these stay under
    their old hash without a path, and are added under the new one. groups(grp, group_name, ext) is the user's table."""
    spark = rows.sparkSession
    toc = rows.filter(F.lower("path") == "base/coretoc.dat").select("ekey").limit(1)
    if not toc.take(1):
        return rows
    known = binary.parsed(store(toc).select(F.col("data").alias("blob")), "contents").filter("error is null")
    known = first_wins(known.select("sno_id", "grp", "name", "ord"), ["sno_id"], ["ord"]).drop("ord")
    groups = groups if groups is not None else spark.createDataFrame([], "grp int, group_name string, ext string")
    new = resolve.rename_numbered(rows.select("name_hash", "path"), known, groups).select("name_hash", F.col("path").alias("new")).cache()
    both = rows.join(new, "name_hash", "left").withColumn("path", F.when(F.col("new").isNull(), F.col("path")))
    more = rows.join(new, "name_hash").withColumns({"path": F.col("new"), "name_hash": name_hash(F.col("new"))})
    return both.drop("new").unionByName(more.drop("new"))


def catalogued(spark: SparkSession, rows: DataFrame, store: Store, **parts) -> Archive:
    """An archive of root rows."""
    rows = rows.cache()
    entries = rows.select("name_hash", "entry_ord", "ckey", "locale", "content", *(["ekey"] if "ekey" in rows.columns else []))
    pairs = rows.filter("file_data_id is not null").select("file_data_id", "name_hash", "entry_ord")
    names = resolve.first_wins(rows.filter("path is not null").select("name_hash", "path", "entry_ord"), ["name_hash"], ["entry_ord"]).drop("entry_ord")
    return Archive(spark=spark, entries=entries, names=names, fdids=resolve.fdid_tables(pairs, ["entry_ord"])[1], store=store, **parts)


def open_static(spark: SparkSession, folder: str, config: dict[str, list[str]], keys: DataFrame | None = None, groups: DataFrame | None = None) -> Archive:
    """A static container: neither encoding table nor index, its root a virtual file system."""
    data = f"{folder}/{folder_case(spark, folder, 'Data')}"
    place = data if entries_of(spark, data) else folder
    store = static_store(place, config, keys)
    rows = renamed(vfs_rows(spark, config, store, None), store, groups)
    return catalogued(spark, rows, store, folders=[place], encoding=None, index=None, config=config, keys=keys)


def static_config(spark: SparkSession, folder: str) -> dict[str, list[str]] | None:
    """The `.build.config` of a static container, in the folder or its Data folder; None if there is none of that kind."""
    for place in (folder, f"{folder}/{folder_case(spark, folder, 'Data')}"):
        try:
            config = parse_config(read_text(spark, f"{place}/.build.config"))
        except ValueError:
            continue
        if is_static(config):
            return config
    return None


def root_rows(spark: SparkSession, config: dict[str, list[str]], store: Store, encoding: DataFrame) -> DataFrame:
    """The rows of the build's root, whatever its kind; of one that isn't known those of its virtual file system, else of
    its install manifest; without either it is an error."""
    if is_vfs_root(config):
        return vfs_rows(spark, config, store, encoding)

    def blob(name: str) -> DataFrame:
        hexes = config.get(name) or []
        found = encoding.filter(F.hex("ckey") == hexes[0].upper()).select(F.element_at("ekeys", 1).alias("ekey")) if hexes else None
        if found is None or not found.take(1):
            raise OpenError(f"the {name} isn't in the encoding table")
        return store(found).select(F.col("data").alias("blob")).cache()

    body = blob("root")
    kind = formats.root_kind(bytes(body.take(1)[0][0] or b""))
    none = F.lit(None).cast("bigint")
    if kind == "text":
        return text.text_root(text.split_lines(body.select(F.decode("blob", "UTF-8").alias("text")))).withColumn("file_data_id", none)
    if kind == "trie":
        return trie.trie_entries(body).filter("status = 'ok'").withColumns({"entry_ord": F.monotonically_increasing_id(), "file_data_id": none})
    if kind in formats.ROOTS:
        return binary.root_entries(body).filter("error is null")
    if "vfs-root" in vfs_keys(config):
        return vfs_rows(spark, config, store, encoding)
    if config.get("install"):
        rows = binary.root_entries(blob("install")).filter("error is null")
        if rows.take(1):
            return rows
    raise OpenError(f"a root of kind {kind}, and neither a virtual file system nor an install manifest")


def read_config(spark: SparkSession, data: str, key: str, mirrors: list[str] | None) -> dict[str, list[str]]:
    """A configuration by its key: the local one, else that of the first mirror that has it."""
    name = f"config/{key[:2]}/{key[2:4]}/{key}"
    for place in (data, *(mirrors or [])):
        try:
            return parse_config(read_text(spark, f"{place}/{name}"))
        except OpenError:
            continue
    raise OpenError(f"no configuration {key}")


def open_archive(spark: SparkSession, folder: str, product: str | None = None, keys: DataFrame | None = None, mirrors: list[str] | None = None, cache: str | None = None, groups: DataFrame | None = None) -> Archive:
    """Open an installation: a static container by its `.build.config`, else `<folder>/.build.info` and what it leads to:
    build configuration, local indices with those of archives, encoding table, and a root of any kind.

    mirrors are folders with `data/` and `config/` below, which serve what isn't there or is broken; cache keeps what they
    served. groups(grp, group_name, ext) names the groups of a table of contents.
    """
    static = static_config(spark, folder)
    if static is not None:
        return open_static(spark, folder, static, keys, groups)
    info = text.bar_table(spark, read_text(spark, f"{folder}/.build.info"))
    chosen = choose_product(product, products(info))
    row = next((r.asDict() for r in info.orderBy("row_no").collect() if (r.asDict().get("Product") or chosen) == chosen), None)
    if row is None:
        raise OpenError(f"no build of {chosen}")
    data = f"{folder}/{folder_case(spark, folder, 'Data')}"
    config = read_config(spark, data, row.get("BuildKey") or "", mirrors)
    storages = [f"{data}/{n}" for n, d in entries_of(spark, data) if d and n in ("data", "ecache")]
    index = binary.local_indices(spark, storages)
    remote = read_config(spark, data, row["CDNKey"], mirrors) if row.get("CDNKey") else {}
    archives = remote.get("archives", [])
    if archives and any(n.endswith(".index") for n, _ in entries_of(spark, f"{data}/indices")):
        index = binary.merge_archive_indices(index, archives, binary.archive_entries(binary.blobs(spark, f"{data}/indices", "*.index")))
    index = index.cache()
    store = local_store(index, storages, keys, mirrors, cache)
    hexes = config.get("encoding") or []
    if len(hexes) < 2:
        raise OpenError("no encoding key")
    table = store(spark.createDataFrame([(bytearray.fromhex(hexes[1]),)], "ekey binary"))
    encoding = resolve.encoding_table(binary.parsed(table.select(F.col("data").alias("blob")), "encoding").filter("error is null"), ["ord"]).cache()
    rows = root_rows(spark, config, store, encoding)
    if "ekey" in rows.columns:
        rows = renamed(rows, store, groups)
    places = {"hosts": (row.get("CDNHosts") or "").split(), "remote_path": row.get("CDNPath") or "", "file_index": next(iter(remote.get("file-index", [])), None)}
    return catalogued(spark, rows, store, folders=storages, encoding=encoding, index=index, config=config, keys=keys, **places)


def probe(spark: SparkSession, folders: list[str], fail_fast: bool = False) -> DataFrame:
    """(folder, passed, entries, error) of each archive; a failure is a row, or raises if fail_fast."""
    out = []
    for folder in folders:
        try:
            out.append((folder, True, open_archive(spark, folder).entries.count(), None))
        except Exception as e:
            if fail_fast:
                raise
            out.append((folder, False, 0, str(e).splitlines()[0][:300]))
    return spark.createDataFrame(out, "folder string, passed boolean, entries bigint, error string")
