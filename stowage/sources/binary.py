"""Binary manifests and indices as DataFrames: one task per file, rows streamed, a bad file a row with an error."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import key9
from ..operators.resolve import small
from ..operators.unique import first_wins
from . import formats

ROOT_FIELDS = "name_hash bigint, entry_ord bigint, file_data_id bigint, path string, ckey binary, locale bigint, content bigint"

#: Parser and columns of each kind.
KINDS: dict[str, tuple[Callable[[bytes], Iterator[tuple]], str]] = {
    "local_index": (formats.local_index, "ekey9 binary, archive bigint, offset bigint, size bigint"),
    "archive_index": (formats.archive_index, "ekey binary, size bigint, offset bigint"),
    "encoding": (formats.encoding, "ord bigint, ckey binary, ekeys array<binary>, size bigint"),
    "flat_root": (formats.flat_root, ROOT_FIELDS),
    "manifest_root": (formats.manifest_root, ROOT_FIELDS),
    "install_root": (formats.install_root, ROOT_FIELDS),
    "install_files": (formats.install_files, "name string, ckey binary, size bigint, tags array<string>"),
    "contents": (formats.contents, "ord bigint, grp int, sno_id int, name string"),
    "vfs_files": (formats.vfs_files, "path string, ekey binary, spans int, length bigint"),
}


def blobs(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(file, blob) of files on any store that Spark reads."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("path").alias("file"), F.col("content").alias("blob"))


def parsed(files: DataFrame, kind: str, blob: str = "blob", strict: bool = False) -> DataFrame:
    """(other columns of files, kind's columns, error): the rows of each blob; a malformed one ends in a row with an error
    (after what could be read), or raises if strict."""
    parse, columns = KINDS[kind]
    return table_function(files, parse, columns, blob, strict)


def table_function(files: DataFrame, parse: Callable[[bytes], Iterator[tuple]], columns: str, blob: str = "blob", strict: bool = False) -> DataFrame:
    """A function from bytes to rows, applied to a column of blobs; see parsed()."""
    rest = [c for c in files.columns if c != blob]
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in rest)
    made = files.sparkSession.createDataFrame([], columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        own = to_arrow_schema(made)
        for b in batches:
            for k in range(b.num_rows):
                data = b.column(len(rest))[k].as_py()
                held: list[tuple] = []

                def flush(error: str | None = None, k: int = k, b: pa.RecordBatch = b) -> pa.RecordBatch:
                    n = len(held) + (error is not None)
                    errors = [None] * len(held) + ([error] if error is not None else [])
                    cols = list(zip(*held, strict=True)) if held else [()] * len(own)
                    cols = [[*c, None] if error is not None else list(c) for c in cols]
                    kept = [b.column(j).take(pa.array([k] * n, pa.int64())) for j in range(len(rest))]  # noqa: B023
                    held.clear()
                    return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, f.type) for c, f in zip(cols, own, strict=True)), pa.array(errors, pa.string())], [*rest, *own.names, "error"])

                try:
                    for row in parse(data if data is not None else b""):
                        held.append(row)
                        if len(held) == 8192:
                            yield flush()
                    if held:
                        yield flush()
                except formats.Malformed as e:
                    if strict:
                        raise
                    yield flush(str(e))

    return files.select(*rest, blob).mapInArrow(run, f"{kinds}{', ' if kinds else ''}{columns}, error string")


def newest_indices(files: DataFrame) -> DataFrame:
    """Of the local index files in a listing (file, ...) the lexicographically last of each of the 16 series."""
    name = F.element_at(F.split("file", "/"), -1)
    own = files.withColumn("series", F.regexp_extract(name, r"(?i)^(0[0-9a-f])[^/]*\.idx$", 1)).filter("series <> ''")
    return own.groupBy("series").agg(F.max("file").alias("file"))


def local_indices(spark: SparkSession, folders: list[str], strict: bool = False) -> DataFrame:
    """(ekey9, storage, archive, offset, size): the merged local indices of storages, first seen first: by storage (a
    folder without index files takes no number), series, then record."""
    out, storage = None, 0
    for folder in folders:
        listed = newest_indices(spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(folder).select(F.col("path").alias("file")))
        found = [(r["series"], r["file"]) for r in listed.collect()]  # at most 16
        if not found:
            continue
        rows = parsed(blobs(spark, [f for _, f in found]), "local_index", strict=strict).filter("error is null")
        rows = rows.select("ekey9", F.lit(storage).alias("storage"), "archive", "offset", "size", F.element_at(F.split("file", "/"), -1).alias("series"), F.monotonically_increasing_id().alias("seq"))
        out = rows if out is None else out.unionByName(rows)
        storage += 1
    if out is None:
        raise FileNotFoundError(f"no local index in {folders}")
    return first_wins(out, ["ekey9"], ["storage", "series", "seq"]).drop("series", "seq")


def merge_archive_indices(index: DataFrame, archives: list[str], entries: DataFrame) -> DataFrame:
    """index with the entries(archive_name, ekey, size, offset) of archive indices added; what is there stays, archives
    count by their place in the configuration, offsets beyond 32 bits are passed over."""
    spark = index.sparkSession
    places = spark.createDataFrame([(a, k) for k, a in enumerate(archives)], "archive_name string, archive bigint")
    more = entries.join(small(places), "archive_name").filter((F.col("offset") >= 0) & (F.col("offset") <= 0xFFFFFFFF))
    more = more.select(key9(F.col("ekey")).alias("ekey9"), F.lit(0).alias("storage"), "archive", "offset", "size", F.lit(1).alias("side"))
    return first_wins(index.select("ekey9", "storage", "archive", "offset", "size", F.lit(0).alias("side")).unionByName(more), ["ekey9"], ["side", "archive", "offset"]).drop("side")


def archive_entries(files: DataFrame) -> DataFrame:
    """(archive_name, ekey, size, offset) of archive index blobs (file, blob), named by their files; a malformed file counts
    for nothing."""
    rows = parsed(files, "archive_index").withColumn("archive_name", F.regexp_extract("file", r"([^/]*)\.index$", 1))
    bad = rows.filter("error is not null").select("file").distinct()
    return rows.filter("error is null").join(small(bad), "file", "left_anti").select("archive_name", "ekey", "size", "offset")


def index_audit(files: DataFrame) -> DataFrame:
    """One row over archive index blobs (file, blob): files, errors, entries, entries that footers announce, files short of
    them."""

    def footer(data: bytes) -> Iterator[tuple]:
        yield (formats.archive_footer(data)["count"], sum(1 for _ in formats.archive_index(data)))

    each = table_function(files, footer, "announced bigint, found bigint")
    return each.agg(
        F.count("*").alias("files"),
        F.count("error").alias("errors"),
        F.coalesce(F.sum("found"), F.lit(0)).alias("entries"),
        F.coalesce(F.sum("announced"), F.lit(0)).alias("announced"),
        F.count(F.when(F.col("found") < F.col("announced"), 1)).alias("short"),
    )


def root_entries(files: DataFrame, strict: bool = False) -> DataFrame:
    """The root entries of blobs of the kinds that formats.ROOTS has, told by their first bytes; other kinds are malformed."""

    def parse(data: bytes) -> Iterator[tuple]:
        kind = formats.root_kind(data)
        if kind not in formats.ROOTS:
            raise formats.Malformed(f"a root of kind {kind}")
        yield from formats.ROOTS[kind](data)

    return table_function(files, parse, ROOT_FIELDS, strict=strict)


def vfs_tree(load: Callable[[DataFrame], DataFrame], root: DataFrame, nested: DataFrame) -> DataFrame:
    """(path, ekey) of a virtual file system whose spans may name nested manifests.

    root(ekey) is the first manifest's key, nested(ekey9, full) are the manifests' keys, load(ekey) gives (ekey, data). A
    file of one span whose key is among them is a manifest, whose paths go on below its own. All levels are followed; a
    manifest within itself isn't, and one that can't be had or read is passed over.
    """
    known, files = small(nested.dropDuplicates(["ekey9"])), None
    level = load(root).select(F.col("data").alias("blob"), F.lit("").alias("prefix"), F.array(key9(F.col("ekey"))).alias("above"))
    while True:
        rows = parsed(level, "vfs_files").filter("error is null").select(F.concat("prefix", "path").alias("path"), "ekey", "spans", "above").withColumn("ekey9", key9(F.col("ekey")))
        rows = rows.join(known, "ekey9", "left").withColumn("inner", F.col("full").isNotNull() & (F.col("spans") == 1)).cache()
        plain = rows.filter("not inner").select("path", "ekey")
        files = plain if files is None else files.unionByName(plain)
        inner = rows.filter(F.col("inner") & ~F.array_contains("above", F.col("ekey9")))
        if not inner.take(1):
            return files
        below = inner.select(F.concat("path", F.lit("/")).alias("prefix"), F.concat("above", F.array("ekey9")).alias("above"), F.col("full").alias("ekey"))
        level = below.join(load(below.select("ekey").distinct()), "ekey").select(F.col("data").alias("blob"), "prefix", "above")
