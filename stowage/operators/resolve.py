"""The lookup chain name -> hash -> content key -> encoding key -> location, and its neighbours, as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fdid_hash, key9
from .unique import first_wins, last_wins

#: Sizes up to which a side is broadcast on purpose; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 200_000
#: Lengths of packages up to which each gets a join of its own.
MOST_LENGTHS = 32


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count bounded by `most` shows it small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def select_entries(entries: DataFrame, locale: int) -> DataFrame:
    """One entry per hash: the first variant that fits the locale, else the first of any."""
    fits = F.col("locale").bitwiseAND(locale) != 0
    return first_wins(entries, ["name_hash"], [~fits, "entry_ord"])


def index_table(records: DataFrame, order: list[str]) -> DataFrame:
    """One location per nine-byte key, the first seen in order."""
    return first_wins(records, ["ekey9"], order)


def encoding_table(records: DataFrame, order: list[str]) -> DataFrame:
    """One encoding row per content key, the last in order."""
    return last_wins(records, ["ckey"], order)


def reverse_encoding(records: DataFrame, order: list[str]) -> DataFrame:
    """(ekey9, ckey): the content key of each encoding key, the last in order, then in the row's list."""
    each = records.select(*order, "ckey", F.posexplode("ekeys").alias("pos", "ekey")).select(*order, "pos", key9(F.col("ekey")).alias("ekey9"), "ckey")
    return last_wins(each, ["ekey9"], [*order, "pos"]).select("ekey9", "ckey")


def fdid_tables(pairs: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id -> hash, hash -> id), the first wins in each; they needn't be inverses."""
    return first_wins(pairs, ["file_data_id"], order).select("file_data_id", "name_hash"), first_wins(pairs, ["name_hash"], order).select("name_hash", "file_data_id")


def best_ekey(encoding: DataFrame, key_names: DataFrame | None = None) -> DataFrame:
    """(ckey, ekey, size): a single key as it is; of several the first whose first 8 bytes, read little-endian, name a
    known decryption key, else the first. key_names(key_name BIGINT) is small: a user's key file."""
    if key_names is None:
        return encoding.select("ckey", F.element_at("ekeys", 1).alias("ekey"), "size")
    each = encoding.select("ckey", "size", F.posexplode("ekeys").alias("pos", "ekey"))
    name = F.conv(F.hex(F.concat(*[F.substring("ekey", k, 1) for k in range(8, 0, -1)])), 16, -10).cast("bigint")
    marked = each.withColumn("key_name", name).join(small(key_names.select("key_name").distinct().withColumn("known", F.lit(True))), "key_name", "left")
    return first_wins(marked.select("ckey", "size", "pos", "ekey", F.coalesce("known", F.lit(False)).alias("known")), ["ckey"], [~F.col("known"), "pos"]).select("ckey", "ekey", "size")


def resolve(names: DataFrame, entries: DataFrame, encoding: DataFrame | None, index: DataFrame | None, locale: int, key_names: DataFrame | None = None, static: bool = False) -> DataFrame:
    """Every path with its keys and location, and the first stage that failed as an error code: name_not_found,
    encoding_not_found or index_not_found; null where all is found. A static container has no encoding (ckey is ekey) and
    no index. Where entries have an ekey of their own, it counts if the encoding table has none."""
    own = "ekey" in entries.columns
    chosen = select_entries(entries, locale).select("name_hash", "ckey", "locale", "content", *([F.col("ekey").alias("_own")] if own else []))
    found = names.select("name_hash", "path").join(chosen, "name_hash", "left")
    if static:
        found = found.withColumns({"ekey": F.col("ckey"), "size": F.lit(None).cast("bigint")})
    else:
        found = found.join(best_ekey(encoding, key_names), "ckey", "left")
    if own:
        found = found.withColumn("ekey", F.coalesce("ekey", "_own")).drop("_own")
    found = found.withColumn("ekey9", key9(F.col("ekey")))
    if index is None:
        return found.withColumn("error", F.when(F.col("ckey").isNull(), "name_not_found"))
    found = found.join(index.withColumnRenamed("size", "encoded_size"), "ekey9", "left")
    error = F.when(F.col("ckey").isNull(), "name_not_found").when(F.col("ekey").isNull(), "encoding_not_found").when(F.col("offset").isNull(), "index_not_found")
    return found.withColumn("error", error)


def longest_prefix(paths: DataFrame, packages: DataFrame, path: str = "path", package: str = "package", key: str = "package_id", on: Sequence[str] = ()) -> DataFrame:
    """paths with the key of the longest package that is a true prefix (case-sensitive, at any character), else null.

    on: columns of both that must be equal too, such as the file that a path and its packages came from. Packages are a dimension. Where they are few (see small()) and of at most MOST_LENGTHS lengths, each length is a
    broadcast join by equality and nothing is shuffled. Else a path becomes a row per length that some package has.
    """
    # at most as many as the longest package has characters
    lengths = sorted(r[0] for r in packages.select(F.length(package)).distinct().collect() if r[0])
    if not lengths:
        return paths.withColumn(key, F.lit(None).cast(packages.schema[key].dataType))
    same = [f"_on{k}" for k in range(len(on))]
    dims = first_wins(packages.select(*[F.col(c).alias(s) for c, s in zip(on, same, strict=True)], F.col(package).alias("_p"), F.col(key).alias("_k")), [*same, "_p"], ["_k"])
    if len(lengths) <= MOST_LENGTHS and dims.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = paths
        for n in lengths:
            own = F.broadcast(dims.filter(F.length("_p") == n).select(*same, F.col("_p").alias(f"_p{n}"), F.col("_k").alias(f"_k{n}")))
            fits = F.when(F.length(path) > n, F.substring(path, 1, n)) == F.col(f"_p{n}")
            for c, s in zip(on, same, strict=True):
                fits &= F.col(c) == F.col(s)
            out = out.join(own, fits, "left").drop(f"_p{n}", *same)
        return out.select(*paths.columns, F.coalesce(*[f"_k{n}" for n in reversed(lengths)]).alias(key))
    rows = paths.withColumn("_row", F.struct(*paths.columns)).select("_row")
    text = F.col(f"_row.{path}")
    each = rows.select("_row", F.explode_outer(F.filter(F.array(*map(F.lit, lengths)), lambda n: n < F.length(text))).alias("_n"))
    each = each.withColumns({"_p": F.substring(text, F.lit(1), F.col("_n"))} | {s: F.col(f"_row.{c}") for c, s in zip(on, same, strict=True)})
    found = each.join(small(dims), [*same, "_p"], "left")
    best = found.groupBy("_row").agg(F.max_by("_k", F.when(F.col("_k").isNotNull(), F.col("_n"))).alias(key))
    counts = rows.groupBy("_row").count()  # repeated rows stay repeated
    return best.join(counts, "_row").select("_row.*", key, F.explode(F.array_repeat(F.lit(0), F.col("count").cast("int"))).alias("_")).drop("_")


def chains(entries: DataFrame, chain: str, order: list[str], last: Column) -> DataFrame:
    """entries with link: the number of the run within its chain; a run ends with the row for which last holds."""
    from pyspark.sql import Window

    before = Window.partitionBy(chain).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("link", F.coalesce(F.sum(last.cast("int")).over(before), F.lit(0)))


def chain_match(linked: DataFrame, wanted: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """For each wanted row the first row of its run with the wanted package."""
    return first_wins(linked.join(wanted, on, "left_semi"), on, order)


def listfile_hashes(lines: DataFrame, fdids: DataFrame, hashed: Column) -> DataFrame:
    """lines(path, file_data_id) with name_hash: the id's hash if it is known, else the path's."""
    return lines.join(fdids.select("file_data_id", F.col("name_hash").alias("_h")), "file_data_id", "left").withColumn("name_hash", F.coalesce("_h", hashed)).drop("_h")


def rename_numbered(names: DataFrame, toc: DataFrame, groups: DataFrame) -> DataFrame:
    """(name_hash, old_path, path) of paths `base/<folder>/<id>[-sub]` whose id the table of contents knows.

    toc(sno_id, grp, name), groups(grp, group_name, ext); a blank name gives way to the id.
    """
    # fixed values: the five folders
    p = r"(?i)^(base/(?:child|meta|payload|paylow|paymed))/([+-]?[0-9]{1,10})(-.*)?$"
    own = names.withColumns({"_id": F.regexp_extract("path", p, 2).try_cast("int"), "_folder": F.regexp_extract("path", p, 1), "_sub": F.regexp_extract("path", p, 3)}).filter("_id is not null")
    known = toc.join(small(groups), "grp", "left").withColumns({"group_name": F.coalesce("group_name", F.lit("Unknown")), "ext": F.coalesce("ext", F.lit(""))})
    display = F.when(F.trim("name") == "", F.col("_id").cast("string")).otherwise(F.col("name"))
    new = F.concat(F.concat_ws("/", "_folder", "group_name", display), "_sub", "ext")
    return own.join(known, own["_id"] == known["sno_id"]).select("name_hash", F.col("path").alias("old_path"), new.alias("path"))


def candidates_match(wanted: DataFrame, blobs: DataFrame, candidates: Column, key: str, name: str = "path") -> DataFrame:
    """wanted with the first of its candidate names that a blob has, else null."""
    each = wanted.select(key, F.posexplode(candidates).alias("rank", "candidate"))
    have = blobs.select(F.lower(name).alias("_n")).distinct()
    hit = each.join(have, F.lower("candidate") == have["_n"], "left_semi")
    best = first_wins(hit.select(key, "rank", "candidate"), [key], ["rank"]).select(key, F.col("candidate").alias("found"))
    return wanted.join(best, key, "left")


def fallback(local: DataFrame, remote: DataFrame, key: str = "ekey") -> DataFrame:
    """Blobs of a local store, or on any of its errors those of a remote one; data and error of the one that counts."""
    r = remote.select(key, F.col("data").alias("_d"), F.col("error").alias("_e"))
    bad = F.col("error").isNotNull() | F.col("data").isNull()
    joined = local.join(r, key, "left")
    served = bad & F.col("_d").isNotNull() & F.col("_e").isNull()
    return joined.select(*[c for c in local.columns if c not in ("data", "error")], F.when(served, F.col("_d")).otherwise(F.col("data")).alias("data"), F.when(~served, F.col("error")).alias("error"), F.when(served, "remote").when(~bad, "local").alias("served_by"))


def fdid_names(ids: Column) -> Column:
    return fdid_hash(ids)
