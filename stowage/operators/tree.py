"""The folder hierarchy over paths: keys are lower-cased components, so nothing recursive is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import norm_parts, parts
from .unique import first_wins, last_wins

#: Rows that a listing shows per level.
LEVEL = 200


def folder_of(path: Column) -> Column:
    """The lower-cased components above the file."""
    p = norm_parts(path)
    return F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))


def tree_files(names: DataFrame, order: str | None = None) -> DataFrame:
    """(folder_key, file_key, path, name_hash, ...): a row per file, of equal keys the last by order. Paths without a
    component are left out."""
    p = norm_parts(F.col("path"))
    keyed = names.withColumns({"folder_key": folder_of(F.col("path")), "file_key": F.element_at(p, -1)}).filter(F.size(p) > 0)
    return last_wins(keyed, ["folder_key", "file_key"], [order] if order else ["path"])


def folder_names(names: DataFrame, order: str = "path") -> DataFrame:
    """(folder_key, display): each folder's name in the casing that came first."""
    own = names.select(F.col(order).alias("o"), parts(F.col("path")).alias("p")).filter(F.size("p") > 1)
    each = own.select("o", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("n"))
    keyed = each.select(F.transform(F.slice("p", F.lit(1), F.col("n")), F.lower).alias("folder_key"), F.element_at("p", F.col("n")).alias("display"), "o")
    return first_wins(keyed, ["folder_key"], ["o"]).drop("o")


def ancestors(folder_key: Column, root: bool = True) -> Column:
    """All folders that a folder lies in, itself and (if root) the empty one included."""
    n = F.size(folder_key)
    above = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.slice(folder_key, F.lit(1), k))).otherwise(F.array().cast("array<array<string>>"))
    return F.concat(F.array(F.array().cast("array<string>")), above) if root else above


def walk(files: DataFrame, folder: list[str]) -> DataFrame:
    """All files below a folder."""
    want = [f.lower() for f in folder]
    return files.filter(F.slice("folder_key", 1, len(want)) == F.array(*map(F.lit, want))) if want else files


def rollup(files: DataFrame, size: str | None = None) -> DataFrame:
    """(folder, depth, files, bytes) of every folder, with all that lies below it.

    Files are counted per own folder first, so what is exploded into ancestors has a row per folder, not per file.
    """
    per = files.groupBy("folder_key").agg(F.count("*").alias("n"), F.sum(F.col(size) if size else F.lit(0)).alias("b"))
    each = per.select(F.explode(ancestors(F.col("folder_key"))).alias("k"), "n", "b")
    return each.groupBy("k").agg(F.sum("n").alias("files"), F.sum("b").cast("bigint").alias("bytes")).select(F.array_join("k", "/").alias("folder"), F.size("k").alias("depth"), "files", "bytes")


def folder_paths(files: DataFrame) -> DataFrame:
    """Every folder's path once."""
    keys = files.select("folder_key").distinct()
    return keys.select(F.explode(ancestors(F.col("folder_key"), root=False)).alias("k")).distinct().select(F.array_join("k", "/").alias("folder"))


def children(files: DataFrame, folder: list[str]) -> DataFrame:
    """(name, is_folder, files): a folder's listing, one level deep."""
    n = len(folder)
    below = walk(files, folder)
    return (
        below.select(F.when(F.size("folder_key") > n, F.element_at("folder_key", n + 1)).alias("sub"), "file_key")
        .groupBy(F.coalesce("sub", "file_key").alias("name"), F.col("sub").isNotNull().alias("is_folder"))
        .agg(F.count("*").alias("files"))
    )


def listing(files: DataFrame, level: int = LEVEL) -> DataFrame:
    """The first files of every folder by name, at most `level` each: sorted first, then cut.

    Spark keeps no more than `level` rows per folder and task before it shuffles (a window-group limit).
    """
    w = Window.partitionBy("folder_key").orderBy("file_key")
    return files.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= level)
