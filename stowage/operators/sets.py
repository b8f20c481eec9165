"""Unions that keep one side, selections, and differences of archives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .unique import first_wins


def storage_union(storages: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """The rows of all storages, each key from the first storage (and row) that has it. An empty storage takes no number."""
    if not storages:
        raise ValueError("no storage")
    each = reduce(DataFrame.unionByName, [s.withColumn("storage", F.lit(k)) for k, s in enumerate(storages)])
    return first_wins(each, keys, ["storage", *order])


def merge_names(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(name_hash, path): names that are there stay; new hashes are added."""
    both = existing.select("name_hash", "path").withColumn("side", F.lit(0)).unionByName(new.select("name_hash", "path").withColumn("side", F.lit(1)))
    return first_wins(both, ["name_hash"], ["side"]).drop("side")


def add_selected(selection: DataFrame, more: DataFrame) -> DataFrame:
    return selection.union(more.select(*selection.columns)).distinct()


def toggle(selection: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that are on one side only."""
    return selection.join(rows, selection.columns, "left_anti").distinct().union(rows.select(*selection.columns).join(selection, selection.columns, "left_anti").distinct())


def export_selection(entries: DataFrame, selection: DataFrame) -> DataFrame:
    """The first variant of each selected hash."""
    return first_wins(entries.join(selection.select("name_hash").distinct(), "name_hash", "left_semi"), ["name_hash"], ["entry_ord"])


def archive_diff(old: DataFrame, new: DataFrame, key: str = "path", content: str = "ckey") -> DataFrame:
    """(key, change): added, removed or changed. An addition to what the archives offer, by one full outer join."""
    a, b = old.select(key, F.col(content).alias("_a")), new.select(key, F.col(content).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def count_by(report: DataFrame, status: str | Column = "status") -> DataFrame:
    return report.groupBy(status).count()
