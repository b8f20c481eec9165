"""Text sources: listfiles, key/value configurations, bar tables, text roots and key files.

Readers take Spark paths, so any store works; line numbers come from the file's own order (whole files are small).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import LOCALE_ALL, key_from_hex, parse_locale
from ..functions.hashing import name_hash


class BadConfig(ValueError):
    """A configuration line that can't be read."""


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line) of text files, bytes that aren't UTF-8 replaced. Meant for manifests; each file is one row first."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode(F.col("content"), "UTF-8")
    return split_lines(files.select(F.col("path").alias("file"), text.alias("text")))


def split_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """(other columns, line_no, line): the lines of a text column, with either line end."""
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.posexplode(F.split(F.regexp_replace(F.col(text), "^﻿", ""), "\r?\n")).alias("line_no", "line"))


def listfile(numbered: DataFrame, line: str = "line") -> DataFrame:
    """(line_no, file_data_id, path): `id;path` or a path alone; blanks and # lines left out; an id that isn't a number
    belongs to the path."""
    text = F.trim(line)
    own = numbered.withColumn("_t", text).filter((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    number = F.regexp_extract("_t", r"^([0-9]{1,10});", 1).try_cast("bigint")
    fits = number.isNotNull() & (number <= 0xFFFFFFFF)
    return own.select("line_no", F.when(fits, number).alias("file_data_id"), F.when(fits, F.trim(F.regexp_replace("_t", r"^[0-9]{1,10};", ""))).otherwise(F.col("_t")).alias("path"))


def listfile_names(parsed: DataFrame, hashed: Column | None = None) -> DataFrame:
    """(name_hash, path, file_data_id): of equal hashes the last line."""
    from ..operators.unique import last_wins

    return last_wins(parsed.withColumn("name_hash", hashed if hashed is not None else name_hash(F.col("path"))), ["name_hash"], ["line_no"]).select("name_hash", "path", "file_data_id")


def config(numbered: DataFrame, line: str = "line", strict: bool = True) -> DataFrame:
    """(key, values, error): `key = v v ...`; blanks and # lines left out; of equal keys the last. A line without `=` is an
    error: strict raises, else it is a row with a null key."""
    from ..operators.unique import last_wins

    own = numbered.withColumn("_t", F.trim(line)).filter((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    split = F.split("_t", "=", 2)
    bad = own.filter(F.instr("_t", "=") == 0).select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("array<string>").alias("values"), F.concat(F.lit("no value: "), "_t").alias("error"))
    if strict and (found := bad.take(1)):
        raise BadConfig(found[0]["error"])
    values = F.filter(F.split(F.trim(split[1]), r"\s+"), lambda v: v != "")
    good = own.filter(F.instr("_t", "=") > 0).select("line_no", F.trim(split[0]).alias("key"), values.alias("values"))
    good = last_wins(good, ["key"], ["line_no"]).select("key", "values", F.lit(None).cast("string").alias("error"))
    return good if strict else good.unionByName(bad)


def config_first(table: DataFrame, key: str) -> str | None:
    """A key's first value."""
    found = table.filter(F.col("key") == key).select(F.try_element_at("values", F.lit(1))).take(1)
    return found[0][0] if found else None


def vfs_fields(table: DataFrame) -> DataFrame:
    """The `vfs-<digits>` rows."""
    return table.filter(F.col("key").rlike("^vfs-[0-9]+$"))


def key_layouts(table: DataFrame) -> DataFrame:
    """(layout, chunk_bits, archive_bits, offset_bits, flags) of `key-layout-<n>` rows with three numbers or four, by n."""
    numbers = F.transform("values", lambda v: v.try_cast("bigint"))
    own = table.filter(F.col("key").rlike("^key-layout-[0-9]+$")).withColumn("n", numbers).filter(F.size("n") >= 3)
    return own.select(
        F.regexp_extract("key", "([0-9]+)$", 1).cast("int").alias("layout"),
        *[F.element_at("n", k + 1).cast("int").alias(c) for k, c in enumerate(("chunk_bits", "archive_bits", "offset_bits"))],
        F.coalesce(F.try_element_at("n", F.lit(4)), F.lit(0)).alias("flags"),
    ).orderBy("layout")


def bar_table(spark: SparkSession, text: str) -> DataFrame:
    """A table of strings whose header is `Name!TYPE:SIZE` parted by bars (by tabs if the header has a tab and no bar);
    names are cut at `!` and lose their spaces, values are trimmed, short rows end in nulls. row_no keeps the order."""
    rows = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    if not rows:
        raise BadConfig("a table without a header")
    mark = "\t" if "|" not in rows[0] and "\t" in rows[0] else "|"
    names = [n.split("!")[0].replace(" ", "") for n in rows[0].split(mark)]
    schema = ", ".join(["row_no int", *[f"`{n}` string" for n in names]])
    made = []
    for k, row in enumerate(rows[1:]):
        values = [v.strip() for v in row.split(mark)][: len(names)]
        made.append((k, *values, *[None] * (len(names) - len(values))))
    return spark.createDataFrame(made, schema)


def bar_value(table: DataFrame, where: str, value: str, column: str) -> str | None:
    """column of the first row with where = value; without that column, of the first row."""
    if column not in table.columns:
        return None
    own = table.filter(F.col(where) == value) if where in table.columns else table
    found = own.orderBy("row_no").select(column).take(1)
    return found[0][0] if found else None


def text_root(numbered: DataFrame, line: str = "line") -> DataFrame:
    """(path, name_hash, entry_ord, ckey, locale, content) of `path[:LOCALE]|hex` lines; others are passed over."""
    split = F.split(line, r"\|", 2)
    key = key_from_hex(F.trim(split[1]))
    name = F.split(split[0], ":", 2)
    own = numbered.filter(F.col(line).contains("|")).select("line_no", name[0].alias("path"), F.when(F.size(name) > 1, parse_locale(name[1])).otherwise(F.lit(LOCALE_ALL)).alias("locale"), key.alias("ckey")).filter("ckey is not null")
    return own.select("path", name_hash(F.col("path")).alias("name_hash"), F.col("line_no").alias("entry_ord"), "ckey", "locale", F.lit(0).cast("bigint").alias("content"))


def looks_like_text_root(data: Column) -> Column:
    """Whether the first 2 KiB are printable ASCII with a bar."""
    sample = F.hex(F.substring(data, 1, 2048))
    return sample.rlike("^(?:0A|0D|09|[2-6][0-9A-F]|7[0-9A-E])*$") & F.decode(F.substring(data, 1, 2048), "ISO-8859-1").contains("|")


def key_file(numbered: DataFrame, line: str = "line") -> DataFrame:
    """(key_name, key) of `NAME KEY` or `NAME;KEY` lines of 16 and 32 hex digits; all else is passed over."""
    p = r"^\s*([0-9A-Fa-f]{16})[\s;]+([0-9A-Fa-f]{32})(?:\s.*)?$"
    own = numbered.select(F.regexp_extract(line, p, 1).alias("n"), F.regexp_extract(line, p, 2).alias("k")).filter("n <> ''")
    return own.select(F.conv("n", 16, -10).cast("bigint").alias("key_name"), F.try_to_binary("k", F.lit("hex")).alias("key"))


def config_text(values: dict[str, list[str]]) -> str:
    """The text of a configuration; the writer that tests go round with."""
    for k in values:
        if "=" in k or re.search(r"\s", k):
            raise BadConfig(k)
    return "\n".join(f"{k} = {' '.join(v)}" for k, v in values.items()) + "\n"
