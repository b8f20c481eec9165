"""The roles of an archive, built from the generic test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import LOCALES
from ..session import table

LANGS = {"en": LOCALES["enUS"], "fr": LOCALES["frFR"], "de": LOCALES["deDE"], "es": LOCALES["esES"]}


def root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, ckey as hex, locale, size): every document as a file whose content key is its text's MD5."""
    lang = F.create_map(*[F.lit(x) for kv in LANGS.items() for x in kv])
    path = F.concat(F.lit("Corpus/"), "source", F.lit("/"), "lang", F.lit("/Doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.md5("text").alias("ckey"), lang[F.col("lang")].cast("bigint").alias("locale"), F.octet_length("text").cast("bigint").alias("size"), "lang", "source")


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): flags from labels."""
    flags = F.when(F.col("toxic") == 1, F.lit(0x08000000)).otherwise(0).bitwiseOR(F.when(F.col("quality") == 0, F.lit(1)).otherwise(0))
    return table(spark, sf_dir, "labels").select("doc_id", flags.cast("bigint").alias("content"))
