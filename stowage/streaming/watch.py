"""A watched folder of index files as a stream: each new key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.binary import parsed

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch_indices(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """(ekey9, archive, offset, size, file, seen) of new local index records; a key that comes again within the delay is
    dropped, and state older than it goes."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.idx").load(folder)
    rows = parsed(files.select(F.col("path").alias("file"), F.col("modificationTime").alias("seen"), F.col("content").alias("blob")), "local_index")
    return rows.filter("error is null").withWatermark("seen", delay).dropDuplicatesWithinWatermark(["ekey9"])
