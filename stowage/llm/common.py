"""What the operators of this subpackage share: the shared folder, lineage cuts, files on any store."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset a local-mode session gets a temporary folder; a cluster is refused.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = getattr(sc, "_stowage_dir", None) or f"file://{tempfile.mkdtemp(prefix='stowage-')}"
        sc._stowage_dir = found
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame, bare: bool = False) -> DataFrame:
    """Write df to the shared folder, so that what follows neither recomputes it nor needs its executors.

    bare: forget the plan's estimate of its size too. A checkpoint keeps it, a join's is the product of its sides', and in
    a loop these products grow until planning takes longer than the work.
    """
    spark = df.sparkSession
    shared_dir(spark)
    made = df.checkpoint()
    if not bare:
        return made
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(made._jdf.queryExecution().toRdd(), made._jdf.schema(), False), spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder; it goes when the JVM ends."""
    uri = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return uri


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """An executor's way to a folder of the shared store: local, HDFS, S3 or GCS by the URI's scheme."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def modest(spark: SparkSession) -> None:
    """Fewer rows per Arrow batch than Spark's default, unless the session has its own number: documents can be long, and
    an executor holds a batch in the JVM and in Python at once. Results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def trim() -> None:
    """Give freed memory back to the system, where the allocators can: a driver's or a worker's peak shouldn't stay."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def publish(files: pafs.FileSystem, temporary: str, final: str) -> None:
    """Give a finished file its name. A repeated attempt writes equal bytes, so either may win."""
    try:
        files.move(temporary, final)
    except OSError:
        if files.get_file_info(final).type != pafs.FileType.File:
            raise
        files.delete_file(temporary)


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def rows(b: pa.RecordBatch, step: int = 256):
    """The rows of a batch as tuples, a few at a time, so that long texts don't all exist twice."""
    for at in range(0, b.num_rows, step):
        yield from zip(*(b.column(k).slice(at, step).to_pylist() for k in range(b.num_columns)), strict=True)


def batches(found, schema: pa.Schema, most_bytes: int = 8 << 20, most_rows: int = 4096):
    """Record batches of the tuples in found, none much over most_bytes of strings and binaries."""
    held, weight = [], 0
    for row in found:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if weight >= most_bytes or len(held) >= most_rows:
            yield batch(schema, held)
            held, weight = [], 0
    if held:
        yield batch(schema, held)


#: Bits of a sieve.
SIEVE = 1 << 26


def sieve(found: DataFrame, c: str, size: int = SIEVE):
    """A test for arrays of 64-bit hashes that holds for all in column c of found and for few others (all, if found is far
    larger than size): what it clears needs no join. It is a bitmap of size bits (a power of two; 8 MB by default),
    whatever the size of found."""
    at = F.pmod(F.col(c), F.lit(size))
    words = found.select(F.shiftright(at, 5).cast("int").alias("w"), at.bitwiseAND(31).alias("bit")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1, cast(bit as int))")).alias("b")).toArrow()
    bitmap = np.zeros(size >> 5, np.int32)
    bitmap[words.column(0).to_numpy()] = words.column(1).to_numpy()
    shared = found.sparkSession.sparkContext.broadcast(bitmap.view(np.uint32))

    def near(h: np.ndarray) -> np.ndarray:
        own = h.view(np.uint64) & np.uint64(size - 1)
        return (shared.value[(own >> np.uint64(5)).astype(np.int64)] >> (own & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)

    return near
