"""Exporting blobs to files, with a status row for each."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses: written, skipped as it exists, the block isn't there, the value is bad, the path leaves the folder, no write.
STATUSES = ("ok", "exists", "missing_block", "error", "bad_path", "write_error")
MISSING = ("index_not_found", "missing_file", "short_block", "not_found", "unknown_storage")


def target(path: str, flat: bool) -> str | None:
    """Where a path goes below the folder: mirrored, or its base name only; None if it would leave the folder."""
    clean = path.replace("\\", "/").lstrip("/")
    if flat:
        clean = clean.rpartition("/")[2]
    norm = posixpath.normpath(clean) if clean else "."
    return None if norm in (".", "..") or norm.startswith("../") or "\0" in norm else norm


def targets(items: DataFrame, flat: bool = False) -> DataFrame:
    """A dry run: path and where it would go."""
    p = F.ltrim(F.translate("path", "\\", "/"), F.lit("/"))
    return items.select("path", (F.element_at(F.split(p, "/"), -1) if flat else p).alias("target"))


def export(items: DataFrame, folder: str, flat: bool = False, overwrite: bool = False, parallel: int | None = None) -> DataFrame:
    """items(path, data, error) written below folder; returns (path, target, status, bytes, detail) as they are consumed.

    A file is written under a temporary name of its task attempt and then moved, so a repeated task leaves no half file
    and no other files than the first would have; of paths with the same target one writes (the flat form). Bad rows are
    reported and never end the job. The report is lazy: running it again finds the files there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        attempt, made = TaskContext.get().taskAttemptId(), set()
        for b in batches:
            out = []
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                for path, data, error in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    name = target(path, flat) if path is not None else None
                    status, detail, size = "ok", None, 0
                    if error is not None or data is None:
                        status, detail = ("missing_block" if error in MISSING else "error"), error or "no value"
                    elif name is None:
                        status = "bad_path"
                    else:
                        try:
                            final = f"{root}/{name}"
                            if not overwrite and where.get_file_info(final).type != pafs.FileType.NotFound:
                                status = "exists"
                            else:
                                above = final.rpartition("/")[0]
                                if above not in made:
                                    where.create_dir(above, recursive=True)
                                    made.add(above)
                                temporary = f"{final}.{attempt}.part"
                                with where.open_output_stream(temporary) as f:
                                    f.write(data)
                                where.move(temporary, final)
                                size = len(data)
                        except OSError as e:
                            status, detail = "write_error", str(e)
                    out.append((path, name, status, size, detail))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "target", "status", "bytes", "detail"])

    own = items.select("path", "data", "error")
    if flat:  # rows that share a target meet in one task, so that exactly one of them writes
        own = own.repartition(F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1))
    elif parallel:
        own = own.repartition(parallel)
    return own.mapInArrow(run, "path string, target string, status string, bytes bigint, detail string")


def outcome(report: DataFrame) -> DataFrame:
    """(status, files, bytes) of a report."""
    return report.groupBy("status").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def plan_status(found: Column, exists: Column, overwrite: bool = False) -> Column:
    """What an export would report, before anything is read: the resolve chain's error, then whether the file is there."""
    return F.when(found.isNotNull(), F.when(found == "index_not_found", "missing_block").otherwise("error")).when(exists & F.lit(not overwrite), "exists").otherwise("ok")
