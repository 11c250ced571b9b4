"""Uploaded projects: archives and single files as rows of files."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 256 << 20
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError)
MEMBER = "upload string, path string, size long, data binary, error string"


def unpacked(uploads: DataFrame, most: int = MOST) -> DataFrame:
    """A row for each file of each upload (path, content): a ZIP archive's members, or the file itself.

    Other archives stay files. An archive that can't be read gives one row that says so; members that are
    damaged, larger than ``most`` bytes unpacked, or whose paths lead out of the project are refused one
    by one in the same way. One member at a time is in memory, and no more of it than ``most``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(*row) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [x.split()[0] for x in MEMBER.split(", ")])

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name, data = (path or "").rpartition("/")[2], content.as_py() or b""
                if not name.endswith(".zip"):
                    yield one(path, name, len(data), data, None)
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as archive:
                        for member in archive.infolist():
                            if member.is_dir():
                                continue
                            if member.filename.startswith("/") or ".." in member.filename.split("/"):
                                yield one(path, member.filename, None, None, "path leads out of the project")
                                continue
                            try:
                                with archive.open(member) as part:
                                    found = part.read(most + 1)  # what the archive says of the size may be wrong
                            except BROKEN as e:
                                yield one(path, member.filename, None, None, f"{type(e).__name__}: {e}")
                                continue
                            if len(found) > most:
                                yield one(path, member.filename, None, None, "too large")
                            else:
                                yield one(path, member.filename, len(found), found, None)
                except BROKEN as e:
                    yield one(path, None, None, None, f"{type(e).__name__}: {e}")

    return uploads.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, MEMBER)


def ingest(spark: SparkSession, folder: str) -> DataFrame:
    """All uploads in a folder of any file system that Spark reads."""
    return unpacked(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content"))


def upload_totals(members: DataFrame) -> DataFrame:
    """Files, bytes and errors of each upload; one without any file is no valid project."""
    ok = F.col("error").isNull()
    rows = members.groupBy("upload").agg(F.count(F.when(ok, 1)).alias("total_files"), F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0).cast("long")).alias("size"), F.count(F.when(~ok, 1)).alias("errors"))
    return rows.withColumn("valid", F.col("total_files") > 0)
