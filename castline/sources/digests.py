"""Digests of files, kept: only what is new or changed since is opened again."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castline.sources.readers import files

KEPT = "path string, size long, modified timestamp, sha256 string, error string"
#: Bytes of a file that are held at once.
BLOCK = 64 << 10


@dataclass(frozen=True)
class Refreshed:
    """The table of digests, and how many files were opened for it, found unchanged, and gone."""

    digests: DataFrame
    opened: int
    unchanged: int
    gone: int


def digest(path: str) -> str:
    """The SHA-256 of a file's content, read block by block."""
    system, place = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    sha = hashlib.sha256()
    with system.open_input_stream(place) as file:
        while block := file.read(BLOCK):
            sha.update(block)
    return sha.hexdigest()


def with_digests(listed: DataFrame) -> DataFrame:
    """``listed`` files (path, size, modified) with sha256; a file that cannot be read has an error."""

    def run(batches):
        for batch in batches:
            found, errors = [], []
            for path in batch.column(0).to_pylist():
                try:
                    found.append(digest(path))
                    errors.append(None)
                except OSError as broken:
                    found.append(None)
                    errors.append(f"{type(broken).__name__}: {broken}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(errors, pa.string())], names=["path", "size", "modified", "sha256", "error"])

    return listed.select("path", "size", "modified").mapInArrow(run, KEPT)


def versions(spark: SparkSession, kept: str) -> list[str]:
    """The folders of whole versions of a kept table, oldest first; the mark that Spark sets when all is written makes one whole."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(kept)
    system = root.getFileSystem(conf)
    if not system.exists(root):
        return []
    names = sorted(s.getPath().getName() for s in system.listStatus(root) if s.getPath().getName().startswith("v"))
    return [f"{kept}/{name}" for name in names if system.exists(jvm.org.apache.hadoop.fs.Path(f"{kept}/{name}/_SUCCESS"))]


def kept_digests(spark: SparkSession, kept: str) -> DataFrame:
    """The newest whole version of a kept table; no rows if there is none."""
    known = versions(spark, kept)
    return spark.read.schema(KEPT).parquet(known[-1]) if known else spark.createDataFrame([], KEPT)


def refresh_digests(spark: SparkSession, path: str, kept: str, pattern: str = "*", keep_versions: int = 2) -> Refreshed:
    """The digests of the files below ``path``, from the table kept in the folder ``kept`` as far as size and time of change are the same.

    Tasks open the other files only. The table is written as a new version, which counts once it is
    whole: readers see the old one until then, and a run that fails leaves it as it was. If nothing
    changed nothing is written. Files that could not be read are tried again next time. Versions
    before the last ``keep_versions`` are deleted.
    """
    listed = files(spark, path, pattern).select("path", "size", "modified")
    known = kept_digests(spark, kept)
    same = ["path", "size", "modified"]
    fine = known.where("error IS NULL")
    held = listed.join(fine, same)
    new = listed.join(fine, same, "left_anti")
    unchanged, opened = held.count(), new.count()
    gone = known.join(listed, "path", "left_anti").count()
    before = versions(spark, kept)
    if opened or gone or not before:
        # New files are dealt out: those of one folder, listed together, may be many.
        fresh = with_digests(new.repartition(max(1, min(opened // 16 + 1, spark.sparkContext.defaultParallelism * 4)), "path"))
        number = int(before[-1].rsplit("/v", 1)[1].split("-")[0]) + 1 if before else 1
        held.select(*fresh.columns).unionByName(fresh).write.parquet(f"{kept}/v{number:09d}-{uuid.uuid4().hex[:8]}")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for old in versions(spark, kept)[:-keep_versions]:
            place = jvm.org.apache.hadoop.fs.Path(old)
            place.getFileSystem(conf).delete(place, True)
    return Refreshed(kept_digests(spark, kept), opened, unchanged, gone)


def same_content(digests: DataFrame) -> DataFrame:
    """Groups of files with equal content: sha256, files, bytes that copies take, and the paths in order."""
    groups = digests.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.count("*").alias("files"), (F.sum("size") - F.max("size")).alias("spare_bytes"), F.array_sort(F.collect_list("path")).alias("paths"))
    return groups.where("files > 1")
