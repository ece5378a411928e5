"""Sound files and archives: catalogues from headers alone, and samples in blocks that tasks read apart."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from castline.functions.text import base_name
from castline.sources.ranged import file_facts

#: Sound that is read at once, and what does not count as sound.
CHUNK_MS, SILENCE_DB = 500, -96.0
#: Frames of a block of samples, and blocks or chunks that one task reads in a row.
FRAMES, IN_A_ROW = 1 << 18, 64


def sound_library(spark: SparkSession, path: str) -> DataFrame:
    """The MP3 files of a library: path, filename, show (the folder below ``path``, empty for files right there), size, seconds to one decimal, kbps; what has no frame has an error."""
    inside = F.regexp_extract("path", rf"^(?:\w+:)?/*{re.escape(path.split('://')[-1].removeprefix('file:').strip('/'))}/(.*)$", 1)
    show = F.when(F.instr(inside, "/") > 0, F.substring_index(inside, "/", 1)).otherwise("")
    return file_facts(spark, path, "mp3").select("path", base_name(F.col("path")).alias("filename"), show.alias("show"), "size", F.bround("seconds", 1).alias("seconds"), "kbps", "error")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, size, crc, error) of the members of ZIP files, read from their directories alone; a broken archive has one row with an error."""
    return file_facts(spark, path, "zip").select("path", "member", F.col("member_size").alias("size"), "crc", "error")


def decoded(data: bytes, width: int) -> np.ndarray:
    """Samples of one to four bytes as whole numbers; those of one byte are stored without a sign, those of three count as four with a last byte of zero."""
    if width == 1:
        return np.frombuffer(data, np.uint8).astype(np.int64) - 128
    if width == 3:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        return wide.view("<i4").ravel().astype(np.int64)
    return np.frombuffer(data, f"<i{width}").astype(np.int64)


def read_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (path, at, bytes, ..) with ``data``: the bytes of the file from a place on; each task seeks."""

    def run(batches):
        for batch in batches:
            names, opened, file = batch.schema.names, None, None
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                path, at, n = (row.column(names.index(c))[0].as_py() for c in ("path", "at", "bytes"))
                if path != opened:
                    system, place = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                    opened, file = path, system.open_input_file(place)
                file.seek(at)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([file.read(n)], pa.binary())], names=[*names, "data"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("data", BinaryType())]))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of files dealt out over tasks, in runs of some parts of a file each."""
    return rows.repartition("path", F.floor(F.col("part") / IN_A_ROW))


def sound_blocks(spark: SparkSession, path: str, frames: int = FRAMES) -> DataFrame:
    """The samples of the WAV files below a path in blocks of so many frames: path, rate, channels, width, part, data (as stored).

    Headers are read first; each block is then read by the task that it is dealt to, so a long recording is many tasks' work.
    Files that cannot be read have no blocks; ``file_facts`` tells why.
    """
    facts = file_facts(spark, path, "wav").where("frames > 0")
    parts = facts.select("path", "rate", "channels", "width", "frames", "data_at", F.explode(F.sequence(F.lit(0), F.floor((F.col("frames") - 1) / frames))).alias("part"))
    frame = F.col("channels") * F.col("width")
    placed = parts.withColumns({"at": F.col("data_at") + F.col("part") * frames * frame, "bytes": F.least(F.lit(frames), F.col("frames") - F.col("part") * frames) * frame})
    return read_ranges(dealt(placed)).select("path", "rate", "channels", "width", "part", "data")


def sound_chunks(spark: SparkSession, path: str, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """One row for each chunk of the WAV files below a path: path, rate, part, samples, squares (their sum, exact), peak, full_scale.

    Samples of all channels count alike, in one to four bytes.
    """
    facts = file_facts(spark, path, "wav").where("frames > 0")
    begin = lambda part: F.floor(part * chunk_ms * F.col("rate") / 1000)
    last = F.floor(F.ceil(F.col("frames") * 1000 / F.col("rate") / chunk_ms)) - 1
    parts = facts.select("path", "rate", "channels", "width", "frames", "data_at", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long")))).alias("part"))
    frame, start = F.col("channels") * F.col("width"), begin(F.col("part"))
    end = F.least(begin(F.col("part") + 1), F.col("frames"))
    placed = parts.withColumns({"at": F.col("data_at") + start * frame, "bytes": (end - start) * frame}).where("bytes > 0")

    def run(batches):
        for batch in batches:
            rows = []
            for data, width in zip(batch.column(2), batch.column(3).to_pylist()):
                x = decoded(data.as_py(), width)
                high, low = x >> 16, x & 0xFFFF
                squares = (int((high * high).sum()) << 32) + (int((high * low).sum()) << 17) + int((low * low).sum())
                rows.append((len(x), str(squares), int(np.abs(x).max()), 1 << (8 * (4 if width == 3 else width) - 1)))
            columns = [pa.array(c) for c in zip(*rows)] if rows else [pa.array([], k) for k in (pa.int64(), pa.string(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), *columns], names=["path", "rate", "part", "samples", "squares", "peak", "full_scale"])

    read = read_ranges(dealt(placed)).select("path", "rate", "data", "width", "part")
    found = read.mapInArrow(run, "path string, rate long, part long, samples long, squares string, peak long, full_scale long")
    return found.withColumn("squares", F.col("squares").cast("decimal(38,0)"))


def decibels(level: Column, full_scale: Column) -> Column:
    """A level relative to the full scale; minus infinity for silence."""
    return F.when(level > 0, 20 * F.log10(level / full_scale)).otherwise(float("-inf"))


def root_mean_square(squares: Column, samples: Column) -> Column:
    """Cut to a whole number."""
    return F.floor(F.sqrt(squares.cast("double") / samples))


def loudness_profiles(spark: SparkSession, path: str, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Of each WAV file below a path: rms, peak, peak_db, mean_db, and quietest_db, the quietest chunk that is no silence (minus infinity without any)."""
    level = decibels(root_mean_square(F.col("squares"), F.col("samples")), F.col("full_scale"))
    chunks = sound_chunks(spark, path, chunk_ms).withColumn("level", level)
    whole = chunks.groupBy("path").agg(
        F.sum("squares").alias("squares"), F.sum("samples").alias("samples"), F.max("peak").alias("peak"), F.first("full_scale").alias("full_scale"), F.min(F.when(F.col("level") > SILENCE_DB, F.col("level"))).alias("quietest")
    )
    rms = root_mean_square(F.col("squares"), F.col("samples"))
    return whole.select("path", rms.alias("rms"), "peak", decibels(F.col("peak"), F.col("full_scale")).alias("peak_db"), decibels(rms, F.col("full_scale")).alias("mean_db"), F.coalesce("quietest", F.lit(float("-inf"))).alias("quietest_db"))
