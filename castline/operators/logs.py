"""Production logs: records of what was generated, run by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castline.functions.text import base_name, nonblank
from castline.operators.sequence import number_runs

# How a log names a line that is generated, its back end, and what it saved.
PREFIX = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^|]*\|[A-Z]+\|[^|]*\|[^|]*\|"
BACKENDS = (
    (r"^\s*>\s*\[(\d+)\]\s+(\S+)\s+with\s+(eleven_\S+)\s+\((\d+)\s+chars\)", None),
    (r"^\s*>\s*\[(\d+)\]\s+(\S+)\s+via\s+(gTTS)\s+\((\d+)\s+chars\)", "gtts"),
    (r"(?i)^\s*>\s*\[(\d+)\]\s+(\S+)\s+via\s+(Chatterbox\s+Turbo)\s+\((\d+)\s+chars\)", "chatterbox-turbo"),
    (r"(?i)^\s*>\s*\[(\d+)\]\s+(\S+)\s+via\s+(Chatterbox)\s+\((\d+)\s+chars\)", "chatterbox"),
)
SAVED, DIGEST = r"^\s*Saved:\s+(\S+)", r"^\s*SHA256:\s+([0-9a-fA-F]+)"


def strip_prefix(line: Column) -> Column:
    """A log line without time, level, host and stage."""
    return F.regexp_replace(line, PREFIX, "")


def marked_lines(lines: DataFrame) -> DataFrame:
    """Log lines (.., raw) with what they mean: boundary, start (seq, speaker, backend, char_count), saved and digest; null for what they don't."""
    prefixed = F.col("raw").rlike(PREFIX)
    rows = lines.withColumn("line", strip_prefix(F.col("raw")))
    boundary = F.when(prefixed, F.col("line").rlike(r"^BEGIN\b")).otherwise(F.col("line").rlike(r"^---\s*Phase 1:\s*Generating"))
    start = None
    for pattern, backend in BACKENDS:
        part = lambda i, p=pattern: F.regexp_extract("line", p, i)
        number = lambda i: F.coalesce(part(i).try_cast("long"), F.lit(0).cast("long"))
        found = F.struct(number(1).alias("seq"), part(2).alias("speaker"), (F.lit(backend) if backend else part(3)).alias("backend"), number(4).alias("char_count"))
        start = F.when(F.col("line").rlike(pattern), found) if start is None else start.when(F.col("line").rlike(pattern), found)
    rows = rows.withColumn("boundary", boundary)
    told = lambda pattern: F.when(~F.col("boundary"), nonblank(F.regexp_extract("line", pattern, 1)))
    return rows.withColumns({"start": F.when(~F.col("boundary"), start), "saved": told(SAVED), "digest": told(DIGEST)}).drop("line")


def production_records(lines: DataFrame) -> DataFrame:
    """Records of logs (file, log_date, line_no, raw): a start, the first path saved after it, the first digest after that.

    A run begins at a boundary, which prefixed and plain lines mark differently; boundaries and
    starts end what was incomplete. Runs are counted within their file.
    """
    rows = number_runs(marked_lines(lines), ["file"], ["line_no"], F.col("boundary"), "run_index")
    rows = number_runs(rows, ["file"], ["line_no"], F.col("boundary") | F.col("start").isNotNull(), "record")
    made = rows.groupBy("file", "log_date", "run_index", "record").agg(
        F.first("start", ignorenulls=True).alias("s"), F.min(F.when(F.col("saved").isNotNull(), F.struct("line_no", "saved"))).alias("saved"), F.sort_array(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("line_no", "digest")))).alias("digests")
    )
    after = F.try_element_at(F.filter("digests", lambda d: d["line_no"] > F.col("saved.line_no")), F.lit(1))
    done = made.withColumn("digest", after).where("s IS NOT NULL AND saved IS NOT NULL AND digest IS NOT NULL")
    return done.select("log_date", "file", "run_index", F.col("saved.line_no").alias("log_line"), "s.*", F.col("saved.saved").alias("stem_path"), base_name(F.col("saved.saved")).alias("stem_filename"), F.col("digest.digest").alias("sha256"))


def filter_records(records: DataFrame, since: str | None = None, tag: str | None = None, slug: str | None = None) -> DataFrame:
    """Records from a date on, and of paths that hold a tag or a show's slug in any case."""
    if since:
        records = records.where(F.col("log_date") >= since)
    for part in (tag, slug):
        if part:
            records = records.where(F.upper("stem_path").contains(part.upper()))
    return records
