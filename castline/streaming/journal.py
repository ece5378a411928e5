"""Edit journals and production logs as streams, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from castline.functions.text import base_name
from castline.operators.logs import marked_lines
from castline.operators.merge import CUE_FIELDS
from castline.sources.readers import JOURNAL

STATE = "ts string, value string, edits long"
OUT = "file string, key string, field string, value string, edits long"


def edits(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (file, key, field, ts, value) from JSON-line journals, told by their paths; malformed lines and other fields are left out."""
    lines = spark.readStream.option("recursiveFileLookup", "true").text(path)
    record = lines.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", JOURNAL).alias("r")).where("r.key IS NOT NULL AND r.fields IS NOT NULL")
    return record.select("file", "r.key", "r.ts", F.explode("r.fields").alias("field", "value")).where(F.col("field").isin(*CUE_FIELDS))


def _last(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ts, value, count = state.get if state.exists else ("", None, 0)
    for rows in batches:
        for t, v in zip(rows["ts"], rows["value"]):
            count += 1
            if (t or "") >= (ts or ""):
                ts, value = t or "", v
    state.update((ts, value, count))
    yield pd.DataFrame({"file": [key[0]], "key": [key[1]], "field": [key[2]], "value": [value], "edits": [count]})


def replay_stream(changes: DataFrame) -> DataFrame:
    """After each batch the fields that changed with their last value by time; null means cleared.

    The state holds one value for each journal, cue and field, however many edits there were.
    """
    return changes.groupBy("file", "key", "field").applyInPandasWithState(_last, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def log_runs(spark: SparkSession, path: str, boundary: str = r"\|BEGIN\b") -> DataFrame:
    """A stream of prefixed log lines: the log (its file's path), the time in the line, the line, and whether a run begins there."""
    lines = spark.readStream.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("log"), "value")
    return lines.withColumn("ts", F.substring_index("value", "|", 1)).withColumn("starts", F.col("value").rlike(boundary)).select("log", "ts", "value", "starts")


def _count_runs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
    before = state.get[0] if state.exists else 0
    rows["run"] = before + rows["starts"].cumsum()
    state.update((int(rows["run"].iloc[-1]),))
    yield rows[["log", "ts", "value", "run"]]


def numbered_runs(lines: DataFrame) -> DataFrame:
    """The lines of ``log_runs`` with the number of their run in their log, 0 before the first.

    The state is one number for each log. Lines count in the order of their times; what a later
    batch brings belongs to the run that was open at the end of the one before.
    """
    return lines.groupBy("log").applyInPandasWithState(_count_runs, "log string, ts string, value string, run long", "run long", "append", GroupStateTimeout.NoTimeout)


def assembled_records(lines: DataFrame, patience_seconds: float | None = None) -> DataFrame:
    """The records of ``production_records`` from a stream of log lines (file, log_date, line_no, raw), with ``complete``.

    A record comes with the batch that holds its digest, wherever the log was cut into batches; the
    lines of a file have to come in order of their batches. The state of a log is its run and at
    most one record. With ``patience_seconds`` a record whose log was silent for so long comes as it
    is, not complete, and is forgotten; a log that goes on after that has no more of it.
    """
    marked = marked_lines(lines).where("boundary OR start IS NOT NULL OR saved IS NOT NULL OR digest IS NOT NULL")
    rows = marked.select("file", "log_date", "line_no", "boundary", F.col("start").isNotNull().alias("begins"), "start.*", "saved", "digest")
    started = ("log_date", "seq", "speaker", "backend", "char_count")

    def assemble(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, line, path, *start = state.get if state.exists else (0, None, None, *[None] * 5)
        made = []
        told = lambda whole, digest: (key[0], start[0], run, line, *start[1:], path, digest, whole)
        if state.hasTimedOut:
            if start[0] is not None:
                made.append(told(False, None))
            line, path, start = None, None, [None] * 5
        else:
            for row in pd.concat(list(batches)).sort_values("line_no", kind="stable").itertuples():
                if row.boundary:
                    run, line, path, start = run + 1, None, None, [None] * 5
                elif row.begins:
                    line, path, start = None, None, [row.log_date, int(row.seq), row.speaker, row.backend, int(row.char_count)]
                elif row.saved is not None and start[0] is not None and path is None:
                    line, path = int(row.line_no), row.saved
                elif row.digest is not None and path is not None:
                    made.append(told(True, row.digest))
                    line, path, start = None, None, [None] * 5
        state.update((run, line, path, *start))
        if patience_seconds is not None and start[0] is not None:
            state.setTimeoutDuration(int(patience_seconds * 1000))
        yield pd.DataFrame(made, columns=["file", "log_date", "run_index", "log_line", *started[1:], "stem_path", "sha256", "complete"]).astype({"log_line": "Int64"})

    held = "run long, line long, path string, log_date string, seq long, speaker string, backend string, char_count long"
    out = "file string, log_date string, run_index long, log_line long, seq long, speaker string, backend string, char_count long, stem_path string, sha256 string, complete boolean"
    patience = GroupStateTimeout.NoTimeout if patience_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    found = rows.groupBy("file").applyInPandasWithState(assemble, out, held, "append", patience)
    return found.withColumn("stem_filename", base_name(F.col("stem_path")))
