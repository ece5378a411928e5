"""Writers: CSV with fixed columns, JSON lines, journals, and writes that an unchanged result skips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(value: Column, kind: str) -> Column:
    """A value as text: null empty, ``True`` and ``False``, whole doubles with ``.0``."""
    if kind == "boolean":
        shown = F.when(value, "True").otherwise("False")
    elif kind in ("double", "float"):
        shown = F.when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").when(F.isnan(value), "nan").otherwise(value.cast("string"))
    else:
        shown = value.cast("string")
    return F.when(value.isNull(), "").otherwise(shown)


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One text line for each row, quoted only where needed; missing columns are blank, others are dropped."""
    kinds = dict(rows.dtypes)
    shown = rows.select(*[cell(F.col(c), kinds[c]).alias(c) if c in kinds else F.lit("").alias(c) for c in columns])
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return shown.select(F.concat_ws(",", *[F.when(F.col(c).rlike('[",\r\n]'), quote(F.col(c))).otherwise(F.col(c)) for c in columns]).alias("value"))


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Write CSV part files with CRLF line ends, in the rows' order; the header is a part of its own and the first one."""
    lines = csv_lines(rows, columns)
    header = rows.sparkSession.createDataFrame([(",".join(columns),)], "value string")
    header.unionByName(lines).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def append_journal(records: DataFrame, path: str) -> None:
    """Append records (ts, key or seq or scope, fields) as JSON lines; null fields are written, for they clear."""
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


def fingerprint(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and a sum of row hashes, whatever their order."""
    found = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    return found[0], str(found[1])


def write_if_changed(rows: DataFrame, path: str) -> bool:
    """Write Parquet unless what is there has the same columns and rows; says whether it wrote."""
    spark = rows.sparkSession
    try:
        there = spark.read.parquet(path)
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        there = None
    if there is not None and there.dtypes == rows.dtypes and fingerprint(there) == fingerprint(rows):
        return False
    rows.write.mode("overwrite").parquet(path)
    return True
