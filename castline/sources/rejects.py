"""Rows and rejects from one pass: what a reader leaves out is a second table, not lost."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


@dataclass(frozen=True)
class Split:
    """What was kept, what was rejected (with its reason), and how many rows there were: ``kept`` and each reason."""

    kept: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


def split(tagged: DataFrame, folder: str, reasons: Sequence[str]) -> Split:
    """Rows whose ``reason`` is null, and the others, after one evaluation of ``tagged``.

    Rows are stored below ``folder`` (shared by all executors), the two kinds apart, and counted
    while they are written. The caller deletes the folder when neither table is read any more.
    """
    spark, path = tagged.sparkSession, f"{folder.rstrip('/')}/split-{uuid.uuid4().hex}"
    seen = Observation()
    counted = tagged.observe(seen, F.count_if(F.col("reason").isNull()).alias("kept"), *[F.count_if(F.col("reason") == r).alias(f"reason_{i}") for i, r in enumerate(reasons)])
    counted.withColumn("rejected", F.col("reason").isNotNull()).write.partitionBy("rejected").parquet(path)
    rows = spark.read.schema(StructType([*tagged.schema.fields, StructField("rejected", BooleanType())])).parquet(path)
    found = seen.get
    return Split(rows.where("NOT rejected").drop("rejected", "reason"), rows.where("rejected").drop("rejected"), {"kept": found["kept"]} | {r: found[f"reason_{i}"] for i, r in enumerate(reasons)})
