"""Timelines: offsets, bands, open spans, loop ends, layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castline.operators.sequence import BEFORE, UP_TO_NOW, changes


def offsets(plans: DataFrame, by: Sequence[str], order: str, duration: Column, background: Column, gap: int = 0) -> DataFrame:
    """Where each row starts: after the durations and gaps of the foreground before it. Background takes no time."""
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(*BEFORE)
    return plans.withColumn("start_ms", F.coalesce(F.sum(F.when(~background, duration + gap).otherwise(0)).over(run), F.lit(0)).cast("long"))


def bands(rows: DataFrame, by: Sequence[str], order: str, label: str, start: str, total: Column) -> DataFrame:
    """Bands of equal labels: from the first timed row of each to the start of the next one or the total.

    Blank labels end a band without starting one; bands without a timed row or without length are left out.
    """
    islands = changes(rows, by, [order], F.col(label)).where(F.coalesce(F.col(label) != "", F.lit(False)))
    placed = islands.groupBy(*by, "island").agg(F.first(label).alias(label), F.min_by(start, F.when(F.col(start).isNotNull(), F.col(order))).alias("start_ms"), F.max(total).alias("total_ms")).where("start_ms IS NOT NULL")
    ends = F.coalesce(F.lead("start_ms").over(Window.partitionBy(*by).orderBy("island")), F.col("total_ms"))
    return placed.withColumn("end_ms", ends).where("end_ms > start_ms").select(*by, label, "start_ms", "end_ms")


def active_spans(rows: DataFrame, by: Sequence[str], order: str, spans: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """For each row the names of the spans open there, in the order of ``spans``.

    A span's columns say where it opens, where it closes, and whether it applies to a row while open
    (for a scope that names a speaker).
    """
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(*UP_TO_NOW)
    names = []
    for name, (opens, closes, applies) in spans.items():
        last = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(run)
        names.append(F.when(F.coalesce(last, F.lit(False)) & applies, name))
    return rows.withColumn("spans", F.array_compact(F.array(*names)))


def loop_ends(rows: DataFrame, by: Sequence[str], order: str, at: str, starts: Column, cues: Column, total: Column) -> DataFrame:
    """The end of each loop: the first cue that is later both in order and in time, or else the total.

    ``at`` is a whole number that never falls with the order, so the nearest later time is that of
    such a cue. The window runs backwards, as a frame that only grows costs one step a row.
    """
    ahead = Window.partitionBy(*by).orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, -1)
    nearest = F.min(F.when(cues, F.col(at))).over(ahead)
    return rows.withColumn("loop_end", F.least(F.coalesce(nearest, total), total)).where(starts)


def layer(plans: DataFrame, name: str, start: Column, end: Column, label: Column) -> DataFrame:
    """Intervals of one layer."""
    return plans.select("*", F.lit(name).alias("layer"), start.alias("start_s"), end.alias("end_s"), label.alias("label"))


def text_map(layers: DataFrame, order: str) -> DataFrame:
    """Lines of a timeline in the order of time, then of the sequence."""
    clock = lambda c: F.format_string("%d:%04.1f", F.floor(F.col(c) / 60).cast("long"), F.col(c) - 60 * F.floor(F.col(c) / 60))
    return layers.orderBy("start_s", order).select(F.concat_ws("  ", clock("start_s"), clock("end_s"), F.rpad("layer", 9, " "), "label").alias("value"))


def span_marker(value: Column) -> Column:
    """ENGAGES or DISENGAGES in a marker's text."""
    return F.when(F.upper(value).contains("DISENGAGES"), "DISENGAGES").when(F.upper(value).contains("ENGAGES"), "ENGAGES")


def span_scope(value: Column) -> Column:
    """The speaker after ENGAGES, in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(value, r"ENGAGES[\s:,-]+(\S+)\s*$", 1)), F.lit(""))
