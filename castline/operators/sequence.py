"""Operators on ordered rows: fill, runs, records, spans, numbering. All are windows over a document's own order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UP_TO_NOW = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def fill_down(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last value that was not null, this row's included."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*UP_TO_NOW)))


def fill_sections(rows: DataFrame, by: Sequence[str], order: Sequence[str], section: Column, scene: Column) -> DataFrame:
    """Section and scene of each row; a new section starts without a scene."""
    seen = fill_down(rows, by, order, section, "section").withColumn("_run", F.count(section).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*UP_TO_NOW)))
    return fill_down(seen, [*by, "_run"], order, scene, "scene").drop("_run")


def number_runs(rows: DataFrame, by: Sequence[str], order: Sequence[str], starts: Column, name: str = "run") -> DataFrame:
    """How many starts there were up to each row."""
    return rows.withColumn(name, F.count_if(starts).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*UP_TO_NOW)))


def changes(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str = "island") -> DataFrame:
    """Numbers of runs of equal values, null being a value like others."""
    before = F.lag(F.struct(value.alias("v"))).over(Window.partitionBy(*by).orderBy(*order))
    marked = rows.withColumn("_new", before.isNull() | ~before["v"].eqNullSafe(value))
    return number_runs(marked, by, order, F.col("_new"), name).drop("_new")


def merge_continuations(lines: DataFrame, by: Sequence[str], order: str, starts: Column, value: str) -> DataFrame:
    """One row for each start with the texts of what follows it joined by spaces; rows before any start are left out."""
    runs = number_runs(lines, by, [order], starts).where("run > 0")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda p: p[value])
    return runs.groupBy(*by, "run").agg(F.min(order).alias(order), F.count("*").alias("lines"), F.array_join(parts, " ").alias(value))


def latch(rows: DataFrame, by: Sequence[str], order: Sequence[str], flag: Column, name: str) -> DataFrame:
    """True from the first row on where the flag is true."""
    return rows.withColumn(name, F.coalesce(F.bool_or(flag).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*UP_TO_NOW)), F.lit(False)))


def assemble_records(rows: DataFrame, by: Sequence[str], order: str, start: Column, middle: Column, end: Column, boundary: Column, keep: dict[str, Column]) -> DataFrame:
    """Records of a start, the first middle after it and the first end after that.

    A boundary or another start ends a record; incomplete ones are left out. ``keep`` names what
    is taken from the start's row.
    """
    marked = rows.withColumns({"_start": start & ~boundary, "_middle": middle & ~boundary, "_end": end & ~boundary, "_boundary": boundary})
    parts = number_runs(marked, by, [order], F.col("_start") | F.col("_boundary"), "record")
    first = Window.partitionBy(*by, "record")
    parts = parts.withColumn("middle_at", F.min(F.when(F.col("_middle"), F.col(order))).over(first))
    made = parts.groupBy(*by, "record").agg(
        *[F.first(F.when(F.col("_start"), c), ignorenulls=True).alias(n) for n, c in keep.items()],
        F.bool_or("_start").alias("_has"), F.min("middle_at").alias("middle_at"), F.min(F.when(F.col("_end") & (F.col(order) > F.col("middle_at")), F.col(order))).alias("end_at"),
    )
    return made.where("_has AND end_at IS NOT NULL").drop("_has")


def renumber(rows: DataFrame, by: Sequence[str], seq: str, order: Sequence[Column]) -> DataFrame:
    """The body counted from 1 in order; rows with a seq of zero or less keep theirs."""
    body = rows.where(F.col(seq) > 0).withColumn(seq, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast(rows.schema[seq].dataType))
    return rows.where(F.col(seq) <= 0).unionByName(body)


def splice(rows: DataFrame, new: DataFrame, by: Sequence[str], seq: str, after: int, inherit: Sequence[str] = ()) -> DataFrame:
    """New rows put after a seq in each document that has it; they take over columns of the row before.

    Their own seq is their order. The preamble cannot be spliced into.
    """
    if after <= 0:
        raise ValueError(f"cannot insert after seq {after}: it lies in the preamble")
    anchors = rows.where(F.col(seq) == after).select(*by, *[F.col(c).alias(f"_{c}") for c in inherit])
    inserted = new.join(anchors, list(by)).select(*[F.col(f"_{c}").alias(c) if c in inherit else F.col(c) for c in rows.columns])
    parts = rows.withColumns({"_at": F.col(seq), "_part": F.lit(0)}).unionByName(inserted.withColumns({"_at": F.lit(after), "_part": F.lit(1)}))
    return renumber(parts, by, seq, [F.col("_at"), F.col("_part"), F.col(seq)]).drop("_at", "_part")


def delete_range(rows: DataFrame, by: Sequence[str], seq: str, start: int, end: int) -> DataFrame:
    """Without the seqs from start to end, the rest counted anew."""
    if start <= 0:
        raise ValueError(f"cannot delete from seq {start}: it lies in the preamble")
    return renumber(rows.where(~F.col(seq).between(start, end)), by, seq, [F.col(seq)])


def unpaired_markers(rows: DataFrame, by: Sequence[str], order: str, opens: Column, closes: Column) -> DataFrame:
    """Opening and closing markers without a partner, as a stack would leave them.

    A close is unpaired if the depth reaches a new low there; an open, if the depth never returns
    below it later on. No row waits for another: both are running minima.
    """
    marks = rows.where(opens | closes).withColumn("_step", F.when(opens, 1).otherwise(-1))
    run = Window.partitionBy(*by).orderBy(order)
    marks = marks.withColumn("_depth", F.sum("_step").over(run.rowsBetween(*UP_TO_NOW)))
    marks = marks.withColumn("_low", F.least(F.lit(0), F.coalesce(F.min("_depth").over(run.rowsBetween(*BEFORE)), F.lit(0))))
    # Backwards, as a frame that only grows costs one step a row.
    later = F.min("_depth").over(Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(*BEFORE))
    marks = marks.withColumn("_later", later)
    lonely = F.when(F.col("_step") < 0, F.col("_depth") < F.col("_low")).otherwise(F.col("_later").isNull() | (F.col("_later") >= F.col("_depth")))
    return marks.where(lonely).withColumn("kind", F.when(F.col("_step") > 0, "open").otherwise("close")).drop("_step", "_depth", "_low", "_later")


def unclosed_loops(rows: DataFrame, by: Sequence[str], order: str, starts: Column, stops: Column) -> DataFrame:
    """Loops that are followed by another loop or by nothing, not by a stop."""
    marks = rows.where(starts | stops).withColumn("_stop", stops)
    after = F.lead("_stop").over(Window.partitionBy(*by).orderBy(order))
    return marks.withColumn("_after", after).where(~F.col("_stop") & ~F.coalesce("_after", F.lit(False))).drop("_stop", "_after")


def first_of(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; where the order is plain columns, tasks keep one row of a key before they shuffle."""
    if all(isinstance(c, str) for c in order):
        return rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_first")).select("_first.*")
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def numbered(rows: DataFrame, coarse: Sequence[Column], order: Sequence[Column | str], name: str) -> DataFrame:
    """All rows numbered from 1 in one order, without bringing them into one task.

    ``coarse`` are what the order goes by first, made rough (a flag, the first letters of a name):
    rows are numbered within each of these values, and what is before it is a running sum over one
    row for each value. So they should be few enough for one task, and many enough to deal out the rows.
    """
    keys = [f"_coarse_{i}" for i in range(len(coarse))]
    keyed = rows.withColumns(dict(zip(keys, coarse)))
    sizes = keyed.groupBy(*keys).count()
    # Null values are values as well, and come first, as they do in an ascending order.
    running = Window.orderBy(*[F.asc_nulls_first(k) for k in keys]).rowsBetween(*BEFORE)
    before = sizes.select(*[F.col(k).alias(f"{k}_") for k in keys], F.coalesce(F.sum("count").over(running), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    met = keyed.withColumn("_own", own).join(before, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    return met.select(*rows.columns, (F.col("_own") + F.col("_before")).alias(name))
