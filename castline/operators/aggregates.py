"""Summaries: per speaker, per document, per episode, and cross tables with a total row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castline.functions.exact import round_exact
from castline.functions.text import generation_seconds, text, word_count


def speaker_stats(entries: DataFrame, by: Sequence[str] = (), speaker: str = "speaker", order: str = "seq") -> DataFrame:
    """Lines, words and characters of each speaker with their shares in per cent, one decimal.

    ``entries`` holds dialogue only. Rows are ranked by lines, equal ones by first appearance; a
    null speaker counts as an empty one.
    """
    who = text(speaker).alias("speaker")
    sums = entries.groupBy(*by, who).agg(
        F.count("*").alias("lines"), F.sum(word_count(F.col("text"))).alias("words"), F.sum(F.length(text("text"))).cast("long").alias("chars"), F.min(order).alias("first_seen")
    )
    whole = Window.partitionBy(*by)
    share = lambda c: round_exact(F.col(c) / F.greatest(F.sum(c).over(whole), F.lit(1)) * 100, F.lit(1))
    ranked = sums.withColumns({f"pct_{c}": share(c) for c in ("lines", "words", "chars")})
    return ranked.withColumn("place", F.row_number().over(whole.orderBy(F.desc("lines"), "first_seen", "speaker"))).drop("first_seen")


def document_stats(entries: DataFrame, by: Sequence[str], body_only: bool = False) -> DataFrame:
    """Counts of entries, dialogue characters, sorted speakers and sections of each document.

    Blank sections are left out; blank speakers count, unless ``body_only``, which also leaves out
    entries with a seq of zero or less.
    """
    rows = entries.where("seq > 0") if body_only else entries
    spoken = F.col("type") == "dialogue"
    speaker = F.when(spoken & (text("speaker") != ""), F.col("speaker")) if body_only else F.when(spoken, text("speaker"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("total_entries"),
        F.count_if(spoken).alias("dialogue_lines"),
        F.count_if(F.col("type") == "direction").alias("direction_lines"),
        F.coalesce(F.sum(F.when(spoken, F.length(text("text")))), F.lit(0)).cast("long").alias("characters_for_tts"),
        F.array_sort(F.collect_set(speaker)).alias("speakers"),
        F.array_sort(F.collect_set(F.when(text("section") != "", F.col("section")))).alias("sections"),
    )


def episode_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Dialogue lines, words and characters of each episode."""
    spoken = F.col("type") == "dialogue"
    return rows.groupBy(*by).agg(
        F.count_if(spoken).alias("dialogue_lines"),
        F.coalesce(F.sum(F.when(spoken, word_count(F.col("text")))), F.lit(0)).alias("words"),
        F.coalesce(F.sum(F.when(spoken, F.length(text("text")))), F.lit(0)).cast("long").alias("tts_chars"),
    )


def episode_order(season: str = "season", episode: str = "episode") -> list[Column]:
    """Show, season, episode, tag; what is no number comes after all numbers."""
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(999))
    return [F.col("show"), number(season), number(episode), F.col("tag")]


def cross_table(rows: DataFrame, by: str, tier: Column, tiers: Sequence[str], total: str = "TOTAL") -> DataFrame:
    """How many rows of each ``by`` are in each tier, zero where none are, and a row of totals.

    One aggregation with a rollup makes both: there is no second pass for the totals.
    """
    counts = [F.count_if(F.coalesce(tier == name, F.lit(False))).alias(name) for name in tiers]
    table = rows.rollup(by).agg(*counts, F.count("*").alias("all"), F.grouping(by).alias("_total"))
    return table.withColumn(by, F.when(F.col("_total") == 1, total).otherwise(F.col(by))).drop("_total")


def tally(rows: DataFrame, tier: Column, tiers: Sequence[str]) -> DataFrame:
    """Rows in each of the given tiers, zero for absent ones."""
    dim = rows.sparkSession.createDataFrame([(t, i) for i, t in enumerate(tiers)], "tier string, place int")
    return dim.join(rows.groupBy(tier.alias("tier")).count(), "tier", "left").select("tier", "place", F.coalesce("count", F.lit(0)).alias("rows"))


def split_totals(rows: DataFrame, by: str, chosen: Column, amount: Column, total: str = "TOTAL") -> DataFrame:
    """Rows and amounts of each ``by``, chosen and not, with a row of totals."""
    pick = lambda flag, value: F.coalesce(F.sum(F.when(flag, value)), F.lit(0)).cast("long")
    table = rows.rollup(by).agg(
        F.count_if(chosen).alias("chosen_rows"), pick(chosen, amount).alias("chosen_amount"), F.count_if(~chosen).alias("skipped_rows"), pick(~chosen, amount).alias("skipped_amount"), F.grouping(by).alias("_total")
    )
    return table.withColumn(by, F.when(F.col("_total") == 1, total).otherwise(F.col(by))).drop("_total")


def credit_budget(rows: DataFrame, by: str, seconds: Column, rate: int = 40) -> DataFrame:
    """Seconds and credits of each category: the sum cut to whole credits, and each cue's own rounded up."""
    return rows.groupBy(by).agg(
        F.count("*").alias("cues"), (F.sum(seconds) * rate).cast("long").alias("credits_cut"), F.sum(F.ceil(generation_seconds(seconds) * rate)).alias("credits_up")
    )


def stage_status(inputs: DataFrame, outputs: DataFrame, key: str, at: str) -> DataFrame:
    """MISSING without outputs, STALE if an input is newer than all outputs, else OK."""
    new_in = inputs.groupBy(key).agg(F.max(at).alias("newest_input"))
    new_out = outputs.groupBy(key).agg(F.max(at).alias("newest_output"), F.min(at).alias("oldest_output"), F.count("*").alias("output_count"))
    status = F.when(F.col("newest_output").isNull(), "MISSING").when(F.col("newest_input") > F.col("newest_output"), "STALE").otherwise("OK")
    return new_in.join(new_out, key, "full").withColumn("status", status).withColumn("output_count", F.coalesce("output_count", F.lit(0)))


def worst(rows: DataFrame, by: str, status: str = "status") -> DataFrame:
    """The worst status of each ``by``: MISSING before STALE before OK."""
    rank = F.when(F.col(status) == "MISSING", 2).when(F.col(status) == "STALE", 1).otherwise(0)
    return rows.groupBy(by).agg(F.max_by(status, rank).alias("worst"))


def keep_latest(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.max(value).alias("latest"))


def deduped_pool(assets: DataFrame, key: Sequence[str], order: Sequence[Column], place: str) -> DataFrame:
    """One asset of each key, the first by ``order``, with the sorted distinct places of the others."""
    ranked = assets.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    others = ranked.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(F.col("_rank") > 1, F.col(place)))).alias("also_in"))
    return ranked.where("_rank = 1").drop("_rank").join(others, list(key))


def loudness(samples: DataFrame, by: Sequence[str], at_ms: str, sample: str, full_scale: int = 32768, chunk_ms: int = 500) -> DataFrame:
    """RMS in decibels of the quietest chunk above -96 dB, and the peak, of each recording."""
    chunks = samples.groupBy(*by, F.floor(F.col(at_ms) / chunk_ms).alias("chunk")).agg(F.floor(F.sqrt(F.avg(F.col(sample).cast("double") * F.col(sample)))).alias("rms"), F.max(F.abs(sample)).alias("peak"))
    db = lambda c: F.when(F.col(c) > 0, 20 * F.log10(F.col(c) / full_scale))
    return chunks.withColumns({"rms_db": db("rms"), "peak_db": db("peak")}).groupBy(*by).agg(F.min(F.when(F.col("rms_db") > -96, F.col("rms_db"))).alias("quietest_db"), F.max("peak_db").alias("peak_db"))
