"""Journal replay, keyed upserts, back-filling, edits and the one-to-one plan of a migration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castline.functions.text import migration_text, text
from castline.operators.aggregates import document_stats

# What an edit may set on a cue.
CUE_FIELDS = ("volume_percentage", "ramp_in_seconds", "ramp_out_seconds", "play_duration", "source")


def last_values(changes: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The last value of each key; null is a value here, for it clears what was there."""
    return changes.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("edits"))


def replay(journal: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What a journal leaves: (key, field, value) of cues, and (field, value) of the defaults; cleared ones are null.

    Cues take the whitelisted fields only, defaults take all.
    """
    fields = journal.select(*order, "key", "scope", F.explode("fields").alias("field", "value"))
    is_default = F.coalesce(F.col("scope") == "defaults", F.lit(False))
    cues = fields.where(~is_default & F.col("key").isNotNull() & F.col("field").isin(*CUE_FIELDS))
    return last_values(cues, ["key", "field"], order, "value"), last_values(fields.where(is_default), ["field"], order, "value")


def replay_rejects(journal: DataFrame, order: Sequence[str], effects: DataFrame) -> DataFrame:
    """What a replay does not take over, or takes over for no known cue: order, key, field, reason.

    Fields that an edit may not set on a cue, and edits of cues that ``effects`` (key) does not hold.
    """
    fields = journal.where("scope IS NULL OR scope != 'defaults'").where("key IS NOT NULL").select(*order, "key", F.explode("fields").alias("field", "value"))
    known = effects.select("key", F.lit(True).alias("_known")).dropDuplicates(["key"])
    reason = F.when(~F.col("field").isin(*CUE_FIELDS), "field that no edit sets").when(F.col("_known").isNull(), "cue that is not there")
    return fields.join(known, "key", "left").withColumn("reason", reason).where("reason IS NOT NULL").select(*order, "key", "field", "reason")


def apply_replay(effects: DataFrame, edits: DataFrame) -> DataFrame:
    """Effects (key, fields map) with edits laid over: set, cleared, or a new orphan cue, which is flagged."""
    pairs = F.map_from_entries(F.collect_list(F.struct("field", "value")))
    laid = edits.groupBy("key").agg(pairs.alias("_edits"))
    joined = effects.withColumn("_known", F.lit(True)).join(laid, "key", "full")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old, new = F.coalesce("fields", empty), F.coalesce("_edits", empty)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return joined.select("key", F.map_concat(kept, F.map_filter(new, lambda _, v: v.isNotNull())).alias("fields"), F.col("_known").isNull().alias("orphan"))


def upsert(manifest: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """New rows laid over old ones of the same key, field by field where they have a value; others are added.

    Of several old rows of a key the last one (``at``) is updated and the others stay; of several
    new ones the last counts.
    """
    last = Window.partitionBy(*key).orderBy(F.desc("at"))
    fresh = new.groupBy(*key).agg(F.max_by(F.struct("at", *columns), "at").alias("_row")).select(*key, "_row.*")
    old = manifest.withColumn("_rank", F.row_number().over(last))
    side = fresh.select(*key, F.lit(1).alias("_rank"), F.lit(True).alias("_new"), F.col("at").alias("_at"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = old.join(side, [*key, "_rank"], "full")
    state = F.when(F.col("_new").isNull(), "kept").when(F.col("at").isNull(), "inserted").otherwise("updated")
    return joined.select(*key, F.coalesce("at", "_at").alias("at"), *[F.coalesce(f"_{c}", c).alias(c) for c in columns], state.alias("state"))


def backfill(config: DataFrame, hints: DataFrame, key: str, value: str, force: bool = False) -> DataFrame:
    """Hints merged into a configuration: added where the key is new, filled where blank, forced if asked for."""
    side = hints.select(key, F.col(value).alias("_hint"))
    joined = config.withColumn("_known", F.lit(True)).join(side, key, "full")
    own, hint = F.nullif(F.col(value).cast("string"), F.lit("")), F.nullif(F.col("_hint").cast("string"), F.lit(""))
    action = F.when(F.col("_known").isNull(), "insert").when(hint.isNull() | own.eqNullSafe(hint), "keep").when(own.isNull(), "fill").otherwise("force" if force else "keep")
    merged = F.when(own.isNull() | F.lit(force), F.coalesce("_hint", value)).otherwise(F.col(value))
    return joined.withColumn("action", action).withColumn(value, merged).drop("_known", "_hint")


def migration_plan(old: DataFrame, new: DataFrame, by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """For each new entry (seq, type, speaker, text) the old stem to take over: EXACT, SPEAKER, NEW or SKIP.

    An entry takes the first old one of its text and speaker, once; a dialogue row without that
    takes the first old one of its text, if no entry before it used the text, and counts as
    SPEAKER if the speaker differs. Two passes of windows do what a loop with two sets would.
    """
    stems = F.col("type").isin("dialogue", "direction")
    role = F.when(F.col("type") == "dialogue", text("speaker")).otherwise("sfx")
    keyed = lambda rows: rows.withColumns({"_text": migration_text(F.col("text"), strict), "_role": role})
    olds, news = keyed(old.where(stems)), keyed(new)
    by_text = olds.groupBy(*by, "_text").agg(F.min_by(F.struct("seq", "speaker"), "seq").alias("_any"))
    by_role = olds.groupBy(*by, "_text", "_role").agg(F.min("seq").alias("_same"))
    met = news.join(by_role, [*by, "_text", "_role"], "left").join(by_text, [*by, "_text"], "left").withColumn("_stem", stems)
    turn = F.row_number().over(Window.partitionBy(*by, "_text", "_role", "_stem").orderBy("seq"))
    met = met.withColumn("_exact", F.col("_stem") & F.col("_same").isNotNull() & (turn == 1))
    uses = F.col("_exact") | (F.col("_stem") & (F.col("type") == "dialogue") & F.col("_any").isNotNull())
    met = met.withColumn("_uses", uses)
    before = F.coalesce(F.count_if("_uses").over(Window.partitionBy(*by, "_text").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    takes = ~F.col("_exact") & F.col("_uses") & (before == 0)
    other = ~F.col("_any.speaker").eqNullSafe(F.col("speaker"))
    status = F.when(~F.col("_stem"), "SKIP").when(F.col("_exact"), "EXACT").when(takes & other, "SPEAKER").otherwise("NEW")
    out = met.withColumn("status", status)
    old_seq = F.when(F.col("status") == "EXACT", F.col("_same")).when(F.col("status") == "SPEAKER", F.col("_any.seq"))
    return out.withColumn("old_seq", old_seq).select(*new.columns, "status", "old_seq")


def set_fields(rows: DataFrame, key: Column, values: dict[str, Column]) -> DataFrame:
    """Columns set on the rows of a key."""
    return rows.withColumns({c: F.when(key, v).otherwise(F.col(c)) for c, v in values.items()})


# What an edit may set on a line of dialogue.
DIALOGUE_FIELDS = ("text", "speaker", "direction")


@dataclass(frozen=True)
class Edited:
    """Entries with the edits in, the statistics of the documents that they change, the journal of what was set, and the edits that were not."""

    entries: DataFrame
    stats: DataFrame
    journal: DataFrame
    rejects: DataFrame


def edit_dialogue(entries: DataFrame, edits: DataFrame, by: Sequence[str]) -> Edited:
    """Set fields of dialogue entries (by, seq, type, ..): ``edits`` are (by, seq, ts, fields), fields a map of text.

    Of several edits of a field the last by ``ts`` is set; null clears it. The journal has a row for
    each entry that changes: by, seq, ts of its last edit, fields as set, and before, what they
    were. Rejects (by, seq, ts, field, reason) are fields that no edit may set and edits of what is
    no line of dialogue. Statistics are made anew for documents with a change only.
    """
    keys = [*by, "seq"]
    each = edits.select(*keys, "ts", F.explode("fields").alias("field", "value"))
    lines = entries.where("type = 'dialogue'").select(*keys, F.struct(*DIALOGUE_FIELDS).alias("_old")).dropDuplicates(keys)
    met = each.join(lines, keys, "left")
    reason = F.when(~F.col("field").isin(*DIALOGUE_FIELDS), "field that no edit sets").when(F.col("_old").isNull(), "no line of dialogue")
    met = met.withColumn("reason", reason)
    rejects = met.where("reason IS NOT NULL").select(*keys, "ts", "field", "reason")
    last = met.where("reason IS NULL").groupBy(*keys, "field").agg(F.max_by(F.struct("value"), F.struct("ts", "value")).alias("set"), F.max("ts").alias("ts"), F.first("_old").alias("_old"))
    old = F.coalesce(*[F.when(F.col("field") == c, F.col(f"_old.{c}")) for c in DIALOGUE_FIELDS])
    changed = last.withColumns({"value": F.col("set.value"), "was": old}).where(~F.col("value").eqNullSafe(F.col("was")))
    as_map = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", c))))
    journal = changed.groupBy(*keys).agg(F.max("ts").alias("ts"), as_map("value").alias("fields"), as_map("was").alias("before"))
    laid = entries.join(journal.select(*keys, F.col("fields").alias("_set")), keys, "left")
    spoken = (F.col("type") == "dialogue") & F.col("_set").isNotNull()
    new = {c: F.when(spoken & F.map_contains_key("_set", F.lit(c)), F.col("_set")[c]).otherwise(F.col(c)) for c in DIALOGUE_FIELDS}
    edited = laid.withColumns(new).select(*entries.columns)
    stats = document_stats(edited.join(journal.select(*by).distinct(), list(by), "left_semi"), by)
    return Edited(edited, stats, journal, rejects)
