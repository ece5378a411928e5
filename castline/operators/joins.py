"""Joins that annotate, compare and audit entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castline.functions.exact import round_exact, similarity
from castline.functions.text import effect_slug, spoken_text, stem_name, strip, text
from castline.operators.timeline import span_marker


def annotate(rows: DataFrame, dim: DataFrame, applies: Column, key: str, dim_key: str, columns: dict[str, Column], flag: str) -> DataFrame:
    """Left join on a key for the rows to which it ``applies``; the others and misses get nulls and a false flag.

    ``columns`` names what is taken from ``dim``, whose keys are unique.
    """
    side = dim.select(F.col(dim_key).alias("_dim_key"), *[c.alias(name) for name, c in columns.items()], F.lit(True).alias("_hit"))
    joined = rows.join(side, applies & (F.col(key) == F.col("_dim_key")), "left")
    return joined.withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_dim_key", "_hit")


def annotate_entries(rows: DataFrame, effects: DataFrame, cast: DataFrame, influence: float | None = None) -> DataFrame:
    """Directions with their effect, dialogue with its speaker's voice; both flagged.

    ``effects`` has cue and effect, ``cast`` has speaker and the voice's columns.
    """
    e = lambda f: F.col(f"effect.{f}")
    sounds = {
        "sfx_type": F.coalesce(e("type"), F.lit("sfx")), "sfx_prompt": e("prompt"), "sfx_duration_seconds": e("duration_seconds"),
        "sfx_prompt_influence": F.coalesce(e("prompt_influence"), F.lit(influence).cast("double")), "sfx_loop": F.coalesce(e("loop"), F.lit(False)), "sfx_slug": effect_slug(F.col("cue")),
    }
    voices = {"cast_full_name": F.col("full_name"), "cast_voice_id": F.col("voice_id"), "cast_pan": F.col("pan"), "cast_filter": text("filter") != "", "cast_role": F.col("role")}
    out = annotate(rows, effects, F.col("type") == "direction", "text", "cue", sounds, "sfx_matched")
    return annotate(out, cast, (F.col("type") == "dialogue") & (text("speaker") != ""), "speaker", "speaker", voices, "cast_matched")


def match_counts(annotated: DataFrame) -> DataFrame:
    """Directions and dialogue rows, and how many of them were matched."""
    direction, spoken = F.col("type") == "direction", F.col("type") == "dialogue"
    return annotated.agg(
        F.count("*").alias("rows"), F.count_if(direction).alias("directions"), F.count_if(direction & F.col("sfx_matched")).alias("sfx_matched"),
        F.count_if(spoken).alias("dialogue"), F.count_if(spoken & F.col("cast_matched")).alias("cast_matched"),
    )


def compare_transcripts(dialogue: DataFrame, stems: DataFrame, threshold: float = 0.8, on: Sequence[str] = ("seq",)) -> DataFrame:
    """Each line's status against its stem (has_transcript, transcript): no_stem, not_transcribed, silent, garbled or ok."""
    side = stems.select(*on, "has_transcript", "transcript", F.lit(True).alias("_stem"))
    joined = dialogue.join(side, list(on), "left")
    silent = strip(text("transcript")) == ""
    heard = F.col("_stem").isNotNull() & F.col("has_transcript")
    # Most stems say what the line says: only the others are compared letter by letter.
    joined = joined.withColumns({"_said": F.when(heard & ~silent, spoken_text(F.col("text"))), "_heard": F.when(heard & ~silent, spoken_text(F.col("transcript")))})
    differ = (F.col("_said") != F.col("_heard")) & (F.col("_said") != "") & (F.col("_heard") != "")
    compared = round_exact(similarity(F.when(differ, F.col("_said")), F.when(differ, F.col("_heard"))), F.lit(4))
    ratio = F.when(F.col("_said") == F.col("_heard"), 1.0).when((F.col("_said") == "") | (F.col("_heard") == ""), 0.0).otherwise(compared)
    status = (
        F.when(F.col("_stem").isNull(), "no_stem").when(~F.col("has_transcript"), "not_transcribed").when(silent, "silent").when(F.col("similarity") < threshold, "garbled").otherwise("ok")
    )
    return joined.withColumn("similarity", F.when(heard & silent, 0.0).when(heard, ratio)).withColumn("status", status).drop("_stem", "_said", "_heard")


def audit(records: DataFrame, dialogue: DataFrame, on: Sequence[str], logged: str, actual: str, threshold: int = 0) -> DataFrame:
    """Logged against actual counts: unmatched, mismatch beyond the threshold, or ok."""
    joined = records.join(dialogue.select(*on, actual), list(on), "left")
    delta = F.abs(F.col(actual) - F.col(logged))
    return joined.withColumn("delta", delta).withColumn("status", F.when(F.col(actual).isNull(), "unmatched").when(delta > threshold, "mismatch").otherwise("ok"))


def stale_stems(stems: DataFrame, entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stems (by, path, base, seq) that disagree with the entries (by, seq, type, section, scene, speaker), with the reason.

    ``by`` tells episodes apart: stems of two of them may have equal numbers. A stem is stale if its seq is gone or a header now; if several stems share a seq, all but the
    one with the expected name; if its ending contradicts the entry's type or speaker.
    """
    keys = [*by, "seq"]
    side = entries.select(*keys, F.col("type").alias("entry_type"), "section", "scene", "speaker")
    rows = stems.where("seq IS NOT NULL").withColumn("same", F.count("*").over(Window.partitionBy(*keys))).join(side, keys, "left")
    expected = stem_name(F.col("seq"), F.col("section"), F.col("scene"), F.col("speaker"), F.col("entry_type"))
    is_sound = F.substring_index("base", "_", -1) == "sfx"
    seq = F.concat(F.lit("seq "), F.col("seq").cast("string"))
    spoken = F.col("entry_type") == "dialogue"
    several = F.col("same") > 1
    reason = (
        F.when(F.col("entry_type").isNull(), "seq not in parsed JSON")
        .when(~F.col("entry_type").isin("dialogue", "direction"), F.concat(seq, F.lit(" is now a "), "entry_type", F.lit(" entry")))
        .when(several & (F.col("base") != expected), F.concat(seq, F.lit(" duplicate (expected "), expected, F.lit(")")))
        .when(several, None)
        .when(is_sound & spoken, F.concat(seq, F.lit(" is now a dialogue entry")))
        .when(~is_sound & (F.col("entry_type") == "direction"), F.concat(seq, F.lit(" is now a direction entry")))
        .when(spoken & ~F.col("base").endswith(F.concat(F.lit("_"), text("speaker"))), F.concat(seq, F.lit(" speaker is now "), text("speaker")))
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select(*by, "path", "seq", "reason")


#: Which markers of a treatment count in a mix although no stem belongs to them.
SENTINEL_MARKERS = {"VINTAGE FILTER": ("DISENGAGES",), "FILM AUDIO": ("ENGAGES", "DISENGAGES"), "SPEAKERPHONE": ("ENGAGES", "DISENGAGES"), "PHONE FILTER": ("ENGAGES", "DISENGAGES")}


def stem_plans(stems: DataFrame, entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What a mix is made of: one row for each usable stem, for each cue that only bounds others, and for each stem that is left out.

    ``stems`` are (by, path, base, seq), ``entries`` (by, seq, type, direction_type, section, scene,
    speaker, text), each seq once. Columns: by, seq, path, type, direction_type, text, scene,
    foreground, plan (stem, sentinel or rejected) and reason, of those rejected. A stem is rejected if its seq
    is gone or a header now, if its ending contradicts the entry's type or speaker, and if one that
    comes before it by path has its seq. Music before the episode, or in its preamble or postamble,
    takes time. Sentinels are stops of ambience and the markers of treatments whose seq has no
    usable stem. Stems without a number are left out.
    """
    keys = [*by, "seq"]
    side = entries.select(*keys, F.col("type").alias("entry_type"), "direction_type", "section", "scene", "speaker", "text", F.lit(True).alias("_there"))
    met = stems.where("seq IS NOT NULL").select(*keys, "path", "base").join(side, keys, "left")
    seq, kind = F.concat(F.lit("seq "), F.col("seq").cast("string")), F.col("entry_type")
    is_sound = F.substring_index("base", "_", -1) == "sfx"
    fits = F.when(text("speaker") == "", True).otherwise(F.col("base").endswith(F.concat(F.lit("_"), text("speaker"))))
    reason = (
        F.when(F.col("_there").isNull(), F.concat(seq, F.lit(" not in parsed JSON")))
        .when(~F.coalesce(kind, F.lit("None")).isin("dialogue", "direction"), F.concat(seq, F.lit(" is now a "), F.coalesce(kind, F.lit("None")), F.lit(" entry")))
        .when(is_sound & (kind == "dialogue"), F.concat(seq, F.lit(" is now a dialogue entry")))
        .when(~is_sound & (kind == "direction"), F.concat(seq, F.lit(" is now a direction entry")))
        .when((kind == "dialogue") & ~fits, F.concat(seq, F.lit(" speaker is now "), text("speaker")))
    )
    told = met.withColumn("reason", reason)
    # Of usable stems of one seq the first by path counts.
    first = F.min(F.when(F.col("reason").isNull(), F.col("path"))).over(Window.partitionBy(*keys))
    told = told.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("path") != first), F.concat(seq, F.lit(" already loaded"))).otherwise(F.col("reason")))
    outside = F.coalesce(F.col("section").isin("preamble", "postamble"), F.lit(False)) | (F.col("seq") < 0)
    foreground = F.coalesce((F.col("direction_type") == "MUSIC") & outside, F.lit(False))
    columns = [*keys, "path", F.col("entry_type").alias("type"), "direction_type", "text", "scene"]
    plans = told.select(*columns, foreground.alias("foreground"), F.when(F.col("reason").isNull(), "stem").otherwise("rejected").alias("plan"), "reason")
    marker = span_marker(text("text"))
    bounds = (F.col("direction_type") == "AMBIENCE") & ((F.col("text") == "AMBIENCE: STOP") | F.endswith("text", F.lit("FADES OUT")))
    for treatment, markers in SENTINEL_MARKERS.items():
        bounds = bounds | ((F.col("direction_type") == treatment) & marker.isin(*markers))
    usable = told.where("reason IS NULL").select(*keys).distinct()
    sentinels = side.where(F.coalesce(bounds, F.lit(False))).join(usable, keys, "left_anti").withColumn("path", F.lit("")).select(*columns[:-1], F.lit(None).cast("string").alias("scene"), F.lit(False).alias("foreground"), F.lit("sentinel").alias("plan"), F.lit(None).cast("string").alias("reason"))
    return plans.unionByName(sentinels)


def reconcile(dialogue: DataFrame, manifest: DataFrame, present: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each line against the manifest: correct, relink or missing with a reason.

    ``manifest`` rows (key, at, path, sha256) count by their last one; ``present`` lists the files (path, sha256).
    """
    last = manifest.groupBy(*key).agg(F.max_by(F.struct("path", "sha256"), "at").alias("_made")).select(*key, F.col("_made.path").alias("made_path"), F.col("_made.sha256").alias("made_sha"))
    joined = dialogue.join(last, list(key), "left").join(present.select(F.col("path").alias("made_path"), F.col("sha256").alias("file_sha")), "made_path", "left")
    state = (
        F.when(F.col("made_path").isNull(), "missing").when(F.col("file_sha").isNull(), "missing").when(F.col("made_sha").isNotNull() & (F.col("made_sha") != F.col("file_sha")), "missing")
        .when(F.col("made_path") == F.col("expected_path"), "correct").otherwise("relink")
    )
    reason = F.when(F.col("made_path").isNull(), "not in manifest").when(F.col("file_sha").isNull(), "file gone").when(F.col("made_sha") != F.col("file_sha"), "content changed")
    return joined.withColumns({"state": state, "reason": reason})


def pending(edits: DataFrame, produced: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """Keys edited after they were last produced."""
    edited = edits.groupBy(*by).agg(F.max(at).alias("edited"))
    made = produced.groupBy(*by).agg(F.max(at).alias("produced"))
    return edited.join(made, list(by)).where("edited > produced")


def matched_or_new(texts: DataFrame, effects: DataFrame, key: str, hinted: Column) -> DataFrame:
    """Each direction's text: matched by an effect, hinted by its own source, or new."""
    side = effects.select(F.col("cue").alias(key), F.lit(True).alias("_hit")).dropDuplicates([key])
    return texts.join(side, key, "left").withColumn("state", F.when(F.col("_hit"), "matched").when(hinted, "hinted").otherwise("new")).drop("_hit")


def contains_join(effects: DataFrame, assets: DataFrame, cue: str, asset: str) -> DataFrame:
    """Effects and the assets whose id their name holds, any case; an effect may hold several.

    Ids look like ``WORD-WORD-12``. Each starts at a word of the name and has no more words than
    the longest id, so the runs of so many words meet the ids in an equi-join.
    """
    longest = assets.agg(F.max(F.size(F.split(asset, "-")))).first()[0] or 0
    words = F.regexp_extract_all(F.upper(cue), F.lit(r"[A-Z0-9_]+"), 0)
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, F.least(n, i + longest - 1)), lambda j: F.array_join(F.slice(words, i, j - i + 1), "-"))))
    found = effects.withColumn(asset, F.explode(F.array_distinct(F.when((n > 0) & (F.lit(longest) > 0), runs)))).join(assets, asset)
    return found.where(F.upper(cue).contains(F.col(asset)))


def speaker_of_line(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Lines (.., line) with the longest known name (display, key, place) that they start with, and what follows.

    A name must be followed by a space, a parenthesis or the end. Names meet lines by their first
    word, so that no line is compared with all names.
    """
    lead = lambda c: F.regexp_extract(c, r"^[^ (]*", 0)
    ids = lines.withColumn("_line", F.monotonically_increasing_id()) if "line_id" not in lines.columns else lines.withColumn("_line", F.col("line_id"))
    names = known.select("display", "key", "place", lead(F.col("display")).alias("_lead"))
    after = F.substring(F.col("line"), F.length("display") + 1, F.length("line"))
    met = ids.withColumn("_lead", lead(F.col("line"))).join(names, "_lead").where(F.col("line").startswith(F.col("display")) & (after.rlike("^[ (]") | (after == "")))
    best = met.groupBy("_line").agg(F.max_by(F.struct("display", "key", after.alias("after")), F.struct(F.length("display"), -F.col("place"))).alias("best"))
    out = ids.join(best, "_line", "left")
    rest = F.regexp_replace("best.after", r"(?U)^\s+", "")
    note = F.regexp_extract(rest, r"^\(([^)]*)\)", 1)
    has_note = rest.rlike(r"^\([^)]*\)")
    return out.select(
        *lines.columns, F.col("best.display").alias("display"), F.col("best.key").alias("speaker"), F.when(has_note, strip(note)).alias("direction"), F.when(has_note, strip(F.regexp_replace(rest, r"^\([^)]*\)", ""))).otherwise(rest).alias("spoken")
    )


def find_effect(plans: DataFrame, effects: DataFrame, key: str) -> DataFrame:
    """Each plan's effect: by its exact text, or else with dashes made plain, the first in file order."""
    plain = lambda c: F.regexp_replace(c, r"(?U)\s*[—–]\s*", " - ")
    exact = effects.select(F.col("cue").alias(key), F.col("effect").alias("_exact"))
    loose = effects.groupBy(plain(F.col("cue")).alias("_plain")).agg(F.min_by("effect", "at").alias("_loose"))
    return plans.withColumn("_plain", plain(F.col(key))).join(exact, key, "left").join(loose, "_plain", "left").withColumn("effect", F.coalesce("_exact", "_loose")).drop("_exact", "_loose", "_plain")
