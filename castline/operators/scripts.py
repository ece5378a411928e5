"""Scripts: scanning lines and parsing whole documents into entries.

All of it is windows over the lines of a document, in their order. A speaker's name that stands
alone waits for its text, and then takes the next line whatever it looks like; so of names that
follow each other every second one is such a text, which a count within their run tells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castline.functions import text as t
from castline.functions.exact import nfc
from castline.functions.text import is_caps_candidate, is_stage_direction, strip
from castline.operators.sequence import UP_TO_NOW, fill_sections
from castline.sources.rejects import Split, split

# Section headers that every show may use, and their slugs.
SECTIONS = {
    "COLD OPEN": "cold-open", "OPENING CREDITS": "opening-credits",
    "CHAPTER ONE": "chapter1", "CHAPTER 1": "chapter1", "CHAPTER TWO": "chapter2", "CHAPTER 2": "chapter2", "CHAPTER THREE": "chapter3", "CHAPTER 3": "chapter3",
    "ACT ONE": "act1", "ACT 1": "act1", "ACT TWO": "act2", "ACT 2": "act2", "ACT THREE": "act3", "ACT 3": "act3",
    "ACT FOUR": "act4", "ACT 4": "act4", "ACT FIVE": "act5", "ACT 5": "act5", "ACT SIX": "act6", "ACT 6": "act6",
    "MID-EPISODE BREAK": "mid-break", "CLOSING": "closing", "POST-INTERVIEW": "post-interview", "POST-CREDITS SCENE": "post-credits",
    "PRODUCTION NOTES": "production-notes", "EPISODE THEME": "preamble", "PRE-SHOW MUSIC": "preamble", "CLOSING TAG": "postamble", "PREAMBLE": "preamble", "POSTAMBLE": "postamble",
}
# Headers of single kinds of projects beside these.
PODCAST = {"INTRO": "intro", "OUTRO": "outro"}
AUDIOBOOK = {"PROLOGUE": "prologue", "EPILOGUE": "epilogue", "AUTHOR'S NOTE": "authors-note", "AUTHOR’S NOTE": "authors-note"}
DRAMA = {"PROLOGUE": "prologue", "EPILOGUE": "epilogue", "INTERMISSION": "intermission"}
# Numbers of chapters in words.
CHAPTERS = (
    "ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE", "TEN", "ELEVEN", "TWELVE", "THIRTEEN", "FOURTEEN", "FIFTEEN", "SIXTEEN", "SEVENTEEN", "EIGHTEEN", "NINETEEN", "TWENTY",
    "TWENTY-ONE", "TWENTY-TWO", "TWENTY-THREE", "TWENTY-FOUR", "TWENTY-FIVE", "TWENTY-SIX", "TWENTY-SEVEN", "TWENTY-EIGHT", "TWENTY-NINE", "THIRTY",
)
#: Segments that a special may have.
SEGMENTS = 15


def sections_of(kind: str | None = None, own: dict[str, str] | None = None) -> dict[str, str]:
    """Headers and slugs for a kind of project: podcast, audiobook, drama, special (all of them, and segments) or any other; a show's ``own`` come on top."""
    found = dict(SECTIONS)
    if kind in ("podcast", "special"):
        found |= PODCAST
    if kind in ("audiobook", "special"):
        found |= AUDIOBOOK | {f"CHAPTER {name}": f"chapter{i}" for i, word in enumerate(CHAPTERS, 1) for name in (word, i)}
    if kind in ("drama", "special"):
        found |= DRAMA
    if kind == "special":
        found |= {f"SEGMENT {i}": f"segment{i}" for i in range(1, SEGMENTS + 1)}
    return found | (own or {})


def caps_lines(lines: DataFrame, by: str = "doc") -> DataFrame:
    """Lines in capitals of a document with how often and where they stand, up to a line that ends the script; stage directions are left out."""
    line = strip(F.col("raw"))
    marked = lines.withColumn("line", line).withColumn("_end", F.min(F.when(line.startswith("END OF"), F.col("line_no"))).over(Window.partitionBy(by)))
    found = marked.where((F.col("_end").isNull() | (F.col("line_no") < F.col("_end"))) & (F.col("line") != "") & ~is_stage_direction(F.col("line")) & is_caps_candidate(F.col("line")))
    return found.groupBy(by, "line").agg(F.count("*").alias("uses"), F.array_sort(F.collect_list("line_no")).alias("line_nos"))


def cast_block(lines: DataFrame, by: str = "doc") -> DataFrame:
    """The bullets of the CAST block: between its head and the first other line that is not blank."""
    line = strip(F.col("raw"))
    run = Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("line", line).withColumn("_in", F.bool_or(F.col("line") == "CAST:").over(run))
    ends = F.col("_in") & (F.col("line") != "CAST:") & (F.col("line") != "") & ~F.col("line").startswith("*")
    marked = marked.withColumn("_out", F.bool_or(ends).over(run))
    name = strip(F.regexp_extract(F.substring("line", 2, 1_000_000), r"(?U)^(.*?)(?:\s*[—–]\s*.*)?$", 1))
    return marked.where(F.col("_in") & ~F.col("_out") & F.col("line").startswith("*")).select(by, "line_no", name.alias("display")).where("display != ''")


def script_lines(scripts: DataFrame) -> DataFrame:
    """The lines of scripts (doc, value) that are read: doc, line_no, raw, line, slug of the show, and the names of the CAST block.

    Texts are composed, escapes, heading and bold marks go. Blank lines and the header line are left
    out, and so is what comes before the end of the CAST block.
    """
    # Whole texts are dealt out, not their lines: what follows has the same partitioning by doc. No character composes over a
    # line end, and none below U+0300 with another, so Python gets single lines, and of these only those that may change.
    texts = scripts.where("value IS NOT NULL").select("doc", "value").repartition("doc")
    cut = texts.select("doc", F.posexplode(F.split("value", "\n")).alias("at", "given"))
    composed = F.coalesce(nfc(F.when(F.col("given").rlike(r"[^\x{0}-\x{2FF}]"), F.col("given"))), F.col("given"))
    raw = cut.select("doc", "at", t.strip_escapes(composed).alias("raw"))
    rows = raw.select("doc", (F.col("at") + 1).cast("long").alias("line_no"), t.strip_formatting(F.col("raw")).alias("raw")).withColumn("line", strip(F.col("raw")))
    whole, run = Window.partitionBy("doc"), Window.partitionBy("doc").orderBy("line_no").rowsBetween(*UP_TO_NOW)
    line, line_no = F.col("line"), F.col("line_no")
    rows = rows.withColumn("_top", F.min(F.when(line != "", F.struct("line_no", "line"))).over(whole))
    header = t.script_header(F.col("_top.line"))
    rows = rows.withColumns({"slug": F.coalesce(t.show_slug(header["show"]), F.lit("unknownshow")), "_start": F.when(header.isNotNull(), F.col("_top.line_no") + 1).otherwise(1)})
    rows = rows.withColumn("_cast", F.coalesce(F.bool_or((line == "CAST:") & (line_no >= F.col("_start"))).over(run), F.lit(False)))
    ends = F.col("_cast") & (line != "CAST:") & (line != "") & ~line.startswith("*")
    rows = rows.withColumn("_end", F.min(F.when(ends, line_no)).over(whole))
    named = F.col("_cast") & line.startswith("*") & (F.col("_end").isNull() | (line_no < F.col("_end")))
    display = t.nonblank(strip(F.regexp_extract(strip(F.substring("line", 2, 1_000_000)), r"(?U)^(.*?)(?:\s*[—–]\s*.*)?$", 1)))
    # The names of a CAST block, a few, go with every line of its script.
    key = t.display_to_key(display)
    names = F.collect_list(F.when(named & (key != ""), F.struct(display.alias("display"), key.alias("key"), F.col("line_no").alias("at")))).over(whole)
    rows = rows.withColumn("names", names).withColumn("read", line_no >= F.coalesce("_end", "_start"))
    return rows.where("read AND line != ''").drop("_top", "_start", "_cast", "_end", "read")


def with_speakers(lines: DataFrame, known: Sequence[tuple[str, str]]) -> DataFrame:
    """Lines with the name that they start with, key and what comes after it: the longest one, followed by a space, a parenthesis or the end.

    Known names meet lines by their first word, in a table as small as the caller's list; the names
    of a script's CAST block are those that its lines carry. Of names of one key in a block the
    first counts. Of equal names the known ones go before those of the block; names with spaces
    may be written with underscores as well.
    """
    lead = lambda c: F.regexp_extract(c, r"^[^ (]*", 0)
    underscored = [(d.replace(" ", "_"), k) for d, k in known if " " in d]
    rows = [(d, k, rank, at) for rank, names in ((1, known), (2, underscored)) for at, (d, k) in enumerate(names)]
    fixed = lines.sparkSession.createDataFrame(rows, "display string, key string, rank int, at long")
    fixed = fixed.groupBy(lead(F.col("display")).alias("_lead")).agg(F.collect_list(F.struct("display", "key", "rank", "at")).alias("_known"))
    line = F.col("line")
    after = lambda name: F.substring(line, F.length(name) + 1, F.length(line))
    fits = lambda name: line.startswith(name) & (after(name).rlike("^[ (]") | (line == name))
    told = lambda name, n, rank: F.struct(F.length(name).alias("length"), rank.cast("int").alias("rank"), n["at"].cast("long").alias("at"), n["key"].alias("key"), after(name).alias("after"))
    plain, joined = lambda n: n["display"], lambda n: F.replace(n["display"], F.lit(" "), F.lit("_"))
    first = lambda n: ~F.exists("names", lambda m: (m["key"] == n["key"]) & (m["at"] < n["at"]))
    own = lambda shown, rank, more: F.transform(F.filter("names", lambda n: fits(shown(n)) & more(n) & first(n)), lambda n: told(shown(n), n, F.lit(rank)))
    of_known = F.transform(F.filter("_known", lambda n: fits(n["display"])), lambda n: told(n["display"], n, n["rank"]))
    of_block = F.when(F.size("names") > 0, F.concat(own(plain, 0, lambda n: F.lit(True)), own(joined, 2, lambda n: n["display"].contains(" "))))
    none = F.array().cast("array<struct<length: int, rank: int, at: bigint, key: string, after: string>>")
    met = lines.withColumn("_lead", lead(line)).join(F.broadcast(fixed), "_lead", "left")
    best = F.array_max(F.concat(F.coalesce(of_known, none), F.coalesce(of_block, none)))
    return met.withColumn("_best", best).withColumns({"key": F.col("_best.key"), "after": F.col("_best.after")}).drop("_lead", "_known", "_best", "names")


def classified(lines: DataFrame, known: Sequence[tuple[str, str]], sections: dict[str, str]) -> DataFrame:
    """What each line is: section, scene, cue, name (it waits for its text), said (name and text), taken (text that was waited for), plain or other.

    Lines after the end of the episode, or from the notes on, are left out.
    """
    line = F.col("line")
    rows = with_speakers(lines, known)
    rest = F.regexp_replace("after", r"(?U)^\s+", "")
    noted = rest.rlike(r"^\([^)]*\)")
    rows = rows.withColumns(
        {
            "note": F.when(noted, strip(F.regexp_extract(rest, r"^\(([^)]*)\)", 1))),
            "words": F.when(noted, strip(F.regexp_replace(rest, r"^\([^)]*\)", ""))).otherwise(rest),
            "section_slug": t.section_slug(line, sections),
            "aside": line.startswith("(") & line.endswith(")"),
            "is_cue": is_stage_direction(line),
        }
    )
    kind = (
        F.when(t.is_divider(line), "other").when(t.is_metadata_section(line), "stop").when(line.startswith("END OF EPISODE") | line.startswith("END OF PRODUCTION"), "stop")
        .when(F.col("section_slug").isNotNull(), "section").when(t.is_scene_header(line), "scene").when(F.col("is_cue"), "cue").when(F.col("words") == "", "name").when(F.col("words").isNotNull(), "said")
        .when(F.col("aside"), "other").otherwise("plain")
    )
    rows = rows.withColumn("kind", kind).withColumn("takes", ~F.col("aside") & ~F.col("is_cue"))
    # Among the lines that can be taken every second one of a run of names waits. All windows have one order, so the lines are sorted once.
    order = Window.partitionBy("doc").orderBy("line_no")
    so_far, before = order.rowsBetween(*UP_TO_NOW), order.rowsBetween(Window.unboundedPreceding, -1)
    is_name = (F.col("kind") == "name") & F.col("takes")
    rows = rows.withColumn("_names", F.count_if(is_name).over(so_far))
    rows = rows.withColumn("_others", F.coalesce(F.max(F.when(F.col("takes") & ~is_name, F.col("_names"))).over(so_far), F.lit(0)))
    rows = rows.withColumn("_waits", is_name & ((F.col("_names") - F.col("_others")) % 2 == 1))
    waited = F.last(F.when(F.col("takes"), F.col("_waits")), ignorenulls=True).over(before)
    rows = rows.withColumn("kind", F.when(F.col("takes") & F.coalesce(waited, F.lit(False)), "taken").otherwise(F.col("kind")))
    rows = rows.withColumn("_stopped", F.bool_or(F.col("kind") == "stop").over(so_far)).where("NOT _stopped")
    # A text that was waited for has the speaker of the last name, and its note or that of the last aside since.
    name = F.last(F.when(F.col("kind") == "name", F.struct("line_no", "key", "note")), ignorenulls=True).over(so_far)
    aside = F.last(F.when(F.col("aside") & (F.col("kind") != "taken"), F.struct("line_no", F.expr("substring(line, 2, length(line) - 2)").alias("note"))), ignorenulls=True).over(so_far)
    rows = rows.withColumns({"_of": name, "_aside": aside})
    taken = F.col("kind") == "taken"
    note = F.when(F.col("_aside.line_no") > F.col("_of.line_no"), strip(F.col("_aside.note"))).otherwise(F.col("_of.note"))
    return rows.withColumns({"speaker": F.when(taken, F.col("_of.key")).otherwise(F.col("key")), "note": F.when(taken, note).otherwise(F.col("note")), "words": F.when(taken, line).otherwise(F.col("words"))}).select(
        "doc", "line_no", "line", "slug", "kind", "speaker", "note", "words", "section_slug"
    )


def directions_of(line: Column, slug: Column) -> Column:
    """The directions in the brackets of a line, as entries."""
    hinted = F.transform(t.brackets(line), lambda inside: t.split_hints(strip(inside), slug))
    found = F.filter(hinted, lambda h: t.direction_type(h["clean"]).isNotNull())
    return F.transform(found, lambda h: entry("direction", h["clean"], direction_type=t.direction_type(h["clean"]), sfx_source=h["source"], sfx_overrides=h["overrides"]))


#: Why a line is no entry.
BEFORE_ANYONE, UNKNOWN_CUE, NO_TEXT = "text before any speaker", "cue of no known kind", "name without a text"


def entry(kind: str, value: Column, **more: Column) -> Column:
    none = {name: F.lit(None).cast("string") for name in ("speaker", "direction", "direction_type", "sfx_source")}
    none["sfx_overrides"] = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return F.struct(F.lit(kind).alias("type"), value.alias("text"), *[c.alias(name) for name, c in (none | more).items()])


def read_lines(scripts: DataFrame, known: Sequence[tuple[str, str]] = (), kind: str | None = None, sections: dict[str, str] | None = None) -> DataFrame:
    """The classified lines of scripts with section, scene, and the event that each belongs to; 0 before the first one."""
    rows = classified(script_lines(scripts), list(known), sections_of(kind, sections))
    scene = F.when(F.col("kind") == "scene", F.concat(F.lit("scene-"), t.scene_number(F.col("line"))))
    rows = fill_sections(rows, ["doc"], ["line_no"], F.when(F.col("kind") == "section", F.col("section_slug")), scene)
    run = Window.partitionBy("doc").orderBy("line_no").rowsBetween(*UP_TO_NOW)
    return rows.withColumn("event", F.count_if(~F.col("kind").isin("plain", "other")).over(run))


def entries_of(rows: DataFrame) -> DataFrame:
    """The entries of read lines that belong to an event."""
    # Plain lines go on with what was said before them.
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.when(F.col("kind") == "plain", F.col("line")).otherwise(F.col("words")).alias("words")))), lambda p: p["words"])
    first = F.min_by(F.struct("kind", "section", "scene", "speaker", "note", "line", "slug"), "line_no").alias("e")
    events = rows.groupBy("doc", "event").agg(F.min("line_no").alias("line_no"), first, F.array_join(parts, " ").alias("words"))
    line, slug, what = F.col("e.line"), F.col("e.slug"), F.col("e.kind")
    made = (
        F.when(what == "section", F.array(entry("section_header", line)))
        .when(what == "scene", F.concat(F.array(entry("scene_header", t.strip_brackets(line))), directions_of(line, slug)))
        .when(what == "cue", directions_of(line, slug))
        .when(what.isin("said", "taken"), F.array(entry("dialogue", F.col("words"), speaker=F.col("e.speaker"), direction=F.col("e.note"))))
    )
    out = events.select("doc", "line_no", "e.section", "e.scene", F.posexplode(made).alias("at", "entry"))
    order = Window.partitionBy("doc").orderBy("line_no", "at")
    return out.withColumn("seq", F.row_number().over(order).cast("long")).select(
        "doc", "seq", "entry.type", "section", "scene", "entry.speaker", "entry.direction", "entry.text", "entry.direction_type", "entry.sfx_source", "entry.sfx_overrides", "line_no"
    )


def parse_scripts(scripts: DataFrame, known: Sequence[tuple[str, str]] = (), kind: str | None = None, sections: dict[str, str] | None = None) -> DataFrame:
    """Entries of scripts (doc, value): doc, seq, type, section, scene, speaker, direction, text, direction_type, sfx_source, sfx_overrides, line_no.

    ``doc`` names one script. ``known`` are speakers (display, key) of the show, ``kind`` is that of
    the project, which tells what headers its sections have, ``sections`` are more of them.

    Null scripts give no rows; neither do lines that no rule takes (``parse_with_rejects`` gives those as well).
    """
    return entries_of(read_lines(scripts, known, kind, sections).where("event > 0 AND kind != 'other'"))


def parse_with_rejects(scripts: DataFrame, folder: str, known: Sequence[tuple[str, str]] = (), kind: str | None = None, sections: dict[str, str] | None = None) -> tuple[DataFrame, Split]:
    """The entries of scripts, and what became of their lines: the rejects (doc, line_no, line, reason) and their numbers.

    Scripts are read once; their lines are stored in ``folder`` on the way. Rejected are lines before
    anyone speaks, cues in brackets of no known kind, and names that wait for a text in vain. Dividers
    and asides are no entries by rule and are neither kept nor rejected.
    """
    rows = read_lines(scripts, known, kind, sections)
    spoken = Window.partitionBy("doc", "event")
    rows = rows.withColumn("_cues", F.when(F.col("kind") == "cue", F.size(directions_of(F.col("line"), F.col("slug")))).otherwise(1))
    later = F.lead("kind").over(Window.partitionBy("doc").orderBy("line_no"))
    waits_in_vain = (F.col("kind") == "name") & (F.coalesce(later, F.lit("stop")) != "taken") & (F.count("*").over(spoken) == 1)
    reason = (
        F.when((F.col("kind") == "plain") & (F.col("event") == 0), BEFORE_ANYONE)
        .when((F.col("kind") == "cue") & (F.col("_cues") == 0), UNKNOWN_CUE)
        .when(waits_in_vain, NO_TEXT)
    )
    told = rows.withColumn("reason", reason).where("reason IS NOT NULL OR (event > 0 AND kind != 'other')").drop("_cues")
    both = split(told, folder, (BEFORE_ANYONE, UNKNOWN_CUE, NO_TEXT))
    # Rejected names and cues are events without entries, so the others are counted as ever.
    return entries_of(both.kept), Split(both.kept, both.rejects.select("doc", "line_no", "line", "reason"), both.counts)


def regenerate(entries: DataFrame, display: dict[str, str], by: str = "doc") -> DataFrame:
    """Scripts of entries, one text for each document: what parsing it again gives the same entries."""
    shown = F.create_map(*[F.lit(x) for pair in display.items() for x in pair]) if display else None
    name = F.coalesce(shown[F.col("speaker")], F.upper(F.replace("speaker", F.lit("_"), F.lit(" ")))) if display else F.upper(F.replace("speaker", F.lit("_"), F.lit(" ")))
    note = F.when(F.col("direction").isNotNull(), F.concat(F.lit(" ("), "direction", F.lit(")"))).otherwise("")
    line = F.when(F.col("type") == "dialogue", F.concat(name, note, F.lit(" "), "text")).when(F.col("type") == "direction", F.concat(F.lit("["), "text", F.lit("]"))).otherwise(F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda p: p["line"])
    return entries.groupBy(by).agg(F.array_join(parts, "\n\n").alias("value"))
