"""What a production derives from its entries: cue sheets, configuration skeletons, digests, chapters, plans of removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castline.functions.exact import title_case
from castline.functions.text import default_duration, nonblank, parse_duration, strip, text
from castline.operators.sequence import UP_TO_NOW, first_of

# Labels of sections that are not just their slug in title case.
SECTION_LABELS = {"act1": "Act One", "act2": "Act Two", "act3": "Act Three", "mid-break": "Mid-Episode Break", "post-interview": "Post-Interview"}


def cue_sheet(lines: DataFrame, by: str = "file") -> DataFrame:
    """Assets of cue sheets in markdown (file, line_no, raw): id, category, reuse, prompt, seconds, loop, scene.

    Headings name the category. Music and ambience stand in blocks, a heading and then a line with
    a prompt; a heading without such a line before the next heading is left out. Sound effects are
    table rows below the heading of their scene. Categories, blocks and scenes are filled down.
    """
    line = strip(F.col("raw"))
    plain = lambda c: strip(F.regexp_replace(c, r"\*+", ""))
    run = Window.partitionBy(by).orderBy("line_no").rowsBetween(*UP_TO_NOW)
    heading = F.upper(plain(F.substring("line", 4, 1_000_000)))
    category = F.when(heading.contains("MUSIC") & heading.contains("CUE"), "MUSIC").when(heading == "AMBIENCE", "AMBIENCE").when(heading.contains("SOUND EFFECT"), "SFX").otherwise("")
    rows = lines.withColumn("line", line).withColumn("_top", F.col("line").startswith("## "))
    rows = rows.withColumn("category", F.last(F.when(F.col("_top"), category), ignorenulls=True).over(run)).withColumn("_part", F.count_if("_top").over(run)).where(text("category") != "")
    inside = Window.partitionBy(by, "_part").orderBy("line_no").rowsBetween(*UP_TO_NOW)
    block = r"(?i)^([\w][\w-]*(?:-\d+)?)\s*\(?(NEW|REUSE)\)?"
    title = plain(F.substring("line", 5, 1_000_000))
    opens = F.col("line").startswith("### ") & title.rlike(block) & F.col("category").isin("MUSIC", "AMBIENCE")
    told = F.col("line").contains("**Prompt:**") & F.col("category").isin("MUSIC", "AMBIENCE")
    rows = rows.withColumns({"_opens": opens, "_told": told}).withColumn("_head", F.last(F.when(opens, title), ignorenulls=True).over(inside)).withColumn("_block", F.count_if("_opens").over(inside))
    rows = rows.withColumn("_nth", F.count_if("_told").over(Window.partitionBy(by, "_part", "_block").orderBy("line_no").rowsBetween(*UP_TO_NOW)))
    seconds = strip(F.regexp_extract("line", r"\*{1,2}Duration:\*{1,2}\s*(.*?)\s*\*{1,2}Used:", 1))
    blocks = rows.where(F.col("_told") & (F.col("_nth") == 1) & F.col("_head").isNotNull()).select(
        by, "line_no", F.upper(F.regexp_extract("_head", block, 1)).alias("asset_id"), "category", (F.upper(F.regexp_extract("_head", block, 2)) == "REUSE").alias("reuse"),
        nonblank(strip(F.regexp_extract("line", r"\*{1,2}Prompt:\*{1,2}\s*(.*?)\s*\*{1,2}Duration:", 1))).alias("prompt"), parse_duration(seconds).alias("seconds"),
        ((F.col("category") == "AMBIENCE") | seconds.rlike(r"(?i)\bloop")).alias("loop"), F.lit(None).cast("string").alias("scene"),
    )
    scene = F.last(F.when(F.col("line").startswith("###"), plain(F.regexp_extract("line", r"^###\s*(?:Scene\s+\d+:\s*)?(.*)", 1))), ignorenulls=True).over(inside)
    cells = F.filter(F.transform(F.split("line", r"\|"), strip), lambda c: c != "")
    row = r"(?i)^\*{0,2}([\w][\w-]*-\d+)\s*\((NEW|REUSE)\)\*{0,2}"
    effects = rows.withColumn("scene", scene).where((F.col("category") == "SFX") & F.col("line").startswith("|")).withColumn("_cells", cells).where(F.size("_cells") >= 2)
    effects = effects.where(F.col("_cells")[0].rlike(row) & F.col("_cells")[0].rlike("[A-Z]{2,}") & ~F.col("_cells")[0].rlike(r"(?i)^Asset\s+Name")).select(
        by, "line_no", F.upper(F.regexp_extract(F.col("_cells")[0], row, 1)).alias("asset_id"), "category", (F.upper(F.regexp_extract(F.col("_cells")[0], row, 2)) == "REUSE").alias("reuse"),
        F.col("_cells")[1].alias("prompt"), F.lit(None).cast("double").alias("seconds"), F.lit(False).alias("loop"), "scene",
    )
    return blocks.unionByName(effects)


def sound_skeleton(entries: DataFrame, by: Sequence[str], order: str = "seq") -> DataFrame:
    """One effect for each direction's text, from its first use: type, source or prompt, seconds, loop.

    Beats, stops and span markers are silences of a length; a cue with a source needs no prompt.
    """
    cues = first_of(entries.where("type = 'direction'"), [*by, "text"], [order])
    cue = F.col("text")
    beat = F.coalesce(F.regexp_extract(cue, r"(?i)(\d+(?:\.\d+)?)\s*SECOND", 1).try_cast("double"), F.lit(1.0))
    marker = cue.startswith("FILM AUDIO") | cue.startswith("SPEAKERPHONE") | cue.startswith("PHONE FILTER")
    stop = (cue == "AMBIENCE: STOP") | cue.endswith("FADES OUT")
    silence = F.when(cue == "BEAT", 1.0).when(cue == "LONG BEAT", 2.0).when(cue.startswith("BEAT"), beat).when(stop | marker, 0.0)
    quiet = silence.isNotNull()
    return cues.select(
        *by, order, cue.alias("cue"), F.when(quiet, "silence").otherwise("sfx").alias("type"), F.when(~quiet, F.col("sfx_source")).alias("source"),
        F.when(~quiet & F.col("sfx_source").isNull(), cue).alias("prompt"), F.coalesce(silence, default_duration(cue)).alias("seconds"), (~quiet & cue.startswith("AMBIENCE:")).alias("loop"),
    )


def cast_skeleton(speakers: DataFrame, registry: DataFrame) -> DataFrame:
    """A voice for each speaker key: the registry's values, or else a name made of the key and TBD."""
    side = registry.select(F.col("key").alias("speaker"), "display", *[F.col(c).alias(f"_{c}") for c in ("full_name", "voice_id", "pan", "filter", "role")])
    joined = speakers.join(side, "speaker", "left")
    name = title_case(F.replace(F.coalesce("display", "speaker"), F.lit("_"), F.lit(" ")))
    or_else = lambda c, d: F.coalesce(nonblank(F.col(c)), d)
    return joined.select(
        *speakers.columns, or_else("_full_name", name).alias("full_name"), or_else("_voice_id", F.lit("TBD")).alias("voice_id"), F.coalesce("_pan", F.lit(0.0)).alias("pan"), F.coalesce("_filter", F.lit("")).alias("filter"), or_else("_role", F.lit("TBD")).alias("role")
    )


def update_cast(cast: DataFrame, voices: DataFrame) -> DataFrame:
    """Role and language of voices filled in where the cast has none."""
    side = voices.select("voice_id", F.col("role").alias("_role"), F.col("language").alias("_language"))
    return cast.join(side, "voice_id", "left").withColumns({"role": F.coalesce(nonblank(F.col("role")), "_role"), "language": F.coalesce(nonblank(F.col("language")), "_language")}).drop("_role", "_language")


def episode_digest(entries: DataFrame, by: Sequence[str], lines: int = 3) -> DataFrame:
    """The first scene and the first lines of the cold open, and the sections in their order."""
    opening = F.col("section") == "cold-open"
    scene = F.min_by("text", F.when(opening & (F.col("type") == "scene_header") & (text("text") != ""), F.col("seq")))
    spoken = entries.where(opening & (F.col("type") == "dialogue")).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("seq"))).where(F.col("_n") <= lines)
    first = spoken.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "speaker", "text"))), lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"))).alias("cold_open_lines"))
    known = F.create_map(*[F.lit(x) for pair in SECTION_LABELS.items() for x in pair])
    arc = entries.where((text("section") != "") & ~F.col("section").isin("preamble", "postamble")).groupBy(*by, "section").agg(F.min("seq").alias("at"))
    arc = arc.withColumn("label", F.coalesce(known[F.col("section")], title_case(F.replace("section", F.lit("-"), F.lit(" ")))))
    arc = arc.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), " → ").alias("section_arc"))
    base = entries.groupBy(*by).agg(scene.alias("cold_open_scene"))
    return base.join(first, list(by), "left").join(arc, list(by), "left").withColumn("section_arc", F.coalesce("section_arc", F.lit("unknown")))


def chapters(entries: DataFrame, cast: DataFrame, by: Sequence[str], narrator: str) -> DataFrame:
    """Scene heads and lines as blocks with a voice, each in the chapter that its section header began."""
    run = Window.partitionBy(*by).orderBy("seq").rowsBetween(*UP_TO_NOW)
    head = F.last(F.when(F.col("type") == "section_header", F.col("text")), ignorenulls=True).over(run)
    number = F.count_if(F.col("type") == "section_header").over(run)
    voices = cast.select("speaker", F.col("voice_id").alias("_voice"))
    blocks = entries.withColumns({"chapter": F.coalesce(head, F.lit("Untitled")), "chapter_no": number}).where(F.col("type").isin("scene_header", "dialogue")).join(voices, "speaker", "left")
    voice = F.when(F.col("type") == "dialogue", F.coalesce("_voice", F.lit(narrator))).otherwise(narrator)
    return blocks.select(*by, "chapter_no", "chapter", "seq", F.when(F.col("type") == "scene_header", "h2").otherwise("p").alias("kind"), voice.alias("voice_id"), "text")


def voices_by_category(voices: DataFrame) -> DataFrame:
    return voices.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).count()


def language_list(languages: Column, shown: int = 3) -> Column:
    """The first distinct languages, and how many more there are."""
    distinct = F.array_distinct(languages)
    more = F.size(distinct) - shown
    return F.concat(F.array_join(F.slice(distinct, 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(""))


def removal_plan(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """Of the paths to remove those that are there, once each, with their size; nothing is deleted."""
    return wanted.select("path").distinct().join(listing.select("path", "size"), "path")


def eviction_plan(files: DataFrame, by: str, budget: int, keep: Column) -> DataFrame:
    """Files to evict, oldest first, until the rest of a folder fits the budget; kept ones count but stay."""
    total = F.sum("size").over(Window.partitionBy(by))
    before = F.coalesce(F.sum(F.when(~keep, F.col("size"))).over(Window.partitionBy(by).orderBy("modified", "size", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumns({"_total": total, "_before": before}).where(~keep & (F.col("_total") - F.col("_before") > budget)).drop("_total", "_before")


def unresolved(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Sources that no listed, non-empty file stands for."""
    return paths.join(listing.where("size > 0").select("path"), "path", "left_anti")
