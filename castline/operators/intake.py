"""What comes into a workspace: archives of stems, scripts and the episodes parsed from them, catalogues of voices and sounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castline.functions.text import base_name, nonblank, show_slug, stem_name, text

HEADERS = ("section_header", "scene_header")


def member_seq(member: Column) -> Column:
    """The digits that a member's name starts with, if an underscore follows them; else null."""
    return nonblank(F.regexp_extract(base_name(member), r"^(\d+)_", 1)).try_cast("long")


def archive_plan(members: DataFrame, entries: DataFrame, present: DataFrame, include: Sequence[str] = (), force: bool = False) -> DataFrame:
    """What becomes of the sound files of an archive (member): missing, header, skip, exists or extract, and the stem's name.

    ``entries`` (seq, type, section, scene, speaker, direction_type) have one row for each seq, the
    last one of the file; directions are taken if their type is in ``include``; stems in ``present``
    (stem) stay unless ``force``. Members that are no MP3 or have no number are left out.
    """
    side = entries.select("seq", "type", "section", "scene", "speaker", "direction_type")
    named = members.where(F.lower("member").endswith(".mp3")).withColumn("seq", member_seq(F.col("member"))).where("seq IS NOT NULL")
    stem = stem_name(F.col("seq"), F.col("section"), F.col("scene"), F.col("speaker"), F.col("type"))
    rows = named.join(side, "seq", "left").withColumn("stem", F.when(F.col("type").isNotNull(), F.concat(stem, F.lit(".mp3"))))
    rows = rows.join(present.select("stem", F.lit(True).alias("_there")).distinct(), "stem", "left")
    outcome = (
        F.when(F.col("type").isNull(), "missing")
        .when(F.col("type").isin(*HEADERS), "header")
        .when((F.col("type") == "direction") & ~text("direction_type").isin(*include), "skip")
        .when(F.coalesce("_there", F.lit(False)) & F.lit(not force), "exists")
        .otherwise("extract")
    )
    return rows.select("member", "seq", "stem", outcome.alias("outcome"))


#: Lengths of the beginnings of names by which they are looked up in sources; the greatest is half of what a file name may have.
ANCHORS = (1, 2, 4, 8, 16, 32, 64, 128)


def script_of_episode(scripts: DataFrame, parsed: DataFrame) -> DataFrame:
    """Scripts (name) with the first of the parsed episodes (source_file, at, ..) whose source holds their name.

    A name is looked up by its first letters, as many as the greatest power of two that it has
    letters for, so at least by half of it (by 128 where it has 256 or more). Each source is cut once into parts of these
    few lengths, names meet them in an equi-join, and what meets is compared whole.
    """
    # Of equal sources the first episode is enough.
    sources = parsed.groupBy("source_file").agg(F.min_by(F.struct(*parsed.columns), "at").alias("episode"), F.min("at").alias("at"))
    anchored = scripts.where("name != ''").select("name").distinct()
    size = F.least(F.pow(F.lit(2), F.floor(F.log2(F.length("name").cast("double")))), F.lit(ANCHORS[-1])).cast("int")
    # The logarithm of a power of two may fall short of it by rounding; a shorter beginning is as right.
    anchored = anchored.withColumn("_part", F.substring(F.col("name"), F.lit(1), size))
    part = lambda n: F.transform(F.sequence(F.lit(1), F.length("source_file") - n + 1), lambda i: F.substring(F.col("source_file"), i, F.lit(n)))
    parts = [F.when(F.length("source_file") >= n, part(n)).otherwise(F.array().cast("array<string>")) for n in ANCHORS]
    # The parts are many more than their table's size tells Spark: a semi-join never broadcasts them, and what it leaves is merged.
    cut = sources.withColumn("_part", F.explode(F.array_distinct(F.concat(*parts)))).join(anchored.select("_part").distinct(), "_part", "left_semi")
    held = cut.hint("merge").join(anchored, "_part").where(F.contains("source_file", "name"))
    first = held.groupBy("name").agg(F.min_by("episode", "at").alias("episode"))
    return scripts.join(first, "name", "left")


def suggested_name(header: Column) -> Column:
    """A script's file name from its header (show, season, episode, title); null without a header."""
    season = F.when(header["season"].isNull(), "XX").otherwise(F.format_string("%02d", header["season"]))
    title = F.regexp_replace(F.regexp_replace(header["title"], r"[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(header.isNotNull(), F.concat(F.lit("S"), season, F.lit("E"), F.format_string("%02d", header["episode"]), F.lit("_"), show_slug(header["show"]), F.lit("_"), title, F.lit("_v1.md")))


def marked_first(flag: Column, name: str) -> list[Column]:
    """Order: rows with the flag first, then by name whatever its case."""
    return [F.coalesce(flag, F.lit(False)).desc(), F.lower(text(name))]


def dated_first(date: str, name: str) -> list[Column]:
    """Order: dated rows first, the latest of them on top; then the others by name."""
    return [F.col(date).desc_nulls_last(), F.lower(text(name))]


def is_identifier(value: Column) -> Column:
    """Letters, digits, underscores and hyphens only: what may become part of a path."""
    return F.coalesce(value.rlike(r"^[A-Za-z0-9_-]+$"), F.lit(False))


def find_show(shows: DataFrame, wanted: str) -> DataFrame:
    """The first show (slug, name), by slug, whose slug is the wanted text or its slug, or whose name has that slug."""
    plain = show_slug(F.lit(wanted))
    return shows.where((F.col("slug") == wanted) | (F.col("slug") == plain) | (show_slug(F.col("name")) == plain)).orderBy("slug").limit(1)


def label_lines(layers: DataFrame) -> DataFrame:
    """Label tracks of a sound editor: start, end and text between tabs, by start."""
    return layers.orderBy("start_s", "end_s", "label").select(F.concat_ws("\t", F.format_string("%.3f", "start_s"), F.format_string("%.3f", "end_s"), "label").alias("value"))


def html_text(value: Column) -> Column:
    """The text with what HTML reads as markup escaped."""
    for mark, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(mark), F.lit(shown))
    return value


def padded(value: Column, width: int) -> Column:
    """Filled with spaces up to a width; longer texts stay whole."""
    return F.when(F.length(value) >= width, value).otherwise(F.rpad(value, width, " "))
