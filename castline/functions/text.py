"""Text expressions of scripts and cues, as columns.

Java's ``\\w`` and ``\\s`` are ASCII only; ``(?U)`` makes them Unicode, as scripts need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Direction types in the order in which they are tested.
DIRECTION_TYPES = ("SFX", "MUSIC", "AMBIENCE", "BEAT", "VINTAGE FILTER", "FILM AUDIO", "SPEAKERPHONE", "PHONE FILTER")
# Headers that begin the notes after a script.
METADATA_SECTIONS = (
    "PRODUCTION NOTES:", "SOCIAL MEDIA PROMPT:", "KEY CHANGES FROM ORIGINAL:", "ACCESSIBILITY NOTES:",
    "VOICES NEEDED THIS EPISODE:", "KEY SOUND EFFECTS:", "MUSIC CUES:",
)
# Words that say nothing about a sound.
STOP_WORDS = (
    "sfx", "ambience", "ambient", "music", "beat", "new", "stem", "needed", "mp3", "wav", "elevenlabs",
    "a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "it", "its", "of", "on", "or", "s", "the", "then", "to", "with", "",
)
#: Longest slug; longer ones are cut and end in eight digits of their digest.
SLUG_LENGTH = 180


def text(value: Column | str) -> Column:
    """The column, null as empty."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def strip(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def truthy(value: Column, kind: str) -> Column:
    """False for null, zero, false and empty strings, by the column's type."""
    if kind == "boolean":
        return F.coalesce(value, F.lit(False))
    if kind == "string":
        return F.coalesce(value != "", F.lit(False))
    return F.coalesce(value != 0, F.lit(False))


def nonblank(value: Column) -> Column:
    """Null instead of an empty string."""
    return F.nullif(value, F.lit(""))


def word_count(value: Column) -> Column:
    """Words between Unicode white space; none in an empty text."""
    words = strip(text(value))
    return F.when(words == "", 0).otherwise(F.size(F.split(words, r"(?U)\s+"))).cast("long")


def head(value: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(value, 1, n)


def first_words(value: Column, n: int = 5) -> Column:
    """The first n words, joined by single spaces."""
    return F.array_join(F.slice(F.split(strip(text(value)), r"(?U)\s+"), 1, n), " ")


def snip(value: Column, n: int = 55) -> Column:
    """At most n characters on one line, with a mark where something was cut."""
    flat = F.regexp_replace(text(value), r"[\r\n]+", " ")
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


# Script lines


def strip_escapes(value: Column) -> Column:
    """Markdown backslash escapes resolved."""
    plain = F.replace(F.replace(value, F.lit("\\["), F.lit("[")), F.lit("\\]"), F.lit("]"))
    plain = F.replace(F.replace(plain, F.lit("\\==="), F.lit("===")), F.lit("\\="), F.lit("="))
    return F.regexp_replace(plain, r"\\(.)", "$1")


def strip_formatting(line: Column) -> Column:
    """One line without heading marks, bold marks and white space at its end."""
    plain = F.replace(F.regexp_replace(line, r"(?U)^#{1,6}\s*", ""), F.lit("**"), F.lit(""))
    return F.regexp_replace(plain, r"(?U)\s+$", "")


def is_divider(line: Column) -> Column:
    return strip(line).rlike(r"^(={3,}|-{3,})$")


def is_metadata_section(line: Column) -> Column:
    return strip(line).isin(*METADATA_SECTIONS)


def is_scene_header(line: Column) -> Column:
    return line.rlike(r"^SCENE \d+[A-Za-z]*:")


def is_stage_direction(line: Column) -> Column:
    return line.startswith("[") & line.contains("]")


def scene_number(line: Column) -> Column:
    return nonblank(F.regexp_extract(line, r"^SCENE (\d+[A-Za-z]*):\s*.+", 1))


def scene_name(line: Column) -> Column:
    return nonblank(strip(F.regexp_extract(line, r"^SCENE \d+[A-Za-z]*:\s*(.+)", 1)))


def brackets(line: Column) -> Column:
    """What stands in each pair of brackets, in order."""
    return F.regexp_extract_all(line, F.lit(r"\[([^\]]+)\]"), 1)


def strip_brackets(line: Column) -> Column:
    return strip(F.regexp_replace(strip(line), r"(?U)\s*\[[^\]]+\]", ""))


def is_caps_candidate(line: Column) -> Column:
    """A line in capitals of 2 to 79 characters that may name a speaker or a section."""
    other = is_divider(line) | is_stage_direction(line) | is_scene_header(line) | line.endswith(":")
    return F.length(line).between(2, 79) & (line == F.upper(line)) & ~other


def direction_type(value: Column) -> Column:
    """The first direction type that the text starts with; special names after that; else null."""
    t = strip(value)
    found = reduce(lambda case, kind: case.when(t.startswith(kind), kind), DIRECTION_TYPES[1:], F.when(t.startswith(DIRECTION_TYPES[0]), DIRECTION_TYPES[0]))
    return found.when(t.isin("BEAT", "LONG BEAT"), "BEAT").when(t.isin("INTRO MUSIC", "OUTRO MUSIC"), "MUSIC")


def script_header(line: Column) -> Column:
    """show, season, episode, title and season_title of a header line, as a struct; null without an episode number."""
    episode = F.regexp_extract(line, r"Episode\s+(\d+)", 1)
    show = F.regexp_extract(line, r"^(.*?)\b(?:Season\s+\d+|Episode\s+\d+)", 1)
    show = F.when(line.rlike(r"\b(?:Season\s+\d+|Episode\s+\d+)"), strip(show)).otherwise("Unknown Show")
    rest = F.regexp_extract(line, r"Episode\s+\d+[:\s]+(.*)", 1)
    quoted = F.regexp_extract(rest, '"([^"]+)"', 1)
    header = F.struct(
        show.alias("show"),
        nonblank(F.regexp_extract(line, r"Season\s+(\d+)", 1)).try_cast("long").alias("season"),
        F.coalesce(episode.try_cast("long"), F.lit(1)).alias("episode"),
        F.coalesce(nonblank(quoted), strip(rest)).alias("title"),
        nonblank(F.regexp_extract(line, r'\bArc:\s*"([^"]+)"', 1)).alias("season_title"),
    )
    return F.when(episode != "", header)


def section_slug(line: Column, sections: dict[str, str]) -> Column:
    """The slug of a section header: of the whole line, or else of what stands before its first colon."""
    known = F.create_map(*[F.lit(x) for pair in sections.items() for x in pair])
    whole = strip(line)
    return F.coalesce(known[whole], F.when(whole.contains(":"), known[strip(F.substring_index(whole, ":", 1))]))


# Names and paths


def display_to_key(display: Column) -> Column:
    """A speaker's display name as a key: no parentheses and signs, lower case, underscores."""
    name = strip(F.regexp_replace(display, r"(?U)\s*\([^)]*?\)\s*", " "))
    name = strip(F.lower(F.regexp_replace(name, r"(?U)[^\w\s]", "")))
    return F.regexp_replace(F.regexp_replace(name, r"(?U)\s+", "_"), "^_+|_+$", "")


def effect_slug(cue: Column) -> Column:
    """A cue's text as a file name."""
    slug = F.replace(F.lower(cue), F.lit(": "), F.lit("_"))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(slug, r"[^a-z0-9_]+", "-"), "-{2,}", "-"), "^-+|-+$", "")
    short = F.regexp_replace(F.substring(slug, 1, SLUG_LENGTH), "-+$", "")
    return F.when(F.length(slug) > SLUG_LENGTH, F.concat(short, F.lit("_"), F.substring(F.sha2(slug, 256), 1, 8))).otherwise(slug)


def effect_path(folder: Column, cue: Column, backend: Column) -> Column:
    """Where a cue's sound lies in a shared library; other back ends than the first add their name."""
    infix = F.when(backend == "elevenlabs", "").otherwise(F.concat(F.lit("."), backend))
    return F.concat(folder, F.lit("/"), effect_slug(cue), infix, F.lit(".mp3"))


def show_slug(show: Column) -> Column:
    return F.regexp_replace(F.lower(show), "[^a-z0-9]", "")


def episode_tag(season: Column, episode: Column) -> Column:
    return F.when(season.isNull(), F.format_string("E%02d", episode)).otherwise(F.format_string("S%02dE%02d", season, episode))


def stem_name(seq: Column, section: Column, scene: Column, speaker: Column, kind: Column) -> Column:
    """The base name of an entry's sound file."""
    place = F.when(text(scene) != "", F.concat(F.lit("-"), scene)).otherwise("")
    who = F.when(kind == "dialogue", F.concat(F.lit("_"), text(speaker))).otherwise("_sfx")
    return F.concat(F.format_string("%03d", F.coalesce(seq, F.lit(0))), F.lit("_"), text(section), place, who)


def stem_seq(path: Column) -> Column:
    """The number before the first underscore of a file name; an ``n`` before it makes it negative."""
    prefix = F.substring_index(F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", ""), "_", 1)
    old = F.regexp_extract(prefix, r"^n(\d+)$", 1)
    return F.when(old != "", -old.try_cast("long")).otherwise(F.when(strip(prefix).rlike(r"^[+-]?\d+$"), strip(prefix).try_cast("long")))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


# Cues and mixing


def tokens(value: Column) -> Column:
    """The sorted distinct words of a cue or file name, without stop words, simple plurals folded."""
    words = F.filter(F.split(F.lower(text(value)), r"[^a-z0-9]+"), lambda w: ~w.isin(*STOP_WORDS))
    single = F.transform(words, lambda w: F.when((F.length(w) >= 4) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w))
    return F.array_sort(F.array_distinct(single))


def coverage(cue: Column, asset: Column) -> Column:
    """The share of the cue's tokens that the asset has; 0 if one side is empty."""
    return F.when((F.size(cue) == 0) | (F.size(asset) == 0), 0.0).otherwise(F.size(F.array_intersect(cue, asset)) / F.size(cue))


def jaccard(cue: Column, asset: Column) -> Column:
    return F.when((F.size(cue) == 0) | (F.size(asset) == 0), 0.0).otherwise(F.size(F.array_intersect(cue, asset)) / F.size(F.array_union(cue, asset)))


def placement(cue: Column) -> Column:
    """Where a cue sits in the mix."""
    key = strip(F.upper(cue))
    music = key.startswith("MUSIC") | key.startswith("INTRO MUSIC") | key.startswith("OUTRO MUSIC") | F.substring_index(key, ":", 1).contains(" MUSIC")
    return F.when(music, "MUSIC(bg)").when(key.startswith("AMBIEN"), "AMBI(bg)").when(key.startswith("BEAT"), "BEAT(fg)").otherwise("SFX(fg)")


def file_placement(name: Column) -> Column:
    """Where a sound sits in the mix, from its file name."""
    f = F.lower(name)
    return (
        F.when(f.rlike(r"^(ambience[_-]|amb[_-]|amb\p{L})"), "AMBI(bg)")
        .when(f.rlike(r"^(music[_-]|mus[_-]|mus\p{L})"), "MUSIC(bg)")
        .when(f.startswith("beat"), "BEAT(fg)")
        .otherwise("SFX(fg)")
    )


def loss_tier(seconds: Column) -> Column:
    return F.when(seconds < 0.1, "1-nochange").when(seconds < 3.0, "2-minor").otherwise("3-review")


def scope_rank(scope: Column, own: Column) -> Column:
    """0 for the own show, 1 for the shared folder, 2 for other shows."""
    return F.when(F.coalesce(scope == own, F.lit(False)), 0).when(text(scope) == "", 1).otherwise(2)


def default_duration(cue: Column) -> Column:
    return F.when(cue.startswith("AMBIENCE:"), 30.0).when(cue.startswith("MUSIC:"), 15.0).otherwise(5.0)


def parse_duration(value: Column) -> Column:
    """Seconds of ``2 min`` or ``45s``; null for loops and what is no duration."""
    t = strip(value)
    number = F.regexp_extract(t, r"(?i)(\d+(?:\.\d+)?)\s*(s|sec|seconds?|m|min|minutes?)\b", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(t, r"(?i)(\d+(?:\.\d+)?)\s*(s|sec|seconds?|m|min|minutes?)\b", 2))
    return F.when(t.rlike("(?i)loop"), None).otherwise(F.when(unit.startswith("m"), number * 60).otherwise(number))


def generation_seconds(duration: Column) -> Column:
    """What a cue of this duration is generated with: 30 seconds at most, 5 if it has none."""
    return F.when(duration > 0, F.least(duration, F.lit(30.0))).otherwise(5.0)


def volume_db(percent: Column) -> Column:
    """Decibels of a volume in per cent; minus infinity at or below zero."""
    return F.when(percent <= 0, F.lit(float("-inf"))).otherwise(20 * F.log10(percent / 100))


def ratio_db(ratio: Column) -> Column:
    return F.when(ratio <= 0, F.lit(float("-inf"))).otherwise(20 * (F.ln(ratio) / F.ln(F.lit(10.0))))


def db_factor(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def rounded(value: Column, digits: int) -> Column:
    """Rounded as SQL engines do that scale doubles: half away from zero on the scaled value; -0.0 stays, what cannot be scaled too."""
    scale = 10.0**digits
    scaled = value * scale
    even = F.rint(scaled)
    whole = F.when((scaled - even == 0.5) & (scaled > 0), even + 1).when((scaled - even == -0.5) & (scaled < 0), even - 1).otherwise(even)
    return F.when(F.abs(scaled) == float("inf"), value).otherwise(whole / scale)


def clock(seconds: Column) -> Column:
    """``M:SS``; null without seconds."""
    whole = F.floor(seconds).cast("long")
    return F.when(whole.isNotNull(), F.format_string("%d:%02d", F.floor(whole / 60), whole % 60))


def content_key(*parts: Column) -> Column:
    """One digest of several parts, nulls told apart from empty strings."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def migration_text(value: Column, strict: bool = False) -> Column:
    """Single spaces; unless ``strict``, dashes, ellipses and curly quotes made plain."""
    flat = F.regexp_replace(strip(text(value)), r"(?U)\s+", " ")
    if strict:
        return flat
    flat = F.replace(F.regexp_replace(flat, r"(?U)\s*—\s*", " - "), F.lit("…"), F.lit("..."))
    return F.translate(flat, "‘’“”", "''\"\"")


def spoken_text(value: Column) -> Column:
    """Lower case, signs as spaces, single spaces: what transcripts are compared by."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text(value)), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def split_hints(raw: Column, slug: Column) -> Column:
    """clean, source and overrides of a direction with hints after `` | ``.

    The first ``.mp3`` or ``.wav`` is the source; ``play_volume_pct`` (0 to 200) and
    ``play_duration_pct`` (0 to 100) are overrides, the last one of each counts; all else stays text.
    """
    parts = F.transform(F.split(raw, r" \| "), strip)
    rest = F.slice(parts, 2, 1_000_000)
    is_file = lambda p: p.endswith(".mp3") | p.endswith(".wav")
    files = F.filter(rest, is_file)
    name = lambda p: strip(F.substring_index(p, "=", 1))
    number = lambda p: F.regexp_replace(F.regexp_replace(F.substring(p, F.instr(p, "=") + 1, F.length(p)), r"(?U)^\s+|\s+$", ""), r"(?U)%+$|%+\s*$", "").try_cast("double")
    top = lambda p: F.when(name(p) == "play_volume_pct", 200.0).when(name(p) == "play_duration_pct", 100.0)
    good = lambda p: ~is_file(p) & p.contains("=") & F.coalesce(number(p).between(0.0, top(p)), F.lit(False))
    pairs = F.filter(
        F.array(
            F.struct(F.lit("volume_percentage").alias("k"), F.try_element_at(F.transform(F.filter(rest, lambda p: good(p) & (name(p) == "play_volume_pct")), number), F.lit(-1)).alias("v")),
            F.struct(F.lit("play_duration").alias("k"), F.try_element_at(F.transform(F.filter(rest, lambda p: good(p) & (name(p) == "play_duration_pct")), number), F.lit(-1)).alias("v")),
        ),
        lambda p: p["v"].isNotNull(),
    )
    # Of several files the first is taken out; the others stay text.
    first_at = F.array_position(F.transform(rest, is_file), True)
    kept = F.filter(rest, lambda p, i: (is_file(p) & (i + 1 != first_at)) | (~is_file(p) & ~good(p)))
    prefix = F.when(text(slug) == "", "SFX").otherwise(F.concat(F.lit("SFX/"), slug))
    return F.struct(
        F.array_join(F.concat(F.slice(parts, 1, 1), kept), " | ").alias("clean"),
        F.when(F.size(files) > 0, F.concat(prefix, F.lit("/"), F.try_element_at(files, F.lit(1)))).alias("source"),
        F.map_from_entries(pairs).alias("overrides"),
    )


def allowed_overrides(cue: Column, silence: Column, overrides: Column) -> Column:
    """Overrides that a cue can use: none for silence, no play duration for looped cues."""
    looped = cue.startswith("AMBIENCE:") | cue.startswith("VINTAGE FILTER")
    return F.when(silence, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).otherwise(F.map_filter(overrides, lambda k, _: ~(looped & (k == "play_duration"))))
