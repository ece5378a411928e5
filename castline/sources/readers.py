"""Readers of scripts, parsed episodes, configurations, journals, logs and file listings.

All schemas are explicit; files that hold one document are read whole, the rest by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castline.functions.text import base_name, head, nonblank, stem_seq
from castline.sources.rejects import Split, split

ENTRY = (
    "struct<seq: bigint, type: string, section: string, scene: string, speaker: string, direction: string, text: string,"
    " direction_type: string, sfx_source: string, sfx_overrides: map<string, double>>"
)
EPISODE = (
    f"show string, season long, episode long, title string, season_title string, source_file string, entries array<{ENTRY}>,"
    " stats struct<total_entries: bigint, dialogue_lines: bigint, direction_lines: bigint, characters_for_tts: bigint, speakers: array<string>, sections: array<string>>"
)
EFFECT = (
    "struct<type: string, prompt: string, source: string, duration_seconds: double, loop: boolean, play_duration: double,"
    " volume_percentage: double, ramp_in_seconds: double, ramp_out_seconds: double, prompt_influence: double>"
)
VOICE = "struct<full_name: string, voice_id: string, pan: double, filter: string, role: string, language_code: string>"
SPEAKER = "display string, key string, full_name string, role string, voice_id string, pan double, filter string"
JOURNAL = "ts string, key string, seq long, scope string, fields map<string, string>"


def file_columns() -> list[Column]:
    """The path of the file that a row comes from, which tells shows apart whose files have equal names, and its name."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name")]


def path_parts(path: Column) -> tuple[Column, Column]:
    """The folder of a show and the tag of an episode in paths like ``parsed/<show>/parsed_<tag>.json``; the show is null in the flat layout."""
    part = lambda pattern: nonblank(F.regexp_extract(path, pattern, 1))
    return part(r"/(?:parsed|configs|scripts|stems)/([^/]+)/[^/]+$"), part(r"_([SE]\d[^/_.]*|V\d[^/_.]*)[^/]*$")


def episodes_found(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(show_dir, tag, kinds) of all episodes that have a file below one of the paths, in either layout; ``kinds`` are the folders or, in the flat one, the beginnings of the names."""
    kind = F.regexp_extract("path", r"/(parsed|configs|scripts|stems)/[^/]+/[^/]+$", 1)
    flat = F.regexp_extract("path", r"/([a-z]+)_[^/]*$", 1)
    rows = None
    for path in paths:
        found = files(spark, path)
        show, tag = path_parts(F.col("path"))
        found = found.select(show.alias("show_dir"), tag.alias("tag"), F.when(kind != "", kind).otherwise(flat).alias("kind")).where("tag IS NOT NULL")
        rows = found if rows is None else rows.unionByName(found)
    return rows.groupBy("show_dir", "tag").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """One row for each file: path, name, size, modified. Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", base_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def hashed_files(spark: SparkSession, path: str, pattern: str = "*.mp3") -> DataFrame:
    """File listing with the SHA-256 of each content, and the sequence number in its name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", base_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), stem_seq(F.col("path")).alias("seq"))


def script_lines(spark: SparkSession, path: str) -> DataFrame:
    """Scripts as lines: file (its path), name, line_no (from 1), raw. Each file is read whole, so lines keep their order."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(*file_columns(), F.posexplode(F.split("value", "\n")).alias("at", "raw"))
    return whole.select("file", "name", (F.col("at") + 1).alias("line_no"), "raw")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Logs as lines: file, name, line_no, raw and log_date, the first date in the file's name, or else today."""
    date = nonblank(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1))
    return script_lines(spark, path).withColumn("log_date", F.coalesce(date, F.current_date().cast("string")))


def episodes(spark: SparkSession, path: str) -> DataFrame:
    """Parsed episodes, one row for each JSON file below a path, with the file's path and name."""
    return spark.read.schema(EPISODE).option("multiLine", "true").option("recursiveFileLookup", "true").json(path).select("*", *file_columns())


def entries(spark: SparkSession, path: str, preview: int | None = None) -> DataFrame:
    """The entries of parsed episodes in file order; ``preview`` cuts texts to so many characters."""
    rows = episodes(spark, path).select("file", "name", "show", "season", "episode", F.posexplode("entries").alias("at", "entry")).select("file", "name", "show", "season", "episode", "at", "entry.*")
    return rows.withColumn("text", head(F.col("text"), preview)) if preview else rows


def effects(spark: SparkSession, path: str) -> DataFrame:
    """Sound configurations, one row for each cue in file order; what is no object is left out.

    ``defaults`` is kept as a map; a cue without a type is an ``sfx``, one without a duration lasts 5 seconds.
    """
    schema = "show string, season long, episode long, defaults map<string, double>, effects map<string, string>"
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path).select(*file_columns(), "show", "defaults", F.posexplode("effects").alias("at", "cue", "raw"))
    rows = rows.withColumn("effect", F.from_json("raw", EFFECT.removeprefix("struct<").removesuffix(">").replace(": ", " "))).where(F.col("raw").startswith("{") & F.col("effect").isNotNull())
    effect = F.col("effect")
    filled = effect.withField("type", F.coalesce(effect["type"], F.lit("sfx"))).withField("duration_seconds", F.coalesce(effect["duration_seconds"], F.lit(5.0)))
    return rows.select("file", "name", "show", "defaults", "at", "cue", filled.alias("effect"))


def cast(spark: SparkSession, path: str) -> DataFrame:
    """Cast configurations, one row for each speaker; a speaker without a name or voice stops the job."""
    rows = spark.read.schema(f"show string, title string, artist string, tag string, cast map<string, {VOICE}>").option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    rows = rows.select(*file_columns(), "show", F.posexplode("cast").alias("at", "speaker", "voice")).select("file", "name", "show", "at", "speaker", "voice.*")
    return rows.withColumn("full_name", F.when(F.col("full_name").isNull() | F.col("voice_id").isNull(), F.raise_error(F.concat(F.lit("incomplete cast member "), "speaker")).cast("string")).otherwise(F.col("full_name")))


def speakers(spark: SparkSession, path: str) -> DataFrame:
    """The speakers' registry."""
    return spark.read.schema(SPEAKER).option("multiLine", "true").json(path)


#: Why a line of a journal is no record.
NO_JSON, NO_FIELDS, NO_KEY = "no JSON object", "no fields", "no key, seq or scope"


def tagged_journal(spark: SparkSession, path: str) -> DataFrame:
    """The lines of edit journals that are not blank: file, name, line_no, raw, the record, and the reason why it is none."""
    lines = script_lines(spark, path).where(F.trim("raw") != "")
    parsed = lines.withColumn("record", F.from_json("raw", JOURNAL, {"mode": "PERMISSIVE"}))
    keyed = F.col("record.key").isNotNull() | F.col("record.seq").isNotNull() | F.coalesce(F.col("record.scope") == "defaults", F.lit(False))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"), F.lit(False))
    return parsed.withColumn("reason", F.when(F.col("record.fields").isNotNull() & keyed, None).when(~is_object, NO_JSON).when(F.col("record.fields").isNull(), NO_FIELDS).otherwise(NO_KEY))


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Edit journals: file, line_no and the record's columns; malformed lines are left out (``journal_with_rejects`` has them).

    Null fields stay in the map: they clear what was set before.
    """
    return tagged_journal(spark, path).where("reason IS NULL").select("file", "name", "line_no", "record.*")


def journal_with_rejects(spark: SparkSession, path: str, folder: str) -> Split:
    """The records of edit journals, and the lines that are none (file, line_no, raw, reason), from one scan."""
    both = split(tagged_journal(spark, path), folder, (NO_JSON, NO_FIELDS, NO_KEY))
    return Split(both.kept.select("file", "name", "line_no", "record.*"), both.rejects.select("file", "line_no", "raw", "reason"), both.counts)


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with quoted line ends and doubled quotes; missing cells are null, blank rows are skipped.

    Columns are bound by name, whatever their order in the file.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False, mode="PERMISSIVE")
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])


def last_by_seq(rows: DataFrame) -> DataFrame:
    """Of entries with the same file and seq the last in file order."""
    return rows.groupBy("file", "seq").agg(F.max_by(F.struct(*rows.columns), "at").alias("_last")).select("_last.*")
