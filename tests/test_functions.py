import difflib
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from castline.functions import exact
from castline.functions import text as t
from tests.test_parser import split_hints


def values(spark, rows, **columns):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_script_lines(spark):
    v = F.col("v")
    rows = ["====", "PRODUCTION NOTES:", "SCENE 12b: The Bar [SFX: RAIN]", "[MUSIC: STING] tail", "  text ", "-- -", "SCENE 3:", ""]
    got = values(spark, rows, d=t.is_divider(v), m=t.is_metadata_section(v), s=t.is_scene_header(v), c=t.is_stage_direction(v), n=t.scene_number(v), b=F.array_join(t.brackets(v), ","), p=t.strip_brackets(v))
    assert [r[0] for r in got] == [True, False, False, False, False, False, False, False]
    assert [r[1] for r in got][:2] == [False, True]
    assert got[2][2:] == (True, False, "12b", "SFX: RAIN", "SCENE 12b: The Bar")
    assert got[3][3] is True and got[3][5] == "MUSIC: STING"
    assert got[6][2] is True and got[6][4] is None


def test_direction_types_in_order(spark):
    v = F.col("v")
    rows = ["SFX: DOOR", "LONG BEAT", "INTRO MUSIC", "AMBIENCE: BAR", "PHONE FILTER ENGAGES", "sighs", "BEATLES PLAY"]
    assert [r[0] for r in values(spark, rows, k=t.direction_type(v))] == ["SFX", "BEAT", "MUSIC", "AMBIENCE", "PHONE FILTER", None, "BEAT"]


def test_header(spark):
    rows = ['THE SHOW Season 2 Episode 5: "Night" Arc: "Rain"', "Show Episode 7: Plain title", "nothing"]
    got = [r[0] for r in values(spark, rows, h=t.script_header(F.col("v")))]
    assert tuple(got[0]) == ("THE SHOW", 2, 5, "Night", "Rain")
    assert tuple(got[1]) == ("Show", None, 7, "Plain title", None)
    assert got[2] is None


def test_keys_and_slugs(spark):
    v = F.col("v")
    long = "x" * 200
    got = values(spark, ["MR. PATTERSON (V.O.)", "RÍAN", "SFX: DOOR — creaks!", long], k=t.display_to_key(v), s=t.effect_slug(v))
    assert got[0][0] == "mr_patterson" and got[1][0] == "rían"
    assert got[2][1] == "sfx_door-creaks"
    assert got[3][1] == "x" * 180 + "_" + hashlib.sha256(long.encode()).hexdigest()[:8]


def test_stem_names_round_trip(spark):
    df = spark.createDataFrame([(7, "act1", "scene-2", "adam", "dialogue"), (1234, "act1", None, None, "direction"), (-3, "x", "", "a", "dialogue")], "q long, s string, c string, p string, k string")
    name = t.stem_name(F.col("q"), F.col("s"), F.col("c"), F.col("p"), F.col("k"))
    rows = df.select("q", name.alias("n")).select("q", "n", t.stem_seq(F.concat(F.lit("a/b/"), "n", F.lit(".mp3"))).alias("back")).collect()
    assert [r["n"] for r in rows][:2] == ["007_act1-scene-2_adam", "1234_act1_sfx"]
    assert [r["back"] for r in rows] == [r["q"] for r in rows]
    assert values(spark, ["n012_a.mp3", "abc.mp3"], s=t.stem_seq(F.col("v"))) == [(-12,), (None,)]


@pytest.mark.parametrize("raw", ["SFX: A", "SFX: A | x.mp3 | play_volume_pct=20%", "SFX: A | soft | y.wav | z.mp3 | play_duration_pct=150", "MUSIC: B | play_duration_pct=50 | play_volume_pct=abc"])
def test_hints_in_columns_and_in_the_parser(spark, raw):
    row = values(spark, [raw], h=t.split_hints(F.col("v"), F.lit("show")))[0][0]
    assert (row["clean"], row["source"], row["overrides"]) == split_hints(raw, "show")


def test_tokens_and_scores(spark):
    rows = spark.createDataFrame([("SFX: THE CHAIRS SCRAPE", "chair-scrape-glass.mp3"), ("", "x")], "a string, b string")
    a, b = t.tokens(F.col("a")), t.tokens(F.col("b"))
    got = rows.select(a.alias("a"), b.alias("b"), t.coverage(a, b).alias("c"), t.jaccard(a, b).alias("j")).collect()
    assert got[0]["a"] == ["chair", "scrape"] and got[0]["b"] == ["chair", "glass", "scrape"]
    assert got[0]["c"] == 1.0 and got[0]["j"] == pytest.approx(2 / 3)
    assert got[1]["c"] == 0.0


def test_exact_functions(spark):
    df = spark.createDataFrame([(2.675, 2, "t-bone o'brien", "é"), (None, 1, None, None)], "x double, d int, s string, n string")
    got = df.select(exact.round_exact("x", "d"), exact.title_case("s"), exact.nfc("n"), exact.short_number("x")).collect()
    assert tuple(got[0]) == (2.67, "T-Bone O'Brien", "é", "2.675")
    assert got[1][0] is None
    pair = spark.createDataFrame([("the cat sat", "the cat sits")], "a string, b string").select(exact.similarity("a", "b")).collect()[0][0]
    assert pair == difflib.SequenceMatcher(None, "the cat sat", "the cat sits").ratio()


def test_durations_and_levels(spark):
    v = F.col("v")
    got = values(spark, ["2 min", "45s", "loop", "1.5 seconds", ""], d=t.parse_duration(v))
    assert [g[0] for g in got] == [120.0, 45.0, None, 1.5, None]
    levels = spark.createDataFrame([(100.0,), (0.0,), (50.0,)], "p double").select(t.volume_db(F.col("p"))).collect()
    assert levels[0][0] == 0.0 and levels[1][0] == float("-inf") and round(levels[2][0], 4) == -6.0206


def test_word_count_knows_all_white_space(spark):
    rows = ["", "  ", "a b  c", "é ü"]
    assert [r[0] for r in values(spark, rows, w=t.word_count(F.col("v")))] == [len(re.split(r"\s+", r.strip())) if r.strip() else 0 for r in rows]


def test_rounding_equals_sql(spark):
    import duckdb

    values = [-1e-9, 1e-9, 0.5e-6, -0.5e-6, 2.5e-6, -2.5e-6, 540190039.6557651, 371479962.37898499, 1e300, -1e305, float("inf"), 17.7827941]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").select(t.rounded(F.col("v"), 6).alias("r")).collect()
    assert [repr(r.r) for r in rows] == [repr(duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0]) for v in values] + ["None"]


def test_clock_without_seconds(spark):
    rows = spark.createDataFrame([(None,), (61.9,), (-61.5,)], "s double").select(t.clock(F.col("s")).alias("c")).collect()
    assert [r.c for r in rows] == [None, "1:01", "-2:-2"]
