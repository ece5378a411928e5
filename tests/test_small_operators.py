import json

import pytest
from pyspark.sql import functions as F

from castline.operators import intake, joins, merge, sequence
from castline.sources import readers, sinks


def test_stale_stems_of_two_episodes(spark):
    stems = spark.createDataFrame([("e1", "a/003_main_eve.mp3", "003_main_eve", 3), ("e2", "b/003_main_eve.mp3", "003_main_eve", 3), ("e2", "b/004_main_sfx.mp3", "004_main_sfx", 4)], "tag string, path string, base string, seq long")
    entries = spark.createDataFrame([("e1", 3, "dialogue", "main", None, "eve"), ("e2", 3, "dialogue", "main", None, "adam"), ("e1", 4, "direction", "main", None, None)], "tag string, seq long, type string, section string, scene string, speaker string")
    got = sorted(map(tuple, joins.stale_stems(stems, entries, ["tag"]).collect()))
    assert got == [("e2", "b/003_main_eve.mp3", 3, "seq 3 speaker is now adam"), ("e2", "b/004_main_sfx.mp3", 4, "seq not in parsed JSON")]


def test_numbering_in_one_order(spark):
    rows = spark.createDataFrame([(i, f"{'aBcD'[i % 4]}{i % 7}", i % 3 == 0, 1) for i in range(200)] + [(300, None, None, 1)], "id int, name string, flag boolean, _before int").drop("_before")
    name = F.lower("name")
    got = sequence.numbered(rows, [F.substring(name, 1, 1)], [F.asc_nulls_first(name), "id"], "n").collect()
    want = sorted(got, key=lambda r: (r.name is not None, (r.name or "").lower(), r.id))
    assert [r.n for r in want] == list(range(1, 202))
    assert sequence.numbered(rows.limit(0), [name], ["id"], "n").count() == 0


def test_orders_of_catalogues(spark):
    rows = spark.createDataFrame([("b", "2024-01-01"), ("C", None), ("a", "2024-05-01"), ("A0", None), (None, None)], "name string, date string")
    assert [r.name for r in rows.orderBy(*intake.dated_first("date", "name")).collect()] == ["a", "b", None, "A0", "C"]
    shown = rows.select(intake.padded(F.col("name"), 2).alias("p")).collect()
    assert sorted(r.p for r in shown if r.p) == ["A0", "C ", "a ", "b "]


def test_shows_are_found(spark):
    shows = spark.createDataFrame([("latehour", "The Late Hour"), ("nightsky", "Night Sky"), ("x", "Late-Hour")], "slug string, name string")
    assert [r.slug for r in intake.find_show(shows, "nightsky").collect()] == ["nightsky"]
    assert [r.slug for r in intake.find_show(shows, "Night Sky!").collect()] == ["nightsky"]
    assert [r.slug for r in intake.find_show(shows, "late hour").collect()] == ["latehour"]
    assert intake.find_show(shows, "nothing").count() == 0


def test_cast_and_speakers(spark, tmp_path):
    voice = {"full_name": "Eve L", "voice_id": "v1", "pan": 0.5, "filter": "phone", "role": "lead"}
    (tmp_path / "cast").mkdir()
    (tmp_path / "cast" / "a.json").write_text(json.dumps({"show": "S", "cast": {"eve": voice, "adam": voice | {"voice_id": "v2"}}}, indent=2))
    got = readers.cast(spark, str(tmp_path / "cast")).orderBy("at").collect()
    assert [(r.speaker, r.voice_id, r.pan) for r in got] == [("eve", "v1", 0.5), ("adam", "v2", 0.5)]
    (tmp_path / "cast" / "b.json").write_text(json.dumps({"show": "T", "cast": {"eve": {"full_name": "Eve"}}}))
    with pytest.raises(Exception, match="incomplete cast member eve"):
        readers.cast(spark, str(tmp_path / "cast")).collect()
    (tmp_path / "speakers.json").write_text(json.dumps([{"display": "EVE", "key": "eve", "voice_id": "v"}, {"display": "ADAM", "key": "adam"}]))
    assert [(r.display, r.voice_id) for r in readers.speakers(spark, str(tmp_path / "speakers.json")).orderBy("key").collect()] == [("ADAM", None), ("EVE", "v")]


def test_journals_are_appended(spark, tmp_path):
    path = str(tmp_path / "journal")
    schema = "ts string, key string, fields map<string,string>"
    sinks.append_journal(spark.createDataFrame([("1", "A", {"source": "x"})], schema), path)
    sinks.append_journal(spark.createDataFrame([("2", "A", {"source": None})], schema), path)
    got = sorted((r.ts, r.fields) for r in readers.journal(spark, path).collect())
    assert got == [("1", {"source": "x"}), ("2", {"source": None})]


def test_stem_plans(spark):
    entry = "tag string, seq long, type string, direction_type string, section string, scene string, speaker string, text string"
    entries = spark.createDataFrame(
        [
            ("e", 1, "dialogue", None, "a", "s1", "eve", "Hi"), ("e", 2, "direction", "SFX", "a", None, None, "SFX: DOOR"), ("e", -1, "direction", "MUSIC", "preamble", None, None, "MUSIC: THEME"),
            ("e", 3, "scene_header", None, "a", None, None, "SCENE"), ("e", 4, "direction", "AMBIENCE", "a", None, None, "AMBIENCE: RAIN FADES OUT"), ("e", 5, "direction", "AMBIENCE", "a", None, None, "AMBIENCE: RAIN"),
            ("e", 6, "direction", "PHONE FILTER", "a", None, None, "PHONE FILTER ENGAGES"), ("e", 7, "direction", "VINTAGE FILTER", "a", None, None, "VINTAGE FILTER ENGAGES"), ("e", 8, "dialogue", None, "a", None, None, "x"),
            ("f", 1, "dialogue", None, "a", None, "adam", "Hi"), ("f", 9, None, None, None, None, None, None),
        ], entry)
    stems = spark.createDataFrame(
        [
            ("e", "b/001_eve.mp3", "001_eve", 1), ("e", "a/001_eve.mp3", "001_eve", 1), ("e", "a/001_adam.mp3", "001_adam", 1), ("e", "a/002_sfx.mp3", "002_sfx", 2), ("e", "c/002_eve.mp3", "002_eve", 2), ("e", "n001_sfx.mp3", "n001_sfx", -1),
            ("e", "003.mp3", "003", 3), ("e", "008_any.mp3", "008_any", 8), ("f", "001_sfx.mp3", "001_sfx", 1), ("f", "009_x.mp3", "009_x", 9), ("f", "010_x.mp3", "010_x", 10), ("f", "x.mp3", "x", None),
        ], "tag string, path string, base string, seq long")
    got = {(r.tag, r.seq, r.path): (r.plan, r.reason, r.foreground) for r in joins.stem_plans(stems, entries, ["tag"]).collect()}
    assert got == {
        ("e", 1, "a/001_eve.mp3"): ("stem", None, False), ("e", 1, "b/001_eve.mp3"): ("rejected", "seq 1 already loaded", False), ("e", 1, "a/001_adam.mp3"): ("rejected", "seq 1 speaker is now eve", False),
        ("e", 2, "a/002_sfx.mp3"): ("stem", None, False), ("e", 2, "c/002_eve.mp3"): ("rejected", "seq 2 is now a direction entry", False), ("e", -1, "n001_sfx.mp3"): ("stem", None, True),
        ("e", 3, "003.mp3"): ("rejected", "seq 3 is now a scene_header entry", False), ("e", 8, "008_any.mp3"): ("stem", None, False), ("f", 1, "001_sfx.mp3"): ("rejected", "seq 1 is now a dialogue entry", False),
        ("f", 9, "009_x.mp3"): ("rejected", "seq 9 is now a None entry", False), ("f", 10, "010_x.mp3"): ("rejected", "seq 10 not in parsed JSON", False),
        ("e", 4, ""): ("sentinel", None, False), ("e", 6, ""): ("sentinel", None, False),
    }


def test_edits_of_dialogue(spark):
    entries = spark.createDataFrame([("a", 1, "dialogue", "m", "eve", None, "Hi"), ("a", 2, "direction", "m", None, None, "SFX: A"), ("b", 1, "dialogue", "m", "adam", "low", "Yes"), ("c", 1, "dialogue", "m", "eve", None, "No")], "tag string, seq long, type string, section string, speaker string, direction string, text string")
    edits = spark.createDataFrame(
        [("a", 1, "2", {"text": "Hello", "pan": "1"}), ("a", 1, "1", {"text": "Old", "speaker": "adam"}), ("a", 2, "1", {"text": "x"}), ("b", 1, "1", {"direction": None}), ("c", 1, "1", {"text": "No"}), ("d", 1, "1", {"text": "x"})],
        "tag string, seq long, ts string, fields map<string,string>",
    )
    found = merge.edit_dialogue(entries, edits, ["tag"])
    assert sorted((r.tag, r.seq, r.speaker, r.direction, r.text) for r in found.entries.collect()) == [("a", 1, "adam", None, "Hello"), ("a", 2, None, None, "SFX: A"), ("b", 1, "adam", None, "Yes"), ("c", 1, "eve", None, "No")]
    assert sorted((r.tag, r.seq, r.ts, str(r.fields), str(r.before)) for r in found.journal.collect()) == [("a", 1, "2", "{'speaker': 'adam', 'text': 'Hello'}", "{'speaker': 'eve', 'text': 'Hi'}"), ("b", 1, "1", "{'direction': None}", "{'direction': 'low'}")]
    assert sorted((r.tag, r.characters_for_tts, r.speakers) for r in found.stats.collect()) == [("a", 5, ["adam"]), ("b", 3, ["adam"])]
    assert sorted((r.tag, r.seq, r.field, r.reason) for r in found.rejects.collect()) == [("a", 1, "pan", "field that no edit sets"), ("a", 2, "text", "no line of dialogue"), ("d", 1, "text", "no line of dialogue")]


def test_scripts_of_episodes_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    names = [None, "", "a", "b.md", *{"".join(rng.choice("abc/") for _ in range(n)) for n in (1, 2, 3, 4, 7, 8, 9, 15, 16, 17) for _ in range(3)}, "x" * 300]
    sources = ["", None, "x" * 299, "y" + "x" * 301, *["".join(rng.choice("abc/") for _ in range(rng.randint(0, 60))) for _ in range(40)]]
    sources += [f"in/{n}/s" for n in names if n][::2]
    parsed = spark.createDataFrame(list(enumerate(sources)), "at int, source_file string")
    got = {r.name: r.episode.at if r.episode else None for r in intake.script_of_episode(spark.createDataFrame([(n,) for n in names], "name string"), parsed).collect()}
    assert got == {n: next((at for at, s in enumerate(sources) if n and s and n in s), None) for n in names}


def test_parts_of_sources_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([(f"scripts/{i}/long name of an episode", i) for i in range(50)], "source_file string, at long").write.parquet(f"{tmp_path}/parsed")
    parsed = spark.read.parquet(f"{tmp_path}/parsed")
    found = intake.script_of_episode(spark.createDataFrame([("7/long",), ("none",)], "name string"), parsed)
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-|")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            under = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            assert not any("Generate" in x for x in lines[i:under])
    assert {r.name: r.episode.at if r.episode else None for r in found.collect()} == {"7/long": 7, "none": None}
