import random
import time

import pytest
from pyspark.sql import functions as F

from castline.operators import aggregates, impact, joins, logs, matching, merge, scripts, sequence, timeline
from castline.sources import readers, sinks
from castline.streaming import journal as stream

SCRIPT = """THE SHOW Season 1 Episode 2: "Rain"
CAST:
* ADAM — host
* MR. POE (V.O.) – caller
===
COLD OPEN
[AMBIENCE: BAR | play_volume_pct=20%]
ADAM (softly) Hello there.
and more
(laughs)
SCENE 2: The Street [SFX: DOOR | door.mp3]
MR. POE (V.O.)
(whispering)
[BEAT]
==== not a divider
[sighs]
ACT ONE: "Later"
ADAM Bye.
END OF EPISODE
ADAM never
"""


def test_parser(spark):
    df = spark.createDataFrame([("d", SCRIPT), ("n", None)], "doc string, value string")
    rows = scripts.parse_scripts(df).orderBy("seq").collect()
    got = [(r.type, r.section, r.scene, r.speaker, r.direction, r.text) for r in rows]
    assert got == [
        ("section_header", "cold-open", None, None, None, "COLD OPEN"),
        ("direction", "cold-open", None, None, None, "AMBIENCE: BAR"),
        ("dialogue", "cold-open", None, "adam", "softly", "Hello there. and more"),
        ("scene_header", "cold-open", "scene-2", None, None, "SCENE 2: The Street"),
        ("direction", "cold-open", "scene-2", None, None, "SFX: DOOR"),
        ("direction", "cold-open", "scene-2", None, None, "BEAT"),
        ("dialogue", "cold-open", "scene-2", "mr_poe", "whispering", "==== not a divider"),
        ("section_header", "act1", None, None, None, 'ACT ONE: "Later"'),
        ("dialogue", "act1", None, "adam", None, "Bye."),
    ]
    assert rows[1].sfx_overrides == {"volume_percentage": 20.0} and rows[4].sfx_source == "SFX/theshow/door.mp3"
    text = scripts.regenerate(scripts.parse_scripts(df).drop("line_no"), {"adam": "ADAM", "mr_poe": "POE"})
    again = scripts.parse_scripts(text, [("ADAM", "adam"), ("POE", "mr_poe")]).orderBy("seq").collect()
    assert [(r.type, r.section, r.scene, r.speaker, r.text) for r in again] == [(g[0], g[1], g[2], g[3], g[5]) for g in got]


def test_scanning(spark):
    lines = spark.createDataFrame([("d", i + 1, line) for i, line in enumerate(SCRIPT.split("\n"))], "doc string, line_no long, raw string")
    assert {r.line for r in scripts.caps_lines(lines).collect()} == {"COLD OPEN", "MR. POE (V.O.)"}
    assert [r.display for r in scripts.cast_block(lines).orderBy("line_no").collect()] == ["ADAM", "MR. POE (V.O.)"]


def test_pairing_equals_a_stack(spark):
    rng, rows, want = random.Random(3), [], set()
    for doc in range(40):
        stack = []
        for i in range(rng.randint(0, 12)):
            opens = rng.random() < 0.5
            rows.append((doc, i, "E" if opens else "D"))
            if opens:
                stack.append(i)
            elif stack:
                stack.pop()
            else:
                want.add((doc, i))
        want |= {(doc, i) for i in stack}
    df = spark.createDataFrame(rows, "doc int, i int, k string")
    assert {(r.doc, r.i) for r in sequence.unpaired_markers(df, ["doc"], "i", F.col("k") == "E", F.col("k") == "D").collect()} == want


def test_records(spark):
    rows = [(1, "b"), (2, "s"), (3, "m"), (4, "s"), (5, "e"), (6, "m"), (7, "m"), (8, "e"), (9, "s"), (10, "b"), (11, "m"), (12, "e")]
    df = spark.createDataFrame([("f", *r) for r in rows], "f string, i long, k string")
    is_ = lambda k: F.col("k") == k
    got = sequence.assemble_records(df, ["f"], "i", is_("s"), is_("m"), is_("e"), is_("b"), {"start": F.col("i")}).collect()
    assert [(r.start, r.middle_at, r.end_at) for r in got] == [(4, 6, 8)]


def test_splice_and_delete_refuse_the_preamble(spark):
    df = spark.createDataFrame([(1, 0, "p"), (1, 1, "a"), (1, 2, "b")], "d int, seq long, t string")
    new = spark.createDataFrame([(1, 1, "n")], "d int, seq long, t string")
    assert [tuple(r)[1:] for r in sequence.splice(df, new, ["d"], "seq", 1).orderBy("seq").collect()] == [(0, "p"), (1, "a"), (2, "n"), (3, "b")]
    for call in (lambda: sequence.splice(df, new, ["d"], "seq", 0), lambda: sequence.delete_range(df, ["d"], "seq", 0, 1)):
        with pytest.raises(ValueError):
            call()


def test_migration_equals_the_loop(spark):
    rng, old, new = random.Random(5), [], []
    for doc in range(60):
        entry = lambda i: (doc, i, rng.choice(["dialogue", "dialogue", "direction", "scene_header"]), rng.choice("ab"), rng.choice("xyz"))
        old += [entry(i) for i in range(rng.randint(0, 7))]
        new += [entry(i) for i in range(rng.randint(0, 7))]
    want = {}
    for doc in range(60):
        role = lambda e: e[3] if e[2] == "dialogue" else "sfx"
        by_role, by_text, used_role, used_text = {}, {}, set(), set()
        for e in (e for e in old if e[0] == doc and e[2] != "scene_header"):
            by_role.setdefault((e[4], role(e)), e)
            by_text.setdefault(e[4], e)
        for e in (e for e in new if e[0] == doc):
            key = (e[4], role(e))
            if e[2] == "scene_header":
                want[doc, e[1]] = ("SKIP", None)
            elif key in by_role and key not in used_role:
                used_role.add(key)
                used_text.add(e[4])
                want[doc, e[1]] = ("EXACT", by_role[key][1])
            elif e[2] == "dialogue" and e[4] in by_text and e[4] not in used_text:
                used_text.add(e[4])
                other = by_text[e[4]]
                want[doc, e[1]] = ("SPEAKER", other[1]) if other[3] != e[3] else ("NEW", None)
            else:
                want[doc, e[1]] = ("NEW", None)
    schema = "doc int, seq int, type string, speaker string, text string"
    got = merge.migration_plan(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["doc"]).collect()
    assert {(r.doc, r.seq): (r.status, r.old_seq) for r in got} == want


def test_replay_in_batch_and_stream(spark, tmp_path):
    lines = [
        '{"ts":"1","key":"SFX: A","fields":{"source":"x","play_duration":"5","color":"red"}}', "broken", '{"ts":"2","key":"SFX: A","fields":{"play_duration":null}}',
        '{"ts":"3","scope":"defaults","fields":{"anything":"1"}}', '{"ts":"4","key":"SFX: B","fields":{"source":"y"}}', '{"ts":"5","key":"SFX: A","fields":{"source":"z"}}',
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines) + "\n")
    edits, defaults = merge.replay(readers.journal(spark, str(tmp_path / "in")), ["line_no"])
    want = {("SFX: A", "source"): "z", ("SFX: A", "play_duration"): None, ("SFX: B", "source"): "y"}
    assert {(r.key, r.field): r.value for r in edits.collect()} == want
    assert [tuple(r)[:2] for r in defaults.collect()] == [("anything", "1")]
    effects = spark.createDataFrame([("SFX: A", {"play_duration": "9", "type": "sfx"})], "key string, fields map<string,string>")
    laid = {r.key: (r.fields, r.orphan) for r in merge.apply_replay(effects, edits).collect()}
    assert laid == {"SFX: A": ({"type": "sfx", "source": "z"}, False), "SFX: B": ({"source": "y"}, True)}
    query = stream.replay_stream(stream.edits(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("replayed").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {(r.key, r.field): r.value for r in spark.table("replayed").collect()} == want


def test_runs_of_a_streamed_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "day.log").write_text("\n".join(["1|I|h|s|early", "2|I|h|s|BEGIN a", "3|I|h|s|one"]) + "\n")

    def run():
        lines = stream.numbered_runs(stream.log_runs(spark, str(tmp_path / "in"), r"\|BEGIN\b"))
        query = lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "runs")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    run()
    (tmp_path / "in" / "later").mkdir()
    (tmp_path / "in" / "later" / "day.log").write_text("\n".join(["4|I|h|s|two", "5|I|h|s|BEGIN b", "6|I|h|s|three"]) + "\n")
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    # The later file is another log, though its name is the same.
    assert sorted((r.log.rsplit("/", 2)[1], r.ts, r.run) for r in rows) == [("in", "1", 0), ("in", "2", 1), ("in", "3", 1), ("later", "4", 0), ("later", "5", 1), ("later", "6", 1)]


def test_upsert_updates_the_last_one(spark):
    schema = "k string, at long, v string, w string"
    old = spark.createDataFrame([("a", 1, "x", "1"), ("a", 2, "y", "2"), ("b", 3, "z", "3")], schema)
    new = spark.createDataFrame([("a", 9, "n", None), ("c", 9, "m", "4")], schema)
    got = sorted(tuple(r) for r in merge.upsert(old, new, ["k"], ["v", "w"]).select("k", "at", "v", "w", "state").collect())
    assert got == [("a", 1, "x", "1", "kept"), ("a", 2, "n", "2", "updated"), ("b", 3, "z", "3", "kept"), ("c", 9, "m", "4", "inserted")]


def test_candidates_equal_all_pairs(spark):
    rng = random.Random(1)
    words = ["door", "bar", "rain", "car", "bell", "dog", "wind", "step"]
    row = lambda i: (f"c{i}", sorted(set(rng.sample(words, rng.randint(1, 5)))), "SFX(fg)")
    cues = spark.createDataFrame([row(i) for i in range(30)], "cue string, cue_tokens array<string>, placement string")
    pool = spark.createDataFrame([row(i) for i in range(40)], "asset string, asset_tokens array<string>, placement string")
    got = {(r.cue, r.asset) for r in matching.candidates(cues, pool).collect()}
    want = {(c.cue, a.asset) for c in cues.collect() for a in pool.collect() if len(set(c.cue_tokens) & set(a.asset_tokens)) / len(c.cue_tokens) >= 0.5}
    assert got == want


def test_impact(spark):
    rows = [("a", 10.0, False, None, 4.0), ("b", 10.0, True, None, 4.0), ("c", 10.0, False, 50.0, 4.0), ("d", 10.0, False, None, 0.0), ("e", None, False, None, 1.0), ("f", 10.0, False, None, 9.95)]
    df = spark.createDataFrame(rows, "cue string, n double, l boolean, p double, d double")
    got = {r.cue: (r.plays_now_s, r.tier) for r in impact.cue_impact(df, F.col("n"), F.col("l"), F.col("p"), F.col("d")).collect()}
    assert got == {"a": (4.0, "3-review"), "b": (10.0, "EXCLUDED"), "c": (5.0, "EXCLUDED"), "d": (10.0, "EXCLUDED"), "e": (None, "MISSING"), "f": (9.95, "1-nochange")}


def test_transcripts(spark):
    lines = spark.createDataFrame([(1, "Hello, there!"), (2, "b"), (3, "c"), (4, "d"), (5, "the long way home")], "seq int, text string")
    stems = spark.createDataFrame([(1, True, "hello there"), (2, True, " "), (3, False, None), (5, True, "xyz")], "seq int, has_transcript boolean, transcript string")
    assert {r.seq: r.status for r in joins.compare_transcripts(lines, stems).collect()} == {1: "ok", 2: "silent", 3: "not_transcribed", 4: "no_stem", 5: "garbled"}


def test_loop_end_and_bands(spark):
    df = spark.createDataFrame([(1, 1, 0, "L"), (1, 2, 0, "C"), (1, 3, 500, "x"), (1, 4, 900, "C")], "d int, i int, at long, k string")
    got = timeline.loop_ends(df, ["d"], "i", "at", F.col("k") == "L", F.col("k") == "C", F.lit(2000)).collect()
    assert [r.loop_end for r in got] == [900]
    rows = spark.createDataFrame([(1, 1, "a", None), (1, 2, "a", 10), (1, 3, "", 20), (1, 4, "b", 30), (1, 5, "a", None)], "d int, i int, s string, ms long")
    assert [tuple(r)[1:] for r in timeline.bands(rows, ["d"], "i", "s", "ms", F.lit(99)).orderBy("start_ms").collect()] == [("a", 10, 30), ("b", 30, 99)]


def test_speaker_stats_rank_and_shares(spark):
    df = spark.createDataFrame([(1, "b", "one two"), (2, "a", "x"), (3, None, "y"), (4, "a", "z")], "seq long, speaker string, text string")
    got = [(r.speaker, r.lines, r.pct_lines, r.place) for r in aggregates.speaker_stats(df).orderBy("place").collect()]
    assert got == [("a", 2, 50.0, 1), ("b", 1, 25.0, 2), ("", 1, 25.0, 3)]


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi",\nthen', True, None)], "i int, s string, b boolean, n string")
    out = str(tmp_path / "csv")
    sinks.write_csv(df, out, ["s", "i", "b", "n", "gone"])
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text == 's,i,b,n,gone\r\n"say ""hi"",\nthen",1,True,,\r\n'
    (tmp_path / "in.csv").write_text(text)
    back = readers.csv(spark, str(tmp_path / "in.csv"), ["i", "s", "other"]).collect()
    assert [tuple(r) for r in back] == [("1", 'say "hi",\nthen', None)]


def test_write_if_changed(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "t")
    assert sinks.write_if_changed(df, path) is True
    time.sleep(0.01)
    assert sinks.write_if_changed(df, path) is False
    assert sinks.write_if_changed(spark.range(4), path) is True


def test_configurations(spark, tmp_path):
    (tmp_path / "sfx_S01E01.json").write_text('{"show":"S","defaults":{"music_volume_percentage":20},"effects":{"SFX: A":{"prompt":"p"},"SFX: B":3,"MUSIC: C":{"type":"music","duration_seconds":9}}}')
    rows = readers.effects(spark, str(tmp_path / "sfx_S01E01.json")).orderBy("at").collect()
    assert [(r.cue, r.effect["type"], r.effect["duration_seconds"]) for r in rows] == [("SFX: A", "sfx", 5.0), ("MUSIC: C", "music", 9.0)]
    (tmp_path / "p.json").write_text('{"show":"S","episode":1,"entries":[{"seq":1,"type":"dialogue","speaker":"a","text":"hello"},{"seq":1,"type":"direction","text":"x"}]}')
    entries = readers.entries(spark, str(tmp_path / "p.json"), preview=3)
    assert [r.text for r in entries.orderBy("at").collect()] == ["hel", "x"]
    assert [r.type for r in readers.last_by_seq(entries).collect()] == ["direction"]
    assert readers.hashed_files(spark, str(tmp_path), "*.json").count() == 2


def test_shows_with_equal_file_names(spark, tmp_path):
    for show in ("one", "two"):
        (tmp_path / "parsed" / show).mkdir(parents=True)
        (tmp_path / "parsed" / show / "parsed_S01E01.json").write_text(f'{{"show":"{show}","episode":1,"entries":[{{"seq":1,"type":"dialogue","text":"first"}},{{"seq":1,"type":"dialogue","text":"{show}"}}]}}')
    (tmp_path / "parsed_E02.json").write_text('{"show":"flat","episode":2,"entries":[]}')
    entries = readers.entries(spark, str(tmp_path))
    assert sorted((r.name, r.text) for r in readers.last_by_seq(entries).collect()) == [("parsed_S01E01.json", "one"), ("parsed_S01E01.json", "two")]
    (tmp_path / "scripts" / "one").mkdir(parents=True)
    (tmp_path / "scripts" / "one" / "script_S01E01.md").write_text("x")
    found = readers.episodes_found(spark, [str(tmp_path)]).collect()
    assert sorted((r.show_dir or "", r.tag, r.kinds) for r in found) == [("", "E02", ["parsed"]), ("one", "S01E01", ["parsed", "scripts"]), ("two", "S01E01", ["parsed"])]


def test_logs_of_two_shows(spark, tmp_path):
    for show in ("one", "two"):
        (tmp_path / show).mkdir()
        (tmp_path / show / "run.log").write_text("--- Phase 1: Generating\n > [1] adam via gTTS (5 chars)\n Saved: a.mp3\n SHA256: ab\n")
    lines = readers.log_lines(spark, str(tmp_path))
    got = logs.production_records(lines).collect()
    assert [(r.run_index, r.seq, r.char_count) for r in got] == [(1, 1, 5), (1, 1, 5)] and len({r.file for r in got}) == 2
    assert {r.log_date for r in got} == {str(lines.select(F.current_date()).first()[0])}


def test_transcripts_are_compared_only_where_they_differ(spark):
    lines = spark.createDataFrame([(1, "Hello, there"), (2, "Hello"), (3, "a b c d"), (4, "x"), (5, "y"), (6, "!!")], "seq int, text string")
    stems = spark.createDataFrame([(1, True, "hello there"), (2, True, "※"), (3, True, "a b c x"), (4, False, None), (6, True, "?")], "seq int, has_transcript boolean, transcript string")
    got = {r.seq: (r.status, r.similarity) for r in joins.compare_transcripts(lines, stems).collect()}
    assert got == {1: ("ok", 1.0), 2: ("garbled", 0.0), 3: ("ok", 0.8571), 4: ("not_transcribed", None), 5: ("no_stem", None), 6: ("ok", 1.0)}


def test_ids_in_cues(spark):
    cues = spark.createDataFrame([("DOOR SLAM-12 loud door-slam-12 x",), ("nothing",), ("",)], "cue string")
    ids = spark.createDataFrame([("DOOR-SLAM-12",), ("DOOR",), ("LOUD",)], "asset_id string")
    assert sorted(r.asset_id for r in joins.contains_join(cues, ids, F.col("cue"), "asset_id").collect()) == ["DOOR", "DOOR-SLAM-12", "LOUD"]
    assert joins.contains_join(cues, ids.limit(0), F.col("cue"), "asset_id").count() == 0
