from castline.operators import merge, scripts
from castline.sources import readers


def test_journal_lines_are_records_or_rejects(spark, tmp_path):
    lines = ['{"ts":"1","key":"A","fields":{"source":"x","color":"red"}}', "broken", "", "[1]", '{"ts":"2","key":"A"}', '{"ts":"3","fields":{"a":"1"}}', '{"ts":"4","scope":"defaults","fields":{"a":null}}', '{"ts":"5","key":"B","fields":{"source":"y"}}', "7"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    found = readers.journal_with_rejects(spark, str(tmp_path / "in"), str(tmp_path / "work"))
    assert sorted(map(str, found.kept.collect())) == sorted(map(str, readers.journal(spark, str(tmp_path / "in")).collect())) and found.kept.count() == 3
    assert sorted((r.line_no, r.reason) for r in found.rejects.collect()) == [(2, "no JSON object"), (4, "no JSON object"), (5, "no fields"), (6, "no key, seq or scope"), (9, "no JSON object")]
    assert found.counts == {"kept": 3, "no JSON object": 3, "no fields": 1, "no key, seq or scope": 1}
    effects = spark.createDataFrame([("A",)], "key string")
    rejects = merge.replay_rejects(found.kept, ["line_no"], effects)
    assert sorted(map(tuple, rejects.collect())) == [(1, "A", "color", "field that no edit sets"), (8, "B", "source", "cue that is not there")]


SCRIPT = """stray text

EVE Hello there.
and more
[SFX: DOOR]
[NOTHING: KNOWN]
ADAM
EVE (softly) Yes.
===
(an aside)
ADAM
"""


def test_scripts_give_entries_and_rejects(spark, tmp_path):
    docs = spark.createDataFrame([("a", SCRIPT), ("b", SCRIPT), ("c", None)], "doc string, value string")
    known = [("EVE", "eve"), ("ADAM", "adam")]
    entries, found = scripts.parse_with_rejects(docs, str(tmp_path), known)
    want = scripts.parse_scripts(docs, known)
    assert sorted(map(str, entries.collect())) == sorted(map(str, want.collect())) and want.count() > 4
    rejects = sorted((r.doc, r.line_no, r.line, r.reason) for r in found.rejects.collect())
    assert [r[1:] for r in rejects if r[0] == "a"] == [r[1:] for r in rejects if r[0] == "b"]
    own = {r[1]: r[3] for r in rejects if r[0] == "a"}
    assert own[1] == scripts.BEFORE_ANYONE and own[6] == scripts.UNKNOWN_CUE and own[11] == scripts.NO_TEXT and set(own) <= {1, 6, 7, 11}
    assert sum(n for reason, n in found.counts.items() if reason != "kept") == len(rejects)
