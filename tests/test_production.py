from pyspark.sql import functions as F

from castline.operators import production

SHEET = """# Cues
## **MUSIC CUES**
### MUS-THEME-01 (NEW)
notes
**Prompt:** slow piano **Duration:** 2 min **Used:** open
### MUS-LOST-02 (NEW)
### MUS-OLD-03 (REUSE)
**Prompt:** strings **Duration:** 20s loop **Used:** x
**Prompt:** never **Duration:** 9s **Used:** x
## Ambience
### AMB-BAR-01 NEW
**Prompt:** a bar **Duration:** loop **Used:** y
## Sound Effects
### Scene 2: The **Street**
| Asset Name | Prompt |
|---|---|
| SFX-DOOR-07 (NEW) | a door | 3 |
| **SFX-BELL-08 (REUSE)** | a bell |
## Notes
### MUS-NOT-09 (NEW)
**Prompt:** x **Duration:** 1s **Used:** z
"""


def test_cue_sheet(spark):
    lines = spark.createDataFrame([("f", i + 1, line) for i, line in enumerate(SHEET.split("\n"))], "file string, line_no int, raw string")
    got = [tuple(r)[2:] for r in production.cue_sheet(lines).orderBy("line_no").collect()]
    assert got == [
        ("MUS-THEME-01", "MUSIC", False, "slow piano", 120.0, False, None),
        ("MUS-OLD-03", "MUSIC", True, "strings", None, True, None),
        ("AMB-BAR-01", "AMBIENCE", False, "a bar", None, True, None),
        ("SFX-DOOR-07", "SFX", False, "a door", None, False, "The Street"),
        ("SFX-BELL-08", "SFX", True, "a bell", None, False, "The Street"),
    ]


def test_digest(spark):
    rows = [
        (1, 1, "section_header", "cold-open", None, "COLD OPEN"), (1, 2, "scene_header", "cold-open", None, "SCENE 1: Bar"), *[(1, 2 + i, "dialogue", "cold-open", "a", f"line {i}") for i in range(1, 6)],
        (1, 9, "section_header", "act1", None, "ACT ONE"), (1, 10, "dialogue", "dez-closing", "b", "x"), (2, 1, "dialogue", None, "a", "y"),
    ]
    got = {r.doc: r for r in production.episode_digest(spark.createDataFrame(rows, "doc int, seq int, type string, section string, speaker string, text string"), ["doc"]).collect()}
    assert got[1].cold_open_scene == "SCENE 1: Bar" and [x.text for x in got[1].cold_open_lines] == ["line 1", "line 2", "line 3"]
    assert got[1].section_arc == "Cold Open → Act One → Dez Closing"
    assert (got[2].cold_open_scene, got[2].cold_open_lines, got[2].section_arc) == (None, None, "unknown")


def test_cast_update_voices_and_plans(spark):
    cast = spark.createDataFrame([("a", "v1", "", None), ("b", "v2", "host", "en"), ("c", "v9", None, None)], "speaker string, voice_id string, role string, language string")
    voices = spark.createDataFrame([("v1", "guest", "de", None), ("v2", "x", "fr", "pro")], "voice_id string, role string, language string, category string")
    assert {r.speaker: (r.role, r.language) for r in production.update_cast(cast, voices).collect()} == {"a": ("guest", "de"), "b": ("host", "en"), "c": (None, None)}
    assert {tuple(r) for r in production.voices_by_category(voices).collect()} == {("unknown", 1), ("pro", 1)}
    shown = spark.range(1).select(production.language_list(F.array(*map(F.lit, ["a", "b", "a", "c", "d", "e"])))).first()[0]
    assert shown == "a, b, c (+2)"
    listing = spark.createDataFrame([("x", 5), ("y", 0)], "path string, size int")
    wanted = spark.createDataFrame([("x",), ("x",), ("z",), ("y",)], "path string")
    assert sorted(tuple(r) for r in production.removal_plan(wanted, listing).collect()) == [("x", 5), ("y", 0)]
    assert {r.path for r in production.unresolved(wanted, listing).collect()} == {"y", "z"}
