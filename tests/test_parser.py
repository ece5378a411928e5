"""The parser against a plain state machine that reads one line after another."""

import random
import re
import unicodedata

from castline.functions.text import DIRECTION_TYPES, METADATA_SECTIONS
from castline.operators import scripts

SECTIONS = scripts.SECTIONS
HINTS = {"play_volume_pct": ("volume_percentage", 200.0), "play_duration_pct": ("play_duration", 100.0)}
NAMES = "seq type section scene speaker direction text direction_type sfx_source sfx_overrides line_no".split()


def split_hints(raw: str, slug: str) -> tuple[str, str | None, dict[str, float]]:
    """Direction text, source and overrides of one bracket."""
    head, *rest = [p.strip() for p in raw.split(" | ")]
    source, overrides, left = None, {}, [head]
    for part in rest:
        name, sign, value = part.partition("=")
        field, top = HINTS.get(name.strip(), (None, 0.0)) if sign else (None, 0.0)
        if part.endswith((".mp3", ".wav")) and source is None:
            source = f"SFX/{slug}/{part}" if slug else f"SFX/{part}"
            continue
        try:
            number = float(value.strip().rstrip("%").strip()) if field and not part.endswith((".mp3", ".wav")) else None
        except ValueError:
            number = None
        if number is not None and 0.0 <= number <= top:
            overrides[field] = number
        else:
            left.append(part)
    return " | ".join(left), source, overrides


def kind_of_direction(value: str) -> str | None:
    t = value.strip()
    special = {"LONG BEAT": "BEAT", "INTRO MUSIC": "MUSIC", "OUTRO MUSIC": "MUSIC"}
    return next((k for k in DIRECTION_TYPES if t.startswith(k)), special.get(t))


class ScriptMachine:
    """The state of one document's parse; ``feed`` takes its lines one by one and adds entries."""

    def __init__(self, names: list[tuple[str, str]], slug: str):
        self.names = sorted(names, key=lambda n: -len(n[0]))
        self.slug, self.entries = slug, []
        self.section = self.scene = self.waiting = None
        self.spoken: dict | None = None
        self.notes = self.ended = False

    def add(self, line_no: int, kind: str, value: str, **more) -> dict:
        base = {"type": kind, "section": self.section, "scene": self.scene, "speaker": None, "direction": None, "text": value, "direction_type": None, "sfx_source": None, "sfx_overrides": {}}
        self.entries.append(base | more | {"seq": len(self.entries) + 1, "line_no": line_no})
        return self.entries[-1]

    def directions(self, line_no: int, line: str) -> None:
        for inside in re.findall(r"\[([^\]]+)\]", line):
            clean, source, overrides = split_hints(inside.strip(), self.slug)
            if kind := kind_of_direction(clean):
                self.add(line_no, "direction", clean, direction_type=kind, sfx_source=source, sfx_overrides=overrides)

    def speaker(self, line: str) -> tuple[str, str | None, str] | None:
        for display, key in self.names:
            rest = line[len(display) :]
            if line.startswith(display) and rest[:1] in ("", " ", "("):
                rest = rest.lstrip()
                note, close, after = rest[1:].partition(")") if rest.startswith("(") else ("", "", "")
                return (key, note.strip(), after.strip()) if close else (key, None, rest)
        return None

    def feed(self, line_no: int, raw: str) -> None:
        line = raw.strip()
        if not line or self.ended:
            return
        aside = line.startswith("(") and line.endswith(")")
        cue = line.startswith("[") and "]" in line
        if self.waiting:  # a name stood alone: this comes before all other readings of the line
            if aside:
                self.waiting = (self.waiting[0], line[1:-1].strip())
            elif cue:
                self.directions(line_no, line)
            else:
                self.spoken = self.add(line_no, "dialogue", line, speaker=self.waiting[0], direction=self.waiting[1])
                self.waiting = None
            return
        if re.fullmatch(r"={3,}|-{3,}", line):
            return
        self.notes = self.notes or line in METADATA_SECTIONS
        if self.notes:
            return
        if line.startswith(("END OF EPISODE", "END OF PRODUCTION")):
            self.ended = True
            return
        slug = SECTIONS.get(line) or (SECTIONS.get(line.split(":")[0].strip()) if ":" in line else None)
        if slug:
            self.section, self.scene, self.spoken = slug, None, None
            self.add(line_no, "section_header", line)
        elif re.match(r"SCENE \d+[A-Za-z]*:", line):
            if number := re.match(r"SCENE (\d+[A-Za-z]*):\s*.+", line):
                self.scene = f"scene-{number[1]}"
            self.add(line_no, "scene_header", re.sub(r"\s*\[[^\]]+\]", "", line).strip())
            self.directions(line_no, line)
            self.spoken = None
        elif cue:
            self.directions(line_no, line)
            self.spoken = None
        elif said := self.speaker(line):
            key, note, words = said
            self.waiting = None if words else (key, note)
            self.spoken = self.add(line_no, "dialogue", words, speaker=key, direction=note) if words else None
        elif self.spoken and not aside:
            self.spoken["text"] += " " + line


def clean_lines(raw: str) -> list[str]:
    """Composed, without escapes, heading marks, bold marks and white space at line ends."""
    raw = unicodedata.normalize("NFC", raw)
    for a, b in (("\\[", "["), ("\\]", "]"), ("\\===", "==="), ("\\=", "=")):
        raw = raw.replace(a, b)
    raw = re.sub(r"\\(.)", r"\1", raw)
    return [re.sub(r"^#{1,6}\s*", "", line).replace("**", "").rstrip() for line in raw.split("\n")]


def to_key(display: str) -> str:
    name = re.sub(r"[^\w\s]", "", re.sub(r"\s*\([^)]*?\)\s*", " ", display).strip()).lower().strip()
    return re.sub(r"\s+", "_", name).strip("_")


def parse_one(raw: str, known: list[tuple[str, str]]) -> list[dict]:
    """Entries of one script; names come from its CAST block and from ``known``."""
    lines = clean_lines(raw)
    top = next((i for i, line in enumerate(lines) if line.strip()), len(lines))
    header = lines[top].strip() if top < len(lines) else ""
    start, show = (top + 1, re.split(r"\b(?:Season\s+\d+|Episode\s+\d+)", header)[0].strip()) if re.search(r"Episode\s+\d+", header) else (0, "Unknown Show")
    names: dict[str, str] = {}
    inside = False
    for i in range(start, len(lines)):
        line = lines[i].strip()
        if line == "CAST:":
            inside = True
        elif inside and line.startswith("*"):
            display = re.split(r"\s*[—–]\s*", line[1:].strip())[0].strip()
            if display and to_key(display) and to_key(display) not in names.values():
                names[display] = to_key(display)
        elif inside and line:
            start = i
            break
    for display, key in known:
        names[display] = key
    names |= {d.replace(" ", "_"): k for d, k in list(names.items()) if " " in d}
    machine = ScriptMachine(list(names.items()), re.sub("[^a-z0-9]", "", show.lower()))
    for i in range(start, len(lines)):
        machine.feed(i + 1, lines[i])
    return machine.entries


LINES = [
    "ADAM", "ADAM (softly)", "ADAM Hi there.", "ADAM (x) Well.", "MR. POE (V.O.)", "MR. POE (V.O.) So.", "MR._POE_(V.O.) yes", "(laughs)", "(quiet", "", "---", "====",
    "[SFX: DOOR | door.mp3 | play_volume_pct=50%] [BEAT]", "[sighs]", "[MUSIC: A | b]", "COLD OPEN", 'ACT ONE: "x"', "SCENE 2: The Street [SFX: DOOR]", "SCENE 3:", "plain line",
    "  and more ", "ADAMANT no", "BOB", "BOB bobs", "# **ADAM** loud", "\\[BEAT\\]",
]
RARE = ["END OF EPISODE", "PRODUCTION NOTES:", "END OF PRODUCTION x"]
HEAD = ["CAST:", "* ADAM — host", "", "* MR. POE (V.O.) – caller", "* **Adam** - dup"]


def test_parser_equals_a_state_machine(spark):
    rng, docs = random.Random(1), []
    for i in range(200):
        lines = [rng.choice(LINES) if rng.random() < 0.98 else rng.choice(RARE) for _ in range(rng.randint(0, 25))]
        head = ["", 'THE SHOW Season 1 Episode 2: "Rain"'][rng.randint(0, 1) :] if rng.random() < 0.5 else []
        if rng.random() < 0.7:
            head += HEAD + (["==="] if rng.random() < 0.8 else [])
        docs.append((str(i), "\n".join(head + lines)))
    known = [("BOB", "bob"), ("ADAM", "adam2")]
    got = {}
    for r in scripts.parse_scripts(spark.createDataFrame(docs, "doc string, value string"), known).collect():
        got.setdefault(r.doc, []).append(tuple(r[n] for n in NAMES))
    for doc, value in docs:
        assert sorted(got.get(doc, [])) == [tuple(e[n] for n in NAMES) for e in parse_one(value, known)], value


def test_sections_by_kind_of_project(spark):
    assert scripts.sections_of("podcast")["INTRO"] == "intro" and scripts.sections_of("podcast")["CHAPTER ONE"] == "chapter1"
    book = scripts.sections_of("audiobook")
    assert (book["CHAPTER THIRTY"], book["CHAPTER 30"], book["AUTHOR’S NOTE"]) == ("chapter30", "chapter30", "authors-note") and "CHAPTER 31" not in book
    special = scripts.sections_of("special")
    assert special["SEGMENT 15"] == "segment15" and special["PROLOGUE"] == "prologue" and special["MID-EPISODE BREAK"] == "mid-break" and "SEGMENT 16" not in special
    assert scripts.sections_of("series") == scripts.SECTIONS
    text = spark.createDataFrame([("b", "CHAPTER TWELVE\nADAM Hi.\nTHE VAULT: later\nADAM Yes.")], "doc string, value string")
    rows = scripts.parse_scripts(text, [("ADAM", "adam")], kind="audiobook", sections={"THE VAULT": "vault"}).orderBy("seq").collect()
    assert [(r.type, r.section, r.text) for r in rows] == [("section_header", "chapter12", "CHAPTER TWELVE"), ("dialogue", "chapter12", "Hi."), ("section_header", "vault", "THE VAULT: later"), ("dialogue", "vault", "Yes.")]
    plain = scripts.parse_scripts(text, [("ADAM", "adam")]).orderBy("seq").collect()
    assert [r.text for r in plain] == ["Hi. THE VAULT: later", "Yes."]


def test_python_composes_single_lines(spark):
    text = "The Baŕ é \\[x\\]\ńlate\nplain \\= line\n\n가 Å"
    lines = scripts.script_lines(spark.createDataFrame([("a", text)], "doc string, value string"))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.index("EvalPython") < plan.index("Generate")
    want = [x.strip() for x in unicodedata.normalize("NFC", text).replace("\\[", "[").replace("\\]", "]").replace("\\=", "=").split("\n") if x.strip()]
    assert [r.line for r in lines.orderBy("line_no").collect()] == want
