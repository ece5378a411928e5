import difflib
import random

import numpy as np
import pytest

from castline.functions import blocks
from castline.functions.blocks import block_ratios
from castline.operators import nearest

ALPHABETS = ["ab", "abc ", "abcdefghij", "etaoinshrdlu zéß", "abcdefghijklmnopqrstuvwxyz     eee", "".join(map(chr, range(200, 700)))]


def changed(rng, text, letters, most):
    out = list(text)
    for _ in range(rng.randint(0, most)):
        at = rng.randint(0, len(out))
        if rng.random() < 0.5:
            out.insert(at, rng.choice(letters))
        elif out:
            out.pop(min(at, len(out) - 1))
    return "".join(out)


def some_pairs(seed, n, longest):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(ALPHABETS)
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))
        yield a, changed(rng, a, letters, longest // 6) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))


@pytest.mark.parametrize(("n", "longest"), [(3000, 30), (300, 700)])
@pytest.mark.parametrize("cells", [1 << 21, 50])
def test_ratios_equal_the_definition(monkeypatch, n, longest, cells):
    monkeypatch.setattr(blocks, "CELLS", cells * (1 if longest < 100 else 100))
    pairs = [*some_pairs(n, n, longest), ("", ""), ("", "a"), ("a", ""), ("a", "a"), ("\U0001f600b", "b\U0001f600")]
    got = block_ratios(*zip(*pairs))
    assert got.tolist() == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert block_ratios([], []).tolist() == []


def test_popular_letters_open_no_block():
    a = "the quick brown fox jumps over the lazy dog and then keeps running through the forest until it reaches the river where it stops to drink some water before heading back home to its den in the hills beyond the valley far away"
    b = "the quick brown fox jumped over a lazy dog and kept running through the forest till it reached the river where it stopped to drink water before heading home to its den in the hills past the valley very far away indeed"
    # Shares that the measure has for these.
    assert block_ratios([a, b], [b, a]).tolist() == [0.29545454545454547, 0.4409090909090909]


@pytest.mark.parametrize("cutoff", [0.3, 0.6, 0.72, 0.9, 1.0])
def test_near_pairs_equal_all_pairs(spark, cutoff):
    rng = random.Random(7)
    words = {w for pair in some_pairs(1, 120, 12) for w in pair} | {w for pair in some_pairs(2, 20, 60) for w in pair}
    choices = {changed(rng, w, "abcdefgh ", 3) for w in sorted(words) if rng.random() < 0.6} | {"", "a", "ab"}
    words |= {"", "a"}
    a = spark.createDataFrame([(w, 1) for w in [*words, *words, None]], "word string, ratio int")
    b = spark.createDataFrame([(c, 1) for c in [*choices, None]], "word string, ratio int")
    got = sorted(map(tuple, nearest.near_pairs(a, b, "word", "word", cutoff).collect()))
    want = sorted((w, c, r) for w in words for c in choices if (r := difflib.SequenceMatcher(None, c, w).ratio()) >= cutoff)
    assert got == want and len(want) > 20
    best = {r.word: r.choice for r in nearest.nearest(a, b, "word", "word", cutoff).collect()}
    assert best == {w: c for w in words for c in difflib.get_close_matches(w, sorted(choices), 1, cutoff)}


def test_near_pairs_compare_no_side_with_all(spark):
    a = spark.createDataFrame([("abc",)], "word string")
    plan = nearest.near_pairs(a, a, "word", "word")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    for cutoff in (0, -1, 1.5):
        with pytest.raises(ValueError):
            nearest.near_pairs(a, a, "word", "word", cutoff)
    assert nearest.near_pairs(a.limit(0), a, "word", "word").count() == nearest.near_pairs(a, a.limit(0), "word", "word").count() == 0


def test_needed_letters():
    for cutoff in (0.1, 0.3, 0.72, 0.9, 1.0):
        for letters in range(1, 200):
            least = nearest.needed(letters, cutoff)
            assert 2.0 * least / letters >= cutoff and (least == 0 or 2.0 * (least - 1) / letters < cutoff)


def test_near_misses(spark):
    text = "ADAM [laughs] Hello.\nMAYA [clears  Throat] Yes.\nDEZ [exhausted] No.\n[SFX: DOOR]\nAVA [laughs] [Laughs] Again.\n[throat clearing] x\n[cries] y [laugh] [ ]"
    lines = spark.createDataFrame([("a", i + 1, line) for i, line in enumerate(text.split("\n"))] + [("b", 3, "[LAUGHS]"), ("b", 1, None)], "file string, line_no int, raw string")
    allowed = spark.createDataFrame([(c,) for c in nearest.CUES], "name string")
    aliases = spark.createDataFrame(nearest.CUE_ALIASES, "name string, suggestion string")
    got = sorted(map(tuple, nearest.near_misses(lines, allowed, aliases).collect()))
    assert got == [
        ("a", "clears throat", "clears  Throat", "clear throat", [2]),
        ("a", "cries", "cries", "crying", [7]),
        ("a", "laughs", "laughs", "laugh", [1, 5, 5]),
        ("a", "throat clearing", "throat clearing", "clear throat", [6]),
        ("b", "laughs", "LAUGHS", "laugh", [3]),
    ]


def test_ratio_of_columns(spark):
    from castline.functions.exact import similarity

    rows = spark.createDataFrame([("abc", "abd"), (None, "a"), ("a", None), ("", "")], "a string, b string")
    assert [r[0] for r in rows.select(similarity("a", "b")).collect()] == [2 / 3, None, None, 1.0]
    assert np.isnan(block_ratios(["a"], ["b"])).sum() == 0
