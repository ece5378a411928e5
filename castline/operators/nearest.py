"""Names that are nearly like given ones: a join of two tables by their share of matching blocks.

A ratio of at least the cutoff takes so many letters that both names must have, whatever their
order. Letters are told by how often they came before in the name (the third e is another one
than the first), rare ones first; two names that have enough letters in common have the first
two common ones among the first few of each. So names meet in an equi-join on two such letters
and both lengths; names of over ``SHORT`` letters together meet on one. What meets is counted,
and only what has letters enough is aligned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castline.functions.exact import similarity
from castline.functions.text import strip

#: Letters of two names together up to which they meet on two letters and their lengths.
SHORT = 40
#: Letters that most names have; they come last. Any order is right.
FREQUENT = " eaitonrslhdcum"
CUTOFF = 0.72

# Inline cues that voices know, and other words for them.
CUES = (
    "advertisement", "angry", "chuckle", "clear throat", "cough", "crying", "dramatic", "fear", "gasp", "groan",
    "happy", "laugh", "narration", "sarcastic", "shush", "sigh", "sniff", "surprised", "whispering",
)
CUE_ALIASES = (("throat clearing", "clear throat"), ("throat clear", "clear throat"), ("cries", "crying"), ("cry", "crying"), ("crys", "crying"))


def needed(letters: int, cutoff: float) -> int:
    """The least number of matched letters that gives two names of so many letters together the cutoff."""
    least = max(0, int(cutoff * letters / 2) - 1)
    while 2.0 * least / letters < cutoff:
        least += 1
    return least


def tokens(name: str) -> list[int]:
    """The letters of a name, each with the number of those like it before, rare ones first."""
    seen: dict[str, int] = {}
    found = []
    for letter in name:
        nth = seen[letter] = seen.get(letter, -1) + 1
        found.append((-nth, FREQUENT.find(letter), -ord(letter), ord(letter) << 32 | nth))
    return [t[-1] for t in sorted(found, key=lambda t: (t[0], -t[1] if t[1] >= 0 else -len(FREQUENT), t[2]))]


def meeting_places(size: int, own: Sequence[int], others: Sequence[int], first_side: bool, cutoff: float) -> Iterator[tuple[int, int, int, int]]:
    """(length of the first name, of the second, a letter, another one): what names of ``others``' lengths that can reach the cutoff share. Zeros stand for what is left open."""
    far = []
    for other in others:
        least = needed(size + other, cutoff)
        if least > min(size, other):
            continue
        if size + other > SHORT:
            far.append(least)
            continue
        sizes = (size, other) if first_side else (other, size)
        if least == 1:
            yield from ((*sizes, letter, 0) for letter in own)
        else:
            yield from ((*sizes, *two) for two in combinations(own[: size - least + 2], 2))
    if far:
        yield from ((0, 0, letter, 0) for letter in own[: size - min(far) + 1])


def placed(names: DataFrame, name: str, others: Sequence[int], first_side: bool, cutoff: float) -> DataFrame:
    """Each distinct name, that has letters, at all its meeting places with names of ``others``' lengths."""

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_pylist()
            letters = [tokens(n) for n in own]
            places = [list(meeting_places(len(n), t, others, first_side, cutoff)) for n, t in zip(own, letters)]
            ends = pa.array(np.cumsum([0, *map(len, places)]), pa.int32())
            flat = np.array([p for own_places in places for p in own_places], np.int64).reshape(-1, 4)
            held = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], names=["a_size", "b_size", "one", "two"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(letters, pa.list_(pa.int64())), pa.ListArray.from_arrays(ends, held)], names=["name", "letters", "places"])

    kind = "name string, letters array<long>, places array<struct<a_size: long, b_size: long, one: long, two: long>>"
    return names.select(F.col(name).alias("name")).where("name != ''").distinct().mapInArrow(run, kind).select("name", "letters", F.explode("places").alias("place"))


def lengths(names: DataFrame, name: str) -> list[int]:
    """The lengths that names have: as many numbers as the longest has letters, at most."""
    return sorted(n for (n,) in names.select(F.length(name)).distinct().collect() if n)


def near_pairs(words: DataFrame, choices: DataFrame, word: str, choice: str, cutoff: float = CUTOFF) -> DataFrame:
    """(word, choice, ratio) of all distinct words and choices, equal ones too, whose ratio reaches the cutoff.

    Nulls are like nothing; an empty word is like an empty choice only. The cutoff is above 0, or
    else every word is like every choice.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff has to be above 0, and 1 at most")
    a = placed(words, word, lengths(choices, choice), True, cutoff).select(F.col("name").alias("a_name"), F.col("letters").alias("a_letters"), "place.*")
    b = placed(choices, choice, lengths(words, word), False, cutoff).select(F.col("name").alias("b_name"), F.col("letters").alias("b_letters"), "place.*")
    met = a.join(b, ["a_size", "b_size", "one", "two"]).where("a_name != b_name")
    common = F.array_intersect("a_letters", "b_letters")
    # A pair comes once: where its first common letters are.
    here = (F.element_at(common, 1) == F.col("one")) & ((F.col("two") == 0) | (F.try_element_at(common, F.lit(2)) == F.col("two")))
    both = F.size("a_letters") + F.size("b_letters")
    here &= (F.col("a_size") > 0) | (both > SHORT)
    met = met.where((F.size(common) > 0) & here & (F.lit(2.0) * F.size(common) / both >= cutoff)).select("a_name", "b_name")
    aligned = met.withColumn("ratio", similarity(F.col("b_name"), F.col("a_name"))).where(F.col("ratio") >= cutoff)
    equal = words.select(F.col(word).alias("a_name")).distinct().join(choices.select(F.col(choice).alias("b_name")).distinct(), F.col("a_name") == F.col("b_name"))
    return aligned.unionByName(equal.withColumn("ratio", F.lit(1.0))).select(F.col("a_name").alias("word"), F.col("b_name").alias("choice"), "ratio")


def nearest(words: DataFrame, choices: DataFrame, word: str, choice: str, cutoff: float = CUTOFF) -> DataFrame:
    """(word, choice, ratio): the most alike choice of every distinct word that has one; of equally alike ones the greater."""
    best = F.max(F.struct("ratio", "choice")).alias("best")
    return near_pairs(words, choices, word, choice, cutoff).groupBy("word").agg(best).select("word", "best.choice", "best.ratio")


def tag_name(token: Column) -> Column:
    """A tag in lower case, with single spaces."""
    return strip(F.regexp_replace(F.lower(token), r"(?U)\s+", " "))


def near_misses(lines: DataFrame, allowed: DataFrame, aliases: DataFrame, by: Sequence[str] = ("file",), cutoff: float = CUTOFF) -> DataFrame:
    """Bracketed tags of lines (by, line_no, raw) that are no known name but nearly one: by, name, text (as first written), suggestion, lines.

    ``allowed`` holds the known names (name), ``aliases`` what some others stand for (name,
    suggestion; each name once); aliases go first. Tags with a colon are cues of another kind.
    ``lines`` has the number of every line that has the tag, as often as it has it; tags like
    nothing are left out.
    """
    found = lines.select(*by, "line_no", F.posexplode(F.regexp_extract_all(strip(F.col("raw")), F.lit(r"\[([^\[\]]+)\]"), 1)).alias("at", "token"))
    tags = found.withColumns({"text": strip(F.col("token")), "name": tag_name(F.col("token"))}).where((F.col("name") != "") & ~F.contains("name", F.lit(":")))
    tags = tags.join(allowed.select("name"), "name", "left_anti").join(aliases.select("name", F.col("suggestion").alias("alias")), "name", "left")
    near = nearest(tags.where("alias IS NULL"), allowed, "name", "name", cutoff).select(F.col("word").alias("name"), F.col("choice").alias("near"))
    told = tags.join(near, "name", "left").withColumn("suggestion", F.coalesce("alias", "near")).where("suggestion IS NOT NULL")
    return told.groupBy(*by, "name").agg(
        F.min_by("text", F.struct("line_no", "at")).alias("text"), F.first("suggestion").alias("suggestion"), F.array_sort(F.collect_list("line_no")).alias("lines")
    )
