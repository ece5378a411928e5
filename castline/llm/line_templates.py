"""Line dedup by a tree of log templates.

Lines are led through a tree of fixed depth: by their number of tokens, then by their leading
tokens, tokens with digits being variable from the start. Lines that reach the same leaf and
agree in most places share a template, whose differing places are variable. A template that
recurs in several documents is dropped from all but the first of them, and a long line as soon
as it recurs in a second one.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from itertools import chain, groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castline.llm.common import Memo, forget_others, stored
from castline.llm.parts import slices

#: Leading tokens that lead to a leaf.
DEPTH = 4
#: Share of places in which a line must agree with a template.
ALIKE = 0.8
#: Documents in which a template must occur to be dropped; short lines recur by chance and need more.
MIN_DOCS, SHORT_TOKENS, MIN_DOCS_SHORT = 3, 5, 20
#: Lines of so many tokens do not recur by chance: equal ones, digits aside, are dropped from the second document on.
LONG_TOKENS = 50
#: Templates of a leaf up to which a line is compared with all of them; from there on an index finds those that it can join.
SCAN = 64
#: Rows of one Arrow batch.
BATCH = 2000
VARIABLE = "<*>"
#: Distinct tokens whose marks a worker keeps, in each of two generations.
MEMO = 200_000


has_digit, has_letter = re.compile("[0-9]").search, re.compile(r"[^\W\d_]").search


@functools.lru_cache(maxsize=1)
def token_marks() -> Memo:
    """Two bytes for each token, none of them two zeros, which stand for a variable one."""
    return Memo(lambda w: (xxhash.xxh32_intdigest(w) % 65535 + 1).to_bytes(2, "little"), MEMO)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def masked(line: str) -> list[str]:
    """The line's tokens, those with digits replaced by the variable mark."""
    tokens = line.split()
    return [VARIABLE if has_digit(w) else w for w in tokens] if has_digit(line) else tokens


def lines_of(documents: DataFrame) -> DataFrame:
    """One row for each line that has a letter outside variable tokens: doc_id, doc_key, line_no, tokens, leaf, own, marks.

    ``leaf`` stands for the number of tokens and the leading ones, ``own`` for all of them;
    ``marks`` holds two bytes for each token. Lines without letters are no templates: blank ones,
    rules, bare numbers.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("at", pa.int32()), ("line_no", pa.int32()), ("tokens", pa.int32()), ("leaf", pa.int64()), ("own", pa.int64()), ("marks", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(token_marks())
        marks = token_marks()
        for batch in chain.from_iterable(slices(whole, 2) for whole in batches):
            rows = []
            for at, text in enumerate(batch.column(2).to_pylist()):
                for line_no, line in enumerate(text.split("\n")):
                    tokens = masked(line)
                    flat = " ".join(tokens)
                    if has_letter(flat):
                        lead = f"{len(tokens)} {' '.join(tokens[:DEPTH])}"
                        rows.append((at, line_no, len(tokens), signed(xxhash.xxh64_intdigest(lead)), signed(xxhash.xxh64_intdigest(flat)), b"".join(map(marks.__getitem__, tokens))))
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), batch.column(1).take(columns[0]), *columns[1:]], names=["doc_id", "doc_key", *schema.names[1:]])

    texts = documents.where("text IS NOT NULL").select("doc_id", doc_key().alias("doc_key"), "text")
    return texts.mapInArrow(run, f"doc_id {kind}, doc_key long, line_no int, tokens int, leaf long, own long, marks binary")


def doc_key() -> Column:
    """Tells documents apart that share an id, or have none."""
    return F.xxhash64("doc_id", "text")


class Leaf:
    """The templates of one leaf, whose lines have ``width`` tokens.

    A line joins the template with which it agrees most, if in ALIKE of all places, and makes the
    places variable in which it differs. The places after the leading ones are cut into one more
    segment than places may differ, so a line and a template that it can join have a segment in
    common: the index by segments finds the same templates as a comparison with all of them.
    """

    def __init__(self, width: int):
        self.need = math.ceil(ALIKE * width)
        segments = width - self.need + 1
        cuts = [2 * (DEPTH + (width - DEPTH) * i // segments) for i in range(segments + 1)]
        self.cuts = list(enumerate(pairwise(cuts)))
        self.found = np.zeros((8, width), "<u2")
        self.names: list[int] = []
        self.index: dict[tuple[int, bytes], list[int]] = {}

    def keys(self, line: np.ndarray) -> list[tuple[int, bytes]]:
        flat = line.tobytes()
        return [(i, flat[start:stop]) for i, (start, stop) in self.cuts]

    def put(self, k: int, known: tuple = ()) -> None:
        """Enter a template into the index by the keys that it has not been entered by."""
        for key in self.keys(self.found[k]):
            if key not in known:
                self.index.setdefault(key, []).append(k)

    def join(self, line: np.ndarray, own: int) -> int:
        """The name of the template that the line joins, or of the new one that it starts: the first line's ``own``."""
        n = len(self.names)
        indexed = n > SCAN
        near = sorted(set().union(*(self.index.get(key, ()) for key in self.keys(line)))) if indexed else range(n)
        if near:
            same = (self.found[near if indexed else slice(n)] == line).sum(axis=1)
            best = int(same.argmax())
            if same[best] >= self.need:
                k = near[best]
                if same[best] < len(line):
                    known = tuple(self.keys(self.found[k])) if indexed else ()
                    self.found[k][self.found[k] != line] = 0
                    if indexed:
                        self.put(k, known)
                return self.names[k]
        if n == len(self.found):
            self.found = np.concatenate([self.found, np.zeros_like(self.found)])
        self.found[n] = line
        self.names.append(own)
        if n >= SCAN:
            for k in range(n + 1) if n == SCAN else (n,):
                self.put(k)
        return own


def shared_templates(lines: DataFrame) -> DataFrame:
    """(leaf, own, template) for lines that share a leaf with other lines; the others are their own template.

    The most frequent lines of a leaf come first. A leaf is read as a stream by one task, which
    keeps its templates and not its lines.
    """
    long = lines.where(F.col("tokens") > DEPTH)
    crowded = long.groupBy("leaf").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("leaf")
    distinct = long.select("leaf", "own", "marks").join(crowded, "leaf").groupBy("leaf", "own").agg(F.count("*").alias("docs"), F.first("marks").alias("marks"))
    schema = pa.schema([("leaf", pa.int64()), ("own", pa.int64()), ("template", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variable = int.from_bytes(token_marks()[VARIABLE], "little")
        rows = chain.from_iterable(zip(*(column.to_pylist() for column in batch.columns)) for batch in batches)
        out: list[tuple] = []
        for leaf, members in groupby(rows, key=itemgetter(0)):
            known = None
            for _, _, own, marks in members:
                line = np.frombuffer(marks, "<u2").copy()
                line[line == variable] = 0
                known = known or Leaf(len(line))
                out.append((leaf, own, known.join(line, own)))
                if len(out) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ordered = distinct.select("leaf", "docs", "own", "marks").repartition("leaf").sortWithinPartitions("leaf", F.desc("docs"), "own")
    return ordered.mapInArrow(run, "leaf long, own long, template long")


def repeated_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, doc_key, drop): the numbers of the lines of each document whose template occurs in an earlier one."""
    lines = stored(lines_of(documents), "lines")
    shared = shared_templates(lines)
    template = F.coalesce("template", "own")
    # A long line also goes by itself; ``exact`` tells the two kinds of names apart.
    names = F.array(F.struct(template.alias("template"), F.lit(False).alias("exact")))
    both = F.array(F.struct(template.alias("template"), F.lit(False).alias("exact")), F.struct(F.col("own").alias("template"), F.lit(True).alias("exact")))
    named = stored(
        lines.drop("marks")
        .join(shared, ["leaf", "own"], "left")
        .select("doc_id", "doc_key", "line_no", "tokens", "leaf", F.explode(F.when(F.col("tokens") < LONG_TOKENS, names).otherwise(both)).alias("name"))
        .select("doc_id", "doc_key", "line_no", "tokens", "leaf", "name.template", "name.exact"),
        "templates",
    )
    doc = F.struct("doc_id", "doc_key")
    least = F.when(F.col("exact"), 2).when(F.col("tokens") < SHORT_TOKENS, MIN_DOCS_SHORT).otherwise(MIN_DOCS)
    recurring = (
        named.select("leaf", "template", "exact", "tokens", "doc_id", "doc_key")
        .distinct()
        .groupBy("leaf", "template", "exact", "tokens")
        .agg(F.count("*").alias("docs"), F.min(doc).alias("first_doc"))
        .where(F.col("docs") >= least)
        .select("leaf", "template", "exact", "first_doc")
    )
    return named.join(recurring, ["leaf", "template", "exact"]).where(~doc.eqNullSafe(F.col("first_doc"))).groupBy("doc_id", "doc_key").agg(F.collect_set("line_no").alias("drop"))


def drop_repeated_lines(documents: DataFrame) -> DataFrame:
    """All rows and columns of ``documents`` with the recurring lines gone from ``text``, and n_lines and n_dropped.

    The first document of a template, by doc_id, keeps its lines; repeated rows count as one
    document and are treated alike. Blank lines are kept. Null and empty texts come back as they
    are, with no lines dropped; documents without an id are told apart by their texts and come
    first in order; an empty table gives no rows. Other columns pass through, unless they are
    named like the two new ones, which replace them. Texts of any length are read whole.
    """
    names = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    # The input's own columns stay in a struct, so that no name of theirs meets one of these.
    marked = documents.drop("n_lines", "n_dropped").select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), doc_key().alias("key"))
    drops = repeated_lines(documents).select(F.col("doc_id").alias("of_id"), F.col("doc_key").alias("of_key"), "drop")
    joined = marked.join(drops, (F.col("key") == F.col("of_key")) & F.col("id").eqNullSafe(F.col("of_id")), "left")
    text = F.col("row").getField("text")
    lines = F.split(text, "\n")
    # The numbers of the lines that stay are a difference of sets, so each line is looked at once.
    staying = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "drop")
    # An array of one element binds the lines, so that the text is cut once and not for each of them.
    bound = F.array(F.struct(lines.alias("lines"), staying.alias("staying")))
    joined_again = F.transform(bound, lambda own: F.array_join(F.transform(own["staying"], lambda at: F.get(own["lines"], at)), "\n"))[0]
    kept = F.when(F.col("drop").isNull(), text).otherwise(joined_again)
    return joined.select(
        *[kept.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).alias("n_dropped"),
    )
