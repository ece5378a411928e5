"""Chat formatting: roles of transcript turns by a hidden Markov model, then canonical turns.

The hidden states are the roles. A turn is seen as its speaker marker (a role name, an alias, an
unknown name or none) and a few line features. The chances of roles to begin, to follow each
other and to have these features are learned from the turns whose markers name a role. Viterbi
finds the likeliest roles of a whole conversation. Conversations are cut into blocks of a bounded
number of turns: each block is reduced to the best score from every first to every last role, the
few rows of a conversation are joined into the best path over its blocks, and each block is then
decoded between its ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from castline.llm.common import stored

ROLES = ("system", "user", "assistant")
# Names by which transcripts mark their speakers.
ALIASES = {
    "system": ("system", "sys", "developer", "instructions"),
    "user": ("user", "human", "q", "question", "customer", "student", "client", "prompter", "usr", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "agent", "gpt", "model", "chatbot", "teacher"),
}
#: Classes of markers: names in the role column, names before the text, unknown names, none.
GIVEN, WRITTEN, OTHER, NONE = 0, len(ROLES), 2 * len(ROLES), 2 * len(ROLES) + 1
#: Turns of a block: decoding holds one block in memory.
BLOCK = 4096
#: How often a marker of the four classes names the speaker, or is there at all: what no unlabelled table can tell.
RIGHT = {GIVEN: 0.99, WRITTEN: 0.94}
#: What roles are thought to begin and to follow each other before turns are counted, and the weight of that.
FIRST = np.array([0.30, 0.68, 0.02])
NEXT = np.array([[0.05, 0.90, 0.05], [0.01, 0.09, 0.90], [0.01, 0.90, 0.09]])
BELIEF = 0.2
#: Line features of a turn; each has a bit.
FEATURES = 5
#: Turns of each role with each combination of features that are thought to have been seen before.
SEEN = 5.0
#: Letters of the text by which equal turns are dealt out to tasks.
RANGE = 64

_marker = r"^\s*(?:[#>*\[(<|\s]*)([A-Za-z]{1,12})(?:[\])>|*\s]*)[:：]\s+"


def marker_class(role: Column, text: Column) -> Column:
    """The number of the role a turn is marked with: by its role column, or else by a name and a colon before its text."""
    name, written = F.lower(F.trim(F.when(F.trim(role) != "", role))), F.lower(F.nullif(F.regexp_extract(text, _marker, 1), F.lit("")))
    found = F.when(name.isNull() & written.isNull(), NONE)
    for i, role_name in enumerate(ROLES):
        found = found.when(name.isin(*ALIASES[role_name]), GIVEN + i).when(name.isNull() & written.isin(*ALIASES[role_name]), WRITTEN + i)
    return found.otherwise(OTHER).cast("int")


def body(text: Column, marker: Column) -> Column:
    """The text, trimmed, and without the name before it where that was what marked the turn."""
    whole = F.coalesce(text, F.lit(""))
    return F.trim(F.when(marker.between(WRITTEN, OTHER - 1), F.regexp_replace(whole, _marker, "")).otherwise(whole))


def render(role: Column, content: Column) -> Column:
    """A turn between its marks. ``<|`` in the content gets a backslash, so no content closes a turn or opens one; one more where there are some, so that it can be undone."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), F.regexp_replace(content, r"<(\\*)\|", r"<\\$1|"), F.lit("<|im_end|>\n"))


def features(text: Column) -> Column:
    """Line features as bits: 1 long, 2 ends in a question, 4 starts like an instruction, 8 several lines, 16 has lines of a list or of code."""
    t = F.coalesce(text, F.lit(""))
    flags = (
        F.length(t) > 400,
        F.rtrim(t).endswith("?"),
        F.lower(t).rlike(r"^\s*(you are|you must|act as|your task|follow these)"),
        F.length(t) - F.length(F.translate(t, "\n", "")) >= 3,
        t.rlike(r"(?m)^\s*([-*•]|[0-9]+[.)]|```)"),
    )
    return sum((F.when(flag, 1 << i).otherwise(0) for i, flag in enumerate(flags)), F.lit(0)).cast("int")


@dataclass(frozen=True)
class Chances:
    """Log-probabilities: roles at the start, from role to role, and of (marker, features) by role."""

    first: np.ndarray
    next: np.ndarray
    marker: np.ndarray
    features: np.ndarray

    def of(self, own: list[tuple]) -> np.ndarray:
        """Emission scores of a block's rows, which have marker and bits at places 3 and 4."""
        return self.marker[[r[3] for r in own]] + self.features[[r[4] for r in own]]


def chances(first: np.ndarray, follow: np.ndarray, seen: np.ndarray) -> Chances:
    """From counts of roles that begin, that follow each other, and that have each combination of features."""
    n = len(ROLES)
    marker = np.full((NONE + 1, n), 1.0)
    for start, right in RIGHT.items():
        marker[start : start + n] = (1 - right) / (n - 1)
        marker[range(start, start + n), range(n)] = right
    share = lambda counts, before: BELIEF * before + (1 - BELIEF) * np.where(counts.sum(axis=-1, keepdims=True) > 0, counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1), before)
    held = seen + SEEN
    return Chances(np.log(share(first, FIRST)), np.log(share(follow, NEXT)), np.log(marker), np.log(held / held.sum(axis=0)))


def learn(placed: DataFrame) -> Chances:
    """The chances by the turns of ``placed`` (conv_id, block, at, marker, bits, before, begins) that name their speaker."""
    n = len(ROLES)
    role = lambda c: F.when(F.col(c) < OTHER, F.col(c) % n)
    known = placed.withColumns({"is": role("marker"), "was": role("before")})
    # Turns at the start of a block follow the last turn of the block before.
    blocks = Window.partitionBy("conv_id").orderBy("block")
    ends = known.groupBy("conv_id", "block").agg(F.min_by("is", "at").alias("is"), F.max_by("is", "at").alias("last"))
    ends = ends.withColumns({"was": F.lag("last").over(blocks), "begins": F.row_number().over(blocks) == 1})
    inside = known.groupBy("is", "was", "bits").count().where("is IS NOT NULL").collect()
    between = ends.groupBy("is", "was", "begins").count().where("is IS NOT NULL").collect()
    first, follow, seen = np.zeros(n), np.zeros((n, n)), np.zeros((1 << FEATURES, n))
    for row in inside:
        seen[row["bits"], row["is"]] += row["count"]
    for row in (*inside, *between):
        if row["was"] is not None:
            follow[row["was"], row["is"]] += row["count"]
    for row in between:
        first[row["is"]] += row["count"] * row["begins"]
    return chances(first, follow, seen)


def transfer(scores: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """For the turns of a block the best score from each role at the first to each role at the last one."""
    best = np.where(np.eye(len(ROLES), dtype=bool), scores[0], -np.inf)
    for row in scores[1:]:
        best = (best[:, :, None] + follow).max(axis=1) + row
    return best


def decode(scores: np.ndarray, known: Chances, first: int | None = None, last: int | None = None) -> list[int]:
    """The best path, between given roles of the first and the last turn; of equal ones the earlier role."""
    now = scores[0] + (known.first if first is None else np.where(np.arange(len(ROLES)) == first, 0.0, -np.inf))
    back = []
    for row in scores[1:]:
        ways = now[:, None] + known.next
        back.append(ways.argmax(axis=0))
        now = ways.max(axis=0) + row
    path = [int(now.argmax()) if last is None else last]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def placed_turns(turns: DataFrame, block: int) -> DataFrame:
    """The turns in order: conv_id, block, at (in the block), marker, bits, before (the marker of the turn before it in the block), turn, role, text.

    Tasks take ranges of the order, so a conversation of any length is dealt out to many; a block
    is what follows each other in one of them, ``block`` turns at most, and blocks are numbered in order.
    """
    turn = F.col("turn").asc_nulls_last()
    ranged = (
        turns.select("conv_id", "turn", "role", "text", marker_class(F.col("role"), F.col("text")).alias("marker"), features(F.col("text")).alias("bits"))
        .repartitionByRange("conv_id", turn, "role", F.substring("text", 1, RANGE))
        .sortWithinPartitions("conv_id", turn, "role", "text")
    )
    conv, kind = (ranged.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at, now, before = TaskContext.get().partitionId() << 32, -1, None, None
        for batch in batches:
            rows = []
            for conv_id, marker in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                at += 1
                if at == block or conv_id != now or not number & 0xFFFFFFFF:
                    number, at, now, before = number + 1, 0, conv_id, None
                rows.append((number, at, before))
                before = marker
            numbers, places, befores = zip(*rows) if rows else ((), (), ())
            columns = [batch.column(0), pa.array(numbers, pa.int64()), pa.array(places, pa.int64()), batch.column(4), batch.column(5), pa.array(befores, pa.int32()), *batch.columns[1:4]]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "at", "marker", "bits", "before", "turn", "role", "text"])

    return ranged.mapInArrow(run, f"conv_id {conv}, block long, at long, marker int, bits int, before int, turn {kind}, role string, text string")


def by_block(batches: Iterator[pa.RecordBatch], work: Callable[[list[tuple]], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Apply ``work`` to the rows of one (conv_id, block) after another; rows come sorted by these."""
    rows = chain.from_iterable(zip(*(column.to_pylist() for column in batch.columns)) for batch in batches)
    out: list[tuple] = []
    for _, own in groupby(rows, key=itemgetter(0, 1)):
        out += work(list(own))
        if len(out) >= BLOCK:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def join_blocks(blocks: pd.DataFrame, known: Chances) -> pd.DataFrame:
    """The roles at both ends of each block of a conversation, on the best path over all its blocks."""
    blocks = blocks.sort_values("block").reset_index(drop=True)
    ways = np.array(blocks["best"].tolist()).reshape(-1, len(ROLES), len(ROLES))
    start, back = known.first, []
    for way in ways:
        through = start[:, None] + way
        enter, end = through.argmax(axis=0), through.max(axis=0)
        leave = (end[:, None] + known.next).argmax(axis=0)
        back.append((enter, leave))
        start = (end[:, None] + known.next).max(axis=0)
    last = int(end.argmax())
    ends = []
    for i in range(len(ways) - 1, -1, -1):
        enter = int(back[i][0][last])
        ends.append((enter, last))
        last = int(back[i - 1][1][enter]) if i else last
    ends.reverse()
    return blocks[["conv_id", "block"]].assign(first=[a for a, _ in ends], last=[b for _, b in ends])


def format_turns(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Recover the role of every row of ``turns`` (conv_id, turn, role, text) and render it.

    Columns: conv_id, turn, role_given, role, content, rendered. The given role counts as a marker
    only: aliases become canonical names, missing, unknown and misplaced ones are replaced if the
    rest of the conversation tells so. A name before the text goes only where it marked the turn,
    so where no role was given. A conversation is its rows by turn (null last), then role
    and text; a null conv_id is a conversation as well. Null texts count as empty and are rendered
    as an empty turn; repeated rows and equal turns are kept; an empty table gives no rows; other
    columns are not read. Texts of any length are rendered whole.
    """
    placed = stored(placed_turns(turns, block), "turns")
    known = learn(placed)
    conv, turn = (placed.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    conv_type = to_arrow_type(placed.schema["conv_id"].dataType)
    long = placed.where("at = 0").groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("long_id"))
    out = pa.schema([("conv_id", conv_type), ("block", pa.int64()), ("best", pa.list_(pa.float64()))])
    summed = (
        placed.select("conv_id", "block", "at", "marker", "bits")
        .join(long, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi")
        .repartition("conv_id", "block")
        .sortWithinPartitions("conv_id", "block", "at")
        .mapInArrow(
            lambda batches: by_block(batches, lambda own: [(own[0][0], own[0][1], transfer(known.of(own), known.next).ravel().tolist())], out),
            f"conv_id {conv}, block long, best array<double>",
        )
    )
    ends = summed.groupBy("conv_id").applyInPandas(lambda blocks: join_blocks(blocks, known), f"conv_id {conv}, block long, first int, last int")
    ends = ends.select(F.col("conv_id").alias("end_id"), F.col("block").alias("end_block"), "first", "last")
    told = placed.join(ends, F.col("conv_id").eqNullSafe(F.col("end_id")) & (F.col("block") == F.col("end_block")), "left").select(
        "conv_id", "block", "at", "marker", "bits", "first", "last", "turn", "role", "text"
    )
    kinds = pa.schema([("conv_id", conv_type), ("turn", to_arrow_type(placed.schema["turn"].dataType)), ("role_given", pa.string()), ("role", pa.string()), ("marker", pa.int32()), ("text", pa.string())])

    def roles(own: list[tuple]) -> list[tuple]:
        first, last = own[0][5:7]
        return [(r[0], r[7], r[8], ROLES[role], r[3], r[9]) for r, role in zip(own, decode(known.of(own), known, first, last))]

    found = (
        told.repartition("conv_id", "block")
        .sortWithinPartitions("conv_id", "block", "at")
        .mapInArrow(lambda batches: by_block(batches, roles, kinds), f"conv_id {conv}, turn {turn}, role_given string, role string, marker int, text string")
    )
    content = body(F.col("text"), F.col("marker"))
    return found.select("conv_id", "turn", "role_given", "role", content.alias("content"), render(F.col("role"), content).alias("rendered"))
