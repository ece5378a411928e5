"""Packing of tokenised documents into sequences by the sum-of-squares rule.

Each piece goes where the squared counts of open sequences, by residual gap, sum to least
afterwards: into one of the gaps that hold it, or into a new sequence. Every task packs what it
tokenises; sequences that are still open at its end are taken apart, and the pieces of all tasks
packed again together, longest first into the smallest gap. Pieces of one length are alike, so
this is planned from the number of pieces of each length; tasks look their pieces up in the plan.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from castline.llm.common import Memo, forget_others, small_batches, stored
from castline.llm.parts import coded_parts, gathered, slices

#: Distinct words, and distinct strings between spaces, that a worker keeps at most in each of two generations.
MEMO = 150_000
#: Bytes of text that are encoded together: places of their parts take many times as much.
ENCODED = 1 << 20
#: New words that the library is asked for together.
ASKED = 20_000
#: Id put after each document.
END = 0
#: Below this letter no letter changes under canonical composition, so words may be lower-cased first.
STABLE = "ɐ"


class Encoder:
    """The text -> ids functions of a worker, ids as little-endian unsigned 32-bit bytes.

    The vocabulary lower-cases, drops white space, cuts between letters and signs and marks each
    word's last token. So the library is given every distinct word once, many in one call, and
    their ids are told apart by the marks; what is not letters and then signs goes to it as it is.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # For words of lower-case letters alone, cut at spaces: what the vocabulary does to texts first leaves them as they are.
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words = Memo(self.ask, MEMO)
        self.parts = Memo(self.part, MEMO)

    def ask(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of many words of letters, asked for at once; none if they can't be told apart."""
        ids = np.asarray(self.plain.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(stops) != len(words):
            return {}  # each will be asked for by itself
        own = ids.tobytes()
        return {word: own[4 * start : 4 * stop] for word, start, stop in zip(words, [0, *stops], stops)}

    def part(self, text: str) -> bytes:
        """One string between spaces."""
        word, signs = split_word(text)
        return self.words[word] + (self.words[signs] if signs else b"") if word else self.ask(text)

    def values(self, distinct: list[str]) -> list[bytes]:
        """The ids of words of letters; new ones are asked for together."""
        found = self.words.known(distinct)
        new = [i for i, value in enumerate(found) if value is None]
        for start in range(0, len(new), ASKED):
            places = new[start : start + ASKED]
            own = self.learn([distinct[i] for i in places])
            self.words.keep(own)
            for i in places:
                found[i] = own[distinct[i]] if own else self.words[distinct[i]]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, and where each text begins and ends among them.

        Texts are cut at spaces and line ends, and these parts, where they are letters and then
        signs, into a word and its signs, of which far fewer are distinct.
        """
        distinct, codes, bounds = coded_parts(pc.replace_substring(texts, "\n", " "))
        letters = pc.ascii_rtrim(distinct, SIGNS)
        plain = pc.and_(pc.utf8_is_alpha(letters), pc.invert(pc.match_substring_regex(distinct, UNSTABLE)))
        words = pc.utf8_lower(letters.filter(plain)).dictionary_encode()
        signed = pc.and_(plain, pc.not_equal(letters, distinct))
        signs = pc.replace_substring_regex(distinct.filter(signed), LETTERS, "").dictionary_encode()
        others = [self.parts[text] for text in distinct.filter(pc.invert(plain)).to_pylist()]
        values = [*self.values(words.dictionary.to_numpy(zero_copy_only=False).tolist()), *map(self.words.__getitem__, signs.dictionary.to_pylist()), *others, b""]
        flat = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        # Each part is two of these values; the last one, which is empty, is the second of what stays whole.
        is_plain, is_signed = (kind.to_numpy(zero_copy_only=False).astype(bool) for kind in (plain, signed))
        first = len(words.dictionary) + len(signs.dictionary)
        halves = np.full((len(distinct), 2), len(values) - 1)
        halves[is_plain, 0] = words.indices.to_numpy()
        halves[is_signed, 1] = len(words.dictionary) + signs.indices.to_numpy()
        halves[~is_plain, 0] = first + np.arange(len(others))
        ids, ends = gathered(flat, np.cumsum(sizes) - sizes, sizes, halves.ravel(), 2 * np.arange(len(distinct) + 1))
        return gathered(ids, ends[:-1], np.diff(ends), codes, bounds)


def split_word(text: str) -> tuple[str, str]:
    """The lower-cased letters and the signs of a string that is letters and then signs; else two empty strings.

    Letters whose lower case is several letters are left to the library, which may cut between them.
    """
    if text.isascii():
        letters = text.rstrip(SIGNS)
        if letters.isalpha():
            return letters.lower(), text[len(letters) :]
    found = letters_and_signs(text)
    if found and (text.isascii() or (found[1].isalpha() and max(text) < STABLE and len(found[1].lower()) == len(found[1]))):
        return found[1].lower(), found[2]
    return "", ""


#: Letters that a word may not have: those whose lower case is several letters, and those from STABLE on.
UNSTABLE = r"[\x{130}\x{250}-\x{10FFFF}]"
#: What comes before a part's signs.
LETTERS = r"^[^!-/:-@\[-`{-~]+"
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
letters_and_signs = re.compile(r"([^\W\d_]+)([\W_]*)").fullmatch


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class SumOfSquares:
    """Open sequences of ``size`` places, by gap."""

    def __init__(self, size: int):
        self.size, self.made = size, 0
        self.counts = np.zeros(size + 1)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int) -> tuple[int, int, int]:
        """The sequence, the offset there and the gap left; of equally good gaps the smallest one that fits."""
        size, counts = self.size, self.counts
        held = counts[length:size]
        # Squares change by 1 - 2n where an open sequence leaves, by 1 + 2n where it arrives; a full one leaves for good.
        change = 2 * counts[: size - length] - 2 * held + 2
        if len(change):
            change[0] -= 1
        change[held == 0] = np.inf
        fresh = 2 * counts[size - length] + 1 if length < size else 0
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and change[best] <= fresh:
            gap = best + length
            sequence = self.open[gap].pop()
            counts[gap] -= 1
        else:
            gap, sequence = size, self.made
            self.made += 1
        left = gap - length
        if left:
            self.open[left].append(sequence)
            counts[left] += 1
        return sequence, size - gap, left


PIECE = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>, sequence_id long, offset long, open boolean, part long, nth long"


def number(level: int, part: int, sequence: int) -> int:
    """A sequence's id: the level (0 in a task, 1 from the plan of all tasks), the task that made it, and its number there."""
    return level << 58 | part << 28 | sequence


def pack_documents(documents: DataFrame, path: str, size: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Cut and pack all rows of ``documents`` (doc_id, text): one row for each piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if ``keep_ids``.
    Documents longer than ``size`` tokens, their end included, are cut into pieces of ``size``; the
    last may be shorter. Null texts count as empty and are one piece of the end token alone; null
    ids and repeated rows are packed like others; an empty table gives no rows; other columns are
    not read. A text of any length is tokenised whole.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = PIECE.format(kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(encoder(path).words, encoder(path).parts)
        packer, part = SumOfSquares(size), TaskContext.get().partitionId()
        held: dict[int, list[tuple]] = {}  # pieces of open sequences
        done: list[tuple] = []
        for batch in batches:
            for doc, ids in encoded(batch):
                for piece, start in enumerate(range(0, len(ids) // 4, size)):
                    own = ids[4 * start : 4 * (start + size)]
                    length = len(own) // 4
                    sequence, offset, left = packer.place(length)
                    row = (doc, piece, start, length, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32) if keep_ids else None, number(0, part, sequence), offset, left > 0, part, 0)
                    if left:
                        held.setdefault(sequence, []).append(row)
                    else:
                        done += [(*r[:8], False, part, 0) for r in held.pop(sequence, [])]
                        done.append(row)
            if done:
                yield rows_batch(done, kind)
                done = []
        # The next task learns its words anew, for a tenth more time; kept, they would lie beside all later stages as long as the worker lives.
        forget_others()
        seen: Counter[int] = Counter()
        for rows in held.values():
            for r in rows:
                done.append((*r[:10], seen[r[3]]))
                seen[r[3]] += 1
            if len(done) >= 20_000:
                yield rows_batch(done, kind)
                done = []
        if done:
            yield rows_batch(done, kind)

    def encoded(whole: pa.RecordBatch) -> Iterator[tuple]:
        closing = np.array([END], "<u4").tobytes()
        for batch in slices(whole, 1, ENCODED):
            ids, bounds = encoder(path).encode(pc.fill_null(batch.column(1), ""))
            flat = ids.tobytes()
            for doc, (start, end) in zip(batch.column(0).to_pylist(), pairwise((4 * bounds).tolist())):
                yield doc, flat[start:end] + closing

    def rows_batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64() if kind == "bigint" else None, pa.int32(), *[pa.int64()] * 3, pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    with small_batches(documents.sparkSession):
        rows = stored(documents.select("doc_id", "text").mapInArrow(run, schema), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "sequence_id", "offset"]
    loose = rows.where("open")
    counts = {n: count for n, count in loose.groupBy("length").count().collect()}
    made, plan = plan_of(counts, size)
    if made >= loose.select("sequence_id").distinct().count():
        return rows.select(columns)  # the tasks' own sequences are no more

    # A piece's place among all of its length: those of earlier tasks come first.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = loose.groupBy("part", "length").count().select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = loose.join(tasks, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before")).select(*columns[:-2], "nth")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences, offsets = placed(plan, batch.column("length").to_numpy(), batch.column("nth").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(number(1, 0, 0) + sequences), pa.array(offsets)], names=columns)

    again = ranked.mapInArrow(look_up, rows.select(columns).schema)
    return rows.where("not open").select(columns).unionByName(again)


def plan_of(counts: dict[int, int], size: int) -> tuple[int, dict[int, np.ndarray]]:
    """The number of sequences that hold so many pieces of each length, and for each length its runs of pieces.

    Every piece, longest first, goes into the smallest gap that holds it. Sequences with equal gaps
    are alike and treated together, so the work and the plan grow with ``size`` and not with the
    pieces. A run is (first piece, first sequence, pieces in each sequence, offset).
    """
    made, plan = 0, {}
    open_: dict[int, list[tuple[int, int]]] = {}  # by gap: (first sequence, number)
    for length in sorted(counts, reverse=True):
        runs, at, left = [], 0, counts[length]
        gaps = [gap for gap in open_ if gap >= length]
        heapq.heapify(gaps)
        while left:
            if gaps:
                gap = gaps[0]
                first, n = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    heapq.heappop(gaps)
            else:
                gap, first, n = size, made, -(-left // (size // length))
                made += n
            each = gap // length
            whole = min(n, left // each)
            # Sequences that take as many as they hold, one that takes the rest, those that stay as they are.
            for take, count in ((each, whole), (left - each * whole if whole < n else 0, 1)):
                if take and count:
                    runs.append((at, first, take, size - gap))
                    if gap > take * length:
                        open_.setdefault(gap - take * length, []).append((first, count))
                    at, left, first, n = at + take * count, left - take * count, first + count, n - count
            if n:
                open_.setdefault(gap, []).append((first, n))
        plan[length] = np.array(runs, np.int64)
    return made, plan


def placed(plan: dict[int, np.ndarray], lengths: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences and offsets of pieces, which are told by their lengths and their places among those of equal length."""
    sequences, offsets = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
    for length in np.unique(lengths):
        at = lengths == length
        runs = plan[int(length)]
        first, sequence, each, offset = runs[np.searchsorted(runs[:, 0], nth[at], "right") - 1].T
        own = nth[at] - first
        sequences[at], offsets[at] = sequence + own // each, offset + own % each * length
    return sequences, offsets
