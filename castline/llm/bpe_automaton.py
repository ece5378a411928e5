"""BPE by a deterministic token automaton, built from the merges by one gadget after another.

Before any merge the automaton has one state, with an arc to itself for each byte. The gadget
of a merge (a, b) -> c leads the arc of a to a copy of its target that lacks the arc of b, and
adds, beside each arc of a, an arc of c to where b led. What remains accepts, of all ways to
cut a word into tokens, the one that the merges make.

All arcs of one token lead to one state. So the automaton is compiled into three tables: the
state to which each token leads; the arcs that each state lacks, with the merge that took them
away; and the bytes of the arcs' labels, as transitions from node to node. An arc that a later
merge would have put beside a missing arc is missing too; so a token is out of a state if a
missing arc is met on the way down its left parts, before the part that was already made when
the arc went.

A word is read from left to right. As each beginning of a word has one way to be cut, one path
at most leads to each place: places hold one state each, and nothing is taken back.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from castline.llm.byte_pairs import Vocabulary, cut_parts, cut_texts, cut_words, halved, load
from castline.llm.common import Memo
from castline.llm.parts import dealt, gathered, numbered, slices

#: Distinct words, and distinct strings between spaces, that a Python worker keeps at most in each of two generations.
MEMO = 200_000
#: Bytes of a word up to which words are read side by side; longer ones are read alone.
SHORT = 512
#: Places of the marks by which most pairs of a state and a token are seen to have their arc.
MARKS = 1 << 24


def marked(keys: np.ndarray) -> np.ndarray:
    return keys * 0x9E3779B1 >> 7 & MARKS - 1


class Automaton:
    """The compiled automaton of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.labels = vocabulary.labels
        n = len(self.labels)
        self.left, self.rank = [-1] * n, [-1] * n
        target, never = [0] * n, set(vocabulary.special.values())
        # A state is (the state it was copied from, the token whose arc went, the rank of the merge).
        states: list[tuple[int, int, int]] = [(-1, -1, -1)]
        for (a, b), (rank, c) in vocabulary.merges.items():
            reached, beyond = target[a], target[b]
            if a in never or b in never or not self.has_arc(lacking(states, reached), 0, b):
                never.add(c)  # b never follows a, so the merge never happens
                continue
            self.left[c], self.rank[c] = a, rank
            target[c] = beyond
            target[a] = len(states)
            states.append((reached, b, rank))

        # Only states to which a token leads are kept; they are numbered anew, in steps of n.
        number = {state: n * i for i, state in enumerate(sorted({0, *target}))}
        self.target = np.array([number[state] for state in target], np.int64)
        self.lacks = {at + token: rank for state, at in number.items() for token, rank in lacking(states, state).items()}
        self.lack_keys = np.array(sorted(self.lacks), np.int64)
        self.lack_ranks = np.array([self.lacks[k] for k in self.lack_keys.tolist()], np.int64)
        self.lack_marks = np.zeros(MARKS, bool)
        self.lack_marks[marked(self.lack_keys)] = True
        self.spine = np.array([self.left, self.rank], np.int64)
        self.compile_labels([token for token, label in enumerate(self.labels) if label and token not in never])
        self.sizes = np.array(list(map(len, self.labels)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.labels), np.uint8)

    def compile_labels(self, tokens: list[int]) -> None:
        """``steps``: node, byte -> node, 0 where nothing follows; ``ends``: node -> token. Nodes without a way on share the last row."""
        ways: dict[bytes, int] = {b"": -1}
        for token in tokens:
            label = self.labels[token]
            for i in range(1, len(label)):
                ways.setdefault(label[:i], -1)
            ways[label] = token
        inner = {label[:-1] for label in ways if label}
        order = sorted(ways, key=lambda label: (label not in inner, label))
        number = {label: i for i, label in enumerate(order)}
        self.last = len(inner)
        self.steps = np.zeros((self.last + 1, 256), np.int32)
        for label, i in number.items():
            if label:
                self.steps[number[label[:-1]], label[-1]] = i
        self.ends = np.array([ways[label] for label in order], np.int64)

    def has_arc(self, lacks: dict[int, int], state: int, token: int) -> bool:
        made = None
        while token >= 0:
            went = lacks.get(state + token)
            if went is not None and (made is None or made >= went):
                return False
            token, made = self.left[token], self.rank[token]
        return True

    def have_arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """As ``has_arc``, for many pairs at once."""
        found = np.ones(len(tokens), bool)
        at, made = np.arange(len(tokens)), np.full(len(tokens), np.iinfo(np.int64).max)
        while len(at):
            keys = states + tokens
            near = np.flatnonzero(self.lack_marks[marked(keys)])
            if len(near):
                place = np.minimum(np.searchsorted(self.lack_keys, keys[near]), len(self.lack_keys) - 1)
                gone = (self.lack_keys[place] == keys[near]) & (made[near] >= self.lack_ranks[place])
                found[at[near[gone]]] = False
            down, made = self.spine[:, tokens]
            more = (down >= 0) & found[at]
            at, states, tokens, made = at[more], states[more], down[more], made[more]
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens of the path that reads the word, driven by the tables: from each place along the labels that go on there."""
        steps, ends, target, lacks, last = self.steps, self.ends, self.target, self.lacks, self.last
        n = len(word)
        states, arcs = [0] * (n + 1), [-1] * (n + 1)
        for start in range(n):
            node, state = 0, states[start]
            for at in range(start, n):
                node = int(steps[min(node, last), word[at]])
                if not node:
                    break
                token = int(ends[node])
                if token >= 0 and self.has_arc(lacks, state, token):
                    states[at + 1], arcs[at + 1] = int(target[token]), token
        found = []
        while n:
            found.append(arcs[n])
            n -= len(self.labels[arcs[n]])
        return found[::-1]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """As ``encode_word``, ids as bytes, for many words at once: all words stand at their first place, then at their second, and so on."""
        order = sorted((i for i, w in enumerate(words) if len(w) <= SHORT), key=lambda i: -len(words[i]))
        sizes = np.array([len(words[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(words[i] + b"\0" for i in order), np.uint8)
        begin = np.cumsum(sizes + 1) - sizes - 1
        states, arcs = np.zeros(len(flat), np.int64), np.full(len(flat), -1, np.int64)
        for start in range(int(sizes[0]) if len(sizes) else 0):
            at = begin[: np.searchsorted(-sizes, -start, "left")] + start
            own, end = states[at], begin[: len(at)] + sizes[: len(at)]
            node = np.zeros(len(at), np.int32)
            while len(at):
                node = self.steps[np.minimum(node, self.last), flat[at]]
                at = at + 1
                tokens = self.ends[node]
                named = np.flatnonzero(tokens >= 0)
                led = named[self.have_arcs(own[named], tokens[named])]
                states[at[led]], arcs[at[led]] = self.target[tokens[led]], tokens[led]
                on = np.flatnonzero((node > 0) & (at < end))
                at, own, end, node = at[on], own[on], end[on], node[on]

        # Back along the arcs, from the ends of all words.
        found = [b""] * len(words)
        use, place, left = np.zeros(len(flat), bool), begin + sizes, np.arange(len(order))
        while len(left):
            use[place] = True
            place = place - self.sizes[arcs[place]]
            on = place > begin[left]
            place, left = place[on], left[on]
        ids, ends = arcs[use].astype(np.int32).tobytes(), np.cumsum(use)
        bounds = (4 * np.concatenate([[0], ends[begin + sizes]])).tolist()
        for i, a, b in zip(order, bounds, bounds[1:]):
            found[i] = ids[a:b]
        for i, word in enumerate(words):
            if len(word) > SHORT:
                found[i] = np.array(self.encode_word(word), np.int32).tobytes()
        return found

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the arcs' labels emit, for the ids of many texts, and where each text begins and ends."""
        return gathered(self.bytes, self.starts, self.sizes, ids, bounds)


def lacking(states: list[tuple[int, int, int]], state: int) -> dict[int, int]:
    """The tokens whose arcs went from a state or from those it was copied from, each with the rank of the first such merge."""
    found = {}
    while state:
        state, token, rank = states[state]
        found[token] = rank
    return found


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The automaton of a worker and its function from texts to ids and their bounds, with its memos."""
    vocabulary = load(path)
    automaton, special = Automaton(vocabulary), vocabulary.special
    words, parts = Memo(lambda w: read([w])[0], MEMO), Memo(lambda p: parts_read([p])[0], MEMO)

    def read(own: list[str]) -> list[bytes]:
        """The ids of distinct words; new ones are read side by side."""
        found = words.known(own)
        new = [i for i, value in enumerate(found) if value is None]
        made = automaton.encode_words([own[i].encode() for i in new])
        for i, value in zip(new, made):
            found[i] = value
        words.keep({own[i]: value for i, value in zip(new, made)})
        return found

    def parts_read(own: list[str]) -> list[bytes]:
        """The ids of distinct parts, which are cut into words."""
        found = parts.known(own)
        new = [i for i, value in enumerate(found) if value is None]
        cut = [[] if own[i] in special else cut_words(own[i]) for i in new]
        distinct = list(dict.fromkeys(chain.from_iterable(cut)))
        ids = dict(zip(distinct, read(distinct)))
        for i, cuts in zip(new, cut):
            found[i] = np.array([special[own[i]]], np.int32).tobytes() if own[i] in special else b"".join([ids[w] for w in cuts])
        parts.keep({own[i]: found[i] for i in new})
        return found

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain, distinct, codes, bounds = cut_texts(texts, vocabulary)
        halves = halved(distinct)
        ids, ends = dealt([*read(halves.words), *parts_read(halves.others), b""], "i4", halves.codes, 3 * np.arange(len(distinct) + 1))
        found, at = [gathered(ids, ends[:-1], np.diff(ends), codes, bounds)], np.flatnonzero(plain)
        if len(at) == len(texts):
            return found[0]
        odd = texts.filter(pa.array(~plain)).to_pylist()
        distinct, codes, bounds = numbered([cut_parts(text, vocabulary) for text in odd])
        found.append(dealt(parts_read(distinct), "i4", codes, bounds))
        # Back into the order of the texts.
        starts, sizes, before = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), 0
        for at, (ids, bounds) in zip((at, np.flatnonzero(~plain)), found):
            starts[at], sizes[at] = before + bounds[:-1], np.diff(bounds)
            before += len(ids)
        flat = np.concatenate([ids for ids, _ in found])
        return gathered(flat, starts, sizes, np.arange(len(texts)), np.arange(len(texts) + 1))

    return automaton, encode


def encode_texts(documents: DataFrame, path: str) -> DataFrame:
    """For every row of ``documents`` (doc_id, text): its token ids and the text decoded from them.

    Null texts are encoded as empty, to no ids and an empty text; null ids and repeated rows come
    back as they are; an empty table gives no rows; other columns are not read. A text of any
    length is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, encode = encoder(path)
        for whole in batches:
            for batch in slices(whole, 1):
                ids, bounds = encode(pc.fill_null(batch.column(1), ""))
                emitted, ends = automaton.decode(ids, bounds)
                emitted = emitted.tobytes()
                decoded = [emitted[start:end].decode(errors="replace") for start, end in pairwise(ends.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
