"""A public byte-level BPE vocabulary: its merges, its symbols and its way of cutting texts.

Used by the encoding automaton and by the token counts.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from castline.llm.parts import by_kind, coded_parts, distinct_parts, numbered

# The cutting pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
cut_words = regex.compile(PATTERN).findall
#: A space whose neighbours are no white space starts a new word, so texts can be cut there first.
cut_single_spaces = regex.compile(r"(?<=\S) (?=\S)").split
has_other_spaces = regex.compile(r"\s | \s|\A | \Z").search
#: All that any of the libraries takes for white space, as an Arrow expression.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Put between parts while Arrow cuts texts; texts that hold it are cut one by one.
CUT = "\0"
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters of which libraries of other years may not know that they are letters.
LATE = r"[\x{250}-\x{10FFFF}]"


@dataclass(frozen=True)
class Vocabulary:
    """``labels``: id -> bytes; ``merges``: (left id, right id) -> (rank, id); ``single``: byte -> id; ``special``: text -> id."""

    labels: list[bytes]
    merges: dict[tuple[int, int], tuple[int, int]]
    single: list[int]
    special: dict[str, int]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 stands for itself, the rest follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """Read a tokenizers JSON file once for each Python worker."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    letters, ids = byte_letters(), found["model"]["vocab"]
    special = {t["content"]: t["id"] for t in found["added_tokens"]}
    labels = [b""] * (1 + max([*ids.values(), *special.values()]))
    for token, i in ids.items():
        labels[i] = bytes(letters[c] for c in token)
    for text, i in special.items():
        labels[i] = text.encode()
    single = [0] * 256
    for letter, b in letters.items():
        single[b] = ids[letter]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in found["model"]["merges"])
    merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
    return Vocabulary(labels, merges, single, special)


def split_special(text: str, vocabulary: Vocabulary) -> list[str]:
    """The text cut at special strings, which are elements of their own."""
    if not any(s in text for s in vocabulary.special):
        return [text]
    return [x for x in regex.split("(" + "|".join(map(regex.escape, vocabulary.special)) + ")", text) if x]


def cut_parts(text: str, vocabulary: Vocabulary) -> list[str]:
    """The text cut at special strings and before single spaces, which stay with what follows."""
    found: list[str] = []
    for piece in split_special(text, vocabulary):
        if piece in vocabulary.special:
            found.append(piece)
        else:
            first, *rest = cut_single_spaces(piece)
            found += [first, *(" " + x for x in rest)]
    return found


def parts_of(texts: list[str], vocabulary: Vocabulary) -> Iterator[tuple[list[int], list[str], np.ndarray, np.ndarray]]:
    """The parts of many texts, of which the pattern sees each by itself: places of texts, distinct parts, their numbers, bounds of the texts.

    Texts whose spaces are all single ones are cut together, the others one by one.
    """
    plain, odd = by_kind(texts, lambda t: not has_other_spaces(t) and not any(s in t for s in vocabulary.special))
    if plain:
        parts, codes, bounds = distinct_parts(pa.array([texts[i] for i in plain], pa.string()))
        # Only the first part of a text has no space before it.
        first, own = np.unique(codes[bounds[:-1]], return_inverse=True)
        codes[bounds[:-1]] = len(parts) + own
        yield plain, [*(" " + p for p in parts), *(parts[i] for i in first)], codes, bounds
    if odd:
        yield odd, *numbered([cut_parts(texts[i], vocabulary) for i in odd])


def cut_texts(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Which texts Arrow can cut, and their parts: distinct parts, the numbers of those that follow each other, bounds of the texts.

    It cuts before single spaces, in texts without two white spaces side by side also before line
    ends, and these stay with what follows: the parts put together are the text.
    """
    odd = pc.match_substring_regex(texts, rf"{WHITE}\x20|\x20{WHITE}|\A\x20|\x20\z|\x00")
    for special in vocabulary.special:
        odd = pc.or_(odd, pc.match_substring(texts, special))
    plain = texts.filter(pc.invert(odd))
    spaced = pc.replace_substring(plain, " ", CUT + " ")
    cut = pc.if_else(pc.match_substring_regex(plain, WHITE + WHITE), spaced, pc.replace_substring(spaced, "\n", CUT + "\n"))
    return ~odd.to_numpy(zero_copy_only=False), *coded_parts(cut, CUT)


@dataclass(frozen=True)
class Halves:
    """Parts as three words each, told by numbers: of ``words``, then of ``others``, then of an empty one.

    ``words`` are words by the pattern: line ends, letters with or without a space before them, signs.
    ``others`` are whole parts that are not of this form.
    """

    words: list[str]
    others: list[str]
    codes: np.ndarray


def halved(parts: pa.Array) -> Halves:
    """Parts of ``cut_texts`` cut into a line end, letters and signs, of which far fewer are distinct."""
    ended = pc.starts_with(parts, "\n")
    rest = pc.if_else(ended, pc.utf8_slice_codeunits(parts, 1), parts)
    lettered = pc.ascii_rtrim(rest, SIGNS)
    bare = pc.ascii_ltrim(lettered, " ")
    plain = pc.and_(pc.utf8_is_alpha(bare), pc.invert(pc.match_substring_regex(bare, LATE)))
    signed = pc.and_(plain, pc.not_equal(lettered, rest))
    letters = lettered.filter(plain).dictionary_encode()
    signs = pc.replace_substring_regex(rest.filter(signed), r"^[^!-/:-@\[-`{-~]+", "").dictionary_encode()
    words = ["\n", *letters.dictionary.to_pylist(), *signs.dictionary.to_pylist()]
    others = parts.filter(pc.invert(plain)).to_pylist()
    is_ended, is_plain, is_signed = (kind.to_numpy(zero_copy_only=False).astype(bool) for kind in (ended, plain, signed))
    codes = np.full((len(parts), 3), len(words) + len(others))
    codes[is_ended & is_plain, 0] = 0
    codes[is_plain, 1] = 1 + letters.indices.to_numpy()
    codes[~is_plain, 1] = len(words) + np.arange(len(others))
    codes[is_signed, 2] = 1 + len(letters.dictionary) + signs.indices.to_numpy()
    return Halves(words, others, codes.ravel())
