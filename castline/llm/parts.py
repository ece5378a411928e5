"""Texts cut into parts, many texts at once: each distinct part is seen to once, and its values are dealt out again.

Arrow cuts the texts and numbers the distinct parts of a slice; what a part stands for comes
from a worker's memo; NumPy copies it to all places where the part occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut together; a longer text is a slice of its own.
TOGETHER = 4 << 20


def slices(batch: pa.RecordBatch, column: int, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs whose texts, those of ``column``, come to no more than ``most`` bytes, or are one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def distinct_parts(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct strings between the spaces of some texts, the numbers of those that follow each other, and where each text begins and ends among these."""
    distinct, codes, bounds = coded_parts(texts)
    return distinct.to_pylist(), codes, bounds


def coded_parts(texts: pa.Array, separator: str = " ") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As ``distinct_parts``, with the strings as an Arrow array."""
    lists = pc.split_pattern(texts, separator)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), bounds - bounds[0]


def numbered(lists: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As ``distinct_parts``, for texts that have been cut already."""
    known: dict[str, int] = {}
    codes = np.array([known.setdefault(part, len(known)) for parts in lists for part in parts], np.int64)
    return list(known), codes, np.cumsum([0, *map(len, lists)])


def dealt(values: list[bytes], kind: str, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts' values, arrays of ``kind`` as bytes, in the order of ``codes``, and the new bounds of the texts."""
    flat = np.frombuffer(b"".join(values), kind)
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(kind).itemsize
    return gathered(flat, np.cumsum(sizes) - sizes, sizes, codes, bounds)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat``, told by their starts and sizes, in the order of ``codes``, and the new bounds of the texts."""
    own = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(own)])
    at = np.repeat(starts[codes] - ends[:-1], own) + np.arange(ends[-1])
    return flat[at], ends[bounds]


def by_kind(texts: list[str], plain: Callable[[str], bool]) -> tuple[list[int], list[int]]:
    """The places of texts for which ``plain`` holds, and of the others."""
    kinds = list(map(plain, texts))
    return [i for i, k in enumerate(kinds) if k], [i for i, k in enumerate(kinds) if not k]
