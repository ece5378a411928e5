"""Token counts: byte-pair merging with a heap and a linked list, without making identifiers.

The count of a word is the number of its bytes less the number of merges done on it.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from castline.llm.byte_pairs import Vocabulary, cut_words, load, parts_of
from castline.llm.common import Memo
from castline.llm.parts import slices

#: Distinct words that a Python worker keeps at most, in each of two generations.
MEMO = 250_000


def count_word(word: bytes, vocabulary: Vocabulary) -> int:
    """Tokens of one word: pop the lowest-ranked adjacent pair, the leftmost of equal ones, until none is left."""
    merges, symbols = vocabulary.merges, [vocabulary.single[b] for b in word]
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(found[0], i, a, b, found[1]) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (found := merges.get((a, b)))]
    heapq.heapify(heap)
    count = n
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two was merged meanwhile
        symbols[i], symbols[j] = made, -1
        count -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if found := merges.get((made, symbols[k])):
                heapq.heappush(heap, (found[0], i, made, symbols[k], found[1]))
        h = before[i]
        if h >= 0 and (found := merges.get((symbols[h], made))):
            heapq.heappush(heap, (found[0], h, symbols[h], made, found[1]))
    return count


@functools.lru_cache(maxsize=2)
def counter(path: str):
    """The texts -> counts function of a worker, with its memos."""
    vocabulary = load(path)
    words = Memo(lambda w: count_word(w.encode(), vocabulary), MEMO)
    parts = Memo(lambda p: 1 if p in vocabulary.special else sum(map(words.__getitem__, cut_words(p))), MEMO)

    def count(texts: list[str]) -> np.ndarray:
        totals = np.zeros(len(texts), np.int64)
        for at, distinct, codes, bounds in parts_of(texts, vocabulary):
            sums = np.concatenate([[0], np.cumsum(np.fromiter(map(parts.__getitem__, distinct), np.int64, len(distinct))[codes])])
            totals[at] = np.diff(sums[bounds])
        return totals

    return count


def count_tokens(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """For every row of ``documents`` (doc_id, text): n_bytes, n_tokens and whether n_tokens exceeds ``limit``.

    Null texts count as empty, with 0 bytes and tokens; null ids and repeated rows come back as
    they are; an empty table gives no rows; other columns are not read. A text of any length is
    read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for whole in batches:
            for batch in slices(whole, 1):
                texts = pc.fill_null(batch.column(1), "")
                tokens = count(texts.to_pylist())
                columns = [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
