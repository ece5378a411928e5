"""Language identification by a string kernel.

Two texts are compared by the byte n-grams that both have (blended spectrum: one to three
bytes, presence only, normalised to a cosine). A few training texts serve as Nyström landmarks;
kernel ridge regression, one language versus the rest, is fitted in the space they span.
Batches of texts are scored by matrix products with the landmarks and the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castline.llm.common import forget_others, stored

#: Presence features: n-grams are hashed to so many places.
PLACES = 8192
#: Bounds of the training sample: rows of each language, rows in all where languages are many, and landmarks (one of each language at least).
TRAIN_PER_LANG, TRAIN_ROWS, LANDMARKS = 800, 160_000, 128
#: Rows of each language below which the bound of all rows does not press it, so that chance leaves none out.
LEAST_PER_LANG = 20
#: Training rows that are unpacked together, and groups whose sums are made apart.
TOGETHER, SLOTS = 256, 16
RIDGE = 1e-3
#: Texts whose presence rows are made at once, and scored in one matrix product.
BATCH = 256

has_letter = re.compile(r"[^\W\d_]").search


def presence(texts: list[str]) -> np.ndarray:
    """One row of 0 and 1 for each text: which hashed n-grams it has."""
    rows = np.zeros((len(texts), PLACES), np.float32)
    for row, text in zip(rows, texts):
        b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
        row[b] = 1
        if len(b) > 1:
            two = b[:-1] << 8 | b[1:]
            row[two * np.uint32(2654435761) >> 19] = 1
            three = two[:-1] << 8 | b[2:]
            row[three * np.uint32(2246822519) >> 19] = 1
    return rows


@dataclass(frozen=True)
class Model:
    """``landmarks``: unit presence rows; ``weights``: landmark kernels -> one score for each language."""

    langs: list[str]
    landmarks: np.ndarray
    weights: np.ndarray


def remainder(doc_id: Column) -> Column:
    """The crc32 of the id as text, modulo 4: texts at 2 are held out."""
    return F.crc32(doc_id.cast("string")) % 4


def training_rows(documents: DataFrame) -> DataFrame | None:
    """(lang, id, nth, bits) for the training sample: packed presence rows, numbered within each language; None without labels.

    At most ``TRAIN_PER_LANG`` texts of each language are taken, fewer where that would be over
    ``TRAIN_ROWS`` in all, by the hash of their ids, so the same rows come again on every run.
    """
    labelled = documents.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id")) != 2))
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return None
    spread = 1 << 30
    per_lang = max(LEAST_PER_LANG, min(TRAIN_PER_LANG, TRAIN_ROWS // len(counts)))
    # A share of the hashes leaves little more than is wanted, so few rows are ranked.
    shares = documents.sparkSession.createDataFrame([(lang, int(spread * min(1.0, 1.2 * per_lang / n + 64 / n))) for lang, n in counts], "lang string, share long")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(spread))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text"))
    sample = labelled.withColumn("draw", draw).join(F.broadcast(shares), "lang").where("draw < share").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_lang)

    return stored(sample.select("lang", F.col("doc_id").cast("string").alias("id"), "nth", "text").mapInArrow(packed_rows, "lang string, id string, nth int, bits binary"), "training")


def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, id, nth, bits) for (lang, id, nth, text), as many texts at once as are scored at once."""
    forget_others()
    for whole in batches:
        for start in range(0, whole.num_rows, BATCH):
            batch = whole.slice(start, BATCH)
            rows = np.packbits(presence(batch.column(3).to_pylist()).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "id", "nth", "bits"])


def unit(bits: list[bytes]) -> np.ndarray:
    """Presence rows of length one."""
    x = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for b in bits]), axis=1).astype(np.float64)
    return x / np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)


def fit(documents: DataFrame) -> Model | None:
    """Learn from labelled rows that are not held out; all languages are learned.

    The tasks make presence rows and sum the normal equations; only the landmarks, one kilobyte
    each, and the sums of ``SLOTS`` groups reach the driver. Without labelled rows the result is None.
    """
    rows = training_rows(documents)
    if rows is None:
        return None
    sizes = {lang: n for lang, n in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    number = {lang: i for i, lang in enumerate(langs)}
    total = sum(sizes.values())
    weight = np.array([np.sqrt(total / (len(langs) * sizes[lang])) for lang in langs])
    picked = rows.where(F.col("nth") <= max(1, LANDMARKS // len(langs))).select("lang", "nth", "bits").collect()
    landmarks = unit([r["bits"] for r in sorted(picked, key=lambda r: (r["lang"], r["nth"]))])
    values, vectors = np.linalg.eigh(landmarks @ landmarks.T)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # maps landmark kernels into the Nyström space

    def sums(batches):
        forget_others()
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                at = np.array([number[lang] for lang in batch.column(1).to_pylist()])
                y = np.where(np.arange(len(langs)) == at[:, None], 1.0, -1.0) * weight[at][:, None]
                z = np.hstack([unit(batch.column(2).to_pylist()) @ landmarks.T @ root, np.ones((len(at), 1))]) * weight[at][:, None]
                slots = batch.column(0).to_numpy()
                for slot in np.unique(slots).tolist():
                    own = slots == slot
                    left, right = held.get(slot, (0.0, 0.0))
                    held[slot] = left + z[own].T @ z[own], right + z[own].T @ y[own]
        if held:
            flat = [pa.array([x.ravel() for x in side], pa.list_(pa.float64())) for side in zip(*held.values())]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), *flat], names=["slot", "left", "right"])

    slotted = rows.select(F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int").alias("slot"), "lang", "bits", "nth").repartition(SLOTS, "slot").sortWithinPartitions("slot", "lang", "nth").drop("nth")
    width = root.shape[1] + 1
    left, right = np.zeros((width, width)), np.zeros((width, len(langs)))
    for _, own_left, own_right in sorted(slotted.mapInArrow(sums, "slot int, left array<double>, right array<double>").collect()):
        left += np.reshape(own_left, left.shape)
        right += np.reshape(own_right, right.shape)
    inner = np.linalg.solve(left + RIDGE * total * np.diag([*[1.0] * (width - 1), 0.0]), right)
    # The bias becomes one more landmark kernel of value 1.
    return Model(langs, landmarks.astype(np.float32), np.vstack([root @ inner[:-1], inner[-1:]]).astype(np.float32))


def identify(documents: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For every row of ``documents`` (doc_id, text): lang_pred and score, beside the columns to ``keep``.

    The documents' own language plays no part in it.

    ``und`` with score 0 stands for null texts and texts without a letter (so for empty ones), and
    for all texts if nothing was learned. Equal texts get equal results; null ids and repeated rows
    come back as they are; an empty table gives no rows. A text of any length is read whole.
    Columns named like the two new ones can't be kept. The score is the winning language's share of the clipped votes, from 0 to 1.
    """

    def run(batches):
        forget_others()
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
                named, sure = ["und"] * len(texts), [0.0] * len(texts)
                at = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
                if at:
                    votes = vote(model, [texts[i] for i in at])
                    for i, row in zip(at, votes):
                        best = int(row.argmax())
                        named[i], sure[i] = model.langs[best], float(row[best])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(named, pa.string()), pa.array(sure, pa.float64())], names=[*keep, "lang_pred", "score"])

    if {"lang_pred", "score"} & set(keep):
        raise ValueError("lang_pred and score are made here")
    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in keep)
    rows = documents.select(*keep, F.col("text").alias("_scored"))
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def lettered(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose text has a letter."""
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([bool(has_letter(t or "")) for t in batch.column(at).to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def vote(model: Model, texts: list[str]) -> np.ndarray:
    rows = presence(texts)
    norms = np.sqrt(rows.sum(axis=1, keepdims=True))
    kernel = np.hstack([(rows @ model.landmarks.T) / np.maximum(norms, 1), np.ones((len(texts), 1), np.float32)])
    votes = np.clip((kernel @ model.weights + 1) / 2, 1e-6, 1)
    return votes / votes.sum(axis=1, keepdims=True)
