"""Mixing recordings in blocks of time, so that an episode is many tasks' work.

Recordings are rows of blocks (``sources.media.sound_blocks``): path, part, data, each with the
same number of frames but for the last one. What is made of them is rows of blocks again. Samples
have 16 bits and saturate; channels lie side by side in a frame.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The least and the greatest sample, and its bytes.
LOW, HIGH, WIDTH = -32768, 32767, 2
#: Samples of a filter that are worked out side by side.
STEP = 64
#: Placements, by the order of their layers, that are laid together before they meet the others of their mix; a power of two.
CHUNK = 1024


def frames_of(milliseconds: Column, rate: Column) -> Column:
    """Whole frames of a time."""
    return F.floor(milliseconds * rate / 1000)


def amplified(samples: np.ndarray, decibels: float | None) -> np.ndarray:
    """Samples times a gain, cut down to whole numbers."""
    if not decibels:
        return samples
    return np.clip(np.floor(samples * 10.0 ** (decibels / 20)), LOW, HIGH).astype(np.int64)


def pieces(placements: DataFrame, frames: int) -> DataFrame:
    """Each placement (mix, layer, path, start, skip, length, period, gain) cut at the blocks of its recording and of the mix.

    Columns: mix, block, layer, at (frame in the block), path, part, from (frame in the part), n, gain.
    ``length`` frames sound from frame ``start`` of the mix on; they are those from ``skip`` of the
    recording on, over and over every ``period`` frames, if that is not null. What would lie before
    the mix is cut off. Further columns stay.
    """
    more = [c for c in placements.columns if c not in ("mix", "layer", "path", "start", "skip", "length", "period", "gain")]
    period = F.coalesce("period", "length")
    rounds = placements.where((F.col("length") > 0) & (period > 0)).withColumns({"period": period, "early": F.greatest(F.lit(0).cast("long"), -F.col("start"))})
    first = F.floor(F.col("early") / F.col("period"))
    last = F.floor((F.col("length") - 1) / F.col("period"))
    rounds = rounds.where(first <= last).withColumn("round", F.explode(F.sequence(first, last)))
    # Of each round the frames lo to hi of the sounding part.
    rounds = rounds.withColumns({"lo": F.greatest(F.col("round") * F.col("period"), F.col("early")), "hi": F.least((F.col("round") + 1) * F.col("period"), F.col("length"))}).where("lo < hi")
    rounds = rounds.withColumn("own", F.col("skip") + F.col("lo") - F.col("round") * F.col("period"))
    n = F.col("hi") - F.col("lo")
    parts = rounds.withColumn("part", F.explode(F.sequence(F.floor(F.col("own") / frames), F.floor((F.col("own") + n - 1) / frames))))
    low, high = F.greatest(F.col("own"), F.col("part") * frames), F.least(F.col("own") + n, (F.col("part") + 1) * frames)
    parts = parts.withColumns({"from": low - F.col("part") * frames, "n": high - low, "to": F.col("start") + F.col("lo") + low - F.col("own")})
    blocks = parts.withColumn("block", F.explode(F.sequence(F.floor(F.col("to") / frames), F.floor((F.col("to") + F.col("n") - 1) / frames))))
    begin, end = F.greatest(F.col("to"), F.col("block") * frames), F.least(F.col("to") + F.col("n"), (F.col("block") + 1) * frames)
    return blocks.select("mix", "block", "layer", (begin - F.col("block") * frames).alias("at"), "path", "part", (F.col("from") + begin - F.col("to")).alias("from"), (end - begin).alias("n"), "gain", *more)


def mixdown(mixes: DataFrame, placements: DataFrame, sounds: DataFrame, frames: int, channels: int = 1) -> DataFrame:
    """The blocks (mix, block, data) of ``mixes`` (mix, length in frames): its placements laid over each other, in the order of their layers.

    ``placements`` are those of ``pieces``; ``sounds`` has the recordings' blocks (path, part,
    data), of ``frames`` frames each. Each sum saturates before the next one is added. Frames
    beyond the end of a recording or of the mix are silent; so are recordings that are not there;
    a mix without placements is silence. Equal layers follow each other by their start.

    What layers make of a sample is x -> clip(x + a, low, high), and so is what follows of two such
    maps: ``CHUNK`` placements of a block become one map for each of its samples, and a task that
    holds a block of a mix has only these maps to apply, however many layers there are.
    """
    frame, mix_type = WIDTH * channels, mixes.schema["mix"].dataType.simpleString()
    wide = mixes.where("length > 0").select("mix", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / frames))).alias("block"), "length")
    size = F.least(F.lit(frames), F.col("length") - F.col("block") * frames)
    silence = wide.select("mix", "block", F.lit(None).cast("long").alias("chunk"), size.cast("long").alias("n"), F.lit(None).cast("binary").alias("maps"))
    columns = ["mix", "layer", "start", "path", "skip", "length", "period", "gain"]
    placed = placements.select(*columns).join(mixes.where("length > 0").select("mix"), "mix", "left_semi")
    # Rows are numbered in their order, so a chunk never holds more placements, whatever a mix has.
    ordered = placed.repartitionByRange("mix", "layer", "start").sortWithinPartitions(*columns)
    chunked = ordered.withColumn("chunk", F.floor(F.monotonically_increasing_id() / CHUNK))
    cut = F.expr(f"substring(data, CAST(from * {frame} + 1 AS INT), CAST(n * {frame} AS INT))")
    # Many pieces may be of one block of a recording, of which there is one row: that is what the join holds, pieces only pass by.
    laid = pieces(chunked, frames).join(sounds.select("path", "part", "data").hint("shuffle_hash"), ["path", "part"]).select(
        "mix", "block", "chunk", "layer", "at", F.col("gain").cast("double").alias("gain"), cut.alias("data")
    )

    def lay(batches):
        here, maps, kind = None, None, None

        def whole():
            return pa.RecordBatch.from_arrays([pa.array([here[0]], kind), pa.array([here[1]], pa.int64()), pa.array([here[2]], pa.int64()), pa.array([maps.tobytes()], pa.binary())], names=["mix", "block", "chunk", "maps"])

        for batch in batches:
            kind = batch.schema.field(0).type
            mixed, blocks, chunks, ats, gains, data = (batch.column(c) for c in range(6))
            # All samples of a batch are one array.
            sizes = np.asarray([0, *(pc.binary_length(data).to_numpy(zero_copy_only=False) // WIDTH)], np.int64).cumsum()
            heard = np.frombuffer(b"".join(data.to_pylist()), "<i2").astype(np.int64)
            for i, (*key, at, gain) in enumerate(zip(mixed.to_pylist(), blocks.to_pylist(), chunks.to_pylist(), ats.to_pylist(), gains.to_pylist())):
                if key != here:
                    if here is not None:
                        yield whole()
                    here, maps = key, np.repeat(np.array([[0], [LOW], [HIGH]], np.int64), frames * channels, axis=1)
                samples = amplified(heard[sizes[i] : sizes[i + 1]], gain)
                place = maps[:, at * channels : at * channels + len(samples)]
                place += samples
                np.clip(place[1:], LOW, HIGH, out=place[1:])
        if here is not None:
            yield whole()

    def add(batches):
        here, block, kind = None, None, None

        def whole():
            return pa.RecordBatch.from_arrays([pa.array([here[0]], kind), pa.array([here[1]], pa.int64()), pa.array([block.astype("<i2").tobytes()], pa.binary())], names=["mix", "block", "data"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for mix, number, n, maps in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if maps is None:
                    # The silence of a block comes first.
                    if here is not None:
                        yield whole()
                    here, block = (mix, number), np.zeros(n * channels, np.int64)
                elif here == (mix, number):
                    more, low, high = np.frombuffer(maps, np.int64).reshape(3, -1)[:, : len(block)]
                    block = np.clip(block + more, low, high)
        if here is not None:
            yield whole()

    sorted_pieces = laid.repartition("mix", "block", "chunk").sortWithinPartitions("mix", "block", "chunk", "layer", "at")
    maps = sorted_pieces.select("mix", "block", "chunk", "at", "gain", "data").mapInArrow(lay, f"mix {mix_type}, block long, chunk long, maps binary")
    rows = silence.unionByName(maps.withColumn("n", F.lit(None).cast("long"))).repartition("mix", "block").sortWithinPartitions("mix", "block", F.asc_nulls_first("chunk"))
    return rows.select("mix", "block", "n", "maps").mapInArrow(add, f"mix {mix_type}, block long, data binary")


def blocks_of(samples: DataFrame, frames: int) -> DataFrame:
    """The blocks (path, rate, part, data) of samples (path, rate, frame, sample) of one channel; each frame is there once, from 0 on."""
    numbered = samples.withColumn("part", F.floor(F.col("frame") / frames))
    ordered = F.array_sort(F.collect_list(F.struct("frame", "sample")))
    # The low byte of a sample comes first.
    digits = lambda x: F.lpad(F.hex(x["sample"].cast("long").bitwiseAND(F.lit(0xFFFF).cast("long"))), 4, "0")
    packed = F.unhex(F.array_join(F.transform(ordered, lambda x: F.concat(F.substring(digits(x), 3, 2), F.substring(digits(x), 1, 2))), ""))
    return numbered.groupBy("path", "part").agg(F.first("rate").alias("rate"), packed.alias("data")).select("path", "rate", "part", "data")


def samples_of(blocks: DataFrame, key: str, part: str, frames: int) -> DataFrame:
    """The samples (key, frame, sample) of blocks of one channel."""
    key_type = blocks.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_py(), "<i2").astype(np.int64)
                own = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(x), np.int64)))
                yield pa.RecordBatch.from_arrays([own, pa.array(batch.column(1)[i].as_py() * frames + np.arange(len(x))), pa.array(x)], names=[key, "frame", "sample"])

    return blocks.select(key, F.col(part).cast("long").alias("part"), "data").mapInArrow(run, f"{key} {key_type}, frame long, sample long")


def responses(x: np.ndarray, keep: float) -> np.ndarray:
    """y[i] = keep * y[i - 1] + x[i] from nothing on, for each row of x: ``STEP`` samples are one product with a triangle, then their ends are carried on."""
    rows, size = x.shape
    padded = np.zeros((rows, -(-size // STEP) * STEP))
    padded[:, :size] = x
    powers = keep ** np.arange(STEP + 1)
    triangle = np.tril(powers[np.abs(np.subtract.outer(np.arange(STEP), np.arange(STEP)))])
    y = padded.reshape(rows, -1, STEP) @ triangle.T
    carried = np.zeros(rows)
    for at in range(y.shape[1]):
        y[:, at] += carried[:, None] * powers[1:]
        carried = y[:, at, -1]
    return y.reshape(rows, -1)[:, :size]


def one_pole(sounds: DataFrame, cutoff: float, kind: str, channels: int = 1) -> DataFrame:
    """Blocks of recordings (path, rate, part, data) filtered by a pole: ``low`` or ``high`` pass with a cutoff in hertz.

    Each block maps the filter's state before it to the state after it, by a factor and an
    addend. The maps, a few numbers a block, are chained recording by recording; then all blocks
    are filtered apart, each from its own state. The first sample passes as it is. Results are cut
    to whole numbers towards zero; they equal those of one pass up to the rounding of doubles.
    """
    if kind not in ("low", "high"):
        raise ValueError("kind is low or high")

    def facts(rate: int) -> tuple[float, float]:
        rc, dt = 1.0 / (cutoff * 2.0 * np.pi), 1.0 / rate
        gain = dt / (rc + dt) if kind == "low" else rc / (rc + dt)
        return gain, 1.0 - gain if kind == "low" else gain

    def driven(x: np.ndarray, rate: int, before: np.ndarray) -> tuple[np.ndarray, float]:
        """What is added to the state at each sample, and the factor that keeps the state."""
        gain, keep = facts(rate)
        return gain * (x if kind == "low" else np.diff(x, axis=1, prepend=before[:, None])), keep

    def samples(data: bytes) -> np.ndarray:
        return np.frombuffer(data, "<i2").astype(np.float64).reshape(-1, channels).T

    def maps(batches):
        for batch in batches:
            rows = []
            for path, rate, part, data in zip(*(batch.column(c).to_pylist() for c in range(4))):
                x = samples(data)
                u, keep = driven(x, rate, np.zeros(channels))
                rows.append((path, part, keep, keep ** x.shape[1], responses(u, keep)[:, -1].tolist(), x[:, 0].tolist(), x[:, -1].tolist()))
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), *[pa.list_(pa.float64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=["path", "part", "keep", "factor", "addend", "head", "tail"])

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        state, before, rows = None, None, []
        for row in frame.sort_values("part").itertuples():
            if state is None:
                # A state that makes the first sample come out as it is, as if the sound had always been there.
                state = np.asarray(row.head) if kind == "low" else np.asarray(row.head) / row.keep
                before = np.asarray(row.head)
            rows.append((row.path, row.part, state, before))
            late = 0.0 if kind == "low" else row.factor * before
            state, before = row.factor * state + np.asarray(row.addend) - late, np.asarray(row.tail)
        return pd.DataFrame(rows, columns=["path", "part", "state", "before"])

    def run(batches):
        for batch in batches:
            found = []
            for rate, data, state, before in zip(*(batch.column(c).to_pylist() for c in range(2, 6))):
                x = samples(data)
                u, keep = driven(x, rate, np.asarray(before))
                y = responses(u, keep) + np.outer(state, keep ** np.arange(1, x.shape[1] + 1))
                found.append(np.trunc(np.clip(y, LOW, HIGH)).astype("<i2").T.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.binary())], names=["path", "part", "rate", "data"])

    rows = sounds.where("octet_length(data) > 0").select("path", F.col("rate").cast("long").alias("rate"), F.col("part").cast("long").alias("part"), "data")
    small = rows.mapInArrow(maps, "path string, part long, keep double, factor double, addend array<double>, head array<double>, tail array<double>")
    states = small.groupBy("path").applyInPandas(chain, "path string, part long, state array<double>, before array<double>")
    return rows.join(states, ["path", "part"]).select("path", "part", "rate", "data", "state", "before").mapInArrow(run, "path string, part long, rate long, data binary")
