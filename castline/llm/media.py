"""Audio features of stored media: resampling, log-mel frames and segments of sound.

Payloads are kept losslessly as 8-bit mono WAV. What is read back goes through a polyphase
filter, overlapped log-mel filterbanks and a segmentation of frame energies with two
thresholds; the frames are stored as Arrow tensors of one fixed shape with their time spans.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Payloads are filled with spaces up to a positive multiple of this.
UNIT = 192
#: Stored rate, and the rate after resampling by UP / DOWN.
RATE, UP, DOWN = 16_000, 3, 4
#: Taps of each phase of the resampling filter: a multiple of DOWN.
TAPS = 16
FRAME, HOP, MELS = 256, 128, 24
#: Frames in one tensor; the last of a text is filled with silence.
SPAN = 32
SILENCE = np.float32(np.log(1e-6))
#: A segment starts above the median energy plus the first figure and ends below the median plus the second, in nepers.
START, END = 0.10, 0.02


def fill(text: str | None) -> tuple[bytes, int]:
    """The payload of a text, and its length before it was filled."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def store(payload: bytes) -> bytes:
    """The payload as 8-bit samples in a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def polyphase_filter() -> np.ndarray:
    """A windowed sinc of TAPS * UP values, as one column of TAPS values for each phase."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    phases = np.zeros((TAPS + DOWN, UP))
    for phase in range(UP):
        # Output m of a block stands at input position m * DOWN / UP.
        skip, offset = divmod(phase * DOWN, UP)
        taps = h[offset::UP][::-1]
        phases[skip : skip + TAPS, phase] = taps / taps.sum()
    return phases.astype(np.float32)


def mel_bank() -> np.ndarray:
    """Triangles that are evenly spaced in mel, for the bins of a frame's spectrum."""
    rate, bins = RATE * UP / DOWN, FRAME // 2 + 1
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1) / (rate / 2) * (bins - 1)
    at = np.arange(bins)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((at - low) / (mid - low), (high - at) / (high - mid))).astype(np.float32)


PHASES, BANK, WINDOW = polyphase_filter(), mel_bank(), np.hanning(FRAME).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """UP samples for each DOWN: one product of overlapping input blocks with the phases."""
    blocks = len(samples) // DOWN
    around = np.concatenate([np.zeros(TAPS // 2, np.float32), samples, np.zeros(TAPS, np.float32)])
    wide = np.lib.stride_tricks.as_strided(around, (blocks, TAPS + DOWN), (around.itemsize * DOWN, around.itemsize))
    return (np.ascontiguousarray(wide) @ PHASES).ravel()


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Log-mel values of frames that overlap by half; at least one frame."""
    frames = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    around = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    around[: len(samples)] = samples[: len(around)]
    wide = np.lib.stride_tricks.as_strided(around, (frames, FRAME), (around.itemsize * HOP, around.itemsize))
    power = np.abs(np.fft.rfft(wide * WINDOW, axis=1)).astype(np.float32) ** 2
    return np.log(power @ BANK + np.float32(1e-6))


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that start above the higher threshold and last until below the lower one."""
    middle = np.median(energy)
    mark = np.where(energy > middle + START, 1, np.where(energy < middle + END, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], -1) == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def features(payload: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel frames of a payload and its segments, in frames."""
    samples = np.frombuffer(payload, np.uint8).astype(np.float32) / 128 - 1
    mel = log_mel(resample(samples))
    return mel, segments(mel.mean(axis=1))


def seconds(frame: int) -> float:
    return frame * HOP * DOWN / UP / RATE


def tensors(mel: np.ndarray) -> np.ndarray:
    """The frames in pieces of SPAN; the last is filled with silence."""
    out = np.full((-(-len(mel) // SPAN) * SPAN, MELS), SILENCE, np.float32)
    out[: len(mel)] = mel
    return out.reshape(-1, SPAN, MELS)


KIND = pa.fixed_shape_tensor(pa.float32(), (SPAN, MELS))
STORED = pa.schema([("start", pa.float64()), ("end", pa.float64()), ("mel", KIND)])


def store_tensors(mel: np.ndarray) -> bytes:
    """The frames as an Arrow stream of fixed-shape tensors, each with its start and end in seconds."""
    held = tensors(mel)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(held.ravel(), pa.float32()), SPAN * MELS)
    starts = [seconds(i * SPAN) for i in range(len(held))]
    batch = pa.RecordBatch.from_arrays([pa.array(starts), pa.array([*starts[1:], seconds(len(mel))]), pa.ExtensionArray.from_storage(KIND, storage)], schema=STORED)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, STORED) as file:
        file.write_batch(batch)
    return out.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The tensors of an Arrow stream, as one array, and their (start, end)."""
    held = pa.ipc.open_stream(stored).read_all().combine_chunks()
    return held.column("mel").chunk(0).to_numpy_ndarray(), np.column_stack([held.column("start"), held.column("end")])


#: Texts whose files are held together.
TOGETHER = 64


def media_rows(documents: DataFrame) -> DataFrame:
    """For every row of ``documents`` (doc_id, text) its media file, its tensors and its segments.

    Columns: doc_id, media (a WAV file), n_bytes, tensors (an Arrow stream of start, end and a
    fixed-shape tensor of SPAN x MELS), segments (start and end in seconds). Null texts count as
    empty and become one unit of spaces; null ids and repeated rows come back as they are; an empty
    table gives no rows; other columns are not read; texts of any length are stored whole, in a
    batch that holds few of them.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.float64()), ("end", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                media, sizes, held, spans = [], [], [], []
                for text in batch.column(1).to_pylist():
                    payload, n = fill(text)
                    media.append(store(payload))
                    sizes.append(n)
                    mel, found = features(read_back(media[-1]))
                    held.append(store_tensors(mel))
                    spans.append([{"start": seconds(a), "end": seconds(b)} for a, b in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(media, pa.binary()), pa.array(sizes, pa.int64()), pa.array(held, pa.binary()), pa.array(spans, pa.list_(span))],
                    names=["doc_id", "media", "n_bytes", "tensors", "segments"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, media binary, n_bytes long, tensors binary, segments array<struct<start: double, end: double>>")


def media_digests(rows: DataFrame) -> DataFrame:
    """The rows of ``media_rows`` with what is read back from their files and tensors reduced to sizes and digests.

    ``feature`` names the numbers of frames, tensors and segments, the mean log-mel value, and a
    digest of the rounded tensors, their spans and the segments. Repeated rows come back as they
    are; no rows give none.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def digest(media: bytes, stored: bytes, segments: list[dict]) -> tuple:
        read = read_back(media)
        held, spans = read_tensors(stored)
        frames = round(spans[-1, 1] / seconds(1))
        told = np.round(held * 64).astype(np.int32).tobytes() + spans.tobytes() + repr([(s["start"], s["end"]) for s in segments]).encode()
        mean = float(held.reshape(-1, MELS)[:frames].mean())
        feature = f"frames={frames};tensors={len(held)}x{SPAN}x{MELS};segments={len(segments)};mean={mean:.3f};mark={hashlib.sha256(told).hexdigest()[:16]}"
        return len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [digest(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("media", "tensors", "segments")))]
            columns = [pa.array([r[i] for r in own], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
