"""Facts from the headers of files: a data source that seeks, so what it reads does not grow with the files.

``spark.read.format("file_facts").option("kind", "mp3").load(path)`` gives one row for each MP3
file below a path (``wav``, ``zip``: likewise; a ZIP file gives a row for each member). Files are
listed once; tasks take some of them each, open them and read only the parts that they need: what
follows an MP3's tag, however large the picture in it is, a WAV file's chunks up to its samples, a
ZIP file's directory at its end. What cannot be read is a row with an error.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Kilobits a second and samples a second by the codes in an MPEG frame's header, for version 1 and for versions 2 and 2.5, layer III.
KBPS = {1: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Fixed value: how far behind its tags an MP3 file's first frame may begin.
REACH = 1 << 20
#: Bytes that are read at once, and files of one task.
BLOCK, FILES = 8 << 10, 64

KINDS = {
    "mp3": ("path string, size long, seconds double, kbps long, rate long, bytes_read long, error string", ".mp3"),
    "wav": ("path string, size long, rate long, channels long, width long, frames long, seconds double, data_at long, bytes_read long, error string", ".wav"),
    "zip": ("path string, size long, member string, member_size long, crc long, bytes_read long, error string", ".zip"),
}


class Blocks(io.RawIOBase):
    """An open file that is read block by block; blocks are kept and their bytes counted."""

    def __init__(self, file, size: int):
        self.file, self.size, self.place, self.count = file, size, 0, 0
        self.kept: dict[int, bytes] = {}

    def at(self, start: int, n: int) -> bytes:
        """The bytes from a place on, fewer at the end of the file."""
        n = max(0, min(n, self.size - start))
        if not n:
            return b""
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        for number in range(first, last + 1):
            if number not in self.kept:
                self.file.seek(number * BLOCK)
                self.kept[number] = self.file.read(BLOCK)
                self.count += len(self.kept[number])
        return b"".join(self.kept[number] for number in range(first, last + 1))[start - first * BLOCK :][:n]

    def forget(self, before: int) -> None:
        """Let go of the blocks that end before a place."""
        for number in [k for k in self.kept if (k + 1) * BLOCK <= before]:
            del self.kept[number]

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.place = offset + (0, self.place, self.size)[whence]
        if self.place < 0:
            raise OSError("before the beginning of the file")
        return self.place

    def tell(self) -> int:
        return self.place

    def read(self, n: int = -1) -> bytes:
        found = self.at(self.place, self.size - self.place if n is None or n < 0 else n)
        self.place += len(found)
        return found


def mp3_frame(head: bytes) -> tuple[int, int, int, int, int] | None:
    """Bytes, bits a second, samples a second, samples, and how far behind its begin the table of contents of a frame with this header is; None if it is none."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE6 != 0xE2:
        return None
    version, code, rate_code, pad = head[1] >> 3 & 3, head[2] >> 4, head[2] >> 2 & 3, head[2] >> 1 & 1
    if version == 1 or rate_code == 3 or not 0 < code < 15:
        return None
    first, mono = version == 3, head[3] >> 6 == 3
    kbps, rate = KBPS[1 if first else 2][code - 1], RATES[version][rate_code]
    samples = 1152 if first else 576
    beyond = 4 + ((17 if mono else 32) if first else (9 if mono else 17))
    return samples // 8 * 1000 * kbps // rate + pad, 1000 * kbps, rate, samples, beyond


def behind_tags(file: Blocks) -> int:
    """The place behind the tags at the beginning of a file."""
    start = 0
    while (head := file.at(start, 10))[:3] == b"ID3" and len(head) == 10:
        start += 10 + (head[6] << 21 | head[7] << 14 | head[8] << 7 | head[9]) + (10 if head[5] & 0x10 else 0)
    return start


def mp3_length(file: Blocks) -> tuple[float, int, int]:
    """Seconds, bits a second and samples a second of an MP3 file, from its first frames: by their table of contents, or else by the size of the file."""
    start = behind_tags(file)
    stop = min(file.size - 3, start + REACH)
    while start < stop:
        block = file.at(start, BLOCK)
        at = start + block.find(b"\xff") if b"\xff" in block else -1
        if at < 0 or at >= stop:
            start += len(block)
            file.forget(start)
            continue
        start = at + 1
        frame = mp3_frame(file.at(at, 4))
        # Two frames have to follow each other, unless the first one ends the file.
        if frame is None or (mp3_frame(file.at(at + frame[0], 4)) is None and at + frame[0] != file.size):
            continue
        _, bits, rate, samples, beyond = frame
        frames = total = 0
        table = file.at(at + beyond, 16)
        if table[:4] in (b"Xing", b"Info"):
            flags, after = int.from_bytes(table[4:8]), 8
            if flags & 1:
                frames, after = int.from_bytes(table[8:12]), 12
            total = int.from_bytes(table[after : after + 4]) if flags & 2 else 0
        elif (table := file.at(at + 36, 18))[:4] == b"VBRI":
            total, frames = int.from_bytes(table[10:14]), int.from_bytes(table[14:18])
        if frames:
            seconds = frames * samples / rate
            return seconds, round(8 * total / seconds) if total else bits, rate
        return 8 * (file.size - at) / bits, bits, rate
    raise ValueError("no frame")


def mp3_rows(file: Blocks) -> list[tuple]:
    seconds, bits, rate = mp3_length(file)
    return [(seconds, bits // 1000, rate)]


def wav_rows(file: Blocks) -> list[tuple]:
    """Of whole numbers as samples, in one to four bytes each; other chunks than those of the format and the samples are passed over."""
    if file.at(0, 4) != b"RIFF" or file.at(8, 4) != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    at, known = 12, None
    while len(head := file.at(at, 8)) == 8:
        size, at = int.from_bytes(head[4:], "little"), at + 8
        if head[:4] == b"fmt ":
            kind, channels, rate, _, frame, bits = struct.unpack("<HHIIHH", file.at(at, 16))
            if kind == 0xFFFE:
                kind = int.from_bytes(file.at(at + 24, 2), "little")
            width = (bits + 7) // 8
            if kind != 1 or not 1 <= width <= 4 or not channels or not rate or frame != channels * width:
                raise ValueError(f"samples of kind {kind} in {bits} bits")
            known = rate, channels, width
        elif head[:4] == b"data":
            if known is None:
                raise ValueError("samples before their format")
            rate, channels, width = known
            frames = min(size, file.size - at) // (channels * width)
            return [(rate, channels, width, frames, frames / rate, at)]
        at += size + size % 2
    raise ValueError("no samples")


def zip_rows(file: Blocks) -> list[tuple]:
    with zipfile.ZipFile(file) as archive:
        return [(m.filename, m.file_size, m.CRC) for m in archive.infolist() if not m.is_dir()]


ROWS = {"mp3": mp3_rows, "wav": wav_rows, "zip": zip_rows}


@dataclass
class Some(InputPartition):
    """Files of one task: paths and sizes."""

    files: list[tuple[str, int]]


class HeaderReader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self) -> list[Some]:
        """The files below the path, but for hidden ones, ``FILES`` for each task; the largest ones are spread."""
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else fs.FileSystem.from_uri("file://" + self.path.removeprefix("file:"))
        inside = lambda p: p[len(root.rstrip("/")) :].split("/")
        found = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.path.lower().endswith(KINDS[self.kind][1])]
        listed = sorted((-i.size, i.path) for i in found if not any(part[:1] in ("_", ".") for part in inside(i.path)))
        tasks = -(-len(listed) // FILES)
        return [Some([(path, -size) for size, path in listed[n::tasks]]) for n in range(tasks)] or [Some([])]

    def read(self, partition: Some) -> Iterator[tuple]:
        scheme = self.path.split("://")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else "file:"
        system = fs.FileSystem.from_uri(self.path if scheme != "file:" else "file:///")[0]
        blank = (None,) * (len(KINDS[self.kind][0].split(",")) - 4)
        for path, size in partition.files:
            count = 0
            try:
                with system.open_input_file(path) as opened:
                    file = Blocks(opened, size)
                    try:
                        rows, error = ROWS[self.kind](file), None
                    except (ValueError, EOFError, struct.error, zipfile.BadZipFile, OSError, NotImplementedError, ZeroDivisionError) as broken:
                        rows, error = [blank], f"{type(broken).__name__}: {broken}"
                    count = file.count
            except OSError as gone:
                rows, error = [blank], f"{type(gone).__name__}: {gone}"
            for row in rows:
                yield (scheme + path, size, *row, count, error)


class HeaderSource(DataSource):
    """The format ``file_facts``; option ``kind``: mp3, wav or zip."""

    @classmethod
    def name(cls) -> str:
        return "file_facts"

    @property
    def kind(self) -> str:
        kind = self.options.get("kind", "mp3")
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        return kind

    def schema(self) -> str:
        return KINDS[self.kind][0]

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options["path"], self.kind)


def file_facts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row for each file (each member of a ZIP file) below a path, read from headers alone; ``bytes_read`` tells how much that was.

    Files are found whatever the case of their ending; hidden files and folders are left out. An
    empty folder gives no rows.
    """
    spark.dataSource.register(HeaderSource)
    return spark.read.format("file_facts").option("kind", kind).load(path)
