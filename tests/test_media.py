import math
import struct
import wave
import zipfile

import numpy as np
import pytest

from castline.sources import digests, media
from castline.sources.ranged import BLOCK, KBPS, file_facts


def frame(kbps_code=9, pad=0, mono=False):
    """An empty MPEG 1 layer III frame of 44.1 kHz; code 9 is 128 kbps, 417 bytes."""
    head = bytes([0xFF, 0xFB, kbps_code << 4 | pad << 1, 0xC0 if mono else 0x00])
    size = 144 * 1000 * KBPS[1][kbps_code - 1] // 44100 + pad
    return head + b"\0" * (size - 4)


def tag(size, fill=b"\xff"):
    return b"ID3\x04\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + fill * size


def by_name(rows):
    return {r.path.rsplit("/", 1)[1]: r for r in rows}


def test_mp3_headers(spark, tmp_path):
    constant = frame() * 100
    first = bytearray(frame())
    first[36:52] = b"Info" + (3).to_bytes(4) + (1000).to_bytes(4) + (500_000).to_bytes(4)
    vbri = bytearray(frame())
    vbri[36:54] = b"VBRI" + b"\0" * 6 + (700_000).to_bytes(4) + (2000).to_bytes(4)
    (tmp_path / "show").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a.mp3").write_bytes(constant)
    (tmp_path / "show" / "b.MP3").write_bytes(tag(128) + bytes(first) + frame() * 3)
    (tmp_path / "show" / "c.mp3").write_bytes(b"nothing here")
    (tmp_path / "e.mp3").write_bytes(tag(2 << 20) + tag(50) + bytes(vbri) + frame() * 3)
    (tmp_path / "f.mp3").write_bytes(b"")
    (tmp_path / "g.mp3").write_bytes(b"\0" * 5000 + constant + b"\0" * (30 << 20))
    (tmp_path / ".hidden" / "h.mp3").write_bytes(constant)
    (tmp_path / "d.wav").write_bytes(b"x")
    got = {r.filename: r for r in media.sound_library(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.mp3", "b.MP3", "c.mp3", "e.mp3", "f.mp3", "g.mp3"}
    assert (got["a.mp3"].show, got["a.mp3"].seconds, got["a.mp3"].kbps) == ("", round(8 * len(constant) / 128_000, 1), 128)
    assert (got["b.MP3"].show, got["b.MP3"].seconds, got["b.MP3"].kbps) == ("show", round(1000 * 1152 / 44100, 1), round(8 * 500_000 * 44100 / 1152 / 1000) // 1000)
    assert (got["e.mp3"].seconds, got["e.mp3"].error) == (round(2000 * 1152 / 44100, 1), None)
    for name in ("c.mp3", "f.mp3"):
        assert (got[name].seconds, got[name].kbps) == (None, None) and "no frame" in got[name].error
    facts = by_name(file_facts(spark, str(tmp_path), "mp3").collect())
    # A picture of two megabytes and thirty of sound are passed over.
    assert all(facts[name].bytes_read <= 3 * BLOCK for name in ("a.mp3", "e.mp3", "g.mp3"))
    with pytest.raises(Exception, match="kind is one of"):
        file_facts(spark, str(tmp_path), "flac").count()


def riff(data, rate=8000, channels=1, width=2, kind=1, before=b""):
    head = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * width, channels * width, 8 * width)
    body = b"WAVE" + before + b"fmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav_headers_and_archives(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as file:
        file.setparams((2, 2, 8000, 0, "NONE", ""))
        file.writeframes(b"\1\2\3\4" * 8000)
    (tmp_path / "b.wav").write_bytes(b"no sound")
    (tmp_path / "c.wav").write_bytes(riff(b"\0" * 900, width=3, before=b"LIST" + struct.pack("<I", 5) + b"abcde\0"))
    (tmp_path / "d.wav").write_bytes(riff(b"\0" * 64, kind=3, width=4))
    (tmp_path / "e.wav").write_bytes(riff(b"\0" * (20 << 20)))
    (tmp_path / "f.wav").write_bytes(riff(b"\0" * 64)[:30])
    got = by_name(file_facts(spark, str(tmp_path), "wav").collect())
    assert (got["a.wav"].rate, got["a.wav"].channels, got["a.wav"].width, got["a.wav"].frames, got["a.wav"].seconds, got["a.wav"].data_at) == (8000, 2, 2, 8000, 1.0, 44)
    assert (got["c.wav"].width, got["c.wav"].frames, got["e.wav"].bytes_read) == (3, 300, BLOCK)
    assert all(got[name].error and got[name].frames is None for name in ("b.wav", "d.wav", "f.wav"))
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as archive:
        archive.writestr("007_a.mp3", b"xyz")
        archive.writestr("big", b"\0" * (5 << 20))
    (tmp_path / "t.zip").write_bytes(b"PK is no archive")
    members = [(r.path.rsplit("/", 1)[1], r.member, r.size, r.error is None) for r in media.archive_members(spark, str(tmp_path)).collect()]
    assert sorted(members, key=str) == [("s.zip", "007_a.mp3", 3, True), ("s.zip", "big", 5 << 20, True), ("t.zip", None, None, False)]
    assert max(r.bytes_read for r in file_facts(spark, str(tmp_path), "zip").collect()) <= 10 * BLOCK
    (tmp_path / "none").mkdir()
    assert file_facts(spark, str(tmp_path / "none"), "wav").count() == 0


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_levels_of_all_widths(spark, tmp_path, width):
    rng = np.random.default_rng(width)
    rate, top = 11025, 1 << (8 * width - 1)
    loud = rng.integers(-top, top, 3 * rate)
    loud[rate : 2 * rate] //= 50
    loud[2 * rate :] = 0
    raw = (loud + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(x).to_bytes(width, "little", signed=True) for x in loud)
    (tmp_path / "a.wav").write_bytes(riff(raw, rate=rate, width=width))
    (tmp_path / "s.wav").write_bytes(riff((b"\x80" if width == 1 else b"\0" * width) * 100, rate=rate, width=width))
    got = by_name(media.loudness_profiles(spark, str(tmp_path)).collect())
    x, full = (loud * 256, 1 << 31) if width == 3 else (loud, top)
    db = lambda part: 20 * math.log10(r / full) if (r := int(math.sqrt(sum(int(v) ** 2 for v in part) / len(part)))) else -math.inf
    starts = [k * 500 * rate // 1000 for k in range(7)]
    levels = [db(x[a:b]) for a, b in zip(starts, starts[1:])]
    r = got["a.wav"]
    assert (r.peak, abs(r.peak_db - 20 * math.log10(r.peak / full)) < 1e-9) == (int(np.abs(x).max()), True)
    assert abs(r.mean_db - db(x)) < 1e-9 and abs(r.quietest_db - min(v for v in levels if v > -96)) < 1e-9
    assert (got["s.wav"].rms, got["s.wav"].mean_db, got["s.wav"].quietest_db) == (0, -math.inf, -math.inf)
    blocks = media.sound_blocks(spark, str(tmp_path), frames=1000).where("path like '%a.wav'").orderBy("part").collect()
    assert b"".join(bytes(b.data) for b in blocks) == raw and len(blocks) == math.ceil(len(loud) / 1000)


def test_digests_are_kept(spark, tmp_path):
    import hashlib
    import os

    sounds, kept = tmp_path / "sounds", str(tmp_path / "kept")
    (sounds / "sub").mkdir(parents=True)
    for i in range(1000):
        (sounds / ("sub" if i % 2 else ".") / f"{i}.mp3").write_bytes(b"%d" % (i // 2))
    first = digests.refresh_digests(spark, str(sounds), kept, "*.mp3")
    assert (first.opened, first.unchanged, first.gone) == (1000, 0, 0)
    want = {str(i): hashlib.sha256(b"%d" % (i // 2)).hexdigest() for i in range(1000)}
    told = lambda found: {r.path.rsplit("/", 1)[1].removesuffix(".mp3"): r.sha256 for r in found.digests.collect()}
    assert told(first) == want
    assert digests.same_content(first.digests).count() == 500
    again = digests.refresh_digests(spark, str(sounds), kept, "*.mp3")
    assert (again.opened, again.unchanged, again.gone) == (0, 1000, 0) and len(digests.versions(spark, kept)) == 1
    (sounds / "4.mp3").write_bytes(b"changed")
    os.utime(sounds / "6.mp3", (1, 1))
    (sounds / "8.mp3").unlink()
    third = digests.refresh_digests(spark, str(sounds), kept, "*.mp3")
    assert (third.opened, third.unchanged, third.gone) == (2, 997, 1)
    want["4"] = hashlib.sha256(b"changed").hexdigest()
    del want["8"]
    assert told(third) == want
    # A version that is not whole does not count; the next run goes on from the one before.
    half = tmp_path / "kept" / "v999999999-half"
    half.mkdir()
    assert told(third) == {r.path.rsplit("/", 1)[1].removesuffix(".mp3"): r.sha256 for r in digests.kept_digests(spark, kept).collect()}
    for i in range(3):
        (sounds / f"new{i}.mp3").write_bytes(b"n")
        assert digests.refresh_digests(spark, str(sounds), kept, "*.mp3").opened == 1
    assert len(digests.versions(spark, kept)) == 2
    empty = digests.refresh_digests(spark, str(sounds), str(tmp_path / "other"), "*.ogg")
    assert (empty.opened, empty.digests.count(), len(digests.versions(spark, str(tmp_path / "other")))) == (0, 0, 1)
