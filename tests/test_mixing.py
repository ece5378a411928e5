import math

import numpy as np
import pytest

from castline.operators import mixing


def stored(spark, sounds, frames, channels=1, rate=8000):
    rows = []
    for path, x in sounds.items():
        step = frames * channels
        rows += [(path, rate, part, bytes(x[at : at + step].astype("<i2").tobytes())) for part, at in enumerate(range(0, len(x), step))]
    return spark.createDataFrame(rows, "path string, rate long, part long, data binary")


def whole(rows, key, block):
    found = {}
    for r in sorted(rows, key=lambda r: r[block]):
        found.setdefault(r[key], []).append(np.frombuffer(bytes(r.data), "<i2"))
    return {k: np.concatenate(v) for k, v in found.items()}


@pytest.mark.parametrize("channels", [1, 2])
def test_mixdown_equals_a_direct_sum(spark, channels):
    rng, frames = np.random.default_rng(channels), 50
    sounds = {f"s{i}": rng.integers(-30000, 30000, int(rng.integers(1, 260)) * channels) for i in range(6)}
    placements, mixes = [], [("a", 333), ("b", 100), ("silent", 120), ("none", 0)]
    for layer in range(40):
        path = f"s{rng.integers(0, 7)}"
        period = int(rng.integers(1, 90)) if rng.random() < 0.4 else None
        placements.append((str(rng.choice(["a", "b", "gone"])), layer, path, int(rng.integers(-60, 330)), int(rng.integers(0, 80)), int(rng.integers(0, 300)), period, [None, 0.0, -6.0, 3.5][rng.integers(0, 4)]))
    schema = "mix string, layer int, path string, start long, skip long, length long, period long, gain double"
    got = whole(mixing.mixdown(spark.createDataFrame(mixes, "mix string, length long"), spark.createDataFrame(placements, schema), stored(spark, sounds, frames, channels), frames, channels).collect(), "mix", "block")
    assert set(got) == {"a", "b", "silent"}
    for mix, length in mixes[:3]:
        want = np.zeros((length, channels), np.int64)
        for m, _, path, start, skip, n, period, gain in placements:
            if m != mix or path not in sounds:
                continue
            x = sounds[path].reshape(-1, channels)
            for t in range(n):
                own, to = skip + (t % period if period else t), start + t
                if own < len(x) and 0 <= to < length:
                    value = np.floor(x[own] * 10.0 ** (gain / 20)).clip(-32768, 32767) if gain else x[own]
                    want[to] = (want[to] + value.astype(np.int64)).clip(-32768, 32767)
        assert (got[mix] == want.ravel()).all(), mix


def direct(x, rate, cutoff, kind):
    rc, dt = 1.0 / (cutoff * 2.0 * math.pi), 1.0 / rate
    alpha = dt / (rc + dt) if kind == "low" else rc / (rc + dt)
    last, out = float(x[0]), [int(x[0])]
    for before, now in zip(x[:-1].tolist(), x[1:].tolist()):
        last = last + alpha * (now - last) if kind == "low" else alpha * (last + now - before)
        out.append(int(min(max(last, -32768.0), 32767.0)))
    return np.array(out)


@pytest.mark.parametrize("kind", ["low", "high"])
@pytest.mark.parametrize(("channels", "frames"), [(1, 1000), (2, 37)])
def test_filters_equal_one_pass(spark, kind, channels, frames):
    rng = np.random.default_rng(frames)
    sounds = {f"s{i}": rng.integers(-20000, 20000, n * channels) for i, n in enumerate((1, 2, 37, 3000))}
    got = whole(mixing.one_pole(stored(spark, sounds, frames, channels), 700.0, kind, channels).collect(), "path", "part")
    for path, x in sounds.items():
        want = np.stack([direct(x.reshape(-1, channels)[:, c], 8000, 700.0, kind) for c in range(channels)], axis=1).ravel()
        assert (got[path] == want).all(), path


def test_odd_filters(spark):
    sounds = stored(spark, {"a": np.zeros(5, int)}, 5)
    assert whole(mixing.one_pole(sounds, 100.0, "high").collect(), "path", "part")["a"].tolist() == [0] * 5
    assert mixing.one_pole(sounds.limit(0), 100.0, "low").count() == 0
    with pytest.raises(ValueError):
        mixing.one_pole(sounds, 100.0, "band")


def test_a_mix_is_laid_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 4)
    rng = np.random.default_rng(3)
    x = rng.integers(-30000, 30000, 64)
    placements = [("m", layer, "s", 5, 0, 60, None, None) for layer in range(23)]
    schema = "mix string, layer int, path string, start long, skip long, length long, period long, gain double"
    mixed = mixing.mixdown(spark.createDataFrame([("m", 64)], "mix string, length long"), spark.createDataFrame(placements, schema), stored(spark, {"s": x}, 16), 16)
    want = np.zeros(64, np.int64)
    for _ in placements:
        want[5:] = (want[5:] + x[:59]).clip(-32768, 32767)
    assert (whole(mixed.collect(), "mix", "block")["m"] == want).all()
    # Pieces are not sorted to meet the few blocks of a recording.
    assert "ShuffledHashJoin [path" in mixed._jdf.queryExecution().executedPlan().toString()
