"""How much of two texts lies in matching blocks (Ratcliff and Obershelp), for many pairs at once.

Where two texts agree, they agree along diagonals. The runs of equal letters on the diagonals of
all pairs are found by sorting; a block is the longest run within a window of two texts, and what
is left and right of it are the windows of the next wave. A wave deals with all windows of all
pairs in a few array operations, and a run that a window cuts is only shortened. Longer runs come
first: those of three letters or more are looked for in whole texts, shorter ones only in the
small windows that are left then.

In a second text of 200 letters or more, letters that make up over a hundredth of it open no
block; they only lengthen one (fixed values of the measure).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Fixed values of the measure: from which length on letters can be popular, and their share.
POPULAR_FROM, POPULAR_SHARE = 200, 100
#: Pairs of equal letters that are looked at together, and the least length of runs in each stage.
CELLS, STAGES = 1 << 21, (3, 1)


def letters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts behind each other, and where each begins and ends."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), bounds


def block_ratios(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Twice the letters in matching blocks, as a share of all letters of each pair; 1 for two empty texts."""
    a, a_bounds = letters(left)
    b, b_bounds = letters(right)
    sizes = np.diff(a_bounds) + np.diff(b_bounds)
    same = np.fromiter((x == y for x, y in zip(left, right)), bool, len(left))
    found = np.where(same, np.diff(a_bounds), 0)
    todo = np.flatnonzero(~same & (np.diff(a_bounds) > 0) & (np.diff(b_bounds) > 0))
    if len(todo):
        found[todo] = _Blocks(a, b, np.stack([a_bounds[todo], a_bounds[todo + 1], b_bounds[todo], b_bounds[todo + 1]], axis=1)).totals()
    return np.where(sizes > 0, 2.0 * found / np.maximum(sizes, 1), 1.0)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as it counts, behind each other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class _Blocks:
    """Some pairs of texts, as windows (first and last place in a, first and last place in b); places are those in all texts behind each other."""

    def __init__(self, a: np.ndarray, b: np.ndarray, windows: np.ndarray):
        self.windows, self.count = windows, len(windows)
        both = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
        self.a, self.b, self.kinds = both[: len(a)], both[len(a) :], int(both.max()) + 1
        size = windows[:, 3] - windows[:, 2]
        self.long = size >= POPULAR_FROM
        #: Which letters of the second texts may open a block.
        self.rare = np.ones(len(b), bool)
        for low, high in windows[self.long, 2:].tolist():
            own = self.b[low:high]
            self.rare[low:high] = np.bincount(own, minlength=self.kinds)[own] <= (high - low) // POPULAR_SHARE + 1

    def keys(self, text: np.ndarray, lows: np.ndarray, highs: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, place, window) of each run of ``q`` letters in a window: equal keys are equal letters of one window."""
        size = np.maximum(highs - lows - q + 1, 0)
        places, owner = spread(lows, size), np.repeat(np.arange(len(lows)), size)
        key = owner
        for ahead in range(q):
            key = key * self.kinds + text[places + ahead]
        return key, places, owner

    def all_runs(self, windows: np.ndarray, q: int) -> tuple[np.ndarray, ...]:
        """(window, place in a, place in b, length) of the longest runs of at least ``q`` equal letters, in the order of windows."""
        wanted, at, owner = self.keys(self.a, windows[:, 0], windows[:, 1], q)
        key, places, _ = self.keys(self.b, windows[:, 2], windows[:, 3], q)
        opens = np.logical_and.reduce([self.rare[places + ahead] for ahead in range(q)])
        key, places = key[opens], places[opens]
        order = np.argsort(key, kind="stable")
        key, places = key[order], places[order]
        low, high = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
        counts = high - low
        ends = np.cumsum(counts)
        begins, finals = [], []
        start = 0
        while start < len(at):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + CELLS, "right")))
            n = counts[start:stop]
            i, j, p = np.repeat(at[start:stop], n), places[spread(low[start:stop], n)], np.repeat(owner[start:stop], n)
            # A popular letter next to a run ends it, like an unlike one or the end of a window.
            first = (i == windows[p, 0]) | (j == windows[p, 2]) | (self.a[i - 1] != self.b[j - 1]) | ~self.rare[j - 1]
            i_next, j_next = i + q, j + q
            last = (i_next == windows[p, 1]) | (j_next == windows[p, 3])
            i_next, j_next = np.minimum(i_next, len(self.a) - 1), np.minimum(j_next, len(self.b) - 1)
            last |= (self.a[i_next] != self.b[j_next]) | ~self.rare[j_next]
            begins.append((p[first], i[first], j[first]))
            finals.append((i[last], j[last]))
            start = stop
        if not begins:
            return tuple(np.zeros((4, 0), np.int64))
        p, i, j = (np.concatenate(x) for x in zip(*begins))
        i_end, j_end = (np.concatenate(x) for x in zip(*finals))
        # Runs of one diagonal follow each other, so the nth begin belongs to the nth end.
        order = np.lexsort((i, j - i))
        p, i, j = p[order], i[order], j[order]
        lengths = i_end[np.lexsort((i_end, j_end - i_end))] + q - i
        by_window = np.argsort(p, kind="stable")
        return p[by_window], i[by_window], j[by_window], lengths[by_window]

    def totals(self) -> np.ndarray:
        """The letters in blocks of each pair."""
        totals = np.zeros(self.count, np.int64)
        windows, pair = self.windows, np.arange(self.count)
        for q in STAGES:
            if q == 1 or len(windows) * self.kinds**q < 1 << 62:
                windows, pair = self.stage(windows, pair, q, totals)
        return totals

    def stage(self, windows: np.ndarray, pair: np.ndarray, q: int, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add the blocks that begin with runs of at least ``q`` letters to ``totals``; what is left are windows (and their pairs) without such runs."""
        owner, i, j, length = self.all_runs(windows, q)
        left = [(windows[:0], pair[:0])]
        while len(windows):
            # What of each run lies in its window.
            w = windows[owner]
            off = j - i
            start = np.maximum(np.maximum(i, w[:, 0]), w[:, 2] - off)
            stop = np.minimum(np.minimum(i + length, w[:, 1]), w[:, 3] - off)
            alive = stop - start >= q
            owner, i, j, length = owner[alive], start[alive], (start + off)[alive], (stop - start)[alive]
            best = np.zeros((len(windows), 3), np.int64)
            best[:, :2] = windows[:, (0, 2)]
            if len(owner):
                firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                most = np.zeros(len(windows), np.int64)
                most[owner[firsts]] = np.maximum.reduceat(length, firsts)
                # Of the longest the first one in a, then the first one in b.
                tie = np.flatnonzero(length == most[owner])
                tie = tie[np.lexsort((j[tie], i[tie], owner[tie]))]
                tie = tie[np.concatenate([[True], owner[tie][1:] != owner[tie][:-1]])]
                best[owner[tie]] = np.stack([i[tie], j[tie], length[tie]], axis=1)
            none = best[:, 2] == 0
            if q > 1:
                left.append((windows[none], pair[none]))
            # Without any run popular letters at the beginning of a window may still be a block.
            for at in np.flatnonzero(self.long[pair] & (~none | (q == 1))):
                best[at] = self.lengthened(windows[at], best[at])
            np.add.at(totals, pair, best[:, 2])
            # The windows on both sides of each block, and the runs that reach into them.
            ahead = np.stack([windows[:, 0], best[:, 0], windows[:, 2], best[:, 1]], axis=1)
            behind = np.stack([best[:, 0] + best[:, 2], windows[:, 1], best[:, 1] + best[:, 2], windows[:, 3]], axis=1)
            both, count = np.concatenate([ahead, behind]), len(windows)
            kept = np.tile(best[:, 2] > 0, 2) & (both[:, 1] > both[:, 0]) & (both[:, 3] > both[:, 2])
            owner, i, j, length = np.concatenate([owner, owner + count]), np.tile(i, 2), np.tile(j, 2), np.tile(length, 2)
            w = both[owner]
            reach = kept[owner] & (i < w[:, 1]) & (i + length > w[:, 0]) & (j < w[:, 3]) & (j + length > w[:, 2])
            owner, i, j, length = owner[reach], i[reach], j[reach], length[reach]
            if q == 1:
                held = self.long[np.tile(pair, 2)]
                held[owner] = True
                kept &= held
            windows, pair, owner = both[kept], np.tile(pair, 2)[kept], (np.cumsum(kept) - 1)[owner]
        return tuple(np.concatenate(x) for x in zip(*left))

    def lengthened(self, window: np.ndarray, block: np.ndarray) -> tuple[int, int, int]:
        """A block with the equal letters, popular ones too, on both sides of it."""
        low_a, high_a, low_b, high_b = window.tolist()
        i, j, size = block.tolist()
        room = min(i - low_a, j - low_b)
        if room:
            unlike = np.flatnonzero(self.a[i - room : i] != self.b[j - room : j])
            more = room - 1 - int(unlike[-1]) if len(unlike) else room
            i, j, size = i - more, j - more, size + more
        room = min(high_a - i - size, high_b - j - size)
        if room:
            unlike = np.flatnonzero(self.a[i + size : i + size + room] != self.b[j + size : j + size + room])
            size += int(unlike[0]) if len(unlike) else room
        return i, j, size
