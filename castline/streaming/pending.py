"""Edits that wait for production, live: two streams in one keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SIDES = ("edited", "produced")


class Latest(StatefulProcessor):
    """Of each seq of an episode the latest edit and the latest production; rows come out when a seq begins or ceases to wait."""

    def __init__(self, by: list[str], keep_ms: int | None):
        self.by, self.keep_ms = by, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "seq long", "edited string, produced string, waits boolean", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest: dict[int, dict[str, str]] = {}
        for frame in rows:
            for (seq, side), at in frame.groupby(["seq", "side"])["at"].max().items():
                own = latest.setdefault(int(seq), {})
                own[side] = max(at, own.get(side) or at)
        changed = []
        for seq, new in sorted(latest.items()):
            edited, produced, waited = self.known.getValue((seq,)) if self.known.containsKey((seq,)) else (None, None, False)
            edited = max((x for x in (edited, new.get("edited")) if x), default=None)
            produced = max((x for x in (produced, new.get("produced")) if x), default=None)
            waits = edited is not None and produced is not None and edited > produced
            self.known.updateValue((seq,), (edited, produced, waits))
            if waits or waited:
                changed.append((*key, seq, edited, produced, waits))
        if changed:
            yield pd.DataFrame(changed, columns=[*self.by, "seq", "edited", "produced", "pending"])

    def close(self) -> None:
        pass


def pending_stream(edits: DataFrame, produced: DataFrame, by: list[str], keep_days: float | None = None) -> DataFrame:
    """Changes of what waits, from streams of edits and of productions (by, seq, at): by, seq, edited, produced, pending.

    A seq waits while its latest edit is later than its latest production; one that was never
    produced does not. A row with ``pending`` false takes back the one before it; one with true
    replaces it. Times may come in any order. Rows without a seq or a time are left out. The state
    is two times for each seq; with ``keep_days`` what was not touched for so long is forgotten.
    The session needs the RocksDB state store.
    """
    side = lambda rows, name: rows.where("seq IS NOT NULL AND at IS NOT NULL").select(*by, F.col("seq").cast("long").alias("seq"), F.col("at").cast("string").alias("at"), F.lit(name).alias("side"))
    both = side(edits, "edited").unionByName(side(produced, "produced"))
    keys = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in by)
    keep_ms = None if keep_days is None else int(keep_days * 86_400_000)
    processor = Latest(list(by), keep_ms)
    return both.groupBy(*by).transformWithStateInPandas(processor, f"{keys}, seq long, edited string, produced string, pending boolean", "Update", "None" if keep_ms is None else "ProcessingTime")


def waiting(changes: DataFrame, by: list[str], batch: str = "batch") -> DataFrame:
    """What waits now, from the stored changes and the number of the micro-batch of each."""
    last = changes.groupBy(*by, "seq").agg(F.max_by(F.struct("edited", "produced", "pending"), batch).alias("last"))
    return last.where("last.pending").select(*by, "seq", "last.edited", "last.produced")
