"""Embedding whitening: principal directions by one-sided Jacobi rotations of a triangular factor.

Components become whole numbers, so that sums and deviations are exact and rows can be centred
without loss. Every task factors its centred rows block by block (QR); the triangular factors
meet in groups of bounded size until one is left (TSQR). Plane rotations make the columns of
that factor orthogonal: their lengths are the standard deviations, the accumulated rotations the
components. No covariance is formed on the way, so small deviations keep their digits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castline.llm.common import scratch, stored

#: A component c counts as floor(SCALE * c) + OFFSET; what is beyond MOST before that counts as MOST.
SCALE, OFFSET, MOST = 1024, 100_000, 1 << 48
#: Rows that are factored at once, and triangular factors that meet in one group.
BLOCK, FAN_IN = 4096, 32
SWEEPS = 60


def usable() -> Column:
    """Whether ``embedding`` is there and all its entries are finite."""
    e = F.col("embedding")
    return F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """One row of whole numbers for each vector."""
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * flat), -MOST, MOST).astype(np.int64).reshape(len(vectors), width) + OFFSET


@dataclass(frozen=True)
class Sums:
    """The number of vectors, their width, and the sum of each dimension."""

    n: int
    width: int
    totals: list[int]

    def away(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S for every entry, exact: longs, or Python's integers where longs are too short."""
        short = self.n * max(abs(int(rows.min())), abs(int(rows.max()))) < 1 << 61 if rows.size else True
        if short and max(map(abs, self.totals)) < 1 << 61:
            return rows * self.n - np.array(self.totals, np.int64)
        return rows.astype(object) * self.n - np.array(self.totals, object)

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return self.away(rows).astype(np.float64) / self.n

    def deviations(self, rows: np.ndarray) -> list[int]:
        """The sum over the dimensions of (n * x - S)^2 of each row, exact."""
        away = self.away(rows)
        if away.dtype != object and away.size and max(abs(int(away.min())), abs(int(away.max()))) ** 2 * self.width >= 1 << 62:
            away = away.astype(object)
        return (away * away).sum(axis=1).tolist()


def exact_sums(vectors: DataFrame) -> Sums | None:
    """The sums over all vectors of the width that most have (the larger one of a tie); None for no vectors."""
    widths = vectors.groupBy(F.size("embedding").alias("width")).count().where("width > 0")
    most = widths.orderBy(F.desc("count"), F.desc("width")).first()
    if most is None:
        return None
    width, n = most

    def add(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                rows = integers(batch.column(0).slice(start, BLOCK), width)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(rows.sum(axis=0))], names=["place", "total"])

    partial = vectors.where(F.size("embedding") == width).select("embedding").mapInArrow(add, "place int, total long")
    found = dict(partial.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect())
    return Sums(n, width, [int(found[i]) for i in range(width)])


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square triangular factor of rows, filled up with zeros where they are few."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))]) if len(r) < rows.shape[1] else r


def factor(vectors: DataFrame, sums: Sums) -> np.ndarray:
    """The triangular factor R of all centred rows: R'R is n times the covariance.

    Each task gives one factor; ``FAN_IN`` of them meet in a group, and so on, so that no group
    holds more however many tasks there are.
    """
    width = sums.width

    def compress(batches):
        r = None
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                rows = sums.centred(integers(batch.column(0).slice(start, BLOCK), width))
                r = triangle(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([np.reshape(r, (width, width)) for r in frame.sort_values("part")["r"]])
        return pd.DataFrame({"part": [frame["part"].min() // FAN_IN], "r": [triangle(stacked).ravel()]})

    kind = "part int, r array<double>"
    factors = stored(vectors.where(F.size("embedding") == width).select("embedding").mapInArrow(compress, kind), "factors")
    parts = factors.agg(F.max("part")).first()[0] + 1
    while parts > 1:
        factors = factors.groupBy(F.expr(f"part div {FAN_IN}")).applyInPandas(meet, kind)
        parts = -(-parts // FAN_IN)
    return np.reshape(factors.first()["r"], (width, width))


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Standard deviations times sqrt(n), falling, and the directions as columns, of a factor ``r``.

    One-sided rotations: in each step of a sweep disjoint pairs of columns are made orthogonal side
    by side; over a sweep every pair meets once. It ends when no pair is further from orthogonal than rounding.
    """
    width = r.shape[1]
    even = width + width % 2
    a, v = np.zeros((len(r), even)), np.eye(even)
    a[:, :width] = r
    order, near = np.arange(even), 4 * np.finfo(float).eps * np.sqrt(width)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(even - 1):
            p, q = order[: even // 2], order[: even // 2 - 1 : -1]
            left, right = a[:, p], a[:, q]
            x, y, z = (left * left).sum(axis=0), (right * right).sum(axis=0), (left * right).sum(axis=0)
            turn = np.abs(z) > np.finfo(float).eps * np.sqrt(x * y)
            if turn.any():
                turned = turned or bool((np.abs(z) > near * np.sqrt(x * y)).any())
                tau = (y - x)[turn] / (2 * z[turn])
                t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1, tau))
                c = 1 / np.sqrt(1 + t * t)
                s, i, j = c * t, p[turn], q[turn]
                for m in (a, v):
                    m[:, i], m[:, j] = c * m[:, i] - s * m[:, j], s * m[:, i] + c * m[:, j]
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if not turned:
            break
    lengths = np.sqrt((a * a).sum(axis=0))[:width]
    falling = np.argsort(-lengths, kind="stable")
    return lengths[falling], v[:width, falling]


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """For every usable vector of ``vectors`` (vec_id, embedding) and each component: its place on it, in standard deviations.

    Columns: vec_id, component (from 1, by falling variance, as many as the vectors are wide at
    most), n, deviation (decimal), whitened, explained, identity_error. Vectors that are null or
    hold null or non-finite entries go, and so do those of another width than most have; what is
    left is all learned from. Ids may be null or repeated: every row is seen to by its own vector.
    A component without variance (all vectors equal, fewer vectors than dimensions) has whitened 0,
    explains 0 and is not part of the identity check. An empty table gives no rows. Other columns
    are not read. Entries beyond 2^38 count as 2^38. The table is read five times; nothing of its size is stored or shuffled.
    """
    spark, id_type = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    kind = f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = vectors.select("vec_id", "embedding").where(usable())
    sums = exact_sums(vectors)
    if sums is None:
        return spark.createDataFrame([], kind)
    n, width = sums.n, sums.width
    with scratch(spark):
        lengths, directions = jacobi(factor(vectors, sums))
    count = min(components, width)
    spread = lengths / np.sqrt(n)
    flat = spread <= spread[0] * width * np.finfo(float).eps
    scaled = np.where(flat, 0.0, directions / np.where(flat, 1.0, spread))[:, :count]
    total = float((spread * spread).sum())
    explained = [float(s * s / total) if total else 0.0 for s in spread[:count]]
    same = vectors.where(F.size("embedding") == width)

    def moments(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                w = sums.centred(integers(batch.column(0).slice(start, BLOCK), width)) @ scaled
                flat_sums = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat_sums), dtype=np.int32)), pa.array(flat_sums)], names=["place", "total"])

    found = dict(same.select("embedding").mapInArrow(moments, "place int, total double").groupBy("place").agg(F.sum("total")).collect())
    mean = np.array([found[i] for i in range(count)]) / n
    covariance = np.array([found[count + i] for i in range(count * count)]).reshape(count, count) / n - np.outer(mean, mean)
    off = np.abs(covariance - np.diag(np.where(flat[:count], 0.0, 1.0)))
    error = float(off.max())

    def project(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                rows = integers(part.column(1), width)
                whitened = sums.centred(rows) @ scaled
                each = np.repeat(np.arange(len(rows)), count)
                numbers = np.tile(np.arange(count), len(rows))
                deviations = pa.array([str(d) for d in sums.deviations(rows)]).take(pa.array(each))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(each)), pa.array(numbers.astype(np.int32) + 1), deviations, pa.array(whitened.ravel()), pa.array(np.array(explained)[numbers])],
                    names=["vec_id", "component", "deviation", "whitened", "explained"],
                )

    rows = same.mapInArrow(project, f"vec_id {id_type}, component int, deviation string, whitened double, explained double")
    return rows.select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error")
    )
