"""Centroid clustering: Lloyd's rounds in whole numbers.

Components become integers, centroids travel to the tasks with the function that uses them
(``k`` times ``width`` numbers, whatever the table's size), NumPy takes the squared differences
to one centroid after another, and the sums of each partition are merged by one ``groupBy``.
Nothing is rounded but by the floor that the means ask for, so the result depends on neither
partitions nor order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers beyond this are taken as this, so that a squared distance fits in a long up to 64 dimensions.
MOST = 1 << 27
#: Places of a cluster's sums: its vectors and the distances to its centroid; the components follow.
COUNT, DISTANCE, COMPONENTS = 0, 1, 2


def whole(width: int) -> Column:
    """Whether ``embedding`` has so many components, none of them null or non-finite."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(e) == width) & fine, F.lit(False))


def integers(vectors: pd.Series, width: int, scale: int) -> np.ndarray:
    """One row of whole numbers for each vector."""
    rows = np.array(vectors.tolist(), np.float64).reshape(len(vectors), width)
    return np.clip(np.floor(scale * rows), -MOST, MOST).astype(np.int64)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid, the smallest one of a tie, and the squared distance."""
    distances = np.empty((len(centroids), len(rows)), np.int64)
    for number, centroid in enumerate(centroids):
        away = rows - centroid
        distances[number] = np.einsum("ij,ij->i", away, away)
    best = distances.argmin(axis=0)
    return best, distances[best, np.arange(len(rows))]


def first_centroids(kept: DataFrame, k: int, seed: int, width: int, scale: int) -> np.ndarray:
    """The vectors with the ``k`` smallest digests of ``seed:vec_id``, in that order; rows without an id come last.

    Rows that share an id are told apart by their vectors.
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(drawn.alias("drawn"), "embedding").orderBy(F.asc_nulls_last("drawn"), "embedding").limit(k).toPandas()
    return integers(rows["embedding"], width, scale)


def sums(kept: DataFrame, centroids: np.ndarray, scale: int) -> dict[int, dict[int, int]]:
    """For each cluster that has vectors, the sums of its places, exact."""
    k, width = centroids.shape

    def add(frames):
        found = [[0] * (COMPONENTS + width) for _ in range(k)]
        for frame in frames:
            rows = integers(frame["embedding"], width, scale)
            cluster, distance = nearest(rows, centroids)
            for number in np.unique(cluster).tolist():
                own = cluster == number
                # Halves of the distances are added apart: the sum of a batch could leave a long.
                high, low = int((distance[own] >> 32).sum()), int((distance[own] & 0xFFFFFFFF).sum())
                new = [int(own.sum()), (high << 32) + low, *rows[own].sum(axis=0).tolist()]
                found[number] = [a + b for a, b in zip(found[number], new)]
        rows = [(number, place, str(total)) for number, totals in enumerate(found) if totals[COUNT] for place, total in enumerate(totals)]
        yield pd.DataFrame(rows, columns=["cluster", "place", "total"])

    merged = kept.select("embedding").mapInPandas(add, "cluster int, place int, total string")
    totals: dict[int, dict[int, int]] = {}
    for number, place, total in merged.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        totals.setdefault(number, {})[place] = int(total)
    return totals


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """For every vector of ``vectors`` (vec_id, embedding) that is whole: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another width, or hold null or non-finite components go. Ids may be
    null or repeated: every row is clustered by its own vector. With fewer than ``k`` vectors there
    are as many centroids; a centroid that equals an earlier one stays empty. An empty table gives
    no rows. Other columns are not read. Components of which ``scale`` times the value is beyond
    2^27 count as 2^27. Sums of distances that no long can hold are null. The table is read once
    for each round, and twice more: nothing of its size is stored or shuffled.
    """
    kept = vectors.select("vec_id", "embedding").where(whole(width))
    centroids = first_centroids(kept, k, seed, width, scale)
    for _ in range(rounds if len(centroids) else 0):
        for number, totals in sums(kept, centroids, scale).items():
            centroids[number] = [totals[COMPONENTS + i] // totals[COUNT] for i in range(width)]
    inertia = {number: totals[DISTANCE] for number, totals in sums(kept, centroids, scale).items()} if len(centroids) else {}
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]

    def assign(frames):
        for frame in frames:
            cluster, distance = nearest(integers(frame["embedding"], width, scale), centroids)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": cluster.astype(np.int32), "distance": distance})

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    assigned = kept.mapInPandas(assign, f"vec_id {id_type}, cluster int, distance long")
    facts = [(number, str(own), str(sum(inertia.values())), digests[number]) for number, own in inertia.items()]
    told = vectors.sparkSession.createDataFrame(facts, "cluster int, own string, every string, centroid_sha256 string")
    told = told.select("cluster", F.expr("try_cast(own AS long)").alias("cluster_inertia"), F.expr("try_cast(every AS long)").alias("inertia"), "centroid_sha256")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
