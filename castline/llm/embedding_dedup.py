"""Near-duplicate embeddings: balanced binary codes, multi-index Hamming tables, exact rerank.

A rotation that balances the signs of the centred vectors (iterative quantisation) is learned on
a bounded sample. Every vector gets a 64-bit code, cut into four tables of 16 bits; two vectors
meet in a table if their parts differ in few bits. How few follows from the sample: where a
large common mean makes near vectors differ in many bits, both sides probe further, until nearly
all pairs at the threshold meet. Vectors whose codes are near are compared by their cosine in
double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castline.llm.common import stored
from castline.llm.components import components

BITS, TABLES = 64, 4
PART = BITS // TABLES
#: Vectors on which the rotation is learned, chosen by the hash of their ids.
SAMPLE = 20_000
ROUNDS = 40
#: Trial pairs at the threshold, made from the sample, and sample vectors that are compared with each other: of the pairs of either kind the share that has to meet.
TRIALS, COMPARED, MEET = 4000, 1500, 0.97
#: Pairs of sample vectors above the threshold that tell something.
TELLING = 30
#: Bits by which parts may differ at most to meet. More than five are taken only where a common mean of about 0.985 or more makes most vectors near each other.
WIDEST = 8


def learn_rotation(sample: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection to BITS balanced signs: principal directions, then alternately signs and rotation.

    With fewer dimensions than bits the missing directions are random ones.
    """
    mean = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
    centred, width = sample - mean, sample.shape[1]
    rng = np.random.default_rng(seed)
    directions = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :BITS]
    if width < BITS:
        directions = np.hstack([directions, rng.standard_normal((width, BITS - width)) / np.sqrt(max(width, 1))])
    spread = centred @ directions
    spread /= np.maximum(spread.std(axis=0), 1e-9) if len(sample) else 1.0
    scale = np.maximum((centred @ directions).std(axis=0), 1e-9) if len(sample) else np.ones(BITS)
    rotation = np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
    for _ in range(ROUNDS):
        signs = np.where(spread @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ spread)
        rotation = (u @ v).T
    # Directions keep their own scale, so that angles do; the rotation spreads it over all bits.
    keep = np.sqrt(scale / scale.max()) if len(sample) else 1.0
    return mean, (directions * keep) @ rotation


def signs(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return (unit - mean) @ projection >= 0


def probe_width(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray, cosine: float, seed: int = 12) -> tuple[int, int]:
    """How many bits of a part, and of a whole code, pairs at the threshold differ in.

    Trial pairs are sample vectors and what lies at the cosine from them, in the direction of the
    difference of two others; beside them stand the pairs of sample vectors that reach the cosine.
    The first figure lets ``MEET`` of either meet in a table, the second is their largest difference.
    """
    rng = np.random.default_rng(seed)
    x, to, off = (unit[rng.integers(0, len(unit), TRIALS)] for _ in range(3))
    way = to - off
    way -= (way * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(way, axis=1)
    x, way = x[size > 1e-9], way[size > 1e-9] / size[size > 1e-9, None]
    found = [(x, cosine * x + np.sqrt(max(0.0, 1 - cosine**2)) * way)] if len(x) else []
    some = unit[rng.permutation(len(unit))[:COMPARED]]
    a, b = np.nonzero(np.triu(some @ some.T >= cosine, 1))
    if len(a) >= TELLING:
        picked = rng.permutation(len(a))[:TRIALS]
        found.append((some[a[picked]], some[b[picked]]))
    width, near = 1, BITS if not found else 0
    for left, right in found:
        differ = signs(left, mean, projection) != signs(right, mean, projection)
        least = differ.reshape(len(left), TABLES, PART).sum(axis=2).min(axis=1)
        width = max(width, next((w for w in range(1, WIDEST) if (least <= w).mean() >= MEET), WIDEST))
        near = max(near, int(differ.sum(axis=1).max()))
    return width, near


def usable() -> Column:
    """Whether a row has an id, a label and a vector of finite components that are not all zero."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))


def classes(vectors: DataFrame) -> DataFrame:
    """Equal vectors of a label as one class: rep, copies, label and the vector.

    An id may recur with other vectors or labels, so a class is told by its smallest id and a hash
    of label and vector; classes are in the order of their ids.
    """
    found = vectors.where(usable()).groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    return found.select("label", "embedding", F.struct("id", F.xxhash64("label", "embedding").alias("key")).alias("rep"), "copies")


def near_pairs(reps: DataFrame, cosine: float) -> DataFrame:
    """Pairs (a, b) of classes (label, rep, embedding) of a label whose cosine reaches ``cosine``."""
    sample = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < _share(reps)).limit(SAMPLE).select("embedding").toPandas()["embedding"]
    width = max([len(x) for x in sample], key=[len(x) for x in sample].count, default=0)
    unit = np.array([np.asarray(x, float) / np.linalg.norm(np.asarray(x, float)) for x in sample if len(x) == width])
    mean, projection = learn_rotation(unit) if width else (np.zeros(0), np.zeros((0, BITS)))
    wide, near = probe_width(unit, mean, projection, cosine) if width else (1, BITS)

    def code(batches):
        for batch in batches:
            rows = batch.column(2).to_pylist()
            codes = np.zeros(len(rows), np.uint64)
            for size in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == size]
                x = np.array([rows[i] for i in at], np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                # Vectors of another width than most are cut or filled for their code; the rerank reads them whole.
                y = np.zeros((len(at), width))
                y[:, : min(size, width)] = x[:, :width]
                codes[at] = np.packbits(signs(y, mean, projection), axis=1).view(">u8").ravel().astype(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.view(np.int64))], names=["label", "rep", "code"])

    label = reps.schema["label"].dataType.simpleString()
    rep = reps.schema["rep"].dataType.simpleString()
    coded = stored(reps.select("label", "rep", "embedding").mapInArrow(code, f"label {label}, rep {rep}, code long"), "codes")
    part = lambda c, t: f"(shiftrightunsigned({c}, {t * PART}) & {(1 << PART) - 1})"
    places = F.expr("explode(array(" + ", ".join(f"struct({t} AS place, {part('code', t)} AS part)" for t in range(TABLES)) + ")) AS at")
    placed = coded.select("label", "rep", "code", places)

    def probes(end: str, bits: int) -> DataFrame:
        """The rows under all parts that differ from their own in so many bits at most, by ``flip``."""
        flips = ", ".join(str(m) for m in range(1 << PART) if m.bit_count() <= bits)
        rows = placed.select("label", F.col("rep").alias(end), F.col("code").alias(f"code_{end}"), "at.place", F.col("at.part").alias("own"), F.expr(f"explode(array({flips}))").alias(f"flip_{end}"))
        return rows.select("label", end, f"code_{end}", "place", f"flip_{end}", F.expr(f"own ^ flip_{end}").alias("part"))

    # Both sides go half of the way. A pair comes once: in the first table in which it meets, and there
    # the one side flips the lower bits in which the parts differ, as many as it may, the other side the rest.
    own_bits, other_bits = (wide + 1) // 2, wide // 2
    once = f"(flip_a & flip_b) = 0 AND (flip_b = 0 OR (bit_count(flip_a) = {own_bits} AND flip_a < (flip_b & -flip_b)))"
    xor = "(code_a ^ code_b)"
    earlier = " OR ".join(f"(place > {t} AND bit_count({part(xor, t)}) <= {wide})" for t in range(TABLES - 1))
    met = probes("a", own_bits).join(probes("b", other_bits), ["label", "place", "part"]).where(f"a < b AND {once} AND bit_count({xor}) <= {near} AND NOT ({earlier})").select("a", "b")
    dot = "aggregate(zip_with(va, vb, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
    norm = "sqrt(aggregate({0}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
    held = reps.select("rep", F.col("embedding").alias("v"), F.expr(norm.format("embedding")).alias("n"))
    return (
        met.join(held.select(F.col("rep").alias("a"), F.col("v").alias("va"), F.col("n").alias("na")), "a")
        .join(held.select(F.col("rep").alias("b"), F.col("v").alias("vb"), F.col("n").alias("nb")), "b")
        .where("size(va) = size(vb)")
        .where(F.expr(f"{dot} / (na * nb) >= {cosine}D"))
        .select("a", "b")
    )


def _share(reps: DataFrame) -> int:
    n = reps.count()
    return int((1 << 20) * min(1.0, 0.9 * SAMPLE / max(n, 1))) + 1


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """For every row of ``vectors`` (vec_id, embedding, label): n_links, component_id, kept.

    Only vectors of equal, non-null labels are compared; those that are null, zero or hold null
    or non-finite components link with nothing, nor do rows without an id. Copies are one class
    in the search and count as links of each other. Repeated ids come back as often as they went
    in: each row has the links of its own vector among those of its own label. An empty table
    gives no rows; other columns are not read.
    """
    vectors = vectors.select("vec_id", "embedding", "label")
    reps = stored(classes(vectors), "classes")
    pairs = stored(near_pairs(reps, cosine), "pairs")
    weights = reps.select("rep", "copies")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.join(weights, both["b"] == weights["rep"]).groupBy("a").agg(F.sum("copies").alias("others"))
    found = (
        reps.join(around, reps["rep"] == around["a"], "left")
        .join(components(pairs), F.col("rep") == F.col("node"), "left")
        .select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep")["id"].alias("component_id"))
    )
    own = vectors.where(usable()).join(found, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = vectors.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
