"""Near-duplicate documents: an exact Jaccard join of word n-gram sets.

A document is the set of its five-word shingles. Shingles are put in one order, rare ones first,
by counts over all documents in a table of a fixed size. Two sets that are alike share one of
the first shingles of both (as many as they may lack of each other), so sets meet in tiles: one
for each such shingle and band of sizes. In a tile, sizes and then bitmaps decide: the number of
bits in which two hashed parity bitmaps differ bounds the overlap from above. Pairs that are
left are settled by intersecting the sorted arrays.

Equal sets are one class throughout. In a tile all sets are first compared with a few leaders,
in large tiles then with a few others; only sets that these do not bring together are compared with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castline.llm.common import discard, forget_others, stored
from castline.llm.components import components
from castline.llm.parts import slices

WORDS = 5
#: Two sets are linked if PARTS * intersection >= ALIKE * union.
ALIKE, PARTS = 75, 100
#: Places of the table of shingle counts, whatever the number of documents, and rows in which it travels.
PLACES, SLICES = 1 << 18, 64
#: Leaders of a tile, and as many others of a large one. All its sets are compared with them first, so many of a set's leaders in each round.
LEADERS, STEPS = 16, (1, 3, 1_000_000)
#: Bytes of a word that are hashed with those of other words, eight at once; a longer one is hashed by itself.
LONG = 256
#: What is left of eight bytes if a word has so many more.
LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
TOP = np.uint64(1 << 63)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (one to one)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts, A-Z lower-cased, between ASCII white space, and where each text begins and ends among them."""
    whole = pc.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    size = int(bounds[-1] - bounds[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(whole) + 1, np.int64)
    raw = np.frombuffer(whole.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    letters = np.zeros(size + 8, np.uint8)
    letters[:size] = raw + (raw - np.uint8(65) < 26) * np.uint8(32)

    # A word begins after white space or at the beginning of a text, and ends likewise.
    inside = (raw != 32) & (raw - np.uint8(9) >= 5)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < size)]
    begins[edges], ends[edges - 1] = inside[edges], inside[edges - 1]
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - starts

    eight = np.ndarray(size + 1, "<u8", letters, strides=(1,))
    hashes = mix((eight[starts] & LEFT[np.minimum(sizes, 8)]) * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64))
    more, at = np.flatnonzero((sizes > 8) & (sizes <= LONG)), 8
    while len(more):
        own = eight[starts[more] + at] & LEFT[np.minimum(sizes[more] - at, 8)]
        hashes[more] = mix(hashes[more] * np.uint64(0xD6E8FEB86659FD93) + own)
        at += 8
        more = more[sizes[more] > at]
    for i in np.flatnonzero(sizes > LONG):
        hashes[i] = xxhash.xxh64_intdigest(letters[starts[i] : starts[i] + sizes[i]].data)
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none without words, and one of all words if they are few."""

    def hashed(h: np.ndarray, width: int) -> np.ndarray:
        n = max(len(h) - width + 1, 0)
        sums = h[:n].copy()
        for i in range(1, width):
            sums = sums * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        return mix(sums + np.uint64(width))

    words, bounds = word_hashes(texts)
    rows, sets = hashed(words, WORDS), []
    for start, end in pairwise(bounds.tolist()):
        if 0 < end - start < WORDS:
            own = hashed(words[start:end], end - start)
        else:
            own = rows[start : max(end - WORDS + 1, start)]
            own.sort()
            new = own[1:] != own[:-1]
            if not new.all():
                own = np.concatenate([own[:1], own[1:][new]])
        sets.append(own)
    return sets


def bitmap(items: np.ndarray) -> np.ndarray:
    """Parity bits at hashed places: about two for each item, a power of two and 64 at least."""
    bits = max(64, 1 << int(2 * len(items) - 1).bit_length())
    odd = np.bincount((items >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def document_sets(documents: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, doc_key, n_shingles, set_a, set_b, bits) for each row, and the counts of shingles by place.

    ``set_a`` and ``set_b`` name the set by 128 bits; both are null for empty sets.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        counts = np.zeros(PLACES, np.int64)
        names = ["doc_id", "doc_key", "n_shingles", "set_a", "set_b", "bits", "slice", "counts"]
        types: list = []
        for batch in chain.from_iterable(slices(whole, 2) for whole in batches):
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64())]
            sets = shingle_sets(batch.column(2))
            if any(map(len, sets)):
                counts += np.bincount((np.concatenate(sets) >> np.uint64(46)).astype(np.int64), minlength=PLACES)
            marks = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) if len(s) else (None, None) for s in sets]
            none = [None] * len(sets)
            columns = [batch.column(0), batch.column(1), [len(s) for s in sets], [m[0] for m in marks], [m[1] for m in marks], [bitmap(s) if len(s) else None for s in sets], none, none]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=names)
        if types:
            none, rows = [None] * SLICES, counts.reshape(SLICES, -1)
            columns = [*[none] * 6, list(range(SLICES)), list(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = row.values.to_numpy()
                sums[i] = sums[i] + values if i in sums else values.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["slice", "counts"])

    schema = f"doc_id {kind}, doc_key long, n_shingles long, set_a long, set_b long, bits array<long>, slice int, counts array<long>"
    made = stored(documents.select("doc_id", doc_key().alias("doc_key"), "text").mapInArrow(run, schema), "sets")
    counts = np.zeros((SLICES, PLACES // SLICES), np.int64)
    for i, row in made.where("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(add, "slice int, counts array<long>").collect():
        counts[i] += np.asarray(row)
    return made.where("slice IS NULL").drop("slice", "counts"), counts.ravel()


def doc_key() -> Column:
    return F.xxhash64("doc_id", "text")


def ranks(counts: np.ndarray) -> np.ndarray:
    """Eight bits for each place, rising with its count: fine near the mean, by powers beyond."""
    mean = counts.mean()
    z = (counts - mean) / np.sqrt(mean + 1)
    near = np.clip(np.round(8 * z) + 64, 0, 127)
    far = 128 + np.clip(8 * np.log2(np.maximum(z, 8) / 8), 0, 127)
    return np.where(z < 8, near, far).astype(np.uint64)


def first_shingles(items: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which a set that is alike must have one: rare ones first, as many as may be missing, and one."""
    keys = np.sort(rank[(items >> np.uint64(46)).astype(np.int64)] << np.uint64(56) | items >> np.uint64(8))
    n = len(keys)
    return keys[: n - -(-ALIKE * n // PARTS) + 1]


def tile_rows(documents: DataFrame, rank: np.ndarray) -> DataFrame:
    """(shingle, place, set_a, n) for the first shingles of every set; a task gives the rows of equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        seen: set[int] = set()
        for batch in chain.from_iterable(slices(whole, 0) for whole in batches):
            out: list[tuple] = []
            for items in shingle_sets(batch.column(0)):
                if len(items):
                    name = int(np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.int64)[0])
                    if name not in seen:
                        seen.add(name)
                        out.append((name, len(items), (first_shingles(items, rank) ^ TOP).view(np.int64)))
            if out:
                names, sizes, firsts = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], names=["set_a", "n", "first"])

    rows = documents.select("text").where("text IS NOT NULL").mapInArrow(run, "set_a long, n int, first array<long>")
    return rows.select(F.posexplode("first").alias("place", "shingle"), "set_a", "n")


def band(n: str) -> Column:
    """Bands of sizes: sets that are alike lie in one band or in two that follow each other."""
    return F.floor(F.log(F.col(n)) / F.log(F.lit(PARTS / ALIKE)) + 1e-9).cast("int")


# The bits in which two bitmaps differ, the wider one folded to the width of the other.
_fold = "aggregate(sequence(0, size({x}) div least(size(bits_a), size(bits_b)) - 1), transform(slice({x}, 1, least(size(bits_a), size(bits_b))), z -> 0L), (s, k) -> zip_with(s, slice({x}, k * least(size(bits_a), size(bits_b)) + 1, least(size(bits_a), size(bits_b))), (p, q) -> p ^ q))"
_differ = f"aggregate(zip_with({_fold.format(x='bits_a')}, {_fold.format(x='bits_b')}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"
SIZES_FIT = f"{PARTS} * least(n_a, n_b) >= {ALIKE} * greatest(n_a, n_b)"
#: If the shingle of a tile is the first that two sets share, no more can follow than the shorter rest.
PLACES_FIT = f"{PARTS + ALIKE} * least(n_a - place_a, n_b - place_b) >= {ALIKE} * (n_a + n_b)"
#: With an overlap of at most (n_a + n_b - differ) / 2 the sets can still be alike.
BITS_FIT = f"{PARTS + ALIKE} * (n_a + n_b - {_differ}) >= {2 * ALIKE} * (n_a + n_b)"


def ruled_in(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that their bitmaps do not rule out."""
    side = lambda end: nodes.select(F.col("set_a").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(F.expr(BITS_FIT)).select("a", "b")


def settle(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sorted arrays are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(PARTS * both >= ALIKE * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    held = pairs.join(sets.withColumnsRenamed({"set_a": "a", "items": "x"}), "a").join(sets.withColumnsRenamed({"set_a": "b", "items": "y"}), "b")
    return held.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def items_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_a, items) for the documents whose doc_key is wanted: the sorted array as bytes, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        seen: set[int] = set()
        for batch in chain.from_iterable(slices(whole, 1) for whole in batches):
            names, items = [], []
            for name, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1))):
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    items.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(items, pa.binary())], names=["set_a", "items"])

    texts = documents.where("text IS NOT NULL").select(doc_key().alias("doc_key"), "text")
    return texts.join(wanted, "doc_key").select("set_a", "text").mapInArrow(run, "set_a long, items binary").dropDuplicates(["set_a"])


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set_a")).unionByName(pairs.select(F.col("b").alias("set_a"))).distinct()


def grouped(rows: DataFrame, parts: DataFrame | None, *columns: str) -> DataFrame:
    """Rows with the component of each of the columns; a set without links is its own."""
    for c in columns:
        if parts is None:
            rows = rows.withColumn(f"part_{c}", F.col(c))
        else:
            rows = rows.join(parts.select(F.col("node").alias(c), "component"), c, "left").withColumn(f"part_{c}", F.coalesce("component", c)).drop("component")
    return rows


def tiles_of(documents: DataFrame, rank: np.ndarray) -> DataFrame:
    """(shingle, band, set_a, n, place) for the tiles in which sets meet; stored."""
    key = Window.partitionBy("shingle")
    met = tile_rows(documents, rank).withColumns({"low": F.min("set_a").over(key), "high": F.max("set_a").over(key)}).where("low < high")
    # Equal sets come from several tasks; dealt out by shingle, they meet here without another shuffle.
    return stored(met.groupBy("shingle", "set_a").agg(F.min("n").alias("n"), F.min("place").alias("place")).withColumn("band", band("n")), "tiles")


def links_of(documents: DataFrame, nodes: DataFrame, rank: np.ndarray) -> DataFrame:
    """Links (a, b) between the sets of ``nodes`` (set_a, n, bits, doc_key), enough of them to connect all that are alike; stored."""
    ends, met = nodes.select("set_a", "doc_key"), tiles_of(documents, rank)
    made = [met]

    def lacking(pairs: DataFrame, items: DataFrame) -> DataFrame:
        """The items with those of further sets; few are wanted still. Stored, their table has a known size: Spark broadcasts it if it is small, and the texts need no shuffle."""
        wanted = stored(ends_of(pairs).join(items, "set_a", "left_anti").join(ends, "set_a"), "wanted")
        more = stored(items_of(documents, wanted), "items")
        made.extend([wanted, more])
        return items.unionByName(more)

    # Each set and the leaders of its tiles, as far as sizes, places and bitmaps allow.
    led = stored(ruled_in(leader_pairs(grouped(met, None, "set_a"), F.col("set_a").asc()), nodes), "led")
    items = stored(items_of(documents, ends_of(led).join(ends, "set_a")), "items")
    made += [led, items]

    # Rounds of exact comparisons; a set that has been linked needs no further leader of the same component.
    links, parts, tried = None, None, 0
    for step in STEPS:
        order = Window.partitionBy("b").orderBy("a")
        open_pairs = grouped(led.withColumn("turn", F.row_number().over(order)), parts, "a", "b").where("part_a != part_b")
        found = settle(open_pairs.where((F.col("turn") > tried) & (F.col("turn") <= tried + step)).select("a", "b"), items)
        before = links, parts
        links = stored(found if links is None else links.unionByName(found), "links")
        parts = stored(components(links), "parts")
        discard(*before)
        tried += step

    # Leaders may be far from the rest of a large tile: others, from the end of its order, are tried once.
    crowd = F.count("*").over(Window.partitionBy("shingle", "band"))
    crowded = grouped(met, parts, "set_a").withColumn("crowd", crowd).where(F.col("crowd") > LEADERS)
    others = stored(ruled_in(leader_pairs(crowded, F.col("set_a").desc()), nodes), "led")
    made.append(others)
    if others.head(1):
        items = lacking(others, items)
        before = links, parts
        links = stored(links.unionByName(settle(others, items)), "links")
        parts = stored(components(links), "parts")
        discard(*before)

    # What the leaders did not bring together is compared pair by pair.
    across = stored(ruled_in(tile_pairs(grouped(met, parts, "set_a")), nodes), "across")
    linked = stored(links.unionByName(settle(across, lacking(across, items))), "links")
    discard(*made, links, parts, across)
    return linked


def leader_pairs(tiles: DataFrame, order: Column) -> DataFrame:
    """Pairs (a, b) of a set and a leader of its tile, the first ones of an order, that lie in different components and that sizes and places allow."""
    columns = lambda end: [F.col(c).alias(f"{name}_{end}") for c, name in (("set_a", "set"), ("n", "n"), ("place", "place"), ("part_set_a", "part"))]
    turn = F.row_number().over(Window.partitionBy("shingle", "band").orderBy(order))
    leaders = tiles.withColumn("turn", turn).where(F.col("turn") <= LEADERS).select("shingle", "band", *columns("a"))
    met = tiles.select("shingle", "band", *columns("b")).join(leaders, ["shingle", "band"]).where(f"part_a != part_b AND {SIZES_FIT} AND {PLACES_FIT}")
    return met.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b")).distinct()


def tile_pairs(tiles: DataFrame) -> DataFrame:
    """Pairs of sets in a tile that lie in different components and that sizes and places allow."""
    key = Window.partitionBy("shingle")
    rows = tiles.withColumns({"low": F.min("part_set_a").over(key), "high": F.max("part_set_a").over(key)}).where("low < high")
    columns = lambda end: [F.col(c).alias(f"{name}_{end}") for c, name in (("set_a", "set"), ("n", "n"), ("place", "place"), ("part_set_a", "part"))]
    # The smaller set looks for sets in its own band and the next.
    a = rows.select("shingle", *columns("a"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    b = rows.select("shingle", *columns("b"), "band")
    met = a.join(b, ["shingle", "band"]).where(f"(n_a < n_b OR (n_a = n_b AND set_a < set_b)) AND part_a != part_b AND {SIZES_FIT} AND {PLACES_FIT}")
    return met.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b")).distinct()


def classes_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal sets as one class, with the first document that has it; and the classes as nodes (set_a, n, bits, doc_key)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "doc_key"))
    classes = stored(sets.groupBy("set_a", "set_b").agg(first.alias("first"), F.first("n_shingles").cast("int").alias("n"), F.first("bits").alias("bits")), "classes")
    return classes, classes.select("set_a", "n", "bits", F.col("first.doc_key").alias("doc_key"))


def similar_texts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links between different sets of ``documents`` (doc_id, text), and who has these sets.

    The first frame holds pairs (a, b), a < b, of sets whose Jaccard similarity is 0.75 or more,
    none left out; the second (doc_id, set_a, n_shingles) for every row, where documents of equal
    sets have the same ``set_a``, by which the pairs name them. Rows without words have no set.
    Nulls, repeated rows and empty tables are treated as in ``near_duplicates``. In a group of many
    different near copies the pairs are as many as the contract of a join asks for.
    """
    documents = documents.select("doc_id", "text")
    sets, counts = document_sets(documents)
    _, nodes = classes_of(sets.where("set_a IS NOT NULL"))
    met = tiles_of(documents, ranks(counts))
    pairs = stored(ruled_in(tile_pairs(grouped(met, None, "set_a")), nodes), "pairs")
    links = stored(settle(pairs, items_of(documents, ends_of(pairs).join(nodes.select("set_a", "doc_key"), "set_a"))), "links")
    discard(met, pairs)
    return links, sets.select("doc_id", "set_a", "n_shingles")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """For every row of ``documents`` (doc_id, text): n_shingles, component_id, doc_key and kept.

    ``doc_key`` hashes the row's id and text; ``kept`` marks the first document of a component.

    Documents whose sets have a Jaccard similarity of 0.75 or more are linked; component_id is
    the smallest doc_id reachable by links, the document itself included. Null texts and texts
    without words have an empty set and are linked with nothing; with fewer than five words the
    whole sequence is the one shingle. Rows without an id are linked by their texts, and their
    component_id is null if no other document is reached; repeated rows come back as often as
    they went in; an empty table gives no rows; other columns are not read. Whole texts count.
    Links join sets named by 64 bits of their digests; equal sets are told by all 128 bits.
    """
    documents = documents.select("doc_id", "text")
    sets, counts = document_sets(documents)
    full = sets.where("set_a IS NOT NULL")
    classes, nodes = classes_of(full)
    links = links_of(documents, nodes, ranks(counts))
    parts = components(links).select(F.col("node").alias("set_a"), "component")
    named = classes.select("set_a", "set_b", "first").join(parts, "set_a", "left").withColumn("component", F.coalesce("component", "set_a"))
    smallest = named.groupBy("component").agg(F.min("first").alias("least"))
    by_set = named.join(smallest, "component").select("set_a", "set_b", "least")
    found = full.select("doc_id", "doc_key", "n_shingles", "set_a", "set_b").join(by_set, ["set_a", "set_b"])
    kept = (F.col("doc_key") == F.col("least.doc_key")) & F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    return found.select("doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), "doc_key", kept.alias("kept")).unionByName(
        sets.where("set_a IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "doc_key", F.lit(True).alias("kept"))
    )
