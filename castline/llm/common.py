"""Shared helpers of the training-data operators: table access, scratch tables, memos."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is used on a local master (one machine, as in
    tests); any other master is refused, as executors could not read each other's files.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    context = spark.sparkContext
    if not (context.master.startswith("local[") or context.master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(context, "_castline_scratch", None)
    if made is None:
        made = context._castline_scratch = tempfile.mkdtemp(prefix="castline-")
    return f"file://{made}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The folder stays until ``discard`` is called with the frame, or a ``scratch`` block around it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/castline-{name}-{uuid.uuid4().hex}"
    for paths in _scratch:
        paths.append(path)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._castline_path = path
    return found


#: Spark's setting for the bytes of an Arrow batch that goes to Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """What is written inside hands rows to Python in batches of about ``most`` bytes, unless the session has a size of its own.

    Else a batch has 10,000 rows whatever they weigh: texts of some kilobytes are copied into tens of megabytes in
    the JVM, and again in the worker, which has the batch before still in hand. The setting is taken back at the end.
    """
    if spark.conf.get(BATCH_BYTES, None) is not None:
        yield
        return
    spark.conf.set(BATCH_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES)


_scratch: list[list[str]] = []


def discard(*frames: DataFrame | None) -> None:
    """Delete the folders of stored frames that nothing will read again."""
    for df in frames:
        if df is not None:
            _delete(df.sparkSession, [df._castline_path])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Whatever is stored inside is deleted at the end, but for stored frames given to the function that this yields."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.remove(df._castline_path)
        return df

    _scratch.append(paths)
    try:
        yield keep
    finally:
        _scratch.remove(paths)
        _delete(spark, paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


class Memo(dict):
    """A bounded memo with two generations: full, the young one becomes the old one.

    ``memo[key]`` computes what is missing and keeps it; a value in use moves to the young
    generation, so frequent keys stay while memory stays under ``2 * most`` entries. Keys of over
    ``LONGEST`` letters are not kept, so entries are short as well: texts without spaces would
    otherwise be kept whole.
    """

    LONGEST = 64
    made: list[weakref.ref] = []

    def __init__(self, work: Callable, most: int):
        super().__init__()
        self.work, self.most, self.old = work, most, {}
        Memo.made.append(weakref.ref(self))

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        self.keep({key: value})
        return value

    def knows(self, key) -> bool:
        return key in self or key in self.old

    def known(self, keys: list) -> list:
        """The values of many keys at once, None for those that are not kept; what the old generation has moves to the young one."""
        found = list(map(self.get, keys))
        if self.old:
            moved = {}
            for i, value in enumerate(found):
                if value is None:
                    found[i] = value = self.old.get(keys[i])
                    if value is not None:
                        moved[keys[i]] = value
            self.keep(moved)
        return found

    def keep(self, values: dict) -> None:
        """Put in what was computed elsewhere, as far as there is room for it."""
        short = {key: value for key, value in islice(values.items(), self.most) if len(key) <= self.LONGEST}
        if len(self) + len(short) > self.most:
            self.old = dict(self)
            self.clear()
        self.update(short)


def forget_others(*mine: Memo) -> None:
    """Empty all memos but these, and give free memory back: a worker goes on from one operator's stage to the next one's."""
    for known in Memo.made:
        memo = known()
        if memo is not None and not any(memo is m for m in mine):
            memo.clear()
            memo.old = {}
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_libc = ctypes.CDLL(None)
