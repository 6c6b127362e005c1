"""What the operators of this subpackage share: tables, the shared scratch folder, bounded slices of Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that one slice of an Arrow batch holds at most, unless a single text is longer.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names no such folder, a temporary one is made and set, but only on one machine (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="trackmend-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> DataFrame:
    """Writes and reads again.  What was shuffled for it is deleted as soon as it is written: nothing reads that again,
    and Spark would else keep it until the driver's memory runs short."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, True)
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    return _write(df, shared_folder(df.sparkSession, name))


class Scratch:
    """Tables in the shared folder that are deleted when a job no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_folder(self.spark, name)
        self.paths.append(path)
        return _write(df, path)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of jobs whose results are written: it does so as soon as the driver's JVM
        finds that nothing refers to them any more, which it would else look for only when memory runs short."""
        self.spark._jvm.System.gc()

    def clear(self, keep: int = 0) -> None:
        """Deletes all but the last ``keep`` tables."""
        cut = len(self.paths) - keep
        for path in self.paths[:cut]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = self.paths[cut:]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with marks in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as strings, null as the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column, "")


def strings(array: pa.Array) -> list[str]:
    """The array as a list; for many short strings much faster than ``to_pylist``."""
    return array.to_numpy(zero_copy_only=False).tolist()


_kept: dict[Hashable, object] = {}


def worker_cache(owner: Hashable, make: Callable[[], object]):
    """What ``make`` gives, kept in this worker process for the tasks of ``owner`` to come.

    Workers are used again by other operators, so there is one owner at a time: the caches of the one before go.
    """
    if owner not in _kept:
        drop_caches()
        _kept[owner] = make()
    return _kept[owner]


def drop_caches() -> None:
    """To be called by work that keeps nothing, so that what others kept doesn't stand beside it."""
    if _kept:
        _kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes, so that memory doesn't follow the batch size."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n + 1
    if start < batch.num_rows:
        yield batch.slice(start)


class Recent:
    """A look-up table of bounded size that keeps what was asked for of late.

    Entries live in two halves.  When the newer one is full it becomes the older one, whose entries go unless they are
    asked for again; frequent entries thus stay, at the price of two dictionaries.
    """

    def __init__(self, entries: int):
        self.half, self.new, self.old = entries // 2, {}, {}

    def many(self, keys: list) -> tuple[list, list[int]]:
        """(the values, None for keys that aren't there; the places of those)."""
        got = list(map(self.new.get, keys))
        missing = [i for i, v in enumerate(got) if v is None]
        if self.old and missing:
            found = list(map(self.old.get, [keys[i] for i in missing]))
            for i, v in zip(missing, found, strict=True):
                if v is not None:
                    got[i] = self.new[keys[i]] = v
            missing = [i for i, v in zip(missing, found, strict=True) if v is None]
        return got, missing

    def put(self, found: dict) -> None:
        self.new.update(found)

    def turn(self) -> None:
        """To be called between batches."""
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}
