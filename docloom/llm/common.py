"""What the operators of this subpackage share: words, staging, row-safe Arrow loops."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a shingle and the least Jaccard similarity of near duplicates.
SHINGLE, SIMILAR = 5, 0.8


def text_of(column: Column | str) -> Column:
    """The text, '' for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def name_of(column: Column | str) -> Column:
    """A value as a string that is never null, for joins and windows on one and the same key."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("\0null"))


def hash_of(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed: an order of rows that tie, the same in every run."""
    return F.xxhash64(F.lit(0), *[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])


def word_count(column: Column | str) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders of this driver's own working tables, deleted when it ends.
_WORKING: list[str] = []


def temporary(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    if not _WORKING:
        atexit.register(release, spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WORKING.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the working tables made so far; results that were read from them must have been written."""
    while _WORKING:
        with contextlib.suppress(Exception):  # the session may be gone
            drop_path(spark, _WORKING.pop())


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: lineage is cut, and a lost executor costs no recomputation."""
    path = temporary(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Spark's own file system layer."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: What functions with ``remembered`` keep in this process.
_REMEMBERED: list = []


def remembered(most: int) -> Callable:
    """``lru_cache`` for what a Python worker keeps from task to task; ``tidy`` empties it."""

    def wrap(make):
        made = lru_cache(maxsize=most)(make)
        _REMEMBERED.append(made)
        return made

    return wrap


def only(*keep) -> None:
    """Drop what ``remembered`` functions keep, but for that of ``keep``."""
    for made in _REMEMBERED:
        if made not in keep:
            made.cache_clear()


def give_back() -> None:
    """Return freed memory to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidy(*keep) -> Callable:
    """For functions of mapInArrow.  Python workers outlive tasks and stages, and all of an executor's share its memory
    with the JVM: one starts without the tables of other operators (``keep``: those of its own) and ends without free memory."""

    def wrap(run):
        def whole(batches):
            only(*keep)
            try:
                yield from run(batches)
            finally:
                give_back()

        return whole

    return wrap


def sliced(batches, rows: int = 512):
    """Arrow batches in slices of a few hundred rows, so that only a few hundred texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]
