"""Session settings and shared-folder tables that the operators of this subpackage use."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches stay small whatever the length of the texts in them.
ARROW_ROWS, ARROW_BYTES = 2000, 4 << 20


def release() -> None:
    """Give freed memory back to the system: a worker lives on after its task, and its allocator would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that releases memory at its end."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return tidied


def arrow_limits(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive, by rows and by bytes.

    A plan reads these settings when it runs, which for a returned DataFrame is after the operator has returned; so they
    stay set. They only ever get tighter: a caller's smaller bounds are kept.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        held = spark.conf.get(key)
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Where the session names none, one of our own on a single machine (tests); on a cluster that is an error."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="jobweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh(taken: list[str], name: str) -> str:
    """A column name of the operator's own that no column of the caller has (names compare without case)."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


_made: list[str] = []


class Workspace:
    """Parquet tables in the shared folder: they cut lineage, survive lost executors and are read column by column.

    What an operator returns reads some of them, so they outlive it; the caller deletes them with `clear` once the
    results are stored.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _made.append(self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` and return the reader of what was written."""
        path = f"{self.root}/{name}"
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete the tables of all operators that this driver has run so far; their results must have been stored."""
    while _made:
        _delete(spark, _made.pop())


def join_by_key(left: DataFrame, right: DataFrame, keys: list[str], size: str = "n", total: int | None = None) -> DataFrame:
    """Inner join of `left` with the one row that `right` (a written table) has for each key, its `size` being the key's rows in `left`.

    At most 1000 keys can hold more than a thousandth of all rows: these are broadcast, so that no task gets a hot key.
    """
    total = total if total is not None else right.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    line = max(total // 1000, 100)
    hot = right.where(F.col(size) > line)
    if hot.isEmpty():
        return left.join(right, keys)
    named = F.broadcast(hot.select(*keys))
    return left.join(F.broadcast(hot), keys).unionByName(left.join(named, keys, "left_anti").join(right.where(F.col(size) <= line), keys))
