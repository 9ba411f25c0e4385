"""What every operator needs from the session: code on the workers and a folder that all machines share."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_FREED_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()
_own: dict[str, str] = {}
_freeing: dict[int, tuple[int, str]] = {}
_freeing_lock = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Put this package on every Python worker's path, once for each application.

    Also bounds the Arrow batches that workers get by bytes, where the session
    still has the wide default: rows here may be very long.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH_BYTES, "67108864b").rstrip("b") == "67108864":
        spark.conf.set(_BATCH_BYTES, "8m")
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="lodestar-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "lodestar_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, str(path.relative_to(_PACKAGE.parent)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one where that is unset and all runs in one process."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or _own.get(context.applicationId)
    if base is None and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if base is None:
        base = tempfile.mkdtemp(prefix="lodestar-shared-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = _own[context.applicationId] = f"file://{base}"
        context.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage: what follows survives lost executors without running
    ``df`` again, and the shuffle files behind it go once it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def one_by_one(spark: SparkSession, frames: Iterator[DataFrame], count: int, schema: str, name: str) -> DataFrame:
    """The rows of ``count`` frames of one schema: of one frame, itself; of more, written one after the other and read at once."""
    if count > 1:
        paths = [saved(df, name).saved_path for df in frames]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return next(frames, None) or spark.createDataFrame([], schema)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs within removes its shuffle files when it ends, not when the driver next collects garbage.

    Threads may be within at a time: the last one out restores what the first one found.
    """
    session = spark._jsparkSession.hashCode()
    with _freeing_lock:
        within, before = _freeing.get(session) or (0, spark.conf.get(_FREED_SHUFFLES, "false"))
        _freeing[session] = within + 1, before
        spark.conf.set(_FREED_SHUFFLES, "true")
    try:
        yield
    finally:
        with _freeing_lock:
            within, before = _freeing.pop(session)
            if within > 1:
                _freeing[session] = within - 1, before
            else:
                spark.conf.set(_FREED_SHUFFLES, before)


def discard(*frames: DataFrame) -> None:
    """Delete the files of ``saved`` frames that nothing will read again."""
    for df in frames:
        system, target = _on_disk(df.sparkSession, df.saved_path)
        system.delete(target, True)


def _on_disk(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any file system that Spark reads."""
    system, target = _on_disk(spark, path)
    return bool(system.exists(target))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    system, target = _on_disk(spark, path)
    return int(system.getContentSummary(target).getLength())


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def task_count(df: DataFrame, bytes_per_task: int = 48 << 20, floor: int | None = None) -> int:
    """Shuffle partitions for a table of this size: at least the session's own number.

    The number follows the input (``size_of``), so that no partition outgrows
    an executor.
    """
    least = floor or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size_of(df) // bytes_per_task))


def size_of(df: DataFrame) -> int:
    """Bytes of what the plan reads (for files: on disk); what has no known size counts as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in known if x < 1 << 60)


def steady_memory(block: int = 2 << 20) -> None:
    """Have the C library return freed blocks of this size and more to the system at once.

    By default it raises that limit with the largest block it has freed, and a
    worker that once held large arrays keeps their memory.
    """
    try:
        ctypes.CDLL(None).mallopt(-3, block)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


def trim_memory() -> None:
    """Return what is free in this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A partition function that leaves no free memory behind in its (reused) worker."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim_memory()

    return tidied
