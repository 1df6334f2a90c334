"""Session and storage helpers shared by iterative and file-writing operators.

Anything that must outlive a stage goes to the folder the cluster names in
``spark.checkpoint.dir``; only where that is unset and the master is local
(tests, a laptop) is a folder of our own made and set. On a cluster without it
the work stops: executors couldn't read each other's tables.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

MAX_RECORDS = 2048
MAX_BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to Python workers small in rows and in bytes, as texts may be long."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", MAX_RECORDS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", MAX_BATCH_BYTES),
    ):
        now = spark.conf.get(key, None)
        number = int(now) if now and now.lstrip("-").isdigit() else 0
        if number <= 0 or number > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders of the tables that the scratch now open has written.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there and lost executors cost no rework."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    if (held := _SCRATCH.get()) is not None:
        held.append(path)
    return table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are removed at the end, but for those given to the function that it yields. Nothing that is still to be computed may need the others."""
    held: list[str] = []
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.written_to)
        return table

    outer = _SCRATCH.set(held)
    try:
        yield keep
    finally:
        _SCRATCH.reset(outer)
        for path in held:
            if path not in kept:
                drop_folder(spark, path)
        if (around := _SCRATCH.get()) is not None:
            around += [path for path in held if path in kept]


def parts_for(df: DataFrame, target: int = 256 << 20) -> int:
    """Partitions for files of about ``target`` bytes by the planner's estimate of ``df``; the cluster's own number at least."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, -(-size // target)) if size < 1 << 50 else least  # the planner's word for a size that it doesn't know is larger


def spread(files: DataFrame, key: str = "file_path") -> DataFrame:
    """``files`` dealt by path, or another key, over all cores: parsing costs far more than moving a text, and a small table may be one partition."""
    spark = files.sparkSession
    return files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for joins that deal both sides by key.

    The planner takes rows that are exploded from a small file for few and
    would send them whole through the driver, however many they are.
    """
    return df.hint("merge")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def local_path(uri: str) -> str | None:
    """The mounted path behind a ``file:`` URI or a bare path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def put_bytes(uri: str, chunks) -> int:
    """Write an object whole or not at all; returns its length. Runs on executors."""
    path = local_path(uri)
    size = 0
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        partial = f"{path}.{uuid.uuid4().hex}.part"
        with open(partial, "wb") as sink:
            for chunk in chunks:
                size += sink.write(chunk)
        os.replace(partial, path)
        return size
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner, compression=None) as sink:
        for chunk in chunks:
            sink.write(chunk)
            size += len(chunk)
    return size


def open_bytes(uri: str):
    """A seekable reader of an object. Runs on executors."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    return store.open_input_file(inner)

