"""Lineage cuts that survive the loss of an executor.

Intermediate tables go, as Parquet, to the shared folder that the session
names in ``spark.checkpoint.dir``.  Only where that setting is unset and the
master is local, as in unit tests on one machine, is a temporary folder made
and registered with the Spark context.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: its shuffles' files go with the job, and Arrow batches stay small whatever a row holds.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}

#: Rows a task, and so a file, of tables of known size: of large ones, and of those that don't occupy all cores twice.
FILE_ROWS, SMALL_ROWS = 100_000, 8_000

_open: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("scratch_tables", default=None)
_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by driver and executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="switchyard-")
    context.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the scratch folder and return a scan of what was written.

    With ``rows``, about how many the last stage reads, a table of few rows is
    written by few tasks and doesn't become hundreds of files.

    The returned frame has no lineage beyond the files, so tasks that are
    retried after an executor is lost reread them.  The files go at the end of
    the ``scratch_scope`` they were written in, by ``release``, or else when
    the Python process ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/switchyard/{tag}-{uuid.uuid4().hex}"
    shape = df.schema
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-rows // SMALL_ROWS))))
    with _settings(spark, _WRITING):
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    held = _open.get()
    (_written if held is None else held).append((spark, path))
    out = spark.read.schema(shape).parquet(path)
    out.scratch_path = path
    return out


@contextmanager
def scratch_scope() -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted on leaving, but those whose frames were put on the list.

    What is kept belongs to the scope around, if there is one.
    """
    held: list[tuple[SparkSession, str]] = []
    kept: list[DataFrame] = []
    mark = _open.set(held)
    try:
        yield kept
    finally:
        _open.reset(mark)
        staying = {frame.scratch_path for frame in kept}
        outer = _open.get()
        for spark, path in held:
            if path in staying:
                (_written if outer is None else outer).append((spark, path))
            else:
                _delete(spark, path)


def release(*frames: DataFrame) -> None:
    """Delete the tables behind frames of ``materialize`` that nothing reads any more."""
    gone = {frame.scratch_path for frame in frames}
    for tables in (_written, _open.get() or []):
        for spark, path in [t for t in tables if t[1] in gone]:
            tables.remove((spark, path))
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    if context._jsc is None or context._gateway is None:
        return True
    try:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have ended before this process
        return False
    return True


def discard_all() -> None:
    """Delete the intermediate tables that this process has written."""
    while _written:
        if not _delete(*_written.pop()):
            return


atexit.register(discard_all)
