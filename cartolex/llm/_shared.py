"""The folder that driver and executors share, and helpers for work tables and Python workers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_OPEN: list[list[str]] = []  # paths of each open scratch
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none (single-process tests) is one made, under
    the machine's temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="cartolex-")
    return _LOCAL[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession):
    """Work tables written inside are deleted at the end, but for those written with ``keep``: what is returned must read no others."""
    _OPEN.append([])
    try:
        yield
    finally:
        jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _OPEN.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(hadoop).delete(where, True)


def materialize(df: DataFrame, label: str, release: bool = False, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and
    a lost executor costs a reread instead of a recomputation.

    ``release``: the driver collects its garbage, upon which Spark deletes the files
    of exchanges that no plan needs any more; else they stay until it happens to.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    if release:
        release_exchanges(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the work tables of the open scratch that ``df`` reads: nothing may read them any more."""
    jvm, hadoop = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    names = {file.rsplit("/", 1)[0].rsplit("/", 1)[1] for file in df.inputFiles()}
    for path in [p for p in (_OPEN[-1] if _OPEN else ()) if p.rsplit("/", 1)[1] in names]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)
        _OPEN[-1].remove(path)


def release_exchanges(spark: SparkSession) -> None:
    """Spark deletes the files of exchanges that no plan needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def posix_path(path: str) -> str:
    """The path as the operating system knows it; for files that workers map."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} cannot be mapped into memory: mount the shared folder as a file system (file://)")
    return path


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _give_back() -> None:
    """What this process has freed goes back to the system."""
    from . import _text

    _text.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _lean(f):
    """``f``, after which the worker returns freed memory: idle workers stay with an executor between stages."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            _give_back()

    return run


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of at most ``BATCH_BYTES`` (unless the session says otherwise) and with workers that give memory back."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) is None:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(_lean(f), schema)


def tasks_for(spark: SparkSession, rows: int, each: int = 100_000) -> int:
    """Tasks for a small table: ``each`` rows in one, but no fewer than two a core."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // each))
