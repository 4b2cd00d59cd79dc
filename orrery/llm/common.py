"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import re
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The upper-case and lower-case ASCII letters, for folding A-Z only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(columns: list[str], name: str = "_row") -> Column:
    """The columns in one struct, so that none of them can clash with a name used beside it."""
    return F.struct(*(F.col("`" + k.replace("`", "``") + "`") for k in columns)).alias(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir, or one set here for a local session."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="orrery-checkpoint-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI that tasks understand, too: without a scheme it's on the cluster's default file system, as for Spark."""
    path, store = _path(spark, folder)
    whole = store.makeQualified(path).toString()
    return re.sub("^s3[an]:", "s3:", re.sub("^file:/(?!//)", "file:///", whole))


def remove(spark: SparkSession, folder: str) -> None:
    """Removes the folder and all that is in it."""
    path, store = _path(spark, folder)
    store.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a reliable checkpoint, so that a lost executor costs no earlier stage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with batches to Python workers bounded in this session: by default they may hold 64 MB, several times over."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def release() -> None:
    """Gives freed memory back: a worker stays for later tasks, and other workers need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """``run``, a function from batches to batches, releasing memory at its end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
