"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 1000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset in local mode (tests) a temporary folder is made and set; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexiflow-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else writes to."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, by Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise with checkpoint(), so that later jobs don't depend on lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few_at_a_time(df: DataFrame) -> DataFrame:
    """df, for texts that go to Python: from now on the session's Arrow batches hold ``ARROW_ROWS`` rows at
    most. Spark bounds them by rows alone, and 10,000 texts can be more than a small executor has."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
    return df


@cache
def _trim() -> Callable:
    """glibc's malloc_trim, or nothing elsewhere."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def giving_back(run: Callable) -> Callable:
    """A function for mapInArrow that hands its worker's free memory back when a task is done; else workers that wait for
    other stages' tasks keep the most that they ever needed."""

    @wraps(run)
    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return done


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
