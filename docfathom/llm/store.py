"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a task of a shuffle should take at most, and bytes of text that a byte of a compressed column is about.
TASK_BYTES, UNPACKED = 128 << 20, 4


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset (tests), a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="docfathom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no files of its shuffles: nothing else reads them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docfathom-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def file_bytes(df: DataFrame) -> int:
    """The size of the files that ``df`` reads, as its plan knows it; very large where it doesn't."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def dealt(df: DataFrame, *columns: str, source: DataFrame, times: float = 1.0) -> DataFrame:
    """``df`` dealt by ``columns``, to as many tasks as the session says, or more where ``source`` is large.

    ``times``: bytes of ``df`` for each byte of text in ``source``, whose size the plan knows from its files.  Only the
    number of tasks depends on it.
    """
    spark = df.sparkSession
    size = file_bytes(source)
    tasks = int(size * UNPACKED * times // TASK_BYTES)
    few = tasks <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(*columns) if few or size >= 1 << 60 else df.repartition(tasks, *columns)  # tables without files have no known size


def drop_stored(df: DataFrame) -> None:
    """Remove a table of ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("docfathom-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
