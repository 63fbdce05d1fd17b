"""Shared scratch space: tables that cut lineage and can be read again after an executor is lost."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder, which only a
    session whose executors are threads of this process can share; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="sparrowdex-")
    return _own[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sparrowdex/{name}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*stashes: DataFrame) -> None:
    """Deletes stashes that nothing reads any more."""
    for df in stashes:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back(spark: SparkSession) -> None:
    """Has the driver's and the executors' heaps collected, so that what earlier steps filled goes back to the system and
    the broadcasts and shuffles that nothing refers to are dropped. Heaps only grow otherwise, until they are full."""
    gc.collect()
    spark._jvm.System.gc()
    tasks = 4 * spark.sparkContext.defaultParallelism  # some for each executor
    spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()
    trim()


def spread(rows: DataFrame, found: DataFrame, key: str, by: str, like: DataFrame | None = None) -> DataFrame:
    """rows joined with found, which has one row at most for each value of `key`; rows without a partner go.

    A value that very many rows have is dealt, by a hash of the column `by`, over as many tasks as a shuffle has: found
    meets the distinct (key, part) pairs, of which a key has no more than parts, and rows meet those. like: rows with the
    same keys and `by`, where they are cheaper to read than rows themselves.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(by), F.lit(parts)).cast("int").alias("part_")
    pairs = (rows if like is None else like).select(key, part).distinct()
    return rows.select("*", part).join(pairs.join(found, key), [key, "part_"]).drop("part_")


#: Bytes that go to a Python worker at once; Spark's own bound holds several copies of 64 MB in each task.
BATCH_BYTES, BATCH_KEY, SPARK_DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands texts to Python in small batches, unless it has a bound of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, SPARK_DEFAULT) == SPARK_DEFAULT:
        conf.set(BATCH_KEY, BATCH_BYTES)
    return df


def lean(run):
    """run, an iterator function of a worker, giving memory back to the system after it: workers live on for other tasks."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def trim() -> None:
    """Gives this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
