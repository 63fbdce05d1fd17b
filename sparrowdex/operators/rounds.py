"""What an iterative operator keeps from round to round."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def keep(df: DataFrame) -> DataFrame:
    """df, computed once: checkpointed in the folder that spark.checkpoint.dir names, else cached, and computed again if
    an executor with it is lost."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if folder else df.persist()


def release(frames: list[DataFrame], result: DataFrame) -> DataFrame:
    """result, kept; what it was made of is not cached any more."""
    out = keep(result)
    out.count()
    for f in frames:
        f.unpersist()
    return out


_own: dict[str, str] = {}


def scratch(spark) -> str:
    """A folder that all executors share: spark.checkpoint.dir or, where all of them are threads of this process, a
    temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return f"{found.rstrip('/')}/sparrowdex"
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="sparrowdex-")
    return _own[context.applicationId]
