"""Tables that a run writes for itself: one folder for each session, which the caller can delete as a whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNS: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The run's folder inside ``spark.checkpoint.dir``. A local session that names none (tests) gets a temporary folder; on a cluster
    other machines would not find that, so there it is an error."""
    run = spark.sparkContext.applicationId
    if run not in _RUNS:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        _RUNS[run] = f"{root.rstrip('/')}/loomspark-{run}"
    return _RUNS[run]


def fresh(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: what is built on it runs nothing before it again, and a lost executor loses nothing."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.materialised_at = path
    return table


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for table in tables:
        delete(table.sparkSession, table.materialised_at)


def clear(spark: SparkSession) -> None:
    """Delete all that this run has materialised."""
    delete(spark, folder(spark))
    _RUNS.pop(spark.sparkContext.applicationId, None)
