"""Places and tables that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session that names none (tests) gets a temporary one: executors
    of a cluster would not find it, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage is cut and a lost executor loses nothing.

    The shuffle files that led to the table go as soon as it is written; the table itself goes by ``discard``.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    table = spark.read.schema(df.schema).parquet(path)
    table.materialised_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(table.materialised_at)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
