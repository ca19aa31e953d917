"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where that is unset a local session gets one of
    its own; a cluster is refused, as a folder of the driver's machine would not be its executors'."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scriptorium-")
        context.setCheckpointDir(root)
    return root


def written(frame: DataFrame, name: str, **options) -> DataFrame:
    """The frame as a Parquet table in the shared folder: its lineage ends there, and a lost executor loses nothing.
    options: of Spark's writer."""
    spark = frame.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(frame.schema).parquet(path)
    table.written_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
