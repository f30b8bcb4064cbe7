"""A folder for tables that a run needs for a while, shared by the driver and the executors."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which goes when the driver ends. A local session without that setting uses its
    warehouse; on a cluster that could be one machine's disk, so the setting is asked for."""
    context = spark.sparkContext
    top = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    own = context._jvm.org.apache.hadoop.fs.Path(f"{top}/scratch-{context.applicationId}")
    files = own.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(own)
    files.deleteOnExit(own)
    return f"{own}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written and read back: computed once, whoever reads them and however often."""
    place = folder(df.sparkSession)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
