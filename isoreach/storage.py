"""Tables written between the passes of a computation, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def _is_local(spark: SparkSession) -> bool:
    """Whether executors are threads of the driver, so that its temporary folder is theirs."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def can_store(spark: SparkSession) -> bool:
    """Whether there is a folder that driver and executors share."""
    return bool(_base(spark)) or _is_local(spark)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the driver's file systems close.

    Where that setting and the context's checkpoint folder are both unset, a temporary folder becomes the
    checkpoint folder if the master is local; on a cluster that is an error.
    """
    context, base = spark.sparkContext, _base(spark)
    if not base:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="isoreach-"))
        base = context.getCheckpointDir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored once and read back, so that later passes see the same rows whatever is lost."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
