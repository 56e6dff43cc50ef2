"""Tables that are written so that every later pass sees the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder that all machines share: the cluster's checkpoint folder; in local mode the warehouse where none is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/gable-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read back. The folder goes when the application ends."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """df, written as Parquet and read back; the folder goes at the end of the block, so nothing read from it may outlive the block."""
    spark = df.sparkSession
    path = scratch(spark)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        system.delete(place, True)
