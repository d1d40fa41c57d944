"""Tables in the folder that driver and executors share: where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share. Only where
    both are one machine may it be unset."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))  # the setting itself can't change in a running session
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/tessera/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of shared_dir() in whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
