"""Versioned logs over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.operators.ordered import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, deleted when the driver's file systems are closed."""
    ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/moraine/{name}-{uuid.uuid4().hex}/data")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path.getParent())
    system.deleteOnExit(path.getParent())
    return system.makeQualified(path).toString()


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a mutation log; an 'error' event deletes its key.

    ``ts`` is in microseconds and ``seq`` breaks its ties.
    """
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select(
        micros.cast("bigint").alias("ts"),
        F.col("event_id").cast("bigint").alias("seq"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"),
        "event_type",
        "value",
        (F.col("event_type") == "error").alias("is_tombstone"),
    )


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key: the names of customers and parts."""
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key")).unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("key")))
