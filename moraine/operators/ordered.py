"""Global row numbers and running sums without a single-task window.

Rows are dealt into sorted ranges of the order; each range is counted and
summed by itself and the ranges' totals, one small row each, are added up.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; where nothing is set, a temporary folder on one machine and an error on a cluster."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="moraine-"))


def numbered(df: DataFrame, order: list[str], sums: dict[str, str] | None = None) -> DataFrame:
    """Adds ``rn`` (from 1, in the order) and, for each name in ``sums``, the sum of an expression over earlier rows.

    The order should be total; rows that tie are numbered in any order.
    """
    spark, sums = df.sparkSession, sums or {}
    ensure_checkpoint_dir(spark)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    # Dealt once and cut here: ranges come from a sample and must not change between the two uses.
    dealt = dealt.checkpoint()
    within = Window.partitionBy("_part").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_rn", F.row_number().over(within))
    for name, expression in sums.items():
        local = local.withColumn(name, F.coalesce(F.sum(F.expr(expression)).over(before), F.lit(0)))
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(F.expr(e)).alias(f"_s_{n}") for n, e in sums.items()])
    # As many rows as there are partitions.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_o{c}") for c in totals.columns[1:]])
    out = local.join(F.broadcast(offsets), "_part").withColumn("rn", (F.col("_rn") + F.col("_o_n")).cast("bigint"))
    for name in sums:
        out = out.withColumn(name, (F.col(name) + F.col(f"_o_s_{name}")).cast("bigint"))
    return out.select(*df.columns, "rn", *sums)
