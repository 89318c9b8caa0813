"""Runs and levels: which run holds a mutation and where compaction has put it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.operators import ordered

THRESHOLD, LEVELS = 20, 5


def level_of(run: Column, runs: Column, threshold: int = THRESHOLD, levels: int = LEVELS) -> Column:
    """The level of a 0-based run after ``runs`` runs: levels fill like the digits of a counter to base ``threshold``.

    The last level grows without bound.
    """
    out = F.lit(0)
    for i in range(1, levels):
        size = threshold**i
        out = F.when(run < size * F.floor(runs / size), i).otherwise(out)
    return out.cast("int")


def catalog(log: DataFrame) -> DataFrame:
    """run, n, tombstones, first_key, last_key and newest of each run of a log with a column run, numbered as integers."""
    return log.groupBy(F.col("run").cast("bigint").alias("run")).agg(
        F.count("*").alias("n"),
        F.count_if("is_tombstone").alias("tombstones"),
        F.min("key").alias("first_key"),
        F.max("key").alias("last_key"),
        F.max("ts").alias("newest"),
    )


def missing_segments(segments: DataFrame) -> DataFrame:
    """Segment numbers below the largest that are missing.

    Numbers are dealt in ranges and only what lies between neighbours is made,
    a gap at a time.
    """
    present = ordered.numbered(segments.select(F.col("segment").cast("bigint").alias("segment")).where("segment >= 0").distinct(), ["segment"])
    later = present.select((F.col("rn") - 1).alias("rn"), F.col("segment").alias("end"))
    first = present.where("rn = 1").select(F.lit(0).cast("bigint").alias("start"), F.col("segment").alias("end"))
    gaps = present.join(later, "rn").select((F.col("segment") + 1).alias("start"), "end").unionByName(first).where("start < end")
    return gaps.select(F.explode(F.sequence("start", F.col("end") - 1)).alias("segment"))


def next_segment(segments: DataFrame) -> DataFrame:
    return segments.agg((F.coalesce(F.max("segment"), F.lit(-1)) + 1).cast("bigint").alias("next_segment"))
