"""Frames, dense index, sparse summary and total range of a sorted run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.operators.ordered import numbered

#: Rows of a summary block.
EVERY = 50


def frame_bytes(key: str = "key", value: str = "value", tombstone: str = "is_tombstone") -> Column:
    """Bytes of an entry's frame: length, checksum, time, key, tag and, if live, value."""
    live = F.when(F.col(tombstone), 0).otherwise(8 + F.octet_length(F.coalesce(F.col(value), F.lit(""))))
    return (8 + 4 + 16 + 8 + F.octet_length(F.col(key)) + 1 + live).cast("bigint")


def index_frame_bytes(key: str = "key") -> Column:
    return (12 + 8 + F.octet_length(F.col(key)) + 8).cast("bigint")


def index(run: DataFrame) -> DataFrame:
    """key, rn, data_offset and index_offset of each row of a run (key, frame) in key order."""
    sized = run.select("key", "frame", index_frame_bytes().alias("_index"))
    return numbered(sized, ["key"], {"data_offset": "frame", "index_offset": "_index"}).select("key", "rn", "data_offset", "index_offset")


def summary(indexed: DataFrame, every: int = EVERY) -> DataFrame:
    """block, first_key, last_key, offset and n of each block of ``every`` rows; the last may be short."""
    block = F.floor((F.col("rn") - 1) / every).cast("bigint").alias("block")
    return indexed.groupBy(block).agg(
        F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.min("index_offset").alias("offset"), F.count("*").alias("n")
    )


def total_range(run: DataFrame) -> DataFrame:
    """first_key, last_key and n of a run; nulls and 0 for an empty one."""
    return run.agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"))


def prefix_intersects(prefix: str, first: str = "first_key", last: str = "last_key") -> Column:
    """Whether keys with the prefix may lie in [first, last]."""
    n = len(prefix)
    return (F.substring(first, 1, n) <= prefix) & (F.lit(prefix) <= F.substring(last, 1, n))


def range_intersects(start: str, end: str, first: str = "first_key", last: str = "last_key") -> Column:
    return (F.col(first) <= end) & (F.lit(start) <= F.col(last))


def prune(blocks: DataFrame, test: Column) -> DataFrame:
    """The blocks that a scan has to read."""
    return blocks.where(test)
