"""Point lookups and ordered scans of the current view.

Key filters stand before the version resolution, which groups by key, so they
reach the scan; keys are ordered bytewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.operators import versions
from moraine.operators.ordered import numbered

RESERVED = {"bf_": "bloom", "cms_": "count_min", "hll_": "hyperloglog", "sh_": "simhash"}


def get(log: DataFrame, key: str) -> DataFrame:
    """The row of a key, or none where it is missing or deleted."""
    return versions.current(log.where(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of the live keys among ``keys`` (a column key)."""
    return versions.current(log.join(keys.select("key"), "key", "left_semi"))


def prefix_scan(log: DataFrame, prefix: str) -> DataFrame:
    """Live keys that start with the prefix; an empty prefix is all of them."""
    return versions.current(log.where(F.col("key").startswith(prefix)))


def range_scan(log: DataFrame, start: str, end: str) -> DataFrame:
    """Live keys from start to end, both included."""
    return versions.current(log.where(F.col("key").between(start, end)))


#: Rows up to the end of a page that a task may hold; deeper pages are found by their first and last key.
HELD = 100_000


def page(view: DataFrame, number: int, size: int, held: int = HELD) -> DataFrame:
    """The 1-based page of a view, which has a key once, in key order; page 0 is page 1."""
    if size <= 0:
        raise ValueError("the page size must be positive")
    if number < 0:
        raise ValueError("the page number must not be negative")
    skipped = (max(number, 1) - 1) * size
    if skipped + size <= held:
        return view.orderBy("key").offset(skipped).limit(size)
    ends = numbered(view.select("key"), ["key"]).where(F.col("rn").between(skipped + 1, skipped + size)).agg(F.min("key"), F.max("key")).first()
    # The filter on keys reaches the scan.
    return view.where(F.col("key").between(*map(F.lit, ends))).orderBy("key")


def memtable_prefix(log: DataFrame, prefix: str) -> DataFrame:
    """Prefix scan of the unflushed part of a log: live rows only."""
    return prefix_scan(log, prefix)


def memtable_range(log: DataFrame, start: str, end: str) -> DataFrame:
    """Range scan of the unflushed part of a log: live rows only."""
    return range_scan(log, start, end)


def reserved_kind(key: Column) -> Column:
    """The sketch that a reserved key holds, or null."""
    out = F.lit(None).cast("string")
    for prefix, kind in RESERVED.items():
        out = F.when(key.startswith(prefix), kind).otherwise(out)
    return out


def is_reserved(key: Column) -> Column:
    return reserved_kind(key).isNotNull()
