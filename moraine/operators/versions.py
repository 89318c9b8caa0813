"""Newest-version-wins resolution over a versioned log.

A log has ``key``, ``ts``, ``seq`` and ``is_tombstone`` besides its payload;
versions are ordered by ``(ts, seq)``, puts and deletes alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ("ts", "seq")


def is_live() -> Column:
    return ~F.col("is_tombstone")


def latest(log: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """One row per key: its newest version, which may be a tombstone."""
    # max_by has a partial aggregate, so a hot key leaves each map task as one row.
    row = F.struct(*[F.col(f"`{c}`") for c in log.columns])
    best = log.groupBy("key").agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def live(view: DataFrame) -> DataFrame:
    """Rows that are not deletes."""
    return view.where(is_live())


def current(log: DataFrame) -> DataFrame:
    """The live newest version of each key; deleted keys are hidden."""
    return live(latest(log))


def newest_live_version(log: DataFrame) -> DataFrame:
    """Variant: the newest put of each key, also of keys deleted later."""
    return latest(live(log))


def all_live_versions(log: DataFrame) -> DataFrame:
    """Variant: every put of every key whose newest version is a put."""
    hidden = latest(log).where("is_tombstone").select("key")
    return live(log).join(hidden, "key", "left_anti")


def compact(log: DataFrame, drop_tombstones: bool = False) -> DataFrame:
    """One row per key for a new run; reads before and after it agree.

    With ``drop_tombstones`` keys whose newest version is a delete go, which is
    right only where no older run is left.
    """
    return current(log) if drop_tombstones else latest(log)


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with puts (or any mutations) appended; missing columns are null."""
    if "is_tombstone" not in rows.columns:
        rows = rows.withColumn("is_tombstone", F.lit(False))
    return log.unionByName(rows, allowMissingColumns=True)


def delete(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The log with a tombstone (key, ts, seq) appended for each key."""
    return log.unionByName(keys.withColumn("is_tombstone", F.lit(True)), allowMissingColumns=True)


def update(view: DataFrame, rows: DataFrame) -> DataFrame:
    """A view of one row a key with the values of rows (key, ts, seq, value) in it: a known key keeps its (ts, seq), also if it was deleted, a new one comes with its own."""
    new = rows.select("key", F.col("ts").alias("_ts"), F.col("seq").alias("_seq"), F.col("value").alias("_value"), F.lit(True).alias("_new"))
    both = view.join(new, "key", "full_outer")
    changed = {"ts": F.coalesce("ts", "_ts"), "seq": F.coalesce("seq", "_seq"), "value": F.when(F.col("_new"), F.col("_value")).otherwise(F.col("value")), "is_tombstone": F.when(F.col("_new"), F.lit(False)).otherwise(F.col("is_tombstone"))}
    return both.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in view.columns])
