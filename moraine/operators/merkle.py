"""Merkle root of an ordered list of values.

A parent is the digests of its two children, one after the other; an odd node
pairs with itself; the root is the top node's data, not hashed again. Blocks of
2**FOLD nodes are folded in one grouped step, so n leaves take about
log2(n) / FOLD shuffles and no task holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.operators.ordered import ensure_checkpoint_dir, numbered

FOLD = 10


def _parents(nodes: Column) -> Column:
    digest = lambda x: F.md5(x.cast("binary"))
    pair = lambda j: F.concat(digest(F.get(nodes, 2 * j)), digest(F.coalesce(F.get(nodes, 2 * j + 1), F.get(nodes, 2 * j))))
    last = F.floor((F.size(nodes) + 1) / 2).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), pair)


def root(values: DataFrame, order: list[str], value: str = "value") -> DataFrame:
    """One row (root, leaves): the root over ``value`` in the order; null and 0 without rows. A null value counts as empty."""
    ensure_checkpoint_dir(values.sparkSession)
    leaves = numbered(values.select(*dict.fromkeys([*order, value])), order)
    nodes = leaves.select((F.col("rn") - 1).alias("i"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("data")).checkpoint()
    total = nodes.count()
    left = total
    while left > 1:
        several = left > 2**FOLD
        block = F.floor(F.col("i") / 2**FOLD).cast("bigint").alias("i")
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "data"))), lambda x: x["data"])
        grouped = nodes.groupBy(block).agg(ordered.alias("nodes"))
        # With one block the fold stops at the top; with several every block is folded to its end.
        step = lambda acc, _: F.when((F.size(acc) > 1) | F.lit(several), _parents(acc)).otherwise(acc)
        nodes = grouped.select("i", F.get(F.aggregate(F.sequence(F.lit(1), F.lit(FOLD)), F.col("nodes"), step), F.lit(0)).alias("data"))
        left = -(-left // 2**FOLD)
    return nodes.agg(F.max("data").alias("root")).withColumn("leaves", F.lit(total).cast("bigint"))


def levels(values: DataFrame) -> DataFrame:
    """level and nodes: how many nodes each level of the tree has, leaves at level 0."""
    n = values.agg(F.count("*").alias("n"))
    halves = F.aggregate(
        F.sequence(F.lit(1), F.lit(63)),
        F.array(F.col("n")),
        lambda acc, _: F.when(F.element_at(acc, -1) > 1, F.concat(acc, F.array(F.floor((F.element_at(acc, -1) + 1) / 2).cast("bigint")))).otherwise(acc),
    )
    return n.where("n > 0").select(F.posexplode(halves).alias("level", "nodes"))
