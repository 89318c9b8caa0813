"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import Workspace, release

#: Edges up to which one task finishes the work, in about 100 bytes of memory for each.
LOCAL_EDGES = 500_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def union(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted nodes of the edges and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, least = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[least]
        np.minimum.at(least, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (further := least[least]).tobytes() != least.tobytes():
            least = further


def _union_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if found:
        nodes, least = union(np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found]))
        for at in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 100_000]), pa.array(least[at : at + 100_000])], names=["node", "component"])
    release()


def components(edges: DataFrame, work: Workspace, local: int = LOCAL_EDGES, rows: int | None = None) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (u, v) of at most ``rows`` rows.

    Alternates large-star and small-star steps, written to the shared folder
    each time, until the edges are stars around the smallest nodes. Each step
    is a grouped minimum with partial aggregation and a join, so a node with
    many neighbours is no single task's work. As soon as at most ``local``
    edges are left, one task joins them; the result is the same.
    """
    now = work.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows)
    n = now.count()
    state = _state(now) if n > local else None
    while n > local:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = work.write(hung.unionByName(smallest.withColumnRenamed("m", "v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        work.drop(now)
        now, before, state = new, state, _state(new)
        n = state[0]
        if before == state:
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            found = work.write(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
            work.drop(now)
            return found
    found = work.write(now.coalesce(1).mapInArrow(_union_all, "node bigint, component bigint"), "components")
    work.drop(now)
    return found
