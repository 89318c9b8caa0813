"""Ordered folds: one pass over the rows of each key in order, with small state.

Rows are dealt by key and sorted in their partitions, then a task passes over
them batch by batch with the state of one key at a time, so a key of any length
needs no more memory than its state.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[object, tuple], tuple[object, tuple]]


def fold(df: DataFrame, key: str, order: list[str], inputs: list[str], outputs: str, start: Callable[[tuple], object], step: Step) -> DataFrame:
    """Adds the columns ``outputs`` (DDL) by folding the rows of each key in order.

    ``start(row)`` makes a key's state from its first row of inputs and
    ``step(state, row)`` returns the next state and the output values.
    """
    names = [x.split()[0] for x in outputs.split(",")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + outputs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, begun = None, None, False
        for batch in batches:
            made: list[tuple] = []
            for k, *row in batch[[key, *inputs]].itertuples(index=False, name=None):
                k = None if pd.isna(k) else k
                if not begun or k != last:
                    last, begun, state = k, True, start(tuple(row))
                state, out = step(state, tuple(row))
                made.append(out)
            yield batch.assign(**{n: [m[i] for m in made] for i, n in enumerate(names)})

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, ddl)


def token_bucket(requests: DataFrame, key: str, order: list[str], time: str, capacity: int, interval: int, cost: str | None = None) -> DataFrame:
    """Adds ``allowed`` and ``tokens`` (left after it) to each request.

    A bucket starts full at its key's first request. A request at least
    ``interval`` after the last reset refills it and becomes the last reset; a
    refused request takes nothing.
    """

    def step(state, row):
        tokens, last = state
        if row[0] - last >= interval:
            tokens, last = capacity, row[0]
        n = 1 if cost is None else row[1]
        allowed = tokens >= n
        tokens -= n if allowed else 0
        return (tokens, last), (bool(allowed), int(tokens))

    inputs = [time] if cost is None else [time, cost]
    return fold(requests, key, order, inputs, "allowed boolean, tokens bigint", lambda row: (capacity, row[0]), step)


def lru(accesses: DataFrame, shard: str, order: list[str], item: str, capacity: int) -> DataFrame:
    """Adds ``hit`` and ``evicted`` (the item that made room, or null) to each access of a shard's cache."""

    def step(cache, row):
        hit, evicted = row[0] in cache, None
        if hit:
            cache.move_to_end(row[0])
        else:
            if len(cache) >= capacity:
                evicted, _ = cache.popitem(last=False)
            cache[row[0]] = None
        return cache, (bool(hit), None if evicted is None else str(evicted))

    return fold(accesses, shard, order, [item], "hit boolean, evicted string", lambda _: OrderedDict(), step)


def wal_segments(frames: DataFrame, shard: str, order: list[str], size: str, segment_bytes: int) -> DataFrame:
    """Adds ``segment`` and ``used`` (bytes after the frame): a frame that doesn't fit opens the next segment."""

    def step(state, row):
        segment, used = state
        n = int(row[0])
        segment, used = (segment, used + n) if used + n <= segment_bytes else (segment + 1, n)
        return (segment, used), (segment, used)

    return fold(frames, shard, order, [size], "segment bigint, used bigint", lambda _: (0, 0), step)


def flush_runs(mutations: DataFrame, shard: str, order: list[str], key: str, capacity: int) -> DataFrame:
    """Adds ``run`` and ``held`` (distinct keys after it): a run closes when it holds ``capacity`` distinct keys."""

    def step(state, row):
        run, keys = state
        keys.add(row[0])
        out = (run, len(keys))
        return ((run + 1, set()) if len(keys) >= capacity else (run, keys)), out

    return fold(mutations, shard, order, [key], "run bigint, held bigint", lambda _: (0, set()), step)
