"""Streams of mutations and requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from moraine.sources.store import RunStore


def ingest(mutations: DataFrame, store: RunStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each micro-batch as the level-0 run of its number.

    A batch that is repeated after a failure replaces its run, and reads take the
    newest version, so results are as if each batch had come once.
    """
    return mutations.writeStream.foreachBatch(lambda batch, n: store.add(batch, n)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def token_bucket(requests: DataFrame, capacity: int, interval: int) -> DataFrame:
    """key, ts, seq, allowed and tokens of each request (key, ts, seq) of a stream, by a bucket kept for each key.

    Requests of a key are taken in the order (ts, seq) within a micro-batch, and
    batches as they come.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        tokens, last = state.get if state.exists else (capacity, int(rows["ts"].iloc[0]))
        out = []
        for ts, seq in rows[["ts", "seq"]].itertuples(index=False, name=None):
            if ts - last >= interval:
                tokens, last = capacity, int(ts)
            allowed = tokens >= 1
            tokens -= allowed
            out.append((key[0], ts, seq, bool(allowed), int(tokens)))
        state.update((int(tokens), int(last)))
        yield pd.DataFrame(out, columns=["key", "ts", "seq", "allowed", "tokens"])

    return requests.groupBy("key").applyInPandasWithState(step, "key string, ts bigint, seq bigint, allowed boolean, tokens bigint", "tokens bigint, last bigint", "append", GroupStateTimeout.NoTimeout)
