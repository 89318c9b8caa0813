"""Sketch states as one checked binary value each, and back.

A state is a small table (set bits, counters, registers, a fingerprint, a root)
whose size its parameters bound, so one row holds it. The parameters stand
beside it, and a checksum guards both.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _checksum(kind: Column, params: Column, state: Column) -> Column:
    return F.crc32(F.concat(kind, F.lit("\n"), params, F.lit("\n"), state.cast("string")).cast("binary"))


def encode(state: DataFrame, kind: str, **params) -> DataFrame:
    """kind, params, state (binary) and crc of a sketch's state, one row; an empty state has one, too."""
    rows = F.sort_array(F.collect_list(F.struct(*state.columns)))
    packed = state.agg(F.to_json(rows).cast("binary").alias("state"))
    head = packed.select(F.lit(kind).alias("kind"), F.lit(json.dumps(params, sort_keys=True)).alias("params"), "state")
    return head.withColumn("crc", _checksum(F.col("kind"), F.col("params"), F.col("state")))


def decode(encoded: DataFrame, kind: str, schema: str, **params) -> DataFrame:
    """The state of an encoded sketch; an error if it is damaged, of another kind or of other parameters."""
    whole = F.col("crc") == _checksum(F.col("kind"), F.col("params"), F.col("state"))
    same = (F.col("kind") == kind) & (F.col("params") == json.dumps(params, sort_keys=True))
    checked = F.when(whole & same, F.col("state").cast("string")).otherwise(F.raise_error(F.lit(f"a damaged or another sketch than {kind} {params}")))
    return encoded.select(F.explode(F.from_json(checked, f"array<struct<{schema}>>")).alias("s")).select("s.*")
