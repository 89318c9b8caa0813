"""Bloom filter, Count-Min Sketch and HyperLogLog as grouped aggregations over portable hashes.

State is a pure function of what was added, so partial aggregates combine and
sketches merge: Bloom bits by or, counters by sum, registers by maximum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.functions.bits import half_up, mask, next_pow2, trailing_zeros
from moraine.functions.hashing import hash60

HASH_BITS = 60


@dataclass(frozen=True)
class Bloom:
    """m bits and k hashes for n items at a false positive rate."""

    n: int
    rate: float
    m: int
    k: int

    @staticmethod
    def sized(n: int, rate: float) -> Bloom:
        if n < 1 or not 0 < rate < 1:
            raise ValueError("a filter needs at least one item and a rate between 0 and 1")
        m = next_pow2(half_up(-n * math.log(rate) / math.log(2) ** 2))
        return Bloom(n, rate, m, half_up(m / n * math.log(2)))

    def positions(self, item: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(self.k - 1)), lambda i: mask(hash60(i, item), self.m))

    def bits(self, items: DataFrame, item: str) -> DataFrame:
        """bit: the set bits after adding all items. Nulls aren't added."""
        return items.where(F.col(item).isNotNull()).select(F.explode(self.positions(F.col(item))).alias("bit")).distinct()

    def words(self, bits: DataFrame) -> DataFrame:
        """word and value: the bits packed by 32."""
        return bits.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("value"))

    def check(self, bits: DataFrame, items: DataFrame, item: str) -> DataFrame:
        """item and present: whether all bits of each distinct item are set."""
        probes = items.where(F.col(item).isNotNull()).select(F.col(item).alias("item")).distinct()
        probes = probes.select("item", F.explode(self.positions(F.col("item"))).alias("bit"))
        found = bits.select("bit", F.lit(True).alias("_set"))
        return probes.join(found, "bit", "left").groupBy("item").agg(F.bool_and(F.coalesce("_set", F.lit(False))).alias("present"))


@dataclass(frozen=True)
class CountMin:
    """rows x columns counters."""

    rows: int
    columns: int

    @staticmethod
    def sized(accuracy: float = 0.01, certainty: float = 0.01) -> CountMin:
        return CountMin(math.ceil(math.log(1 / certainty)), next_pow2(math.ceil(2.71828 / accuracy)))

    def cells(self, item: Column) -> Column:
        one = lambda r: F.struct(r.cast("int").alias("row"), mask(hash60(r, item), self.columns).alias("col"))
        return F.transform(F.sequence(F.lit(0), F.lit(self.rows - 1)), one)

    def matrix(self, items: DataFrame, item: str, by: tuple[str, ...] = ()) -> DataFrame:
        """row, col, cnt: the non-zero counters after adding all items (for each group)."""
        # Counted by item first: a frequent item is hashed once.
        counted = items.where(F.col(item).isNotNull()).groupBy(*by, F.col(item).alias("_item")).agg(F.count("*").alias("_n"))
        cells = counted.select(*by, "_n", F.explode(self.cells(F.col("_item"))).alias("c"))
        return cells.groupBy(*by, F.col("c.row").alias("row"), F.col("c.col").alias("col")).agg(F.sum("_n").alias("cnt"))

    def count(self, matrix: DataFrame, items: DataFrame, item: str) -> DataFrame:
        """item and estimate of each distinct item: the least of its counters, never below its true count."""
        probes = items.select(F.col(item).alias("item")).where("item is not null").distinct()
        probes = probes.select("item", F.explode(self.cells(F.col("item"))).alias("c")).select("item", "c.row", "c.col")
        return probes.join(matrix, ["row", "col"], "left").groupBy("item").agg(F.min(F.coalesce("cnt", F.lit(0))).cast("bigint").alias("estimate"))


@dataclass(frozen=True)
class HyperLogLog:
    """2**p registers."""

    p: int = 10

    def __post_init__(self):
        if not 4 <= self.p <= 16:
            raise ValueError("p must be from 4 to 16")

    @property
    def m(self) -> int:
        return 1 << self.p

    def registers(self, items: DataFrame, item: str, by: tuple[str, ...] = ()) -> DataFrame:
        """bucket and rho of the registers that are set (for each group). Nulls aren't added."""
        h = hash60("hll", F.col(item))
        low = HASH_BITS - self.p
        bucket = F.shiftright(h, low).cast("int").alias("bucket")
        rho = (trailing_zeros(h.bitwiseOR(F.lit(1 << low))) + 1).cast("int").alias("rho")
        return items.where(F.col(item).isNotNull()).select(*by, bucket, rho).groupBy(*by, "bucket").agg(F.max("rho").alias("rho"))

    def merged(self, a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        return a.unionByName(b).groupBy(*by, "bucket").agg(F.max("rho").alias("rho"))

    def count(self, registers: DataFrame, by: tuple[str, ...] = (), log2: bool = False) -> DataFrame:
        """estimate (for each group). ``log2`` gives the variant with binary logarithms in its corrections."""
        m = float(self.m)
        alpha = 0.7213 / (1 + 1.079 / m)
        log = F.log2 if log2 else F.log
        sums = registers.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("_s"), F.count("*").alias("_n"))
        zero = F.lit(m) - F.col("_n")
        raw = F.lit(alpha * m * m) / (F.coalesce("_s", F.lit(0.0)) + zero)
        small = F.lit(m) * log(F.lit(m) / zero)
        big = 2.0**32
        large = F.lit(-big) * log(F.lit(1.0) - raw / big)
        out = F.when((raw <= 2.5 * m) & (zero > 0), small).when(raw > big / 30, large).otherwise(raw)
        return sums.select(*by, out.alias("estimate"))
