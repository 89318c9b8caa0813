"""SimHash fingerprints of texts and their similarity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

STOPWORDS = ("this", "is", "a", "with", "to", "the", "some")
SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


#: What stands in no token and between none.
NOISE = r"[^\p{L}\p{N}" + SPACE[1:-2] + "]"
#: Values that stand more than once, up to which they are broadcast.
BROADCAST_KEYS = 500_000
_AT_ONCE = 50_000


def _cleaned(text: Column) -> Column:
    """A text in lower case with letters, digits and spaces alone: one pass over the text, not one for each word."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOISE, "")


def tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Words of a text in lower case with letters and digits alone, without empty ones and stop words."""
    return F.filter(F.split(_cleaned(text), SPACE), lambda w: (w != "") & ~w.isin(*stopwords))


def _counted(docs: DataFrame, by: str, text: str, stopwords: tuple[str, ...]) -> DataFrame:
    """by, token and n of each row by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun, sizes, found, counts = 0, [], [], []
            for i in range(batch.num_rows):
                n = Counter(batch.column(1)[i].as_py().split())  # of the spaces of split, those beyond SPACE are noise
                for word in stopwords:
                    n.pop(word, None)
                sizes.append(len(n))
                found.extend(n)
                counts.extend(n.values())
                if len(found) >= _AT_ONCE or i + 1 == batch.num_rows:
                    keys = batch.column(0).take(pa.array(np.repeat(np.arange(begun, i + 1), sizes)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.string()), pa.array(counts, pa.int64())], names=[by, "token", "n"])
                    begun, sizes, found, counts = i + 1, [], [], []

    rows = docs.select(F.col(by), _cleaned(F.col(text)).alias("_text"))
    return rows.mapInArrow(run, StructType([rows.schema[0], StructField("token", StringType()), StructField("n", LongType())]))


def weights(docs: DataFrame, by: str, text: str = "text", stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """by, token and n: how often each token occurs in each text, in all texts of a value of by together.

    Each text is counted where it is read; only counts of values that stand
    more than once are shuffled and added up.
    """
    again = docs.groupBy(F.col(by).alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again")
    many = again.count()
    if not many:
        return _counted(docs, by, text, stopwords)
    keys, same = F.broadcast(again) if many <= BROADCAST_KEYS else again, F.col(by).eqNullSafe(F.col("_again"))
    docs = docs.select(by, text)
    more = _counted(docs.join(keys, same, "left_semi"), by, text, stopwords).groupBy(by, "token").agg(F.sum("n").alias("n"))
    return _counted(docs.join(keys, same, "left_anti"), by, text, stopwords).unionByName(more)


def fingerprints(docs: DataFrame, by: str, text: str = "text", stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """by, fp_hi and fp_lo: the halves of the 64-bit fingerprint; 0 without tokens. One row for each value of by.

    A bit is set iff the tokens that have it outnumber those that don't. The
    sums combine on the map side, so a long text is no single task's work.
    """
    each = docs.select(by, F.posexplode_outer(tokens(F.col(text), stopwords)).alias("_at", "_token"))
    each = each.select(by, F.shiftright("_at", 20).alias("_block"), F.conv(F.substring(F.md5(F.col("_token").cast("binary")), 1, 16), 16, -10).cast("bigint").alias("_h"))
    # Three counters in a number: 22 sums in place of 64. A block of 2**20 tokens can't overflow 21 bits.
    bits = [range(j, min(j + 3, 64)) for j in range(0, 64, 3)]
    packed = [sum((F.shiftleft(F.shiftright("_h", i).bitwiseAND(F.lit(1)), 21 * k) for k, i in enumerate(some)), F.lit(0).cast("bigint")) for some in bits]
    blocks = each.groupBy(by, "_block").agg(F.count("_h").alias("_n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(f"_p{j}") for j, x in enumerate(packed)])
    count = lambda i: F.shiftright(f"_p{i // 3}", 21 * (i % 3)).bitwiseAND(F.lit((1 << 21) - 1))
    summed = blocks.groupBy(by).agg(F.sum("_n").alias("_n"), *[F.sum(count(i)).alias(f"_c{i}") for i in range(64)])
    half = lambda at: sum((F.when(2 * F.col(f"_c{at + i}") > F.col("_n"), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i in range(32)), F.lit(0).cast("bigint"))
    return summed.select(by, half(32).alias("fp_hi"), half(0).alias("fp_lo"))


def hamming(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    return (F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))).cast("int")


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance / F.lit(64.0)


def near(fps: DataFrame, by: str, most: int = 3) -> DataFrame:
    """a, b and distance of the pairs of different fingerprints at most ``most`` bits apart, by their smallest ids.

    Of ``most`` + 3 blocks of bits such a pair has three the same at least, so
    only those that share some three blocks, about half of the bits, are
    compared. Equal fingerprints are one class.
    """
    classes = fps.groupBy("fp_hi", "fp_lo").agg(F.min(by).alias("id"))
    n = most + 3
    cuts = [64 * i // n for i in range(n + 1)]
    whole = F.shiftleft("fp_hi", 32).bitwiseOR(F.col("fp_lo"))
    block = lambda k: F.shiftrightunsigned(whole, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))
    keys = [F.struct(F.lit(j).alias("j"), F.xxhash64(*map(block, some)).alias("x")) for j, some in enumerate(combinations(range(n), 3))]
    keyed = classes.select("fp_hi", "fp_lo", "id", F.explode(F.array(*keys)).alias("key")).select("fp_hi", "fp_lo", "id", "key.j", "key.x")
    a, b = keyed.toDF("hi_a", "lo_a", "a", "j", "x"), keyed.toDF("hi_b", "lo_b", "b", "j", "x")
    distance = hamming(F.col("hi_a"), F.col("lo_a"), F.col("hi_b"), F.col("lo_b"))
    return a.join(b, ["j", "x"]).where("a < b").withColumn("distance", distance).where(F.col("distance") <= most).select("a", "b", "distance").distinct()
