"""Shared pieces of the operators: tables, written intermediates, text expressions."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, [\\x20\\x09-\\x0D], as a Java character class body.
ASCII_SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where nothing is named, on one machine, a temporary folder is set; on a
    cluster that is an error, since executors don't share such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="moraine-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark finds it in."""
    system, where = hadoop_path(spark, path)
    return system.makeQualified(where).toString()


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each changed until no column has it, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/moraine/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path and the path there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Deletes an existing folder when the driver's file systems are closed."""
    system, where = hadoop_path(spark, path)
    system.deleteOnExit(where)


#: Rows of a file of a small intermediate table.
ROWS_A_FILE = 100_000


class Workspace:
    """Written intermediates of one call: they cut the lineage in the shared folder.

    Tables go when they are dropped or cleared, and what is left when the
    driver's file systems are closed at its end.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, scratch(spark, name), 0
        self.live: set[str] = set()

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """The table, written and read again. ``rows`` bounds its rows: small ones go to few files by few tasks."""
        path = self.path(name)
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
        df.write.parquet(path)
        if not self.live:
            delete_at_end(self.spark, self.root)
        self.live.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.moraine_path = path
        return out

    def _delete(self, path: str) -> None:
        system, where = hadoop_path(self.spark, path)
        system.delete(where, True)
        self.live.discard(path)

    def drop(self, *written: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in written:
            self._delete(df.moraine_path)

    def only(self, *written: DataFrame) -> None:
        """Delete all tables but these."""
        for path in self.live - {df.moraine_path for df in written}:
            self._delete(path)

    def clear(self) -> None:
        """Delete all tables of the call."""
        self._delete(self.root)
        self.live.clear()


#: Rows and bytes of the Arrow batches in which whole texts go to Python.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of ARROW_ROWS rows and ARROW_BYTES at most, unless the session sets other numbers than Spark's defaults: 10,000 whole texts, or 64 MB of them in each task several times over, take much memory."""
    for name, default, most in (("maxRecordsPerBatch", "10000", ARROW_ROWS), ("maxBytesPerBatch", "67108864b", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name) == default:
            spark.conf.set(name, str(most))


def map_texts(df: DataFrame, run, ddl: str) -> DataFrame:
    """``mapInArrow`` in small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, ddl)


def release() -> None:
    """Hands memory that a Python worker no longer uses back to the system; called at the end of a task."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not the GNU library
            pass


def text_key(text: str | Column = "text") -> Column:
    """128 bits that stand for a whole text; null has a key of its own."""
    col = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(F.coalesce(col, F.lit("")).cast("binary")))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed.

    ``lower`` is the fast way, right where every character is one byte.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def window_hashes(df: DataFrame, hashes: str, sizes: list[int], names: list[str]) -> DataFrame:
    """Adds a column for each size n: the hashes of the n-element windows of an array of hashes, in order.

    Windows of 2, 4, 8... elements are each hashed from two halves, and those of
    n from the powers of two in n: few steps for each window, however long it is.
    """
    powers, at = {1: hashes}, 1
    # No array stands inside a lambda: an expression that the optimizer moves there is evaluated for each element.
    joined = lambda left, right, by: F.zip_with(left, F.slice(right, by + 1, F.size(right)), lambda x, y: F.xxhash64(x, y))
    while 2 * at <= max(sizes, default=1):
        powers[2 * at] = f"_windows_{2 * at}"
        df = df.withColumn(powers[2 * at], joined(powers[at], powers[at], at))
        at *= 2
    for n, name in zip(sizes, names):
        bits = [p for p in powers if n & p]
        made, size = powers[bits[0]], bits[0]
        for p in bits[1:]:
            df = df.withColumn(name, joined(made, powers[p], size))
            made, size = name, size + p
        df = df.withColumn(name, F.slice(made, 1, F.greatest(F.lit(0), F.size(hashes) - (n - 1))))
    return df.drop(*[c for p, c in powers.items() if p > 1])
