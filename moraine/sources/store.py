"""A store of sorted runs: Parquet folders level=L/run=N under one root.

A run holds one row per key, dealt into key ranges and sorted by key, with a
Parquet bloom filter on the key, so point and range reads skip files and row
groups. Beside it stand its sparse summary (a row for each block of keys), and a
row of metadata: first and last key, number of rows and Merkle root. Reads skip
runs whose keys can't have what is asked for. A level with ``level_threshold`` runs is merged into one run of the next
level. Runs are written whole before the runs that they replace go, and reading
resolves versions anyway, so a failure in between changes no result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import codecs
from moraine.functions.sketches import Bloom
from moraine.operators import blocks, merkle, ordered, scan, versions
from moraine.sources.config import Config

_RUN = re.compile(r"level=(\d+)/run=(\d+)$")


class RunStore:
    def __init__(self, spark: SparkSession, root: str, schema: str, config: Config | None = None):
        self.spark, self.root, self.schema, self.config = spark, root.rstrip("/"), schema, config or Config()

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, where: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)

    def init(self) -> None:
        self._fs().mkdirs(self._path(self.root))

    def clear(self) -> None:
        """Deletes all runs."""
        self._fs().delete(self._path(self.root), True)
        self.init()

    def runs(self) -> list[tuple[int, int]]:
        """(level, run) of the runs that are whole, in numeric order."""
        found = self._fs().globStatus(self._path(f"{self.root}/level=*/run=*/_SUCCESS")) or []
        return sorted(tuple(map(int, _RUN.search(s.getPath().getParent().toString()).groups())) for s in found)

    def _where(self, level: int, run: int) -> str:
        return f"{self.root}/level={level}/run={run}"

    def _write(self, rows: DataFrame, level: int, run: int) -> None:
        single = self.config.single_file_rows > 0 and rows.count() <= self.config.single_file_rows
        sorted_ = (rows.coalesce(1) if single else rows.repartitionByRange("key")).sortWithinPartitions("key", "ts", "seq")
        self._fs().delete(self._path(self._beside("filter", level, run)), True)
        writer = sorted_.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.config.run_bloom_rate))
        writer.parquet(self._where(level, run))
        written = self._load([(level, run)])
        blocks.summary(self.index(level, run), self.config.summary_every).write.mode("overwrite").parquet(self._beside("summary", level, run))
        self._described(written).write.mode("overwrite").parquet(self._beside("meta", level, run))

    def _beside(self, kind: str, level: int, run: int) -> str:
        return f"{self.root}/{kind}/level={level}/run={run}"

    def _described(self, rows: DataFrame) -> DataFrame:
        """first_key, last_key, n, root and leaves of a run: its range and the Merkle root over its values in key order."""
        return blocks.total_range(rows).crossJoin(F.broadcast(merkle.root(rows, ["key", "ts", "seq"])))  # one row and one row

    def metadata(self) -> DataFrame:
        """level, run, first_key, last_key, n, root and leaves of each run."""
        every = self.runs()
        if not every:
            return self.spark.createDataFrame([], "level int, run int, first_key string, last_key string, n bigint, root string, leaves bigint")
        read = self.spark.read.option("basePath", f"{self.root}/meta").parquet(*[self._beside("meta", *r) for r in every])
        return read.select(F.col("level").cast("int"), F.col("run").cast("int"), "first_key", "last_key", "n", "root", "leaves")

    def scan(self, level: int, run: int, start: str | None = None) -> DataFrame:
        """The rows of a run in key order, from a key on if one is given."""
        rows = self._load([(level, run)])
        return (rows if start is None else rows.where(F.col("key") >= start)).orderBy("key", "ts", "seq")

    def index(self, level: int, run: int) -> DataFrame:
        """key, ts, seq, rn and index_offset (rows before it) of each row of a run, its dense index."""
        rows = self._load([(level, run)]).select("key", "ts", "seq")
        return ordered.numbered(rows, ["key", "ts", "seq"]).withColumn("index_offset", F.col("rn") - 1)

    def seek(self, level: int, run: int, start: str, n: int) -> DataFrame:
        """The first n rows of a run from a key on, of the blocks that its summary names."""
        found = self.summary(level, run).where(F.col("last_key") >= start).orderBy("block").limit(n // self.config.summary_every + 2).agg(F.max("last_key")).first()[0]
        return self.scan(level, run, start).where(F.col("key") <= (found or "")).orderBy("key", "ts", "seq").limit(n)

    def filter(self, level: int, run: int) -> DataFrame:
        """The Bloom filter of a run's keys, encoded; written when it is first asked for."""
        where, bloom = self._beside("filter", level, run), self._bloom(level, run)
        if not self._fs().exists(self._path(f"{where}/_SUCCESS")):
            bits = bloom.bits(self._load([(level, run)]), "key")
            codecs.encode(bits, "bloom", m=bloom.m, k=bloom.k).write.mode("overwrite").parquet(where)
        return self.spark.read.parquet(where)

    def _bloom(self, level: int, run: int) -> Bloom:
        n = self.spark.read.parquet(self._beside("meta", level, run)).first().n
        return Bloom.sized(max(1, n), self.config.run_bloom_rate)

    def may_have(self, level: int, run: int, keys: DataFrame) -> DataFrame:
        """item and present: whether each key may be in a run, by its filter alone."""
        bloom = self._bloom(level, run)
        bits = codecs.decode(self.filter(level, run), "bloom", "bit: bigint", m=bloom.m, k=bloom.k)
        return bloom.check(bits, keys, "key")

    def summary(self, level: int, run: int) -> DataFrame:
        """block, first_key, last_key, offset (rows before it) and n of a run's blocks."""
        return self.spark.read.parquet(self._beside("summary", level, run))

    def intact(self, level: int, run: int) -> bool:
        """Whether a run's rows still have the Merkle root that they were written with."""
        stored = self.spark.read.parquet(self._beside("meta", level, run)).first()
        return tuple(self._described(self._load([(level, run)])).first()) == tuple(stored)

    def _runs_with(self, test) -> list[tuple[int, int]]:
        """The runs whose range passes a test, by their metadata, a row for each run."""
        return [(r.level, r.run) for r in self.metadata().where("n > 0").where(test).select("level", "run").collect()]

    def _load(self, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._where(*r) for r in runs])

    @staticmethod
    def _compacted(log: DataFrame, drop_tombstones: bool = False) -> DataFrame:
        """One row per key; all rows of sketches, whose state is their aggregation."""
        kept = scan.is_reserved(F.col("key"))
        return versions.compact(log.where(~kept), drop_tombstones).unionByName(log.where(kept))

    def add(self, log: DataFrame, run: int | None = None) -> int:
        """Writes mutations as a run of level 0 and merges full levels. The same ``run`` again replaces it."""
        if run is None:
            run = max((n for level, n in self.runs() if level == 0), default=-1) + 1
        self._write(self._compacted(log), 0, run)
        self.settle()
        return run

    def settle(self) -> None:
        level = 0
        while level < self.config.levels - 1:
            if sum(at == level for at, _ in self.runs()) >= self.config.level_threshold:
                self.merge(level)
            level += 1

    def merge(self, level: int) -> None:
        """All runs of a level as one run of the next; deletes go where no older run is left."""
        every = self.runs()
        some = [r for r in every if r[0] == level]
        if not some:
            return
        oldest = not any(at > level for at, _ in every)
        run = max((n for at, n in every if at == level + 1), default=-1) + 1
        self._write(self._compacted(self._load(some), drop_tombstones=oldest), level + 1, run)
        for r in some:
            for where in (self._where(*r), *(self._beside(kind, *r) for kind in ("summary", "meta", "filter"))):
                self._fs().delete(self._path(where), True)

    def log(self) -> DataFrame:
        """The rows of all runs."""
        return self._load(self.runs())

    def get(self, key: str) -> DataFrame:
        return scan.get(self._load(self._runs_with(blocks.range_intersects(key, key))), key)

    def prefix_scan(self, prefix: str) -> DataFrame:
        return scan.prefix_scan(self._load(self._runs_with(blocks.prefix_intersects(prefix))), prefix)

    def range_scan(self, start: str, end: str) -> DataFrame:
        return scan.range_scan(self._load(self._runs_with(blocks.range_intersects(start, end))), start, end)
