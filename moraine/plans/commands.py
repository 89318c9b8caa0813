"""The command language: a line becomes a plan over the versioned log.

``put K V``, ``delete K``, ``get K``, ``list PREFIX [PAGE SIZE]``,
``range-scan START END [PAGE SIZE]``, ``bf new|add|check``, ``hll new|add|count``,
``cms new|add|count``, ``sh hash|similarity``, ``help``, ``quit``. Values with
spaces are quoted. A sketch is a key whose log rows are what was added to it
since its last ``new``, so its state is an aggregation over the log.
"""

from __future__ import annotations

import json
import shlex
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import simhash
from moraine.functions.sketches import Bloom, CountMin, HyperLogLog
from moraine.operators import scan, versions
from moraine.sources.config import Config
from moraine.sources.frames import WriteAheadLog
from moraine.sources.store import RunStore

LOG = "ts bigint, seq bigint, key string, value string, op string, is_tombstone boolean"
RESULT = "key string, value string"
HELP = __doc__.split("\n\n")[1]


class CommandError(ValueError):
    """A line that is no command, or a command that its key doesn't allow."""


@dataclass(frozen=True)
class Command:
    name: str
    args: tuple[str, ...]


#: name -> (fewest, most) arguments
_ARITY = {
    "put": (2, 2), "delete": (1, 1), "get": (1, 1), "list": (1, 3), "range-scan": (2, 4), "help": (0, 0), "quit": (0, 0),
    "bf new": (1, 1), "bf add": (2, 2), "bf check": (2, 2), "hll new": (1, 1), "hll add": (2, 2), "hll count": (1, 1),
    "cms new": (1, 1), "cms add": (2, 2), "cms count": (1, 2), "sh hash": (2, 2), "sh similarity": (2, 2),
}
_PREFIX = {"bf": "bf_", "hll": "hll_", "cms": "cms_", "sh": "sh_"}


def parse(line: str) -> Command:
    """A line as a command; CommandError says what is wrong with it."""
    try:
        words = shlex.split(line)
    except ValueError as e:
        raise CommandError(f"{line!r}: {e}") from None
    if not words:
        raise CommandError("an empty line is no command")
    name = " ".join(words[:2]) if words[0] in _PREFIX and len(words) > 1 else words[0]
    if name not in _ARITY:
        raise CommandError(f"unknown command {name!r}")
    args = tuple(words[len(name.split()) :])
    least, most = _ARITY[name]
    paged = len(args) - least
    if not least <= len(args) <= most or (name in ("list", "range-scan") and paged == 1):
        raise CommandError(f"{name} takes {least} to {most} arguments" + ", page and size together" * (most - least == 2))
    group = name.split()[0]
    if group in _PREFIX:
        for key in args if name == "sh similarity" else args[:1]:
            if not key.startswith(_PREFIX[group]):
                raise CommandError(f"{name} needs a key that starts with {_PREFIX[group]}")
    elif name in ("put", "delete") and args[0].startswith(tuple(scan.RESERVED)):
        raise CommandError(f"the key {args[0]} is reserved for sketches")
    return Command(name, args)


@dataclass
class RateGate:
    """A bucket of tokens for data commands, refilled whole at the first command after its interval."""

    capacity: int
    interval: float
    clock: Callable[[], float] = time.monotonic
    tokens: int = field(init=False)
    last: float = field(init=False)

    def __post_init__(self):
        self.tokens, self.last = self.capacity, self.clock()

    def take(self, n: int = 1) -> bool:
        now = self.clock()
        if now - self.last >= self.interval:
            self.tokens, self.last = self.capacity, now
        if self.tokens < n:
            return False
        self.tokens -= n
        return True


class Engine:
    """Commands over a log: a base table and the mutations since then.

    With a write-ahead log each mutation is written there first, and opening
    takes up the mutations that it holds. With a store, ``memtable_keys``
    distinct keys of mutations become a run of it, and the log is purged. A
    crash in between is harmless: entries not newer than the runs are left out.
    Looked-up values are kept in a cache of ``cache_entries`` keys.
    """

    def __init__(self, spark: SparkSession, base: DataFrame | None = None, config: Config | None = None, gate: RateGate | None = None, store: RunStore | None = None, wal: WriteAheadLog | None = None):
        self.spark, self.config, self.gate, self.store, self.wal = spark, config or Config(), gate, store, wal
        self.base = base if base is not None or store is None else store.log()
        self.pending: list[tuple] = []
        #: Distinct keys of the mutations, and the time of each looked-up sketch's last new (None: there was none).
        self.held: set[str] = set()
        self.begun: dict[str, tuple[int, int] | None] = {}
        self.cache: OrderedDict[str, str | None] = OrderedDict()
        self.running = True
        self.clock = 0 if self.base is None else int(self.base.agg(F.coalesce(F.max("ts"), F.lit(0))).first()[0])
        for ts, key, data in wal.entries() if wal else ():
            if ts > self.clock:
                op, value = ("delete", None) if data is None else json.loads(data)
                self.pending.append((ts, ts, key.decode(), value, op, op == "delete"))
                self.held.add(key.decode())
                self.clock = ts

    def flush(self) -> None:
        """Writes the mutations as a run and purges the log."""
        if self.store is not None and self.pending:
            self.store.add(self.spark.createDataFrame(self.pending, LOG))
            self.base, self.pending = self.store.log(), []
            self.held.clear()
            if self.wal is not None:
                self.wal.purge()

    def log(self) -> DataFrame:
        new = self.spark.createDataFrame(self.pending, LOG)
        return new if self.base is None else self.base.unionByName(new)

    def view(self) -> DataFrame:
        """The log without the rows of sketches."""
        return self.log().where("op in ('put', 'delete')")

    def _append(self, key: str, value: str | None, op: str) -> None:
        self.clock += 1
        if self.wal is not None:
            self.wal.append(self.clock, key.encode(), None if op == "delete" else json.dumps([op, value]).encode())
        self.pending.append((self.clock, self.clock, key, value, op, op == "delete"))
        self.held.add(key)
        self.cache.pop(key, None)
        if self.store is not None and len(self.held) >= self.config.memtable_keys:
            self.flush()

    def _said(self, key: str, value: str) -> DataFrame:
        return self.spark.createDataFrame([(key, value)], RESULT)

    def _begun(self, key: str) -> tuple[int, int] | None:
        """The ts and seq at which a sketch was last made new; the log is asked once a key."""
        if key not in self.begun:
            newest = self.log().where((F.col("key") == key) & (F.col("op") == "new")).agg(F.max(F.struct("ts", "seq"))).first()[0]
            self.begun[key] = newest and (newest.ts, newest.seq)
        return self.begun[key]

    def _added(self, key: str) -> DataFrame | None:
        """item: what was added to a sketch since its last new, or None if there was none."""
        begun = self._begun(key)
        if begun is None:
            return None
        later = F.struct("ts", "seq") > F.struct(*[F.lit(x).cast("bigint") for x in begun])
        return self.log().where((F.col("key") == key) & (F.col("op") == "add") & later).select(F.col("value").alias("item"))

    def execute(self, line: str) -> DataFrame | None:
        """Runs a line: its result (key, value), or None where it prints nothing."""
        command = parse(line)
        if command.name == "quit":
            self.running = False
            return None
        if command.name == "help":
            return self._said("help", HELP)
        if self.gate is not None and not self.gate.take():
            return self._said(command.name, "rate limit reached")
        return getattr(self, "_" + command.name.replace(" ", "_").replace("-", "_"))(*command.args)

    def _put(self, key, value):
        self._append(key, value, "put")

    def _delete(self, key):
        self._append(key, None, "delete")

    def find(self, key: str) -> str | None:
        """The value of a key, or None; from the cache where it is there."""
        if key not in self.cache:
            # A key has one row.
            found = scan.get(self.view(), key).select("value").collect()
            self.cache[key] = found[0].value if found else None
        self.cache.move_to_end(key)
        while len(self.cache) > self.config.cache_entries:
            self.cache.popitem(last=False)
        return self.cache[key]

    def _get(self, key):
        value = self.find(key)
        return self._said(key, "Key not found" if value is None else value)

    def _scan(self, view, paging):
        if paging:
            try:
                number, size = map(int, paging)
            except ValueError:
                raise CommandError("page and size are numbers") from None
            view = scan.page(view, number, size)
        return view.orderBy("key").select("key", "value")

    def _list(self, prefix, *paging):
        return self._scan(scan.prefix_scan(self.view(), prefix), paging)

    def _range_scan(self, start, end, *paging):
        return self._scan(scan.range_scan(self.view(), start, end), paging)

    def _new(self, key):
        self._append(key, None, "new")
        self.begun[key] = (self.clock, self.clock)

    _bf_new = _hll_new = _cms_new = _new

    def _add(self, key, value):
        if self._begun(key) is None:
            return self._said(key, "Key not found")
        self._append(key, value, "add")
        return None

    _bf_add = _hll_add = _add

    def _bf_check(self, key, value):
        items = self._added(key)
        if items is None:
            return self._said(key, "Key not found")
        bloom = Bloom.sized(self.config.bloom_items, self.config.bloom_rate)
        checked = bloom.check(bloom.bits(items, "item"), self.spark.createDataFrame([(value,)], "item string"), "item")
        return checked.select(F.lit(key).alias("key"), F.when(F.col("present"), "present").otherwise("not present").alias("value"))

    def _hll_count(self, key):
        items = self._added(key)
        if items is None:
            return self._said(key, "Key not found")
        hll = HyperLogLog(self.config.hll_bits)
        return hll.count(hll.registers(items, "item")).select(F.lit(key).alias("key"), F.round("estimate", 4).cast("string").alias("value"))

    def _cms_add(self, key, value):
        return self._add(key, value) or self._cms_count(key, value)

    def _cms_count(self, key, item=""):
        items = self._added(key)
        if items is None:
            return self._said(key, "Key not found")
        cms = CountMin.sized(self.config.cms_accuracy, self.config.cms_certainty)
        counted = cms.count(cms.matrix(items, "item"), self.spark.createDataFrame([(item,)], "item string"), "item")
        return counted.select(F.lit(key).alias("key"), F.col("estimate").cast("string").alias("value"))

    def _sh_hash(self, key, text):
        self._append(key, text, "hash")

    def _sh_similarity(self, left, right):
        texts = versions.latest(self.log().where(F.col("op") == "hash").where(F.col("key").isin(left, right))).select("key", F.col("value").alias("text"))
        fps = {r.key: r for r in simhash.fingerprints(texts, "key", stopwords=self.config.stopwords).collect()}  # two rows at most
        for key in (left, right):
            if key not in fps:
                return self._said(key, "Key not found")
        a, b = fps[left], fps[right]
        differ = bin(a.fp_hi ^ b.fp_hi).count("1") + bin(a.fp_lo ^ b.fp_lo).count("1")
        return self._said(left, str(1 - differ / 64))


def run_script(spark: SparkSession, lines: Iterable[str], base: DataFrame | None = None, config: Config | None = None) -> DataFrame:
    """line, key and value of what the commands print, lines numbered from 1, up to ``quit``."""
    engine, out = Engine(spark, base, config), None
    for n, line in enumerate(lines, 1):
        if not line.strip():
            continue
        printed = engine.execute(line)
        if printed is not None:
            printed = printed.select(F.lit(n).alias("line"), "key", "value")
            out = printed if out is None else out.unionByName(printed)
        if not engine.running:
            break
    return spark.createDataFrame([], "line int, " + RESULT) if out is None else out
