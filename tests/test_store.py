"""Runs, segments, streams and the command line; what the catalog's oracles don't reach."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from moraine.__main__ import described, main
from moraine.functions import codecs, simhash
from moraine.functions.sketches import Bloom, CountMin, HyperLogLog
from moraine.operators import folds, scan, versions
from moraine.plans.commands import LOG, CommandError, Engine, RateGate, parse, run_script
from moraine.sources import frames
from moraine.sources.config import Config
from moraine.sources.store import RunStore
from moraine.streaming import ingest

SCHEMA = "ts bigint, seq bigint, key string, value string, is_tombstone boolean"


def log(spark, rows):
    return spark.createDataFrame([(t, t, k, v, v is None) for t, k, v in rows], SCHEMA)


def live(df):
    return {r.key: r.value for r in df.collect()}


def test_store_merges_and_keeps_results(spark, tmp_path):
    store, r, want = RunStore(spark, str(tmp_path / "s"), SCHEMA, Config(level_threshold=2, levels=3)), random.Random(1), {}
    store.init()
    for n in range(5):
        rows = [(10 * n + i, str(r.randrange(12)), None if r.random() < 0.3 else f"v{n}{i}") for i in range(8)]
        store.add(log(spark, rows))
        want |= {k: v for _, k, v in rows}
    assert live(versions.current(store.log())) == {k: v for k, v in want.items() if v is not None}
    assert store.runs() == [(0, 0), (2, 0)]
    for k, v in want.items():
        assert live(store.get(k)) == ({} if v is None else {k: v})
    assert live(store.range_scan("1", "5")) == {k: v for k, v in want.items() if v is not None and "1" <= k <= "5"}
    assert live(store.prefix_scan("1")) == {k: v for k, v in want.items() if v is not None and k.startswith("1")}
    store.clear()
    assert store.runs() == [] and store.log().count() == 0


def test_compaction_is_idempotent(spark):
    rows = log(spark, [(1, "a", "x"), (2, "a", None), (3, "b", "y"), (2, "b", "old"), (5, "c", None)])
    once = versions.compact(rows)
    assert sorted(map(tuple, versions.compact(once).collect())) == sorted(map(tuple, once.collect()))
    assert live(versions.current(once)) == live(versions.current(rows)) == {"b": "y"}


def test_segments(spark, tmp_path):
    entries = [(i, f"k{i}é".encode(), None if i % 7 == 0 else b"v" * (i * 13 % 60)) for i in range(100)]
    packed = list(frames.segments(entries, 500))
    for n, data in enumerate(packed):
        (tmp_path / f"segment-{n}").write_bytes(data)
    (tmp_path / "segment-x").write_bytes(b"no segment")
    got = frames.read_segments(spark, str(tmp_path)).orderBy("segment", "seq").collect()
    assert [(r.ts, r.key.encode(), None if r.value is None else bytes(r.value)) for r in got] == entries
    with pytest.raises(ValueError, match="damaged"):
        list(frames.decode(packed[0][:20] + b"\xff" + packed[0][21:]))
    with pytest.raises(ValueError, match="fits no"):
        list(frames.segments([(1, b"k", b"v" * 600)], 500))


def test_streams(spark, tmp_path):
    requests = [(k, t, t) for t, k in enumerate("aabaaabbaaaabbba")]
    frame = spark.createDataFrame(requests, "key string, ts bigint, seq bigint")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.token_bucket(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), 2, 5)
    query = stream.writeStream.format("memory").queryName("bucket").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = folds.token_bucket(frame, "key", ["ts", "seq"], "ts", 2, 5)
    assert sorted(map(tuple, spark.table("bucket").collect())) == sorted(map(tuple, want.collect()))

    store = RunStore(spark, str(tmp_path / "s"), SCHEMA)
    for n, rows in enumerate(([(1, "a", "x"), (2, "b", "y")], [(3, "a", None)])):
        log(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        ingest.ingest(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "log")), store, str(tmp_path / "c2")).awaitTermination(60)
        assert live(versions.current(store.log())) == [{"a": "x", "b": "y"}, {"b": "y"}][n]


def test_command_line(spark, tmp_path):
    said, at = [], ["--dir", str(tmp_path / "d"), "--config", str(tmp_path / "none")]
    (tmp_path / "script").write_text("put k one\nbf new bf_x\nbf add bf_x pear\nnonsense\nget k\n")
    assert main(["init", *at]) == 0 and main(["run", str(tmp_path / "script"), *at], out=said.append) == 1
    assert said[-1] == "k: one" and said[0].startswith("error")
    said.clear()
    assert main(["start", *at], lines=["get k", "bf check bf_x pear", "quit", "get k"], out=said.append) == 0
    assert said == ["k: one", "bf_x: present"]


def test_parser_and_script(spark):
    for line in ("", "nope", "get", "list a 1", "bf add x y", "put bf_x v", 'put "a'):
        with pytest.raises(CommandError):
            parse(line)
    got = [tuple(r) for r in run_script(spark, ["hll count hll_x", "put a 'two words'", "get a", "quit", "get a"]).collect()]
    assert got == [(1, "hll_x", "Key not found"), (3, "a", "two words")]


def test_rate_gate():
    now = [0.0]
    gate = RateGate(5, 2.0, lambda: now[0])
    assert gate.take() and gate.tokens == 4 and not gate.take(10)
    now[0] = 2.0
    assert gate.take(5) and not gate.take()


def test_config(tmp_path):
    Config(hll_bits=12).save(str(tmp_path / "c"))
    assert Config.load(str(tmp_path / "c")) == Config(hll_bits=12) and Config.load(str(tmp_path / "no")) == Config()
    with pytest.raises(ValueError):
        Config(hll_bits=3)


def test_sketch_properties(spark):
    items = spark.createDataFrame([(f"i{i % 300}",) for i in range(2000)], "item string")
    bloom, cms, hll = Bloom.sized(300, 0.01), CountMin.sized(), HyperLogLog(10)
    assert all(r.present for r in bloom.check(bloom.bits(items, "item"), items, "item").collect())
    truth = {r["item"]: r["count"] for r in items.groupBy("item").count().collect()}
    assert all(r.estimate >= truth[r["item"]] for r in cms.count(cms.matrix(items, "item"), items, "item").collect())
    assert abs(hll.count(hll.registers(items, "item")).first().estimate - 300) < 3 * 300 * 1.04 / 32


def test_write_ahead_log(tmp_path):
    folder, entries = str(tmp_path / "wal"), [(i, f"k{i}".encode(), None if i % 5 == 0 else b"v" * i) for i in range(1, 40)]
    wal = frames.WriteAheadLog(folder, 300)
    for e in entries[:20]:
        wal.append(*e)
    wal = frames.WriteAheadLog(folder, 300)  # goes on where it was
    for e in entries[20:]:
        wal.append(*e)
    assert list(wal.entries()) == entries and wal.segments() == list(range(wal.index + 1)) and wal.index > 2
    with pytest.raises(ValueError, match="fits no"):
        wal.append(99, b"k", b"v" * 400)
    last = tmp_path / "wal" / f"segment-{wal.index}"
    last.write_bytes(last.read_bytes()[:-3])  # a crash in the middle of a write
    wal = frames.WriteAheadLog(folder, 300)
    assert list(wal.entries()) == entries[:-1]
    wal.append(*entries[-1])
    assert list(wal.entries()) == entries
    before = wal.index
    wal.purge()
    assert wal.segments() == [] and wal.index == before + 1
    wal.append(*entries[0])
    assert list(wal.entries()) == entries[:1]
    (tmp_path / "wal" / f"segment-{wal.index + 2}").write_bytes(b"")
    with pytest.raises(frames.SegmentGap):
        frames.WriteAheadLog(folder, 300)


def test_engine_survives_a_crash(spark, tmp_path):
    config = Config(memtable_keys=4, cache_entries=2)

    def opened():
        return Engine(spark, config=config, store=RunStore(spark, str(tmp_path / "s"), LOG, config), wal=frames.WriteAheadLog(str(tmp_path / "wal"), 20_000))

    def value(engine, key):
        return engine.execute(f"get {key}").first().value

    engine = opened()
    for line in ("put a 1", "put b 2", "cms new cms_x", "cms add cms_x pear"):
        engine.execute(line)
    assert engine.store.runs() == [] and value(engine, "a") == "1"
    engine.execute("put a 3")  # not from the cache
    assert value(engine, "a") == "3"
    engine = opened()  # nothing was flushed: all comes from the log
    assert len(engine.pending) == 5 and (value(engine, "a"), value(engine, "b")) == ("3", "2")
    engine.execute("delete b")
    engine.execute("put d 4")
    assert engine.store.runs() == [(0, 0)] and engine.pending == [] and list(engine.wal.entries()) == []
    engine = opened()
    assert (value(engine, "a"), value(engine, "b"), value(engine, "d")) == ("3", "Key not found", "4")
    assert engine.execute("cms count cms_x pear").first().value == "1" and list(engine.cache) == ["b", "d"]
    # Flushed, but the log not purged: its entries don't count twice.
    for ts, key, op in ((3, "cms_x", "new"), (4, "cms_x", "add")):
        engine.wal.append(ts, key.encode(), f'["{op}", "pear"]'.encode())
    assert opened().pending == []


def test_runs_have_metadata(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"), SCHEMA, Config(summary_every=3))
    store.init()
    assert store.metadata().count() == 0
    store.add(log(spark, [(i, f"a{i}", f"v{i}") for i in range(8)]))
    store.add(log(spark, [(100 + i, f"m{i}", None if i == 2 else "w") for i in range(5)]))
    meta = {(r.level, r.run): r for r in store.metadata().collect()}
    assert [(r.first_key, r.last_key, r.n, r.leaves) for _, r in sorted(meta.items())] == [("a0", "a7", 8, 8), ("m0", "m4", 5, 5)]
    assert meta[0, 0].root != meta[0, 1].root and store.intact(0, 0) and store.intact(0, 1)
    assert [(r.block, r.first_key, r.last_key, r.offset, r.n) for r in store.summary(0, 0).orderBy("block").collect()] == [(0, "a0", "a2", 0, 3), (1, "a3", "a5", 3, 3), (2, "a6", "a7", 6, 2)]
    for found, runs in ((store.get("m1"), {"run=1"}), (store.range_scan("a3", "b"), {"run=0"}), (store.prefix_scan("m"), {"run=1"})):
        assert {part for f in found.inputFiles() for part in f.split("/") if part.startswith("run=")} == runs  # the other run isn't read
    assert store.get("zzz").count() == 0
    log(spark, [(i, f"a{i}", "changed") for i in range(8)]).write.mode("overwrite").parquet(str(tmp_path / "s" / "level=0" / "run=0"))
    assert not store.intact(0, 0)


def test_settings_and_data(spark, tmp_path):
    at = ["--dir", str(tmp_path / "d"), "--config", str(tmp_path / "c")]
    Config(stopwords=("noise",)).save(str(tmp_path / "c"))
    assert main(["generate-test-data", "--n", "30", *at]) == 0
    said = []
    assert main(["start", *at], lines=["get key_7", "sh hash sh_a 'pear noise'", "sh hash sh_b 'pear'", "sh similarity sh_a sh_b", "help", "get"], out=said.append) == 0
    assert len(said[0]) == len("key_7: ") + 32 and said[1] == "sh_a: 1.0" and said[2].startswith("help") and said[3].startswith("error")
    try:
        try:
            raise OSError("no disk")
        except OSError as e:
            raise ValueError("no log") from e
    except ValueError as e:
        assert described(e) == "error: no log\ncaused by: no disk"


def test_fingerprint_of_a_long_text(spark):
    text = " ".join(f"w{i % 7}" for i in range((1 << 20) + 5000))  # more than a block of counters
    short = " ".join(f"w{i}" for i in range(7) for _ in range(3))
    rows = simhash.fingerprints(spark.createDataFrame([(1, text), (2, short), (3, None)], "id int, text string"), "id").collect()
    got = {r.id: (r.fp_hi, r.fp_lo) for r in rows}

    def want(words):
        sums = [sum((1 if int(hashlib.md5(w.encode()).hexdigest()[:16], 16) >> i & 1 else -1) * n for w, n in Counter(words).items()) for i in range(64)]
        fp = sum(1 << i for i, s in enumerate(sums) if s > 0)
        return fp >> 32, fp & 0xFFFFFFFF

    assert got == {1: want(text.split()), 2: want(short.split()), 3: (0, 0)}


def test_codecs_and_run_files(spark, tmp_path):
    bits = spark.createDataFrame([(i,) for i in (1, 5, 9)], "bit bigint")
    encoded = codecs.encode(bits, "bloom", m=16, k=2)
    assert sorted(r.bit for r in codecs.decode(encoded, "bloom", "bit: bigint", m=16, k=2).collect()) == [1, 5, 9]
    assert codecs.decode(codecs.encode(bits.limit(0), "bloom", m=16, k=2), "bloom", "bit: bigint", m=16, k=2).count() == 0
    for damaged, m in ((encoded.withColumn("crc", F.col("crc") + 1), 16), (encoded, 32)):
        with pytest.raises(Exception, match="damaged"):
            codecs.decode(damaged, "bloom", "bit: bigint", m=m, k=2).collect()
    store = RunStore(spark, str(tmp_path / "s"), SCHEMA, Config(single_file_rows=100, summary_every=4))
    store.init()
    store.add(log(spark, [(i, f"k{i:02d}", f"v{i}") for i in range(30)]).repartition(5))
    assert len(store._load([(0, 0)]).inputFiles()) == 1
    assert [r.key for r in store.scan(0, 0, "k25").collect()] == [f"k{i}" for i in range(25, 30)]
    assert [r.key for r in store.seek(0, 0, "k07", 9).collect()] == [f"k{i:02d}" for i in range(7, 16)] and store.seek(0, 0, "z", 3).count() == 0
    asked = spark.createDataFrame([("k03",), ("k29",), ("absent",)], "key string")
    for _ in range(2):  # the second time the filter is read
        found = {r["item"]: r.present for r in store.may_have(0, 0, asked).collect()}
        assert found["k03"] and found["k29"] and len(found) == 3


def test_pages_of_any_depth(spark):
    view = spark.range(57).select(F.format_string("k%03d", F.col("id")).alias("key"), (F.col("id") * 2).alias("rn")).repartition(5)
    for number, size in [(0, 5), (1, 10), (4, 7), (6, 10), (7, 10), (2, 57)]:
        flat, deep = ([(r.key, r.rn) for r in scan.page(view, number, size, held).collect()] for held in (10**6, 0))
        assert flat == deep, (number, size)


def test_sketches_begin_anew(spark):
    engine = Engine(spark)

    def say(line):
        said = engine.execute(line)
        return [] if said is None else [r.value for r in said.collect()]

    assert say("bf add bf_a x") == ["Key not found"] and say("bf new bf_a") == [] == say("bf add bf_a x")
    assert say("bf check bf_a x") == ["present"] and say("bf new bf_a") == [] and say("bf check bf_a x") == ["not present"]
    again = Engine(spark, engine.log())
    assert again._begun("bf_a") == engine.begun["bf_a"] and again._begun("bf_b") is None
