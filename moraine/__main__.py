"""python -m moraine init | clear | start | run FILE | generate-test-data [--dir DIR] [--config FILE] [--n N]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from moraine.plans.commands import LOG, CommandError, Engine, RateGate
from moraine.sources.config import Config
from moraine.sources.frames import WriteAheadLog
from moraine.sources.store import RunStore


def main(argv: list[str] | None = None, lines=None, out=print) -> int:
    parser = argparse.ArgumentParser(prog="moraine")
    parser.add_argument("action", choices=["init", "clear", "start", "run", "generate-test-data"])
    parser.add_argument("file", nargs="?", help="commands to run, a line each")
    parser.add_argument("--dir", default="moraine-data")
    parser.add_argument("--config", default="moraine.json")
    parser.add_argument("--n", type=int, default=1000, help="entries that generate-test-data puts")
    args = parser.parse_args(argv)
    if args.action == "run" and not args.file:
        parser.error("run needs a file")
    spark, config = SparkSession.builder.appName("moraine").getOrCreate(), Config.load(args.config)
    store = RunStore(spark, args.dir, LOG, config)
    if args.action in ("init", "clear"):
        getattr(store, args.action)()
        return 0
    store.init()
    if args.action == "generate-test-data":
        at = store.log().agg(F.coalesce(F.max("ts"), F.lit(0))).first()[0]
        made = spark.range(args.n).select((F.col("id") + at + 1).alias("ts"), (F.col("id") + at + 1).alias("seq"), F.concat(F.lit("key_"), F.col("id")).alias("key"))
        store.add(made.select("*", F.md5(F.col("key").cast("binary")).alias("value"), F.lit("put").alias("op"), F.lit(False).alias("is_tombstone")))
        return 0
    gate = RateGate(config.bucket_tokens, config.bucket_seconds) if args.action == "start" else None
    try:
        engine, failed = Engine(spark, config=config, gate=gate, store=store, wal=WriteAheadLog(f"{args.dir}/wal", config.wal_segment_bytes)), 0
    except (OSError, ValueError) as e:
        out(described(e))
        return 2
    if lines is None:
        lines = open(args.file, encoding="utf-8") if args.action == "run" else sys.stdin
    for line in filter(str.strip, lines):
        try:
            printed = engine.execute(line.strip())
            for row in printed.toLocalIterator() if printed is not None else ():
                out(f"{row.key}: {row.value}")
        except (CommandError, OSError) as e:
            failed += 1
            out(described(e))
        if not engine.running:
            break
    return int(args.action == "run" and failed > 0)


def described(error: BaseException) -> str:
    """An error and what caused it, one line each."""
    out = [f"error: {error}"]
    while (error := error.__cause__ or error.__context__) is not None:
        out.append(f"caused by: {error}")
    return "\n".join(out)


if __name__ == "__main__":
    sys.exit(main())
