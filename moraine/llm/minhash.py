"""Operator 4: near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch: ``T`` bins are filled in rounds. In round i < T every shingle is hashed
into one bin with a value in [i, i+1); in rounds T..2T-1 every shingle goes to
bin i - T; each bin keeps its smallest value. After the last round every bin is
full, whatever the size of the set, and bins of two sets agree with probability
equal to their Jaccard similarity, with the concentration of independent draws.

Bands of ``ROWS`` bins make bucket keys. A pair at similarity s shares each band
with probability s**7, and there are as many bands as it takes for a pair just at
the threshold to miss all of them with probability ``MISS`` at most (69 at 0.8,
42 at 0.85).

A parity sketch of each set (of each of ``PARITY`` bits, whether an odd number of
shingles falls on it) bounds pairs exactly: the bits in which two sketches
differ are never more than the shingles in which the sets differ, and a link
allows (100 - percent) / (100 + percent) of the two sizes' sum. Pairs beyond that
are dropped before their texts are looked at.

Links are confirmed on the full shingle sets. Not all pairs of a bucket are
needed for the groups: texts with the same words are one node; in each bucket
nodes are compared with one representative; and groups found so far are taken
together. Nodes of different groups that share a bucket go on, in rounds of more
and more representatives: a representative is compared with every node of its
bucket that isn't of its group and then leaves the bucket, and a bucket whose
nodes are of one group is done. So a bucket of copies is done after one round,
all others end with every pair compared, and what a task holds for a bucket is a
bounded list of representatives, while its nodes may lie in any number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import Workspace, fresh, map_texts, release, table, text_key
from moraine.llm.graph import components

T, ROWS, PARITY, FOLD, MISS = 512, 7, 2048, 4, 1e-7
#: Keys up to which they are broadcast to thin out the rows before a shuffle.
BROADCAST_KEYS = 500_000
#: Representatives of a bucket in its second round at most, and by how much more each round takes, up to MOST.
REPRESENTATIVES, MOST = 8, 1024
_MEMO = 100_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.arange(1, 2 * T + 1, dtype=np.uint64) * _GOLD) ^ np.uint64(0xD1B54A32D192ED03)
# A bin, a round and a value in 64 bits.
_BIN_BITS = T.bit_length() - 1
_VALUE_BITS = 64 - _BIN_BITS - (_BIN_BITS + 1)
_ROUND = np.arange(2 * T, dtype=np.uint64) << np.uint64(_VALUE_BITS)
_VALUE = np.uint64((1 << _VALUE_BITS) - 1)
_BIN = ~np.uint64((1 << (64 - _BIN_BITS)) - 1)
#: Hashes made at once for a sketch: with this many most sets fill their bins.
_AT_ONCE = 4400


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased; other letters stay."""
    return text.encode("utf-8", "replace").lower().split()


def shingles(found: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter."""
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    k = min(k, len(h))
    x = h[: len(h) - k + 1] + np.uint64(k * int(_GOLD) % (1 << 64))
    for j in range(1, k):
        x = _mix(x) + h[j : len(h) - k + 1 + j]
    return np.unique(_mix(x))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The T bins of a non-empty set, each as round << 49 | value."""
    bins, full, i = np.zeros(T, np.uint64), np.zeros(T, bool), 0
    while not full.all():
        r = min(T - i, max(1, -(-_AT_ONCE // len(hashes)))) if i < T else T
        x = _mix(hashes[None, :] + _SEEDS[i : i + r, None])
        if i < T:
            packed = np.sort(((x & _BIN) | _ROUND[i : i + r, None] | ((x >> np.uint64(4)) & _VALUE)).ravel())
            at = packed >> np.uint64(64 - _BIN_BITS)
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            which, value = at[first].astype(np.int64), packed[first] & ~_BIN
            new = ~full[which]
            bins[which[new]], full[which[new]] = value[new], True
        else:
            value = ((x >> np.uint64(4)) & _VALUE).min(axis=1) | _ROUND[T:]
            bins[~full], full[:] = value[~full], True
        i += r
    return bins


def n_bands(percent: int) -> int:
    """Bands for a threshold, as many as the sketch has for very low ones."""
    hit = (percent / 100) ** ROWS
    return max(1, min(T // ROWS, ceil(log(MISS) / log1p(-hit)) if 0 < hit < 1 else 1))


def bands(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket keys of a non-empty set, one for each of n bands, as signed 64-bit integers."""
    rows = sketch(hashes)[: n * ROWS].reshape(n, ROWS)
    x = np.arange(1, n + 1, dtype=np.uint64) * _GOLD
    for j in range(ROWS):
        x = _mix(x + rows[:, j])
    return x.view(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray:
    """The parity sketch of a set as signed 64-bit integers, after its fold to ``FOLD`` of them."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (PARITY - 1), minlength=PARITY) & 1
    odd = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return np.concatenate((np.bitwise_xor.reduce(odd.reshape(-1, FOLD)), odd))


def _may_link(percent: int, n_a: Column, n_b: Column, odd_a: Column, odd_b: Column) -> Column:
    """Whether sizes and parity sketches of two sides leave room for a link; folded sketches, which tell most, first."""
    room = (100 - percent) * (n_a + n_b)
    few = sum((F.bit_count(F.get(odd_a, F.lit(i)).bitwiseXOR(F.get(odd_b, F.lit(i)))) for i in range(FOLD)), F.lit(0))
    both = F.aggregate(F.zip_with(odd_a, odd_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * few <= room) & ((100 + percent) * (both - few) <= room)


def _signatures(docs: DataFrame, k: int, n: int) -> DataFrame:
    """doc_id, text_key, words_key, n_shingles, keys and odd (null without words), a row for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("words_key", pa.binary()), ("n_shingles", pa.int64()), ("keys", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, digests, sizes, keys, odd = {}, [], [], [], []
            for scalar in batch.column(1):
                found = words(scalar.as_py() or "")
                digest = xxhash.xxh3_128_digest(b" ".join(found)) if found else None
                if digest not in made:
                    s = shingles(found, k)
                    made[digest] = (len(s), bands(s, n), parity(s)) if len(s) else (0, None, None)
                digests.append(digest)
                sizes.append(made[digest][0])
                keys.append(made[digest][1])
                odd.append(made[digest][2])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], schema=schema)
        _WORDS.clear()
        release()

    ddl = "doc_id bigint, text_key binary, words_key binary, n_shingles bigint, keys array<bigint>, odd array<bigint>"
    return map_texts(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), text_key(F.col("text").cast("string")).alias("text_key")), run, ddl)


def _confirmed(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of (a, b, text_a, text_b) with 100 * intersection >= percent * union, as (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, np.empty(0, np.uint64)
        for batch in batches:
            kept = []
            for a, b, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if b != last:
                    last, other = b, shingles(words(text_b.as_py()), k)
                mine = shingles(words(text_a.as_py()), k)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in kept], pa.int64()) for j in (0, 1)], schema=schema)
        _WORDS.clear()
        release()

    return map_texts(pairs.select("a", "b", "text_a", "text_b"), run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_key, a row for each row of docs.

    Sets are the distinct k-word shingles; sets with 100 * intersection >=
    percent * union are linked, component_id is the smallest doc_id reachable
    and kept says that the row has it. Texts that are null or without words are
    linked with nothing and kept, also where they repeat. Rows with equal words
    are linked. Repeated rows share their values, so the kept row of a group
    may repeat. A null doc_id is larger than any other. Needs only doc_id and
    text. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "near-duplicates")
    n_keys = n_bands(percent)
    signed = work.write(_signatures(docs, k, n_keys), "signed")
    size = signed.count()
    classes = signed.where("keys is not null").groupBy("words_key").agg(
        F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.first("keys").alias("keys"), F.first("odd").alias("odd"), F.first("n_shingles").alias("n")
    )
    classes = work.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes", 16 * size)

    # Tables that are joined by bucket are written before: then Spark can split a bucket that most nodes are in.
    placed = classes.select("node", F.explode("keys").alias("h"))
    shared = placed.groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("rep")).where("c > 1").select("h", "rep")
    shared = work.write(shared, "shared", n_keys * size // 2)
    now = work.write(placed.join(shared, "h").where("node <> rep"), "members", n_keys * size)
    left = now.count()
    checked = work.write(now.select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct(), "pairs", left)

    # The nodes in shared buckets and their texts, one each.
    nodes = checked.select(F.col("a").alias("node")).unionByName(checked.select(F.col("b").alias("node"))).distinct()
    wanted = work.write(classes.join(nodes, "node", "left_semi").select("node", "text_key", "odd", "n"), "wanted", 16 * size)
    texts = docs.select(F.col("text").cast("string"), text_key(F.col("text").cast("string")).alias("text_key")).where("text is not null")
    if wanted.count() <= BROADCAST_KEYS:
        short = wanted.select(F.xxhash64("text_key").alias("short")).distinct()
        texts = texts.withColumn("short", F.xxhash64("text_key")).join(F.broadcast(short), "short", "left_semi")
    texts = texts.groupBy("text_key").agg(F.first("text").alias("text"))
    texts = work.write(texts.join(wanted.select("text_key", "node"), "text_key").select("node", "text"), "texts", 8 * size)

    sides = wanted.select("node", "odd", "n")

    def check(pairs: DataFrame, rows: int) -> DataFrame:
        """The links among (a, b) nodes."""
        needed = texts
        if rows <= BROADCAST_KEYS:  # few pairs don't shuffle all texts
            ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
            needed = texts.join(F.broadcast(ids), "node", "left_semi")
        full = pairs.join(needed.toDF("a", "text_a"), "a").join(needed.toDF("b", "text_b"), "b")
        return work.write(_confirmed(full, k, percent), "links", 64 * rows)

    rows = checked.count()
    may = _may_link(percent, F.col("n_a"), F.col("n_b"), F.col("odd_a"), F.col("odd_b"))
    sized = checked.join(sides.toDF("a", "odd_a", "n_a"), "a").join(sides.toDF("b", "odd_b", "n_b"), "b").where(may).select("a", "b")
    sized = work.write(sized, "sized", 4 * rows)
    groups = components(check(sized, sized.count()).toDF("u", "v"), work, rows=rows)

    going, most = now.select("h", "node"), REPRESENTATIVES
    while left:
        now = work.write(going.join(groups, "node", "left").select("h", "node", F.coalesce("component", "node").alias("group")), "going", left)
        slot = F.pmod(F.xxhash64("node", F.lit(most)), F.lit(most))
        several = now.groupBy("h").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("h")
        top = now.join(several, "h", "left_semi").groupBy("h", slot.alias("slot")).agg(F.min("node").alias("rep"))
        top = work.write(top, "open", left)
        if top.isEmpty():
            break
        # Nodes and representatives with their sketches: only pairs that these leave room for are made at all.
        facing = now.withColumn("slot", slot).join(top, ["h", "slot"]).withColumn("is_rep", F.col("node") == F.col("rep")).drop("rep")
        facing = work.write(facing.join(sides, "node"), "facing", 4 * left)
        # At most MOST of a bucket: a task that collects lists holds many.
        reps = facing.where("is_rep").groupBy("h").agg(F.collect_list(F.struct("node", "group", "odd", "n")).alias("reps"))
        reps = work.write(reps, "representatives", 4 * left)
        meet = lambda r: (r["node"] != F.col("node")) & (r["group"] != F.col("group")) & _may_link(percent, r["n"], F.col("n"), r["odd"], F.col("odd"))
        pairs = facing.join(reps, "h").select("node", F.explode(F.transform(F.filter("reps", meet), lambda r: r["node"])).alias("r"))
        pairs = pairs.select(F.greatest("node", "r").alias("a"), F.least("node", "r").alias("b")).distinct().join(checked, ["a", "b"], "left_anti")
        pairs = work.write(pairs, "pairs", left)
        rows, checked = pairs.count(), checked.unionByName(pairs)
        if rows:
            found = check(pairs, rows)
            if not found.isEmpty():
                tree = groups.where("node <> component").toDF("u", "v")
                groups = components(tree.unionByName(found.toDF("u", "v")), work, rows=rows + size)
        going = facing.where("not is_rep").select("h", "node")
        most = min(most * REPRESENTATIVES, MOST)

    known = classes.select("words_key", "first_id", "node").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    smallest = known.groupBy("group").agg(F.min("first_id").alias("component_id"))
    known = known.join(smallest, "group").select("words_key", "component_id", F.col("group").alias("group_id"))
    out = signed.select("doc_id", "n_shingles", "words_key", "text_key").join(known, "words_key", "left")
    out = out.withColumn("component_id", F.when(F.col("words_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    out = out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key", "group_id")
    out = work.write(out, "groups", 2 * size)
    work.only(out)
    return out


def kept_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group one row with the smallest doc_id.

    Rows without words (empty or null texts) are in no group and stay. Of rows
    that share the smallest doc_id, or have none in a group of nulls, one stays,
    the text with the smallest key. An empty table gives no rows, and columns of
    any name but doc_id and text are only carried.
    """
    work = Workspace(docs.sparkSession, "kept-documents")
    rows = near_duplicates(docs, k, percent).where("group_id is not null")
    rows = work.write(rows.groupBy("doc_id", "text_key", "group_id", "kept").agg(F.count("*").alias("n")), "rows")
    first = rows.where("kept").groupBy("group_id").agg(F.min("text_key").alias("first_key"))
    # Each group has a kept row; the others need no look at their group, however large it is.
    marked = rows.where("kept").join(first, "group_id").select("doc_id", "text_key", "n", (F.col("text_key") == F.col("first_key")).alias("stays"))
    marked = marked.unionByName(rows.where("not kept").select("doc_id", "text_key", "n", F.lit(False).alias("stays")))
    name, key = fresh(docs.columns, "gone_id", "gone_key")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(name)) & (text_key(F.col("text").cast("string")) == F.col(key))

    def keys(which: str) -> DataFrame:
        found = work.write(marked.where(which).select(F.col("doc_id").alias(name), F.col("text_key").alias(key)), "keys")
        return F.broadcast(found) if found.count() <= BROADCAST_KEYS else found

    # Only rows that stand more than once are shuffled whole.
    again = docs.join(keys("stays and n > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(keys("not stays or n > 1"), same, "left_anti").unionByName(again)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).drop("text_key", "group_id")


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as sh from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways as (select x, y from e union all select y, x from e),
r as (select doc_id as a, doc_id as b from documents union select r.a, both_ways.y from r join both_ways on r.b = both_ways.x)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join n using (doc_id) join (select a, min(b) as component_id from r group by a) c on c.a = d.doc_id"""
