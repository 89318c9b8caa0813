"""Operator 8: substring deduplication by hashing lines and the clauses in them.

A unit is a line, or a part of it that ends after a clause of at least
``MIN_CLAUSE`` words (where a part ends depends on the nearby words alone, so
equal passages are cut alike wherever they stand). Units are normalised (lower
case, white space as one space) and hashed. Digests are grouped globally with
partial counts; the occurrence with the smallest (doc_id, offset) is the first.
Every later occurrence is removed, consecutive ones of one text as one span with
its offsets in the original text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import Workspace, fresh, map_texts, release, table

#: Words of a clause that ends a unit, and of a run of later occurrences that is removed (1: all are).
MIN_CLAUSE, MIN_WORDS = 4, 1
#: Words of a removed run from which on a text is reported to hold a long repeat.
LONG_RUN = 20
_END = re.compile(r"[.!?,;:]+\s+")


def units(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normalised text) of the units of a text that have a word, in order."""
    out, start = [], 0
    for line in text.split("\n"):
        at, begin = 0, 0
        ends = [m.end() for m in _END.finditer(line)] + [len(line)]
        for end in ends:
            last = line[at:end].split()
            if len(last) < MIN_CLAUSE and end < len(line):
                at = end
                continue
            words = line[begin:end].split()
            if words:
                out.append((start + begin, start + end, len(words), " ".join(words).lower()))
            at = begin = end
        start += len(line) + 1
    return out


#: Units that a task hands over at once.
_AT_ONCE = 8_000


def _units(docs: DataFrame) -> DataFrame:
    """A row for each unit: its document (doc_id and t, a hash of the text), digest (d1, d2), number, offset, length and words."""
    narrow = {"t": "q", "d1": "q", "d2": "q", "i": "i", "start": "i", "size": "i", "words": "i"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, columns = [], [array(kind) for kind in narrow.values()]

        def made():
            arrays = [pa.array(np.frombuffer(c, f"i{c.itemsize}")) for c in map(array.__copy__, columns)]
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *arrays], names=["doc_id", *narrow])
            ids.clear()
            for c in columns:
                del c[:]
            return batch

        for batch in batches:
            for doc_id, text, t in zip(batch.column(0), batch.column(1), batch.column(2)):
                found, t = units(text.as_py()), t.as_py()
                for at in range(0, len(found), _AT_ONCE):  # of a long text piece by piece
                    some = found[at : at + _AT_ONCE]
                    digests = b"".join([xxhash.xxh3_128_digest(u[3].encode("utf-8", "replace")) for u in some])
                    both = array("q", digests)
                    fields = [array("q", [t]) * len(some), both[::2], both[1::2], range(at, at + len(some)), [u[0] for u in some], [u[1] - u[0] for u in some], [u[2] for u in some]]
                    ids.append(pa.repeat(doc_id, len(some)))
                    for c, x in zip(columns, fields):
                        c.extend(x)
                    if len(columns[0]) >= _AT_ONCE:
                        yield made()
        if ids:
            yield made()
        release()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("t")).where("text is not null")
    return map_texts(rows, run, "doc_id bigint, t bigint, d1 bigint, d2 bigint, i int, start int, size int, words int")


def _runs(grouped: DataFrame, min_words: int) -> DataFrame:
    """doc_id, t, n_shared, n_removed, removed_words, longest_run and spans of the documents' repeated units."""
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n_shared", pa.int64()), ("n_removed", pa.int64()), ("removed_words", pa.int64()), ("longest_run", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, t, found in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = sorted((u["i"], u["start"], u["size"], u["words"], u["later"]) for u in found)
                runs: list[list] = []
                for i, a, n, w, later in found:
                    if later and runs and runs[-1][0] == i - 1:
                        r = runs[-1]
                        r[0], r[2], r[3], r[4] = i, a + n, r[3] + w, r[4] + 1
                    elif later:
                        runs.append([i, a, a + n, w, 1])
                kept = [r for r in runs if r[3] >= min_words]
                rows.append((doc_id, t, len(found), sum(r[4] for r in kept), sum(r[3] for r in kept), max((r[3] for r in kept), default=0), [{"start": r[1], "end": r[2]} for r in kept]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)
        release()

    return map_texts(grouped, run, "doc_id bigint, t bigint, n_shared bigint, n_removed bigint, removed_words bigint, longest_run bigint, spans array<struct<start:int,end:int>>")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_units, n_shared, n_removed, removed_words, longest_run and spans, a row for each row of docs.

    n_shared counts units whose digest occurs more than once, n_removed those in
    the removed spans (start, end in code points, end exclusive): every
    occurrence but the first, unless min_words spares runs of fewer words;
    longest_run is the number of words of the longest of them. Units
    without words and null texts have no digest. Rows with equal doc_id and text are one
    document: they share their values and keep a row each, also where doc_id is
    null (null ranks last). An empty table gives no rows. Only doc_id and text
    are read.
    """
    work = Workspace(docs.sparkSession, "substring")
    cut = work.write(_units(docs), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t", "start")
    seen = cut.groupBy("d1", "d2").agg(F.count("*").alias("c"), F.min(rank).alias("first")).where("c > 1").select("d1", "d2", "first")
    # Written, so that Spark can split the join at a digest that many units have.
    seen = work.write(seen, "seen")
    later = ~rank.eqNullSafe(F.col("first"))
    unit = F.struct("i", "start", "size", "words", later.alias("later"))
    # A set, combined before the shuffle: a document that stands in many rows has each unit once.
    found = cut.join(seen, ["d1", "d2"]).groupBy("doc_id", "t").agg(F.collect_set(unit).alias("found"))
    found = _runs(found, min_words)
    sizes = cut.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("dt")).agg((F.max("i") + 1).cast("bigint").alias("n_units"))
    both = sizes.join(found, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("dt") == F.col("t")), "left").drop("doc_id", "t")
    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    out = rows.join(both, rows["doc_id"].eqNullSafe(both["d"]) & (rows["t"] == both["dt"]), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select("doc_id", zero("n_units"), zero("n_shared"), zero("n_removed"), zero("removed_words"), zero("longest_run"), F.coalesce("spans", none).alias("spans"), "t")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with their repeated spans cut from text; rows whose text is removed whole have an empty one.

    Null and empty texts stay as they are, rows with equal doc_id and text (also
    with a null doc_id) are cut alike, an empty table gives no rows, and columns
    of any name but doc_id and text are only carried.
    """
    name, key, cuts = fresh(docs.columns, "span_id", "span_t", "spans")
    spans = repeated_spans(docs, min_words).where(F.size("spans") > 0).dropDuplicates(["doc_id", "t"]).select(F.col("doc_id").alias(name), F.col("t").alias(key), F.col("spans").alias(cuts))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts, spans):
            text, found = text.as_py(), found.as_py()
            if found:
                at, parts = 0, []
                for s in found:
                    parts.append(text[at : s["start"]])
                    at = s["end"]
                text = "".join([*parts, text[at:]]).strip("\n")
            out.append(text)
        return pa.array(out, pa.string())

    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(name)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key))
    joined = docs.join(spans, same, "left")
    return joined.withColumn("text", cut(F.col("text").cast("string"), F.col(cuts))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", "n_units", "n_shared", "n_removed", "removed_words", "longest_run", text.alias("spans"), (F.col("n_removed") > 0).alias("has_repeats"), (F.col("longest_run") >= LONG_RUN).alias("has_long_repeats"))


#: White space as Python's str.split sees it.
_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: For distinct doc_ids. A unit is the clauses of a line up to one of MIN_CLAUSE words or more.
ORACLE = rf"""
with lines as (
    select doc_id, string_split(text, chr(10)) as all_lines from documents where text is not null
), line as (
    select doc_id, unnest(all_lines) as line, unnest(range(len(all_lines))) as l from lines
), placed as (
    select doc_id, l, line, coalesce(sum(length(line) + 1) over (partition by doc_id order by l rows between unbounded preceding and 1 preceding), 0) as line_start from line
), parts as (
    select doc_id, l, line_start, regexp_extract_all(line, '(?s).*?[.!?,;:]+[{_SPACE}]+|.+') as all_parts from placed
), part as (
    select doc_id, l, line_start, unnest(all_parts) as part, unnest(range(len(all_parts))) as p from parts
), clause as (
    select *, len(regexp_extract_all(part, '[^{_SPACE}]+')) as n,
        line_start + coalesce(sum(length(part)) over (partition by doc_id, l order by p rows between unbounded preceding and 1 preceding), 0) as pos from part
), grouped as (
    select *, coalesce(sum((n >= {MIN_CLAUSE})::int) over (partition by doc_id, l order by p rows between unbounded preceding and 1 preceding), 0) as g from clause
), joined as (
    select doc_id, l, g, min(pos) as a, max(pos + length(part)) as b, string_agg(part, '' order by p) as unit from grouped group by doc_id, l, g
), cut as (
    select doc_id, a, b, regexp_extract_all(unit, '[^{_SPACE}]+') as found from joined
), units as (
    select doc_id, a, b, len(found) as words, lower(array_to_string(found, ' ')) as unit, row_number() over (partition by doc_id order by a) as i from cut where len(found) > 0
), ranked as (
    select *, count(*) over (partition by unit) as c, row_number() over (partition by unit order by doc_id, a) > 1 as later from units
), islands as (
    select *, i - row_number() over (partition by doc_id, later order by i) as island from ranked
), spans as (
    select doc_id, min(a) as a, max(b) as b, count(*) as n, sum(words) as words from islands where later group by doc_id, island
), removed as (
    select doc_id, sum(n) as n_removed, sum(words) as removed_words, max(words) as longest_run, string_agg(a || ':' || b, ',' order by a) as spans from spans group by doc_id
), counted as (
    select doc_id, count(*) as n_units, count(*) filter (c > 1) as n_shared from ranked group by doc_id
)
select doc_id, coalesce(n_units, 0)::bigint as n_units, coalesce(n_shared, 0)::bigint as n_shared, coalesce(n_removed, 0)::bigint as n_removed,
    coalesce(removed_words, 0)::bigint as removed_words, coalesce(longest_run, 0)::bigint as longest_run,
    coalesce(spans, '') as spans, coalesce(n_removed, 0) > 0 as has_repeats, coalesce(longest_run, 0) >= {LONG_RUN} as has_long_repeats
from documents left join counted using (doc_id) left join removed using (doc_id)
"""
