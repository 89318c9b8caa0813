"""Operator 2: benchmark decontamination by hashed word windows, in DataFrame operations alone.

The items' windows of ``WINDOW`` normalised words (all words of a shorter item)
are hashed and, where their number is proven small, broadcast. Document windows
are scanned against them; a hit counts only if its words are those of the item's
window. Beyond the bound the windows meet by a shuffle of their hashes and the
hits are verified by joining the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import Workspace, ascii_lower, fresh, table, text_key, window_hashes

WINDOW = 10
#: Distinct item windows up to which they are broadcast, about 300 bytes each whatever the number of their items,
#: and documents with hits up to which their keys are. Results don't depend on either.
BROADCAST_WINDOWS, BROADCAST_KEYS = 200_000, 500_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    """The normalised words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text; none of a null."""
    # Split at what lies between: extracting matches copies the text for each of them.
    return F.array_remove(F.split(F.coalesce(ascii_lower(F.col(text).cast("string")), F.lit("")), _GAP), "")


def item_windows(items: DataFrame, work: Workspace, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Written tables of the distinct windows (n, g, item_words and the id w) and of the items (w, item_id) that have them."""
    found = items.select("item_id", words().alias("words")).where(F.size("words") > 0).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    found = window_hashes(found, "h", list(range(1, window + 1)), [f"g{n}" for n in range(1, window + 1)])
    n = F.least(F.lit(window), F.size("words"))
    found = found.select("item_id", "words", n.alias("n"), F.coalesce(*[F.when(n == k, F.col(f"g{k}")) for k in range(1, window + 1)]).alias("all"))
    single = found.select("item_id", "words", "n", F.posexplode_outer("all").alias("at", "g"))
    single = work.write(single.select("item_id", "n", "g", F.slice("words", F.col("at") + 1, F.col("n")).alias("item_words")), "single")
    windows = work.write(single.select("n", "g", "item_words").distinct().withColumn("w", F.monotonically_increasing_id()), "windows")
    having = work.write(single.join(windows, ["n", "g", "item_words"]).select("w", "item_id").distinct(), "having")
    work.drop(single)
    return windows, having


#: The hash that each document has once in a scan for all documents, at its first place.
_EACH = -0x5DEECE66D


def _scan(rows: DataFrame, known: DataFrame, sizes: list[int], small: bool, each: bool = False) -> DataFrame:
    """The hits of rows with words: their other columns, n_words, span and w of every verified window.

    With ``each`` every row has one more hit whose span is null.
    """
    carry = [c for c in rows.columns if c != "words"]
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    # The windows of all sizes in one array, those of each size together. It is a column before it is
    # exploded: then generator, join and verification are one generated stage that copies no words. An outer
    # generator infers no filter, which would be pushed down as a copy of the whole expression.
    names = [f"_w{n}" for n in sizes]
    rows = window_hashes(rows, "h", sizes, names)
    rows = rows.select(*carry, "words", F.concat(F.array(*[F.lit(_EACH)] * each).cast("array<bigint>"), *names).alias("all"))
    hashed = rows.select(*carry, *(["words"] if small else []), F.size("words").cast("bigint").alias("n_words"), F.posexplode_outer("all").alias("at", "g"))
    before, start = F.lit(int(each)).cast("bigint"), F.lit(0).cast("bigint")
    for n in sizes:
        start = F.when(F.col("n") == n, before).otherwise(start)
        before = before + F.greatest(F.lit(0), F.col("n_words") - (n - 1))
    if each:
        mark = known.sparkSession.range(1).select(F.lit(0).alias("n"), F.array().cast("array<string>").alias("item_words"), F.lit(-1).cast("bigint").alias("w"), F.lit(_EACH).alias("g"))
        known = known.select(*mark.columns).unionByName(mark)
    if small:
        found = hashed.join(F.broadcast(known), "g")
    else:
        found = hashed.join(known, "g").join(rows.select("text_key", "words").dropDuplicates(["text_key"]), "text_key")
    found = found.withColumn("pos", (F.col("at") - start).cast("int"))
    inside = (F.col("n") > 0) & (F.col("pos") >= 0) & (F.col("pos") + F.col("n") <= F.size("words"))
    real = inside & (F.slice("words", F.when(inside, F.col("pos") + 1).otherwise(1), F.col("n")) == F.col("item_words"))
    if each:
        real = real | ((F.col("n") == 0) & (F.col("at") == 0))
    return found.where(real).select(*carry, "n_words", F.when(F.col("n") > 0, F.struct("pos", "n")).alias("span"), F.when(F.col("n") > 0, F.col("w")).alias("w"))


def _sizes(windows: DataFrame) -> list[int]:
    return sorted((r.n for r in windows.select("n").distinct().collect()), reverse=True)  # at most the size of a window


def hits(docs: DataFrame, items: DataFrame, work: Workspace, window: int = WINDOW, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, text_key and spans of every document with a hit, a written table.

    spans are distinct (pos, n): n words from the 0-based word pos are a window
    of some item. Rows with equal doc_id and text are one document.
    """
    windows, _ = item_windows(items, work, window)
    rows = docs.select(F.col("doc_id").cast("bigint"), text_key(F.col("text").cast("string")).alias("text_key"), words().alias("words"))
    found = _scan(rows, windows, _sizes(windows), windows.count() <= most)
    return work.write(found.groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("spans")), "hits")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, a row for each row of docs.

    A word is hit if it lies in any occurrence of an item's window. Null and
    empty texts have no words and no hits; items without words have no windows.
    Rows with equal doc_id and text share their values and keep a row each, also
    where doc_id is null. Items may repeat, also their ids. Texts of any length
    are read whole. Empty tables give no rows, or rows without hits. Only doc_id,
    text and item_id are read, so other columns may have any name.
    """
    work = Workspace(docs.sparkSession, "decontamination")
    windows, having = item_windows(items, work, window)
    sizes, small = _sizes(windows), windows.count() <= most
    gathered = F.collect_set("span").alias("spans"), F.collect_set("w").alias("ws")
    if small:  # one scan gives every row and its hits
        rows = docs.select(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"), text_key(F.col("text").cast("string")).alias("text_key"), words().alias("words"))
        both = _scan(rows.drop("text_key"), windows, sizes, small, each=True).groupBy("row", "doc_id", "n_words").agg(*gathered)
    else:
        rows = docs.select(F.col("doc_id").cast("bigint"), text_key(F.col("text").cast("string")).alias("text_key"), words().alias("words"))
        found = _scan(rows.drop("doc_id"), windows, sizes, small).groupBy("text_key").agg(*gathered)
        both = rows.select("doc_id", "text_key", F.size("words").cast("bigint").alias("n_words")).join(found, "text_key", "left").withColumn("row", F.monotonically_increasing_id())
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["n"] - 1))))
    n_hit = F.when(F.size("spans") > 0, F.size(covered)).otherwise(0).cast("bigint")
    both = work.write(both.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), "ws"), "rows")
    of = both.where(F.size("ws") > 0).select("row", F.explode("ws").alias("w")).join(having, "w").groupBy(F.col("row").alias("of")).agg(F.collect_set("item_id").alias("items"))
    both = both.join(of, both["row"] == of["of"], "left")
    names = F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda i: i.cast("string")))
    return both.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _with_hits(docs: DataFrame, items: DataFrame, window: int, how: str) -> tuple[DataFrame, str]:
    """docs joined with the documents that have hits, and the name of the column of their spans."""
    name, key, spans = fresh(docs.columns, "hit_id", "hit_key", "spans")
    found = hits(docs, items, Workspace(docs.sparkSession, "hits"), window).toDF(name, key, spans)
    if found.count() <= BROADCAST_KEYS:
        found = F.broadcast(found)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(name)) & (text_key(F.col("text").cast("string")) == F.col(key))
    return docs.join(found, same, how), spans


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any hit, with all their columns.

    Null and empty texts stay, as do all rows where no item has words; rows with
    equal doc_id and text go together, also where doc_id is null; an empty table
    gives no rows; columns of any name but doc_id and text are only carried.
    """
    return _with_hits(docs, items, window, "left_anti")[0]


def without_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs with every hit word removed from text; rows without hits stay as they are.

    In a text with hits the words that are not hit are kept, with what follows
    each up to the next word. Null texts, repeated rows, empty tables and other
    columns are as in ``clean_documents``.
    """
    joined, spans = _with_hits(docs, items, window, "left")
    units = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract(F.col("text"), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    gone = F.flatten(F.transform(spans, lambda s: F.sequence(s["pos"], s["pos"] + s["n"] - 1)))
    left = F.filter(units, lambda _, i: ~F.array_contains(gone, i))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(left, "")))
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with lowered as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
d as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from lowered),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark),
bw as (
  select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') as win
  from (select item_id, ws, least(10, len(ws)) as n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from b where len(ws) > 0)),
sizes as (select distinct n from bw),
dw as (
  select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as win
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, sizes where len(ws) >= n)),
hit as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.win = bw.win),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
its as (
  select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as names
  from (select distinct doc_id, cast(item_id as varchar) as s from hit) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join its using (doc_id)"""
