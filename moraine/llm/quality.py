"""Operator 10: quality rules and a hashed n-gram log-likelihood ratio, in DataFrame operations alone.

The hashed n-grams of a text are its words and its pairs of neighbouring words,
each whole, in ``BUCKETS`` buckets. Their counts over one half of all trusted
documents (labelled quality 1) and over the whole raw corpus make two smoothed
multinomials; a document's score is the mean over its n-grams of
log p_trusted - log p_raw, so it doesn't depend on length.

The threshold is a rule, not a constant: the score that ``SPARED`` of the other
half of the trusted documents, which the trusted multinomial hasn't seen, fall
under. Every document is held against it alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import Workspace, table, window_hashes

BUCKETS, SMOOTHING, SPARED = 1 << 15, 0.5, 0.002
#: Up to this many fitted doc_ids are broadcast, in lists of about LIST; beyond that documents are joined with the lists by a shuffle.
BROADCAST_IDS, LIST = 5_000_000, 64
WINDOW, MIN_WORDS, MOST_REPEATED = 8, 20, 30
_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def words(text: str = "text") -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none of a null."""
    # Split at single blanks, which needs no pattern matching; the empty parts between two of them go.
    spaced = F.coalesce(F.col(text).cast("string"), F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def _symbols(text: str) -> Column:
    left = F.col(text)
    for symbol in SYMBOLS:
        left = F.replace(left, F.lit(symbol), F.lit(""))
    return (F.octet_length(text) - F.octet_length(left)).cast("bigint")


def _hashed(rows: DataFrame, sizes: dict[int, str]) -> DataFrame:
    """Adds h, the hashes of the words, and for each size n its column of n-word hashes."""
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    return window_hashes(rows, "h", list(sizes), list(sizes.values()))


def _bucket(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def trusted(labels: DataFrame) -> DataFrame:
    """trusted_id and fitted: every distinct trusted doc_id, and whether the multinomial has it; the threshold has the others."""
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("trusted_id")).distinct()
    return ids.withColumn("fitted", F.pmod(F.xxhash64("trusted_id", F.lit("half")), F.lit(2)) == 0)


def log_ratios(docs: DataFrame, known: DataFrame, most: int = BROADCAST_IDS) -> list[float]:
    """log p_trusted - log p_raw of each bucket. Without trusted n-grams all are 0."""
    fitted = known.where("fitted")
    n = fitted.count()
    slot = lambda doc_id: F.pmod(F.xxhash64(doc_id), F.lit(1 + n // LIST))
    lists = fitted.groupBy(slot("trusted_id").alias("slot")).agg(F.collect_list("trusted_id").alias("ids"))
    lists = F.broadcast(lists) if n <= most else lists
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").withColumn("in", slot("doc_id")).join(lists, F.col("in") == F.col("slot"), "left")
    good = F.coalesce(F.array_contains("ids", F.col("doc_id")), F.lit(False)).cast("bigint")
    # N-grams are exploded as a column: what follows is generated code with partial counts of BUCKETS rows a task.
    # A plain explode would have the words made again, in a filter before the join; a null n-gram is in no bucket.
    rows = _hashed(rows.select(good.alias("t"), words().alias("words")), {2: "p"})
    rows = rows.select("t", F.concat("h", "p").alias("grams")).select("t", F.explode_outer("grams").alias("gram"))
    counts = rows.select("t", _bucket(F.col("gram")).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("good"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").fillna(0, ["raw", "good"])
    row = every.agg(F.array_sort(F.collect_list(F.struct("b", "raw", "good"))).alias("c"), F.sum("raw").alias("raws"), F.sum("good").alias("goods"))
    log = lambda n, total: F.log(n + F.lit(SMOOTHING)) - F.log(total + F.lit(SMOOTHING * BUCKETS))
    w = F.transform("c", lambda x: F.when(F.col("goods") == 0, F.lit(0.0)).otherwise(log(x["good"], F.col("goods")) - log(x["raw"], F.col("raws"))))
    return row.select(w.alias("w")).first().w


def _repeated_words() -> Column:
    """Words in 8-word windows found twice or more, from the window hashes g."""
    sorted_ = F.sort_array(F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    same = lambda s, k: F.get(s, k)["g"]

    def starts(s: Column) -> Column:
        twice = F.filter(F.transform(s, lambda x, k: F.when((x["g"] == same(s, k - 1)) | (x["g"] == same(s, k + 1)), x["i"])), lambda i: i.isNotNull())
        return F.sort_array(twice)

    def total(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    # transform over an array of one element names an intermediate value once.
    named = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    count = named(sorted_, lambda s: named(starts(s), total))
    return F.when(F.size(F.array_distinct("g")) < F.size("g"), count).otherwise(0).cast("bigint")


def measured(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and score, a row for each row."""
    # BUCKETS numbers, as a literal.
    weights = F.split(F.lit(",".join(f"{w:.9g}" for w in ratios)), ",").cast("array<double>")
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("words", words())
    rows = _hashed(rows, {WINDOW: "g", 2: "p"}).withColumn("grams", F.concat("h", "p"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(_WORD))
    total = F.aggregate("grams", F.lit(0.0), lambda sum_, gram: sum_ + F.get(weights, _bucket(gram)))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        _symbols("text").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        _repeated_words().alias("n_repeat_words"),
        F.when(F.size("grams") == 0, F.lit(0.0)).otherwise(F.round(total / F.size("grams"), 9)).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score")


def threshold(rows: DataFrame, known: DataFrame, spared: float = SPARED) -> float | None:
    """The score under which ``spared`` of the trusted rows lie that were not fitted and pass the base rules; None without such rows.

    ``rows`` are measured ones. It is the exact percentile, interpolated; no
    task holds more scores than those up to it.
    """
    apart = known.where("not fitted")
    scores = rows.where("not base_failed").join(apart, F.col("doc_id") == F.col("trusted_id"), "left_semi").select("score")
    n = scores.count()
    if not n:
        return None
    at = (n - 1) * spared
    k = math.floor(at)
    two = scores.orderBy("score").offset(k).limit(2).agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    return two.lo if two.lo == two.hi else (k + 1 - at) * two.lo + (at - k) * two.hi


def quality(docs: DataFrame, labels: DataFrame, spared: float = SPARED, most: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score, a row for each row.

    A null text has no words and no symbols; like any text under 20 words it
    fails. The score of a text without n-grams is 0, and a score equal to the
    threshold keeps. Without trusted rows only the base rules decide. Repeated
    rows and null doc_ids keep a row each; repeated labels count once. Whole
    texts are read, of any length. Only doc_id, text and the labels' doc_id and
    quality are read. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "quality")
    known = work.write(trusted(labels), "trusted")
    rows = work.write(measured(docs, log_ratios(docs, known, most)), "measured")
    least = threshold(rows, known, spared)
    work.only(rows)
    kept = ~F.col("base_failed") & (F.lit(True) if least is None else F.col("score") >= F.lit(least))
    return rows.select(*[c for c in rows.columns if c != "score"], kept.alias("kept"), "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
