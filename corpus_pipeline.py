"""A corpus pipeline of five stages, each written as Parquet and read again.

Toxicity, near-duplicates, benchmark decontamination, personal data, encoding.
Each stage works on all that its predecessor kept and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm import bpe, decontaminate, minhash, pii, toxicity
from moraine.llm.common import Workspace, table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 3 doesn't predict to be toxic."""
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(grammar)(F.col("text").cast("string")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of operator 4 at five words and a similarity of 0.8: that with the smallest doc_id."""
    return minhash.kept_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item (operator 2)."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the personal data that operator 5 finds replaced by its kind; n_chars follows the text."""
    out = pii.without_personal_data(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each whole text by operator 7, as their number and the digests of ids and decoded text."""
    return bpe.encode_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("encoding", encode),
]

#: No stage but the third can be said in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of sf_dir."""
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES:
        before = docs
        docs = work.write(stage(spark, docs, sf_dir), name)
        if before is not docs and hasattr(before, "moraine_path"):
            work.drop(before)
    return docs
