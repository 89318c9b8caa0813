"""Operator 6: language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of character
n-grams (n = 1..3) that both have, over the root of the product of their n-gram
counts. Nystroem landmarks (training texts, some of each language) give features
z(x) = K(x, L) K(L, L)^-1/2; one-versus-rest kernel ridge regression on them
gives a weight for each landmark and language. n-grams are hashed into ``DIM``
buckets, so K(x, L) is a product of presence rows, and landmarks and weights
fold into one DIM x languages matrix by which batches of texts are multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.llm.common import map_texts, release, table

#: Training texts of each language, and of all, at most; landmarks of each language.
PER_LANGUAGE, MOST, LANDMARKS = 400, 8_000, 60
#: Rows of each language that are ranked for the sample, as a multiple of PER_LANGUAGE, about.
SURPLUS = 4
#: n-gram buckets, n-gram sizes and the ridge.
DIM, SIZES, RIDGE = 1 << 15, (1, 2, 3), 1e-2
#: Texts of a block of presence rows (DIM floats each) that is multiplied at once.
BLOCK = 64
#: Languages up to which their counts are broadcast.
BROADCAST_LANGUAGES = 100_000
#: Characters looked at together; texts are taken in pieces of this many and their presences united.
_PIECE = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)


def present(text: str) -> np.ndarray:
    """Sorted buckets of the n-grams of a text in lower case, white space and digits as one space."""
    flags = np.zeros(DIM, bool)
    text = " " + text.lower() + " "
    for start in range(0, len(text), _PIECE):
        points = np.frombuffer(text[start : start + _PIECE + max(SIZES) - 1].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        points = np.where((points <= 32) | ((points >= 48) & (points <= 57)), np.uint64(32), points)
        h = np.zeros(len(points), np.uint64)
        for n in range(1, max(SIZES) + 1):
            h = (h[: len(points) - n + 1] + np.uint64(n)) * _P + points[n - 1 :] if n > 1 else points * _P
            if n in SIZES:
                flags[((h ^ (h >> np.uint64(29))) * _P) >> np.uint64(49)] = True
    return np.flatnonzero(flags)


def _letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Languages and the folded matrix."""

    def __init__(self, languages: list[str], matrix: np.ndarray):
        self.languages, self.matrix = languages, matrix

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each text of a batch; 'und' and 0 without letters."""
        real = [i for i, t in enumerate(texts) if _letters(t)] if self.languages else []
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        for at in range(0, len(real), BLOCK):
            some = real[at : at + BLOCK]
            # A block of presence rows times the matrix.
            block = np.zeros((len(some), DIM), np.float32)
            for row, i in zip(block, some):
                at_ = present(texts[i])
                row[at_] = 1 / np.sqrt(len(at_))
            values = block @ self.matrix
            top = np.argmax(values, axis=1)
            odds = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
            for i, k, p in zip(some, top, odds.max(axis=1) / odds.sum(axis=1)):
                names[i], scores[i] = self.languages[k], float(p)
        return names, scores


def fit(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model from (language, presence) rows."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], np.zeros((DIM, 0), np.float32))

    def dense(some: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(some), DIM), np.float32)
        for row, at in zip(x, some):
            row[at] = 1 / np.sqrt(len(at))
        return x

    chosen = [x for lang in languages for x in [p for name, p in rows if name == lang][:landmarks]]
    marks = dense(chosen)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    k = np.concatenate([dense([p for _, p in rows[i : i + 256]]) @ marks.T for i in range(0, len(rows), 256)])
    z = k @ root
    y = np.array([[1.0 if lang == name else -1.0 for name in languages] for lang, _ in rows])
    share = np.array([1 / sum(name == lang for name, _ in rows) for lang, _ in rows])[:, None]  # each language counts alike
    bias = np.ones((len(rows), 1))
    z = np.hstack([z, bias])
    beta = np.linalg.solve((z * share).T @ z + ridge * np.eye(z.shape[1]) / len(languages), (z * share).T @ y)
    return Model(languages, (marks.T @ (root @ beta[:-1])).astype(np.float32))


def held_out(doc_id="doc_id"):
    """Rows that nothing is learned from; a null doc_id is one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sampled(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST) -> DataFrame:
    """doc_id, lang, r and text: at most ``per_language`` distinct doc_ids of each language and ``most`` in all.

    They are chosen by hashes of doc_id. A doc_id that stands in several rows
    counts once, with its smallest lang and then its smallest text there.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("text").cast("string")).where("lang is not null and text is not null").where(~held_out())
    # Hashes thin each language to a few times what is taken before its rows meet in one task.
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(SURPLUS * per_language)) / F.col("n")) * (1 << 30)
    few = sizes.count() <= BROADCAST_LANGUAGES
    known = rows.select("doc_id", "lang").join(F.broadcast(sizes) if few else sizes, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < share)
    known = known.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rank = known.select("doc_id", "lang", F.row_number().over(order).alias("r")).where(F.col("r") <= per_language)
    rank = rank.orderBy("r", "lang").limit(most)  # at most ``most`` rows: broadcast
    return rows.join(F.broadcast(rank), ["doc_id", "lang"]).groupBy("doc_id", "lang", "r").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST) -> Model:
    """Fits on the presence rows of the sample, a few thousand bits each."""
    schema = pa.schema([("lang", pa.string()), ("r", pa.int32()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for text in batch.column(1):
                flags = np.zeros(DIM, bool)
                if _letters(text.as_py()):
                    flags[present(text.as_py())] = True
                bits.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bits, pa.binary())], schema=schema)

    train = map_texts(sampled(docs, per_language, most).select("lang", "text", "r"), run, "lang string, r int, bits binary")
    rows = sorted((r.r, r.lang, bytes(r.bits)) for r in train.collect())
    return fit([(lang, np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))) for _, lang, bits in rows])


def languages(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST) -> DataFrame:
    """doc_id, held_out, lang_pred and score, a row for each row of docs.

    Texts that are null or have no letter are 'und' with score 0, as is every
    text where nothing could be learned. Whole texts are read, long ones in
    pieces. Repeated rows keep a row each; a null doc_id counts as held out.
    Only doc_id, text and lang are read, lang for learning alone. An empty table
    gives no rows.
    """
    model = learn(docs, per_language, most)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 4 * BLOCK):
                part = batch.slice(start, 4 * BLOCK)
                names, scores = model.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)
        release()

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), F.col("text").cast("string"))
    return map_texts(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
