"""Operator 1: token counts without token ids.

A byte-level BPE never merges across pre-tokens, so the count of a text is the
sum, over its pre-tokens, of their piece counts. Pre-tokens are cut at white
space the way the vocabulary's pattern cuts there: a run of other characters
with at most one space before it, or white space.

Each block of texts (an Arrow batch) is reduced to per-document pre-token
frequencies; the block's distinct pre-tokens that the worker doesn't know yet
are encoded once, for their number of pieces alone; and the frequencies are
joined to those numbers and summed. What a worker knows is bounded by ``MEMO``
pre-tokens of at most ``LONG`` characters and forgotten after each task.
A join through the whole corpus's table of distinct pre-tokens gives the same
counts but moves most of the corpus: rare pre-tokens outnumber the texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import mul, sub

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import map_texts, release, table, tokenizer_path

#: Pre-tokens that a worker knows before it starts anew, and characters of one up to which it is remembered.
MEMO, LONG = 400_000, 512
LIMIT = 512

_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNITS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")


def units(text: str) -> list[str]:
    """The pre-tokens of a text without special strings, cut at white space only."""
    return _UNITS.findall(text)


def _counted(text: str, special: re.Pattern) -> tuple[Counter, int]:
    """Frequencies of a text's pre-tokens, and how many special strings it has."""
    parts = special.split(text)
    found = Counter(units(parts[0]))
    for part in parts[1:]:
        found.update(units(part))
    return found, len(parts) - 1


def _special(tokenizer) -> re.Pattern:
    names = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True))) or "(?!)")


def _tokenizer(path: str, kept: dict = {}):  # noqa: B006  one for each path and Python worker
    if path not in kept:
        from tokenizers import Tokenizer

        kept[path] = Tokenizer.from_file(path)
        kept[path].no_truncation()
        kept[path].no_padding()
    return kept[path]


class PieceCounts:
    """Number of pieces of each pre-token, found once while it is known."""

    def __init__(self, path: str, memo: int = MEMO):
        self.tokenizer, self.most, self.known = _tokenizer(path), memo, {}
        self.special = _special(self.tokenizer)
        # Tokens that begin with a space's symbol, which stands nowhere else in a pre-token that one space begins.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = bytearray(max(vocabulary.values(), default=0) + 1)
        for token, i in vocabulary.items():
            self.begins[i] = token.startswith("\u0120")

    def add(self, pretokens: set[str]) -> None:
        new = list(pretokens.difference(self.known))
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(pretokens)
        spaced = [p for p in new if p[0] == " " and not p.isspace()]
        # One after the other they are cut where each begins, so one call encodes them all.
        ids = self.tokenizer.encode("".join(spaced), add_special_tokens=False).ids
        starts = [i for i, t in enumerate(ids) if self.begins[t]]
        if len(starts) == len(spaced):
            self.known.update(zip(spaced, map(sub, [*starts[1:], len(ids)], starts)))
            new = [p for p in new if p not in self.known]
        for start in range(0, len(new), 10_000):
            some = new[start : start + 10_000]
            encoded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.known.update(zip(some, map(len, encoded)))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text of a block."""
        found = [_counted(text, self.special) for text in texts]
        distinct = set().union(*(f for f, _ in found))
        self.add(distinct)
        get = self.known.__getitem__
        counts = [special + sum(map(mul, map(get, f), f.values())) for f, special in found]
        for pretoken in [p for p in distinct if len(p) > LONG]:
            del self.known[pretoken]
        return counts


#: Characters of the texts of a block, or one text.
_BLOCK = 2_000_000


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit), a row for each row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null
    doc_ids keep a row each; other columns aren't read. An empty table gives no
    rows. Special strings inside a text are one token each, as the library's
    default has it. Needs no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            ids, start = batch.column(0), 0
            while start < len(batch):
                texts, size = [], 0
                while start + len(texts) < len(batch) and size < _BLOCK:
                    texts.append(batch.column(1)[start + len(texts)].as_py() or "")
                    size += len(texts[-1])
                n_tokens = pieces.count(texts)
                n_bytes = [len(t.encode("utf-8", "replace")) for t in texts]
                columns = [ids.slice(start, len(texts)), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                start += len(texts)
        pieces.known.clear()
        release()

    ddl = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return map_texts(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, ddl)


def _pieces(path: str, kept: dict = {}) -> PieceCounts:  # noqa: B006  one for each path and Python worker
    if path not in kept:
        kept[path] = PieceCounts(path)
    return kept[path]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
