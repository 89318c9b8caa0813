"""Operator 7: BPE encoding and decoding of whole texts, as the tokenizers library gives them.

ASCII white space never lies inside a token of the word-level vocabulary, so a
text is the concatenation of its white-space-free runs; each distinct run is
encoded once and kept in a bounded memo, as is each distinct pre-token of runs in
Latin letters, whose cuts are plain. A run that stays long and unsplit goes
through tree concatenation: its leaves are encoded in parallel in one batch,
then neighbours are joined pairwise, re-encoding a window around each join that
grows until it agrees with both sides.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import map_texts, release, table, tokenizer_path

#: Byte-level symbols up to which a pre-token is encoded in one piece.
LEAF = 2048
#: Runs of more UTF-8 bytes than this bypass the memo and are looked at for long pre-tokens.
LONG_RUN = 4096
#: Entries after which a memo is emptied; it is emptied after each task, too.
MEMO = 300_000

#: Runs whose pre-tokens follow from these patterns after lower-casing: ASCII and Latin letters that lower-case within the range.
_LATIN = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]*")
_PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\u017f]+")

Token = tuple[int, int]  # id, length in byte-level symbols


class TreeEncoder:
    """Encodes one long pre-token, a string of byte-level symbols."""

    def __init__(self, model: dict, leaf: int = LEAF):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import Tokenizer, models

        self.suffix, self.leaf = model.get("end_of_word_suffix") or "", leaf
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.inner = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))
        self.outer = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix)) if self.suffix else self.inner

    def _tokens(self, encoding) -> list[Token]:
        # Offsets count the symbols of the piece, with or without the suffix.
        return [(i, b - a) for i, (a, b) in zip(encoding.ids, encoding.offsets)]

    def _encode(self, piece: str, last: bool) -> list[Token]:
        return self._tokens((self.outer if last else self.inner).encode(piece, add_special_tokens=False))

    def encode(self, symbols: str) -> list[int]:
        """The ids of the pre-token, equal to those of encoding it whole."""
        if len(symbols) <= self.leaf:
            return [i for i, _ in self._encode(symbols, True)]
        bounds, size = [0, len(symbols)], len(symbols)
        while size > self.leaf:  # halve every part until each is a leaf
            bounds = sorted({*bounds, *((a + b) // 2 for a, b in zip(bounds, bounds[1:]))})
            size = max(b - a for a, b in zip(bounds, bounds[1:]))
        leaves = [symbols[a:b] for a, b in zip(bounds, bounds[1:])]
        level = [self._tokens(e) for e in self.inner.encode_batch(leaves[:-1], add_special_tokens=False)]
        level.append(self._encode(leaves[-1], True))
        starts = bounds[:-1]
        while len(level) > 1:
            joined, kept = [], []
            for k in range(0, len(level) - 1, 2):
                joined.append(self._join(symbols, level[k], level[k + 1], starts[k + 1], k + 2 == len(level)))
                kept.append(starts[k])
            if len(level) % 2:
                joined.append(level[-1])
                kept.append(starts[-1])
            level, starts = joined, kept
        return [i for i, _ in level[0]]

    def _join(self, symbols: str, left: list[Token], right: list[Token], at: int, last: bool) -> list[Token]:
        w = 8
        while True:
            a, b = min(w, len(left)), min(w, len(right))
            begin, end = at - sum(n for _, n in left[-a:]), at + sum(n for _, n in right[:b])
            whole_left, whole_right = a == len(left), b == len(right)
            got = self._encode(symbols[begin:end], last and whole_right)
            same = w // 2
            agrees_left = whole_left or got[:same] == left[len(left) - a :][:same]
            agrees_right = whole_right or got[-same:] == right[:b][-same:]
            if agrees_left and agrees_right and (len(got) >= 2 * same or (whole_left and whole_right)):
                return left[: len(left) - a] + got + right[b:]
            if whole_left and whole_right:
                return got
            w *= 2


class WordBpe:
    """Ids and decoded text of whole texts under a word-level BPE vocabulary.

    Works for vocabularies whose pre-tokenizer drops white space and that have
    no decoder, so that decoding joins the tokens with a space.
    """

    def __init__(self, path: str, long_run: int = LONG_RUN, leaf: int = LEAF, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["decoder"] is not None or not spec["model"].get("end_of_word_suffix"):
            raise ValueError("a word-level vocabulary without a decoder is needed")
        self.long_run, self.leaf, self.most = long_run, leaf, memo
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids: dict[bytes, bytes] = {}
        self.pretokens: dict[str, bytes] = {}
        self.pieces = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.pieces[i] = token.encode()
        self.final = [p.endswith(spec["model"]["end_of_word_suffix"].encode()) for p in self.pieces]
        self.path = path
        self._tree: TreeEncoder | None = None

    @property
    def tree(self) -> TreeEncoder:
        if self._tree is None:
            with open(self.path, encoding="utf-8") as f:
                self._tree = TreeEncoder(json.load(f)["model"], self.leaf)
        return self._tree

    def forget(self) -> None:
        """Empties the memos."""
        self.ids.clear()
        self.pretokens.clear()

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _long(self, run: str) -> list[int]:
        """Ids of a long run: special strings first, then pre-token by pre-token."""
        out: list[int] = []
        for part in re.split("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")", run):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                for symbols, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                    out += self.tree.encode(symbols)
        return out

    def _plain(self, runs: list[tuple[bytes, str]]) -> None:
        """Learns runs in Latin letters by their pre-tokens."""
        cut = [_PRETOKEN.findall(run.lower()) for _, run in runs]
        every = set(chain.from_iterable(cut))
        new = list(every.difference(self.pretokens))
        if len(self.pretokens) + len(new) > self.most:
            self.pretokens.clear()
            new = list(every)
        ids = self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids
        ends = [i for i, t in enumerate(ids, 1) if self.final[t]]
        if len(ends) != len(new):  # not cut as expected
            for pretoken in new:
                self.pretokens[pretoken] = self._pack(self.tokenizer.encode(pretoken, add_special_tokens=False).ids)
        else:
            packed = self._pack(ids)
            self.pretokens.update(zip(new, [packed[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]))
        get, known = self.pretokens.__getitem__, self.ids
        for (run, _), parts in zip(runs, cut):
            known[run] = get(parts[0]) if len(parts) == 1 else b"".join(map(get, parts))

    def _learn(self, new: list[bytes]) -> None:
        plain, other = [], []
        for r in new:
            run = r.decode()
            if len(r) > self.long_run:
                self.ids[r] = self._pack(self._long(run))
            elif _LATIN.fullmatch(run) and "<|" not in run:
                plain.append((r, run))
            else:
                other.append((r, run))
        if plain:
            self._plain(plain)
        for (r, _), e in zip(other, self.tokenizer.encode_batch_fast([x for _, x in other], add_special_tokens=False)):
            self.ids[r] = self._pack(e.ids)

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        return list(self.encode_all([text]))[0]

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """``encode`` of each text in turn; what is new in any of them is learned together."""
        cut = [text.encode("utf-8", "replace").split() for text in texts]
        runs = set(chain.from_iterable(cut))
        new = list(runs.difference(self.ids))
        if len(self.ids) + len(new) > self.most:
            self.ids.clear()
            new = list(runs)
        self._learn(new)
        for c in cut:
            ids = b"".join(map(self.ids.__getitem__, c))
            yield ids, self.decode(ids)
        for r in new:
            if len(r) > self.long_run:
                del self.ids[r]


#: Characters of the texts that are encoded together, or one text.
_BLOCK = 1_000_000


def blocks(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column in order, null as empty, about ``_BLOCK`` characters at a time."""
    texts, size = [], 0
    for scalar in column:
        texts.append(scalar.as_py() or "")
        size += len(texts[-1])
        if size >= _BLOCK:
            yield texts
            texts, size = [], 0
    yield texts


_KEPT: dict[str, WordBpe] = {}


def codec(path: str) -> WordBpe:
    """One codec for each path and Python worker."""
    if path not in _KEPT:
        _KEPT[path] = WordBpe(path)
    return _KEPT[path]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's whole text, one row each.

    With ``with_ids`` the ids and the decoded text follow. A null text counts as
    empty: no ids, both digests those of no bytes. Rows are independent, so
    repeated rows and null doc_ids keep a row each; other columns aren't read.
    A null byte, lone text without tokens or a run without white space of any
    length is no special case. Needs no shuffle.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [("ids", pa.list_(pa.int64())), ("decoded", pa.string())]
        ddl += ", ids array<bigint>, decoded string"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            encoded = (x for texts in blocks(batch.column(1)) for x in bpe.encode_all(texts))
            for doc_id, (ids, decoded) in zip(batch.column(0).to_pylist(), encoded):
                row = [doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                if with_ids:
                    row += [list(memoryview(ids).cast("I")), decoded.decode()]
                for column, value in zip(columns, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        bpe.forget()
        release()

    return map_texts(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, ddl)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
