"""Operator 5: personal data by base patterns and bootstrapped contextual extraction.

Base spans come from fixed patterns with checks, one kind at a time; values that
are assigned to a credential's name, such as token = "...", are spans of a kind
of their own, secret. They are the seeds of a bootstrapping: the words around a seed make lexical patterns (the
two words before; the word before and the word after), and other identifier-like
tokens and runs of digit groups in the same contexts are candidate instances.
Spark scores patterns and instances in turn on the pattern-instance graph, as
weighted averages of each other with seeds held at 1 for ``ROUNDS`` steps.
Instances that score high enough in a pattern with enough support and confidence
become seeds, whose contexts make patterns in turn, until no instance is new.
Candidates of a high-confidence pattern become spans of its kind. Base spans
always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import Workspace, fresh, map_texts, release, small_batches, table

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Patterns up to which they are broadcast for redaction, about 100 bytes each.
BROADCAST_PATTERNS = 200_000
#: Steps of the graph, and what a pattern needs: distinct seeds, share of seeds among its instances by weight.
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE = 3, 3, 0.6
#: Code points beyond which an instance or a word stands as a digest, and digits that a candidate of another kind than email needs.
MOST_CHARS, MIN_DIGITS = 64, 6

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?:(?:api|access|auth|private)[_ -]?key|token|secret|passw(?:or)?d|credential)s?[\"']?\s*[:=]\s*[\"']?([a-z0-9+/_=.~-]{7,}[a-z0-9+/_=~-])", re.IGNORECASE | re.ASCII)
_DIGIT = re.compile(r"[0-9]")
_GROUPS = re.compile(r"[(\[]?[0-9]++(?:[ \u00a0.()\[\]\u2010-\u2015-]{1,3}[0-9]++)++")
_EDGE = ".,;:!?\"'()<>[]{}|=#*&$"
_TOKEN = re.compile(r"\S+")
_WORD = re.compile(rf"[^\s{re.escape(_EDGE)}]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # A match starts where the run of local characters before its @ starts, or where the last match ends.
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = max(free, at + 1)
            at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    # In a maximal run of dotted numbers, matches are each next four of them.
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            some = parts[k : k + 4]
            size = sum(map(len, some)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in some):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base spans by start, then kind as in KINDS."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(a, 1, b) for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group()) if m.end() - m.start() <= 40 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def secret_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, "secret", end) of the values of credentials: 8 characters or more with a letter and a digit."""
    if "=" not in text and ":" not in text:
        return []
    found = [m.span(1) for m in _SECRET.finditer(text)]
    return [(a, "secret", b) for a, b in found if _DIGIT.search(text, a, b) and any(map(str.isalpha, text[a:b]))]


def listed(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def _instance(found: str) -> str:
    return found if len(found) <= MOST_CHARS else hashlib.sha256(found.encode("utf-8", "replace")).hexdigest()


class _Contexts:
    """The patterns of spans of a text: words in lower case, of any length and at any distance."""

    def __init__(self, text: str):
        self.text, found = text, [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]

    def _word(self, k: int) -> str:
        return _instance(self.text[self.starts[k] : self.ends[k]].lower()) if 0 <= k < len(self.starts) else ""

    def _piece(self, a: int, b: int) -> str:
        """What is glued to a span; "+" for more than a word's worth."""
        return self.text[a:b].lower() if b - a <= MOST_CHARS else "+"

    def patterns(self, a: int, b: int) -> tuple[str, str]:
        k = bisect_left(self.starts, a) - 1
        if k >= 0 and self.ends[k] > a:
            left = [self._word(k - 1), self._piece(self.starts[k], a)]
        else:
            left = [self._word(k - 1), self._word(k)]
        k = bisect_right(self.ends, b)
        right = self._piece(b, self.ends[k]) if k < len(self.ends) and self.starts[k] < b else self._word(k)
        return f"L2 {left[0]} {left[1]}", f"LR {left[1]} {right}"


def _grouped(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of digit groups between base spans, out to the edges of the tokens that they start and end in."""
    free = b = 0
    for x, y in [*taken, (len(text), len(text))]:
        for m in _GROUPS.finditer(text, free, x) if free < x else ():
            if m.end() <= b:
                continue
            a, b = m.span()
            while a > free and not text[a - 1].isspace() and text[a - 1] not in _EDGE:
                a -= 1
            while b < x and not text[b].isspace() and text[b] not in _EDGE:
                b += 1
            yield a, b
        free = max(free, y)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans over the same places, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidates(text: str, spans: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """(start, end) of the identifier-like tokens and digit groups apart from the base spans."""
    if not _DIGIT.search(text) and "@" not in text:
        return []
    taken, found = _united([(a, b) for a, _, b in spans]), set()
    ends = [b for _, b in taken]
    for m in _TOKEN.finditer(text):
        token = m.group()
        if not _DIGIT.search(token) and "@" not in token:
            continue
        word = token.strip(_EDGE)
        a = m.start() + len(token) - len(token.lstrip(_EDGE))
        b = a + len(word)
        k = bisect_right(ends, a)
        if not word or k < len(taken) and taken[k][0] < b:
            continue
        if "@" in word[1:-1] or sum(c in "0123456789" for c in word) >= MIN_DIGITS:
            found.add((a, b))
    found |= {(a, b) for a, b in _grouped(text, taken) if sum(c in "0123456789" for c in text[a:b]) >= MIN_DIGITS}
    return sorted(found)


def _instances(text: str, spans: list[tuple[int, str, int]]) -> list[tuple]:
    """(start, end, kind or None, instance, patterns) of the seeds and candidates."""
    found = [(a, b, kind) for a, kind, b in spans] + [(a, b, None) for a, b in candidates(text, spans)]
    if not found:
        return []
    contexts = _Contexts(text)
    return [(a, b, kind, _instance(text[a:b]), contexts.patterns(a, b)) for a, b, kind in found]


def outermost(added: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Those that lie in no longer one: a token within a run of groups is part of it."""
    out, end = [], -1
    for a, kind, b in sorted(added, key=lambda s: (s[0], -s[2])):
        if b > end:
            out.append((a, kind, b))
            end = b
    return out


def together(base: list[tuple[int, str, int]], added: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Base and added spans by start, then kind."""
    return sorted([*base, *added], key=lambda s: (s[0], ALL_KINDS.index(s[1]), s[2]))


def all_spans(text: str, patterns: dict[str, tuple[float, str]]) -> list[tuple[int, str, int]]:
    """The base spans and secrets, and those that the patterns (score and kind) add."""
    base, added = [*base_spans(text), *secret_spans(text)], []
    for a, b, kind, _, around in _instances(text, base):
        found = [patterns[p] for p in around if p in patterns] if kind is None else []
        if found:
            added.append((a, min(found, key=lambda x: (-x[0], ALL_KINDS.index(x[1])))[1], b))
    return together(base, outermost(added))


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("t", pa.int64()), ("base", pa.string()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("secrets", pa.string()), ("n_secret", pa.int64()),
    ("found", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))),
])
_DDL = "doc_id bigint, t bigint, base string, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, secrets string, n_secret bigint, found array<struct<start:int,end:int,kind:string,instance:string,patterns:array<string>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in _SCHEMA]
        for doc_id, scalar, t in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            text = scalar.as_py() or ""
            spans, secrets = base_spans(text), secret_spans(text)
            base = listed(spans)
            counts = [sum(k == kind for _, k, _ in spans) for kind in KINDS]
            found = [{"start": a, "end": b, "kind": kind, "instance": word, "patterns": list(around)} for a, b, kind, word, around in _instances(text, [*spans, *secrets])]
            for c, x in zip(columns, (doc_id, t, base, *counts, hashlib.sha256(base.encode()).hexdigest(), listed(secrets), len(secrets), found)):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)
    release()


def discovered(found: DataFrame, work: Workspace, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """pattern, kind and score of the patterns that discover instances, a row for each pattern.

    ``found`` has kind (null for candidates), instance and pattern. Seeds of one
    kind are negative for the others. Instances of a confident pattern whose own
    score reaches ``confidence`` become seeds of its kind, and the graph is scored
    again, until none is new; there are no more turns than instances.
    """
    edges = work.write(found.groupBy("pattern", "kind", "instance").agg(F.log1p(F.count("*")).alias("weight")), "edges")
    size = edges.count()
    bases = edges.where("kind is not null").select("instance", F.col("kind").alias("known")).distinct()
    promoted = work.write(bases.limit(0), "promoted", 0)
    order = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("of"))
    mean = lambda of: F.sum(F.col("weight") * F.col(of)) / F.sum("weight")
    while True:
        labelled = edges.join(promoted, "instance", "left").withColumn("kind", F.coalesce("kind", "known")).drop("known")
        labelled = work.write(labelled, "labelled", size)
        # Per kind: edges from each pattern with a seed of the kind to all its instances.
        kinds = work.write(labelled.where("kind is not null").select("pattern", F.col("kind").alias("of")).distinct(), "kinds", size)
        seed = F.when(F.col("kind").isNotNull(), (F.col("kind") == F.col("of")).cast("double"))
        graph = work.write(labelled.join(kinds, "pattern").select("pattern", "of", "instance", "weight", seed.alias("seed")), "graph", size)
        score = graph.withColumn("s", F.coalesce("seed", F.lit(0.0)))
        for _ in range(rounds):
            patterns = score.groupBy("pattern", "of").agg(mean("s").alias("p"))
            instances = graph.where("seed is null").join(patterns, ["pattern", "of"]).groupBy("instance", "of").agg(mean("p").alias("i"))
            score = graph.join(instances, ["instance", "of"], "left").withColumn("s", F.coalesce("seed", "i", F.lit(0.0))).drop("i")
        score = work.write(score, "scores", size)
        seeds = F.count_distinct(F.when(F.col("seed") == 1, F.col("instance")))
        final = score.groupBy("pattern", "of").agg(mean("s").alias("score"), seeds.alias("seeds"))
        final = work.write(final.where((F.col("seeds") >= min_seeds) & (F.col("score") >= confidence)).select("pattern", "of", "score"), "patterns", size)
        new = score.where((F.col("seed").isNull()) & (F.col("s") >= confidence)).join(final.select("pattern", "of"), ["pattern", "of"], "left_semi")
        new = new.groupBy("instance").agg(F.min_by("of", F.struct(-F.col("s"), order)).alias("known"))
        new = work.write(new.unionByName(promoted), "promoted", size)
        if new.count() == promoted.count():
            return final.groupBy("pattern").agg(F.min_by(F.struct(F.col("of").alias("kind"), "score"), F.struct(-F.col("score"), order)).alias("best")).select("pattern", "best.*")
        promoted = new


def _scanned(docs: DataFrame, work: Workspace) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    return work.write(map_texts(rows, _scan, _DDL), "scanned")


def _each(scanned: DataFrame) -> DataFrame:
    each = scanned.where(F.size("found") > 0).select("doc_id", "t", F.explode("found").alias("f"))
    return each.select("doc_id", "t", "f.start", "f.end", "f.kind", "f.instance", F.explode("f.patterns").alias("pattern"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """spans and n_added of rows with base spans, secrets and added spans."""
    for batch in batches:
        spans, n_added = [], []
        for base, secrets, found in zip(*(batch.column(c).to_pylist() for c in ("base", "secrets", "added"))):
            added = outermost([(x["start"], x["kind"], x["end"]) for x in found or ()])
            known = [(int(a), kind, int(b)) for kind, a, b in (x.split(":") for x in f"{base},{secrets}".split(",") if x)]
            spans.append(listed(together(known, added)) if added or secrets else base)
            n_added.append(len(added))
        keep = [c for c in batch.schema.names if c not in ("base", "secrets", "added")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(spans, pa.string()), pa.array(n_added, pa.int64())], names=[*keep, "spans", "n_added"])
    release()


def personal_data(docs: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret, n_personal, has_personal_data and t, a row for each row of docs.

    The counts and the digest are of the base spans; spans lists base spans, secrets and added
    spans as kind:start:end in code points, by start, then kind; n_personal is
    their number. Null and empty texts have none; texts of any length are read
    whole. Rows with equal doc_id and text share their added spans and keep a row
    each, also where doc_id is null. An empty table gives no rows. Only doc_id
    and text are read, so other columns may have any name; t is a hash of the text.
    """
    work = Workspace(docs.sparkSession, "personal-data")
    scanned = _scanned(docs, work)
    each = _each(scanned)
    patterns = work.write(discovered(each.select("pattern", "kind", "instance"), work, rounds, min_seeds, confidence), "found")
    order = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind"))
    added = each.where("kind is null").drop("kind").join(patterns, "pattern")
    added = added.groupBy("doc_id", "t", "start", "end").agg(F.min_by("kind", F.struct(-F.col("score"), order)).alias("kind"))
    added = added.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added")).select(F.col("doc_id").alias("a_id"), F.col("t").alias("a_t"), "added")
    added = work.write(added, "added")
    work.only(scanned, added)
    both = scanned.drop("found").join(added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("t") == F.col("a_t")), "left")
    counts = [f"n_{k}" for k in KINDS]
    both = both.select("doc_id", "t", "base", "secrets", "added", *counts, "base_sha256", "n_secret")
    ddl = "doc_id bigint, t bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, n_secret bigint, spans string, n_added bigint"
    out = map_texts(both, _listed, ddl).withColumn("n_personal", sum((F.col(c) for c in [*counts, "n_secret"]), F.col("n_added")))
    return out.select("doc_id", *counts, "base_sha256", "spans", "n_added", "n_secret", "n_personal", (F.col("n_personal") > 0).alias("has_personal_data"), "t")


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span, or overlapping spans together, as [KIND]."""
    at, out = 0, []
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame, most: int = BROADCAST_PATTERNS) -> DataFrame:
    """All rows and columns of docs, with personal data in text redacted.

    Null and empty texts stay as they are; rows with equal text are redacted
    alike, also where doc_id is null; an empty table gives no rows; columns of
    any name but doc_id and text are only carried. Up to ``most`` patterns are
    broadcast and the texts aren't shuffled; beyond that spans are joined to the
    texts, with the same result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "redaction")
    patterns = work.write(discovered(_each(_scanned(docs, work)).select("pattern", "kind", "instance"), work), "found")
    if patterns.count() <= most:
        known = spark.sparkContext.broadcast({r.pattern: (r.score, r.kind) for r in patterns.collect()})
        work.clear()

        @F.arrow_udf("string")
        def cut(texts: pa.Array) -> pa.Array:
            return pa.array([t if not t else redacted(t, all_spans(t, known.value)) for t in (x.as_py() for x in texts)], pa.string())

        return docs.withColumn("text", cut(F.col("text").cast("string")))
    work.clear()
    name, key, cuts = fresh(docs.columns, "p_id", "p_t", "spans")
    spans = personal_data(docs).where("n_personal > 0").dropDuplicates(["doc_id", "t"]).select(F.col("doc_id").alias(name), F.col("t").alias(key), F.col("spans").alias(cuts))

    @F.arrow_udf("string")
    def cut_at(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist()):
            out.append(redacted(text, [(int(a), kind, int(b)) for kind, a, b in (x.split(":") for x in found.split(","))]) if found else text)
        return pa.array(out, pa.string())

    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(name)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key))
    return docs.join(spans, same, "left").withColumn("text", cut_at(F.col("text").cast("string"), F.col(cuts))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("t")
