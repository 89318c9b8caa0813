"""Operator 3: toxicity by a weighted finite-state pattern grammar.

A clause is a lattice: each token is an arc with its class (insult, threat,
intent, target, negation, reporting verb, quotation mark, other) and a weight,
and each insult or threat of several words is one arc over all of them. Five
transducers read the classes and multiply the weights by factors: insults (more
with a target on either side), threats (with a target on either side or for a
quarter, more soon after an intent), negation and reported speech. Where a target may
still follow, a transducer goes both ways and the promise has to be kept. Their
composition is searched for the best path over each clause; a document's evidence
is the sum over its matched clauses, and a logistic curve turns it into a score.

Insults come from a small seed lexicon and from the labelled rows of a bounded
sample: words and pairs of words much commoner in toxic documents and found in
many contexts there, so that copies of one document don't make its words look
toxic.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import Workspace, map_texts, small_batches, table

#: Labelled doc_ids to learn from, chosen by a hash of doc_id, about this many at most.
SAMPLE = 20_000
#: Words and pairs of words up to which they are broadcast to be counted in clean documents.
BROADCAST_UNITS = 200_000
#: A learned insult: toxic documents that have it, contexts for each of them, and log odds at least.
MIN_TOXIC, MIN_CONTEXTS, MIN_ODDS = 5, 0.5, 2.5

SEEDS = {
    "insult": "idiot idiots stupid moron morons loser losers scum worthless pathetic disgusting trash clown fool imbecile dumb garbage filth vermin "
    "dummkopf trottel abschaum blöd dumm idiote stupide imbécile connard ordure minable estúpido imbécil idiota basura escoria patético",
    "threat": "kill hurt destroy beat stab shoot burn crush töten schlagen vernichten tuer frapper détruire matar golpear destruir",
    "intent": "will shall gonna going i'll we'll werde werden wird vais allons va voy vamos va",
    "target": "you your yours u he she they them him her it this that these those who du dich dir ihr euch er sie tu te toi vous il elle ils elles tú usted ustedes él ella ellos",
    "negation": "not no never isn't aren't wasn't don't nicht kein keine nie ne pas jamais nunca jamás",
    "report": "said says say told wrote called claims claimed reported quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó",
}
#: Insults and threats of several words.
PHRASES = {
    "insult": ["waste of space", "piece of trash", "piece of garbage", "get lost", "shut up", "halt die klappe", "ferme ta gueule", "cierra la boca"],
    "threat": ["watch your back", "hunt down", "make you pay", "cut your throat"],
}
_SEED_WEIGHT = 2.0

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?", re.UNICODE)
_CLAUSE = re.compile(r"[.!?;:\n]+")
_QUOTES = "\"“”„«»"
_TOKEN = re.compile(rf"[^\W_]+(?:'[^\W_]+)?|[{_QUOTES}]", re.UNICODE)

CLASSES = ("insult", "threat", "intent", "target", "negation", "report", "quote", "other")
Arc = tuple[float, int]  # factor, next state


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, class) -> [(factor, next state)]; "*" stands for all other classes, a missing arc keeps the state at factor 1."""

    arcs: dict[tuple[int, str], list[Arc]]
    final: frozenset[int] | None = None  # None: all

    def step(self, state: int, label: str) -> list[Arc]:
        return self.arcs.get((state, label)) or self.arcs.get((state, "*")) or [(1.0, state)]

    def ends(self, state: int) -> bool:
        return self.final is None or state in self.final


def compose(*machines: Transducer) -> Transducer:
    """The product machine from state 0: factors multiply along the arcs, states are numbered as they are reached."""
    numbers = {(0,) * len(machines): 0}
    arcs: dict[tuple[int, str], list[Arc]] = {}
    todo = list(numbers)
    while todo:
        states = todo.pop()
        for label in CLASSES:
            out = []
            for steps in product(*(m.step(s, label) for m, s in zip(machines, states))):
                after = tuple(s for _, s in steps)
                if after not in numbers:
                    numbers[after] = len(numbers)
                    todo.append(after)
                out.append((prod(f for f, _ in steps), numbers[after]))
            arcs[numbers[states], label] = out
    return Transducer(arcs, frozenset(n for states, n in numbers.items() if all(m.ends(s) for m, s in zip(machines, states))))


def _targeted(label: str, alone: float, targeted: float) -> Transducer:
    """Weights of a class count ``targeted`` times with a target in the clause, before or after, and else ``alone`` times.

    States: no target yet, target seen, target promised.
    """
    arcs = {(0, "target"): [(1.0, 1)], (2, "target"): [(1.0, 1)], (0, label): [(alone, 0), (targeted, 2)], (1, label): [(targeted, 1)], (2, label): [(targeted, 2)]}
    return Transducer(arcs, frozenset((0, 1)))


def insult() -> Transducer:
    return _targeted("insult", 1.0, 1.25)


def threat(span: int = 3, factor: float = 1.25) -> Transducer:
    """A threat counts whole with a target, else for a quarter, and more within ``span`` words after an intent."""
    soon = {(s, "intent"): [(1.0, span)] for s in range(span + 1)}
    for s in range(1, span + 1):
        soon |= {(s, "threat"): [(factor, s - 1)], (s, "*"): [(1.0, s - 1)]}
    return compose(_targeted("threat", 0.25, 1.0), Transducer(soon))


def negation(span: int = 3, factor: float = 0.25) -> Transducer:
    """After a negation, the next ``span`` words count ``factor`` times."""
    arcs = {(s, "negation"): [(1.0, span)] for s in range(span + 1)}
    for s in range(1, span + 1):
        arcs |= {(s, c): [(factor, s - 1)] for c in ("insult", "threat")} | {(s, "*"): [(1.0, s - 1)]}
    return Transducer(arcs)


def reported(factor: float = 0.5) -> Transducer:
    """After a reporting verb, or between quotation marks, words count ``factor`` times."""
    arcs = {(0, "report"): [(1.0, 1)], (0, "quote"): [(1.0, 2)], (1, "quote"): [(1.0, 2)], (2, "quote"): [(1.0, 0)]}
    return Transducer(arcs | {(s, c): [(factor, s)] for s in (1, 2) for c in ("insult", "threat")})


def parts() -> list[Transducer]:
    return [insult(), threat(), negation(), reported()]


@cache
def machine() -> Transducer:
    return compose(*parts())


@dataclass
class Grammar:
    """The lexicon (words, and phrases as words joined by a space) and the curve from evidence to score."""

    weights: dict[str, float]
    classes: dict[str, str]
    intercept: float = -3.0
    slope: float = 2.0
    single: frozenset[str] = field(init=False)
    phrases: dict[str, list[tuple[str, ...]]] = field(init=False)
    first: frozenset[str] = field(init=False)

    def __post_init__(self):
        self.phrases, heavy = defaultdict(list), [tuple(w.split()) for w, x in self.weights.items() if x > 0]
        for words in heavy:
            if len(words) > 1:
                self.phrases[words[0]].append(words)
        self.single = frozenset(words[0] for words in heavy if len(words) == 1)
        self.first = self.single | self.phrases.keys()

    def matches(self, tokens: list[str]) -> bool:
        """Whether an insult or threat stands in a clause."""
        if not self.single.isdisjoint(tokens):
            return True
        begin = [i for i, t in enumerate(tokens) if t in self.first]
        return any(tuple(tokens[i : i + len(words)]) == words for i in begin for words in self.phrases[tokens[i]])

    def lattice(self, tokens: list[str]) -> list[list[tuple[int, str, float]]]:
        """For each place of a clause its arcs: tokens covered, class and weight."""
        out = []
        for i, token in enumerate(tokens):
            label = self.classes.get(token) or ("quote" if token in _QUOTES else "other")
            arcs = [(1, label, self.weights.get(token, 0.0))]
            for words in self.phrases.get(token, ()):
                if tuple(tokens[i : i + len(words)]) == words:
                    whole = " ".join(words)
                    arcs.append((len(words), self.classes[whole], self.weights[whole]))
            out.append(arcs)
        return out

    def clause(self, tokens: list[str]) -> float:
        """The weight of the best path of the composed machine over a clause."""
        arcs, ends = machine().arcs, machine().final
        best: list[dict[int, float]] = [{0: 0.0}] + [{} for _ in tokens]
        for i, steps in enumerate(self.lattice(tokens)):
            for n, label, weight in steps:
                after = best[i + n]
                for state, so_far in best[i].items():
                    for factor, to in arcs[state, label]:
                        reached = so_far + factor * weight
                        if reached > after.get(to, -1.0):
                            after[to] = reached
            best[i] = {}
        return max(w for s, w in best[-1].items() if s in ends)

    def evidence(self, text: str) -> float:
        text = text.lower()
        if self.first.isdisjoint(_WORD.findall(text)):
            return 0.0
        total = 0.0
        for clause in _CLAUSE.split(text):
            tokens = _TOKEN.findall(clause)
            if self.matches(tokens):
                total += self.clause(tokens)
        return total

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-(self.intercept + self.slope * evidence), -700, 700)))


def seed_grammar() -> Grammar:
    classes = {w: c for c in ("report", "negation", "target", "intent", "threat", "insult") for w in SEEDS[c].split()}
    classes |= {w: c for c, some in PHRASES.items() for w in some}
    return Grammar({w: _SEED_WEIGHT for w, c in classes.items() if c in PHRASES}, classes)


def held_out(doc_id="doc_id"):
    """Rows that no label is learned from; a null doc_id is one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, toxic and text of the sample of labelled doc_ids, one row for each.

    Of a doc_id's labels the greatest counts, of its texts the smallest.
    """
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("text is not null")
    return texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word and pair of words of a text, with the word before its first occurrence."""
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            words = _WORD.findall(text.as_py().lower())
            seen: dict[str, str] = {}
            for before, word in zip(["", *words], words):
                seen.setdefault(word, before)
            for before, a, b in zip(["", *words], words, words[1:]):
                seen.setdefault(f"{a} {b}", before)
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.string()), pa.array([toxic] * len(seen), pa.int32())], names=["unit", "before", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """A grammar whose weights and curve come from a bounded sample of labelled rows.

    Without labels it is the seed grammar.
    """
    grammar, work = seed_grammar(), Workspace(docs.sparkSession, "toxicity")
    train = work.write(_training(docs, labels, sample), "train")
    sizes = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        work.clear()
        return grammar
    units = lambda which: map_texts(train.where(F.col("toxic") == which).select("text", "toxic"), _units, "unit string, before string, toxic int")
    toxic = units(1).groupBy("unit").agg(F.count("*").alias("df1"), F.approx_count_distinct("before").alias("contexts"))
    seeds = docs.sparkSession.createDataFrame([(w, 0) for w in grammar.weights], "unit string, df1 bigint")
    # Seeds are counted whether or not a toxic document has them.
    common = toxic.join(F.broadcast(seeds.select("unit", F.lit(True).alias("seed"))), "unit", "left").where((F.col("df1") >= MIN_TOXIC) & (F.col("contexts") >= MIN_CONTEXTS * F.col("df1")) | F.col("seed"))
    common = work.write(common.select("unit", "df1").unionByName(seeds).groupBy("unit").agg(F.max("df1").alias("df1")), "common")
    asked = common.select("unit")
    clean = units(0).join(F.broadcast(asked) if common.count() <= BROADCAST_UNITS else asked, "unit", "left_semi").groupBy("unit").agg(F.count("*").alias("df0"))
    found = {r.unit: (r.df1, r.df0) for r in common.join(clean, "unit", "left").fillna(0, ["df0"]).collect()}
    for unit, (df1, df0) in sorted(found.items(), key=lambda x: (x[0].count(" "), x[0])):
        odds = float(np.log((df1 + 0.5) / (sizes[1] + 1)) - np.log((df0 + 0.5) / (sizes[0] + 1)))
        if unit in grammar.weights:
            if df1 or df0:  # the seed counts like a few toxic documents
                grammar.weights[unit] = max(0.0, (5 * _SEED_WEIGHT + (df1 + df0) * odds) / (5 + df1 + df0)) if df1 else 0.0
        elif odds >= MIN_ODDS and df1 >= 4 * df0 and unit not in grammar.classes and grammar.weights.keys().isdisjoint(unit.split()):
            grammar.weights[unit], grammar.classes[unit] = odds, "insult"
    grammar.__post_init__()

    scored = map_texts(train.select("text", "toxic"), _evidence(grammar), "toxic int, evidence double").collect()
    work.clear()
    x, y = np.array([r.evidence for r in scored]), np.array([float(r.toxic) for r in scored])
    grammar.intercept, grammar.slope = _logistic(x, y)
    return grammar


def _evidence(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([grammar.evidence(t.as_py()) for t in batch.column(0)], pa.float64())], names=["toxic", "evidence"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not negative) of a logistic curve, by Newton steps with a weak prior."""
    a, b = -3.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(-(a + b * x), -700, 700)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum() - 0.01 * a, ((y - p) * x).sum() - 0.01 * (b - 1)])
        h = np.array([[w.sum() + 0.01, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), max(0.0, b + float(np.clip(step[1], -2, 2)))
        if abs(step).max() < 1e-9:
            break
    return a, b


def score_column(grammar: Grammar):
    """A function from a text column to the score; a null text counts as empty."""

    small_batches(SparkSession.active())

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(grammar.score(np.array([grammar.evidence(t.as_py() or "") for t in texts], dtype=float)), pa.float64())

    return score


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of docs.

    A null text counts as empty and gets the curve's value at no evidence; texts
    of any length are read whole. Repeated rows keep a row each; a null doc_id
    counts as held out. Labels that are null, not 0 or 1, or of no document are
    unused; of a doc_id's labels the greatest counts and of its texts the
    smallest is learned from. Without usable labels the seed grammar scores.
    Only doc_id, text and the labels' doc_id and toxic are read. An empty table
    gives no rows.
    """
    grammar = learn(docs, labels, sample)
    scored = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).select("doc_id", held_out().alias("held_out"), score_column(grammar)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
