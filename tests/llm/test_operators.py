"""The operators that SQL doesn't express, against brute force, round trips and held-out labels; edge cases of all."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moraine.llm import bpe, decontaminate, graph, langid, minhash, pii, quality, registry, substring, token_counts, toxicity, warc
from moraine.llm.common import Workspace, table, tokenizer_path
from tests.oracle import compare, connect

EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, "null id here"), (None, "null id here"), (5, "word " * 30000), (6, "x" * 50000), (7, "\x00 tail \x0b end"), (8, "ÄÖ ß é 日本 ½")]


@pytest.fixture(scope="module")
def edges(spark):
    """Edge rows with extra columns that clash with names inside the operators."""
    rows = [(d, t, 1, "x", 2, b"k") for d, t in EDGES]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n int, h string, row int, text_key binary").repartition(3)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


EDGE_IDS = sorted((d for d, _ in EDGES), key=str)


# --- decontamination


def test_decontamination_oracles(spark, sf_oracle):
    con = connect(sf_oracle)
    for name, sql in registry.oracle_sql().items():
        compare(registry.queries()[name](spark, sf_oracle), con, sql)


def brute_hits(text, items, window):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = cut(text), set(), set()
    for item_id, t in items:
        w = cut(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[i : i + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item_id))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [10**6, 0])
@pytest.mark.parametrize("window", [1, 3, 7, 10])
def test_decontamination_brute(spark, most, window):
    r = random.Random(window)
    text = lambda n: " ".join(r.choice(["a", "B", "c-d", "é", "x1"]) for _ in range(n))
    docs = [(i, text(r.randrange(40))) for i in range(40)] + [(99, None), (99, None)]
    items = [(i, text(r.randrange(2 * window))) for i in range(6)] + [(3, text(4)), (77, None), (78, "--")]
    got = decontaminate.decontaminated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), window, most)
    assert sorted(map(tuple, got.collect())) == sorted((d, *brute_hits(t, items, window)) for d, t in docs)


def test_decontamination_removal(spark, edges):
    items = spark.createDataFrame([(1, "w1 w2 w3 w4"), (2, "")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "- A b! W1 w2, w3 w4; tail"), (2, None), (3, "w1 w2 w3")], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in decontaminate.without_spans(docs, items).collect()} == {1: "- A b! tail", 2: None, 3: "w1 w2 w3"}
    assert ids(decontaminate.clean_documents(docs, items)) == [2, 3]
    none = items.limit(0)
    assert ids(decontaminate.decontaminated(edges, none)) == EDGE_IDS == ids(decontaminate.clean_documents(edges, items))
    assert ids(decontaminate.decontaminated(edges, items)) == EDGE_IDS
    assert decontaminate.decontaminated(edges.limit(0), items).count() == 0


def test_bootstrapping_finds_grouped_and_long_identifiers(spark):
    known = [(i, f"Please reach me by phone number +1 555 0{i}0 4{i}{i}7 today.") for i in range(8)]
    mails = [(20 + i, f"You may write to address someone{i}@example.org any time.") for i in range(8)]
    odd = "ü" * 70 + "@" + "ö" * 20
    grouped = ["555 0199 4471", "(030) 123 45 67", "(030) 1234567", "[030] 123.45.67", "DE89 3704 0044 0532 0130 00", "1234567"]
    unseen = [(100 + i, f"Please reach me by phone number {g} today.") for i, g in enumerate(grouped)]
    docs = spark.createDataFrame([*known, *mails, *unseen, (200, f"You may write to address {odd} any time."), (201, "The years 1990 1991 1992 passed.")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    texts = {r.doc_id: r.text for r in pii.without_personal_data(docs).collect()}
    for i, g in enumerate(grouped):
        assert (rows[100 + i].n_added, rows[100 + i].spans.count(":")) == (1, 2), g
        assert texts[100 + i] == "Please reach me by phone number [PHONE] today.", g
    assert texts[200] == "You may write to address [EMAIL] any time." and rows[201].spans == ""


# --- toxicity and language


def test_toxicity_held_out(spark, sf_oracle, edges):
    labels = table(spark, sf_oracle, "labels")
    got = toxicity.op3_toxicity(spark, sf_oracle).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and (r.score >= 0.5) == r.predicted for r in got)
    assert sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got) and any(r.toxic for r in got)
    for some in (labels, labels.limit(0)):
        assert ids(toxicity.toxicity(edges, some)) == EDGE_IDS
    assert toxicity.toxicity(edges.limit(0), labels).count() == 0


def test_seeds_of_clean_documents_alone_count_nothing(spark):
    rows = [(i, "we burn wood in the stove") if i % 2 else (i, f"you w{i} idiot") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    grammar = toxicity.learn(docs, labels)
    assert grammar.weights["burn"] == 0 and grammar.evidence("they burn wood") == 0
    assert grammar.weights["idiot"] > 0 and grammar.weights["kill"] == 2.0


def test_held_out_rows(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)], "doc_id bigint").select("doc_id", toxicity.held_out().alias("t"), langid.held_out().alias("l")).collect()
    for r in rows:
        c = zlib.crc32(str(r.doc_id).encode())
        assert (r.t, r.l) == (c % 5 == 0, c % 3 == 1)


def brute_path(grammar, tokens):
    """The best weight over every way through a clause, machine by machine and without their composition."""
    machines, arcs = toxicity.parts(), grammar.lattice(tokens)

    def best(i, states):
        if i == len(tokens):
            return 0.0 if all(m.ends(s) for m, s in zip(machines, states)) else None
        found = []
        for n, label, weight in arcs[i]:
            for steps in itertools.product(*(m.step(s, label) for m, s in zip(machines, states))):
                rest = best(i + n, tuple(s for _, s in steps))
                if rest is not None:
                    found.append(weight * math.prod(f for f, _ in steps) + rest)
        return max(found, default=None)

    return best(0, (0,) * len(machines))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("idiot kill you not said will waste of space get lost watch your back \" the day".split()), max_size=9))
def test_best_path_against_every_path(tokens):
    grammar = toxicity.seed_grammar()
    assert abs(grammar.clause(tokens) - brute_path(grammar, tokens)) < 1e-9


def test_grammar_context():
    g = toxicity.seed_grammar()
    weight = g.evidence("you are an idiot")
    assert g.evidence("an idiot") < weight and g.evidence("you are not an idiot") < weight and g.evidence('he said "you idiot"') < weight and g.evidence("a fine day") == 0
    assert g.evidence("kill you") == g.evidence("you kill") > g.evidence("kill the process") and g.evidence("I will hurt you") > g.evidence("I hurt you")
    assert g.evidence("you waste of space") > g.evidence("waste of space") > g.evidence("waste of time") == 0
    assert g.evidence("you idiot. " * 50) == 50 * g.evidence("you idiot.")


def test_repeated_rows_keep_the_samples_bounded(spark):
    rows = [(1, "en", "you idiot of the day")] * 2000 + [(i, "en" if i % 2 else "de", f"words of text {i} and more") for i in range(2, 60)] + [(1, "en", "another text of one id"), (1, "de", "and another")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(4)
    got = langid.sampled(docs, per_language=10).groupBy("lang").count().collect()
    assert all(0 < r["count"] <= 10 for r in got)
    assert len(langid.sampled(docs, per_language=10, most=7).collect()) <= 7
    labels = spark.createDataFrame([(1, 1)] * 50 + [(i, i % 2) for i in range(1, 60)], "doc_id bigint, toxic int")
    train = toxicity._training(docs, labels, 100).collect()
    assert len(train) == len({r.doc_id for r in train}) and len(train) < 60
    assert ids(toxicity.toxicity(docs, labels)) == sorted((d for d, _, _ in rows), key=str) == ids(langid.languages(docs))


def test_language_held_out(spark, sf_oracle, edges):
    docs = table(spark, sf_oracle, "documents").select("doc_id", "lang")
    got = langid.op6_language_id(spark, sf_oracle).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 0
    unlearned = langid.languages(edges.withColumn("lang", F.lit(None).cast("string")))
    assert ids(unlearned) == EDGE_IDS and {r.lang_pred for r in unlearned.collect()} == {"und"}
    assert langid.languages(edges.withColumn("lang", F.lit("en")).limit(0)).count() == 0


def test_language_kernel_brute(spark):
    """Kernel, landmarks and ridge regression from sets of n-grams, against the folded matrix."""
    r, alphabets = random.Random(3), {"aa": "abcde fg", "bb": "defgh ij", "cc": "áéíóú bc"}
    text = lambda lang: "".join(r.choice(alphabets[lang]) for _ in range(80))
    train = [(lang, text(lang)) for lang in alphabets for _ in range(12)]
    model = langid.fit([(lang, langid.present(t)) for lang, t in train], landmarks=5)
    sets = lambda t: set(brute_grams(t))
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    known = [(lang, sets(t)) for lang, t in train]
    marks = [x for name in alphabets for x in [g for lang, g in known if lang == name][:5]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    root = vectors / np.sqrt(values)
    z = lambda g: np.append(np.array([kernel(g, m) for m in marks]) @ root, 1.0)
    x, y = np.array([z(g) for _, g in known]), np.array([[1.0 if lang == name else -1.0 for name in alphabets] for lang, _ in known])
    beta = np.linalg.solve(x.T @ x / 12 + langid.RIDGE * np.eye(x.shape[1]) / 3, x.T @ y / 12)
    new = [text(lang) for lang in alphabets for _ in range(10)]
    # The bias is the same for all languages' scores of a text only if they are alike; the model leaves it out.
    want = [sorted(alphabets)[int(np.argmax(z(sets(t))[:-1] @ beta[:-1]))] for t in new]
    assert model.predict(new)[0] == want and model.predict([None, "", "12 !?"]) == (["und"] * 3, [0.0] * 3)


def brute_grams(text):
    """The buckets of the n-grams of a text, one by one."""
    points = [32 if ord(c) <= 32 or c in "0123456789" else ord(c) for c in " " + text.lower() + " "]
    p, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            h = points[i] * p & mask
            for k in range(1, n):
                h = ((h + k + 1) * p + points[i + k]) & mask
            yield ((h ^ (h >> 29)) * p & mask) >> 49


# --- personal data

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def brute_base(text):
    out = []
    for k, (kind, (pattern, good)) in enumerate(BASE.items()):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if good(m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "@", "x@y.z", ".", "1", "255", "256.", "10.0.0.1", "+", "+1 (555) 010-99", "4111 1111 1111 1111", "-", " ", "(", ")", "é", "\n", "0" * 14]), max_size=25).map("".join))
def test_base_spans(text):
    assert pii.listed(pii.base_spans(text)) == brute_base(text)


def test_personal_data(spark, sf_small, edges):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_small, "documents").collect()}
    for r in pii.op5_personal_data(spark, sf_small).collect():
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(",")) and r.n_email == base.count("email:")
    assert ids(pii.personal_data(edges)) == EDGE_IDS
    assert pii.personal_data(edges.limit(0)).count() == 0


def test_bootstrapping_finds_unseen_identifiers(spark):
    known = [(i, f"Please reach me by phone number +1 555 0{i}0 4{i}{i}7 today.") for i in range(8)]
    unseen = [(100, "Please reach me by phone number 555-0199-4471 today."), (101, "The reference 555-0199-4471 stands.")]
    docs = spark.createDataFrame([*known, *unseen], "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert got[100] == "phone:32:45" and got[101] == ""
    texts = {r.doc_id: r.text for r in pii.without_personal_data(docs).collect()}
    assert texts[100] == "Please reach me by phone number [PHONE] today." and texts[0].count("[PHONE]") == 1


def test_bootstrapping_in_two_hops(spark):
    known = [(i, f"Please reach me by phone number +1 555 0{i}0 4{i}{i}7 today.") for i in range(8)]
    both = [f"555-0199-44{i}1" for i in range(4)]
    first = [(20 + i, f"Please reach me by phone number {x} today.") for i, x in enumerate(both)]
    second = [(30 + i, f"The night hotline answers {x} always.") for i, x in enumerate(both)]
    docs = spark.createDataFrame([*known, *first, *second, (99, "The night hotline answers 777-8888-123 always."), (98, "The order 777-8888-123 shipped.")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert got[99].spans == "phone:26:38" and got[99].has_personal_data and got[98].n_personal == 0
    for most in (pii.BROADCAST_PATTERNS, 0):
        texts = {r.doc_id: r.text for r in pii.without_personal_data(docs, most).collect()}
        assert texts[99] == "The night hotline answers [PHONE] always." and texts[98] == "The order 777-8888-123 shipped."


def test_secrets(spark):
    texts = ['the token = "04dbebab91ab85687d33" ends', "API_KEY: sk-1a2b3c4d5e, a@b.example", "a token of esteem: none, secret: nothing1", "password=hunter42x. token=short1", "token = " + " " * 50_000 + "x", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert [got[i].n_secret for i in range(6)] == [1, 1, 1, 1, 0, 0] and [got[i].n_personal for i in range(6)] == [1, 2, 1, 1, 0, 0]
    assert got[0].spans == "secret:13:33" and got[1].spans == "secret:9:22,email:24:35" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].spans == "secret:9:18"
    for most in (pii.BROADCAST_PATTERNS, 0):
        cut = {r.doc_id: r.text for r in pii.without_personal_data(docs, most).collect()}
        assert cut[0] == 'the token = "[SECRET]" ends' and cut[1] == "API_KEY: [SECRET], [EMAIL]" and cut[4] == texts[4] and cut[5] is None


def test_contexts_reach_any_distance():
    text = "number" + " " * 500 + ": (" + " " * 300 + "555-0199-4471" + " " * 400 + "w" * 90
    (a, b, kind, word, around), = pii._instances(text, [])
    assert word == "555-0199-4471" and around[0] == "L2  number" and around[1].startswith("LR number ") and len(around[1]) == len("LR number ") + 64
    assert pii.candidates("x" * 200_000 + " 1", []) == [] and len(pii.candidates("a" * 100_000 + "@" + "b" * 100_000, [])) == 1


# --- substring


def brute_units(text):
    """Units character by character: they end at a line's end, and after a clause's mark and blanks if the last four words or more follow the mark before."""
    begin = sentence = i = 0
    while i <= len(text):
        if i == len(text) or text[i] == "\n":
            if text[begin:i].split():
                yield begin, i, len(text[begin:i].split()), " ".join(text[begin:i].split()).lower()
            begin = sentence = i = i + 1
            continue
        j = i
        while j < len(text) and text[j] in ".!?,;:":
            j += 1
        k = j
        while j > i and k < len(text) and text[k] != "\n" and text[k].isspace():
            k += 1
        if k > j > i:
            if len(text[sentence:k].split()) >= 4 or k == len(text) or text[k] == "\n":
                if text[begin:k].split():
                    yield begin, k, len(text[begin:k].split()), " ".join(text[begin:k].split()).lower()
                begin = k
            sentence = k
        i = max(k, i + 1)


def test_substring_brute(spark, edges):
    r = random.Random(5)
    line = lambda: "".join(r.choice("abcdefgh") * 2 + r.choice([" ", " ", " ", ". ", "!? ", ", ", ":", "  ", "."]) for _ in range(r.randrange(1, 40)))
    pool = [line() for _ in range(12)]
    docs = [(i, "\n".join(r.choice(pool) if r.random() < 0.5 else line() for _ in range(r.randrange(6)))) for i in range(40)] + [(50, None)]
    seen, want = set(), {}
    for d, t in sorted(docs):
        spans, run = [], None
        for a, b, n, norm in brute_units(t or ""):
            if norm in seen:
                run = [run[0], b, run[2] + n] if run else [a, b, n]
            else:
                spans, run = spans + ([run] if run else []), None
            seen.add(norm)
        want[d] = [(a, b) for a, b, n in spans + ([run] if run else []) if n >= substring.MIN_WORDS]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in substring.repeated_spans(frame).collect()}
    assert got == want and any(want.values())
    texts = {x.doc_id: x.text for x in substring.without_repeats(frame).collect()}
    assert all(texts[d] == t for d, t in docs if not want[d])
    assert ids(substring.repeated_spans(edges)) == EDGE_IDS
    assert substring.repeated_spans(edges.limit(0)).count() == 0


def test_substring_removes_short_repeats(spark):
    long = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"Read more\n{long}\nfirst"), (2, f"other\nread  MORE\nmiddle\n{long}"), (3, "Read more\nRead more\nlast")], "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.removed_words, r.longest_run) for r in substring.repeated_spans(docs).collect()}
    assert got == {1: (0, 0, 0), 2: (2, 12, 10), 3: (2, 4, 4)}
    assert {r.doc_id: r.text.split() for r in substring.without_repeats(docs).collect()} == {1: f"Read more {long} first".split(), 2: ["other", "middle"], 3: ["last"]}


def test_substring_catches_passages_in_mid_sentence(spark):
    """A passage of 60 words, cut off within sentences at both ends, is one long run; repeated rows change nothing."""
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) + r.choice(["", "", "", "", "", ","]) for _ in range(n))
    passage = words(60)
    rows = [(i, f"{words(30)} {passage} {words(30)}") for i in range(4)] + [(9, words(120))]
    docs = spark.createDataFrame(rows * 3, "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.longest_run for x in substring.repeated_spans(docs).collect()}
    assert got[0] == got[9] == 0 and all(30 <= got[i] <= 60 for i in (1, 2, 3))


# --- WARC


def test_warc_round_trip(spark):
    rows = [(5, "u", "<a>"), (3, "v", "<a>"), (9, "w", "é" * 100), (8, None, None), (2, "x\r\ny", ""), (None, "n", "<a>"), (7, "z", "\r\n\r\nWARC/1.1\x1f" * 3000), (9, "w", "é" * 100), (1, "q", "one")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, revisit int").repartition(3)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    got = sorted(warc.round_trip(pages).drop("url", "html").collect(), key=repr)

    def want(p, h):
        data = (h or "").encode()
        again = p != first.get(h or "", p)
        return p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None

    assert sorted(map(tuple, got), key=repr) == sorted((want(p, h) for p, _, h in rows), key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_ranges(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "<p>" + "ab" * (i * 37 % 900)) for i in range(120)], "page_id bigint, url string, html string").repartition(2)
    archives = warc.write(pages, str(tmp_path / "w"))
    whole = sorted(map(tuple, warc.read(archives).collect()))
    assert len(whole) == 120 and sorted(map(tuple, warc.read(archives, 97).collect())) == whole


def test_warc_damage_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}" + "ab" * 200) for i in [*range(40), 7, 7]] + [(None, "u", "x")] * 2, "page_id bigint, url string, html string").coalesce(1)
    archives = warc.write(pages, str(tmp_path / "w"))
    path = archives.first().path.removeprefix("file:")
    data = open(path, "rb").read()
    starts = [m.start() for m in re.finditer(rb"\x1f\x8b\x08", data)]
    names = re.findall(rb"WARC-Record-ID: (\S+)", b"".join(zlib.decompress(data[a:b], 31) for a, b in zip(starts, [*starts[1:], len(data)])))
    assert archives.first().records == len(names) == len(set(names)) == 44
    for place in (starts[0] + 1, starts[5] + 60, starts[20], starts[-1] + 30):
        for size in (warc.RANGE, 300):
            with open(path, "wb") as f:
                f.write(data[:place] + bytes([data[place] ^ 0xFF]) + data[place + 1 :])
            with pytest.raises(Exception, match="DamagedArchive"):
                warc.read(archives, size).collect()
            assert warc.read(archives, size, strict=False).count() == 43


# --- quality


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = len({p for found in at.values() if len(found) > 1 for i in found for p in range(i, i + 8)})
    failed = len(words) < 20 or 100 * repeated > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeated, failed


def test_quality_brute(spark, sf_small, edges):
    labels = table(spark, sf_small, "labels")
    r = random.Random(2)
    made = [(1000 + i, "".join(r.choice(["a", "b ", "c ", "\n", "#x ", "\x0b", "é "]) for _ in range(r.randrange(120)))) for i in range(60)]
    rows = [tuple(x) for x in table(spark, sf_small, "documents").select("doc_id", "text").collect()] + made + EDGES
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted((tuple(x)[:7] for x in quality.quality(docs, labels).collect()), key=repr)
    assert got == sorted(((d, *brute_quality(t)) for d, t in rows), key=repr)
    assert ids(quality.quality(edges, labels.limit(0))) == EDGE_IDS
    assert quality.quality(edges.limit(0), labels).count() == 0


def test_quality_agrees_with_labels(spark, sf_oracle):
    both = quality.op10_quality(spark, sf_oracle).join(table(spark, sf_oracle, "labels"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in both) >= 0.97 * len(both) > 0


def _long(value, seed):
    return xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), seed=seed)


def _signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute_scores(rows, labels, spared, gram_counts=None):
    """score and kept of each (doc_id, text), n-grams counted one by one."""

    def grams(text):
        words = [_signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return [h % quality.BUCKETS for h in words] + [_long(b, _long(a, 42)) % quality.BUCKETS for a, b in zip(words, words[1:])]

    trusted = {d for d, q in labels if q == 1 and d is not None}
    fitted = {d for d in trusted if _signed(xxhash.xxh64_intdigest(b"half", seed=_long(d, 42))) % 2 == 0}
    raw, good = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for d, t in rows:
        for g in grams(t):
            raw[g] += 1
            good[g] += d in fitted
    log = lambda n: np.log(n + 0.5) - np.log(n.sum() + 0.5 * quality.BUCKETS)
    w = log(good) - log(raw) if good.sum() else 0 * raw
    score = [float(np.mean([w[g] for g in grams(t)])) if grams(t) else 0.0 for _, t in rows]
    apart = [s for s, (d, t) in zip(score, rows) if d in trusted - fitted and not brute_quality(t)[5]]
    least = np.percentile(apart, 100 * spared) if apart else -math.inf
    return [(s, s >= least - 1e-9 and not brute_quality(t)[5]) for s, (_, t) in zip(score, rows)]


@pytest.mark.parametrize("spared", [quality.SPARED, 0.2])
def test_quality_scores_brute(spark, sf_small, spared):
    rows = [tuple(x) for x in table(spark, sf_small, "documents").select("doc_id", "text").collect()] + EDGES
    labels = [(r.doc_id, r.quality) for r in table(spark, sf_small, "labels").collect()] + [(5, None), (None, 1), (6, 1), (6, 1)]
    docs, known = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = sorted(((r.doc_id, r.n_words, r.score, r.kept) for r in quality.quality(docs, known, spared).collect()), key=repr)
    want = sorted(((d, brute_quality(t)[0], s, k) for (d, t), (s, k) in zip(rows, brute_scores(rows, labels, spared))), key=repr)
    assert len({k for *_, k in want}) == 2
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-6 and g[3] == w[3]


def test_quality_fits_on_every_trusted_row(spark):
    r, n = random.Random(7), 24_000
    names = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(r.sample(names[: 1500 if i % 3 else 3000], 20))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = [(i, int(i % 12 != 0)) for i in range(n)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    assert quality.trusted(known).count() == 22_000
    got = sorted((x.doc_id, x.score, x.kept) for x in quality.quality(docs, known, 0.1).collect())
    want = brute_scores(rows, labels, 0.1)
    assert len(got) == n and len({k for _, k in want}) == 2
    for (_, score, kept), (s, k) in zip(got, want):
        assert abs(score - s) < 1e-6 and kept == k


def test_quality_without_broadcast(spark, sf_small):
    rows = [tuple(x) for x in table(spark, sf_small, "documents").select("doc_id", "text").collect()] + EDGES
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = [sorted(map(tuple, quality.quality(docs, table(spark, sf_small, "labels"), 0.2, most).collect()), key=repr) for most in (0, quality.BROADCAST_IDS)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got[0] == got[1] and len({x[-2] for x in got[0]}) == 2


def test_quality_scores_whole_words_and_their_order(spark):
    words = "understanding international communication requires considerable concentration always".split() * 5
    middle = [w[:3] + "qxzj" * ((len(w) - 6) // 4 + 1) + w[-3:] for w in words]
    shuffled = random.Random(1).sample(words, len(words))
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(6)] + [(10, " ".join(middle)), (11, " ".join(shuffled))], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(6)], "doc_id bigint, quality int")
    score = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    assert score[10] < score[11] - 0.1 and score[11] < score[0] - 0.05


# --- near-duplicates


def test_near_duplicates_edges(spark, edges):
    assert ids(minhash.near_duplicates(edges)) == EDGE_IDS
    kept = minhash.kept_documents(edges)
    assert kept.columns == edges.columns


def test_components_by_stars_and_in_one_task(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(200, i) for i in range(201, 230)]
    frame, work = spark.createDataFrame(edges, "u bigint, v bigint"), Workspace(spark, "test")
    got = [sorted(map(tuple, graph.components(frame, work, local).collect())) for local in (0, 20, 10**6)]
    least = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got[0] == got[1] == got[2] == sorted(least.items())
    assert graph.components(frame.limit(0), work).count() == 0


# --- names of other columns, and tables of odd rows

CLASHES = "spans hit_id hit_key gone_id gone_key p_id p_t span_id span_t n_tokens ids row node keys h n t w words text_key score lang_pred base added of".split()


@pytest.fixture(scope="module")
def clashing(spark):
    """The edge rows under extra columns that have the operators' own names."""
    rows = [(d, t, *range(len(CLASHES))) for d, t in EDGES]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} bigint" for c in CLASHES)).repartition(3)


def _operators(spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "null id"), (2, None)], "item_id bigint, text string")
    return {
        "op1": lambda d: token_counts.token_counts(d, tokenizer_path("byte_bpe_50k.json")),
        "op2": lambda d: decontaminate.decontaminated(d, items),
        "op3": lambda d: toxicity.toxicity(d, labels),
        "op4": lambda d: minhash.near_duplicates(d),
        "op5": lambda d: pii.personal_data(d),
        "op6": lambda d: langid.languages(d.withColumn("lang", F.lit("en"))),
        "op7": lambda d: bpe.encode_documents(d, tokenizer_path("word_bpe_49k.json")),
        "op8": lambda d: substring.repeated_spans(d),
        "op9": lambda d: warc.round_trip(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.lit("u").alias("url"), *CLASHES)).withColumnRenamed("page_id", "doc_id"),
        "op10": lambda d: quality.quality(d, labels),
        "redaction": lambda d: pii.without_personal_data(d),
        "redaction by join": lambda d: pii.without_personal_data(d, 0),
        "repeats": lambda d: substring.without_repeats(d),
        "spans": lambda d: decontaminate.without_spans(d, items),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "redaction", "redaction by join", "repeats", "spans"])
def test_odd_rows_and_clashing_columns(spark, clashing, name):
    run = _operators(spark)[name]
    got = run(clashing)
    assert ids(got) == EDGE_IDS
    if not name.startswith("op"):
        assert got.columns == clashing.columns
    assert run(clashing.limit(0)).count() == 0


def test_kept_and_clean_with_clashing_columns(spark, clashing):
    kept, items = minhash.kept_documents(clashing), spark.createDataFrame([(1, "null id")], "item_id bigint, text string")
    assert kept.columns == clashing.columns and ids(kept) == sorted((d for d in [None, 1, 2, 3, 4, 5, 6, 7, 8]), key=str)
    clean = decontaminate.clean_documents(clashing, items)
    assert clean.columns == clashing.columns and ids(clean) == sorted((d for d, _ in EDGES if d is not None), key=str)
