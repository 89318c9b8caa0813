import re

import pyarrow as pa
from pyspark.sql import functions as F

from moraine.llm import minhash
from moraine.llm.common import ARROW_BYTES, map_texts


def brute(rows, k, percent):
    """component_id by (doc_id, text), all pairs compared."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        j = min(k, len(w))
        sets.append({tuple(w[i : i + j]) for i in range(len(w) - j + 1)} if w else set())
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                at[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(root(i), []).append(doc_id)
    return [(d, len(sets[i]), min(x for x in least[root(i)])) for i, (d, _) in enumerate(rows)]


def got(spark, rows, k, percent):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, k, percent).collect())


def test_edges(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (2, base), (9, base.upper()), (1, None), (3, ""), (4, "  \n "), (7, "one two"), (8, "One  two"), (6, "one"), (6, "one")]
    assert got(spark, rows, 3, 85) == sorted(brute(rows, 3, 85))


def test_empty_table(spark):
    assert got(spark, [], 3, 85) == []


def test_chain_and_clashing_columns(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[6 * i : 6 * i + 200])) for i in range(30)]
    assert got(spark, rows, 3, 85) == sorted(brute(rows, 3, 85))
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id bigint, text string, node int, keys string, h int")
    assert {r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()} == {71}


def test_against_brute_force(spark, sf_small, sf_oracle):
    """Equal components are a recall of 1 over the links between them."""
    for folder, k, percent in ((sf_small, 3, 85), (sf_small, 5, 80), (sf_oracle, 3, 85), (sf_oracle, 5, 80)):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        assert got(spark, rows, k, percent) == sorted(brute(rows, k, percent))


def test_a_bucket_of_many_groups(spark):
    """Texts that share a long passage meet in buckets without being linked; a few of them are."""
    shared = " ".join(f"s{i}" for i in range(70))
    rows = [(i, shared + " " + " ".join(f"x{i // 2 if i % 5 == 0 else i}y{j}" for j in range(20)) + f" z{i}") for i in range(300)]
    assert got(spark, rows, 3, 85) == sorted(brute(rows, 3, 85))


def test_sketch_is_full_and_concentrated():
    a, b = minhash.shingles([b"w%d" % i for i in range(900)], 1), minhash.shingles([b"w%d" % i for i in range(100, 1000)], 1)
    assert abs((minhash.sketch(a) == minhash.sketch(b)).mean() - 0.8) < 0.15
    assert (minhash.sketch(a[:1]) > 0).all()


def test_one_row_of_each_group_stays(spark):
    text, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, text), (1, text), (1, text.upper()), (2, text), (None, other), (None, other), (None, "alone among the null ids"), (3, None), (3, None), (4, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = [tuple(r) for r in minhash.kept_documents(docs).collect()]
    assert sorted((d for d, _ in kept), key=str) == [1, 3, 3, 4, 4, None, None]
    assert sum((t or "").lower() == text for _, t in kept) == 1 and sum(t == other for _, t in kept) == 1


def test_representatives_stand_in_short_lists(spark, monkeypatch):
    """However large a bucket is, a round takes a few representatives; the groups are those of all pairs."""
    monkeypatch.setattr(minhash, "REPRESENTATIVES", 4)
    monkeypatch.setattr(minhash, "MOST", 8)
    lists, write = [], minhash.Workspace.write

    def written(self, df, name, rows=None):
        out = write(self, df, name, rows)
        if name == "representatives":
            lists.append(max((len(r.reps) for r in out.select("reps").collect()), default=0))
        return out

    monkeypatch.setattr(minhash.Workspace, "write", written)
    shared = " ".join(f"s{i}" for i in range(70))
    rows = [(i, shared + " " + " ".join(f"x{i // 2 if i % 5 == 0 else i}y{j}" for j in range(20)) + f" z{i}") for i in range(60)]
    assert got(spark, rows, 3, 85) == sorted(brute(rows, 3, 85))
    assert len(lists) > 2 and 4 < max(lists) <= 8


def test_batches_of_long_texts_are_small(spark):
    """Rows and bytes bound what goes to a Python worker at once."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    docs = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = [r.bytes for r in map_texts(docs, run, "bytes bigint").collect()]
    assert sum(sizes) >= 64 << 20 and max(sizes) < ARROW_BYTES + (3 << 20)
