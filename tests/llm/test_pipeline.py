"""The corpus pipeline against its stages' own operators."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from moraine.llm import decontaminate, toxicity  # noqa: E402
from moraine.llm.common import table, tokenizer_path  # noqa: E402


def test_stages(spark, sf_oracle):
    docs = table(spark, sf_oracle, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf_oracle, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_oracle).collect(), docs.schema)
        after = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and after <= before, name
        if name == "toxicity":
            assert all(labels.get(d) != 0 for d in before - after)
        if name == "personal_data":
            assert after == before
        before = after
    assert not any(r.contaminated for r in decontaminate.decontaminated(docs, table(spark, sf_oracle, "benchmark")).collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_oracle).collect()
    from tokenizers import Tokenizer

    word = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in last} == before
    assert all(r.n_tokens == len(word.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) for r in last)
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_oracle).collect()))
    assert got == sorted(map(tuple, last))


CLASHES = "spans hit_id hit_key gone_id gone_key p_id p_t span_id span_t n_tokens row node keys h t words text_key score".split()
ROWS = [(1, None), (2, ""), (3, " \n "), (4, "one two three four five six"), (4, "one two three four five six"), (5, "One two three four FIVE six"), (None, "a null id"), (None, "a null id"), (6, "word " * 40_000), (7, "mail a@b.org now")]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows_and_clashing_columns(spark, sf_small, name, stage):
    docs = spark.createDataFrame([(d, t, *range(len(CLASHES))) for d, t in ROWS], "doc_id bigint, text string, " + ", ".join(f"{c} int" for c in CLASHES)).repartition(3)
    got = stage(spark, docs, sf_small)
    left = sorted((r.doc_id for r in got.collect()), key=str)
    once = name == "near_duplicates"  # one row of each group stays
    assert left == sorted([1, 2, 3, 4, 6, 7, None] if once else [d for d, _ in ROWS], key=str)
    if name != "encoding":
        assert got.columns == docs.columns
    if name == "personal_data":
        assert {r.text for r in got.collect() if r.doc_id == 7} == {"mail [EMAIL] now"}
    assert stage(spark, docs.limit(0), sf_small).count() == 0
