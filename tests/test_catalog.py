"""Each registered query against its oracle, columns, types of values and rows."""

import pytest
from pyspark.sql import functions as F

from moraine.plans import catalog
from moraine.sources import frames
from tests.oracle import compare, connect

ROWS_ONLY = {"hll_native", "cms_native"}


@pytest.fixture(scope="module")
def con(sf_oracle):
    return connect(sf_oracle)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_oracle(spark, con, sf_oracle, name):
    compare(catalog.queries()[name](spark, sf_oracle), con, catalog.oracle_sql()[name])


def test_native_sketches_are_near_the_truth(spark, sf_oracle):
    r = catalog.queries()["hll_native"](spark, sf_oracle).first()
    assert abs(r.estimate - r.exact) < 0.1 * r.exact and abs(r.approx - r.exact) < 0.15 * r.exact
    assert catalog.queries()["cms_native"](spark, sf_oracle).first().bytes > 0


def test_checksums(spark, sf_oracle):
    import zlib

    kinds = {r.event_id: r.event_type for r in spark.read.parquet(f"{sf_oracle}/events.parquet").collect()}
    for r in catalog.queries()["entry_crc"](spark, sf_oracle).collect():
        assert r.crc == zlib.crc32(kinds[r.seq].encode()) ^ 0xFFFFFFFF


def test_replay_of_a_long_log(spark, sf_small, tmp_path):
    """Sequence numbers beyond 20 bits, as a log of over a million mutations has."""
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    events.withColumn("event_id", F.col("event_id") * 50_021).write.parquet(f"{tmp_path}/events.parquet")
    log = connect(sf_small)
    log.execute(f"create or replace view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    compare(catalog.queries()["kv_wal_replay"](spark, str(tmp_path)), log, catalog.oracle_sql()["kv_wal_replay"])


def test_a_seq_too_large_for_its_bits_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 5, 1 << 20, "k", "v", False)], "shard string, segment bigint, ts bigint, seq bigint, key string, value string, is_tombstone boolean")
    with pytest.raises(Exception, match="doesn't fit 20 bits"):
        frames.write_segments(rows, f"file://{tmp_path}/wal", 1_000, 20).collect()


def test_token_counts_of_repeated_ids(spark, tmp_path):
    """Texts of one id, and of no id, count together; odd spaces, letters and marks are as in SQL."""
    odd = "Größe ÉCOLE don't\x1cstop ١٢ the　The\x85x​y -- 漢字 é \U0001d400 \U0001f600"
    texts = [(1, "a b b c"), (1, "B b d the"), (2, odd), (3, None), (4, ""), (None, "x y"), (None, "y"), (5, " ".join(f"w{i % 30000}" for i in range(60_000))), (6, "this is"), (7, odd.upper())]
    spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    compare(catalog.queries()["simhash_tokens"](spark, str(tmp_path)), con, catalog.oracle_sql()["simhash_tokens"])


def test_token_counts_of_single_ids_are_not_shuffled(spark, sf_small):
    df = catalog.queries()["simhash_tokens"](spark, sf_small)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
