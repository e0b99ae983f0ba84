"""The registered queries: SQL where there is some, else that they cover their table."""

import pytest
from oracle import assert_equal

from lexiflow.llm import queries

SF = "/root/testdata/sf0.001"
BOUND, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_equal(spark, BOUND[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(BOUND) - set(SQL)))
def test_query_covers_its_table(spark, name):
    table = "pages" if name.startswith("op4") else "documents"
    assert BOUND[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_secret_scan_query_against_brute_force(spark):
    """Counts and digest of the base spans over the whole table; the added ones by the query's own model."""
    from test_secrets import slow

    rows = queries.op1_secret_scan(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = slow(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*want[:3], want[4])


def test_simhash_query_against_brute_force(spark):
    from test_simhash import slow_components, slow_fingerprint

    rows = sorted(queries.op2_simhash(spark, SF).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = [slow_fingerprint(texts[r.doc_id]) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in rows] == [rows[k].doc_id for k in slow_components(fps)]


def test_tokenizer_query_against_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op8_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts) and all(r.ids == library.encode(texts[r.doc_id]) and r.lossless for r in rows)
