"""The registered corpus queries: equal to their SQL where there is one, and shaped as their contracts say."""

from pathlib import Path

import duckdb
import pytest

from tamiz.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
COLUMNS = {
    "op1_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op8_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op11_cross_tokenizer": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op12_lexical_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op13_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_of_the_contracts(spark, name):
    types = dict(QUERIES[name](spark, FOLDER).dtypes)
    assert {c.split()[0]: types.get(c.split()[0]) for c in COLUMNS[name].split(", ")} == dict(c.split() for c in COLUMNS[name].split(", "))


@pytest.mark.parametrize("name", list(ORACLE))
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, FOLDER).select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
