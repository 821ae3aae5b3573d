"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
CHECKED = (
    "label_normalize clean_text fix_encoding text_features clean_dedup clean_stats parse_lines stratified_split_70_15_15 "
    "head_tail_split profile_summary length_histogram length_boxplot top_bigrams top_english_stop top_ngram_table lexicon_score lexicon_score_learned "
    "class_report tfidf_weights logits_to_probs encode_fixed_length best_step decode_codes lexicon_paths labeled_files "
    "delimited_files split_files corpus_files stopword_files run_files table_files report_files"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


def test_registry_is_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    # Their scores are a solver's; logreg_optimality, svm_optimality and model_grid_cells hold them to SQL instead.
    own = {q for q in queries if not (q == "pipeline" or q.startswith("op"))}
    assert own - set(oracles) == {"logreg_predict", "svm_predict", "model_grid"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), names)
