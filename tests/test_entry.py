"""The registered queries against their SQL in DuckDB on the smallest driver tables, where these are there."""

import os
import subprocess
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
NAMES = [
    "flagship_recall", "a3_exclusion_summary", "w2_split_global", "w15_page", "v6_ranking_report", "v9_lineup_overlap", "e4_normalize_payloads", "t2_running_popularity", "m8_quantize_vectors",
    "j5_seed_exclusion", "m6_first_histogram", "s10_changed_parts", "c8_search_index", "t2_corrected_popularity", "a14_latency_percentiles", "s5_bucketed_split",
]


def test_every_query_is_registered_once_and_sql_belongs_to_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) <= set(entry.oracle_sql())


def test_queries_are_registered_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert e.queries().keys() >= e.oracle_sql().keys()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    text = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    want = sorted(tuple(map(text, r)) for r in con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_tfidf_with_the_large_vocabulary(spark):
    import __spark_entry__ as entry

    test_query_equals_its_sql(spark, "m3_tfidf_weights_50k")
    assert entry.queries()["m3_tfidf_weights_50k"](spark, DATA).select("term").distinct().count() > 300


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_tfidf_weighs_all_terms_of_all_documents(spark):
    import __spark_entry__ as entry

    test_query_equals_its_sql(spark, "m3_tfidf_weights")
    cells = "SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower('lang_' || lang || ' ' || coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')) AS term"
    wanted = duckdb.connect().sql(f"SELECT count(*) FROM ({cells} FROM '{DATA}/documents.parquet')").fetchall()[0][0]
    assert entry.queries()["m3_tfidf_weights"](spark, DATA).count() == wanted
