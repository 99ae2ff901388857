"""Every query with SQL gives the SQL's rows on the smallest tables, and some."""

import os

import duckdb
import pytest

from clearprose import gate_queries, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUICK = ["q_sentence_length_by_lang", "q_sentences", "q_lint_full", "q_semicolon", "q_classify_paths", "q_apply_edit", "q_reply_gate", "q_dictionary", "q_report_lines", "q_blocks", "q_edit_lint", "q_calls_of_a_batch", "q_spliced_results", "q_snapshots", "q_reply_gate_stream"]
QUERIES, ORACLE_SQL = queries.QUERIES | gate_queries.QUERIES, queries.ORACLE_SQL | gate_queries.ORACLE_SQL


def canonical(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(str, r)) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    base = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations"):
        base.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = base.execute(ORACLE_SQL[name]).fetchdf()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and canonical(got) == canonical(want)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
