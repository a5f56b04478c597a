"""Every registered SQL agrees with its query on the smallest tables; the whole of them runs in the driver's check."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["source_acts", "search_synonyms", "source_written", "diff_moved_to", "diff_lists", "obligations_quotes", "quotes_exact", "tree_subtree_text", "diff_nodes", "diff_rollup", "rules_state", "version_lookup", "eval_cells", "text_dates", "diff_words", "eval_projection", "obligations_ranked", "obligations_timeline", "obligations_open_questions", "text_citations", "text_hashes", "text_tokens", "audit_readings", "audit_dates", "provisions_found", "records_rechecked", "eval_scores", "eval_strata", "eval_rescored", "obligations_timed", "obligations_rejects", "tree_siblings", "search_ranked", "source_rejects", "quotes_verified"]


def rows(columns, values):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SOME)
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
