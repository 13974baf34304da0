import os

import duckdb
import pytest

import __spark_entry__ as entry
from twinsift.plans import queries as core

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_a_distinct_name_and_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.queries()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", ["p4_found", "p4_summary", "scan_exclusion_filter", "exact_hash_groups", "near_pairs_phash", "group_savings", "duplicate_totals", "group_report", "video_similarity_strict", "whash_haar_bits"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    df = core.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    want = sorted(map(repr, con.execute(f"select {', '.join(columns)} from ({core.oracle_sql()[name]})").fetchall()))
    assert got == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
