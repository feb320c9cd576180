"""The registry, with or without the optional subpackage."""

import os

import pytest

import __spark_entry__ as registry

TABLES = "/root/testdata/sf0.001"


def test_names_and_sql_belong_together():
    found, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 70 and "quad_accuracy_by_category" in sql
    assert all(callable(q) for q in found.values()) and all(s.strip() for s in sql.values())


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the shared tables are not here")
def test_entry_and_a_query_against_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = registry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() >= {"category", "I_Acc", "Acc"}
    con = duckdb.connect()
    for name in ("orders", "events"):
        con.sql(f"create view {name} as select * from '{TABLES}/{name}.parquet'")
    for name in ("quad_accuracy_by_category", "uniform_samples", "basin_peaks", "mcq_scores_by_duration"):
        df = registry.queries()[name](spark, TABLES)
        rel = con.sql(registry.oracle_sql()[name])
        columns = sorted(df.columns)
        assert columns == sorted(rel.columns)
        got = sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect())))
        want = sorted(map(str, (tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall())))
        assert got == want
