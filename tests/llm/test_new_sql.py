"""The SQL of the queries that have it, on the smallest tables."""

import os

import duckdb
import pytest

from loregrid.llm import queries


@pytest.mark.parametrize("name", ["op11_collocations", "op12_source_audit"])
def test_query_matches_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    said = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in said.description)
    want = sorted(map(tuple, said.df()[columns].values.tolist()))
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == columns and sorted(tuple(r) for r in got.select(columns).collect()) == want
