"""Registered queries: importable without the optional part, and some of them against DuckDB."""

import os
import subprocess
import sys

import duckdb
import pytest

from graphloom import graph_queries

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["flagship_revenue_by_nation", "extend_multi_rel", "correlated_subquery", "weighted_shortest", "create_set_delete", "merge_counts"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = graph_queries.QUERIES[name](spark, SF).toPandas(), con.sql(graph_queries.ORACLES[name]).df()
    flat = lambda df: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and flat(got) == flat(want)


def test_imports_without_the_optional_part(tmp_path):
    code = "import sys; sys.modules['graphloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'flagship_revenue_by_nation' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
