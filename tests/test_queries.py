"""Every query of the curation operators against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from sievework.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    return f"{value:.5f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, oracle, name):
    frame = queries.queries()[name](spark, sf)
    relation = oracle.sql(queries.oracle_sql()[name])
    order = sorted(frame.columns)
    assert order == sorted(relation.columns)
    at = [relation.columns.index(c) for c in order]
    got = sorted([plain(r[c]) for c in order] for r in frame.collect())
    want = sorted([plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at] for r in relation.fetchall())
    assert got == want


def test_registry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True)
    assert int(out.stdout.split()[0]) > 40
