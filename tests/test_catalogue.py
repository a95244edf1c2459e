"""Catalogue queries against their SQL twins on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from tallyforge.plans import elections, evaluation, feeds, ingest, problems, surveys

DATA = "/root/testdata/sf0.001"
# the simulation's summaries share its plan; one of them stands for all here
SLOW = {"win_probs", "seat_hist", "medoid_draw", "government_scenarios", "gallagher_index"}
QUERIES = problems.QUERIES | surveys.CATALOGUE.queries | elections.CATALOGUE.queries | evaluation.CATALOGUE.queries | feeds.CATALOGUE.queries | ingest.CATALOGUE.queries
SQL = problems.ORACLE | surveys.CATALOGUE.oracle | elections.CATALOGUE.oracle | evaluation.CATALOGUE.oracle | feeds.CATALOGUE.oracle | ingest.CATALOGUE.oracle


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_tuple") or isinstance(v, float):
        return round(float(v), 6) + 0.0
    return float(v) if isinstance(v, int) and abs(v) < 2**53 else str(v)


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(DATA + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    found = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    result = tables.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert found == Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
