"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry


def test_names_and_twins_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p1_found", "p2_found", "p3_found", "p5_found", "p6_found"} <= set(queries)
    assert all(isinstance(s, str) and s.strip() for s in sql.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_flagship_gives_seats(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"boundary_year", "party", "seats"} == set(rows[0].asDict())
