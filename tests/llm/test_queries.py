"""Queries with SQL against DuckDB, and the registration of all."""

import pytest

import __spark_entry__ as E
from oracle_compare import duck, rows_of
from tiltml.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF)
    cursor = duck(SF).execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of([r.asDict() for r in got.collect()], sorted(columns), False) == rows_of(want, sorted(columns), False)


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in E.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in E.queries()
