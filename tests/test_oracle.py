"""Every query with a SQL twin matches DuckDB on sf0.001 (row count, columns, values)."""

import pytest

import __spark_entry__ as E
from oracle_compare import rows_of
from tiltml.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
ORACLE = E.oracle_sql()


# Full cascades of 285 boosting rounds: tools/oracle_compare.py runs them; tests/test_cleaning.py has short ones.
SLOW = {"confidence_cascade", "job_cascade"}


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if n in QUERIES and n not in SLOW))
def test_query_matches_oracle(spark, duck_small, name):
    sdf = E.queries()[name](spark, SF)
    srecs = [r.asDict() for r in sdf.collect()]
    res = duck_small.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drecs = [dict(zip(dcols, r)) for r in res.fetchall()]
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srecs) == len(drecs)
    cols = sorted(dcols)
    assert rows_of(srecs, cols, False) == rows_of(drecs, cols, False)


def test_every_query_has_oracle_or_is_a_model_fit():
    no_sql = set(QUERIES) - set(ORACLE)
    assert no_sql <= {"pca_project"}
