"""Hash-mode operators give the same rows at any shuffle width and after a repartition."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["undersample", "oversample", "balance", "random_split", "kfold_assign",
         "evolved_feature_selection", "synthetic_bernoulli", "union_many"]


def _rows(df):
    return sorted(map(lambda r: tuple(r.asDict()[c] for c in sorted(df.columns)), df.collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_at_other_shuffle_width(spark, name):
    q = E.queries()[name]
    base = _rows(q(spark, SF))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert _rows(q(spark, SF)) == base
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        assert _rows(q(spark, SF)) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
