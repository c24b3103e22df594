import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tiltml.functions import columns as C
from tiltml.functions.hashing import hash_u, sql_hash_u


def test_hash_u_matches_duckdb(spark, duck_small):
    df = spark.createDataFrame([(7,), (123456789,)], "k long")
    got = sorted(r.u for r in df.select(hash_u(["k"], 42).alias("u")).collect())
    exp = sorted(r[0] for r in duck_small.execute(
        f"SELECT {sql_hash_u(['k'], 42)} FROM (VALUES (7), (123456789)) t(k)").fetchall())
    assert got == exp
    assert got[0] == pytest.approx(0.46435326454229653) or got[1] == pytest.approx(0.46435326454229653)


def test_hash_u_in_unit_interval_and_salted(spark):
    df = spark.range(2000).select(hash_u(["id"], 1).alias("a"), hash_u(["id"], 1, "x").alias("b"))
    r = df.agg(F.min("a"), F.max("a"), F.avg("a"), F.count_if(F.col("a") == F.col("b"))).first()
    assert 0.0 <= r[0] and r[1] < 1.0 and abs(r[2] - 0.5) < 0.05 and r[3] == 0


def test_feature_columns_excludes_class_and_label(spark):
    # a raw table that already has `label` must not feed it back as a feature
    df = spark.createDataFrame([(1.0, 2.0, 1.0, 0.0)], "a double, b double, label double, class double")
    assert C.feature_columns(df) == ["a", "b"]


def test_cast_all_double_bad_text_is_null(spark):
    df = spark.createDataFrame([("1.5", "x", 3)], "a string, b string, c int")
    r = C.cast_all_double(df).first()
    assert r.a == 1.5 and r.b is None and r.c == 3.0


def test_row_sum_null_propagates(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double")
    vals = [r.s for r in df.select(C.row_sum(["a", "b"]).alias("s")).collect()]
    assert vals == [None, 3.0]


def test_class_lookup_int_long_double_keys_and_miss(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "class int")
    vals = [r.v for r in df.select(C.class_lookup(F.col("class"), {0: 10.0, 1: 20.0}).alias("v")).collect()]
    assert vals == [10.0, 20.0, None]


def test_vector_to_columns_short_vector_gives_null(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]), 1.0), (Vectors.sparse(3, [2], [5.0]), 0.0)],
                               ["features", "label"])
    rows = C.vector_to_columns(df, "features", 4, "label").orderBy("label").collect()
    assert [rows[0][f"label{i}"] for i in range(4)] == [0.0, 0.0, 5.0, None]
    assert [rows[1][f"label{i}"] for i in range(4)] == [1.0, 2.0, None, None]


def test_array_element_out_of_range_is_null(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "a array<double>")
    r = df.select(C.array_element("a", 1).alias("x"), C.array_element("a", 3).alias("y")).first()
    assert r.x == 1.0 and r.y is None


def test_select_except_and_drop_missing(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, class int")
    assert C.select_except(df, "class").columns == ["a", "b"]
    assert C.drop_columns(df, "zzz", "b").columns == ["a", "class"]


def test_pack_and_unpack_cells(spark):
    df = spark.createDataFrame([(2.0, 3.0, 1.0)], "a double, b_sum double, class double")
    packed = C.pack_cells(df, ["a", "b_sum"], F.lit(0.5))
    r = packed.first()
    assert r.a.res == 1.0 and r.b_sum.value == 3.0
    # a name containing `_sum` survives the round trip
    assert C.unpack_values(packed, ["a", "b_sum"]).columns == ["a", "b_sum", "class"]


def test_sig_round(spark):
    from tiltml.plans.catalog import sig_round
    df = spark.createDataFrame([(123456.789012345,), (-1.70894456574e-06,), (0.0,), (float("nan"),)], "x double")
    vals = [r.y for r in df.select(sig_round(F.col("x"), 6).alias("y")).collect()]
    assert vals[0] == 123457.0 and vals[1] == -1.70894e-06 and vals[2] == 0.0 and math.isnan(vals[3])


def test_xxhash64_draws_partition_independent(spark):
    from tiltml.functions.hashing import DRAW_HASH_CONF
    spark.conf.set(DRAW_HASH_CONF, "xxhash64")
    try:
        df = spark.range(5000).withColumn("k2", F.col("id") % 7)
        a = df.select("id", hash_u(["id", "k2"], 3).alias("u"))
        b = df.repartition(11).select("id", hash_u(["id", "k2"], 3).alias("u"))
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        r = a.agg(F.min("u"), F.max("u"), F.avg("u")).first()
        assert 0.0 <= r[0] and r[1] < 1.0 and abs(r[2] - 0.5) < 0.03
    finally:
        spark.conf.unset(DRAW_HASH_CONF)


def test_wide_row_sum_keeps_left_fold_and_nulls(spark):
    import random
    random.seed(1)
    n = 150
    vals = [[random.uniform(-1e6, 1e6) for _ in range(n)] for _ in range(20)]
    vals[3][77] = None
    df = spark.createDataFrame(vals, ", ".join(f"c{i} double" for i in range(n)))
    got = [r.s for r in df.select(C.row_sum([f"c{i}" for i in range(n)]).alias("s")).collect()]
    for row, g in zip(vals, got):
        if None in row:
            assert g is None
        else:
            acc = row[0]
            for v in row[1:]:
                acc = acc + v
            assert g == acc


@pytest.mark.parametrize("n", [1, 63, 64, 65, 66])
def test_row_sum_keeps_the_type_at_every_width(spark, n):
    big = 9007199254740993
    df = spark.range(2).select(*[F.lit(big if i == 0 else 0).cast("long").alias(f"c.{i}") for i in range(n)])
    out = df.select(C.row_sum(df.columns).alias("s"))
    assert out.dtypes == [("s", "bigint")] and out.first().s == big
    ints = spark.range(3).select(*[F.when(F.col("id") != 1, F.lit(2)).alias(f"c{i}") for i in range(n)])
    out = ints.select(C.row_sum(ints.columns).alias("s"))
    assert out.dtypes == [("s", "int")] and [r.s for r in out.collect()] == [2 * n, None, 2 * n]
