import math
import time

import pytest
from pyspark.sql import functions as F

from tiltml.operators.quantiles import exact_median, exact_quantile


@pytest.mark.parametrize("col", ["l_extendedprice", "l_quantity", "l_discount", "l_orderkey"])
@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.73, 1.0])
def test_matches_spark_percentile(spark, col, q):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    exp = li.select(F.percentile(col, q)).first()[0]
    assert exact_quantile(li, col, q, buckets=8, max_collect=20) == exp


def test_hot_value_and_nulls(spark):
    # a third of the rows share one value; NULLs are ignored
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7.0))
                                  .when(F.col("id") % 3 == 1, F.col("id").cast("double"))
                                  .otherwise(F.lit(None).cast("double")).alias("v"))
    exp = df.select(F.percentile("v", 0.5)).first()[0]
    assert exact_median(df, "v", buckets=4, max_collect=10) == exp
    assert exact_median(df.filter("v is null"), "v") is None


INF = float("inf")


@pytest.mark.parametrize("name,values", [
    ("two values", [0.0] * 1000 + [1.0] * 1000), ("two far clusters", [1e-300 * i for i in range(500)] + [1e300 + i * 1e290 for i in range(500)]),
    ("four rows", [1.0, 2.0, 3.0, 4.0]), ("even count", [float(i) for i in range(1000)]), ("one value", [5.0] * 77),
    ("infinities", [-INF] * 3 + [1.0, 2.0, 3.0] + [INF] * 4), ("only infinities", [-INF, INF]), ("huge range", [-1.7e308, 1.7e308, 0.0, 1.0]),
    ("neighbours", [1.0, math.nextafter(1.0, 2.0)] * 50)])
@pytest.mark.parametrize("max_collect", [0, 1, 100_000])
def test_always_ends(spark, name, values, max_collect):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    began = time.time()
    got = exact_median(df, "v", max_collect=max_collect)
    want = df.select(F.percentile("v", 0.5)).first()[0]
    assert got == want or math.isnan(want) and math.isnan(got), name
    assert time.time() - began < 60


def test_two_values_beyond_the_default(spark):
    df = spark.range(300_000).select((F.col("id") % 2).cast("double").alias("v"))
    began = time.time()
    assert exact_median(df, "v") == 0.5
    assert time.time() - began < 60
