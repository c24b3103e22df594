import math

import pytest
from pyspark.sql import functions as F

from tiltml.functions.hashing import hash_u
from tiltml.operators import aggregates as A


def _pred(spark, cells):
    rows = []
    for (lab, pred), n in cells.items():
        rows += [(float(lab), float(pred))] * n
    return spark.createDataFrame(rows, "label double, prediction double")


def test_evaluate_column_major_cells(spark):
    # actual0/pred0=5, actual1/pred0=3, actual0/pred1=2, actual1/pred1=7 -> [5,3,2,7]
    df = _pred(spark, {(0, 0): 5, (1, 0): 3, (0, 1): 2, (1, 1): 7})
    r = A.evaluate_scores(df, positive=0.0).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (5, 3, 2, 7)
    assert r.tpr == 5 / 7 and r.tnr == 7 / 10 and r.score == (5 / 7) * (7 / 10)


def test_positive_convention_swaps_rates_keeps_product(spark):
    df = _pred(spark, {(0, 0): 5, (1, 0): 3, (0, 1): 2, (1, 1): 7})
    a = A.evaluate(df, positive=0.0)
    b = A.evaluate(df, positive=1.0)
    assert a[0] == b[1] and a[1] == b[0] and math.isclose(a[2], b[2])


def test_single_class_gives_nan_not_error(spark):
    df = _pred(spark, {(1, 1): 4})
    tpr, tnr, score = A.evaluate(df, positive=0.0)
    assert math.isnan(tpr) and tnr == 1.0 and math.isnan(score)


def test_third_label_is_ignored(spark):
    df = _pred(spark, {(0, 0): 2, (1, 1): 2, (2, 1): 5, (1, 2): 5})
    r = A.evaluate_scores(df, positive=1.0).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 0, 0, 2)


def test_accuracy_and_ratio(spark):
    df = _pred(spark, {(0, 0): 3, (1, 0): 1})
    assert A.accuracy(df).first().accuracy == 0.75
    r = A.class_ratio(df, "label", 1.0, 0.0).first()
    assert (r.n_num, r.n_den, r.ratio) == (1, 3, 1 / 3)
    z = A.class_ratio(df.filter("label = 1"), "label", 1.0, 0.0).first()
    assert math.isnan(z.ratio)


def test_predictions_must_be_double_typed(spark):
    df = spark.createDataFrame([(0, 0), (1, 1)], "label int, prediction int")
    assert A.evaluate(df, positive=1.0) == (1.0, 1.0, 1.0)


def test_covariance_modes_agree(spark):
    df = spark.createDataFrame([(1.25, 2.5), (3.75, 1.0), (2.0, 0.5)], "a double, b double")
    exact = {(r.col_a, r.col_b): r.covariance for r in A.feature_covariance(df, ["a", "b"], 2).collect()}
    builtin = {(r.col_a, r.col_b): r.covariance for r in A.feature_covariance(df, ["a", "b"]).collect()}
    for k in exact:
        assert math.isclose(exact[k], builtin[k], rel_tol=1e-12)


def test_class_max_values_bounded(spark):
    df = spark.createDataFrame([(1.0, 0.0), (5.0, 0.0), (2.0, 1.0)], "v double, class double")
    assert A.class_max_values(df, "v", "class") == {0.0: 5.0, 1.0: 2.0}


@pytest.mark.parametrize("n", [2, 31, 32, 33])
def test_covariance_is_pairwise_at_every_width(spark, n):
    cols = [f"c.{i}" for i in range(n)]
    df = spark.range(300).select(*[F.when(F.col("id") % (i + 3) != 0, hash_u(["id"], i) * (i + 1) + F.col("id") * 0.01 * i + 1e6).alias(c)
                                   for i, c in enumerate(cols)]).cache()
    got = {(r.col_a, r.col_b): r.covariance for r in A.feature_covariance(df, cols).collect()}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    want = df.agg(*[F.covar_samp(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    assert len(got) == len(pairs)
    for i, pair in enumerate(pairs):
        assert math.isclose(got[pair], want[f"p{i}"], rel_tol=1e-7, abs_tol=1e-9)


def test_covariance_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0), (float("nan"), 5.0)], "a double, b double")
    got = {(r.col_a, r.col_b): r.covariance for r in A.feature_covariance(df, ["a", "b"]).collect()}
    assert got[("a", "a")] == 0.5 and got[("a", "b")] is None and got[("b", "b")] == 2.0
    assert all(r.covariance is None for r in A.feature_covariance(df.limit(0), ["a", "b"]).collect())
