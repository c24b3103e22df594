"""A model that has learnt nothing, an empty cascade or a filter that does nothing turns its query red."""

import pytest
from pyspark.sql import functions as F

from tiltml.operators import aggregates as A
from tiltml.operators import certificates as CT
from tiltml.operators import cleaning as X
from tiltml.operators import models as MD
from tiltml.plans import catalog as Q
from tiltml.plans import jobs as J

SF = "/root/testdata/sf0.001"


def constant(estimator, train, test):
    return test.withColumn("prediction", F.lit(0.0))


@pytest.mark.parametrize("name", ["gbt_classify", "rf_classify", "weighted_gbt_classify", "job_gbt_score", "job_rf_score", "job_csv_mlp", "job_pca_weighted_gbt_score"])
def test_a_constant_prediction_is_red(spark, monkeypatch, name):
    monkeypatch.setattr(MD, "fit_predict", constant)
    monkeypatch.setattr(J.MD, "fit_predict", constant)
    assert not any(r.passed for r in Q.QUERIES[name](spark, SF).collect())


@pytest.mark.parametrize("name", ["mlp_classify", "job_mlp_score"])
def test_an_untrained_perceptron_is_red(spark, monkeypatch, name):
    monkeypatch.setitem(Q.MLP_PARAMS, "iter", 1)
    assert not any(r.passed for r in Q.QUERIES[name](spark, SF).collect())


@pytest.mark.parametrize("name", ["fm_classify", "job_fm_score"])
def test_an_untrained_machine_is_red(spark, monkeypatch, name):
    monkeypatch.setitem(Q.FM_PARAMS, "maxiter", 1)
    assert not any(r.passed for r in Q.QUERIES[name](spark, SF).collect())


def test_a_filter_that_keeps_all_is_red(spark, monkeypatch):
    monkeypatch.setattr(X, "noise_filter", lambda df, **_: df)
    assert not any(r.share for r in Q.QUERIES["noise_filter"](spark, SF).collect())


@pytest.mark.parametrize("empty", [True, False])
def test_an_empty_or_untouched_cascade_is_red(spark, monkeypatch, empty):
    def fake(df, keep=(), **_):
        labels = [f"label{i}" for i in range(X.CASCADE_ROUNDS)]
        out = df.select(*keep, "label", *[F.lit(0.0).alias(c) for c in labels], F.array(*[F.lit(0.0) for _ in labels]).alias("features"))
        return out.limit(0) if empty else out
    monkeypatch.setattr(X, "confidence_cascade", fake)
    rows = Q.QUERIES["confidence_cascade"](spark, SF).collect()
    assert not any(r.share for r in rows) if empty else not all(r.ok for r in rows)


def test_grown_twins_see_another_model(spark, duck_small, monkeypatch):
    from oracle_compare import rows_of

    from tiltml.plans.oracle import ORACLE
    monkeypatch.setattr(Q, "GROWN_FOREST", Q.GROWN_FOREST | {"maxDepth": 1})
    for name in ("forest_grown", "noise_filter_grown", "job_rf_grown"):
        got = Q.QUERIES[name](spark, SF)
        res = duck_small.execute(ORACLE[name])
        cols = sorted(d[0] for d in res.description)
        want = [dict(zip([d[0] for d in res.description], r, strict=True)) for r in res.fetchall()]
        assert rows_of([r.asDict() for r in got.collect()], cols, False) != rows_of(want, cols, False)


def test_certificates_are_those_of_numpy(spark):
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    train, test = MD.scaled_split(*Q._ml_split(spark, SF))
    x = np.array([r.x for r in train.select(vector_to_array("features").alias("x"), "label").collect()])
    y = np.array([r.label for r in train.select("features", "label").collect()])
    fm = MD.fit(MD.fm_classifier({"maxiter": 3, "stepSize": 0.1, "seed": 1, "factorSize": 3}), train)
    w, v = fm.linear.toArray(), fm.factors.toArray()
    m = fm.intercept + x @ w + 0.5 * ((x @ v) ** 2 - (x**2) @ (v**2)).sum(axis=1)
    e = 1 / (1 + np.exp(-m)) - y
    gradient = [e.mean(), *(e[:, None] * x).mean(axis=0), *(e[:, None, None] * (x[:, :, None] * (x @ v)[:, None, :] - v * x[:, :, None] ** 2)).mean(axis=0).ravel()]
    got = CT.fm_certificate(train, fm).first()
    assert got.loss == pytest.approx(np.log1p(np.exp(np.where(y == 1, -m, m))).mean()) and got.gradient == pytest.approx(np.linalg.norm(gradient))
    p = y.mean()
    assert got.prior_loss == pytest.approx(-(p * np.log(p) + (1 - p) * np.log(1 - p))) and got.n == len(y)
    mlp = MD.fit(MD.mlp_classifier({"layers": [4, 5, 3, 2], "iter": 20, "seed": 1}), train)
    want = mlp.transform(train).select(F.avg(F.when(F.col("label") == 1, -F.log(F.get(vector_to_array("probability"), 1))).otherwise(-F.log(F.get(vector_to_array("probability"), 0))))).first()[0]
    assert CT.mlp_certificate(train, mlp, [4, 5, 3, 2]).first().loss == pytest.approx(want, rel=1e-6)
    assert A.evaluate(mlp.transform(test))[2] >= 0
