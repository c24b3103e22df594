import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import DoubleType, StructType

from tiltml.operators import block_fits
from tiltml.operators import models as MD
from tiltml.operators.certificates import fm_certificate, mlp_certificate

ROW = StructType().add("features", VectorUDT()).add("label", DoubleType())


def _separable(spark, n=3000):
    rows = [(i, float((i * 37) % 101) / 101, float((i * 53) % 89) / 89) for i in range(n)]
    df = spark.createDataFrame([(i, Vectors.dense(a, b, a * b), float(a + b > 1.2)) for i, a, b in rows], ["id", "features", "label"])
    return df.repartition(5)


def test_a_machine_over_blocks_has_the_weights_of_spark_ml(spark):
    train = _separable(spark)
    params = {"maxiter": 15, "regParam": 0.01, "stepSize": 0.1, "seed": 5, "factorSize": 3}
    got, want = MD.fit(MD.fm_classifier(params), train), MD.fm_classifier(params).fit(train)
    assert np.allclose(got.factors.toArray(), want.factors.toArray(), rtol=0, atol=1e-9)
    assert np.allclose(got.linear.toArray(), want.linear.toArray(), rtol=0, atol=1e-9) and got.intercept == pytest.approx(want.intercept, abs=1e-9)


def test_iterative_fits_take_few_tasks(spark):
    # one task a dealt partition and iteration made a fit of a few rows take thousands of tasks
    train = _separable(spark)
    with block_fits._blocks(MD.fm_classifier(), MD.deal(train, ["features", "label"], 64), 3, 2) as blocks:
        assert blocks.getNumPartitions() <= spark.sparkContext.defaultParallelism
        sums = block_fits.machine_sums(np.zeros(3 * 2 + 4), 3, 2, with_loss=True)
        loss, gradient = block_fits._mean(blocks, 3, sums)
    y = np.array([r.label for r in train.select("label").collect()])
    assert loss == pytest.approx(np.log(2)) and gradient[-1] == pytest.approx(0.5 - y.mean())


def test_a_perceptron_over_blocks_does_as_well_as_spark_ml(spark):
    train = _separable(spark)
    params = {"layers": [3, 5, 2], "iter": 60, "seed": 5}
    got, want = MD.fit(MD.mlp_classifier(params), train), MD.mlp_classifier(params).fit(train)
    first = MD.fit(MD.mlp_classifier(params | {"iter": 0}), train)
    assert np.array_equal(first.weights.toArray(), MD.mlp_classifier(params | {"iter": 0}).fit(train).weights.toArray())
    loss = [mlp_certificate(train, m, params["layers"]).first().loss for m in (got, want, first)]
    assert loss[0] <= 1.5 * loss[1] + 1e-3 and loss[0] < loss[2] / 2


@pytest.mark.parametrize("row", [(Vectors.dense(0.1, 0.2, 0.3), 2.0), (Vectors.dense(0.1, float("nan"), 0.3), 1.0), (Vectors.dense(0.1, 0.3), 1.0), (Vectors.dense(0.1, 0.2, 0.3), None)])
def test_rows_that_a_fit_cannot_use_are_errors(spark, row):
    train = _separable(spark, 50).select("features", "label").union(spark.createDataFrame([(*row,)], ROW))
    for est in (MD.fm_classifier({"maxiter": 2}), MD.mlp_classifier({"layers": [3, 2], "iter": 2})):
        with pytest.raises(Exception, match="features|labels"):
            MD.fit(est, train)


def test_a_machines_certificate_of_no_rows_and_of_no_labels(spark):
    model = MD.fit(MD.fm_classifier({"maxiter": 2, "factorSize": 3, "seed": 5}), _separable(spark, 200))
    empty = spark.createDataFrame([], ROW)
    assert fm_certificate(empty, model).first().n == 0 and fm_certificate(empty, model).first().loss is None
    unknown = spark.createDataFrame([(Vectors.dense(0.1, 0.2, 0.3), None)], ROW)
    assert fm_certificate(unknown, model).first().n == 1 and fm_certificate(unknown, model).first().loss is None
