"""What a fit has reached, from its weights: loss and gradient in one aggregate.

The forward pass of a perceptron is written as columns, that of a factorization machine goes over batches, so one pass over a table
gives its mean logistic loss, the loss of the class shares alone (what a model that has learnt nothing
reaches), and the gradient's norm. An untrained or constant model shows: its loss isn't under
the shares' one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltml.operators.block_fits import machine_sums


def _sum(xs: Sequence[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return out


def _soft_loss(margin: Column, label: Column) -> Column:
    """-log of the probability of the label's class, without overflow."""
    z = F.when(label == F.lit(1.0), margin).otherwise(-margin)
    return F.when(z > 0, F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)) - z)


def _reached(means: DataFrame, gradient: Sequence[str]) -> DataFrame:
    """One row n, loss, prior_loss, gradient from the means loss, p (of the label) and those of the gradient."""
    p = F.col("p")
    prior = F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log(p) + (1 - p) * F.log(1 - p)))
    return means.select("n", "loss", prior.alias("prior_loss"), F.sqrt(_sum([F.col(g) * F.col(g) for g in gradient])).alias("gradient"))


def _certificate(staged: DataFrame, terms: Sequence[Column]) -> DataFrame:
    """One row n, loss, prior_loss, gradient from columns loss and label: the norm of the terms' means."""
    row = staged.agg(F.count("*").alias("n"), F.avg("loss").alias("loss"), F.avg("label").alias("p"), *[F.avg(t).alias(f"g{i}") for i, t in enumerate(terms)])
    return _reached(row, [f"g{i}" for i in range(len(terms))])


def fm_certificate(df: DataFrame, model, features_col: str = "features", label_col: str = "label") -> DataFrame:
    """Certificate of a factorization machine over ``df``: the gradient is that of the loss in every weight. Losses and
    gradients are added up by the batch, as in the fit; rows without a label count in n alone."""
    linear, factors = model.linear.toArray(), model.factors.toArray()
    d, k = factors.shape
    weights = np.concatenate((factors.ravel(), linear, [model.intercept]))
    sums = machine_sums(weights, d, k, with_loss=True)

    def run(batches):
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).T
            here = ~np.isnan(y)
            y, x = y[here], np.ascontiguousarray(x[:, here])
            with np.errstate(over="ignore"):
                loss, gradient = sums(x, y)
            row = [np.array([v]) for v in (len(here), len(y), y.sum(), loss, *gradient)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in row], ["n", "m", "p", "loss", *[f"g{i}" for i in range(len(gradient))]])

    names = ["p", "loss", *[f"g{i}" for i in range(len(weights))]]
    rows = df.select(vector_to_array(F.col(features_col)), F.col(label_col).cast("double"))
    parts = rows.mapInArrow(run, ", ".join(["n long", "m long", *[f"{c} double" for c in names]]))
    means = parts.agg(F.sum("n").alias("n"), *[F.try_divide(F.sum(c), F.sum("m")).alias(c) for c in names])
    return _reached(means.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))), [f"g{i}" for i in range(len(weights))])


def mlp_certificate(df: DataFrame, model, layers: Sequence[int], features_col: str = "features", label_col: str = "label") -> DataFrame:
    """Certificate of a two-class perceptron over ``df``: the gradient is that of the loss in the last layer's weights."""
    weights = model.weights.toArray()
    staged = df.select(F.col(label_col).alias("label"), vector_to_array(F.col(features_col)).alias("x"))
    staged = staged.select("label", *[F.get("x", F.lit(i)).alias(f"h0_{i}") for i in range(layers[0])])
    at = 0
    for level, (ins, outs) in enumerate(zip(layers, layers[1:], strict=False), 1):
        last = level == len(layers) - 1
        # a layer's matrix lies by columns, its constants after it
        z = [_sum([F.lit(float(weights[at + ins * outs + o]))] + [F.lit(float(weights[at + o + i * outs])) * F.col(f"h{level - 1}_{i}") for i in range(ins)]) for o in range(outs)]
        at += outs * (ins + 1)
        act = z if last else [F.lit(1.0) / (F.lit(1.0) + F.exp(-v)) for v in z]
        staged = staged.select("label", *([f"h{level - 1}_{i}" for i in range(ins)] if last else []), *[v.alias(f"h{level}_{o}") for o, v in enumerate(act)])
    n = len(layers) - 1
    margin = F.col(f"h{n}_1") - F.col(f"h{n}_0")
    staged = staged.withColumns({"loss": _soft_loss(margin, F.col("label")), "e": F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)) - F.col("label")})
    terms = [F.col("e"), *[F.col("e") * F.col(f"h{n - 1}_{i}") for i in range(layers[-2])]]
    return _certificate(staged, terms)
