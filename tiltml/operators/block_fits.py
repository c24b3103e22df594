"""Factorization machines and perceptrons, fitted over blocks of rows.

spark.ml's own trainers take the rows of a machine one by one, held as objects, and those of a perceptron 128 at a time, at
each of 50 or 100 iterations. Here every row of the dealt table is packed once into blocks of doubles, which Spark holds in memory and on
disk; an iteration is one job: each task adds up loss and gradient of its blocks, a few matrix products a block, and sends one
sum a dealt partition. A task takes several small partitions. The optimizers are spark.ml's: AdamW with its convergence test for machines, L-BFGS (10 corrections, a weak Wolfe
line search) on the mean loss of all rows for perceptrons. First weights are those that spark.ml draws from the seed, and the result is
a spark.ml model. Sums are added up by partition number, so a fit depends on how its rows are dealt only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel
from pyspark.ml.classification import FMClassifier, MultilayerPerceptronClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Doubles in a block at most, so that a block's products stay in a core's cache; bytes of blocks in a task.
BLOCK_VALUES, TASK_BYTES = 1 << 15, 1 << 25
CORRECTIONS, LINE_STEPS, VALUE_MEMORY = 10, 30, 20
ARMIJO, CURVATURE = 1e-4, 0.9


def takes(estimator) -> bool:
    """Whether the fit goes over blocks; other solvers and parts of rows are left to spark.ml."""
    if isinstance(estimator, FMClassifier):
        return estimator.getSolver() == "adamW" and estimator.getMiniBatchFraction() == 1.0 and estimator.getFitLinear() and estimator.getFitIntercept()
    return isinstance(estimator, MultilayerPerceptronClassifier) and estimator.getSolver() == "l-bfgs"


def _packed(rows: DataFrame, width: int, classes: int) -> RDD:
    """The rows of an array and a label column as (partition, bytes) of blocks: label and features, each in a run."""
    step = max(1, BLOCK_VALUES // (width + 1))

    def run(batches):
        for b in batches:
            lists, y = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            x = lists.flatten().to_numpy(zero_copy_only=False)
            if (np.diff(lists.offsets.to_numpy()) != width).any():
                raise ValueError(f"a fit needs {width} features in every row")
            if not np.isfinite(x).all():
                raise ValueError("features must not be null, NaN or infinite")
            if not (np.isfinite(y) & (y >= 0) & (y < classes) & (y == np.floor(y))).all():
                raise ValueError(f"labels must be whole numbers under {classes}")
            data = np.vstack((y, x.reshape(-1, width).T))
            out = [data[:, low:low + step].tobytes() for low in range(0, len(y), step)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["block"])

    packed = rows.mapInArrow(run, "block binary").rdd
    return packed.mapPartitionsWithIndex(lambda part, found: ((part, bytes(r.block)) for r in found))


@contextmanager
def _blocks(estimator, rows: DataFrame, width: int, classes: int) -> Iterator[RDD]:
    """The packed rows, held while a fit goes over them, in tasks of some 32 MB and no fewer than there are cores."""
    array = vector_to_array(F.col(f"`{estimator.getFeaturesCol()}`"))
    blocks = _packed(rows.select(array, F.col(f"`{estimator.getLabelCol()}`").cast("double")), width, classes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        size = blocks.map(lambda b: len(b[1])).sum()
        yield blocks.coalesce(max(blocks.context.defaultParallelism, -(-size // TASK_BYTES)))
    finally:
        blocks.unpersist()


def _mean(blocks: RDD, width: int, sums: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]]) -> tuple[float, np.ndarray]:
    """Mean loss and gradient over all rows: ``sums`` gives those of a block (features by labels) added up."""
    def run(found):
        sums_of: dict[int, tuple[int, float, np.ndarray]] = {}
        with np.errstate(over="ignore"):
            for part, block in found:
                data = np.frombuffer(block).reshape(width + 1, -1)
                loss, gradient = sums(data[1:], data[0])
                rows, so_far, by = sums_of.get(part, (0, 0.0, 0.0))
                sums_of[part] = rows + data.shape[1], so_far + loss, by + gradient
        return ((part, *found) for part, found in sums_of.items())

    parts = sorted(blocks.mapPartitions(run).collect(), key=lambda p: p[0])
    n = sum(p[1] for p in parts)
    return sum(p[2] for p in parts) / n, sum(p[3] for p in parts) / n


def _built(estimator, kind: str, *weights):
    """The estimator's spark.ml model of given weights."""
    sc = SparkContext._active_spark_context
    model = getattr(sc._jvm.org.apache.spark.ml.classification, kind)(estimator.uid, *[w if isinstance(w, float) else _py2java(sc, w) for w in weights])
    return estimator._copyValues(estimator._create_model(model))


# --------------------------------------------------------------------------- factorization machine

def machine_sums(weights: np.ndarray, width: int, factors: int, with_loss: bool = False):
    """Logistic loss (if wanted) and gradient of a block under weights laid out as in spark.ml: factors by feature, linear, constant."""
    v, w, c = weights[:width * factors].reshape(width, factors), weights[width * factors:-1], weights[-1]
    squares = (v * v).sum(axis=1)

    def run(x, y):
        s, x2 = v.T @ x, x * x
        margin = c + w @ x + 0.5 * ((s * s).sum(axis=0) - squares @ x2)
        e = 1 / (1 + np.exp(-margin)) - y
        loss = np.logaddexp(0, np.where(y > 0, -margin, margin)).sum() if with_loss else 0.0
        by_factor = (x * e) @ s.T - v * (x2 @ e)[:, None]
        return loss, np.concatenate((by_factor.ravel(), x @ e, [e.sum()]))

    return run


def adamw(gradient: Callable[[np.ndarray], np.ndarray], weights: np.ndarray, steps: int, step_size: float, decay: float, tol: float) -> np.ndarray:
    """spark.ml's AdamW: ends after ``steps`` or with a step shorter than ``tol`` of the weights' norm (1 at least)."""
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for i in range(1, steps + 1):
        g = gradient(weights)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        last = weights
        weights = weights - step_size * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8) - decay * weights
        if i > 1 and np.linalg.norm(weights - last) < tol * max(np.linalg.norm(weights), 1.0):
            break
    return weights


# --------------------------------------------------------------------------- perceptron

def _layers(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, constants) of each layer: a matrix lies by columns, its constants after it."""
    out, at = [], 0
    for ins, outs in zip(layers, layers[1:], strict=False):
        out.append((weights[at:at + ins * outs].reshape(ins, outs).T, weights[at + ins * outs:at + (ins + 1) * outs]))
        at += (ins + 1) * outs
    return out


def _perceptron_sums(weights: np.ndarray, layers: Sequence[int]):
    """Cross-entropy and gradient of a block: sigmoids within, softmax at the end."""
    parts = _layers(weights, layers)

    def run(x, y):
        acts = [x]
        for matrix, constants in parts[:-1]:
            z = matrix @ acts[-1]
            z += constants[:, None]
            np.negative(z, out=z)
            np.exp(z, out=z)
            z += 1
            acts.append(np.reciprocal(z, out=z))
        matrix, constants = parts[-1]
        z = matrix @ acts[-1] + constants[:, None]
        z -= z.max(axis=0)
        own = z[y.astype(np.int64), np.arange(len(y))].sum()
        np.exp(z, out=z)
        total = z.sum(axis=0)
        loss = np.log(total).sum() - own
        back = z / total
        back[y.astype(np.int64), np.arange(len(y))] -= 1
        gradient = []
        for level in range(len(parts) - 1, -1, -1):
            gradient = [(acts[level] @ back.T).ravel(), back.sum(axis=1), *gradient]
            if level:
                back = parts[level][0].T @ back
                back *= acts[level] * (1 - acts[level])
        return loss, np.concatenate(gradient)

    return run


def lbfgs(mean: Callable[[np.ndarray], tuple[float, np.ndarray]], weights: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """L-BFGS with a weak Wolfe line search. Ends after ``steps``, when the value fell by less than ``tol`` of the first one
    against each of the last 20, with a gradient under ``tol`` of the value, or when no step lowers the value."""
    if not steps:
        return weights
    value, gradient = mean(weights)
    first, values, pairs = value, [], []
    for _ in range(steps):
        direction = -gradient
        alphas = []
        for s, y in reversed(pairs):
            alphas.append(s @ direction / (s @ y))
            direction = direction - alphas[-1] * y
        if pairs:
            direction = direction * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]))
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            direction = direction + s * (a - y @ direction / (s @ y))
        slope = gradient @ direction
        step, low, high = 1.0 if pairs else 1.0 / max(np.linalg.norm(gradient), 1e-12), 0.0, np.inf
        for _ in range(LINE_STEPS):
            there, by = mean(weights + step * direction)
            if not there <= value + ARMIJO * step * slope:
                high = step
            elif by @ direction < CURVATURE * slope:
                low = step
            else:
                break
            step = 2 * low if high == np.inf else (low + high) / 2
        if not there < value:
            break
        values = [*values, value][-VALUE_MEMORY:]
        if (by - gradient) @ direction > 0:
            pairs = [*pairs, (step * direction, by - gradient)][-CORRECTIONS:]
        weights, value, gradient = weights + step * direction, there, by
        if max(values) - value <= tol * first or np.linalg.norm(gradient) <= max(tol * value, 1e-8):
            break
    return weights


# --------------------------------------------------------------------------- fits

def _untrained(estimator, rows: DataFrame, vector):
    """The model with the first weights that spark.ml draws from the seed."""
    one = rows.sparkSession.createDataFrame([(vector, 0.0)], [estimator.getFeaturesCol(), estimator.getLabelCol()])
    return estimator.copy({estimator.maxIter: 0}).fit(one)


def fit(estimator, rows: DataFrame, vector):
    """Fit on dealt rows; ``vector`` are the features of one of them."""
    return (_fit_machine if isinstance(estimator, FMClassifier) else _fit_perceptron)(estimator, rows, vector)


def _fit_machine(estimator, rows: DataFrame, vector):
    width, factors = len(vector), estimator.getFactorSize()
    first = _untrained(estimator, rows, vector)
    weights = np.concatenate((first.factors.toArray().ravel(), first.linear.toArray(), [first.intercept]))
    with _blocks(estimator, rows, width, 2) as blocks:
        weights = adamw(lambda w: _mean(blocks, width, machine_sums(w, width, factors))[1], weights,
                        estimator.getMaxIter(), estimator.getStepSize(), estimator.getRegParam(), estimator.getTol())
    matrix = DenseMatrix(width, factors, weights[:width * factors], True)
    return _built(estimator, "FMClassificationModel", float(weights[-1]), DenseVector(weights[width * factors:-1]), matrix)


def _fit_perceptron(estimator, rows: DataFrame, vector):
    layers = estimator.getLayers()
    if len(vector) != layers[0]:
        raise ValueError(f"{len(vector)} features for a first layer of {layers[0]}")
    given = estimator.getInitialWeights() if estimator.isDefined(estimator.initialWeights) else _untrained(estimator, rows, vector).weights
    with _blocks(estimator, rows, layers[0], layers[-1]) as blocks:
        weights = lbfgs(lambda w: _mean(blocks, layers[0], _perceptron_sums(w, layers)), given.toArray(), estimator.getMaxIter(), estimator.getTol())
    return _built(estimator, "MultilayerPerceptronClassificationModel", DenseVector(weights))
