"""Classifiers (spark.ml estimators) configured from job parameter dicts.

Each ``*_classifier(params)`` returns an unfitted estimator; ``fit_predict``
fits on train and scores test, adding ``rawPrediction, probability,
prediction``. Trees and naive Bayes are trained by spark.ml's distributed
implementation, machines and perceptrons over blocks of rows
(:mod:`tiltml.operators.block_fits`); the driver only holds the model.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import FMClassifier, GBTClassifier, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltml.operators import block_fits


def gbt_classifier(params: Mapping | None = None, features_col: str = "features",
                   label_col: str = "label", weight_col: str | None = None) -> GBTClassifier:
    """Gradient-boosted trees: ``maxIter``, ``depth`` (maxDepth), ``stepsize``/``stepSize``, ``maxBins``, ``seed``."""
    p = dict(params or {})
    est = GBTClassifier(featuresCol=features_col, labelCol=label_col, featureSubsetStrategy="auto")
    if "maxIter" in p:
        est.setMaxIter(int(p["maxIter"]))
    if "depth" in p or "maxDepth" in p:
        est.setMaxDepth(int(p.get("depth", p.get("maxDepth"))))
    step = p.get("stepsize", p.get("stepSize"))
    if step is not None:
        est.setStepSize(float(step))
    if "maxBins" in p:
        est.setMaxBins(int(p["maxBins"]))
    if "seed" in p:
        est.setSeed(int(p["seed"]))
    if weight_col:
        est.setWeightCol(weight_col)
    return est


def rf_classifier(params: Mapping | None = None, features_col: str = "features",
                  label_col: str = "label") -> RandomForestClassifier:
    """Random forest: ``impurity``, ``maxDepth``, ``nTrees``, ``strategy``, ``maxBins``, ``bootstrap``, ``seed``.

    Missing keys keep spark.ml's defaults (depth 5, 20 trees, "auto"); the
    original job's fallbacks (0 trees, depth 0) could not train.
    """
    p = dict(params or {})
    est = RandomForestClassifier(featuresCol=features_col, labelCol=label_col,
                                 impurity=str(p.get("impurity", "gini")))
    if "maxDepth" in p:
        est.setMaxDepth(int(p["maxDepth"]))
    if "nTrees" in p or "numTrees" in p:
        est.setNumTrees(int(p.get("nTrees", p.get("numTrees"))))
    if "strategy" in p:
        est.setFeatureSubsetStrategy(str(p["strategy"]))
    if "maxBins" in p:
        est.setMaxBins(int(p["maxBins"]))
    if "bootstrap" in p:
        est.setBootstrap(bool(p["bootstrap"]))
    if "seed" in p:
        est.setSeed(int(p["seed"]))
    return est


def mlp_classifier(params: Mapping, features_col: str = "features",
                   label_col: str = "label") -> MultilayerPerceptronClassifier:
    """Multilayer perceptron: ``layers`` (first = #features, last = #classes),
    ``stepsize``, ``blockSize``, ``seed``, ``iter``."""
    p = dict(params)
    est = MultilayerPerceptronClassifier(featuresCol=features_col, labelCol=label_col,
                                         layers=[int(x) for x in p["layers"]])
    if "stepsize" in p or "stepSize" in p:
        est.setStepSize(float(p.get("stepsize", p.get("stepSize"))))
    if "blockSize" in p:
        est.setBlockSize(int(p["blockSize"]))
    if "seed" in p:
        est.setSeed(int(p["seed"]))
    if "iter" in p or "maxIter" in p:
        est.setMaxIter(int(p.get("iter", p.get("maxIter"))))
    return est


def fm_classifier(params: Mapping | None = None, features_col: str = "features",
                  label_col: str = "label") -> FMClassifier:
    """Factorization machine: ``maxiter``, ``regParam``, ``stepSize``, ``factorSize`` (the original job called it "SVM").
    Scale the features first: with raw prices and the default step the weights run away."""
    p = dict(params or {})
    est = FMClassifier(featuresCol=features_col, labelCol=label_col)
    if "maxiter" in p or "maxIter" in p:
        est.setMaxIter(int(p.get("maxiter", p.get("maxIter"))))
    if "regParam" in p:
        est.setRegParam(float(p["regParam"]))
    if "stepSize" in p:
        est.setStepSize(float(p["stepSize"]))
    if "factorSize" in p:
        est.setFactorSize(int(p["factorSize"]))
    if "seed" in p:
        est.setSeed(int(p["seed"]))
    return est


def nb_classifier(smoothing: float = 1.0, model_type: str = "multinomial",
                  features_col: str = "features", label_col: str = "label") -> NaiveBayes:
    """Naive Bayes (multinomial, smoothing 1); features must be non-negative."""
    return NaiveBayes(featuresCol=features_col, labelCol=label_col,
                      smoothing=smoothing, modelType=model_type)


def positive_class_weight(df: DataFrame, scale_pos_weight: float, label_col: str = "label",
                          weight_col: str = "w") -> DataFrame:
    """``w = scale_pos_weight`` for label 1, else 1.0 (boosting's positive-class weight)."""
    return df.withColumn(weight_col, F.when(F.col(label_col) == F.lit(1.0), F.lit(float(scale_pos_weight)))
                         .otherwise(F.lit(1.0)))


def weighted_gbt_classifier(params: Mapping, features_col: str = "features",
                            label_col: str = "label", weight_col: str = "w") -> GBTClassifier:
    """Boosting with a positive-class weight: ``num_round`` -> maxIter, weights in ``w``.

    ``num_workers`` is not mapped: parallelism follows the input partitions,
    which a fixed worker count from a small-cluster config would shrink.
    """
    p = dict(params)
    est = GBTClassifier(featuresCol=features_col, labelCol=label_col, weightCol=weight_col,
                        maxIter=int(p.get("num_round", 20)))
    if "depth" in p or "maxDepth" in p:
        est.setMaxDepth(int(p.get("depth", p.get("maxDepth"))))
    if "seed" in p:
        est.setSeed(int(p["seed"]))
    return est


# Session setting: partitions of a fit's training rows (default: spark.sql.shuffle.partitions).
FIT_PARTITIONS_CONF = "spark.tiltml.fit.partitions"


# Equal rows without keys are dealt in runs of so many.
EQUAL_RUN = 256


def _needed(estimator) -> list[str]:
    named = ("featuresCol", "labelCol", "weightCol")
    return [estimator.getOrDefault(p) for p in named if estimator.hasParam(p) and estimator.isDefined(p)]


def deal(train: DataFrame, columns: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The named columns of a fit's rows, dealt by a hash of the whole row over a number of partitions that the caller or
    the session sets, and ordered within: the same on any number of cores and from any file layout.

    Where a table has no other columns (no keys), equal rows are counted first, which also takes them out of the shuffle,
    and are dealt in runs by the hash of the row and the run's number: no partition gets all copies of a row.
    """
    conf = train.sparkSession.conf
    n = partitions or int(conf.get(FIT_PARTITIONS_CONF, conf.get("spark.sql.shuffle.partitions")))
    cols = [F.col(f"`{c}`") for c in columns]
    if set(train.columns) - set(columns):
        place = F.xxhash64(*[F.col(f"`{c}`") for c in train.columns])
        dealt = train.select(*cols, place.alias("__tilt_place")).repartition(n, "__tilt_place")
        return dealt.sortWithinPartitions("__tilt_place").drop("__tilt_place")
    counted = train.groupBy(*cols).agg(F.count("*").alias("__tilt_n"))
    run = F.lit(EQUAL_RUN)
    runs = counted.withColumn("__tilt_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__tilt_n") - 1) / run))))
    runs = runs.withColumn("__tilt_place", F.xxhash64(*cols, F.col("__tilt_run"))).repartition(n, "__tilt_place").sortWithinPartitions("__tilt_place", "__tilt_run")
    size = F.least(run, F.col("__tilt_n") - F.col("__tilt_run") * run).cast("int")
    return runs.select(*cols, F.explode(F.array_repeat(F.lit(True), size)).alias("__tilt_copy")).drop("__tilt_copy")


@contextmanager
def held(rows: DataFrame) -> Iterator[DataFrame]:
    """The rows kept in memory and on disk while fits read them, and released after."""
    rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def training_rows(estimator, train: DataFrame, partitions: int | None = None) -> DataFrame:
    """What a fit reads: features, label and weight only.

    An iterative fit's result depends on how its rows are dealt (bags are drawn by partition),
    so they go through :func:`deal`. One-pass fits (naive Bayes) read their input as it is.
    """
    cols = _needed(estimator)
    return train.select(*[F.col(f"`{c}`") for c in cols]) if isinstance(estimator, NaiveBayes) else deal(train, cols, partitions)


# Rows from which a feature's bins are chosen: so many, or fewer if there are many features.
BIN_ROWS, BIN_VALUES = 100_000, 5_000_000
# Rows that a bagged fit draws one by one; of larger tables it draws runs of equal binned rows, about so many and one a cell more.
BAG_ROWS = 1 << 21
# Cells in a partition of a bagged and of any other tree fit's input: a boosted fit has thousands of short stages, whose tasks take longer to send than to run.
CELL_ROWS, BOOSTED_ROWS = 1 << 14, 1 << 16
CELL_WEIGHT = "__tilt_weight"


def is_tree_fit(estimator) -> bool:
    return isinstance(estimator, (GBTClassifier, RandomForestClassifier))


def is_bagged(estimator) -> bool:
    return isinstance(estimator, RandomForestClassifier) and estimator.getBootstrap()


def fit(estimator, train: DataFrame, partitions: int | None = None):
    """Fit on :func:`training_rows` (machines and perceptrons over blocks of them), or a tree fit on :func:`tree_cells`."""
    if block_fits.takes(estimator):
        first = train.select(F.col(f"`{estimator.getFeaturesCol()}`")).head()
        if first is None or first[0] is None:
            raise ValueError("a fit needs rows with features")
        return block_fits.fit(estimator, training_rows(estimator, train, partitions), first[0])
    if not is_tree_fit(estimator):
        return estimator.fit(training_rows(estimator, train, partitions))
    with tree_cells(estimator, train) as cells:
        return weighted(estimator).fit(cells)


def weighted(estimator):
    """The estimator for rows of :func:`tree_cells`."""
    return estimator.copy({estimator.weightCol: CELL_WEIGHT})


def bin_values(sample: np.ndarray, times: np.ndarray, bins: int) -> list[np.ndarray]:
    """Each feature's values that stand for its bins: all values of the sample, or as many quantiles as there are bins.
    A value belongs to the nearest one (the lower one in the middle), where a tree fit on these values puts its thresholds."""
    out = []
    for x in sample.T:
        here = ~np.isnan(x)
        values, place = np.unique(x[here], return_inverse=True)
        if len(values) > bins:
            share = np.cumsum(np.bincount(place, times[here])) / times[here].sum()
            values = np.unique(values[np.searchsorted(share, (np.arange(bins) + 0.5) / bins)])
        out.append(values if len(values) else np.zeros(1))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _coded(rows: DataFrame, values: Sequence[np.ndarray], names: Sequence[str]) -> DataFrame:
    """``code`` (the bins of the array in the first column, two bytes a feature) and the other columns."""
    cuts = [(v[1:] + v[:-1]) / 2 for v in values]
    schema = ", ".join(["code binary", *[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0))
            codes = np.empty(x.shape, "<u2")
            for j, c in enumerate(cuts):
                codes[:, j] = np.searchsorted(c, x[:, j])
            ends = np.arange(len(x) + 1, dtype=np.int32) * (2 * len(cuts))
            code = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([code, *b.columns[1:]], ["code", *names])

    return rows.mapInArrow(run, schema)


def _decoded(values: Sequence[np.ndarray]):
    """UDF: the values that stand for a code's bins."""
    width = max(len(v) for v in values)
    table = np.array([np.pad(v, (0, width - len(v))) for v in values])

    @F.pandas_udf("array<double>")
    def run(code: pd.Series) -> pd.Series:
        codes = np.frombuffer(b"".join(code), "<u2").reshape(len(code), len(table))
        return pd.Series(list(table[np.arange(len(table)), codes]), dtype=object)

    return run


@contextmanager
def tree_cells(estimator, train: DataFrame, keep: Sequence[str] = ()) -> Iterator[DataFrame]:
    """What a tree fit reads: features, label, ``keep`` and a weight, a row for all rows that it can't tell apart.

    A tree sees no more of a feature than its bin (``maxBins``). The bins are chosen here, once, from a sample by a hash of the
    row as the fit itself does; every row of the table is put into its bins, and equal rows become one with their number (or the sum
    of their weights) as its weight. The table is read once; what the fit goes over at each level of each tree is bounded by the bins, whatever the
    number of rows, and by the rows if there are many features. Thresholds lie between the values that stand for bins, so
    the model scores rows as they are. A bagged fit gets runs of equal rows, as long as leaves about ``BAG_ROWS`` of them, dealt as by :func:`deal`; up to
    that number of rows a run is one row. The cells are dealt by a hash and held for the length of the fits.
    """
    columns = _needed(estimator)
    features, others = columns[0], [*columns[1:], *keep]
    if estimator.isDefined(estimator.weightCol) and estimator.getOrDefault(estimator.weightCol):
        weight = F.col(f"`{estimator.getWeightCol()}`")
    else:
        weight = F.lit(1.0)
    bagged = is_bagged(estimator)
    named = [F.col(f"`{c}`") for c in others]
    needed = {features, *others}
    slim = train.select(vector_to_array(F.col(f"`{features}`")).alias("__tilt_x"), *named, F.xxhash64(*[F.col(f"`{c}`") for c in train.columns]).alias("__tilt_place"))
    checked = F.when(F.col("__tilt_x").isNull() | F.col(f"`{columns[1]}`").isNull() | F.isnan(F.col(f"`{columns[1]}`")),
                     F.raise_error(F.lit("a fit needs features and a label in every row"))).otherwise(F.col("__tilt_x"))
    slim = slim.withColumn("__tilt_x", checked)
    if set(train.columns) - needed:
        slim = slim.withColumn("__tilt_n", F.lit(1).cast("long"))
    else:
        slim = slim.groupBy("__tilt_x", *named, "__tilt_place").agg(F.count("*").alias("__tilt_n"))
    with held(slim):
        distinct, rows, width = slim.agg(F.count("*"), F.sum("__tilt_n"), F.max(F.size("__tilt_x"))).first()
        if not rows:
            raise ValueError("a fit needs rows")
        wanted = min(BIN_ROWS, max(10_000, BIN_VALUES // max(1, width)))
        some = slim.where(F.pmod("__tilt_place", F.lit(max(1, distinct // wanted))) == 0).select("__tilt_x", "__tilt_n").toArrow()
        if some.num_rows < min(distinct, wanted) // 4:  # few different rows, often repeated: all of them
            some = slim.groupBy("__tilt_x").agg(F.sum("__tilt_n").alias("__tilt_n")).toArrow()
        values = bin_values(_matrix(some.column(0).combine_chunks()), some.column(1).to_numpy().astype(np.float64), estimator.getMaxBins())
        cells = _coded(slim.select("__tilt_x", *others, "__tilt_n"), values, [*others, "__tilt_n"])
        total = F.sum("__tilt_n") if bagged else F.sum(weight * F.col("__tilt_n"))
        by = [c for c in others if bagged or c not in columns[2:]]
        cells = cells.groupBy("code", *[F.col(f"`{c}`") for c in by]).agg(total.alias(CELL_WEIGHT))
        cells = cells.where(F.col(CELL_WEIGHT) > 0)
        with held(cells):
            place = [F.col("code"), *[F.col(f"`{c}`") for c in by]]
            parts = max(1, -(-cells.count() // (CELL_ROWS if bagged else BOOSTED_ROWS)))
            if bagged:
                run = F.lit(max(1, rows // BAG_ROWS))
                parts = max(parts, -(-min(rows, BAG_ROWS) // (2 * CELL_ROWS)))
                runs = cells.withColumn("__tilt_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(CELL_WEIGHT) - 1) / run))))
                size = F.least(run.cast("long"), F.col(CELL_WEIGHT) - F.col("__tilt_run") * run)
                cells, place = runs.withColumn(CELL_WEIGHT, size * weight), [*place, F.col("__tilt_run")]
            dealt = cells.withColumn("__tilt_place", F.xxhash64(*place)).repartition(parts, "__tilt_place").sortWithinPartitions("__tilt_place", *place)
            vector = array_to_vector(_decoded(values)(F.col("code"))).alias(features)
            out = dealt.select(vector, *[F.col(f"`{c}`") for c in [columns[1], *keep]], F.col(CELL_WEIGHT).cast("double").alias(CELL_WEIGHT))
            out.persist(StorageLevel.MEMORY_AND_DISK)
            out.count()
    try:
        yield out
    finally:
        out.unpersist()


def fit_dealt(jobs, parallelism: int = 4) -> list:
    """Fit independent ``(estimator, dealt rows)`` pairs from a thread pool, in the order given.

    Each fit is a series of Spark jobs; submitting several at once lets the
    scheduler interleave them across idle task slots (the same scheme as
    ``CrossValidator(parallelism=...)``).
    """
    from concurrent.futures import ThreadPoolExecutor
    jobs = list(jobs)
    if parallelism <= 1 or len(jobs) <= 1:
        return [est.fit(rows) for est, rows in jobs]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(jobs))) as pool:
        return list(pool.map(lambda job: job[0].fit(job[1]), jobs))


def scaled_split(train: DataFrame, test: DataFrame, features_col: str = "features") -> tuple[DataFrame, DataFrame]:
    """Train and test with features scaled by train's largest absolute values."""
    from tiltml.operators.features import maxabs_scale
    parts = maxabs_scale(train, test, features_col, "__tilt_scaled")
    return tuple(p.drop(features_col).withColumnRenamed("__tilt_scaled", features_col) for p in parts)


def fit_predict(estimator, train: DataFrame, test: DataFrame) -> DataFrame:
    """Fit on train and score test (adds rawPrediction, probability, prediction)."""
    return fit(estimator, train).transform(test)
