"""Feature transformers: max-abs scaling, chi-square selection, PCA, binning.

All are spark.ml built-ins: each fit is one distributed aggregate whose
result (a d-vector, a d x d matrix, or per-feature statistics) is bounded
by the feature count, not by the row count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, ChiSqSelector, MaxAbsScaler, QuantileDiscretizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import ChiSquareTest, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltml.operators.aggregates import summed_arrays

# Fixed-width bins of scaled features for the chi-square test. Odd, so that two classes give an
# even number of degrees of freedom where every bin has rows.
CHI2_BUCKETS = 33


def maxabs_scale(train: DataFrame, test: DataFrame | None = None, input_col: str = "features",
                 output_col: str = "scaledFeatures", refit_on_test: bool = False):
    """Scale each feature by its train max |x| (to [-1, 1]; all-zero stays 0).

    Returns ``(train_scaled, test_scaled)``. The scaler is fit on train only;
    ``refit_on_test=True`` refits it on test as the original job did.
    """
    scaler = MaxAbsScaler(inputCol=input_col, outputCol=output_col)
    model = scaler.fit(train)
    train_scaled = model.transform(train)
    if test is None:
        return train_scaled, None
    test_model = scaler.fit(test) if refit_on_test else model
    return train_scaled, test_model.transform(test)


def maxabs_scale_columns(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with each column times 1 / max |x| over ``train`` (all-zero stays 0): one aggregate and
    one projection in generated code. Scale before assembling a vector where the columns are at hand."""
    maxima = train.agg(*[F.max(F.abs(F.col(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    factors = [1.0 / m if m else 1.0 for m in maxima]
    return df.withColumns({c: F.col(f"`{c}`") * F.lit(f) for c, f in zip(columns, factors, strict=True)})


def chi2_test(df: DataFrame, features_col: str = "features", label_col: str = "label") -> DataFrame:
    """Per-feature Pearson chi-square against the label:
    ``(featureIndex, pValue, degreesOfFreedom, statistic)``.

    Categorical features only (Spark caps a feature at 10,000 distinct
    values); bin continuous features with :func:`bin_features` first.
    """
    return ChiSquareTest.test(df, features_col, label_col, flatten=True)


def chi2_selector(selector_type: str = "percentile", percentile: float = 0.1,
                  num_top_features: int = 50, fpr: float = 0.05, fdr: float = 0.05,
                  fwe: float = 0.05, features_col: str = "features", label_col: str = "label",
                  output_col: str = "selectedFeatures") -> ChiSqSelector:
    """Chi-square selector with an explicit selector type.

    Setting only a percentile without the type leaves spark.ml's default
    ``numTopFeatures=50`` in force; here the type defaults to "percentile".
    """
    return ChiSqSelector(selectorType=selector_type, percentile=percentile,
                         numTopFeatures=num_top_features, fpr=fpr, fdr=fdr, fwe=fwe,
                         featuresCol=features_col, labelCol=label_col, outputCol=output_col)


def bin_features(df: DataFrame, columns: Sequence[str], num_buckets: int = 32,
                 relative_error: float = 0.001, suffix: str = "_bin") -> DataFrame:
    """Quantile buckets per column (approximate quantiles: one bounded-memory pass)."""
    qd = QuantileDiscretizer(inputCols=list(columns), outputCols=[c + suffix for c in columns],
                             numBuckets=num_buckets, relativeError=relative_error,
                             handleInvalid="keep")
    return qd.fit(df).transform(df)


def select_by_chi2(train: DataFrame, columns: Sequence[str], label_col: str = "label",
                   selector_type: str = "percentile", percentile: float = 0.5,
                   num_top_features: int = 50, fpr: float = 0.05, fdr: float = 0.05,
                   fwe: float = 0.05, num_buckets: int = 32) -> list[int]:
    """Indices (into ``columns``) chosen by a chi-square selector fit on binned values."""
    binned = bin_features(train, columns, num_buckets)
    vec = VectorAssembler(inputCols=[c + "_bin" for c in columns], outputCol="__bins",
                          handleInvalid="keep").transform(binned)
    sel = chi2_selector(selector_type, percentile, num_top_features, fpr, fdr, fwe,
                        features_col="__bins", label_col=label_col)
    return list(sel.fit(vec.select("__bins", label_col)).selectedFeatures)


def inverse_maxima(df: DataFrame, features_col: str = "features") -> list[float]:
    """1 / max |x| of each feature (1 where all are zero), from one aggregate; as many numbers as features."""
    if df.isEmpty():
        return []
    row = df.select(Summarizer.metrics("max", "min").summary(F.col(features_col)).alias("s")).select("s.max", "s.min").first()
    return [1.0 if m == 0 else 1.0 / m for m in np.maximum(np.abs(row["max"].toArray()), np.abs(row["min"].toArray())).tolist()]


def scaled_array(features_col: str, scale: Sequence[float]) -> Column:
    """The vector's elements times their factors, as an array."""
    return F.zip_with(vector_to_array(F.col(features_col)), F.array(*[F.lit(float(x)) for x in scale]), lambda x, f: x * f)


def contingency(df: DataFrame, array_col: str, label_col: str = "label", weight_col: str | None = None, num_buckets: int = CHI2_BUCKETS) -> DataFrame:
    """label, place (feature times ``num_buckets`` plus bin), total of an array in [-1, 1], cut into bins of equal width.

    Each task adds its rows into one array a label, so rows aren't multiplied: what is shuffled are counts. Null and NaN elements aren't counted. Memory: features x bins numbers for each label.
    """
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)

    def count(batches):
        found: dict[float, np.ndarray] = {}
        for b in batches:
            values, labels, weights = b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            sizes = np.diff(values.offsets.to_numpy())
            x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            feature = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            with np.errstate(invalid="ignore"):
                bins = np.clip(np.floor((x + 1.0) / 2.0 * num_buckets), 0, num_buckets - 1)
            there = ~np.isnan(x)
            for label in np.unique(labels[~np.isnan(labels)]).tolist():
                own = there & (labels[row] == label)
                at = feature[own] * num_buckets + bins[own].astype(np.int64)
                new = np.bincount(at, weights[row[own]], minlength=num_buckets * int(sizes.max(initial=0)))
                old = found.get(label, np.zeros(0))
                if len(old) < len(new):
                    old, new = new, old
                old[:len(new)] += new
                found[label] = old
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.float64()), pa.array([x.tolist() for x in found.values()], pa.list_(pa.float64()))], ["label", "counts"])

    parts = df.select(F.col(array_col).cast("array<double>").alias("x"), F.col(label_col).cast("double").alias("label"), weight.alias("n"))
    return summed_arrays(parts.mapInArrow(count, "label double, counts array<double>"), ["label"], "counts").filter(F.col("total") > 0)


def chi2_tail(statistic: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Upper tail of the chi-square distribution: the regularised incomplete gamma function, by its series
    below the mean and by its continued fraction above."""
    a, x = np.maximum(np.asarray(dof, np.float64), 1e-300) / 2.0, np.asarray(statistic, np.float64) / 2.0
    front = np.exp(np.where(x > 0, a * np.log(np.where(x > 0, x, 1.0)), -np.inf) - x - np.array([math.lgamma(v) for v in a.tolist()]))
    low = x < a + 1.0
    term = total = 1.0 / a
    xs = np.where(low, x, 0.0)
    n = 0
    while n < 100_000 and (np.abs(term) > 1e-17 * np.abs(total)).any():
        n += 1
        term = term * xs / (a + n)
        total = total + term
    xf = np.where(low, a + 2.0, x)
    tiny = 1e-300
    b = xf + 1.0 - a
    c, d = np.full_like(b, 1.0 / tiny), 1.0 / b
    h, n = d.copy(), 0
    move = np.full_like(b, 2.0)
    while n < 100_000 and (np.abs(move - 1.0) > 1e-16).any():
        n += 1
        k = -n * (n - a)
        b = b + 2.0
        d = 1.0 / np.where(np.abs(k * d + b) < tiny, tiny, k * d + b)
        c = np.where(np.abs(b + k / c) < tiny, tiny, b + k / c)
        move = c * d
        h = h * move
        if n > 400 and (np.abs(move - 1.0) < 1e-14).all():
            break
    return np.where(x <= 0, 1.0, np.clip(np.where(low, 1.0 - front * total, front * h), 0.0, 1.0))


def chi2_binned(df: DataFrame, array_col: str, label_col: str = "label", weight_col: str | None = None,
                num_buckets: int = CHI2_BUCKETS) -> list[tuple[int, float, int, float]]:
    """(feature, statistic, degrees of freedom, p-value) of each element of an array in [-1, 1], cut into
    bins of equal width, against the label; rows count ``weight_col`` times.

    The counts are those of :func:`contingency`; features x bins x classes numbers reach the driver, where all
    statistics and p-values are computed at once.
    """
    rows = contingency(df, array_col, label_col, weight_col, num_buckets).collect()
    if not rows:
        return []
    labels = sorted({r["label"] for r in rows})
    features = max(r["place"] for r in rows) // num_buckets + 1
    table = np.zeros((len(labels), features * num_buckets))
    number = {label: i for i, label in enumerate(labels)}
    table[[number[r["label"]] for r in rows], [r["place"] for r in rows]] = [r["total"] for r in rows]
    table = table.reshape(len(labels), features, num_buckets).transpose(1, 2, 0)
    by_bin, by_label = table.sum(axis=2), table.sum(axis=1)
    total = by_bin.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        expected = by_bin[:, :, None] * by_label[:, None, :] / total[:, None, None]
        cells = np.where(expected > 0, np.square(table - expected) / expected, 0.0)
    dof = ((by_bin > 0).sum(axis=1) - 1) * ((by_label > 0).sum(axis=1) - 1)
    tested = dof > 0
    statistic = np.where(tested, cells.sum(axis=(1, 2)), 0.0)
    p = np.where(tested, chi2_tail(statistic, np.where(tested, dof, 1)), 1.0)
    return [(i, float(s), int(max(k, 0)), float(v)) for i, (s, k, v) in enumerate(zip(statistic, dof, p, strict=True))]


def chosen_features(tests: Sequence[tuple[int, float, int, float]], selector_type: str = "percentile", percentile: float = 0.1,
                    num_top_features: int = 50, fpr: float = 0.05, fdr: float = 0.05, fwe: float = 0.05) -> list[int]:
    """Features that a selector keeps, in their order. Ranks: p-value (to 12 places, beyond
    which the tail of the distribution isn't computed), then the larger statistic, then the index."""
    ranked = sorted(tests, key=lambda t: (round(t[3], 12), -t[1], t[0]))
    n = len(ranked)
    if selector_type == "percentile":
        kept = ranked[:int(n * percentile)]
    elif selector_type == "numTopFeatures":
        kept = ranked[:num_top_features]
    elif selector_type == "fpr":
        kept = [t for t in ranked if t[3] < fpr]
    elif selector_type == "fdr":
        last = max([i + 1 for i, t in enumerate(ranked) if t[3] <= fdr * (i + 1) / n], default=0)
        kept = ranked[:last]
    elif selector_type == "fwe":
        kept = [t for t in ranked if t[3] < fwe / n]
    else:
        raise ValueError(f"unknown selector type {selector_type!r}")
    return sorted(t[0] for t in kept)


def select_binned(df: DataFrame, array_col: str, label_col: str = "label", weight_col: str | None = None, selector_type: str = "percentile",
                  percentile: float = 0.5, num_top_features: int = 50, fpr: float = 0.05, fdr: float = 0.05, fwe: float = 0.05,
                  num_buckets: int = CHI2_BUCKETS) -> list[int]:
    """Elements of a scaled array that a chi-square selector keeps."""
    return chosen_features(chi2_binned(df, array_col, label_col, weight_col, num_buckets), selector_type, percentile, num_top_features, fpr, fdr, fwe)


def pca_fit(train: DataFrame, k: int, input_col: str = "features", output_col: str = "pcaFeatures"):
    """PCA fit on train (covariance by one tree aggregate of a d x d Gramian)."""
    return PCA(k=k, inputCol=input_col, outputCol=output_col).fit(train)


def pca_project(train: DataFrame, test: DataFrame | None, k: int, input_col: str = "features"):
    """Project train and test onto train's top-k components, as ``(features, label)``.

    Spark's projection is not mean-centred (x . V), as in the original jobs.
    """
    model = pca_fit(train, k, input_col)

    def proj(d: DataFrame) -> DataFrame:
        keep = [c for c in d.columns if c not in (input_col, "pcaFeatures")]
        return model.transform(d).select(*keep, F.col("pcaFeatures").alias("features"))
    return proj(train), (proj(test) if test is not None else None)


def string_index(df: DataFrame, input_col: str, output_col: str | None = None,
                 order: str = "frequencyDesc", handle_invalid: str = "error") -> DataFrame:
    """Index a string column (most frequent value -> 0.0; ties alphabetical).

    Counts by value, ranks and joins back, all in the plan: any number of distinct
    values. The rank of a value is its place within its task's range of the sorted
    values plus the sizes of the ranges before it (one number a task). NULLs:
    "error" fails the job, "skip" drops the rows, "keep" gives them the next index.
    """
    out = output_col or f"{input_col}_idx"
    sort = {"frequencyDesc": [F.desc("__n"), F.asc("__v")], "frequencyAsc": [F.asc("__n"), F.asc("__v")],
            "alphabetAsc": [F.asc("__v")], "alphabetDesc": [F.desc("__v")]}[order]
    value = F.col(f"`{input_col}`").cast("string")
    counts = df.where(value.isNotNull()).groupBy(value.alias("__v")).agg(F.count("*").alias("__n"))
    index = ranked(counts, sort, "__i").select("__v", "__i")
    joined = df.join(index, value == F.col("__v"), "left").drop("__v")
    if handle_invalid == "skip":
        joined = joined.where(value.isNotNull())
    missing = F.lit(float(counts.count())) if handle_invalid == "keep" else F.raise_error(F.lit(f"NULL in {input_col}")).cast("double")
    return joined.withColumn(out, F.coalesce(F.col("__i").cast("double"), missing)).drop("__i")


def ranked(df: DataFrame, sort: Sequence[Column], name: str) -> DataFrame:
    """0-based rank in a total order without a window over one partition: the table is sorted by ranges
    and written once, so that ranges and ranks agree."""
    from pyspark.sql import Window

    from tiltml.session import materialize
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m"))
    placed = materialize(placed, "ranks")
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__c"), F.min("__m").alias("__first"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    starts = sizes.select("__p", "__first", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    return placed.join(starts, "__p").withColumn(name, F.col("__m") - F.col("__first") + F.col("__start")).drop("__p", "__m", "__first", "__start")
