"""Global aggregates, class statistics and evaluation scores.

Every operator is a single aggregate (partial on each task, one final
merge): the shuffle carries one partial row per task, not the data.
Values brought to the driver are bounded by the number of classes or
feature columns, never by the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` in double; NaN on a zero denominator (JVM double semantics)."""
    return F.when(den == F.lit(0), F.lit(NAN)).otherwise(num.cast("double") / den.cast("double"))


def class_counts(df: DataFrame, label_col: str = "class") -> DataFrame:
    """Rows per class in one aggregate: ``(label_col, n)``."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def count_by_value(df: DataFrame, label_col: str, values: Sequence[float]) -> dict[float, int]:
    """Counts of the given class values in one pass (bounded result to the driver)."""
    row = df.agg(*[F.count_if(F.col(label_col) == F.lit(v)).alias(f"c{i}")
                   for i, v in enumerate(values)]).first()
    return {v: int(row[f"c{i}"]) for i, v in enumerate(values)}


def class_ratio(df: DataFrame, label_col: str = "class", numerator: float = 1.0,
                denominator: float = 0.0) -> DataFrame:
    """One row: ``n_num, n_den, ratio = n_num / n_den`` (NaN when n_den = 0)."""
    n1 = F.count_if(F.col(label_col) == F.lit(numerator))
    n0 = F.count_if(F.col(label_col) == F.lit(denominator))
    agg = df.agg(n1.alias("n_num"), n0.alias("n_den"))
    return agg.select("n_num", "n_den", safe_div(F.col("n_num"), F.col("n_den")).alias("ratio"))


def class_max(df: DataFrame, value: str | Column, label_col: str = "class") -> DataFrame:
    """Maximum of a value per class: ``(label_col, max_value)``."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(label_col).agg(F.max(v).alias("max_value"))


def class_max_values(df: DataFrame, value: str | Column, label_col: str,
                     classes: Sequence[float] = (0.0, 1.0)) -> dict[float, float | None]:
    """Per-class maxima as driver scalars, one job (bounded by the class count)."""
    v = F.col(value) if isinstance(value, str) else value
    row = df.agg(*[F.max(F.when(F.col(label_col) == F.lit(c), v)).alias(f"m{i}")
                   for i, c in enumerate(classes)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(classes)}


def column_sums(df: DataFrame, columns: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """Sum of every given column (or expression) in one pass: 1 row x N columns."""
    if isinstance(columns, Mapping):
        exprs = [F.sum(e).alias(n) for n, e in columns.items()]
    else:
        exprs = [F.sum(F.col(f"`{c}`")).alias(c) for c in columns]
    return df.agg(*exprs)


def confusion_counts(df: DataFrame, prediction_col: str = "prediction", label_col: str = "label",
                     positive: float = 1.0, negative: float | None = None) -> DataFrame:
    """One row ``tp, fp, fn, tn`` counted by value (other labels are ignored)."""
    neg = (1.0 - positive) if negative is None else negative
    lab, pred = F.col(label_col).cast("double"), F.col(prediction_col).cast("double")
    return df.agg(
        F.count_if((lab == F.lit(positive)) & (pred == F.lit(positive))).alias("tp"),
        F.count_if((lab == F.lit(neg)) & (pred == F.lit(positive))).alias("fp"),
        F.count_if((lab == F.lit(positive)) & (pred == F.lit(neg))).alias("fn"),
        F.count_if((lab == F.lit(neg)) & (pred == F.lit(neg))).alias("tn"))


def confusion_matrix(df: DataFrame, prediction_col: str = "prediction",
                     label_col: str = "label") -> DataFrame:
    """Long-form matrix ``(label, prediction, n)`` over the observed values."""
    return (df.groupBy(F.col(label_col).cast("double").alias("label"),
                       F.col(prediction_col).cast("double").alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def evaluate_scores(df: DataFrame, positive: float = 0.0, prediction_col: str = "prediction",
                    label_col: str = "label") -> DataFrame:
    """One row ``tp, fp, fn, tn, tpr, tnr, score`` with ``score = tpr * tnr``.

    ``positive=0.0`` is the convention of the generic evaluator (class 0 is
    the positive cell), ``positive=1.0`` that of the random-forest job; the
    product is the same either way. A class absent from the labels gives NaN.
    """
    cm = confusion_counts(df, prediction_col, label_col, positive)
    tpr = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    tnr = safe_div(F.col("tn"), F.col("tn") + F.col("fp"))
    return cm.select("tp", "fp", "fn", "tn", tpr.alias("tpr"), tnr.alias("tnr"),
                     (tpr * tnr).alias("score"))


def evaluate(df: DataFrame, positive: float = 0.0, prediction_col: str = "prediction",
             label_col: str = "label") -> tuple[float, float, float]:
    """``(tpr, tnr, score)`` as driver values (one small job)."""
    r = evaluate_scores(df, positive, prediction_col, label_col).first()
    return float(r["tpr"]), float(r["tnr"]), float(r["score"])


def accuracy(df: DataFrame, prediction_col: str = "prediction", label_col: str = "label") -> DataFrame:
    """One row ``n, correct, accuracy``."""
    agg = df.agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col(prediction_col).cast("double") == F.col(label_col).cast("double")).alias("correct"))
    return agg.select("n", "correct", safe_div(F.col("correct"), F.col("n")).alias("accuracy"))


def summed_arrays(parts: DataFrame, keys: Sequence[str], array_col: str, *more: Column) -> DataFrame:
    """Element-wise sums of arrays by ``keys``: (keys, place, total). ``parts`` has a few rows a task, so there are as many
    cells as places for each task, and they are added up on the map side first. ``more`` are aggregates of its other columns."""
    others = [c for c in parts.columns if c not in (*keys, array_col)]
    cells = parts.select(*[F.col(f"`{c}`") for c in (*keys, *others)], F.posexplode(F.col(f"`{array_col}`")).alias("place", "__tilt_x"))
    return cells.groupBy(*[F.col(f"`{c}`") for c in keys], "place").agg(F.sum("__tilt_x").alias("total"), *more)


def _pairwise_covariance(df: DataFrame, cols: list[str]) -> DataFrame:
    """Covariances from one Gramian of centred values and their masks.

    Row ``z = [x - mean, 0 where NULL | 1 where not NULL]``; the Gramian's blocks
    hold, for every pair, the sums and the counts over the rows where both are
    present. One tree aggregate; ``4 d^2`` numbers reach the driver. NaN values count as NULL.
    """
    import numpy as np
    import pandas as pd
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    d = len(cols)
    value = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in cols]
    means = df.select(F.array(*value).alias("v")).agg(*[F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(d)]).first()
    centred = [F.coalesce(v - F.lit(means[i] or 0.0), F.lit(0.0)) for i, v in enumerate(value)]
    masks = [F.when(v.isNull(), F.lit(0.0)).otherwise(F.lit(1.0)) for v in value]
    rows = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(F.array(*centred, *masks)).alias("z")), "z")
    upper = np.triu_indices(d)
    if all(m is None for m in means):
        cov = np.full((d, d), np.nan)
        both = np.zeros((d, d))
    else:
        gram = RowMatrix(rows).computeGramianMatrix().toArray()
        products, sums, both = gram[:d, :d], gram[:d, d:], gram[d:, d:]
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = (products - sums * sums.T / both) / (both - 1.0)
    names = np.array(cols, dtype=object)
    out = pd.DataFrame({"col_a": names[upper[0]], "col_b": names[upper[1]], "covariance": cov[upper], "n": both[upper]})
    made = df.sparkSession.createDataFrame(out, "col_a string, col_b string, covariance double, n double")
    return made.select("col_a", "col_b", F.when(F.col("n") > 1, F.col("covariance")).alias("covariance"))


def feature_covariance(df: DataFrame, columns: Sequence[str], decimal_scale: int | None = None) -> DataFrame:
    """Sample covariance of every feature pair, long form ``(col_a, col_b, covariance)``.

    A pair's covariance is taken over the rows where both features are present,
    as ``covar_samp`` does, at every width (NULL for fewer than two such rows).
    With ``decimal_scale`` the sums run in exact DECIMAL arithmetic (order of
    addition no longer matters, so every engine gets the same bits), then
    ``(n*Sxy - Sx*Sy) / (n*(n-1))`` in double; this form takes features without
    NULLs, and its aggregate grows with the number of pairs.
    """
    cols = list(columns)
    if decimal_scale is None:
        return _pairwise_covariance(df, cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    dt = f"decimal(18,{decimal_scale})"
    d = {c: F.col(f"`{c}`").cast(dt) for c in cols}
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(d[c]).alias(f"s_{j}") for j, c in enumerate(cols)]
    aggs += [F.sum(d[a] * d[b]).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    row = df.agg(*aggs)
    idx = {c: j for j, c in enumerate(cols)}
    n = F.col("n").cast("double")
    cov = []
    for i, (a, b) in enumerate(pairs):
        # exact decimal sums, then the same double arithmetic in any engine
        sa, sb = F.col(f"s_{idx[a]}").cast("double"), F.col(f"s_{idx[b]}").cast("double")
        num = n * F.col(f"p{i}").cast("double") - sa * sb
        cov.append(safe_div(num, n * (n - F.lit(1.0))))
    stacked = F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), c.alias("covariance"))
        for (a, b), c in zip(pairs, cov)]))
    return row.select(stacked.alias("s")).select("s.*")
