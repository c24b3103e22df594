"""Iterative weight evolution and evolved feature selection.

Every cell ``v`` of feature ``j`` starts with a weight ``w0``; each round does
``w' = w + (cut[c] - (res + cut[c])) / M[c]`` and ``res' = w * v`` with the
*previous* ``w``, where ``c`` is the row's class and ``M[c]`` the largest row
sum of raw values within the class. The cut constants cancel, leaving
``w(t+1) = w(t) - x * w(t-1)``, ``x = v / M[c]``, ``w(-1) = w(0)``, so after
``T`` rounds ``w(T) = w0 * P_T(x)`` with integer coefficients
``P_T(x) = sum_k (-1)^k * C(T+1-k, k) * x^k``.

The plan is therefore: one aggregate for the per-class maxima (two numbers
to the driver), then a single projection computing ``P_T`` by Horner's
rule per cell, then one aggregate of the per-column weight sums (N numbers).
No plan depth grows with ``T``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltml.functions.columns import feature_columns, row_sum
from tiltml.functions.hashing import hash_u
from tiltml.operators.aggregates import class_max_values, summed_arrays

# The round count and per-class cut constants of the original job.
DEFAULT_ITERATIONS = 10
CUT_CONSTANT_CLASS1 = 100000
CUT_CONSTANT_CLASS0 = 10000
DEFAULT_TOP_K = 200


def evolution_coefficients(iterations: int) -> list[int]:
    """Integer coefficients ``c_k`` (ascending powers of x) of ``P_T``."""
    prev, cur = [1], [1]                     # w(-1), w(0) as polynomials in x
    for _ in range(iterations):
        nxt = cur + [0] * (len(prev) + 1 - len(cur))
        for k, c in enumerate(prev):
            nxt[k + 1] -= c
        prev, cur = cur, nxt
    while len(cur) > 1 and cur[-1] == 0:
        cur.pop()
    return cur


def horner(x: Column, coeffs: Sequence[int]) -> Column:
    expr: Column = F.lit(float(coeffs[-1]))
    for c in reversed(coeffs[:-1]):
        expr = F.lit(float(c)) + x * expr
    return expr


def sql_horner(x: str, coeffs: Sequence[int]) -> str:
    expr = f"{float(coeffs[-1])!r}"
    for c in reversed(coeffs[:-1]):
        expr = f"({float(c)!r} + {x} * {expr})"
    return expr


def initial_weight(mode: str, column: str | Column, seed: int, keys: Sequence[str] | None,
                   index: int = 0) -> Column:
    """``w0`` per cell: "const" (1.0), "hash" (hash-u by row key and column
    name; the name may be a column in long form) or "rand" (``rand(seed +
    index)``, partition-dependent)."""
    if mode == "const":
        return F.lit(1.0)
    if mode == "hash":
        if not keys:
            raise ValueError("weight_mode='hash' needs key columns")
        if isinstance(column, Column):
            return hash_u(list(keys) + [column], seed)
        return hash_u(keys, seed, salt=column)
    if mode == "rand":
        return F.rand(seed + index)
    raise ValueError(f"unknown weight_mode {mode!r}")


def class_row_maxima(df: DataFrame, features: Sequence[str], label_col: str = "class",
                     float32: bool = True) -> dict[float, float | None]:
    """``M[c]`` = max over rows of class ``c`` of the raw row sum (one job).

    ``float32`` rounds the maxima to single precision as the original job
    did before embedding them as literals.
    """
    maxima = class_max_values(df, row_sum(features), label_col, (0.0, 1.0))
    if float32:
        import numpy as np
        maxima = {c: (float(np.float32(v)) if v is not None else None) for c, v in maxima.items()}
    return maxima


def _scaled(feature: str, label_col: str, maxima: dict) -> Column:
    lab = F.col(label_col)
    m = F.when(lab == F.lit(0.0), F.lit(maxima.get(0.0))).when(lab == F.lit(1.0), F.lit(maxima.get(1.0)))
    # a class maximum of 0 (or an absent class) gives NULL weights, not an error
    return F.try_divide(F.col(f"`{feature}`").cast("double"), m)


def evolved_weights(df: DataFrame, features: Sequence[str], maxima: dict, label_col: str = "class",
                    iterations: int = DEFAULT_ITERATIONS, weight_mode: str = "const",
                    seed: int = 0, keys: Sequence[str] | None = None) -> dict[str, Column]:
    """Final weight expression per feature (Horner form of ``P_T``)."""
    coeffs = evolution_coefficients(iterations)
    return {c: initial_weight(weight_mode, c, seed, keys, i) * horner(_scaled(c, label_col, maxima), coeffs)
            for i, c in enumerate(features)}


def _summed(rows: DataFrame, names: list[str]) -> DataFrame:
    """``(column, score)`` from the array column ``__tilt_w``: one aggregate with one sum for each
    place (combined on each task), then one row a name. An empty table gives NULL scores."""
    row = rows.agg(*[F.sum(F.get("__tilt_w", F.lit(i))).alias(f"s{i}") for i in range(len(names))])
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"s{i}").alias("score"))
                                  for i, n in enumerate(names)]))
    return row.select(stacked.alias("c")).select("c.column", "c.score")


def _scores(df: DataFrame, feats: Sequence[str], maxima: dict, label_col: str, iterations: int,
            weight_mode: str, seed: int, keys: Sequence[str] | None) -> DataFrame:
    """Summed final weights, one form at every width: the polynomial is one lambda over the row's
    cells, so the plan doesn't grow by a polynomial for each column and no row is multiplied."""
    coeffs = evolution_coefficients(iterations)
    lab = F.col(label_col)
    m = F.when(lab == F.lit(0.0), F.lit(maxima.get(0.0))).when(lab == F.lit(1.0), F.lit(maxima.get(1.0)))
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in feats])
    first = F.array(*[initial_weight(weight_mode, c, seed, keys, i) for i, c in enumerate(feats)])
    staged = df.select(values.alias("__tilt_v"), first.alias("__tilt_w0"), m.cast("double").alias("__tilt_m"))
    # the quotient is bound once a cell, not in every step of the polynomial
    shares = F.transform("__tilt_v", lambda v: F.try_divide(v, F.col("__tilt_m")))
    weights = F.zip_with(shares, "__tilt_w0", lambda x, w: w * horner(x, coeffs))
    return _summed(staged.select(weights.alias("__tilt_w")), list(feats))


def moment_scores(df: DataFrame, features: Sequence[str], label_col: str = "class", iterations: int = DEFAULT_ITERATIONS, float32_max: bool = True) -> DataFrame:
    """``(column, score)`` for starting weights of 1 from one scan: a score is a combination of the sums of a column's
    powers in each class, so the class maxima and those sums are gathered together, in one array a class and task; the plan is the
    same at every width. NULL and NaN values count for nothing."""
    coeffs = evolution_coefficients(iterations)
    d, size = len(features), len(coeffs)

    def moments(batches):
        found: dict[float, tuple[float | None, np.ndarray]] = {}
        for b in batches:
            classes, sums = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in np.unique(classes).tolist():
                own = classes == c
                highest, totals = found.get(c, (None, np.zeros((size, d))))
                row, v = sums[own], x[own]
                row = row[~np.isnan(row)]
                if len(row):
                    highest = max(row.max(), -np.inf if highest is None else highest)
                there = ~np.isnan(v)
                v = np.where(there, v, 0.0)
                power = there.astype(np.float64)
                for k in range(size):
                    totals[k] += power.sum(axis=0)
                    power *= v
                found[c] = highest, totals
        if found:
            cols = [pa.array(list(found), pa.float64()), pa.array([m for m, _ in found.values()], pa.float64()), pa.array([t.ravel().tolist() for _, t in found.values()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["c", "m", "p"])

    label = F.col(label_col).cast("double")
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    rows = df.filter(label.isin(0.0, 1.0)).select(label.alias("c"), row_sum(features).cast("double").alias("s"), values.alias("x"))
    totals = summed_arrays(rows.mapInArrow(moments, "c double, m double, p array<double>"), ["c"], "p", F.max("m").alias("m"))
    m = F.col("m").cast("float").cast("double") if float32_max else F.col("m")
    names = F.array(*[F.lit(c) for c in features])
    power = F.floor(F.col("place") / d).cast("int")
    factor = F.get(F.array(*[F.lit(float(c)) for c in coeffs]), power) * F.pow(F.try_divide(F.lit(1.0), m), power)
    # a class maximum of 0 gives NULL weights, which count for nothing; a column without values has a NULL score
    cells = totals.select(F.get(names, F.col("place") % d).alias("column"), (F.col("total") * factor).alias("cell"), F.when((power == 0) & (m != 0), F.col("total")).alias("n"))
    # every column has its row, also where the table has no rows of the two classes
    every = df.sparkSession.range(1).select(F.explode(names).alias("column"), F.lit(None).cast("double").alias("cell"), F.lit(None).cast("double").alias("n"))
    return cells.unionByName(every).groupBy("column").agg(F.when(F.sum("n") > 0, F.sum("cell")).alias("score"))


def weight_evolution(df: DataFrame, features: Sequence[str] | None = None, label_col: str = "class",
                     iterations: int = DEFAULT_ITERATIONS, weight_mode: str = "const", seed: int = 0,
                     keys: Sequence[str] | None = None, float32_max: bool = True) -> DataFrame:
    """Per-feature evolved weight totals ``(column, score)``; equal starting weights take one scan."""
    feats = list(features) if features is not None else feature_columns(df, exclude=set(keys or ()) | {label_col, "label"})
    if weight_mode == "const":
        return moment_scores(df, feats, label_col, iterations, float32_max)
    maxima = class_row_maxima(df, feats, label_col, float32_max)
    return _scores(df, feats, maxima, label_col, iterations, weight_mode, seed, keys)


def top_k_columns(scores: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """The ``k`` best columns by score (descending; ties by column name).

    ``scores`` has one row per feature column, so this sort is bounded by
    the table's width, not its length.
    """
    return scores.orderBy(F.col("score").desc(), F.col("column").asc()).limit(k)


def project_selected(df: DataFrame, columns: Sequence[str], label_col: str = "class",
                     keep: Sequence[str] = ()) -> DataFrame:
    """Raw values of the selected columns plus the class (struct cells unwrapped)."""
    from pyspark.sql.types import StructType

    def raw(c: str) -> Column:
        if isinstance(df.schema[c].dataType, StructType):
            return F.col(f"`{c}`.value").alias(c)
        return F.col(f"`{c}`")
    return df.select(*keep, *[raw(c) for c in columns], F.col(label_col))


def instance_filter(df: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """Keep rows whose summed weights reach ``avg - min`` of that row score."""
    score = row_sum(list(weights.values()))
    scored = df.withColumn("__tilt_row_score", score)
    r = scored.agg(F.avg("__tilt_row_score").alias("a"), F.min("__tilt_row_score").alias("m")).first()
    if r["a"] is None:
        return df
    return scored.filter(F.col("__tilt_row_score") >= F.lit(r["a"] - r["m"])).drop("__tilt_row_score")


def evolved_feature_selection(df: DataFrame, k: int = DEFAULT_TOP_K, features: Sequence[str] | None = None,
                              label_col: str = "class", iterations: int = DEFAULT_ITERATIONS,
                              weight_mode: str = "const", seed: int = 0,
                              keys: Sequence[str] | None = None, float32_max: bool = True,
                              with_instance_filter: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Evolve weights, keep the top-``k`` columns by weight total, emit raw values + class.

    The name map is kept explicitly, so any column name (including ones
    containing ``_sum``) survives.
    """
    feats = list(features) if features is not None else feature_columns(
        df, exclude=set(keys or ()) | set(keep) | {label_col, "label"})
    scores = weight_evolution(df, feats, label_col, iterations, weight_mode, seed, keys, float32_max)
    chosen = [r["column"] for r in top_k_columns(scores, k).collect()]
    base = df
    if with_instance_filter:
        maxima = class_row_maxima(df, feats, label_col, float32_max)
        base = instance_filter(df, evolved_weights(df, feats, maxima, label_col, iterations, weight_mode, seed, keys))
    return project_selected(base, chosen, label_col, keep)
