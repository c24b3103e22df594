"""Column-level expressions over wide numeric tables.

Everything here is a built-in Catalyst expression (whole-stage codegen), no
Python UDF. Functions return either a ``Column`` or a ``DataFrame`` whose
plan only adds a projection.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL_COLUMNS = ("class", "label")


def feature_columns(df: DataFrame, exclude: Iterable[str] = LABEL_COLUMNS) -> list[str]:
    """All columns except the label columns (``class`` and ``label``).

    The label-leak rule: a raw table that already carries ``label`` must
    not feed it back as a feature, so both names are excluded by default.
    """
    skip = set(exclude)
    return [c for c in df.columns if c not in skip]


def select_except(df: DataFrame, *drop: str) -> DataFrame:
    """Every column but the given ones, in table order."""
    skip = set(drop)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in skip])


def cast_all_double(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast every (or the given) column to double; bad text becomes NULL.

    Dates and timestamps become seconds since 1970-01-01 (zone-less ones as they stand).
    """
    def cast(c: str) -> Column:
        col, kind = F.col(f"`{c}`"), df.schema[c].dataType
        if isinstance(kind, (T.DateType, T.TimestampNTZType)):
            since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col.cast("timestamp_ntz"))
            return since / F.lit(1_000_000.0)
        return col.try_cast("double")
    cols = list(columns) if columns is not None else df.columns
    return df.withColumns({c: cast(c) for c in cols})


def derive_label(df: DataFrame, source: str = "class", target: str = "label") -> DataFrame:
    """``label = CAST(source AS double)``."""
    return df.withColumn(target, F.col(source).cast("double"))


def shift_features(df: DataFrame, amount: float, columns: Sequence[str] | None = None) -> DataFrame:
    """Add a constant to every feature column (makes values non-negative)."""
    cols = list(columns) if columns is not None else feature_columns(df)
    return df.withColumns({c: F.col(f"`{c}`") + F.lit(amount) for c in cols})


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns; names that do not exist are ignored."""
    return df.drop(*cols)


def row_sum(cols: Sequence[str | Column]) -> Column:
    """Row-wise sum of columns, left to right; a NULL cell makes the sum NULL.

    One form at every width: a fold over ``array(...)``, so thousands of columns
    build no deep expression tree. The sum has the columns' common type (whole
    numbers stay whole); cast decimals first, since their sums would widen.
    """
    exprs = [F.col(f"`{c}`") if isinstance(c, str) else c for c in cols]
    arr = F.array(*exprs)
    return F.aggregate(F.slice(arr, 2, len(exprs)), F.get(arr, F.lit(0)), lambda acc, x: acc + x)


def class_lookup(label: Column, values: Mapping[float, float | Column],
                 default: Column | None = None) -> Column:
    """Constant per class value (``map(k0, v0, k1, v1)[label]``) as CASE WHEN.

    Unknown classes yield NULL (like a map lookup miss) unless ``default``.
    """
    expr = None
    for k, v in values.items():
        val = v if isinstance(v, Column) else F.lit(v)
        expr = F.when(label == F.lit(k), val) if expr is None else expr.when(label == F.lit(k), val)
    if expr is None:
        return default if default is not None else F.lit(None)
    return expr.otherwise(default) if default is not None else expr


def conditional_value(cond: Column, if_true, if_false) -> Column:
    a = if_true if isinstance(if_true, Column) else F.lit(if_true)
    b = if_false if isinstance(if_false, Column) else F.lit(if_false)
    return F.when(cond, a).otherwise(b)


def vector_element(vector_col: str | Column, index: int) -> Column:
    """0-based element of an ml/mllib vector; NULL past the end (no ANSI error)."""
    v = F.col(vector_col) if isinstance(vector_col, str) else vector_col
    return F.get(vector_to_array(v), F.lit(index))


def vector_to_columns(df: DataFrame, vector_col: str = "features", n: int = 30,
                      prefix: str = "label", keep: Sequence[str] = ("label",)) -> DataFrame:
    """Explode the first ``n`` vector elements into ``prefix0..prefix{n-1}``.

    The vector is converted to an array once; elements past its length are
    NULL. ``keep`` columns are carried after the exploded ones.
    """
    arr = vector_to_array(F.col(vector_col))
    tmp = "__tilt_arr"
    staged = df.select(*[F.col(k) for k in keep if k in df.columns], arr.alias(tmp))
    cols = [F.get(F.col(tmp), F.lit(i)).alias(f"{prefix}{i}") for i in range(n)]
    return staged.select(*cols, *[F.col(k) for k in keep if k in df.columns])


def columns_to_array(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`") for c in cols])


def array_element(col: str | Column, position: int) -> Column:
    """1-based array element; NULL when out of range (ANSI-safe).

    Written as the 0-based ``get`` (``try_element_at`` inside a filter hits a
    code-generation failure in Spark 4.1 and falls back to interpretation).
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.get(c, F.lit(position - 1))


def pack_cells(df: DataFrame, columns: Sequence[str], weight: Mapping[str, Column] | Column) -> DataFrame:
    """Replace each feature column by ``struct(weight, value, res = weight * value)``."""
    def w(c: str) -> Column:
        return weight[c] if isinstance(weight, Mapping) else weight
    return df.withColumns({
        c: F.struct(w(c).alias("weight"), F.col(f"`{c}`").alias("value"),
                    (w(c) * F.col(f"`{c}`")).alias("res"))
        for c in columns
    })


def unpack_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("class",)) -> DataFrame:
    """Project struct cells back to their raw ``value`` under the original names."""
    return df.select(*[F.col(f"`{c}`.value").alias(c) for c in columns],
                     *[F.col(k) for k in keep])


def uniform_column(seed: int, keys: Sequence[str] | None = None, salt: str | None = None) -> Column:
    """Random [0,1) column: ``rand(seed)`` natively, hash-u when keys are given."""
    if keys:
        from tiltml.functions.hashing import hash_u
        return hash_u(keys, seed, salt)
    return F.rand(seed)


def label_remap(df: DataFrame, label_col: str = "label", source: float = 0.0, target: float = -1.0) -> DataFrame:
    """Relabel one class value (e.g. 0 -> -1 for a margin-based learner)."""
    return df.withColumn(label_col, F.when(F.col(label_col) == F.lit(source), F.lit(target))
                         .otherwise(F.col(label_col)).cast("double"))


def limit_rows(df: DataFrame, n: int, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows; with ``order_by`` the rows are deterministic (top-n per
    task, then one merge of at most n rows per task)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
