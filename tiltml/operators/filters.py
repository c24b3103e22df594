"""Row predicates (pushed into the scan when they touch raw columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltml.functions.columns import array_element


def filter_class(df: DataFrame, value: float = 1.0, label_col: str = "class") -> DataFrame:
    """Rows of one class (``class = value``)."""
    return df.filter(F.col(label_col) == F.lit(value))


def confident_predicate(probability_col: str = "probability", label_col: str = "label",
                        threshold: float = 0.6) -> Column:
    """Confident and correct: ``(p0 > t and label = 0) or (p1 > t and label = 1)``.

    ``probability`` may be a 2-element array or an ml vector.
    """
    prob = F.col(probability_col)
    label = F.col(label_col)
    p0 = array_element(prob, 1)
    p1 = array_element(prob, 2)
    return ((p0 > F.lit(threshold)) & (label == F.lit(0))) | ((p1 > F.lit(threshold)) & (label == F.lit(1)))


def confident_filter(df: DataFrame, probability_col: str = "probability", label_col: str = "label",
                     threshold: float = 0.6) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql.types import ArrayType
    if not isinstance(df.schema[probability_col].dataType, ArrayType):
        df = df.withColumn(probability_col, vector_to_array(F.col(probability_col)))
    return df.filter(confident_predicate(probability_col, label_col, threshold))


def noise_retention_predicate(label_col: str = "label", prediction_col: str = "prediction") -> Column:
    """Keep every minority (label 1) row; keep a label-0 row only if predicted right."""
    label = F.col(label_col)
    return (label == F.lit(1)) | ((label == F.lit(0)) & (label == F.col(prediction_col)))


def noise_filter_predicate(df: DataFrame, label_col: str = "label",
                           prediction_col: str = "prediction") -> DataFrame:
    return df.filter(noise_retention_predicate(label_col, prediction_col))
