"""Two-class fixtures derived from the driver tables, each with a DuckDB twin.

Every fixture reads a whole driver table; nothing is capped or subset.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixture definitions (keys, features, label thresholds).
LINEITEM_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
ML_BINARY_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ML_DISCRETE_FEATURES = ["l_quantity", "l_linenumber", "l_discount", "l_tax"]
REVENUE_THRESHOLD = 80000
PREDICTION_PRICE_THRESHOLD = 82000
PROBABILITY_PRICE_LOW = 65000
PROBABILITY_PRICE_SPAN = 30000
ORDERS_PRICE_THRESHOLD = 400000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ml_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys + 4 double features + ``class`` (about 20% ones at every scale)."""
    li = table(spark, sf_dir, "lineitem")
    revenue = F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))
    return li.select(
        *LINEITEM_KEYS, *ML_BINARY_FEATURES,
        F.when(revenue >= F.lit(REVENUE_THRESHOLD), F.lit(1.0)).otherwise(F.lit(0.0)).alias("class"))


ML_BINARY_SQL = f"""
SELECT {', '.join(LINEITEM_KEYS)}, {', '.join(ML_BINARY_FEATURES)},
       CAST(CASE WHEN l_extendedprice * (1 - l_discount) >= {REVENUE_THRESHOLD}
                 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS class
FROM lineitem"""


def ml_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few-category features against ``class = (l_returnflag = 'R')``.

    ``l_linenumber`` stays an integer key; its double copy is the feature
    ``l_linenumber_f``.
    """
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        *LINEITEM_KEYS,
        F.col("l_quantity").cast("double").alias("l_quantity"),
        F.col("l_discount").cast("double").alias("l_discount"),
        F.col("l_tax").cast("double").alias("l_tax"),
        F.col("l_linenumber").cast("double").alias("l_linenumber_f"),
        F.when(F.col("l_returnflag") == F.lit("R"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("class"))


ML_DISCRETE_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
       CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount,
       CAST(l_tax AS DOUBLE) AS l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber_f,
       CAST(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS class
FROM lineitem"""

ML_DISCRETE_FEATURE_COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber_f"]


ML_BINNED_FEATURES = ["l_quantity", "price_step", "l_discount", "l_tax"]
PRICE_STEP = 2500


def ml_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ml_binary`` with the price in steps, so that every feature has some 50 values at most and
    the first levels of a tree can be grown exactly in SQL."""
    b = ml_binary(spark, sf_dir)
    return b.select(*LINEITEM_KEYS, "l_quantity", F.floor(F.col("l_extendedprice") / PRICE_STEP).cast("double").alias("price_step"), "l_discount", "l_tax", "class")


ML_BINNED_SQL = f"""
SELECT {', '.join(LINEITEM_KEYS)}, l_quantity, floor(l_extendedprice / {PRICE_STEP})::DOUBLE AS price_step, l_discount, l_tax, class
FROM ({ML_BINARY_SQL})"""


def ml_highcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One high-cardinality feature (``l_extendedprice``) against ``ml_binary``'s class."""
    return ml_binary(spark, sf_dir).select(*LINEITEM_KEYS, "l_extendedprice", "class")


def emb_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, features (vector of 64 doubles), label = (label = 0)``."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        "vec_id",
        array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"),
        F.when(F.col("label") == F.lit(0), F.lit(1.0)).otherwise(F.lit(0.0)).alias("label"))


EMB_BINARY_SQL = """
SELECT vec_id, embedding, CAST(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS label
FROM embeddings"""


def orders_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_totalprice",
                    F.when(F.col("o_totalprice") > F.lit(ORDERS_PRICE_THRESHOLD), F.lit(1.0))
                    .otherwise(F.lit(0.0)).alias("class"))


ORDERS_BINARY_SQL = f"""
SELECT o_orderkey, o_totalprice,
       CAST(CASE WHEN o_totalprice > {ORDERS_PRICE_THRESHOLD} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS class
FROM orders"""


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` joined to ``documents``: feature ``n_chars``, ``class = quality``.

    Class 1 is the majority here. ``labels`` is the small side of the join
    but its size is not bounded by contract, so no broadcast hint: AQE turns
    the join into a broadcast at run time when the measured side is small.
    """
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return (lab.join(docs, "doc_id")
            .select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                    F.col("quality").cast("double").alias("class")))


TEXT_LABELS_SQL = """
SELECT l.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(l.quality AS DOUBLE) AS class
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def formula_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ml_binary`` plus a model-free prediction and a 2-element probability."""
    b = ml_binary(spark, sf_dir)
    p1 = F.least(F.lit(1.0), F.greatest(
        F.lit(0.0), (F.col("l_extendedprice") - F.lit(PROBABILITY_PRICE_LOW)) / F.lit(PROBABILITY_PRICE_SPAN)))
    return b.select(
        *LINEITEM_KEYS, "l_extendedprice",
        F.col("class").alias("label"),
        F.when(F.col("l_extendedprice") > F.lit(PREDICTION_PRICE_THRESHOLD), F.lit(1.0))
        .otherwise(F.lit(0.0)).alias("prediction"),
        F.array(F.lit(1.0) - p1, p1).alias("probability"))


FORMULA_PREDICTIONS_SQL = f"""
SELECT {', '.join(LINEITEM_KEYS)}, l_extendedprice, class AS label,
       CAST(CASE WHEN l_extendedprice > {PREDICTION_PRICE_THRESHOLD} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS prediction,
       1.0 - LEAST(1.0, GREATEST(0.0, (l_extendedprice - {PROBABILITY_PRICE_LOW}) / {PROBABILITY_PRICE_SPAN}.0)) AS p0,
       LEAST(1.0, GREATEST(0.0, (l_extendedprice - {PROBABILITY_PRICE_LOW}) / {PROBABILITY_PRICE_SPAN}.0)) AS p1
FROM ({ML_BINARY_SQL}) b"""
