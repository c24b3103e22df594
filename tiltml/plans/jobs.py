"""Batch jobs: the end-to-end pipelines a user runs, as ``job(spark, config)``.

``config`` is a plain dict with the keys the original YAML files carried
(``dataset``, ``test``, ``output``, ``params`` ...). Required keys are checked
up front. Scores come back as a one-row DataFrame instead of stdout.
Optional ``keys`` (list of key columns) switches every random draw to
hash-u, making a job's output independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltml.functions.columns import derive_label, feature_columns, shift_features
from tiltml.operators import aggregates as A
from tiltml.operators import cleaning as X
from tiltml.operators import evolution as EV
from tiltml.operators import features as FT
from tiltml.operators import models as MD
from tiltml.operators import sampling as S
from tiltml.operators.certificates import fm_certificate, mlp_certificate
from tiltml.sources import fixtures as FX
from tiltml.sources.readers import assemble_features, prepare_data, scan_checked, scan_delimited
from tiltml.sources.sinks import sink_parquet

# Shift applied before naive Bayes (keeps features non-negative),
# and the flagship slice's forest.
NB_SHIFT = 10.0
FLAGSHIP_TREES = 10
FLAGSHIP_DEPTH = 4


def _require(config: Mapping, *keys: str) -> None:
    missing = [k for k in keys if k not in config]
    if missing:
        raise KeyError(f"job config is missing required keys: {missing}")


def _params(config: Mapping) -> dict:
    return dict(config.get("params") or {})


def _keys(config: Mapping) -> list[str]:
    return list(config.get("keys") or [])


def _load(spark: SparkSession, config: Mapping):
    """Train/test ML tables; key columns (``config['keys']``) are carried, never features."""
    return prepare_data(spark, config, cast_double=bool(config.get("cast_double")), keep=_keys(config))


def gbt_job(spark: SparkSession, config: Mapping) -> DataFrame:
    """Train boosted trees on ``dataset``, score ``test``: (tp..score), class 0 positive."""
    _require(config, "dataset", "test", "params")
    p = _params(config)
    train, test = _load(spark, config)
    weight = None
    if p.get("prepare"):
        # variant: oversample -> scale -> chi-square selection before boosting; copies go into the fit as weights
        weight = "w"
        train, test = X.prepare_chain(train, test, float(p.get("ratio", 1.5)),
                                      str(p.get("selectorType", "percentile")), float(p.get("percentil", 0.5)),
                                      keys=config.get("keys"), keep=_keys(config), weight_col=weight)
    if p.get("k"):
        # variant: PCA(k) fit on train before boosting
        train, test = FT.pca_project(train, test, int(p["k"]))
    pred = MD.fit_predict(MD.gbt_classifier(p, weight_col=weight), train, test)
    return A.evaluate_scores(pred, positive=0.0)


def rf_job(spark: SparkSession, config: Mapping) -> DataFrame:
    """Random forest train + score, class 1 positive."""
    _require(config, "dataset", "test")
    train, test = _load(spark, config)
    pred = MD.fit_predict(MD.rf_classifier(_params(config)), train, test)
    return A.evaluate_scores(pred, positive=1.0)


def _scaled(p: Mapping, train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test, scaled by train's largest absolute values if the job's ``scale`` says ``maxabs``."""
    if p.get("scale") not in (None, "maxabs"):
        raise ValueError(f"unknown scale {p['scale']!r}")
    return MD.scaled_split(train, test) if p.get("scale") else (train, test)


def mlp_job(spark: SparkSession, config: Mapping) -> DataFrame:
    """Multilayer perceptron train + score, with the train/test row counts and what the fit has reached on
    train: loss, prior_loss (of the class shares alone) and the gradient's norm. ``scale: maxabs`` scales first."""
    _require(config, "dataset", "test", "params")
    p = _params(config)
    train, test = _scaled(p, *_load(spark, config))
    model = MD.fit(MD.mlp_classifier(p), train)
    reached = mlp_certificate(train, model, [int(x) for x in p["layers"]]).withColumnRenamed("n", "n_train")
    sizes = reached.crossJoin(test.agg(F.count("*").alias("n_test")))  # one row each
    return A.evaluate_scores(model.transform(test), positive=0.0).crossJoin(sizes)


def fm_job(spark: SparkSession, config: Mapping) -> DataFrame:
    """Factorization machine train + score, with what the fit has reached on train: loss, prior_loss and the
    gradient's norm. ``scale: maxabs`` scales first."""
    _require(config, "dataset", "test", "params")
    p = _params(config)
    train, test = _scaled(p, *_load(spark, config))
    model = MD.fit(MD.fm_classifier(p), train)
    return A.evaluate_scores(model.transform(test), positive=0.0).crossJoin(fm_certificate(train, model).withColumnRenamed("n", "n_train"))  # one row each


def nb_job(spark: SparkSession, config: Mapping) -> DataFrame:
    """Shift features by +10, label from ``class``, 70/30 split, naive Bayes, accuracy."""
    _require(config, "dataset")
    raw = spark.read.parquet(str(config["dataset"]))
    keys = _keys(config)
    feats = feature_columns(raw, exclude={"class", "label", *keys})
    df = derive_label(shift_features(raw, NB_SHIFT, feats), "class", "label")
    ml = assemble_features(df, feats, label_source=None, keep=keys)   # keys, features, label
    train, test = S.random_split(ml, [0.7, 0.3], S.SPLIT_SEED_70_30, keys or None)
    pred = MD.fit_predict(MD.nb_classifier(), train, test)
    return A.accuracy(pred)


def pca_weighted_gbt_job(spark: SparkSession, config: Mapping) -> DataFrame:
    """PCA(k) fit on train, then boosting with a positive-class weight; score and train counts by class."""
    _require(config, "dataset", "test", "params")
    p = _params(config)
    train, test = _load(spark, config)
    ptr, pte = FT.pca_project(train, test, int(p["k"]))
    weighted = MD.positive_class_weight(ptr, float(p.get("scale_pos_weight", 1.0)))
    pred = MD.fit_predict(MD.weighted_gbt_classifier(p), weighted, pte)
    counts = train.agg(F.count_if(F.col("label") == 0.0).alias("n_train_0"), F.count_if(F.col("label") == 1.0).alias("n_train_1"))
    return A.evaluate_scores(pred, positive=0.0).crossJoin(counts)  # one row each


def pca_preview_job(spark: SparkSession, config: Mapping, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """PCA(k) projections of train and test: the first ``n`` rows each by the key columns
    (without keys, by the projection itself)."""
    _require(config, "dataset", "test", "params")
    train, test = _load(spark, config)
    ptr, pte = FT.pca_project(train, test, int(_params(config)["k"]))
    order = _keys(config) or [vector_to_array(F.col("features"))]
    return ptr.orderBy(*order).limit(n), pte.orderBy(*order).limit(n)


def feature_preparation_job(spark: SparkSession, config: Mapping) -> tuple[DataFrame, DataFrame]:
    """Oversample 1.5 -> max-abs scale -> chi-square select; write trainOut/testOut."""
    _require(config, "dataset", "test", "trainOut", "testOut")
    p = _params(config)
    train, test = _load(spark, config)
    tr, te = X.prepare_chain(train, test, float(p.get("ratio", 1.5)),
                             str(p.get("selectorType", "percentile")), float(p.get("percentil", 0.5)),
                             keys=config.get("keys"), keep=_keys(config))
    sink_parquet(tr, str(config["trainOut"]))
    sink_parquet(te, str(config["testOut"]))
    return spark.read.parquet(str(config["trainOut"])), spark.read.parquet(str(config["testOut"]))


def evolved_selection_job(spark: SparkSession, config: Mapping) -> DataFrame:
    """Undersample (ratio 1), evolve weights, keep the top-k columns; write ``output``."""
    _require(config, "dataset", "output")
    p = _params(config)
    keys = config.get("keys")
    raw = spark.read.parquet(str(config["dataset"]))
    bal = S.undersample(raw, 1.0, "class", S.SAMPLING_SEED, keys)
    out = EV.evolved_feature_selection(
        bal, int(p.get("k", EV.DEFAULT_TOP_K)), label_col="class",
        iterations=int(p.get("iterations", EV.DEFAULT_ITERATIONS)),
        weight_mode=str(p.get("weight_mode", "hash" if keys else "rand")),
        seed=int(p.get("seed", 0)), keys=keys,
        with_instance_filter=bool(p.get("instance_filter", False)), keep=list(keys or []))
    sink_parquet(out, str(config["output"]))
    return spark.read.parquet(str(config["output"]))


def cascade_job(spark: SparkSession, config: Mapping) -> DataFrame:
    """Confidence cascade over an ML table (``datasetTrain``); write ``output``."""
    _require(config, "datasetTrain", "output")
    p = _params(config)
    ml = spark.read.parquet(str(config["datasetTrain"]))
    keys = config.get("keys")
    out = X.confidence_cascade(ml, rounds=int(p.get("rounds", X.CASCADE_ROUNDS)),
                               configs=p.get("configs", X.CASCADE_CONFIGS), keys=keys,
                               keep=list(keys or []), model_seed=p.get("seed"))
    sink_parquet(out, str(config["output"]))
    return spark.read.parquet(str(config["output"]))


def synthetic_job(spark: SparkSession, config: Mapping) -> DataFrame:
    """30 synthetic Bernoulli(0.7) features per row; written to ``output`` (or ``test``)."""
    _require(config, "dataset")
    out_path = config.get("output", config.get("test"))
    if out_path is None:
        raise KeyError("job config needs 'output' (or 'test') as the output path")
    p = _params(config)
    ml = spark.read.parquet(str(config["dataset"]))
    keys = config.get("keys")
    out = X.synthetic_bernoulli(ml, int(p.get("n", X.SYNTHETIC_COLUMNS)),
                                float(p.get("p_class0", X.SYNTHETIC_P_ONE)),
                                float(p.get("p_class1", X.SYNTHETIC_P_ONE)),
                                seed=int(p.get("seed", 0)), keys=keys, keep=list(keys or []))
    sink_parquet(out, str(out_path))
    return spark.read.parquet(str(out_path))


def csv_mlp_job(spark: SparkSession, config: Mapping) -> DataFrame:
    """``|``-separated text -> drop ``layers`` -> label from ``media`` -> assemble -> fit MLP -> score the rows.

    Features are every column except the keys, ``class``, ``label`` and the label
    source ``media`` (no leak). ``schema`` (DDL text) spares the pass over the
    text that infers one; with ``quarantine`` too, lines that don't fit it go there. Returns keys, label and prediction of every row.
    """
    _require(config, "dataset", "params")
    keys = _keys(config)
    if config.get("quarantine"):
        _require(config, "schema")
        df = scan_checked(spark, str(config["dataset"]), config["schema"], str(config["quarantine"]), drop=("layers",))
    else:
        df = scan_delimited(spark, str(config["dataset"]), sep="|", header=True, schema=config.get("schema"), drop=("layers",))
    feats = feature_columns(df, exclude={"class", "label", "media", *keys})
    ml = assemble_features(derive_label(df, "media", "label"), feats, label_source=None, keep=keys)
    ml, _ = _scaled(_params(config), ml, ml)
    return MD.fit_predict(MD.mlp_classifier(_params(config)), ml, ml).select(*keys, "label", "prediction")


def flagship_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: ml_binary -> hash 70/30 split -> assemble -> RF -> scores."""
    ml = assemble_features(FX.ml_binary(spark, sf_dir), FX.ML_BINARY_FEATURES, "class", keep=FX.LINEITEM_KEYS)
    train, test = S.random_split(ml, [0.7, 0.3], S.SPLIT_SEED_70_30, FX.LINEITEM_KEYS)
    est = MD.rf_classifier({"nTrees": FLAGSHIP_TREES, "maxDepth": FLAGSHIP_DEPTH, "seed": 42})
    return A.evaluate_scores(MD.fit_predict(est, train, test), positive=0.0)
