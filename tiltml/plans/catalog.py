"""Query catalogue: one Spark query per operator, each with a DuckDB twin.

Every query reads whole driver tables (through the fixtures) and returns
plain columns (no vectors), aliased the same way as its oracle SQL.
Randomised operators use hash-u draws keyed by the fixture's unique keys,
so the oracle reproduces them row for row. SQL can't fit the trees, perceptrons
and machines: their queries run the full fit and return what SQL can check of it
(which rows were scored, the counts of each class, rules that every row keeps).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltml.functions import columns as C
from tiltml.functions.hashing import hash_u, sql_hash_u
from tiltml.operators import aggregates as A
from tiltml.operators import certificates as CT
from tiltml.operators import cleaning as X
from tiltml.operators import evolution as EV
from tiltml.operators import features as FT
from tiltml.operators import filters as FL
from tiltml.operators import models as MD
from tiltml.operators import sampling as S
from tiltml.operators import tree_tables as TT
from tiltml.plans import jobs as J
from tiltml.session import materialize, scratch_path
from tiltml.sources import fixtures as FX
from tiltml.sources.readers import assemble_features, prepare_data, quarantined, scan_checked, scan_delimited
from tiltml.sources.sinks import preview, schema_table, sink_delimited, sink_parquet

KEYS = FX.LINEITEM_KEYS
FEATS = FX.ML_BINARY_FEATURES
KEYS_SQL = ", ".join(KEYS)
B = f"WITH b AS ({FX.ML_BINARY_SQL})"

# Parameters of the registered queries (seeds follow the jobs).
SEED = S.SAMPLING_SEED
SPLIT_SEED = S.SPLIT_SEED_70_30
FOLD_SEED = S.SPLIT_SEED_FOLDS
WEIGHT_SEED = 7
OVERSAMPLE_RATIO = 1.5
TOP_K_REPORT = 2
TOP_K_SELECT = 3
SHIFT = 10.0
RF_PARAMS = {"maxDepth": 4, "nTrees": 90, "seed": 123456789, "strategy": "sqrt", "impurity": "gini"}
GBT_PARAMS = {"maxIter": 20, "depth": 5, "stepsize": 0.4, "seed": 1234}
MLP_PARAMS = {"layers": [4, 8, 2], "stepsize": 0.03, "blockSize": 128, "seed": 1234, "iter": 100, "scale": "maxabs"}
FM_PARAMS = {"maxiter": 50, "regParam": 0.01, "stepSize": 0.1, "seed": 1234, "scale": "maxabs"}
# What TPR x TNR each fit reaches at least (a constant prediction has 0), and the largest norm of a gradient.
SCORE_GATES = {"gbt": 0.9, "rf": 0.7, "mlp": 0.9, "fm": 0.7, "weighted_gbt": 0.5}
GRADIENT_BOUND = 0.1
PCA_K = 3
SIG_DIGITS = 9
LIMIT_ROWS = 1000
FDR = 0.05


def sig_round(x, digits: int = SIG_DIGITS):
    """Round to ``digits`` significant digits (float sums differ in the last
    bits between engines because the order of addition differs).

    Only exact powers of ten (10^0..10^22) scale the value, so after the
    decimal rounding every engine lands on the same double.
    """
    p = F.ceil(F.log10(F.abs(x)))
    up = F.pow(F.lit(10.0), p)
    down = F.pow(F.lit(10.0), -p)
    scaled = F.when(p >= 0, F.round(x / up, digits) * up).otherwise(F.round(x * down, digits) / down)
    return F.when((x == F.lit(0.0)) | x.isNull() | F.isnan(x), x).otherwise(scaled)


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint location."""
    return scratch_path(spark, name)


def _u(seed: int = SEED, salt: str | None = None):
    return hash_u(KEYS, seed, salt)


def _su(seed: int = SEED, salt: str | None = None) -> str:
    return sql_hash_u(KEYS, seed, salt)


def _split_train_test(df: DataFrame, seed: int = SPLIT_SEED, weights=(0.7, 0.3)):
    return S.random_split(df, list(weights), seed, KEYS)


SQL_TRAIN = f"{_su(SPLIT_SEED)} < 0.7"
SQL_TEST = f"{_su(SPLIT_SEED)} >= 0.7"


def _vec_cols(df: DataFrame, vec: str, names: list[str]) -> list:
    """Vector elements as columns; ``+ 0.0`` folds -0.0 into 0.0 (a sparse
    vector drops the sign of zero, a dense one keeps it)."""
    arr = vector_to_array(F.col(vec))
    return [(F.get(arr, F.lit(i)) + F.lit(0.0)).alias(n) for i, n in enumerate(names)]


# --------------------------------------------------------------------------- sources / sinks

def q_scan_parquet(spark, d):
    return FX.ml_binary(spark, d)


def q_scan_delimited(spark, d):
    path = _scratch(spark, "part-delimited")
    sink_delimited(FX.table(spark, d, "part"), path, sep="|")
    return scan_delimited(spark, path, sep="|", header=True, infer_schema=True)


CHECKED_SCHEMA = "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string"


def q_scan_checked(spark, d):
    """Lines of which some have text for a number (orders divisible by 97) or lack a field (by 101): good rows and quarantined lines."""
    text, apart = _scratch(spark, "lines"), _scratch(spark, "quarantine")
    li = FX.table(spark, d, "lineitem")
    part = F.when(F.col("l_orderkey") % 97 == 0, F.concat(F.lit("x"), F.col("l_partkey").cast("string"))).otherwise(F.col("l_partkey").cast("string"))
    flag = F.when(F.col("l_orderkey") % 101 != 0, F.col("l_returnflag"))
    li.select(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), part, flag)).write.text(text)
    good = scan_checked(spark, text, CHECKED_SCHEMA, apart, header=False).withColumn("line", F.lit(None).cast("string"))
    return good.unionByName(quarantined(spark, apart).select("line"), allowMissingColumns=True)


def q_sink_parquet(spark, d):
    path = _scratch(spark, "ml-binary")
    sink_parquet(FX.ml_binary(spark, d), path)
    return spark.read.parquet(path)


def q_prepare_data(spark, d):
    train, test = _split_train_test(FX.ml_binary(spark, d))
    tp, sp = _scratch(spark, "train"), _scratch(spark, "test")
    sink_parquet(train, tp)
    sink_parquet(test, sp)
    tr, te = prepare_data(spark, {"dataset": tp, "test": sp}, keep=KEYS)
    names = [f"f{i}" for i in range(len(FEATS))]
    out = lambda x, part: x.select(*KEYS, *_vec_cols(x, "features", names), "label", F.lit(part).alias("part"))
    return out(tr, "train").unionByName(out(te, "test"))


# --------------------------------------------------------------------------- projections

def q_cast_all_double(spark, d):
    return C.cast_all_double(FX.table(spark, d, "lineitem"))


def q_derive_label(spark, d):
    return C.derive_label(FX.orders_binary(spark, d), "class", "label")


def q_shift_features(spark, d):
    return C.shift_features(FX.ml_binary(spark, d), SHIFT, FEATS)


def q_drop_columns(spark, d):
    return C.drop_columns(FX.ml_binary(spark, d), "l_tax", "l_discount", "no_such_column")


def q_rename_columns(spark, d):
    return C.rename_columns(FX.ml_binary(spark, d), {"class": "label", "l_quantity": "qty"})


def q_select_alias(spark, d):
    return FX.ml_binary(spark, d).selectExpr(
        "l_orderkey AS ok", "l_linenumber AS ln", "l_extendedprice * (1 - l_discount) AS revenue", "class AS label")


def q_select_except(spark, d):
    return C.select_except(FX.ml_binary(spark, d), "class")


def q_pack_weighted_cells(spark, d):
    b = FX.ml_binary(spark, d)
    packed = C.pack_cells(b, FEATS, {c: _u(WEIGHT_SEED, c) for c in FEATS})
    return packed.select(*KEYS, *[F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in FEATS
                                  for f in ("weight", "value", "res")], "class")


def q_vector_to_columns(spark, d):
    emb = FX.emb_binary(spark, d)
    wide = C.vector_to_columns(emb, "features", 30, "label", keep=("vec_id", "label"))
    return wide.select("vec_id", *[(F.col(f"label{i}") + F.lit(0.0)).alias(f"label{i}") for i in range(30)], "label")


def q_columns_to_array(spark, d):
    b = FX.ml_binary(spark, d).withColumn("arr", C.columns_to_array(FEATS))
    return b.select(*KEYS, F.size("arr").alias("n_elems"), C.array_element("arr", 1).alias("first_elem"),
                    C.array_element("arr", len(FEATS)).alias("last_elem"), "class")


def q_array_element(spark, d):
    emb = FX.table(spark, d, "embeddings")
    return emb.select("vec_id", C.array_element("embedding", 1).cast("double").alias("e1"),
                      C.array_element("embedding", 64).cast("double").alias("e64"),
                      C.array_element("embedding", 65).cast("double").alias("e65"))


def q_class_lookup(spark, d):
    b = FX.ml_binary(spark, d)
    n = len(FEATS)
    cut = C.class_lookup(F.col("class"), {0.0: EV.CUT_CONSTANT_CLASS0 / n, 1.0: EV.CUT_CONSTANT_CLASS1 / n})
    return b.select(*KEYS, "class", cut.alias("cut"))


def q_conditional_value(spark, d):
    b = FX.ml_binary(spark, d)
    return b.select(*KEYS, C.conditional_value(F.col("l_quantity") > F.lit(25), 1, 0).alias("big_qty"))


def q_row_sum(spark, d):
    b = FX.ml_binary(spark, d)
    s = C.row_sum(FEATS)
    return b.select(*KEYS, "class", F.lit(0).alias("sum"), s.alias("sumTotal"),
                    (s * F.col("class")).alias("total"))


def q_row_weighted_sum(spark, d):
    b = FX.ml_binary(spark, d)
    s = C.row_sum([_u(WEIGHT_SEED, c) * F.col(c) for c in FEATS])
    return b.select(*KEYS, "class", s.alias("sum"))


def q_random_column(spark, d):
    return FX.ml_binary(spark, d).select(*KEYS, _u(SEED).alias("u"))


# --------------------------------------------------------------------------- filters

def q_filter_class(spark, d):
    return FL.filter_class(FX.ml_binary(spark, d), 1.0, "class")


def q_confident_filter(spark, d):
    return FL.confident_filter(FX.formula_predictions(spark, d)).select(*KEYS, "label", "prediction")


def q_noise_filter_predicate(spark, d):
    return FL.noise_filter_predicate(FX.formula_predictions(spark, d)).select(*KEYS, "label", "prediction")


# --------------------------------------------------------------------------- aggregates / evaluation

def q_class_counts(spark, d):
    return A.class_counts(FX.ml_binary(spark, d), "class")


def q_class_max(spark, d):
    return A.class_max(FX.ml_binary(spark, d), C.row_sum(FEATS), "class")


def q_column_sums(spark, d):
    b = FX.ml_binary(spark, d)
    sums = A.column_sums(b, {c: F.col(c).cast("decimal(18,2)") for c in FEATS})
    return sums.select(*[F.col(c).cast("double").alias(c) for c in FEATS])


def q_class_ratio(spark, d):
    return A.class_ratio(FX.ml_binary(spark, d), "class", 1.0, 0.0)


def q_confusion_matrix(spark, d):
    return A.confusion_matrix(FX.formula_predictions(spark, d))


def q_evaluate_scores(spark, d):
    return A.evaluate_scores(FX.formula_predictions(spark, d), positive=0.0)


def q_evaluate_scores_pos1(spark, d):
    return A.evaluate_scores(FX.formula_predictions(spark, d), positive=1.0)


def q_accuracy(spark, d):
    return A.accuracy(FX.formula_predictions(spark, d))


def q_feature_covariance(spark, d):
    cov = A.feature_covariance(FX.ml_binary(spark, d), FEATS, decimal_scale=2)
    return cov.select("col_a", "col_b", sig_round(F.col("covariance")).alias("covariance"))


# --------------------------------------------------------------------------- sampling / sets

def q_undersample(spark, d):
    return S.undersample(FX.ml_binary(spark, d), 1.0, "class", SEED, KEYS)


def q_oversample(spark, d):
    b = FX.ml_binary(spark, d).withColumnRenamed("class", "label")
    return S.oversample(b, OVERSAMPLE_RATIO, "label", SEED, KEYS)


def q_balance(spark, d):
    return S.balance(FX.text_labels(spark, d), "class", SEED, ["doc_id"])


def q_random_split(spark, d):
    return S.assign_split(FX.ml_binary(spark, d), [0.7, 0.3], SPLIT_SEED, KEYS).select(*KEYS, "class", "split")


def q_kfold_assign(spark, d):
    return S.kfold_assign(FX.ml_binary(spark, d), 4, FOLD_SEED, KEYS).select(*KEYS, "class", "fold")


def q_union_all(spark, d):
    b = FX.ml_binary(spark, d)
    return S.union_all(b.filter(F.col("l_extendedprice") > 50000), b.filter(F.col("l_discount") > 0.05))


def q_union_many(spark, d):
    b = FX.ml_binary(spark, d)
    return S.union_many(S.random_split(b, [0.25] * 4, FOLD_SEED, KEYS))


def q_first_row(spark, d):
    return FX.ml_binary(spark, d).orderBy(*KEYS).limit(1)


# --------------------------------------------------------------------------- evolution / selection

def q_weight_evolution(spark, d):
    s = EV.weight_evolution(FX.ml_binary(spark, d), FEATS, "class", weight_mode="const")
    return s.select("column", sig_round(F.col("score")).alias("score"))


def q_weight_evolution_hash(spark, d):
    s = EV.weight_evolution(FX.ml_binary(spark, d), FEATS, "class", weight_mode="hash",
                            seed=WEIGHT_SEED, keys=KEYS)
    return s.select("column", sig_round(F.col("score")).alias("score"))


def q_top_k_columns(spark, d):
    s = EV.weight_evolution(FX.ml_binary(spark, d), FEATS, "class", weight_mode="const")
    return EV.top_k_columns(s, TOP_K_REPORT).select("column", sig_round(F.col("score")).alias("score"))


def q_evolved_feature_selection(spark, d):
    bal = S.undersample(FX.ml_binary(spark, d), 1.0, "class", SEED, KEYS)
    sel = EV.evolved_feature_selection(bal, TOP_K_SELECT, FEATS, "class", weight_mode="const", keep=KEYS)
    chosen = [c for c in sel.columns if c in FEATS]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                for c in chosen]))
    # long form (key, column, value): the chosen column set is data-dependent
    return sel.select(*KEYS, "class", cells.alias("kv")).select(*KEYS, "class", "kv.column", "kv.value")


# --------------------------------------------------------------------------- feature transformers

def q_assemble_features(spark, d):
    ml = assemble_features(FX.ml_binary(spark, d), FEATS, "class", keep=KEYS)
    return ml.select(*KEYS, *_vec_cols(ml, "features", FEATS), "label")


def q_maxabs_scale(spark, d):
    b = FX.ml_binary(spark, d)
    scaled = FT.maxabs_scale_columns(_split_train_test(b)[0], b, FEATS)
    return scaled.select(*KEYS, *[(F.col(c) + F.lit(0.0)).alias(c) for c in FEATS], F.col("class").alias("label"))


def q_maxabs_scale_vectors(spark, d):
    ml = assemble_features(FX.ml_binary(spark, d), FEATS, "class", keep=KEYS)
    train, _ = _split_train_test(ml)
    _, scaled = FT.maxabs_scale(train, ml)
    return scaled.select(*KEYS, *_vec_cols(scaled, "scaledFeatures", FEATS), "label")


def q_chi2_statistic(spark, d):
    disc = FX.ml_discrete(spark, d)
    ml = assemble_features(disc, FX.ML_DISCRETE_FEATURE_COLS, "class")
    res = FT.chi2_test(ml)
    names = F.array(*[F.lit(c) for c in FX.ML_DISCRETE_FEATURE_COLS])
    return res.select(F.get(names, F.col("featureIndex")).alias("feature"),
                      F.round("statistic", 6).alias("statistic"),
                      F.col("degreesOfFreedom").cast("bigint").alias("dof"))


def q_pca_project(spark, d):
    emb = FX.emb_binary(spark, d)
    train, test = S.random_split(emb, [0.7, 0.3], SPLIT_SEED, ["vec_id"])
    ptr, pte = FT.pca_project(train, test, PCA_K)
    names = [f"pc{i}" for i in range(PCA_K)]
    out = lambda x, part: x.select("vec_id", *_vec_cols(x, "features", names), "label",
                                   F.lit(part).alias("part"))
    return out(ptr, "train").unionByName(out(pte, "test"))


PCA_PAIR = ["l_discount", "l_tax"]


def _unsigned(x: DataFrame, part: str) -> DataFrame:
    """Projections on two components without their free signs."""
    cols = _vec_cols(x, "features", ["pc0", "pc1"])
    return x.select(*KEYS, *cols, "label").select(*KEYS, *[F.round(F.abs(c), 6).alias(c) for c in ("pc0", "pc1")], "label", F.lit(part).alias("part"))


def q_pca_project_pair(spark, d):
    ml = assemble_features(FX.ml_binary(spark, d), PCA_PAIR, "class", keep=KEYS)
    train, test = FT.pca_project(*_split_train_test(ml), 2)
    return _unsigned(train, "train").unionByName(_unsigned(test, "test"))


# --------------------------------------------------------------------------- classifiers

def _ml_split(spark, d, shift: float | None = None):
    b = FX.ml_binary(spark, d)
    if shift is not None:
        b = C.shift_features(b, shift, FEATS)
    ml = assemble_features(b, FEATS, "class", keep=KEYS)
    return _split_train_test(ml)


def _predictions(pred: DataFrame) -> DataFrame:
    return pred.select(*KEYS, "label", F.col("prediction").cast("double").alias("prediction"))


def _scored(pred: DataFrame, gate: float, reached: DataFrame | None = None) -> DataFrame:
    """Key, label, whether the row got one of the two classes, and whether the fit holds: its score is at the gate and what it
    reached on train is better than the class shares alone, with a small gradient. A constant or untrained model fails in every row."""
    passed = A.evaluate(pred)[2] >= gate and (reached is None or _holds(reached.first()))
    return pred.select(*KEYS, "label", F.coalesce(F.col("prediction").isin(0.0, 1.0), F.lit(False)).alias("scored"), F.lit(bool(passed)).alias("passed"))


def _holds(reached) -> bool:
    return reached["loss"] < reached["prior_loss"] and reached["gradient"] <= GRADIENT_BOUND


def q_nb_classify(spark, d):
    train, test = _ml_split(spark, d, shift=SHIFT)
    return _predictions(MD.fit_predict(MD.nb_classifier(), train, test))


def q_gbt_classify(spark, d):
    train, test = _ml_split(spark, d)
    return _scored(MD.fit_predict(MD.gbt_classifier(GBT_PARAMS), train, test), SCORE_GATES["gbt"])


def q_rf_classify(spark, d):
    train, test = _ml_split(spark, d)
    return _scored(MD.fit_predict(MD.rf_classifier(RF_PARAMS), train, test), SCORE_GATES["rf"])


def q_mlp_classify(spark, d):
    train, test = MD.scaled_split(*_ml_split(spark, d))
    model = MD.fit(MD.mlp_classifier(MLP_PARAMS), train)
    return _scored(model.transform(test), SCORE_GATES["mlp"], CT.mlp_certificate(train, model, MLP_PARAMS["layers"]))


def q_fm_classify(spark, d):
    train, test = MD.scaled_split(*_ml_split(spark, d))
    model = MD.fit(MD.fm_classifier(FM_PARAMS), train)
    return _scored(model.transform(test), SCORE_GATES["fm"], CT.fm_certificate(train, model))


def q_weighted_gbt_classify(spark, d):
    train, test = _ml_split(spark, d)
    ptr, pte = FT.pca_project(train, test, PCA_K)
    counts = A.count_by_value(ptr, "label", [0.0, 1.0])
    spw = counts[0.0] / counts[1.0] if counts[1.0] else 1.0
    est = MD.weighted_gbt_classifier({"num_round": GBT_PARAMS["maxIter"], "depth": GBT_PARAMS["depth"],
                                      "seed": GBT_PARAMS["seed"]})
    return _scored(MD.fit_predict(est, MD.positive_class_weight(ptr, spw), pte), SCORE_GATES["weighted_gbt"])


# --------------------------------------------------------------------------- composites

def _held_against(source: DataFrame, out: DataFrame, rule, share) -> DataFrame:
    """Every row of ``source`` with its times in ``out``, a rule about it, and whether the share of rows that are in ``out`` is as
    ``share`` says; rows of ``out`` that aren't in ``source`` would come on top. ``out`` has keys, label and ``ok``."""
    times = out.groupBy(*KEYS, "label").agg(F.count("*").alias("n"), F.every("ok").alias("ok"))
    both = source.select(*KEYS, "label").join(times, [*KEYS, "label"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
    both = materialize(both, "held-against")
    found = both.agg(F.avg((F.col("n") > 0).cast("double"))).first()[0] or 0.0
    return both.select(*KEYS, "label", (F.col("n") <= 1).alias("once"), rule(F.col("n"), F.coalesce("ok", F.lit(True))).alias("ok"), F.lit(bool(share(found))).alias("share"))


def q_noise_filter(spark, d):
    ml = assemble_features(FX.ml_binary(spark, d), FEATS, "class", keep=KEYS)
    out = X.noise_filter(ml, keys=KEYS, keep=KEYS, materialize=True)
    # every minority row stays, no row comes twice, none is added, and some majority row goes
    return _held_against(ml, out.withColumn("ok", F.lit(True)), lambda n, ok: ok & ((F.col("label") == 0.0) | (n == 1)), lambda x: 0.5 <= x < 1.0)


def _cascade_rules(test: DataFrame, out: DataFrame) -> DataFrame:
    # arrays are compared whole: 60 comparisons, one by one, make code that is too long to be compiled
    labels = F.array_repeat(F.col("label"), X.CASCADE_ROUNDS)
    agree = (F.array(*[F.col(f"label{i}") for i in range(X.CASCADE_ROUNDS)]) == labels) & (F.slice("features", 1, X.CASCADE_ROUNDS) == labels)
    # a subset of the test band whose rounds all agree with the label, and most of it
    return _held_against(test, out.withColumn("ok", agree), lambda n, ok: ok, lambda x: x >= 0.5)


def q_confidence_cascade(spark, d):
    ml = assemble_features(FX.ml_binary(spark, d), FEATS, "class", keep=KEYS)
    out = X.confidence_cascade(ml, keys=KEYS, keep=KEYS, model_seed=1234)
    return _cascade_rules(S.random_split(ml, X.CASCADE_SPLIT, S.SPLIT_SEED_FOLDS, KEYS)[1], out)


def q_synthetic_bernoulli(spark, d):
    emb = FX.emb_binary(spark, d)
    return X.synthetic_bernoulli(emb, seed=WEIGHT_SEED, keys=["vec_id"], assemble=False, keep=["vec_id"])


# Fits that SQL can grow exactly (no bags, all features, a bin for every value of ml_binned).
GROWN_BINS = 64
GROWN_DEPTH = 3
GROWN_FOREST = {"nTrees": 3, "maxDepth": GROWN_DEPTH, "strategy": "all", "bootstrap": False, "maxBins": GROWN_BINS, "seed": 5}
GROWN_STEP = 0.4
GROWN_BOOSTS = tuple({"maxIter": i, "depth": 2, "stepSize": GROWN_STEP, "maxBins": GROWN_BINS} for i in (1, 2))
GROWN_ROUNDS = 4


def _binned_ml(spark, d) -> DataFrame:
    return assemble_features(FX.ml_binned(spark, d), FX.ML_BINNED_FEATURES, "class", keep=KEYS)


def _probabilities(pred: DataFrame) -> DataFrame:
    """Key, label, prediction and the probability of class 1 of every scored row."""
    one = F.get(vector_to_array(F.col("probability")), F.lit(1))
    return pred.select(*KEYS, "label", F.col("prediction").cast("double").alias("prediction"), F.round(one, 9).alias("probability"))


def q_forest_nodes(spark, d):
    """Every node of a forest without bags: where it splits, how many rows reach it and what it predicts."""
    train, _ = _split_train_test(_binned_ml(spark, d))
    nodes = TT.numbered(TT.tree_nodes(MD.fit(MD.rf_classifier(GROWN_FOREST), train)))
    return nodes.select("tree", "node", "feature", "threshold", F.col("n").cast("double").alias("n"), "prediction")


def q_forest_grown(spark, d):
    train, test = _split_train_test(_binned_ml(spark, d))
    return _probabilities(MD.fit_predict(MD.rf_classifier(GROWN_FOREST), train, test))


def q_boosting_grown(spark, d):
    train, test = _split_train_test(_binned_ml(spark, d))
    return _probabilities(MD.fit_predict(MD.gbt_classifier(GROWN_BOOSTS[-1]), train, test))


def q_noise_filter_grown(spark, d):
    return X.noise_filter(_binned_ml(spark, d), keys=KEYS, keep=KEYS, estimator=MD.rf_classifier(GROWN_FOREST), materialize=True).select(*KEYS, "label")


def _cascade_rows(out: DataFrame) -> DataFrame:
    return out.select(*KEYS, "label", *[f"label{i}" for i in range(GROWN_ROUNDS)], F.size("features").alias("n_features"))


def q_cascade_grown(spark, d):
    return _cascade_rows(X.confidence_cascade(_binned_ml(spark, d), rounds=GROWN_ROUNDS, configs=GROWN_BOOSTS, keys=KEYS, keep=KEYS))


def _binned_tables(spark, d) -> dict:
    paths = [_scratch(spark, f"binned-{name}") for name in ("train", "test")]
    for part, path in zip(_split_train_test(FX.ml_binned(spark, d)), paths, strict=True):
        sink_parquet(part, path)
    return {"dataset": paths[0], "test": paths[1], "keys": KEYS}


def q_job_rf_grown(spark, d):
    return J.rf_job(spark, dict(_binned_tables(spark, d), params=GROWN_FOREST))


def q_job_gbt_grown(spark, d):
    return J.gbt_job(spark, dict(_binned_tables(spark, d), params=GROWN_BOOSTS[-1]))


def q_job_cascade_grown(spark, d):
    src = _scratch(spark, "cascade-in")
    sink_parquet(_binned_ml(spark, d), src)
    return _cascade_rows(J.cascade_job(spark, {"datasetTrain": src, "output": _scratch(spark, "cascade-out"), "keys": KEYS,
                                               "params": {"configs": GROWN_BOOSTS, "rounds": GROWN_ROUNDS}}))


N_PREPARED = len(FEATS) // 2


def _prepared(tr: DataFrame, te: DataFrame) -> DataFrame:
    names = [f"f{i}" for i in range(N_PREPARED)]
    out = lambda x, part: x.select(*KEYS, *_vec_cols(x, "features", names), "label", F.lit(part).alias("part"))
    return out(tr, "train").unionByName(out(te, "test"))


def q_prepare_chain(spark, d):
    train, test = _ml_split(spark, d)
    return _prepared(*X.prepare_chain(train, test, OVERSAMPLE_RATIO, "percentile", 0.5, keys=KEYS, keep=KEYS))


# --------------------------------------------------------------------------- dormant variants

def q_median_band_filter(spark, d):
    b = FX.ml_binary(spark, d)
    return X.median_band_filter(b, C.row_sum(FEATS)).select(*KEYS, "class", C.row_sum(FEATS).alias("sumTotal"))


def q_instance_filter(spark, d):
    b = FX.ml_binary(spark, d)
    maxima = EV.class_row_maxima(b, FEATS, "class")
    w = EV.evolved_weights(b, FEATS, maxima, "class", weight_mode="const")
    return EV.instance_filter(b, w).select(*KEYS, "class")


def q_label_remap(spark, d):
    return C.label_remap(FX.ml_binary(spark, d), "class").select(*KEYS, "class")


def q_string_index(spark, d):
    li = FX.table(spark, d, "lineitem").select(*KEYS, "l_returnflag")
    return FT.string_index(li, "l_returnflag", "flag_idx")


def q_confusion_counts(spark, d):
    return A.confusion_counts(FX.formula_predictions(spark, d), positive=1.0)


def q_limit_rows(spark, d):
    return C.limit_rows(FX.ml_binary(spark, d), LIMIT_ROWS, KEYS)


def _chi2_selection(spark, d, **how) -> DataFrame:
    """Every feature with its test on 33 bins of equal width of the scaled values, and whether it is kept."""
    ml = assemble_features(FX.ml_binary(spark, d), FEATS, "class")
    scaled = ml.select(FT.scaled_array("features", FT.inverse_maxima(ml)).alias("x"), "label")
    tests = FT.chi2_binned(scaled, "x")
    kept = FT.chosen_features(tests, **how)
    rows = [(FEATS[i], round(statistic, 4), dof, i in kept) for i, statistic, dof, _ in tests]
    return spark.createDataFrame(rows, "feature string, statistic double, dof long, kept boolean")


def q_chi2_fdr_select(spark, d):
    return _chi2_selection(spark, d, selector_type="fdr", fdr=FDR)


def q_chi2_percentile_select(spark, d):
    return _chi2_selection(spark, d, selector_type="percentile", percentile=0.5)


def q_chi2_top_select(spark, d):
    return _chi2_selection(spark, d, selector_type="numTopFeatures", num_top_features=3)


def q_sample_with_replacement(spark, d):
    return S.sample_fraction(FX.ml_binary(spark, d), 1.5, SEED, with_replacement=True, keys=KEYS)


# Fractions whose copies are counted (one draw, one draw, and 250 of them).
POISSON_FRACTIONS = (0.25, 6.0, 2000.0)


def q_poisson_counts(spark, d):
    """Copies of each order at a small, a middle and a large fraction."""
    o = FX.table(spark, d, "orders").select("o_orderkey")
    return o.select("*", *[S.copies_of(o, f, SEED, ["o_orderkey"])[0].cast("long").alias(f"n{i}") for i, f in enumerate(POISSON_FRACTIONS)])


def q_schema_table(spark, d):
    return schema_table(FX.ml_binary(spark, d), counts=True)


def q_preview_rows(spark, d):
    return preview(FX.ml_binary(spark, d), 20, order_by=KEYS)


# --------------------------------------------------------------------------- jobs (J1-J12)

JOB_PCA_PARAMS = {"k": PCA_K, "scale_pos_weight": 4.0, "num_round": GBT_PARAMS["maxIter"],
                  "depth": GBT_PARAMS["depth"], "seed": GBT_PARAMS["seed"]}
SYNTHETIC_JOB_SEED = 0


def _job_tables(spark, d) -> dict:
    """``ml_binary`` split 70/30 by hash, written as train/test parquet in the shared folder."""
    train, test = _split_train_test(FX.ml_binary(spark, d))
    tp, sp = _scratch(spark, "job-train"), _scratch(spark, "job-test")
    sink_parquet(train, tp)
    sink_parquet(test, sp)
    return {"dataset": tp, "test": sp, "keys": KEYS}


def _job_full_table(spark, d) -> str:
    path = _scratch(spark, "job-dataset")
    sink_parquet(FX.ml_binary(spark, d), path)
    return path


def _score_rules(scores: DataFrame, gate: float, *more: str, certified: bool = False) -> DataFrame:
    """Test rows of each class, and whether the score reaches the gate (and the fit its certificate)."""
    passed = (F.col("score") >= F.lit(gate)) & (F.col("score") <= 1.0)
    if certified:
        passed = passed & (F.col("loss") < F.col("prior_loss")) & (F.col("gradient") <= F.lit(GRADIENT_BOUND))
    return scores.select((F.col("tp") + F.col("fn")).alias("n_positive"), (F.col("tn") + F.col("fp")).alias("n_negative"), passed.alias("passed"), *more)


def q_job_gbt_score(spark, d):
    return _score_rules(J.gbt_job(spark, dict(_job_tables(spark, d), params=GBT_PARAMS)), SCORE_GATES["gbt"])


def q_job_gbt_prepared_score(spark, d):
    params = GBT_PARAMS | {"prepare": True, "ratio": OVERSAMPLE_RATIO, "percentil": 0.5}
    return _score_rules(J.gbt_job(spark, dict(_job_tables(spark, d), params=params)), SCORE_GATES["weighted_gbt"])


def q_job_gbt_pca_score(spark, d):
    return _score_rules(J.gbt_job(spark, dict(_job_tables(spark, d), params=GBT_PARAMS | {"k": PCA_K})), SCORE_GATES["weighted_gbt"])


def q_job_rf_score(spark, d):
    return _score_rules(J.rf_job(spark, dict(_job_tables(spark, d), params=RF_PARAMS)), SCORE_GATES["rf"])


def q_job_mlp_score(spark, d):
    return _score_rules(J.mlp_job(spark, dict(_job_tables(spark, d), params=MLP_PARAMS)), SCORE_GATES["mlp"], "n_train", "n_test", certified=True)


def q_job_fm_score(spark, d):
    return _score_rules(J.fm_job(spark, dict(_job_tables(spark, d), params=FM_PARAMS)), SCORE_GATES["fm"], "n_train", certified=True)


def q_job_cascade(spark, d):
    ml = assemble_features(FX.ml_binary(spark, d), FEATS, "class", keep=KEYS)
    src = _scratch(spark, "cascade-in")
    sink_parquet(ml, src)
    out = J.cascade_job(spark, {"datasetTrain": src, "output": _scratch(spark, "cascade-out"), "keys": KEYS, "params": {"seed": 1234}})
    return _cascade_rules(S.random_split(ml, X.CASCADE_SPLIT, S.SPLIT_SEED_FOLDS, KEYS)[1], out)


CSV_KEYS = [k for k in KEYS if k != "l_shipdate"]


def q_job_csv_mlp(spark, d):
    path = _scratch(spark, "csv-mlp")
    rows = FX.ml_binary(spark, d).drop("l_shipdate").withColumn("layers", F.lit("4-8-2")).withColumnRenamed("class", "media")
    sink_delimited(rows, path, sep="|")
    out = J.csv_mlp_job(spark, {"dataset": path, "params": MLP_PARAMS, "keys": CSV_KEYS, "schema": ", ".join(f"{c} {t}" for c, t in rows.dtypes)})
    passed = A.evaluate(out)[2] >= SCORE_GATES["mlp"]
    return out.select(*CSV_KEYS, "label", F.coalesce(F.col("prediction").isin(0.0, 1.0), F.lit(False)).alias("scored"), F.lit(passed).alias("passed"))


def q_job_nb_accuracy(spark, d):
    return J.nb_job(spark, {"dataset": _job_full_table(spark, d), "keys": KEYS})


def q_job_pca_weighted_gbt_score(spark, d):
    return _score_rules(J.pca_weighted_gbt_job(spark, dict(_job_tables(spark, d), params=JOB_PCA_PARAMS)), SCORE_GATES["weighted_gbt"],
                        "n_train_0", "n_train_1")


def _pca_preview(spark, d, feats: list[str], k: int):
    rows = FX.ml_binary(spark, d).select(*KEYS, *feats, "class")
    paths = {}
    for name, part in zip(("dataset", "test"), _split_train_test(rows)):
        paths[name] = _scratch(spark, f"pca-{name}")
        sink_parquet(part, paths[name])
    return J.pca_preview_job(spark, dict(paths, keys=KEYS, params={"k": k}))


def q_job_pca_preview(spark, d):
    """The job on all features: the first rows' projections on three components. The price's variance is a million times the
    next one, so only the first component's values (without their sign) are the same in every engine."""
    def out(x, part):
        first = F.abs(F.get(vector_to_array("features"), F.lit(0)))
        return x.select(*KEYS, sig_round(first, 6).alias("pc0"), F.size(vector_to_array("features")).alias("n_components"), "label", F.lit(part).alias("part"))
    train, test = _pca_preview(spark, d, FEATS, PCA_K)
    return out(train, "train").unionByName(out(test, "test"))


def q_job_pca_preview_pair(spark, d):
    train, test = _pca_preview(spark, d, PCA_PAIR, 2)
    return _unsigned(train, "train").unionByName(_unsigned(test, "test"))


def q_job_feature_preparation(spark, d):
    cfg = dict(_job_tables(spark, d), trainOut=_scratch(spark, "prep-train"), testOut=_scratch(spark, "prep-test"),
               params={"percentil": 0.5})
    return _prepared(*J.feature_preparation_job(spark, cfg))


def q_job_evolved_selection(spark, d):
    cfg = {"dataset": _job_full_table(spark, d), "output": _scratch(spark, "evolved"), "keys": KEYS,
           "params": {"k": TOP_K_SELECT, "weight_mode": "const"}}
    sel = J.evolved_selection_job(spark, cfg)
    chosen = [c for c in sel.columns if c in FEATS]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                for c in chosen]))
    return sel.select(*KEYS, "class", cells.alias("kv")).select(*KEYS, "class", "kv.column", "kv.value")


def q_job_synthetic(spark, d):
    ml = assemble_features(FX.ml_binary(spark, d), FEATS, "class", keep=KEYS)
    src = _scratch(spark, "synthetic-in")
    sink_parquet(ml, src)
    out = J.synthetic_job(spark, {"dataset": src, "output": _scratch(spark, "synthetic-out"), "keys": KEYS,
                                  "params": {"seed": SYNTHETIC_JOB_SEED}})
    names = [f"label{i}" for i in range(X.SYNTHETIC_COLUMNS)]
    # the vector becomes an array once a row
    arrays = out.select(*KEYS, vector_to_array("features").alias("x"), "label")
    return arrays.select(*KEYS, *[(F.get("x", F.lit(i)) + F.lit(0.0)).alias(name) for i, name in enumerate(names)], "label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
