import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tiltml.operators import aggregates as A
from tiltml.operators import features as FT
from tiltml.operators import models as MD
from tiltml.operators import sampling as S
from tiltml.sources import fixtures as FX
from tiltml.sources.readers import assemble_features

KEYS = FX.LINEITEM_KEYS


@pytest.fixture(scope="module")
def split(spark):
    ml = assemble_features(FX.ml_binary(spark, "/root/testdata/sf0.001"), FX.ML_BINARY_FEATURES, "class", keep=KEYS)
    tr, te = S.random_split(ml, [0.7, 0.3], 1234, KEYS)
    return tr.cache(), te.cache()


def test_maxabs_fit_on_train_only(spark):
    tr = spark.createDataFrame([(Vectors.dense([2.0, 0.0]), 0.0)], ["features", "label"])
    te = spark.createDataFrame([(Vectors.dense([4.0, 1.0]), 0.0)], ["features", "label"])
    _, a = FT.maxabs_scale(tr, te)
    _, b = FT.maxabs_scale(tr, te, refit_on_test=True)
    assert list(a.first().scaledFeatures) == [2.0, 1.0]   # all-zero train column keeps scale 1
    assert list(b.first().scaledFeatures) == [1.0, 1.0]


def test_chi2_selector_type_is_explicit(spark):
    sel = FT.chi2_selector(percentile=0.5)
    assert sel.getSelectorType() == "percentile"


def test_chi2_high_cardinality_needs_binning(spark):
    hc = FX.ml_highcard(spark, "/root/testdata/sf0.01").withColumnRenamed("class", "label")
    idx = FT.select_by_chi2(hc, ["l_extendedprice"], "label", "numTopFeatures", num_top_features=1)
    assert idx == [0]


def test_pca_projection_not_centred(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 1.0]), 0.0), (Vectors.dense([3.0, 3.0]), 1.0)],
                               ["features", "label"])
    tr, _ = FT.pca_project(df, None, 1)
    vals = sorted(abs(r.features[0]) for r in tr.collect())
    assert vals[0] == pytest.approx(2 ** 0.5) and vals[1] == pytest.approx(3 * 2 ** 0.5)


def test_rf_defaults_are_trainable():
    est = MD.rf_classifier({})
    assert est.getNumTrees() == 20 and est.getMaxDepth() == 5


def test_fm_job_trains_a_factorization_machine():
    assert type(MD.fm_classifier({"maxiter": 3})).__name__ == "FMClassifier"


@pytest.mark.parametrize("make", [
    lambda: MD.rf_classifier({"nTrees": 10, "maxDepth": 4, "seed": 1}),
    lambda: MD.gbt_classifier({"maxIter": 5, "depth": 3, "stepsize": 0.4}),
    lambda: MD.mlp_classifier({"layers": [4, 5, 2], "iter": 50, "seed": 1, "blockSize": 64, "stepsize": 0.03}),
])
def test_classifiers_produce_predictions(split, make):
    tr, te = split
    pred = MD.fit_predict(make(), tr, te)
    assert pred.count() == te.count()
    assert {"rawPrediction", "probability", "prediction"} <= set(pred.columns)


def test_tree_models_beat_constant_predictor(split):
    tr, te = split
    pred = MD.fit_predict(MD.rf_classifier({"nTrees": 10, "maxDepth": 4, "seed": 1}), tr, te)
    assert A.evaluate(pred)[2] > 0.5


def test_naive_bayes_needs_shift_and_weighted_gbt(spark, split):
    tr, te = split
    pred = MD.fit_predict(MD.nb_classifier(), tr, te)
    assert pred.count() == te.count()
    w = MD.positive_class_weight(tr, 4.0)
    assert w.filter("label = 1").select(F.min("w")).first()[0] == 4.0
    pred = MD.fit_predict(MD.weighted_gbt_classifier({"num_round": 3, "depth": 3}), w, te)
    assert pred.count() == te.count()


def _predictions(est, train, test):
    return sorted(map(tuple, MD.fit_predict(est, train, test).select(*KEYS, "prediction").collect()))


@pytest.mark.parametrize("make", [
    lambda: MD.rf_classifier({"nTrees": 10, "maxDepth": 4, "seed": 1}),
    lambda: MD.mlp_classifier({"layers": [4, 5, 2], "iter": 30, "seed": 1, "blockSize": 64, "stepsize": 0.03}),
])
def test_fits_do_not_depend_on_the_input_partitions(split, make):
    tr, te = split
    base = _predictions(make(), tr.repartition(2), te)
    assert _predictions(make(), tr.repartition(7, "l_orderkey"), te.repartition(3)) == base


def test_nothing_runs_before_the_fit(spark, split):
    tr, _ = split
    grouped = tr.groupBy("features", "label").count()
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    for est in (MD.gbt_classifier({"maxIter": 2}), MD.nb_classifier()):
        MD.training_rows(est, grouped)
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() == before


def test_training_rows_hold_needed_columns_only(split):
    weighted = MD.positive_class_weight(split[0], 2.0)
    assert MD.training_rows(MD.nb_classifier(), split[0]).columns == ["features", "label"]
    assert MD.training_rows(MD.weighted_gbt_classifier({}), weighted, 3).columns == ["features", "label", "w"]


def test_equal_rows_are_dealt_over_the_partitions(spark):
    """20,000 rows of two kinds without keys: no partition gets more than a fair share and some runs."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0).alias("label")).select(F.array("label").alias("f"), "label")
    from pyspark.ml.functions import array_to_vector
    rows = df.select(array_to_vector("f").alias("features"), "label")
    dealt = MD.training_rows(MD.rf_classifier({}), rows, 8)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 8 and max(sizes) <= 2 * 20_000 / 8
    again = MD.training_rows(MD.rf_classifier({}), rows.repartition(3, "label"), 8)
    place = lambda x: sorted(tuple(r) for r in x.groupBy(F.spark_partition_id().alias("p"), "label").count().collect())
    assert place(again) == place(dealt)
    assert dealt.groupBy("label").count().select("count").distinct().collect()[0][0] == 10_000


def test_held_rows_are_released_after_a_fit(spark, split):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    MD.fit(MD.gbt_classifier({"maxIter": 2, "depth": 2}), split[0])
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


@pytest.mark.parametrize("make,least", [(lambda: MD.gbt_classifier({"maxIter": 4, "depth": 3, "stepsize": 0.4, "seed": 3}), 4),
                                        (lambda: MD.rf_classifier({"nTrees": 3, "maxDepth": 3, "seed": 3}), 3)])
def test_tables_of_trees_score_like_the_model(split, make, least):
    from pyspark.ml.functions import vector_to_array

    from tiltml.operators import tree_tables as TT
    model = MD.fit(make(), split[0])
    nodes = TT.tree_nodes(model).cache()
    assert nodes.select("tree").distinct().count() == least
    root = TT.numbered(nodes).filter("node = 1")
    assert root.count() == least and root.filter("id != 0").count() == 0
    if "GBT" in type(model).__name__:
        got = model.transform(split[1]).withColumn("m", F.get(TT.staged_margins(model, [least]), 0))
        assert got.filter(F.abs(F.col("m") - F.get(vector_to_array("rawPrediction"), 1)) > 1e-12).count() == 0


def test_string_index_of_many_values(spark):
    df = spark.range(5000).select((F.col("id") % 1700).cast("string").alias("v"), "id")
    counts = {}
    for r in df.collect():
        counts[r.v] = counts.get(r.v, 0) + 1
    want = {v: float(i) for i, (v, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
    assert {r.v: r.v_idx for r in FT.string_index(df, "v").collect()} == want
    nulls = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "v string")
    assert sorted(r.v_idx for r in FT.string_index(nulls, "v", handle_invalid="keep").collect()) == [0.0, 0.0, 1.0, 2.0]
    assert FT.string_index(nulls, "v", handle_invalid="skip").count() == 3
    with pytest.raises(Exception, match="NULL in v"):
        FT.string_index(nulls, "v").collect()


@pytest.mark.parametrize("kind,want", [("percentile", [0, 2]), ("numTopFeatures", [0, 2, 3]), ("fpr", [0, 2]), ("fdr", [0, 2]), ("fwe", [0])])
def test_selector_types(kind, want):
    tests = [(0, 90.0, 4, 1e-9), (1, 0.1, 4, 0.9), (2, 11.0, 4, 0.015), (3, 3.0, 4, 0.5)]
    assert FT.chosen_features(tests, kind, percentile=0.5, num_top_features=3) == want


def test_binned_test_equals_spark_on_repeated_rows(spark):
    rows = [([float(i % 5) / 5.0, float(i % 3 - 1)], float(i % 2), 1 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "x array<double>, label double, n int")
    got = FT.chi2_binned(df, "x", "label", "n")
    repeated = df.select(F.explode(F.array_repeat(F.struct("x", "label"), F.col("n"))).alias("r")).select("r.*")
    bins = repeated.select(FT.F.transform("x", lambda v: F.least(F.floor((v + 1) / 2 * FT.CHI2_BUCKETS), F.lit(32)).cast("double")).alias("b"), "label")
    from pyspark.ml.functions import array_to_vector
    want = FT.chi2_test(bins.select(array_to_vector("b").alias("features"), "label")).orderBy("featureIndex").collect()
    for (i, statistic, dof, p), r in zip(got, want, strict=True):
        assert (i, dof) == (r.featureIndex, r.degreesOfFreedom)
        assert statistic == pytest.approx(r.statistic) and p == pytest.approx(r.pValue)


def test_wide_tables_are_counted_without_repeating_rows(spark):
    """2,000 columns: counts by numpy, statistics and p-values by Spark's own test on a few of them."""
    import numpy as np
    from pyspark.mllib.linalg import DenseMatrix
    from pyspark.mllib.stat import Statistics
    d = 2000
    rows = spark.range(400).select((F.col("id") % 3).cast("double").alias("label"), F.transform(F.sequence(F.lit(1), F.lit(d)), lambda j: F.sin(F.col("id") * j * j)).alias("x"))
    got = FT.chi2_binned(rows, "x")
    assert [t[0] for t in got] == list(range(d))
    local = rows.collect()
    x, y = np.array([r.x for r in local]), np.array([r.label for r in local])
    bins = np.minimum(np.floor((x + 1) / 2 * FT.CHI2_BUCKETS), FT.CHI2_BUCKETS - 1).astype(int)
    for j in (0, 1, 255, 256, 1023, 1999):
        table = np.array([[np.sum((bins[:, j] == b) & (y == label)) for label in range(3)] for b in np.unique(bins[:, j])], float)
        want = Statistics.chiSqTest(DenseMatrix(*table.shape, table.ravel(order="F").tolist()))
        assert got[j][1] == pytest.approx(want.statistic) and got[j][2] == want.degreesOfFreedom and got[j][3] == pytest.approx(want.pValue, abs=1e-12)


def test_chi_square_tail():
    import math

    import numpy as np
    for dof in (2, 4, 32, 64, 1000):  # closed form for even degrees
        x = np.array([0.0, 0.1, 1.0, dof * 0.5, dof * 1.0, dof * 1.5, dof * 3.0])
        want = [math.fsum(math.exp(-v / 2 + j * math.log(v / 2) - math.lgamma(j + 1)) for j in range(dof // 2)) if v else 1.0 for v in x.tolist()]
        assert FT.chi2_tail(x, np.full(len(x), dof)) == pytest.approx(want, rel=1e-9, abs=1e-14)
    assert FT.chi2_tail(np.array([1.0, 4.0]), np.array([1, 1])) == pytest.approx([math.erfc(math.sqrt(0.5)), math.erfc(math.sqrt(2.0))], rel=1e-12)


def test_weighted_fit_equals_the_fit_of_repeated_rows(spark):
    rows = [([float(i % 7), float(i % 11), float(i * i % 13)], float((i % 7) * (i % 11) > 18), float(1 + i % 3)) for i in range(300)]
    from pyspark.ml.functions import array_to_vector, vector_to_array
    df = spark.createDataFrame(rows, "f array<double>, label double, w double").select(array_to_vector("f").alias("features"), "label", "w")
    repeated = df.select("features", "label", F.explode(F.array_repeat(F.lit(1), F.col("w").cast("int")))).drop("col")
    params = {"maxIter": 4, "depth": 3, "seed": 2}
    a = MD.fit(MD.gbt_classifier(params, weight_col="w"), df).transform(df)
    b = MD.fit(MD.gbt_classifier(params), repeated).transform(df)
    raw = lambda x: sorted(tuple(round(v, 9) for v in (*r.f, r.m)) for r in x.select(vector_to_array("features").alias("f"), F.get(vector_to_array("rawPrediction"), 1).alias("m")).collect())
    assert raw(a) == raw(b)


def test_preparation_with_weights_repeats_no_row(split):
    from tiltml.operators import cleaning as X
    tr, te = split
    weighted, _ = X.prepare_chain(tr, te, 1.5, "percentile", 0.5, keys=KEYS, keep=KEYS, weight_col="w")
    repeated, _ = X.prepare_chain(tr, te, 1.5, "percentile", 0.5, keys=KEYS, keep=KEYS)
    assert weighted.select(*KEYS).distinct().count() == weighted.count()
    n = lambda x, v: sorted(map(tuple, x.groupBy(*KEYS).agg(v.alias("n")).collect()))
    assert n(weighted, F.sum("w").cast("long")) == n(repeated, F.count("*"))


def test_tree_fits_read_a_row_a_cell(spark):
    """200,000 rows, all their prices different: the fit reads as many weighted rows as there are pairs of bins and labels, no row is
    lost, and the model scores the rows as they are."""
    from pyspark.ml.functions import array_to_vector
    rows = spark.range(200_000).select("id", array_to_vector(F.array(F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1000.0, (F.col("id") % 7).cast("double"))).alias("features"),
                                       F.when(F.pmod(F.xxhash64("id"), F.lit(10**9)) < 3 * 10**8, 1.0).otherwise(0.0).alias("label"))
    est = MD.gbt_classifier({"maxIter": 2, "depth": 3})
    with MD.tree_cells(est, rows) as cells:
        assert cells.count() <= 32 * 7 * 2
        assert cells.agg(F.sum(MD.CELL_WEIGHT)).first()[0] == 200_000
        first = sorted((list(r.features), r.label, r[MD.CELL_WEIGHT]) for r in cells.collect())
    with MD.tree_cells(est, rows.repartition(5)) as cells:
        assert sorted((list(r.features), r.label, r[MD.CELL_WEIGHT]) for r in cells.collect()) == first
    assert A.evaluate(MD.fit(est, rows).transform(rows))[2] > 0.9
    copies = rows.select("features", "label").where("id < 3").union(rows.select("features", "label").where("id < 3"))
    with MD.tree_cells(est, copies) as cells:
        assert sorted(r[MD.CELL_WEIGHT] for r in cells.collect()) == [2.0, 2.0, 2.0]


def test_bags_draw_rows_one_by_one_or_runs_of_equal_ones(spark, split, monkeypatch):
    est = MD.rf_classifier({"nTrees": 3, "maxDepth": 3, "seed": 3})
    n = split[0].count()
    with MD.tree_cells(est, split[0]) as cells:
        assert cells.count() == n and cells.select(MD.CELL_WEIGHT).distinct().collect()[0][0] == 1.0
    monkeypatch.setattr(MD, "BAG_ROWS", n // 4)
    binned = split[0].select(*KEYS, "label", F.lit(1.0).alias("x")).where("l_linenumber is not null")
    from pyspark.ml.functions import array_to_vector
    same = binned.select(*KEYS, array_to_vector(F.array("x")).alias("features"), "label")
    with MD.tree_cells(est, same) as cells:
        assert cells.count() <= n // 4 + 3 and cells.agg(F.sum(MD.CELL_WEIGHT)).first()[0] == n


def test_fits_refuse_rows_without_a_label(spark, split):
    bad = split[0].withColumn("label", F.when(F.col("l_linenumber") > 1, F.col("label")))
    with pytest.raises(Exception, match="label in every row"):
        MD.fit(MD.gbt_classifier({"maxIter": 1}), bad)
