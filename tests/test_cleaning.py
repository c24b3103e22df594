import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tiltml.operators import cleaning as X
from tiltml.sources import fixtures as FX
from tiltml.sources.readers import assemble_features

KEYS = FX.LINEITEM_KEYS


@pytest.fixture(scope="module")
def ml(spark):
    return assemble_features(FX.ml_binary(spark, "/root/testdata/sf0.001"), FX.ML_BINARY_FEATURES,
                             "class", keep=KEYS).cache()


def test_noise_filter_invariants(ml):
    out = X.noise_filter(ml, keys=KEYS, keep=KEYS, num_trees=5)
    ones_in = ml.filter("label = 1").count()
    assert out.filter("label = 1").count() == ones_in            # minority always kept
    assert out.join(ml.select(*KEYS), KEYS, "left_anti").count() == 0   # subset of input
    assert out.select(*KEYS).distinct().count() == out.count()   # each row once


def test_confidence_cascade_labels_equal_label(ml):
    cfg = ({"maxIter": 3, "depth": 3, "stepSize": 0.4}, {"maxIter": 4, "depth": 3, "stepSize": 0.4})
    out = X.confidence_cascade(ml, rounds=5, configs=cfg, keys=KEYS, keep=KEYS, model_seed=1)
    assert out.columns[:len(KEYS)] == KEYS
    for i in range(5):
        assert out.filter(F.col(f"label{i}") != F.col("label")).count() == 0
    r = out.first()
    assert r is None or list(r.features) == [r.label] * 5


def test_cascade_by_stages_equals_single_fits(ml):
    """Margins of the stages of the longest runs against separate fits of every configuration."""
    base = {"depth": 3, "stepSize": 0.4, "seed": 5}
    configs = [base | {"maxIter": 2}, base | {"maxIter": 5}, base | {"maxIter": 3, "depth": 2}, base | {"maxIter": 4}]
    from tiltml.operators.models import fit, gbt_classifier
    from tiltml.operators.tree_tables import staged_margins
    train = ml.filter("l_linenumber > 2")
    models, names = X.fit_longest(configs, train, "features", "label", 2)
    assert len(models) == 2
    for c, name in zip(configs, names, strict=True):
        single = fit(gbt_classifier(c), train).transform(ml)
        both = single.withColumn("margin", F.get(staged_margins(models[name], [c["maxIter"]]), 0))
        raw = F.get(__import__("pyspark.ml.functions", fromlist=["x"]).vector_to_array("rawPrediction"), 1)
        assert both.filter(F.abs(F.col("margin") - raw) > 1e-12).count() == 0
        assert both.filter((F.col("margin") > 0) != (F.col("prediction") == 1.0)).count() == 0


def _two_trees():
    """Two small trees as nodes: on features 0 and 2, with a threshold that both have."""
    import pandas as pd
    cols = ["tree", "id", "feature", "threshold", "left", "right", "prediction", "weight"]
    return pd.DataFrame([(0, 0, 0, 1.5, 1, 2, 0.0, 1.0), (0, 1, -1, None, -1, -1, -0.3, 1.0), (0, 2, 2, -4.0, 3, 4, 0.0, 1.0), (0, 3, -1, None, -1, -1, 0.1, 1.0),
                         (0, 4, -1, None, -1, -1, 0.7, 1.0), (1, 0, 2, 0.25, 1, 2, 0.0, 0.4), (1, 1, 0, 1.5, 3, 4, 0.0, 0.4), (1, 2, -1, None, -1, -1, 1.1, 0.4),
                         (1, 3, -1, None, -1, -1, 1e-9, 0.4), (1, 4, -1, None, -1, -1, -2.0, 0.4)], columns=cols)


@pytest.mark.parametrize("kept", [1 << 22, 8, 0])
def test_trees_are_walked_once_a_cell(monkeypatch, kept):
    """2 x 3 cells of any number of rows: bit for bit the margins of the walk over every row, values on and beside thresholds included."""
    import numpy as np

    from tiltml.operators import tree_tables as TT
    monkeypatch.setattr(TT, "KEPT_MARGINS", kept)
    table = TT.TreeTable(_two_trees())
    scorer = TT.CellScorer([(table, [1, 2]), (table, [2])])
    walked = []
    plain = TT.TreeTable.sums
    monkeypatch.setattr(TT.TreeTable, "sums", lambda self, x, stages: walked.append(len(x)) or plain(self, x, stages))
    edges = [1.5, np.nextafter(1.5, 2), np.nextafter(1.5, 1), -4.0, 0.25, np.nextafter(0.25, 1), 0.0, -0.0, np.nan, np.inf, -np.inf]
    x = np.array([(a, b, c) for a in edges for b in (0.0, np.nan) for c in edges])
    rng = np.random.default_rng(1)
    for rows in (x, x[rng.permutation(len(x))], rng.normal(size=(5000, 3)) * 3, x[:1]):
        want = np.hstack([plain(table, rows, [1, 2]), plain(table, rows, [2])])
        assert scorer.margins(rows).tobytes() == want.tobytes()
    assert max(walked) <= 6 and (kept < 18 or sum(walked) == 12)  # each cell once for either run


def test_rows_of_more_cells_than_numbers_are_walked(monkeypatch):
    import numpy as np
    import pandas as pd

    from tiltml.operators import tree_tables as TT
    stumps = [r for j in range(70) for r in ((j, 0, j, 0.0, 1, 2, 0.0, 1.0), (j, 1, -1, None, -1, -1, -1.0, 1.0), (j, 2, -1, None, -1, -1, j / 7, 1.0))]
    table = TT.TreeTable(pd.DataFrame(stumps, columns=_two_trees().columns))
    x = np.random.default_rng(2).normal(size=(300, 70))
    scorer = TT.CellScorer([(table, [3, 70])])
    assert not scorer.numbered and scorer.margins(x).tobytes() == table.sums(x, [3, 70]).tobytes()


def test_cascade_scores_each_row_once(ml):
    """The filter on the margins is above them: they aren't made once for it and once for the labels, and all models have one pass."""
    cfg = ({"maxIter": 2, "depth": 2, "stepSize": 0.4}, {"maxIter": 2, "depth": 3, "stepSize": 0.4}, {"maxIter": 3, "depth": 2, "stepSize": 0.4})
    out = X.confidence_cascade(ml, rounds=4, configs=cfg, keys=KEYS, keep=KEYS, model_seed=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("margins(") == 1


def test_scoring_needs_features_of_one_length(spark):
    from tiltml.operators import models as MD
    from tiltml.operators.tree_tables import staged_margins
    rows = spark.createDataFrame([(Vectors.dense([float(i % 5), float(i % 3)]), float(i % 2)) for i in range(30)], ["features", "label"])
    margin = staged_margins(MD.fit(MD.gbt_classifier({"maxIter": 2, "seed": 1}), rows), [1, 2])
    assert rows.select(F.size(margin).alias("n")).distinct().collect()[0].n == 2
    assert rows.limit(0).select(margin.alias("m")).collect() == []
    more = rows.limit(1).union(spark.createDataFrame([(Vectors.dense([1.0]), 0.0)], rows.schema)).coalesce(1)
    with pytest.raises(Exception, match="scoring needs features"):
        more.select(margin.alias("m")).collect()


def test_rules_see_one_wrong_round(ml):
    """A label of one round, or an element of the features, that isn't the row's label turns the row red."""
    from tiltml.plans import catalog as Q
    names = [f"label{i}" for i in range(X.CASCADE_ROUNDS)]
    right = ml.select(*KEYS, "label", *[F.col("label").alias(c) for c in names], F.array_repeat("label", X.CASCADE_ROUNDS).alias("features"))
    n = ml.count()
    for out, wrong in ((right, 0), (right.withColumn("label7", F.when(F.col("l_linenumber") == 1, 1 - F.col("label")).otherwise(F.col("label"))), 1),
                       (right.withColumn("features", F.transform("features", lambda x, i: F.when((i == 29) & (F.col("l_linenumber") == 1), 1 - x).otherwise(x))), 1)):
        rows = Q._cascade_rules(ml, out).collect()
        assert len(rows) == n and sum(not r.ok for r in rows) == (ml.filter("l_linenumber = 1").count() if wrong else 0)


def test_synthetic_bernoulli_rate(spark):
    df = spark.range(20000).select("id", F.lit(0.0).alias("label"),
                                   F.array_repeat(F.lit(0.0), 30).alias("a"))
    out = X.synthetic_bernoulli(df, seed=3, keys=["id"], assemble=False, keep=["id"])
    mean = out.select(F.avg("label0"), F.avg("label29")).first()
    assert abs(mean[0] - 0.7) < 0.02 and abs(mean[1] - 0.7) < 0.02
    vec = X.synthetic_bernoulli(df.limit(5), seed=3, keys=["id"])
    assert vec.columns == ["features", "label"] and len(vec.first().features) == 30


def test_synthetic_bernoulli_per_class(spark):
    df = spark.range(20000).select("id", (F.col("id") % 2).cast("double").alias("label"))
    out = X.synthetic_bernoulli(df, n=2, p_class0=0.1, p_class1=0.9, seed=1, keys=["id"], assemble=False)
    means = {r.label: r.m for r in out.groupBy("label").agg(F.avg("label0").alias("m")).collect()}
    assert abs(means[0.0] - 0.1) < 0.02 and abs(means[1.0] - 0.9) < 0.02


def test_prepare_chain_equals_the_expanded_form(ml):
    """Scaling and testing before the copies are made gives what they give after it."""
    from pyspark.ml.feature import MaxAbsScaler
    from pyspark.ml.functions import vector_to_array

    from tiltml.operators import features as FT
    from tiltml.operators import sampling as S
    tr = ml.filter(F.col("l_linenumber") != 1)
    otr, _ = X.prepare_chain(tr, ml, 1.5, "numTopFeatures", num_top_features=2, keys=KEYS, keep=KEYS)
    over = S.oversample(tr, 1.5, "label", S.SAMPLING_SEED, KEYS)
    scaled = MaxAbsScaler(inputCol="features", outputCol="s").fit(over).transform(over)
    idx = FT.select_binned(scaled.select(vector_to_array("s").alias("x"), "label"), "x", "label", None, "numTopFeatures", num_top_features=2)
    want = scaled.select(*KEYS, *[F.get(vector_to_array("s"), F.lit(i)).alias(f"f{i}") for i in idx])
    got = otr.select(*KEYS, *[F.get(vector_to_array("features"), F.lit(j)).alias(f"f{i}") for j, i in enumerate(idx)])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_prepare_chain_scales_and_selects(ml):
    tr, te = ml.filter(F.col("l_linenumber") != 1), ml.filter(F.col("l_linenumber") == 1)
    otr, ote = X.prepare_chain(tr, te, 1.5, "numTopFeatures", num_top_features=2, keys=KEYS)
    assert otr.columns == ["features", "label"]
    assert len(otr.first().features) == 2
    mx = otr.select(F.max(F.abs(F.get(__import__("pyspark.ml.functions", fromlist=["x"]).vector_to_array("features"), 0)))).first()[0]
    assert mx <= 1.0


def test_synthetic_draws_are_compared_as_text(spark):
    """No digits are converted, the draws are those of hash_u_block, and a probability of 0 or 1 is sure."""
    from tiltml.functions.hashing import hash_u_block
    df = spark.range(300).select("id", (F.col("id") % 3).cast("double").alias("label"))
    for p0, p1 in ((0.7, 0.7), (0.25, 0.9), (0.0, 1.0), (1.0, 0.0)):
        out = X.synthetic_bernoulli(df, n=6, p_class0=p0, p_class1=p1, seed=5, keys=["id"], assemble=False, keep=["id"])
        assert "conv(" not in out._jdf.queryExecution().optimizedPlan().toString()
        p = F.when(F.col("label") == 1.0, F.lit(p1)).otherwise(F.lit(p0))
        us = [u for b in (0, 1) for u in hash_u_block(["id"], 5, f"label.block{b}")]
        want = df.select("id", *[F.when(u >= 1.0 - p, 1).otherwise(0).alias(f"label{i}") for i, u in enumerate(us[:6])], "label")
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
