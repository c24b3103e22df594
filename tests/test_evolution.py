import math

import pytest
from pyspark.sql import functions as F

from tiltml.functions.hashing import hash_u
from tiltml.operators import evolution as EV


def evolve_cells_stepwise(df, features, maxima, label_col="class", iterations=EV.DEFAULT_ITERATIONS, w0=None):
    """The round-by-round form (struct ``withField`` updates), against which the
    closed form is held. Plan depth grows with rounds."""
    n = len(features)
    cut = {0.0: EV.CUT_CONSTANT_CLASS0 / n, 1.0: EV.CUT_CONSTANT_CLASS1 / n}
    lab = F.col(label_col)
    cut_c = F.when(lab == F.lit(0.0), F.lit(cut[0.0])).when(lab == F.lit(1.0), F.lit(cut[1.0]))
    max_c = F.when(lab == F.lit(0.0), F.lit(maxima.get(0.0))).when(lab == F.lit(1.0), F.lit(maxima.get(1.0)))
    w0 = w0 or {c: F.lit(1.0) for c in features}
    cur = df.withColumns({c: F.struct(w0[c].alias("weight"), F.col(f"`{c}`").alias("value"),
                                      (w0[c] * F.col(f"`{c}`")).alias("res")) for c in features})
    for _ in range(iterations):
        cur = cur.withColumns({
            c: F.col(f"`{c}`").withField("weight", F.col(f"`{c}`.weight") + F.try_divide(cut_c - (F.col(f"`{c}`.res") + cut_c), max_c))
                              .withField("res", F.col(f"`{c}`.weight") * F.col(f"`{c}`.value"))
            for c in features})
    return cur


def test_coefficients_closed_form():
    assert EV.evolution_coefficients(10) == [1, -10, 36, -56, 35, -6]
    # P_T(x) = sum_k (-1)^k C(T+1-k, k) x^k
    for t in range(0, 15):
        exp = [(-1) ** k * math.comb(t + 1 - k, k) for k in range(0, (t + 1) // 2 + 1)]
        got = EV.evolution_coefficients(t)
        assert got == exp[:len(got)] and all(v == 0 for v in exp[len(got):])


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, float((i * 7) % 11), float((i * 3) % 5) + 0.5, float(i % 2)) for i in range(40)]
    return spark.createDataFrame(rows, "k long, a double, b double, class double")


@pytest.mark.parametrize("iterations", [1, 3, 10])
def test_closed_form_equals_stepwise(spark, small, iterations):
    feats = ["a", "b"]
    maxima = EV.class_row_maxima(small, feats, "class", float32=True)
    w0 = {c: hash_u(["k"], 3, c) for c in feats}
    step = evolve_cells_stepwise(small, feats, maxima, "class", iterations, w0)
    closed = EV.evolved_weights(small, feats, maxima, "class", iterations, "hash", 3, ["k"])
    got = step.select("k", *[F.col(f"{c}.weight").alias(c) for c in feats]).orderBy("k").collect()
    exp = small.select("k", *[closed[c].alias(c) for c in feats]).orderBy("k").collect()
    for g, e in zip(got, exp):
        for c in feats:
            assert math.isclose(g[c], e[c], rel_tol=1e-9, abs_tol=1e-9)


def test_top_k_descending_ties_by_name(spark):
    s = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 5.0), ("d", -1.0)], "column string, score double")
    assert [r.column for r in EV.top_k_columns(s, 3).collect()] == ["c", "a", "b"]


@pytest.mark.parametrize("mode", ["const", "hash"])
def test_scores_equal_summed_weights(spark, small, mode):
    feats = ["a", "b"]
    maxima = EV.class_row_maxima(small, feats, "class")
    w = EV.evolved_weights(small, feats, maxima, "class", 10, mode, 3, ["k"])
    apart = {r.column: r.score for r in EV._summed(small.select(F.array(*w.values()).alias("__tilt_w")), list(w)).collect()}
    whole = {r.column: r.score for r in EV.weight_evolution(small, feats, "class", 10, mode, 3, ["k"]).collect()}
    for c in feats:
        assert math.isclose(whole[c], apart[c], rel_tol=1e-12)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 66])
def test_one_form_at_every_width(spark, n):
    feats = [f"c{i}" for i in range(n)]
    df = spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 2).cast("double").alias("class"),
                                *[F.when(F.col("id") % 7 != 3, (F.col("id") * (i + 1) % 11).cast("int")).alias(c) for i, c in enumerate(feats)])
    got = {r.column: r.score for r in EV.weight_evolution(df, feats, "class", 2).collect()}
    maxima = EV.class_row_maxima(df, feats, "class")
    for c in feats:
        want = sum(sum(co * (r[c] / maxima[r["class"]]) ** k for k, co in enumerate(EV.evolution_coefficients(2)))
                   for r in df.collect() if r[c] is not None)
        assert math.isclose(got[c], want, rel_tol=1e-9)
    empty = EV.weight_evolution(df.limit(0), feats, "class").collect()
    assert len(empty) == n and all(r.score is None for r in empty)


def test_zero_and_absent_class_maximum(spark):
    rows = [(float(i), 1.0) for i in range(5)] + [(0.0, 0.0)] * 3
    df = spark.createDataFrame(rows, "`a.x` double, class double")
    score = EV.weight_evolution(df, ["a.x"], "class", 2).first().score
    want = EV.weight_evolution(df.filter("class = 1"), ["a.x"], "class", 2).first().score
    assert math.isclose(score, want)  # the all-zero class adds NULLs, no error
    assert EV.evolved_feature_selection(df, 1, ["a.x"]).count() == 8
    assert EV.weight_evolution(df.filter("class = 0"), ["a.x"], "class", 2).first().score is None


def test_selection_keeps_names_with_sum_suffix(spark):
    rows = [(float(i % 3), float(i % 7), float(i % 2)) for i in range(30)]
    df = spark.createDataFrame(rows, "x_sum double, y double, class double")
    out = EV.evolved_feature_selection(df, k=1, weight_mode="const")
    assert len(out.columns) == 2 and out.columns[-1] == "class" and out.columns[0] in ("x_sum", "y")
    assert out.count() == 30


def test_instance_filter_keeps_rows(spark, small):
    feats = ["a", "b"]
    maxima = EV.class_row_maxima(small, feats, "class")
    w = EV.evolved_weights(small, feats, maxima, "class", 10, "const")
    kept = EV.instance_filter(small, w).count()
    assert 0 < kept <= 40


def test_wide_table_selection(spark):
    import time
    base = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 5 == 0).cast("double").alias("class"))
    feats = [(hash_u(["k"], i) * F.lit(float(i % 17 + 1))).alias(f"f{i}") for i in range(150)]
    df = base.select("k", *feats, "class").cache()
    df.count()
    t = time.time()
    out = EV.evolved_feature_selection(df, k=100, label_col="class", weight_mode="hash", seed=5,
                                       keys=["k"], keep=["k"])
    assert len(out.columns) == 102 and out.count() == 400
    assert time.time() - t < 120
    scores = EV.weight_evolution(df, [f"f{i}" for i in range(150)], "class", weight_mode="const")
    assert scores.count() == 150
