import pytest
from pyspark.sql import functions as F

from tiltml.functions import hashing as H
from tiltml.operators import sampling as S
from tiltml.operators.aggregates import count_by_value
from tiltml.sources import fixtures as FX

KEYS = FX.LINEITEM_KEYS


@pytest.fixture(scope="module")
def mlb(spark):
    return FX.ml_binary(spark, "/root/testdata/sf0.01").cache()


def _rows(df):
    return sorted(tuple(r) for r in df.select(*KEYS, "class").collect())


def test_undersample_hash_balances(mlb):
    out = S.undersample(mlb, 1.0, "class", S.SAMPLING_SEED, KEYS)
    c = count_by_value(out, "class", [0.0, 1.0])
    assert c[1.0] == 11988
    assert abs(c[0.0] - 11988) < 400


def test_undersample_truncated_ratio(mlb):
    # ratio 0.5 truncates to 0: the majority disappears (original behaviour)
    out = S.undersample(mlb, 0.5, "class", S.SAMPLING_SEED, KEYS, truncate_ratio=True)
    assert count_by_value(out, "class", [0.0, 1.0]) == {0.0: 0, 1.0: 11988}
    out = S.undersample(mlb, 0.5, "class", S.SAMPLING_SEED, KEYS)
    assert abs(count_by_value(out, "class", [0.0])[0.0] - 5994) < 300


def test_hash_sampling_is_partition_independent(mlb):
    a = S.undersample(mlb, 1.0, "class", S.SAMPLING_SEED, KEYS)
    b = S.undersample(mlb.repartition(13), 1.0, "class", S.SAMPLING_SEED, KEYS)
    assert _rows(a) == _rows(b)


def test_oversample_fraction_above_one(mlb):
    b = mlb.withColumnRenamed("class", "label")
    out = S.oversample(b, 1.5, "label", S.SAMPLING_SEED, KEYS)
    c = count_by_value(out, "label", [0.0, 1.0])
    assert c[0.0] == 48012
    assert abs(c[1.0] - 1.5 * 48012) < 1500


def test_oversample_keep_originals(mlb):
    b = mlb.withColumnRenamed("class", "label")
    out = S.oversample(b, 1.5, "label", S.SAMPLING_SEED, KEYS, keep_originals=True)
    originals = b.filter("label = 1").select(*KEYS).distinct().count()
    kept = out.filter("label = 1").select(*KEYS).distinct().count()
    assert originals == kept == 11988


def test_native_oversample_runs(mlb):
    b = mlb.withColumnRenamed("class", "label")
    out = S.oversample(b, 1.0, "label", S.SAMPLING_SEED)
    assert abs(count_by_value(out, "label", [1.0])[1.0] - 48012) < 1500


def test_balance_samples_the_real_majority(spark):
    # class 1 is the majority: the original helper dropped it entirely
    df = spark.createDataFrame([(i, 1.0 if i % 10 < 8 else 0.0) for i in range(2000)], "k long, class double")
    out = S.balance(df, "class", 5, ["k"])
    c = count_by_value(out, "class", [0.0, 1.0])
    assert c[0.0] == 400 and abs(c[1.0] - 400) < 80
    trap = S.balance(df, "class", 5, ["k"], always_sample_class0=True)
    assert count_by_value(trap, "class", [1.0])[1.0] == 0


def test_random_split_partitions_rows(mlb):
    parts = S.random_split(mlb, [0.7, 0.3], S.SPLIT_SEED_70_30, KEYS)
    n = [p.count() for p in parts]
    assert sum(n) == 60000 and abs(n[0] / 60000 - 0.7) < 0.02
    assert parts[0].join(parts[1], KEYS).count() == 0


def test_native_random_split(mlb):
    parts = S.random_split(mlb, [0.5, 0.5], 3)
    assert sum(p.count() for p in parts) == 60000


def test_kfold_complement(mlb):
    folded = S.kfold_assign(mlb, 4, S.SPLIT_SEED_FOLDS, KEYS)
    sizes = {r.fold: r.n for r in folded.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert set(sizes) == {0, 1, 2, 3} and sum(sizes.values()) == 60000
    assert S.kfold_complement(folded, 2).count() == 60000 - sizes[2]


def test_union_many_positional_and_by_name(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, 4)], "y int, x int")
    assert sorted(tuple(r) for r in S.union_all(a, b).collect()) == [(1, 2), (4, 3)]
    assert sorted(tuple(r) for r in S.union_all(a, b, by_name=False).collect()) == [(1, 2), (3, 4)]
    assert S.union_many([a, a, a]).count() == 3


def test_large_copy_counts_are_split_across_tasks(spark):
    # 3 minority rows against 30,000 majority rows: each minority row gets ~15,000 copies
    from pyspark.sql import functions as F
    df = spark.range(30003).select(F.col("id").alias("k"),
                                   F.when(F.col("id") < 3, F.lit(1.0)).otherwise(F.lit(0.0)).alias("label"))
    drawn = S.oversample(df, 1.5, "label", 7, ["k"])
    assert abs(count_by_value(drawn, "label", [1.0])[1.0] - 45000) < 5 * 45000 ** 0.5
    out = S.oversample(df, 1.5, "label", 7, ["k"], draw="systematic")
    c = count_by_value(out, "label", [0.0, 1.0])
    assert c[0.0] == 30000 and c[1.0] == 45000        # 3 rows x 15000 exact copies (integer fraction)
    per_task = out.filter("label = 1").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per_task) > 1 and max(r["count"] for r in per_task) < 45000
    # below the chunk size the copies expand locally: f = 1003 / 3 * 1.5 = 501.5
    few = S.oversample(df.filter("k < 3 or k >= 29000"), 1.5, "label", 7, ["k"], draw="systematic")
    assert 3 * 501 <= count_by_value(few, "label", [1.0])[1.0] <= 3 * 502


@pytest.mark.parametrize("op", [
    lambda df, seed: S.undersample(df, 1.0, "class", seed, KEYS),
    lambda df, seed: S.random_split(df, [0.5, 0.5], seed, KEYS)[0],
    lambda df, seed: S.kfold_assign(df, 3, seed, KEYS).filter("fold = 0"),
])
def test_seed_controls_every_draw(mlb, op):
    a, b, c = op(mlb, 1), op(mlb, 1), op(mlb, 2)
    assert _rows(a) == _rows(b)
    assert _rows(a) != _rows(c)


@pytest.mark.parametrize("fraction", [0.0, 1e-6, 0.25, 1.0, 6.0, 8.0])
def test_one_draw_follows_the_distribution(spark, fraction):
    """Counts of copies against the Poisson distribution, at draws on an even grid."""
    from math import exp, lgamma, log
    n = 20_000
    u = (F.col("id") + F.lit(0.5)) / n
    rows = spark.range(n).select(u.alias("u")).select(H.poisson_copies(F.col("u"), fraction).alias("c")).groupBy("c").count().collect()
    assert sum(r["c"] * r["count"] for r in rows) == pytest.approx(fraction * n, rel=2e-3, abs=2)
    assert max(r["c"] for r in rows) <= len(H.poisson_table(fraction))
    for r in rows:
        p = exp(-fraction + r["c"] * log(fraction) - lgamma(r["c"] + 1)) if fraction else 1.0
        assert abs(r["count"] - n * p) <= 1.01


@pytest.mark.parametrize("fraction,rows", [(9.0, 20_000), (40.0, 20_000), (2000.0, 2000), (1e6, 3)])
def test_sums_of_draws_have_the_mean_and_variance(spark, fraction, rows):
    df = spark.range(rows).withColumnRenamed("id", "k")
    copies, largest = S.copies_of(df, fraction, 3, ["k"])
    got = df.select(copies.alias("c")).agg(F.avg("c").alias("m"), F.var_pop("c").alias("v"), F.max("c").alias("top")).first()
    assert abs(got.m - fraction) < 5 * (fraction / rows) ** 0.5 and got.top <= largest
    if rows > 100:
        assert got.v == pytest.approx(fraction, rel=5 * (2 / rows) ** 0.5)


def test_poisson_tables_are_short_at_any_fraction():
    for fraction in (1e-9, 0.3, 8.0, 8.0001, 50.0, 1e6, 3e6, 1e9, 1e15):
        draws, mean = H.poisson_parts(fraction)
        assert draws * mean == pytest.approx(fraction) and len(H.poisson_table(mean)) <= 40
    with pytest.raises(ValueError):
        H.poisson_table(8.5)


def test_plan_does_not_grow_with_the_fraction(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    size = lambda f: len(df.select(S.copies_of(df, f, 3, ["k"])[0])._jdf.queryExecution().optimizedPlan().toString())
    assert size(1e9) < size(9.0) * 1.5


def test_oversampling_a_tiny_class_against_a_huge_one(spark):
    """Two rows get about 150,000 copies each, spread over tasks."""
    df = spark.range(300_002).select(F.col("id").alias("k"), F.when(F.col("id") < 2, 1.0).otherwise(0.0).alias("label"))
    out = S.oversample(df, 1.0, "label", 5, ["k"]).filter("label = 1")
    n = {r.k: r["count"] for r in out.groupBy("k").count().collect()}
    assert set(n) == {0, 1} and all(abs(x - 150_000) < 5 * 150_000 ** 0.5 for x in n.values())


def test_with_replacement_loses_and_repeats_rows(mlb):
    under = S.undersample(mlb, 1.0, "class", S.SAMPLING_SEED, KEYS).filter("class = 0")
    assert under.count() > under.select(*KEYS).distinct().count()
    over = S.oversample(mlb.withColumnRenamed("class", "label"), 0.5, "label", S.SAMPLING_SEED, KEYS).filter("label = 1")
    assert over.select(*KEYS).distinct().count() < 11988 < over.count()


def test_null_and_zoned_keys(spark):
    rows = spark.createDataFrame([(1, None, 2), (1, 2, None), (1, 2, 2)], "a int, b int, c int")
    assert rows.select(H.hash_u(["a", "b", "c"], 1).alias("u")).distinct().count() == 3
    stamps = spark.sql("select timestamp'2024-01-01 00:00:00Z' t, 1.0D d, 1.0D class")
    draws = set()
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            draws.add(S.assign_split(stamps, [1.0] * 1000, 5, ["t"]).first().split)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(draws) == 1
    with pytest.raises(TypeError):
        S.assign_split(stamps, [1, 1], 5, ["d"])


def test_one_draw_a_row(mlb):
    for df in (S.kfold_assign(mlb, 4, 1, KEYS), S.random_split(mlb, [0.7, 0.3], 1, KEYS)[1], S.random_split(mlb, [0.25] * 4, 1, KEYS)[2]):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("md5(") == 1


def test_large_poisson_counts_are_the_sums_of_md5_draws(spark):
    """Counts of many draws against plain md5; they come from batches, not from lambdas that Spark interprets draw by draw."""
    import bisect
    from hashlib import md5
    rows = spark.range(20).withColumn("id", F.when(F.col("id") > 0, F.col("id")))
    for fraction in (9.0, 2000.0, 600_000.0):
        draws, mean = H.poisson_parts(fraction)
        table = H.poisson_table(mean)
        some = rows.limit(20 if fraction < 10_000 else 2)
        out = some.select("id", S.copies_of(some, fraction, 7, ["id"])[0].alias("n"))
        assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
        for r in out.collect():
            key = f"7|{H.NULL_KEY if r.id is None else r.id}"
            digests = [md5(f"{key}|poisson|{b}".encode()).digest() for b in range(-(-draws // 4))]
            us = [int.from_bytes(digests[j // 4][j % 4 * 4:j % 4 * 4 + 4], "big") / 2**32 for j in range(draws)]
            assert r.n == sum(bisect.bisect_right(table, u) for u in us)
