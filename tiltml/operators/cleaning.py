"""Composite cleaning, stacking, synthetic-feature and preparation operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltml.functions.hashing import (DRAWS_PER_DIGEST, _draw_hash, hash_u_block,
                                      digest_draw_at_least, digest_from_key, key_text)
from tiltml.operators.features import CHI2_BUCKETS, inverse_maxima, scaled_array, select_binned
from tiltml.operators.filters import confident_predicate, noise_retention_predicate
from tiltml.operators.models import fit, fit_dealt, gbt_classifier, rf_classifier, tree_cells, weighted
from tiltml.operators.sampling import (SAMPLING_SEED, SPLIT_SEED_FOLDS, kfold_assign,
                                       kfold_complement, oversample_copies, random_split, repeat_rows, union_many)
from tiltml.operators.tree_tables import margins_of
from tiltml.sources.sinks import spread

# The cascade's five boosting configurations (cycled over 30 rounds),
# its 0.3/0.7 split, confidence threshold, and the noise filter's 4 folds of 10 trees.
CASCADE_CONFIGS = (
    {"maxIter": 65, "depth": 7, "stepSize": 0.4},
    {"maxIter": 70, "depth": 7, "stepSize": 0.4},
    {"maxIter": 100, "depth": 6, "stepSize": 0.4},
    {"maxIter": 90, "depth": 7, "stepSize": 0.4},
    {"maxIter": 95, "depth": 8, "stepSize": 0.4},
)
CASCADE_ROUNDS = 30
CASCADE_SPLIT = (0.3, 0.7)
CASCADE_THRESHOLD = 0.6
NOISE_FOLDS = 4
NOISE_TREES = 10
SYNTHETIC_COLUMNS = 30
SYNTHETIC_P_ONE = 0.7


def noise_filter(df: DataFrame, k: int = NOISE_FOLDS, seed: int = SPLIT_SEED_FOLDS,
                 keys: Sequence[str] | None = None, num_trees: int = NOISE_TREES,
                 model_seed: int = 42, features_col: str = "features", label_col: str = "label",
                 keep: Sequence[str] = (), parallelism: int = 4, materialize: bool = False, estimator=None) -> DataFrame:
    """Cross-validated majority noise filter.

    Rows get a fold in ``0..k-1``; for each fold a random forest is fit on
    the other folds and scores the held-out fold; a held-out row is kept if
    it is minority (label 1) or a correctly predicted majority row. Every
    minority row survives; the output is a subset of the input.

    One fold column replaces k splits + unions of k-1 parts. The training rows become weighted cells
    once, with their fold, and are held while the k fits read those of the other folds;
    the fits are submitted concurrently (``parallelism``). With ``materialize`` the result is written
    to the shared checkpoint folder, so that later actions don't score the rows again.
    ``estimator`` replaces the random forest of ``num_trees``.
    """
    folded = kfold_assign(df.select(*keep, features_col, label_col), k, seed, keys)
    est = estimator or rf_classifier({"nTrees": num_trees, "seed": model_seed}, features_col, label_col)
    with tree_cells(est, folded, ["fold"]) as cells:
        models = fit_dealt([(weighted(est), kfold_complement(cells, i).drop("fold")) for i in range(k)], parallelism)
    parts = []
    for i, model in enumerate(models):
        scored = model.transform(folded.filter(F.col("fold") == F.lit(i)))
        parts.append(scored.filter(noise_retention_predicate(label_col, "prediction"))
                     .select(*keep, features_col, label_col))
    out = union_many(parts)
    if materialize:
        from tiltml.session import materialize as write_table
        out = write_table(out, "noise-filter")
    return out


def confidence_cascade(df: DataFrame, rounds: int = CASCADE_ROUNDS,
                       configs: Sequence[Mapping] = CASCADE_CONFIGS,
                       split: Sequence[float] = CASCADE_SPLIT, seed: int = SPLIT_SEED_FOLDS,
                       keys: Sequence[str] | None = None, threshold: float = CASCADE_THRESHOLD,
                       features_col: str = "features", label_col: str = "label",
                       keep: Sequence[str] = (), model_seed: int | None = None,
                       cut_lineage_every: int | None = None, parallelism: int = 5) -> DataFrame:
    """Stacking set from a cascade of boosted-tree models.

    Split train/test; round ``i`` fits a model with ``configs[i % len]`` on
    the same train, scores the surviving test rows, keeps the confident and
    correct ones and records the prediction as ``label{i}``. The output adds
    ``features = array(label0..label{rounds-1})`` and drops the vector.

    A configuration seen before is the same fit (same data, parameters and
    seed), and its survivors already passed that model, so a repeated round
    re-emits that round's prediction column without refitting or rescoring.
    Configurations that differ in their number of rounds only are stages of
    the longest: 3 fits on weighted cells made and held once, and one walk over 285 trees a cell
    for the 30 rounds of the original configurations.
    """
    train, test = random_split(df.select(*keep, features_col, label_col), split, seed, keys)
    m = len(configs)
    distinct = [dict(c) for c in configs[:min(rounds, m)]]
    if model_seed is not None:
        distinct = [c | {"seed": model_seed} for c in distinct]
    models, names = fit_longest(distinct, train, features_col, label_col, parallelism)
    same = {name: [j for j in range(len(distinct)) if names[j] == name] for name in models}
    walked = margins_of([(models[name], [int(distinct[j]["maxIter"]) for j in js]) for name, js in same.items()], features_col)
    cur = spread(test).withColumn("__tilt_walk", walked)
    ready = {j: F.get(F.col("__tilt_walk"), F.lit(at)) for at, j in enumerate(j for js in same.values() for j in js)}
    for i in range(rounds):
        ci = i % m
        if i >= m:
            cur = cur.withColumn(f"label{i}", F.col(f"label{ci}"))
            continue
        sure = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * ready[i]))
        cur = (cur.withColumn("__tilt_p", F.array(F.lit(1.0) - sure, sure)).filter(confident_predicate("__tilt_p", label_col, threshold)).drop("__tilt_p")
               .withColumn(f"label{i}", F.when(ready[i] > F.lit(0.0), F.lit(1.0)).otherwise(F.lit(0.0))))
        if cut_lineage_every and (i + 1) % cut_lineage_every == 0:
            from tiltml.session import cut_lineage
            cur = cut_lineage(cur)
    labels = [f"label{i}" for i in range(rounds)]
    return cur.select(*keep, label_col, *labels, F.array(*[F.col(c) for c in labels]).alias("features"))


def fit_longest(configs: Sequence[Mapping], train: DataFrame, features_col: str, label_col: str, parallelism: int) -> tuple[dict, list[tuple]]:
    """(models by name, the name of each configuration): of configurations that differ in ``maxIter`` only, the longest is fitted. The
    training rows become weighted cells once for all fits."""
    longest: dict[tuple, dict] = {}
    names = [tuple(sorted((k, v) for k, v in c.items() if k != "maxIter")) for c in configs]
    for name, c in zip(names, configs, strict=True):
        if name not in longest or int(c["maxIter"]) > int(longest[name]["maxIter"]):
            longest[name] = dict(c)
    fits = [gbt_classifier(c, features_col, label_col) for c in longest.values()]
    if len({est.getMaxBins() for est in fits}) > 1:
        models = [fit(est, train) for est in fits]
    else:
        with tree_cells(fits[0], train) as cells:
            models = fit_dealt([(weighted(est), cells) for est in fits], parallelism)
    return dict(zip(longest, models, strict=True)), names


def synthetic_bernoulli(df: DataFrame, n: int = SYNTHETIC_COLUMNS, p_class0: float = SYNTHETIC_P_ONE,
                        p_class1: float = SYNTHETIC_P_ONE, seed: int = 0,
                        keys: Sequence[str] | None = None, label_col: str = "label",
                        prefix: str = "label", assemble: bool = True,
                        keep: Sequence[str] = ()) -> DataFrame:
    """Replace the features by ``n`` synthetic 0/1 columns, ``P(1) = p`` per class.

    The original job exploded the first 30 vector elements and then
    overwrote every one of them with a random draw (its second draw, with
    P(1) = 0.7, wins), so only the count survives: the vector is never read
    here. With keys, draws come four per md5 digest of (row key, block) and are
    compared as text; the vectors are dense.
    """
    one = F.col(label_col) == F.lit(1.0)
    least = [(p_class1, one), (p_class0, None)] if p_class1 != p_class0 else [(p_class0, None)]

    def drawn(at_least) -> Column:
        """Whether the draw is at least 1 - p of the row's class."""
        out = at_least(1.0 - least[-1][0])
        return out if len(least) == 1 else F.when(one, at_least(1.0 - least[0][0])).otherwise(out)

    staged_key = bool(keys) and _draw_hash() == "md5"
    if staged_key:
        # the row's key text is built once, in its own projection, and so are the digests
        blocks = range(-(-n // DRAWS_PER_DIGEST))
        df = df.select(*keep, F.col(label_col), key_text(keys, seed).alias("__tilt_key"))
        df = df.select(*keep, F.col(label_col), *[digest_from_key(F.col("__tilt_key"), f"{prefix}.block{b}").alias(f"__tilt_md5_{b}") for b in blocks])
    cols = []
    draws: list = []
    for i in range(n):
        slot = i % DRAWS_PER_DIGEST
        if staged_key:
            digest = F.col(f"__tilt_md5_{i // DRAWS_PER_DIGEST}")
            hit = drawn(lambda x, d=digest, j=slot: digest_draw_at_least(d, j, x))
        elif keys:
            if slot == 0:
                draws = hash_u_block(keys, seed, f"{prefix}.block{i // DRAWS_PER_DIGEST}")
            hit = drawn(lambda x, u=draws[slot]: u >= F.lit(x))
        else:
            hit = F.rand(seed + i) >= F.lit(1.0) - F.when(one, F.lit(p_class1)).otherwise(F.lit(p_class0))
        cols.append(F.when(hit, F.lit(1)).otherwise(F.lit(0)).alias(f"{prefix}{i}"))
    wide = df.select(*keep, *cols, F.col(label_col))
    if not assemble:
        return wide
    names = [F.col(f"{prefix}{i}").cast("double") for i in range(n)]
    return wide.select(*keep, array_to_vector(F.array(*names)).alias("features"), label_col)


def prepare_chain(train: DataFrame, test: DataFrame, oversample_ratio: float = 1.5,
                  selector_type: str = "percentile", percentile: float = 0.5,
                  num_top_features: int = 50, seed: int = SAMPLING_SEED,
                  keys: Sequence[str] | None = None, num_buckets: int = CHI2_BUCKETS,
                  refit_on_test: bool = False, keep: Sequence[str] = (), weight_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Oversample -> max-abs scale (fit on train) -> chi-square select -> ``(features, label)``.

    Oversampling gives every row a number of copies. The maxima need only the
    rows with a copy, and the chi-square test of the binned *scaled* features needs
    counts weighted by the copies, so both are aggregates over the original rows;
    rows are repeated once, in the output. The chosen indices are sliced out of the
    scaled vector, so scaling reaches the output. With ``weight_col`` no row is repeated: train comes with
    its copies as a weight, for fits that take weights, and test with weight 1.
    """
    copies, largest = oversample_copies(train, oversample_ratio, "label", seed, keys)
    counted = train.withColumn("__tilt_copies", copies).filter(F.col("__tilt_copies") >= F.lit(1))
    scale = inverse_maxima(counted)
    idx = select_binned(counted.select(scaled_array("features", scale).alias("x"), "label", F.col("__tilt_copies").alias("n")),
                        "x", "label", "n", selector_type, percentile, num_top_features, num_buckets=num_buckets)

    def out(x: DataFrame, by: list[float], *more: Column) -> DataFrame:
        picked = [F.get(vector_to_array(F.col("features")), F.lit(i)) * F.lit(by[i]) for i in idx]
        return x.select(*keep, array_to_vector(F.array(*picked)).alias("features"), "label", *more)

    test_scale = inverse_maxima(test) if refit_on_test else scale
    if weight_col:
        return out(counted, scale, F.col("__tilt_copies").cast("double").alias(weight_col)), out(test, test_scale, F.lit(1.0).alias(weight_col))
    return out(repeat_rows(train, copies, largest), scale), out(test, test_scale)


def median_band_filter(df: DataFrame, value, float32: bool = True, strict_reference: bool = False,
                       buckets: int = 4096) -> DataFrame:
    """Keep rows whose value lies in the band ``median -/+ margin``.

    ``margin = (|max - median| - |median - min|) / 2`` from one max/min
    aggregate and an exact distributed median (three scalars to the driver).
    With a negative margin the lower bound exceeds the upper one: by default
    the band runs between the two bounds; ``strict_reference=True`` keeps
    ``inf < v < sup`` literally (then nothing survives). ``float32`` rounds
    the three statistics to single precision as the original job did.
    """
    import numpy as np

    from tiltml.operators.quantiles import exact_median
    v = F.col(value) if isinstance(value, str) else value
    staged = df.withColumn("__tilt_band", v.cast("double"))
    r = staged.agg(F.max("__tilt_band").alias("mx"), F.min("__tilt_band").alias("mn")).first()
    med = exact_median(staged, "__tilt_band", buckets=buckets)
    if med is None:
        return df.limit(0)
    if float32:
        mx, mn, md = np.float32(r["mx"]), np.float32(r["mn"]), np.float32(med)
        margin = float(np.float32(abs(mx - md)) - np.float32(abs(md - mn))) / 2.0
        med_d = float(md)
    else:
        margin = (abs(r["mx"] - med) - abs(med - r["mn"])) / 2.0
        med_d = med
    sup, inf = med_d + margin, med_d - margin
    if not strict_reference:
        inf, sup = min(inf, sup), max(inf, sup)
    band = (F.col("__tilt_band") > F.lit(inf)) & (F.col("__tilt_band") < F.lit(sup))
    return staged.filter(band).drop("__tilt_band")
