"""Balancing, sampling, splitting and folding.

Two draw methods for every operator:

* ``keys=None`` (native): ``DataFrame.sample`` / ``randomSplit`` / ``rand``
  with a seed, as a Spark user writes it. Results depend on partitioning.
* ``keys=[...]`` (hash): a row-local hash-u draw from the key columns, the
  same rows at any partitioning and after task retries, and reproducible by
  the DuckDB oracle.

Sampling with replacement in hash mode gives every row a Poisson number of copies
by inverse distribution from its draw (``draw="poisson"``, as the native sampler
does; beyond a mean of 8 the sum of counts of several draws), or, with ``draw="systematic"``, the fraction's whole part plus at most one.

Neither needs a shuffle or a sort: a draw is a projection + filter (and an
``explode`` for copies when sampling with replacement). In hash mode a
balancing operator is a single pass over its input: each row gets a copy
count (1 for a kept class, the draw for the sampled class) instead of a
union of two filtered scans. Class counts come from one aggregate; only
those counts reach the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltml.functions.hashing import _bound, hash_u, key_columns, key_text, poisson_count, systematic_copies
from tiltml.operators.aggregates import count_by_value

# Copies of one row generated inside a single task; beyond this the copies of a
# row are split into chunks that are spread over tasks before expanding.
COPY_CHUNK = 1024

# Seeds used by the balancing and splitting jobs.
SAMPLING_SEED = 12345678
SPLIT_SEED_70_30 = 1234
SPLIT_SEED_FOLDS = 123456789


def _draw(df: DataFrame, seed: int, keys: Sequence[str] | None, salt: str | None = None) -> Column:
    return hash_u(key_columns(df, keys), seed, salt) if keys else F.rand(seed)


def copies_of(df: DataFrame, fraction: float, seed: int, keys: Sequence[str] | None, draw: str = "poisson", salt: str | None = None) -> tuple[Column, int]:
    """Copies column and its bound; a row's draw is computed once."""
    u = _draw(df, seed, keys, salt)
    if draw == "systematic":
        return _bound(u, lambda x: systematic_copies(x, fraction)[0]), systematic_copies(F.lit(0.0), fraction)[1]
    if draw != "poisson":
        raise ValueError(f"unknown draw {draw!r}")
    key = key_text([*(key_columns(df, keys) if keys else [F.rand(seed)]), *([F.lit(salt)] if salt is not None else [])], seed)
    return poisson_count(u, key, fraction)


def _expand_copies(staged: DataFrame, cols: Sequence[str], copies_col: str, max_copies: int) -> DataFrame:
    """Repeat each row ``copies_col`` times.

    Up to ``COPY_CHUNK`` copies are expanded where the row is read. A larger
    count (a tiny class oversampled against a huge one) would put a large
    share of the output in the task holding that row, so each row first
    becomes ``ceil(n / COPY_CHUNK)`` chunk rows, the chunk rows are spread
    round-robin over the shuffle partitions, and each chunk expands there.
    """
    n = F.col(copies_col)
    cols = [F.col(f"`{c}`") for c in cols]
    if max_copies <= COPY_CHUNK:
        # no copies: an empty list, which gives no row
        return staged.select(*cols, F.explode(F.array_repeat(F.lit(True), n.cast("int"))).alias("__tilt_copy")).select(*cols)
    staged = staged.filter(n >= F.lit(1))
    chunk = F.lit(COPY_CHUNK)
    chunks = staged.select(*cols, n.alias("__tilt_n"),
                           F.explode(F.sequence(F.lit(0), ((n - 1) / chunk).cast("int"))).alias("__tilt_c"))
    sized = chunks.select(*cols, F.least(chunk, F.col("__tilt_n") - F.col("__tilt_c") * chunk).alias("__tilt_m"))
    parts = int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (sized.repartition(parts)
            .select(*cols, F.explode(F.sequence(F.lit(1), F.col("__tilt_m"))).alias("__tilt_copy"))
            .select(*cols))


def sample_fraction(df: DataFrame, fraction: float, seed: int, with_replacement: bool = False,
                    keys: Sequence[str] | None = None, salt: str | None = None, draw: str = "poisson") -> DataFrame:
    """Sample rows at ``fraction`` (may exceed 1 with replacement)."""
    if fraction < 0:
        raise ValueError(f"fraction must be >= 0, got {fraction}")
    if not keys:
        return df.sample(withReplacement=with_replacement, fraction=fraction, seed=seed)
    if not with_replacement:
        if fraction > 1:
            raise ValueError("fraction > 1 needs with_replacement=True")
        return df.filter(_draw(df, seed, keys, salt) < F.lit(fraction))
    copies, largest = copies_of(df, fraction, seed, keys, draw, salt)
    return repeat_rows(df, copies, largest)


def repeat_rows(df: DataFrame, copies: Column, largest: int) -> DataFrame:
    """Each row as often as ``copies`` says (at most ``largest`` times)."""
    n = "__tilt_copies"
    staged = df.withColumn(n, copies)
    if largest <= 1:
        return staged.filter(F.col(n) >= F.lit(1)).drop(n)
    return _expand_copies(staged, df.columns, n, largest)


def _resample_one_pass(df: DataFrame, label_col: str, keep_all: Sequence[float],
                       sampled: float, fraction: float, seed: int, keys: Sequence[str],
                       extra_for_kept: bool = False, draw: str = "poisson") -> DataFrame:
    """One scan: rows of ``keep_all`` classes stay once, rows of ``sampled``
    get their drawn copies (plus one when ``extra_for_kept``)."""
    return repeat_rows(df, *resample_copies(df, label_col, keep_all, sampled, fraction, seed, keys, extra_for_kept, draw))


def resample_copies(df: DataFrame, label_col: str, keep_all: Sequence[float],
                    sampled: float, fraction: float, seed: int, keys: Sequence[str],
                    extra_for_kept: bool = False, draw: str = "poisson") -> tuple[Column, int]:
    """Copies of each row in a resampled table, as a column, and their largest possible number."""
    lab = F.col(label_col)
    copies, largest = copies_of(df, fraction, seed, keys, draw)
    if extra_for_kept:
        copies, largest = copies + F.lit(1), largest + 1
    n = F.when(lab == F.lit(sampled), copies)
    for v in keep_all:
        n = n.when(lab == F.lit(v), F.lit(1))
    return n.otherwise(F.lit(0)), max(1, largest)


def undersample(df: DataFrame, ratio: float = 1.0, label_col: str = "class",
                seed: int = SAMPLING_SEED, keys: Sequence[str] | None = None,
                minority: float = 1.0, majority: float = 0.0,
                truncate_ratio: bool = False, draw: str = "poisson") -> DataFrame:
    """Keep every minority row; sample the majority with replacement at
    ``(n_minority / n_majority) * ratio``.

    ``truncate_ratio=True`` truncates ``ratio`` to an integer first (so 1.5
    acts as 1 and 0.5 removes the majority), as the original job did.
    """
    counts = count_by_value(df, label_col, [minority, majority])
    n_min, n_maj = counts[minority], counts[majority]
    factor = float(int(ratio)) if truncate_ratio else float(ratio)
    fraction = (float(n_min) / float(n_maj)) * factor if n_maj else 0.0
    if keys:
        return _resample_one_pass(df, label_col, [minority], majority, fraction, seed, keys, draw=draw)
    maj = df.filter(F.col(label_col) == F.lit(majority))
    mino = df.filter(F.col(label_col) == F.lit(minority))
    sampled = sample_fraction(maj, fraction, seed, with_replacement=True, keys=keys)
    return sampled.unionByName(mino)


def oversample(df: DataFrame, ratio: float = 1.0, label_col: str = "label",
               seed: int = SAMPLING_SEED, keys: Sequence[str] | None = None,
               minority: float = 1.0, majority: float = 0.0,
               keep_originals: bool = False, draw: str = "poisson") -> DataFrame:
    """Replace the minority by a with-replacement sample at
    ``(n_majority / n_minority) * ratio`` and union the majority.

    With ``keep_originals`` every minority row is kept once and the draw
    adds ``fraction - 1`` copies on top.
    """
    counts = count_by_value(df, label_col, [minority, majority])
    n_min, n_maj = counts[minority], counts[majority]
    fraction = (float(n_maj) / float(n_min)) * float(ratio) if n_min else 0.0
    if keys:
        if keep_originals and fraction > 1:
            return _resample_one_pass(df, label_col, [majority], minority, fraction - 1.0, seed, keys,
                                      extra_for_kept=True, draw=draw)
        return _resample_one_pass(df, label_col, [majority], minority, fraction, seed, keys, draw=draw)
    maj = df.filter(F.col(label_col) == F.lit(majority))
    mino = df.filter(F.col(label_col) == F.lit(minority))
    if keep_originals and fraction > 1:
        extra = sample_fraction(mino, fraction - 1.0, seed, with_replacement=True, keys=keys)
        return maj.unionByName(mino).unionByName(extra)
    return maj.unionByName(sample_fraction(mino, fraction, seed, with_replacement=True, keys=keys))


def oversample_copies(df: DataFrame, ratio: float = 1.0, label_col: str = "label", seed: int = SAMPLING_SEED,
                      keys: Sequence[str] | None = None, minority: float = 1.0, majority: float = 0.0,
                      draw: str = "poisson") -> tuple[Column, int]:
    """Copies of each row that :func:`oversample` makes, as a column, and their largest possible number.
    Without keys the draw is ``rand(seed)``, which follows the partitions."""
    counts = count_by_value(df, label_col, [minority, majority])
    n_min, n_maj = counts[minority], counts[majority]
    fraction = (float(n_maj) / float(n_min)) * float(ratio) if n_min else 0.0
    return resample_copies(df, label_col, [majority], minority, fraction, seed, keys or (), draw=draw)


def balance(df: DataFrame, label_col: str = "class", seed: int = SAMPLING_SEED,
            keys: Sequence[str] | None = None, classes: tuple[float, float] = (1.0, 0.0),
            always_sample_class0: bool = False, draw: str = "poisson") -> DataFrame:
    """Bring the larger class down to the size of the smaller (with replacement).

    The larger class is found from the counts. ``always_sample_class0``
    reproduces the original helper, which always sampled class 0 and so
    returned class 0 twice (and no class 1) when class 0 was the smaller.
    """
    a, b = classes
    counts = count_by_value(df, label_col, [a, b])
    n_a, n_b = counts[a], counts[b]
    major_n, minor_n = max(n_a, n_b), min(n_a, n_b)
    minor_val = a if n_a < n_b else b
    major_val = b if minor_val == a else a
    fraction = float(minor_n) / float(major_n) if major_n else 0.0
    sampled_val = 0.0 if always_sample_class0 else major_val
    if keys and sampled_val != minor_val:
        return _resample_one_pass(df, label_col, [minor_val], sampled_val, fraction, seed, keys, draw=draw)
    minor_df = df.filter(F.col(label_col) == F.lit(minor_val))
    sampled = sample_fraction(df.filter(F.col(label_col) == F.lit(sampled_val)), fraction, seed,
                              with_replacement=True, keys=keys, draw=draw)
    return minor_df.unionByName(sampled)


def _bands(weights: Sequence[float]) -> list[tuple[float, float]]:
    total = float(sum(weights))
    if total <= 0 or any(w < 0 for w in weights):
        raise ValueError(f"weights must be non-negative with a positive sum: {weights}")
    edges, acc = [0.0], 0.0
    for w in weights:
        acc += w / total
        edges.append(acc)
    edges[-1] = 1.0
    return list(zip(edges[:-1], edges[1:]))


def assign_split(df: DataFrame, weights: Sequence[float], seed: int,
                 keys: Sequence[str] | None = None, split_col: str = "split") -> DataFrame:
    """Add the split index (0-based) by cumulative-weight bands of one draw."""
    return df.withColumn(split_col, _band(_draw(df, seed, keys), _bands(weights)))


def _band(u: Column, bands: list[tuple[float, float]]) -> Column:
    """Index of the band that holds the draw, which is computed once a row."""
    def index(x: Column) -> Column:
        if len(bands) == 1:
            return F.lit(0)
        expr = F.when(x < F.lit(bands[0][1]), F.lit(0))
        for i in range(1, len(bands) - 1):
            expr = expr.when(x < F.lit(bands[i][1]), F.lit(i))
        return expr.otherwise(F.lit(len(bands) - 1))
    if len(bands) <= 2:
        return index(u)
    return F.get(F.transform(F.array(u), index), 0)


def random_split(df: DataFrame, weights: Sequence[float], seed: int,
                 keys: Sequence[str] | None = None) -> list[DataFrame]:
    """Split rows by weights. Native: ``randomSplit``; hash: bands of hash-u.

    The hash form evaluates one draw per row and filters by band; each
    part is a filter over the same scan (no per-partition sort).
    """
    if not keys:
        return df.randomSplit(list(weights), seed)
    bands = _bands(weights)
    u = _draw(df, seed, keys)
    if len(bands) == 2:
        return [df.filter(u < F.lit(bands[0][1])), df.filter(u >= F.lit(bands[0][1]))]
    return [df.filter(_band(u, bands) == F.lit(i)) for i in range(len(bands))]


def kfold_assign(df: DataFrame, k: int, seed: int = SPLIT_SEED_FOLDS,
                 keys: Sequence[str] | None = None, fold_col: str = "fold") -> DataFrame:
    """One ``fold`` column in ``0..k-1`` (equal bands), instead of k separate splits."""
    return assign_split(df, [1.0] * k, seed, keys, fold_col)


def kfold_complement(df: DataFrame, fold: int, fold_col: str = "fold") -> DataFrame:
    """Training rows for fold ``i``: every other fold (a filter, no union of k-1 parts)."""
    return df.filter(F.col(fold_col) != F.lit(fold))


def union_all(a: DataFrame, b: DataFrame, by_name: bool = True) -> DataFrame:
    """UNION ALL; by column name unless ``by_name=False`` (positional)."""
    return a.unionByName(b) if by_name else a.union(b)


def union_many(dfs: Sequence[DataFrame], by_name: bool = True) -> DataFrame:
    return functools.reduce(lambda x, y: union_all(x, y, by_name), dfs)
