"""Exact order statistics without sorting or collecting the column.

``exact_quantile`` narrows the value range by histogram refinement: each
pass is one aggregate ``groupBy(bucket).agg(count, min, max)`` over the
rows still in range (map-side partial aggregation, ``buckets`` rows
shuffled per task), then the range shrinks to the bucket holding the
target ranks. It stops when the ranks fall into two buckets (whose touching
ends they are), when at most ``max_collect`` values remain (those few are
brought to the driver and indexed) or when the range collapses to a single
value, which also covers one value holding a third of all rows.
The full input is read twice (count/min/max, first histogram); the rows
still in range after that (about 1/``buckets`` of them) are persisted and
later passes read only those.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kth_values(df: DataFrame, ranks: tuple[int, int], lo: float, hi: float,
                buckets: int, max_collect: int) -> tuple[float, float]:
    """Values at two ranks that are equal or neighbours, among the finite ``__q`` in [lo, hi].

    A pass either ends (one value left, few rows left, or the ranks fall into two
    buckets, whose touching ends they are) or goes on in one bucket. The
    smallest and the largest value lie in different buckets, so that one is narrower.
    """
    from pyspark import StorageLevel
    v = F.col("__q")
    below = 0                                       # rows strictly under the current range
    source, cached = df, None
    try:
        while lo < hi:
            in_range = source.filter(v.between(F.lit(lo), F.lit(hi)))
            # halves, so that the width of a huge range doesn't overflow
            share = (v / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
            b = F.when(v >= F.lit(hi), F.lit(buckets - 1)).when(v <= F.lit(lo), F.lit(0)).otherwise(
                F.least(F.floor(share * F.lit(buckets)), F.lit(buckets - 1)).cast("int"))
            hist = sorted(tuple(r) for r in in_range.groupBy(b.alias("b"))
                          .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("mn"), F.max(v).alias("mx")).collect())
            if sum(h[1] for h in hist) <= max_collect:
                vals = sorted(r[0] for r in in_range.select(v).collect())
                return vals[ranks[0] - below], vals[ranks[1] - below]
            acc, holding = below, []
            for _, n, mn, mx in hist:
                holding += [(mn, mx, acc) for k in ranks if acc <= k < acc + n]
                acc += n
            first, last = holding
            if first != last:
                return first[1], last[0]
            if (first[0], first[1]) == (lo, hi):
                raise AssertionError("the range didn't shrink")
            lo, hi, below = first
            if cached is None:
                # later passes read only the rows left in range (about 1/buckets of the input)
                cached = df.filter(v.between(F.lit(lo), F.lit(hi))).persist(StorageLevel.MEMORY_AND_DISK)
                source = cached
        return lo, lo
    finally:
        if cached is not None:
            cached.unpersist()


def exact_quantile(df: DataFrame, value: str | Column, q: float = 0.5, buckets: int = 4096,
                   max_collect: int = 100_000) -> float | None:
    """Exact ``percentile(value, q)`` with linear interpolation (NULLs and NaNs ignored).

    Matches ``percentile``/``median`` in Spark SQL and ``quantile_cont`` in
    DuckDB, using passes of bounded aggregates instead of one task holding
    every distinct value. Infinities take their ranks at the ends.
    """
    if buckets < 2:
        raise ValueError("at least 2 buckets")
    v = F.col(value) if isinstance(value, str) else value
    data = df.select(v.cast("double").alias("__q")).filter(F.col("__q").isNotNull() & ~F.isnan("__q"))
    inf = F.lit(float("inf"))
    finite = F.abs("__q") < inf
    stats = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__q") == -inf).alias("under"), F.count_if(finite).alias("inside"),
                     F.min(F.when(finite, F.col("__q"))).alias("lo"), F.max(F.when(finite, F.col("__q"))).alias("hi")).first()
    n, under, inside = stats["n"], stats["under"], stats["inside"]
    if n == 0:
        return None
    pos = (n - 1) * q
    ranks = (math.floor(pos), math.ceil(pos))
    at = [k - under for k in ranks]
    values = [float("-inf") if k < 0 else float("inf") for k in at]
    known = [i for i, k in enumerate(at) if 0 <= k < inside]
    if known:
        pair = (at[known[0]], at[known[-1]])
        found = _kth_values(data.filter(finite), pair, stats["lo"], stats["hi"], buckets, max_collect)
        values[known[0]], values[known[-1]] = found
    lower, upper = values
    if lower == upper:
        return lower
    return (ranks[1] - pos) * lower + (pos - ranks[0]) * upper


def exact_median(df: DataFrame, value: str | Column, **kw) -> float | None:
    return exact_quantile(df, value, 0.5, **kw)
