"""Row-local, partition-independent uniform draws ("hash-u").

``u(key, seed) = int(md5(seed|k1|k2|...)[0:8], 16) / 2**32`` lies in [0, 1).
It depends only on the row's key values, so a sample, split or fold built
from it is the same at any partitioning, after any repartition, after an
executor is lost and its tasks rerun, and in any engine that has ``md5``
(``sql_hash_u`` is the DuckDB twin used by the oracle queries).

Keys must be integral, string, date or zone-less timestamp columns: their text
form is the same in Spark and DuckDB (doubles are not). A NULL key is a value of
its own. Zoned timestamps would follow the session's time zone: ``key_columns``
turns them into microseconds and rejects floating-point keys.

The session setting ``spark.tiltml.draw.hash`` picks the hash: ``md5``
(default; reproducible in DuckDB) or ``xxhash64`` (Spark's built-in, about
5x cheaper per row, equally deterministic and partition-independent, but
with no SQL twin). Large deployments that do not need cross-engine
reproducibility set ``xxhash64``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TWO_POW_32 = 4294967296.0
TWO_POW_53 = 9007199254740992.0
DRAW_HASH_CONF = "spark.tiltml.draw.hash"


def _draw_hash() -> str:
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    return (s.conf.get(DRAW_HASH_CONF, "md5") if s is not None else "md5").lower()


# Fixed value: the text of a NULL key in every draw (the symbol for null).
NULL_KEY = "\u2400"


def _key_cols(keys: Sequence[str | Column]) -> list[Column]:
    cols = [F.col(f"`{k}`") if isinstance(k, str) else k for k in keys]
    return [F.coalesce(c.cast("string"), F.lit(NULL_KEY)) for c in cols]


def _sql_keys(keys: Sequence[str]) -> list[str]:
    return [f"coalesce(CAST({k} AS VARCHAR), '{NULL_KEY}')" for k in keys]


def key_columns(df: DataFrame, keys: Sequence[str | Column] | None) -> list[Column]:
    """The key columns in a form whose text depends on nothing but the value."""
    out = []
    for k in keys or ():
        if not isinstance(k, str):
            out.append(k)
            continue
        kind = df.schema[k].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            raise TypeError(f"key column {k!r} is {kind.simpleString()}: its text form differs between engines")
        out.append(F.unix_micros(F.col(f"`{k}`")) if isinstance(kind, T.TimestampType) else F.col(f"`{k}`"))
    return out


def hash_u(keys: Sequence[str | Column], seed: int, salt: str | None = None) -> Column:
    """Uniform [0, 1) draw from the row's key columns and a seed.

    ``salt`` adds a constant tag (e.g. a column name) so that one row gets
    independent draws for different purposes.
    """
    parts: list[Column] = [F.lit(str(seed))] + _key_cols(keys)
    if salt is not None:
        parts.append(F.lit(salt))
    if _draw_hash() == "xxhash64":
        # top 53 bits of a 64-bit hash -> [0, 1)
        return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(TWO_POW_53)
    hexed = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(TWO_POW_32)


def sql_hash_u(keys: Sequence[str], seed: int, salt: str | None = None) -> str:
    """DuckDB expression equal to :func:`hash_u` for the same keys and seed."""
    parts = [f"'{seed}'"] + _sql_keys(keys)
    if salt is not None:
        parts.append(f"'{salt}'")
    return (f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"
            f" / {TWO_POW_32})")


DRAWS_PER_DIGEST = 4


def hash_u_block(keys: Sequence[str | Column], seed: int, block: str) -> list[Column]:
    """Four independent draws from one md5 digest (each 32-bit slice is one draw).

    Many draws per row (e.g. 30 synthetic columns) cost a quarter of the
    digests; the shared digest is computed once per row (subexpression
    elimination). In ``xxhash64`` mode each slot is its own salted draw.
    """
    if _draw_hash() == "xxhash64":
        return [hash_u(keys, seed, f"{block}.{j}") for j in range(DRAWS_PER_DIGEST)]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *_key_cols(keys), F.lit(block)))
    return [F.conv(F.substring(digest, 1 + 8 * j, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)
            for j in range(DRAWS_PER_DIGEST)]


def key_text(keys: Sequence[str | Column], seed: int) -> Column:
    """``seed|k1|k2|...``: the text every draw of a row starts from. Stage it in
    its own projection when a row needs many draws, so it is built once."""
    return F.concat_ws("|", F.lit(str(seed)), *_key_cols(keys))


def hash_u_block_from_key(key: Column, block: str) -> list[Column]:
    """:func:`hash_u_block` from a staged :func:`key_text` column (same draws)."""
    digest = digest_from_key(key, block)
    return [F.conv(F.substring(digest, 1 + 8 * j, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)
            for j in range(DRAWS_PER_DIGEST)]


def digest_from_key(key: Column, block: str) -> Column:
    """The md5 digest whose slots are the draws of :func:`hash_u_block_from_key`."""
    return F.md5(F.concat(key, F.lit("|"), F.lit(block)))


def digest_draw_at_least(digest: Column, slot: int, least: float) -> Column:
    """Whether draw ``slot`` of a digest is ``least`` or more, by comparing its eight digits as text: a draw is
    their number over 2^32, which is exact, so no digits are converted."""
    number = math.ceil(least * TWO_POW_32)
    if number <= 0 or number >= 1 << 32:
        return F.lit(number <= 0)
    return F.substring(digest, 1 + 8 * slot, 8) >= F.lit(f"{number:08x}")


def sql_hash_u_block(keys: Sequence[str], seed: int, block: str, slot: int) -> str:
    """DuckDB twin of slot ``slot`` of :func:`hash_u_block`."""
    parts = ", ".join([f"'{seed}'"] + _sql_keys(keys) + [f"'{block}'"])
    return (f"(('0x' || substr(md5(concat_ws('|', {parts})), {1 + 8 * slot}, 8))::BIGINT"
            f" / {TWO_POW_32})")


# The draws have 32 bits: probabilities under half a step don't show.
_STEP = 2.0**-33

# The largest mean that one draw stands for. A count of a larger mean is the sum of the counts of several
# draws with equal shares of it, so the table below has some 35 values at most.
POISSON_MEAN = 8.0


def poisson_parts(fraction: float) -> tuple[int, float]:
    """Number of draws of a Poisson count with mean ``fraction``, and the mean of each."""
    draws = max(1, math.ceil(fraction / POISSON_MEAN))
    return draws, fraction / draws


def poisson_table(mean: float) -> list[float]:
    """cdf(0), cdf(1), ... of a Poisson variable with a mean up to ``POISSON_MEAN``: the count of a draw u
    is the number of values up to u."""
    if not 0 <= mean <= POISSON_MEAN:
        raise ValueError(f"one draw stands for a mean of 0 to {POISSON_MEAN}, got {mean}")
    out, total = [], 0.0
    while mean > 0:
        k = len(out)
        total += math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
        if total >= 1.0 - _STEP:
            break
        out.append(total)
    return out


def poisson_copies(u: Column, mean: float) -> Column:
    """Copies that one draw gives: a Poisson count by inverse distribution, as the native sampler
    draws it (rows may be lost, rows may come several times). Small counts come first in the CASE."""
    table = poisson_table(mean)
    if not table:
        return F.lit(0)
    out = F.when(u < F.lit(table[0]), F.lit(0))
    for k, t in enumerate(table[1:], 1):
        out = out.when(u < F.lit(t), F.lit(k))
    return out.otherwise(F.lit(len(table)))


def _bound(x: Column, use) -> Column:
    """``use(x)`` with ``x`` computed once, however often ``use`` refers to it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(x), use), 0)


def poisson_count(u: Column, key: Column, fraction: float) -> tuple[Column, int]:
    """Copies of a row for sampling *with replacement* at ``fraction``, and their largest possible number.

    Up to ``POISSON_MEAN`` the row's draw ``u`` decides. Beyond, the draws come four a hash of the row's ``key`` text and a
    block number, and their counts are added up; neither the plan nor a task's memory grows with the fraction,
    the work of a row does, as its copies do. md5 draws are counted on Arrow batches, as the lambdas that Spark interprets take
    some ten times as long.
    """
    draws, mean = poisson_parts(fraction)
    largest = draws * len(poisson_table(mean))
    if draws == 1:
        return _bound(u, lambda x: poisson_copies(x, mean)), largest
    if _draw_hash() != "xxhash64":
        return _poisson_sums(draws, mean)(key), largest
    blocks = -(-draws // DRAWS_PER_DIGEST)
    inner = math.isqrt(blocks - 1) + 1
    zero = F.lit(0).cast("long")
    plus = lambda a, x: a + x

    def block(k: Column, b: Column) -> Column:
        places = F.sequence(F.lit(0), F.least(F.lit(DRAWS_PER_DIGEST - 1), F.lit(draws - 1) - b * DRAWS_PER_DIGEST).cast("int"))
        us = F.transform(places, lambda j: F.shiftrightunsigned(F.xxhash64(k, b, j), 11).cast("double") / F.lit(TWO_POW_53))
        return F.aggregate(F.transform(us, lambda x: poisson_copies(x, mean).cast("long")), zero, plus)

    def row(k: Column) -> Column:
        def some(o: Column) -> Column:
            last = F.least(F.lit(inner - 1).cast("long"), F.lit(blocks - 1) - o * inner)
            return F.aggregate(F.sequence(zero, last), zero, lambda a, i: a + block(k, o * inner + i))
        return F.aggregate(F.sequence(zero, F.lit((blocks - 1) // inner).cast("long")), zero, lambda a, o: a + some(o))

    return _bound(key, row), largest


# Digests that a task holds at once while it counts draws.
_DIGESTS = 1 << 14


def _poisson_sums(draws: int, mean: float):
    """UDF: the sum of ``draws`` Poisson counts from the md5 digests of a row's key text and the block numbers."""
    table = np.array(poisson_table(mean)) * TWO_POW_32
    blocks = -(-draws // DRAWS_PER_DIGEST)

    @F.pandas_udf("long")
    def sums(keys: pd.Series) -> pd.Series:
        starts = [f"{k}|poisson|".encode() for k in keys]
        out = np.zeros(len(starts), np.int64)
        for first in range(0, blocks, _DIGESTS):
            ends = [str(b).encode() for b in range(first, min(blocks, first + _DIGESTS))]
            wanted = min(draws - first * DRAWS_PER_DIGEST, len(ends) * DRAWS_PER_DIGEST)
            rows = max(1, _DIGESTS // len(ends))
            for low in range(0, len(starts), rows):
                some = starts[low:low + rows]
                data = b"".join([md5(s + e).digest() for s in some for e in ends])
                us = np.frombuffer(data, ">u4").reshape(len(some), -1)[:, :wanted].astype(np.float64)
                out[low:low + rows] += np.searchsorted(table, us.ravel(), side="right").reshape(us.shape).sum(axis=1)
        return pd.Series(out)

    return sums


def sql_poisson_ctes(fraction_from: str, tag: str = "", values: int = 60) -> str:
    """DuckDB CTE ``pt`` (with ``tag`` behind its name) with ``draws`` and the list ``cdf`` of :func:`poisson_table`;
    ``fraction_from`` is a CTE with one row and a column ``frac``."""
    term = "exp(-mean + k * ln(mean) - lgamma(k + 1))"
    return (f"pd{tag} AS (SELECT *, frac / draws AS mean FROM (SELECT frac, greatest(1, ceil(frac / {POISSON_MEAN!r}))::BIGINT AS draws FROM {fraction_from})), "
            f"pk{tag} AS (SELECT k, sum({term}) OVER (ORDER BY k) AS c FROM (SELECT mean FROM pd{tag} WHERE mean > 0), range({values}) AS r(k)), "
            f"pt{tag} AS (SELECT (SELECT draws FROM pd{tag}) AS draws, coalesce(list(c ORDER BY k) FILTER (c < 1.0 - {_STEP!r}), []) AS cdf FROM pk{tag})")


def sql_poisson_copies(keys: Sequence[str], seed: int, salt: str | None = None) -> str:
    """DuckDB twin of :func:`poisson_count` with the draws of :func:`hash_u`, with ``pt`` in the FROM clause."""
    key = ", ".join([f"'{seed}'", *_sql_keys(keys), *([f"'{salt}'"] if salt is not None else [])])
    draw = f"(('0x' || substr(md5(concat_ws('|', {key}, 'poisson', j // {DRAWS_PER_DIGEST})), 1 + 8 * (j % {DRAWS_PER_DIGEST}), 8))::BIGINT / {TWO_POW_32})"
    many = f"list_sum(list_transform(range(0, draws), lambda j: len(list_filter(cdf, lambda t: t <= {draw}))))"
    return f"CASE WHEN draws = 1 THEN len(list_filter(cdf, lambda t: t <= {sql_hash_u(keys, seed, salt)})) ELSE {many} END::BIGINT"


def systematic_copies(u: Column, fraction: float) -> tuple[Column, int]:
    """``floor(f) + (u < f - floor(f))`` copies: the mean of a Poisson draw with less variance. Rows
    repeat only above a fraction of 1, and none is lost there."""
    whole = int(fraction // 1)
    rest = fraction - whole
    return F.lit(whole) + F.when(u < F.lit(rest), F.lit(1)).otherwise(F.lit(0)), whole + (rest > 0)
