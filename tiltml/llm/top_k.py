"""Exact top-k inner products by columnar branch and bound.

Vectors become integers, floor(256 * x). Candidates are packed into blocks in vertical layout
(one row a dimension, in the fewest bytes that hold the block's numbers), queries into blocks of their own, and every pair
of blocks is met once by a sort-merge join on its two numbers, so no table goes through the driver; a pair is one bounded unit of work. In it, scores are added up
dimension block by dimension block, the heaviest dimensions first. What the dimensions left can
still add is at most the product of the remaining norms, so a candidate whose partial score and
bound stay under the query's k-th best known score is dropped, and the survivors are compacted.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor
do rows with a null id. Vectors of different lengths are compared as if the shorter one ended in
zeros. Candidates that bear the query's id are its own row. Equal query rows answer once; other
repeated rows each count. Ties go to the smaller id. Empty tables give no rows. Scores must fit in
64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiltml.llm.common import load

CANDIDATES, QUERIES, DIMENSIONS = 4096, 4096, 16


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v array<long> of the rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * 256)).alias("v"))


def narrowed(matrix: np.ndarray) -> bytes:
    """The matrix in the narrowest integers that hold it, behind one byte with their size."""
    low, high = matrix.min(initial=0), matrix.max(initial=0)
    size = next(n for n in (1, 2, 4, 8) if n == 8 or (low >= -(1 << 8 * n - 1) and high < 1 << 8 * n - 1))
    return bytes([size]) + matrix.astype(f"<i{size}").tobytes()


def widened(data: bytes, columns: int) -> np.ndarray:
    """The matrix of :func:`narrowed`, as 64-bit integers."""
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(-1, columns)


def packed(rows: DataFrame, blocks: int, block: str, names: tuple[str, str, str]) -> DataFrame:
    """Deals rows evenly over ``blocks`` partitions and makes each one row: number, ids, dimensions by rows."""
    def pack(batches):
        ids, values, sizes = [], [], []
        for b in batches:
            if b.num_rows:
                ids.append(b.column(0).to_numpy())
                flat = b.column(1)
                values.append(flat.flatten().to_numpy())
                sizes.append(np.diff(flat.offsets.to_numpy()))
        if ids:
            size = np.concatenate(sizes)
            matrix = np.zeros((int(size.max()), len(size)), "<i8")
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            matrix[place, row] = np.concatenate(values)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.concatenate(ids).astype("<i8").tobytes()]),
                                              pa.array([narrowed(matrix)])], [block, *names[:2]])

    return rows.repartition(blocks).mapInArrow(pack, f"{block} int, {names[0]} binary, {names[1]} binary")


def block_top_k(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, step: int = DIMENSIONS) -> list[tuple[int, int, int]]:
    """(query's place, candidate id, score) of the k best candidates of each query in one pair of
    blocks. ``q`` and ``c`` are vertical: one row a dimension."""
    d = max(len(q), len(c))
    q, c = (np.pad(x, ((0, d - len(x)), (0, 0))) for x in (q, c))
    exact = np.float64 if d * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2.0**52 else np.int64
    q, c = q.astype(exact), c.astype(exact)
    heavy = np.argsort(-np.square(c.astype(np.float64)).sum(axis=1), kind="stable")
    q, c = np.ascontiguousarray(q[heavy]), np.ascontiguousarray(c[heavy])
    edges = [*range(0, d, step), d]
    # rest_*[i]: norm of the dimensions from edge i on
    rest_q, rest_c = ([np.sqrt(np.square(x[e:].astype(np.float64)).sum(axis=0)) for e in edges] for x in (q, c))
    out: list[tuple[int, int, int]] = []
    for first in range(0, q.shape[1], 64):
        some = slice(first, first + 64)
        start = q[:edges[1], some].T @ c[:edges[1]] if d else np.zeros((len(q_ids[some]), len(c_ids)), exact)
        for j in range(start.shape[0]):
            n = first + j
            part, alive = start[j], None
            bound = rest_q[1][n] * rest_c[1] if d else np.zeros(len(c_ids))
            other = c_ids != q_ids[n]
            best = np.where(other, part + bound, -np.inf)
            seeds = np.flatnonzero(other) if len(best) <= 4 * k else np.argpartition(best, -4 * k)[-4 * k:]
            seeds = seeds[other[seeds]]
            if not len(seeds):
                continue
            full = q[:, n] @ c[:, seeds]
            least = float(np.sort(full)[-k]) if len(full) >= k else -np.inf
            keep = lambda p, b: p + b * (1 + 1e-9) + 1 + 1e-9 * np.abs(p) >= least
            alive = np.flatnonzero(other & keep(part, bound))
            part = part[alive]
            for i in range(1, len(edges) - 1):
                part = part + q[edges[i]:edges[i + 1], n] @ c[edges[i]:edges[i + 1], alive]
                stay = keep(part, rest_q[i + 1][n] * rest_c[i + 1][alive])
                alive, part = alive[stay], part[stay]
            top = np.lexsort((c_ids[alive], -part))[:k]
            out += [(n, int(c_ids[a]), int(s)) for a, s in zip(alive[top], part[top], strict=True)]
    return out


def top_k(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query among all other rows of ``rows`` (vec_id, v)."""
    n, m = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    n_c, n_q = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    numbers = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    candidates = packed(rows, n_c, "c", ("c_ids", "c_v", "c")).select("c", "c_ids", "c_v", numbers(n_q, "q"))
    queries = packed(rows.where(is_query).dropDuplicates(), n_q, "q", ("q_ids", "q_v", "q")).select("q", "q_ids", "q_v", numbers(n_c, "c"))

    def work(batches):
        for b in batches:
            for q_no, *data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                q_ids, c_ids = np.frombuffer(data[0], "<i8"), np.frombuffer(data[2], "<i8")
                q, c = widened(data[1], len(q_ids)), widened(data[3], len(c_ids))
                found = block_top_k(q_ids, q, c_ids, c, k)
                place = np.array([x[0] for x in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), q_no, np.int32)), pa.array(place), pa.array(q_ids[place], pa.int64()), pa.array([x[1] for x in found], pa.int64()),
                     pa.array([x[2] for x in found], pa.int64())], ["q", "place", "query_id", "vec_id", "score"])

    # a broadcast of either side would grow with the product of both through the driver
    met = queries.hint("merge").join(candidates, ["q", "c"]).select("q", "q_ids", "q_v", "c_ids", "c_v")
    found = met.mapInArrow(work, "q int, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantised(load(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
