"""Hard negatives of anchors by exact integer products of tiles.

Vectors become integers, floor(256 * x). Candidates are packed once into blocks, anchors into blocks of
their own; a block of anchors is sent to every block of candidates, so a candidate travels once. The scores
of a tile come from Strassen's recursion on int64 matrices: odd sides get a row or column of zeros, sums
and differences are exact, and the products at the leaves are exact as well (in doubles where every
partial sum stays under 2^53, else in int64, whose overflow modulo 2^64 cancels in the sums).

The first pass keeps for each anchor a heap of its best rows of the same label, the second one a heap for
each anchor and positive of the best rows of another label within the window of scores that the
positive sets. Heaps hold a few entries, ties by smaller id; heaps of one anchor merge as tiles follow
in a task, and those of different tasks merge in a window of so many rows.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part.
Vectors of different lengths are compared as if the shorter one ended in zeros. Rows that bear the anchor's id
are its own. Equal anchor rows answer once; other repeated rows each count, as positives and as negatives.
Extra columns aren't read. Empty tables give no rows. Scores must fit in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiltml.llm.common import load, materialize

CANDIDATES, ANCHORS, LEAF = 8192, 512, 16
HELD_ANCHORS = 1 << 18
NONE = np.iinfo(np.int64).min  # a place of a heap that holds nothing


def labelled(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, label, v array<long> of the rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & label.isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * 256)).alias("v"))


# --------------------------------------------------------------------------- tiles

def _narrow(x: np.ndarray) -> bytes:
    """The matrix in the smallest integers that hold it, after one byte that tells their size."""
    high = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    size = next(s for s in (1, 2, 4, 8) if high < 1 << (8 * s - 1))
    return bytes([size]) + x.astype(f"<i{size}").tobytes()


def _wide(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(rows, -1).astype(np.int64)


def packed(rows: DataFrame, blocks: int, block: str) -> DataFrame:
    """Deals rows (vec_id, label, v) evenly over ``blocks`` partitions and makes each one row: number, ids, labels, matrix; by id."""
    def pack(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            ids, labels = (np.concatenate([b.column(i).to_numpy() for b in parts]).astype("<i8") for i in (0, 1))
            sizes = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in parts])
            values = np.concatenate([b.column(2).flatten().to_numpy() for b in parts])
            matrix = np.zeros((len(ids), int(sizes.max())), np.int64)
            row = np.repeat(np.arange(len(ids)), sizes)
            matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
            order = np.argsort(ids, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([x]) for x in (
                ids[order].tobytes(), labels[order].tobytes(), _narrow(matrix[order])))], [block, f"{block}_ids", f"{block}_labels", f"{block}_v"])

    return rows.repartition(blocks).mapInArrow(pack, f"{block} int, {block}_ids binary, {block}_labels binary, {block}_v binary")


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices by seven half-sized products a step, until the smallest side is ``leaf`` or less."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        high = k * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if high < 2.0**53 else a @ b
    a, b = (np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2))) if x.shape[0] % 2 or x.shape[1] % 2 else x for x in (a, b))
    half = lambda x: (slice(0, x // 2), slice(x // 2, x))
    (a11, a12), (a21, a22) = ([a[r, c] for c in half(a.shape[1])] for r in half(a.shape[0]))
    (b11, b12), (b21, b22) = ([b[r, c] for c in half(b.shape[1])] for r in half(b.shape[0]))
    out = np.empty((a.shape[0], b.shape[1]), np.int64)
    (c11, c12), (c21, c22) = ([out[r, c] for c in half(out.shape[1])] for r in half(out.shape[0]))
    # Strassen's seven products and where they go.
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:n, :m]


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = max(a.shape[1], c.shape[1])
    a, c = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, c))
    return strassen(a, np.ascontiguousarray(c.T))


# --------------------------------------------------------------------------- heaps

def heap_of(tile: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``k`` allowed scores of each row with their ids, best first; ``ids`` ascend, so the first of equal scores has the smallest."""
    left = np.where(allowed, tile, NONE)
    best, best_ids = np.full((len(tile), k), NONE), np.zeros((len(tile), k), np.int64)
    rows = np.arange(len(tile))
    for j in range(min(k, tile.shape[1])):
        at = left.argmax(axis=1)
        best[:, j], best_ids[:, j] = left[rows, at], ids[at]
        left[rows, at] = NONE
    return best, best_ids


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The heaps of the rows that either pair of heaps saw; same size, best first, ties by smaller id."""
    k = a[0].shape[1]
    best, ids = (np.concatenate(x, axis=1) for x in zip(a, b, strict=True))
    order = np.argsort(ids, axis=1, kind="stable")
    best, ids = np.take_along_axis(best, order, 1), np.take_along_axis(ids, order, 1)
    order = np.argsort(~best, axis=1, kind="stable")[:, :k]  # ~x falls as x rises, without overflow
    return np.take_along_axis(best, order, 1), np.take_along_axis(ids, order, 1)


class _Held:
    """Heaps by block of anchors; as many anchors as ``HELD_ANCHORS`` are held before all are given out."""

    def __init__(self):
        self.heaps: dict[int, tuple] = {}
        self.rows = 0

    def add(self, block: int, heap: tuple) -> bool:
        if block in self.heaps:
            self.heaps[block] = merged(self.heaps[block], heap)
        else:
            self.heaps[block] = heap
            self.rows += len(heap[0])
        return self.rows > HELD_ANCHORS

    def given_out(self):
        """(block, rows, ranks, scores, ids) of the entries of each heap."""
        for block, (best, ids) in self.heaps.items():
            rows, at = np.nonzero(best != NONE)
            if len(rows):
                yield block, rows, at, best[rows, at], ids[rows, at]
        self.heaps, self.rows = {}, 0


def _blocks(batches, names):
    for b in batches:
        for i in range(b.num_rows):
            yield [b.column(b.schema.get_field_index(n))[i].as_py() for n in names]


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def positives_of(met: DataFrame, k: int) -> DataFrame:
    """a, place, rank, positive_id, positive_score: the best ``k`` other rows of an anchor's label."""
    def work(batches):
        held = _Held()

        def out():
            for block, rows, _, best, ids in held.given_out():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), block, np.int32)), pa.array(rows.astype(np.int32)), pa.array(ids), pa.array(best)],
                                                 ["a", "place", "positive_id", "positive_score"])

        for a, a_ids, a_labels, a_v, c_ids, c_labels, c_v in _blocks(batches, ["a", "a_ids", "a_labels", "a_v", "c_ids", "c_labels", "c_v"]):
            a_ids, a_labels, c_ids, c_labels = map(_ids, (a_ids, a_labels, c_ids, c_labels))
            allowed = (a_labels[:, None] == c_labels) & (a_ids[:, None] != c_ids)
            if held.add(a, heap_of(scores(_wide(a_v, len(a_ids)), _wide(c_v, len(c_ids))), allowed, c_ids, k)):
                yield from out()
        yield from out()

    found = met.mapInArrow(work, "a int, place int, positive_id long, positive_score long")
    order = Window.partitionBy("a", "place").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def negatives_of(met: DataFrame, k: int, n: int, low: int, high: int) -> DataFrame:
    """The best ``n`` rows of another label in each positive's window, as rows with the anchor's and the positive's ids."""
    def work(batches):
        held, about = _Held(), {}

        def out():
            for block, rows, _, best, ids in held.given_out():
                anchor, p_ids, p_scores = about[block]
                at = rows // k, rows % k
                cols = [pa.array(np.full(len(rows), block, np.int32)), pa.array(rows.astype(np.int32)), pa.array(anchor[at[0]]), pa.array(p_ids[at]), pa.array(p_scores[at]),
                        pa.array(ids), pa.array(best)]
                yield pa.RecordBatch.from_arrays(cols, ["a", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
            about.clear()

        for a, a_ids, a_labels, a_v, c_ids, c_labels, c_v, known in _blocks(batches, ["a", "a_ids", "a_labels", "a_v", "c_ids", "c_labels", "c_v", "known"]):
            a_ids, a_labels, c_ids, c_labels = map(_ids, (a_ids, a_labels, c_ids, c_labels))
            p_ids, p_scores = np.zeros((len(a_ids), k), np.int64), np.full((len(a_ids), k), NONE)
            least, most = np.ones((len(a_ids), k), np.int64), np.zeros((len(a_ids), k), np.int64)
            for x in known:
                at = x["place"], x["rank"] - 1
                p_ids[at], p_scores[at] = x["positive_id"], x["positive_score"]
                least[at], most[at] = -(-low * x["positive_score"] // 100), high * x["positive_score"] // 100
            tile = scores(_wide(a_v, len(a_ids)), _wide(c_v, len(c_ids)))
            other = a_labels[:, None] != c_labels
            heaps = [heap_of(tile, other & (tile >= least[:, j:j + 1]) & (tile <= most[:, j:j + 1]), c_ids, n) for j in range(k)]
            about[a] = (a_ids, p_ids, p_scores)
            # row of a heap: the anchor's place times k plus the positive's number
            if held.add(a, tuple(np.stack([h[i] for h in heaps], axis=1).reshape(-1, n) for i in (0, 1))):
                yield from out()
        yield from out()

    found = met.mapInArrow(work, "a int, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("a", "place").orderBy(F.desc("negative_score"), "negative_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best ``positives``, the
    best ``negatives`` rows of another label that score ``low`` to ``high`` hundredths of the positive. ``rows`` has vec_id, label, v."""
    n, m = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    n_c, n_a = max(1, -(-n // CANDIDATES)), max(1, -(-m // ANCHORS))
    candidates = materialize(packed(rows, n_c, "c"), "candidates")
    anchors = materialize(packed(rows.where(is_anchor).dropDuplicates(), n_a, "a"), "anchors")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c")
    best = positives_of(anchors.select("*", everywhere).join(candidates, "c"), positives)
    known = best.groupBy("a").agg(F.collect_list(F.struct("place", "rank", "positive_id", "positive_score")).alias("known"))  # ANCHORS * positives at most
    told = materialize(anchors.join(known, "a"), "anchors-positives")
    return negatives_of(told.select("*", everywhere).join(candidates, "c"), positives, negatives, low, high)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(labelled(load(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS n FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0)),
s AS (
  SELECT a.n, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM a JOIN v c ON c.vec_id <> a.vec_id),
p AS (
  SELECT n, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS pr
  FROM s WHERE same QUALIFY pr <= 5),
g AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.n, p.pr ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.n = p.n AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 3
"""
