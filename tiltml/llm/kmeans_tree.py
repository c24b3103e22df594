"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on a sample of about ``SAMPLE`` distinct vectors (all, if there are fewer): each node
splits its vectors by k-means into up to ``BRANCH`` children until ``2 * LEAF_ROWS`` or fewer are left. Every row
of the table is then led to one leaf, by the nearest centre at each level, and the rows of a leaf are packed
into blocks of about ``BLOCK`` rows, so that a leaf that holds a third of all rows is many units of work.

A query goes through the tree best bin first: a priority queue holds the nodes seen so far by the inner product
that their best members may reach (that of the centre, and twice the spread along the query), and gives
out leaves in that order. How many leaves are visited is calibrated: for ``CALIBRATION`` query vectors the exact
neighbours come from one scan of the index, and the visits are widened until their leaves hold ``RECALL`` of them.
The first eighth of the visits gives each query a score that later leaves must beat; queries that have
found too few rows then widen to all leaves, so nobody gets fewer rows than there are.

Equal vectors are searched once: as queries they share a search, and of the rows with equal vectors
those of the ``k + 1`` smallest ids are indexed, with their number, since no other one can be among the first k
of any query (ties go to the smaller id). Scores are sums in the order of the dimensions, in double precision.

Defined cases: rows with a null id, and vectors that are null, zero (or empty) or hold null or non-finite
components, take no part. Vectors of different lengths are compared as if the shorter one ended in zeros. Rows that bear
the query's id are its own. Equal query rows answer once; other repeated rows each count. Extra columns
aren't read. Empty tables give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiltml.llm.common import load, materialize

SAMPLE, BRANCH, LEAF_ROWS, BLOCK = 8192, 16, 32, 4096
CALIBRATION, RECALL, FIRST = 256, 0.95, 8
QUERIES = 1024  # queries routed, and met by a block, at once
BLOCKS = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


# --------------------------------------------------------------------------- tree

class Tree:
    """Centres, spreads and children of the nodes (0 is the root); ``leaf[node]`` numbers the leaves, -1 for inner nodes."""

    def __init__(self, vectors: np.ndarray, seed: int = 42):
        self.centres: list[np.ndarray] = []
        self.spread: list[float] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(vectors, np.random.default_rng(seed))
        self.points = np.stack(self.centres)
        self.wide = np.array(self.spread)

    def _grow(self, x: np.ndarray, rng) -> int:
        node = len(self.centres)
        centre = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.centres.append(centre)
        self.spread.append(float(np.sqrt(np.square(x - centre).mean())) if x.size else 0.0)
        self.children.append([])
        self.leaf.append(-1)
        parts = k_means(x, min(BRANCH, -(-len(x) // LEAF_ROWS)), rng) if len(x) > 2 * LEAF_ROWS else []
        if len(parts) < 2:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
        else:
            self.children[node] = [self._grow(p, rng) for p in parts]
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the child with the nearest centre at every level, the first of equal ones."""
        x = _fitted(x, self.points.shape[1])
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0 or not len(rows):
                out[rows] = max(self.leaf[node], 0)
                continue
            centres = self.points[self.children[node]]
            nearest = (np.square(centres).sum(axis=1) - 2.0 * x[rows] @ centres.T).argmin(axis=1)
            todo += [(child, rows[nearest == i]) for i, child in enumerate(self.children[node])]
        return out

    def visits(self, x: np.ndarray, most: int) -> list[list[int]]:
        """The first ``most`` leaves of each query, best bin first."""
        x = _fitted(x, self.points.shape[1])
        reach = x @ self.points.T + 2.0 * np.sqrt(np.square(x).sum(axis=1))[:, None] * self.wide
        out = []
        for own in (-reach).tolist():
            queue, found = [(own[0], 0)], []
            while queue and len(found) < most:
                _, node = heapq.heappop(queue)
                if self.leaf[node] >= 0:
                    found.append(self.leaf[node])
                for child in self.children[node]:
                    heapq.heappush(queue, (own[child], child))
            out.append(found)
        return out


def k_means(x: np.ndarray, k: int, rng, rounds: int = 12) -> list[np.ndarray]:
    """The parts of ``x`` by Lloyd's rounds from seeded rows; parts that fall empty are left out."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = (np.square(centres).sum(axis=1) - 2.0 * x @ centres.T).argmin(axis=1)
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    nearest = (np.square(centres).sum(axis=1) - 2.0 * x @ centres.T).argmin(axis=1)
    return [x[nearest == i] for i in range(k) if (nearest == i).any()]


def _fitted(x: np.ndarray, d: int) -> np.ndarray:
    return x[:, :d] if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones ending in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == sizes[0]).all():
        return values.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _coded(x: np.ndarray) -> bytes:
    """The matrix in single precision if that holds it, else in double, after one byte that tells which."""
    small = x.astype("<f4")
    return b"\x04" + small.tobytes() if np.array_equal(small, x) else b"\x08" + x.astype("<f8").tobytes()


def _decoded(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<f{data[0]}", offset=1).reshape(rows, -1).astype(np.float64)


# --------------------------------------------------------------------------- tiles

def best_pairs(q: np.ndarray, floor: np.ndarray, c: np.ndarray, ids: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, candidate's row, score) of a tile, by query and rank: what can be among the first k of the query whichever id is its own,
    that is the best rows of the k + 1 first different ids, k rows an id at most, unless they score under ``floor``."""
    if not len(q) or not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    d = max(q.shape[1], c.shape[1])
    q, c = _fitted(q, d), _fitted(c, d)
    near = q @ c.T
    some = min(len(c), k + 1)
    slack = 1e-12 * np.sqrt(np.square(q).sum(axis=1) * np.square(c).sum(axis=1).max())
    single = len(np.unique(ids)) == len(ids)
    least = np.partition(near, len(c) - some, axis=1)[:, len(c) - some] if single else np.full(len(q), -np.inf)
    row, col = np.nonzero(near >= (np.maximum(floor, least) - slack)[:, None])
    exact = np.zeros(len(row))
    for j in range(d):
        exact += q[row, j] * c[col, j]
    stay = exact >= floor[row]
    row, col, exact = row[stay], col[stay], exact[stay]
    order = np.lexsort((ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    if single:
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place <= k
    else:
        keep = np.zeros(len(row), bool)
        seen: dict = {}
        for i, (r, x) in enumerate(zip(row.tolist(), ids[col].tolist(), strict=True)):
            if not i or row[i - 1] != r:
                seen = {}
            if x in seen or len(seen) <= k:
                seen[x] = seen.get(x, 0) + 1
                keep[i] = seen[x] <= k
    return row[keep], col[keep], exact[keep]


# --------------------------------------------------------------------------- index

def points(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v, copies: the different rows that take part, and how often each one is there."""
    v = F.col(f"`{vector_col}`")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, number) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.where(good).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    return rows.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))


def fit_tree(rows: DataFrame, n: int, seed: int = 42) -> Tree:
    share = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "v"), 11) / F.lit(2.0**53)
    sample = rows.where(share < F.lit(min(1.0, SAMPLE / max(n, 1)))).select("v").distinct().toArrow().column(0).combine_chunks()
    x = _matrix(sample if isinstance(sample, pa.ListArray) else sample.chunk(0)) if len(sample) else np.zeros((0, 1))
    return Tree(x[np.lexsort(x.T[::-1])], seed)


def indexed(rows: DataFrame, tree: Tree, k: int) -> tuple[DataFrame, DataFrame]:
    """(blocks of packed rows: leaf, block, ids, copies, v; leaf and its number of blocks)."""
    own = rows.withColumn("i", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("i") <= k + 1)

    def lead(batches):
        for b in batches:
            leaf = tree.assign(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *(b.column(i) for i in range(3))], ["leaf", "vec_id", "copies", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    led = own.select("vec_id", F.least("copies", F.lit(k)).alias("copies"), "v").mapInArrow(lead, f"leaf int, vec_id long, copies long, v {kind}")
    led = materialize(led, "tree-rows")
    sizes = materialize(led.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "tree-leaves")  # one row a leaf of the tree
    dealt = led.join(F.broadcast(sizes), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int"))
    dealt = dealt.select("leaf", "block", "vec_id", "copies", "v").repartition("leaf", "block").sortWithinPartitions("leaf", "block", "vec_id", "v")

    def pack(batches):
        held, key = [], None

        def row():
            x = [_matrix(p.column(4)) for p in held]
            d = max(p.shape[1] for p in x)
            ids, copies = (np.concatenate([p.column(i).to_numpy() for p in held]).astype("<i8").tobytes() for i in (2, 3))
            data = [key[0], key[1], ids, copies, _coded(np.concatenate([_fitted(p, d) for p in x]))]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(data, BLOCKS, strict=True)], ["leaf", "block", "ids", "copies", "v"])

        for b in batches:
            leaf, block = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(leaf) != 0) | (np.diff(block) != 0)) + 1), b.num_rows]
            for start, end in zip(edges, edges[1:], strict=False):
                if start < end:
                    now = int(leaf[start]), int(block[start])
                    if held and now != key:
                        yield row()
                        held = []
                    key = now
                    held.append(b.slice(start, end - start))
        if held:
            yield row()

    return materialize(dealt.mapInArrow(pack, "leaf int, block int, ids binary, copies binary, v binary"), "tree-blocks"), sizes


def _block(ids: bytes, copies: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(copies, "<i8"), _decoded(v, len(ids))


# --------------------------------------------------------------------------- search

def merged(found: DataFrame, k: int) -> DataFrame:
    """q, entries (score, vec_id, copies; best first), different: of each query the best rows of its k + 1 first ids, k rows an id at most."""
    by_id = Window.partitionBy("q", "vec_id").orderBy(F.desc("score"))
    ranked = found.repartition("q").withColumn("own", F.row_number().over(by_id)).where(F.col("own") <= k)
    so_far = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "own").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("different", F.sum(F.when(F.col("own") == 1, 1).otherwise(0)).over(so_far)).where(F.col("different") <= k + 1)
    entry = F.struct((-F.col("score")).alias("less"), "vec_id", "own", "score", "copies")
    return ranked.groupBy("q").agg(F.sort_array(F.collect_list(entry)).alias("e"), F.max("different").cast("int").alias("different")).select(
        "q", F.transform("e", lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"), x["copies"].alias("copies"))).alias("entries"), "different")


FOUND = "q string, score double, vec_id long, copies long"


def searched(routes: DataFrame, blocks: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """q, score, vec_id, copies from the leaves in ``routes`` (q, v, floor, leaves)."""
    def route(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, QUERIES):
                b = whole.slice(start, QUERIES)
                x, floor, names = _matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False), b.column(0).to_pylist()
                of: dict[int, list[int]] = {}
                for i, leaves in enumerate(b.column(3).to_pylist()):
                    for leaf in leaves:
                        of.setdefault(leaf, []).append(i)
                for leaf, own in of.items():
                    yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int32()), pa.array([[names[i] for i in own]]), pa.array([floor[own].astype("<f8").tobytes()]),
                                                      pa.array([_coded(x[own])])], ["leaf", "q", "floor", "x"])

    def work(batches):
        for b in batches:
            for i in range(b.num_rows):
                names, floor, x, *block = (b.column(b.schema.get_field_index(n))[i].as_py() for n in ("q", "floor", "x", "ids", "copies", "v"))
                ids, copies, c = _block(*block)
                row, col, score = best_pairs(_decoded(x, len(names)), np.frombuffer(floor, "<f8"), c, ids, copies, k)
                yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(row)), pa.array(score), pa.array(ids[col]), pa.array(copies[col])], ["q", "score", "vec_id", "copies"])

    pieces = routes.select("q", "v", "floor", "leaves").mapInArrow(route, "leaf int, q array<string>, floor binary, x binary")
    everywhere = pieces.join(F.broadcast(sizes), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return everywhere.join(blocks, ["leaf", "block"]).mapInArrow(work, FOUND)


def calibrated(tree: Tree, queries: DataFrame, blocks: DataFrame, k: int, recall: float) -> int:
    """The number of leaves to visit, from the exact neighbours of ``CALIBRATION`` query vectors (query_id, q, v)."""
    some = queries.groupBy("q").agg(F.min("query_id").alias("query_id"), F.first("v").alias("v")).orderBy(F.xxhash64("q"), "q").limit(CALIBRATION).toArrow()
    if not some.num_rows:
        return 1
    vectors = some.column("v").combine_chunks()
    x, own = _matrix(vectors), some.column("query_id").to_numpy()

    def scan(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32))  # row, id, score, leaf
        floor = np.full(len(x), -np.inf)
        for b in batches:
            for i in range(b.num_rows):
                leaf, *block = (b.column(b.schema.get_field_index(n))[i].as_py() for n in ("leaf", "ids", "copies", "v"))
                ids, copies, c = _block(*block)
                row, col, score = best_pairs(x, floor, c, ids, copies, k)
                other = ids[col] != own[row]
                new = row[other], ids[col[other]], score[other], np.full(other.sum(), leaf, np.int32)
                both = [np.concatenate(p) for p in zip(held, new, strict=True)]
                order = np.lexsort((both[1], -both[2], both[0]))
                both = [p[order] for p in both]
                place = np.arange(len(order)) - np.searchsorted(both[0], both[0])
                held = tuple(p[place < k] for p in both)
                floor[both[0][place == k - 1]] = both[2][place == k - 1]
        yield pa.RecordBatch.from_arrays([pa.array(p) for p in held], ["row", "vec_id", "score", "leaf"])

    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    exact = blocks.mapInArrow(scan, "row long, vec_id long, score double, leaf int").withColumn("i", F.row_number().over(best)).where(F.col("i") <= k)
    order = [{leaf: i for i, leaf in enumerate(leaves)} for leaves in tree.visits(x, tree.leaves)]
    places = np.array([order[r["row"]][r["leaf"]] for r in exact.select("row", "leaf").collect()], np.int64)  # k * CALIBRATION at most
    visits = 1
    while visits < tree.leaves and len(places) and (places < visits).mean() < recall:
        visits += 1
    return visits


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows found for each query; ``is_query`` speaks of ``vec_id``."""
    rows = materialize(points(vectors, id_col, vector_col), "tree-points")
    tree = fit_tree(rows, rows.count())
    blocks, sizes = indexed(rows, tree, k)
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.md5(F.concat_ws(",", F.col("v").cast("array<string>"))).alias("q"), "v")
    visits = calibrated(tree, queries, blocks, k, recall)

    def routed(x: DataFrame, most: int, skip: int) -> DataFrame:
        """q, v, floor and the leaves that come after the first ``skip`` ones."""
        def lead(batches):
            for whole in batches:
                for start in range(0, whole.num_rows, QUERIES):
                    b = whole.slice(start, QUERIES)
                    leaves = [own[skip:] for own in tree.visits(_matrix(b.column(1)), most)]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(leaves, pa.list_(pa.int32()))], ["q", "v", "floor", "leaves"])
        kind = rows.schema["v"].dataType.simpleString()
        return x.select("q", "v", "floor").mapInArrow(lead, f"q string, v {kind}, floor double, leaves array<int>")

    distinct = materialize(queries.groupBy("q").agg(F.first("v").alias("v")), "tree-queries")
    lists, before = None, 0
    for most in dict.fromkeys((-(-visits // FIRST), visits, tree.leaves)):
        state = distinct.withColumn("floor", F.lit(float("-inf")))
        if lists is not None:
            known = lists.select("q", F.col("different").alias("n"), F.element_at("entries", -1)["score"].alias("last"))
            state = distinct.join(known, "q", "left").withColumn("floor", F.when(F.col("n") > k, F.col("last")).otherwise(float("-inf")))
            if before >= visits:  # those that found too few
                state = state.where(F.coalesce(F.col("n"), F.lit(0)) <= k)
                if state.isEmpty():
                    break
        found = searched(routed(state, most, before), blocks, sizes, k)
        if lists is not None:
            found = found.unionByName(lists.select("q", F.explode("entries").alias("e")).select("q", "e.*"))
        lists, before = materialize(merged(found, k), "tree-lists"), most
    other = F.filter("entries", lambda x: x["vec_id"] != F.col("query_id"))
    each = F.flatten(F.transform(F.slice(other, 1, k), lambda x: F.array_repeat(x, x["copies"].cast("int"))))
    answers = queries.select("query_id", "q").join(lists.select("q", "entries"), "q").select("query_id", F.posexplode(F.slice(each, 1, k)).alias("i", "e"))
    return answers.select("query_id", (F.col("i") + 1).alias("rank"), "e.vec_id", "e.score")


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
