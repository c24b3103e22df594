import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltml.llm import kmeans_tree as T
from tiltml.llm.queries import QUERIES


def brute_force(rows, k=20, step=20):
    """{(query_id, vector): [(score, vec_id)]}, best first; sums in the order of the dimensions."""
    good = [(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    d = max((len(v) for _, v in good), default=0)
    padded = {r: np.array(r[1] + (0.0,) * (d - len(r[1]))) for r in set(good)}
    matrix = np.array([padded[r] for r in good]).reshape(len(good), d)
    out = {}
    for i, v in set(good):
        if i % step == 0:
            scores = np.zeros(len(good))
            for j in range(d):
                scores += padded[i, v][j] * matrix[:, j]
            out[i, v] = sorted((-s, j) for s, (j, _) in zip(scores.tolist(), good, strict=True) if j != i)[:k]
    return out


def rows_of(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]


def result_of(df):
    out = {}
    for r in sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()):
        out.setdefault(r[0], []).append(r[1:])
    return out


def checked_recall(rows, got, k=20):
    """Share of the exact neighbours found; every row's score, order and ranks hold, and nobody gets too few."""
    exact, found, all_ = brute_force(rows, k), 0, 0
    by_id = {}
    for i, v in rows:
        by_id.setdefault(i, []).append(v)
    for (i, v), want in exact.items():
        own = got.get(i, [])
        assert [r[0] for r in own] == list(range(1, len(want) + 1))
        assert [(-s, j) for _, j, s in own] == sorted((-s, j) for _, j, s in own)
        for _, j, s in own:
            assert j != i and any(s == sum_in_order(v, x) for x in by_id[j])
        left = [(j, -s) for s, j in want]
        for _, j, s in own:
            if (j, s) in left:
                left.remove((j, s))
                found += 1
        all_ += len(want)
    assert set(got) == {i for (i, _), want in exact.items() if want}
    return found / max(all_, 1)


def sum_in_order(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=False):
        total += x * y
    return total


def awkward(n=700, d=24):
    r = random.Random(6)
    rows = [(i, [float(np.float32(r.gauss(0, 0.2))) for _ in range(d)]) for i in range(n)]
    rows[20], rows[21], rows[22], rows[23], rows[24], rows[25] = (20, None), (21, [0.0] * d), (22, []), (23, [0.5, None]), (24, [float("nan")] * d), (25, [float("-inf")] * d)
    rows[26], rows[60] = (26, [0.5] * (d + 9)), (60, [0.25] * (d - 5))
    rows += [(2000 + i, rows[100][1]) for i in range(500)]  # one very common vector
    rows += [(None, rows[1][1]), rows[101], rows[101], rows[120], (2001, rows[100][1])]
    rows += [(5001, [float(np.float32(r.gauss(0, 0.2))) for _ in range(d)]) for _ in range(60)]  # one id, many vectors
    return rows


@pytest.fixture(scope="module")
def folder(spark):
    path = tempfile.mkdtemp(prefix="tiltml-ann-")
    rows = [(*x, 1, 2, "q") for x in awkward()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int, copies int, q string").repartition(4).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("block", [4096, 50])
def test_recall_and_scores_on_awkward_rows(spark, folder, block, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", block)
    assert checked_recall(rows_of(spark, folder), result_of(QUERIES["op13_nearest"](spark, folder))) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_given_tables(spark, sf):
    folder = f"/root/testdata/{sf}"
    assert checked_recall(rows_of(spark, folder), result_of(QUERIES["op13_nearest"](spark, folder))) >= 0.9


def test_all_leaves_give_the_exact_result(spark, folder):
    got = result_of(T.nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 20 == 0, recall=1.1))
    assert checked_recall(rows_of(spark, folder), got) == 1.0


def test_short_lists_widen_to_all_leaves(spark, monkeypatch):
    """Sixty tight groups of twelve rows: no query finds twenty rows in the leaves that hold its neighbours."""
    r = np.random.default_rng(3)
    centres = np.eye(60) * 10
    rows = [(i, (centres[i % 60] + r.normal(0, 0.01, 60)).tolist()) for i in range(720)]
    monkeypatch.setattr(T, "LEAF_ROWS", 4)
    got = result_of(T.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, recall=0.3))
    checked_recall(rows, got)


def test_tree_leads_every_row_to_one_leaf_and_visits_each_leaf_once():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 16))
    tree = T.Tree(x)
    leaves = tree.assign(x)
    assert set(leaves.tolist()) == set(range(tree.leaves)) and tree.leaves > 30
    assert all(sorted(v) == list(range(tree.leaves)) for v in tree.visits(x[:20], tree.leaves))
    home = [v.index(leaf) for v, leaf in zip(tree.visits(x[:200], tree.leaves), leaves[:200], strict=True)]
    assert np.mean(home) < 3
    assert T.Tree(np.zeros((0, 4))).assign(x[:3]).tolist() == [0, 0, 0]
    assert T.Tree(np.ones((500, 4))).leaves == 1


def test_empty_table(spark, folder):
    path = tempfile.mkdtemp(prefix="tiltml-ann-")
    spark.read.parquet(f"{folder}/embeddings.parquet").limit(0).write.parquet(f"{path}/embeddings.parquet")
    assert QUERIES["op13_nearest"](spark, path).count() == 0
