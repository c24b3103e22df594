import math

import numpy as np
import pytest

from tiltml.llm import top_k as K
from tiltml.llm.queries import QUERIES


def brute_force(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in good if j != i)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4096, 1024), (37, 3)])
def test_equals_brute_force(spark, tables, sizes, monkeypatch):
    monkeypatch.setattr(K, "CANDIDATES", sizes[0])
    monkeypatch.setattr(K, "QUERIES", sizes[1])
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in QUERIES["op3_top_k"](spark, tables).collect()) == brute_force(rows)


def test_block_with_ties_and_large_numbers():
    r = np.random.default_rng(1)
    for high, n in ((3, 500), (2**30, 40), (50, 3)):
        q, c = r.integers(-high, high, (40, 7)), r.integers(-high, high, (40, n))
        ids = r.permutation(n)
        got = K.block_top_k(np.array([-1, 0, 1, 2, -5, 3, 4]), q, ids, c, 5)
        for j, own in enumerate([-1, 0, 1, 2, -5, 3, 4]):
            scores = sorted((-int(q[:, j].astype(object) @ c[:, i].astype(object)), int(ids[i])) for i in range(n) if ids[i] != own)
            assert [(i, s) for p, i, s in got if p == j] == [(i, -s) for s, i in scores[:5]]


def test_most_candidates_are_pruned():
    """With energy in few dimensions the first block decides, and the survivors are few: the result stays exact."""
    r = np.random.default_rng(2)
    c = (r.standard_normal((64, 3000)) * np.geomspace(1000, 1, 64)[:, None]).astype(np.int64)
    got = K.block_top_k(np.arange(-3, 0), c[:, :3], np.arange(3000), c, 5)
    for j in range(3):
        scores = sorted((-int(s), i) for i, s in enumerate(c[:, j] @ c))
        assert [(i, s) for p, i, s in got if p == j] == [(i, -s) for s, i in scores[:5]]


def test_blocks_never_go_through_the_driver(spark, tables):
    """A side that is small at run time isn't broadcast either: it grows with the product of both sides."""
    found = QUERIES["op3_top_k"](spark, tables)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_blocks_are_packed_narrowly():
    for high, size in ((100, 1), (300, 2), (40_000, 4), (2**40, 8)):
        matrix = np.array([[-high, 0, high], [1, 2, 3]])
        data = K.narrowed(matrix)
        assert len(data) == 1 + 6 * size and (K.widened(data, 3) == matrix).all()
    assert K.widened(K.narrowed(np.array([[-128, 127]])), 2).tolist() == [[-128, 127]] and len(K.narrowed(np.array([[128]]))) == 3


def test_empty_table(spark, empty_tables):
    assert QUERIES["op3_top_k"](spark, empty_tables).count() == 0
