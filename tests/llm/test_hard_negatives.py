import math
import random
import tempfile

import numpy as np
import pytest

from tiltml.llm import hard_negatives as H
from tiltml.llm.queries import QUERIES

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute_force(rows):
    good = [(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, q in {r for r in good if r[0] % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j, other) for j, other, c in good if j != i)
        for p, pid, _ in [s for s in scored if s[2] == label][:5]:
            window = [(s, j) for s, j, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(i, pid, n + 1, j, -p, -s) for n, (s, j) in enumerate(window[:3])]
    return sorted(out)


def awkward():
    r = random.Random(8)
    rows = [(i, [r.gauss(0.03, 0.2) for _ in range(20)], r.randrange(3)) for i in range(400)]
    rows[100] = (100, None, 1)
    rows[7] = (7, [0.1, None], 1)
    rows[8] = (8, [float("nan")] * 20, 1)
    rows[9] = (9, [float("inf")] + [0.0] * 19, 0)
    rows[150] = (150, [0.1] * 20, None)
    rows[11] = (11, [], 0)
    rows[12] = (12, [0.5] * 33, 2)
    rows[0] = (0, [0.5] * 31, 2)
    rows[200] = (200, [0.0] * 20, 1)
    rows += [(1000 + i, rows[250][1], i % 4) for i in range(300)] + [rows[50], rows[50], (50, [0.3] * 20, 2), (None, [0.1] * 20, 1), rows[300], (-50, [0.2] * 20, 0), (-7, [0.2] * 20, 9)]
    return rows


@pytest.fixture(scope="module")
def folder(spark):
    path = tempfile.mkdtemp(prefix="tiltml-neg-")
    rows = [(*x, 1, 2, 3) for x in awkward()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int, c int, a int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("sizes", [(8192, 512, 1 << 18), (37, 3, 10), (200, 64, 4)])
def test_equals_brute_force(spark, folder, sizes, monkeypatch):
    for name, value in zip(("CANDIDATES", "ANCHORS", "HELD_ANCHORS"), sizes, strict=True):
        monkeypatch.setattr(H, name, value)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, folder).select(*NAMES).collect())
    assert len(got) > 20 and got == brute_force(rows)


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 17, 65), (64, 64, 64), (100, 31, 7), (47, 130, 90), (0, 5, 3), (40, 40, 0)])
@pytest.mark.parametrize("high", [3, 256, 2**29])
def test_strassen_is_exact(shape, high):
    r = np.random.default_rng(high)
    a, b = r.integers(-high, high, shape[:2]), r.integers(-high, high, shape[1:])
    want = (a.astype(object) @ b.astype(object)).astype(np.int64) if min(shape) else np.zeros((shape[0], shape[2]), np.int64)
    for leaf in (1, 4, 16):
        assert np.array_equal(H.strassen(a, b, leaf), want)


def test_heaps_merge_in_any_order():
    r = np.random.default_rng(5)
    tile, ids = r.integers(-4, 4, (6, 90)), np.sort(r.permutation(1000)[:90])
    allowed = r.random((6, 90)) < 0.7
    whole = H.heap_of(tile, allowed, ids, 5)
    parts = [H.heap_of(tile[:, s], allowed[:, s], ids[s], 5) for s in (slice(60, 90), slice(0, 3), slice(3, 60))]
    joined = H.merged(H.merged(*parts[:2]), parts[2])
    for i in range(6):
        want = sorted((-int(s), int(j)) for s, j, ok in zip(tile[i], ids, allowed[i], strict=True) if ok)[:5]
        for best, at in (whole, joined):
            assert [(-int(s), int(j)) for s, j in zip(best[i], at[i], strict=True) if s != H.NONE] == want


def test_empty_table(spark, folder):
    path = tempfile.mkdtemp(prefix="tiltml-neg-")
    spark.read.parquet(f"{folder}/embeddings.parquet").limit(0).write.parquet(f"{path}/embeddings.parquet")
    assert QUERIES["op12_hard_negatives"](spark, path).count() == 0
