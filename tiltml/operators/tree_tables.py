"""Fitted trees as tables: a row a node, and scoring from them.

Spark's saved form of a tree model is a table of nodes; here it gets a tidy shape. Scoring walks all trees
of a model at once and can give the margins of several stages of a boosting run: a run that stops
earlier is the first trees of the longer one, so one walk over the longest scores them all. Rows that no
threshold of the trees tells apart are in one cell, and a worker walks the trees once a cell.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltml.session import scratch_path


def tree_nodes(model) -> DataFrame:
    """tree, id, feature (-1 in a leaf), threshold, left, right, prediction, impurity, gain, n, weight of every node of a
    fitted tree, forest or boosted model; ``id`` 0 is a tree's root, ``n`` the
    weight of the rows that reach a node. Splits must be by thresholds."""
    spark = SparkSession.active()
    path = scratch_path(spark, "tree-model")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*")
        weights = list(model.treeWeights)
    else:
        data, weights = data.withColumn("tree", F.lit(0)), [1.0]
    split = F.col("split")
    # a fit on cells counts their weights, not the cells: sums of the classes, or the first of a regression's three sums
    stats = F.col("impurityStats")
    total = F.get(stats, 0) if "GBT" in type(model).__name__ or "Regress" in type(model).__name__ else F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    reached = F.round(total).cast("long")
    leaf = F.col("leftChild") < 0
    threshold = F.get(split["leftCategoriesOrThreshold"], 0)
    checked = F.when(split["numCategories"] >= 0, F.raise_error(F.lit("a split by categories has no threshold")).cast("double")).otherwise(threshold)
    return data.select("tree", "id", F.when(leaf, -1).otherwise(split["featureIndex"]).alias("feature"), F.when(~leaf, checked).alias("threshold"),
                       F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), "prediction", "impurity", F.when(~leaf, F.col("gain")).alias("gain"),
                       reached.alias("n"), F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("tree")).alias("weight"))


def numbered(nodes: DataFrame) -> DataFrame:
    """The nodes with ``node``: 1 in the root, 2 i and 2 i + 1 in the children of i. A model's nodes are few, they go through the driver."""
    rows = {(r.tree, r.id): r for r in nodes.collect()}
    places, todo = [], [(tree, 0, 1) for tree, i in rows if i == 0]
    while todo:
        tree, i, number = todo.pop()
        r = rows[tree, i]
        places.append((tree, i, number))
        if r.feature >= 0:
            todo += [(tree, r.left, 2 * number), (tree, r.right, 2 * number + 1)]
    return nodes.join(nodes.sparkSession.createDataFrame(places, "tree int, id int, node long"), ["tree", "id"])


class TreeTable:
    """The nodes of all trees of a model as arrays, in the order of the trees."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "id"], ignore_index=True)
        starts = nodes.index[nodes["id"] == 0].to_numpy()
        base = np.repeat(starts, np.diff([*starts, len(nodes)]))
        leaf = nodes["feature"].to_numpy() < 0
        here = np.arange(len(nodes))
        self.roots = starts
        self.feature = np.where(leaf, 0, nodes["feature"].to_numpy())
        self.threshold = np.where(leaf, np.inf, nodes["threshold"].to_numpy(np.float64))
        self.left, self.right = (np.where(leaf, here, base + nodes[c].to_numpy()) for c in ("left", "right"))
        self.value = nodes["prediction"].to_numpy(np.float64) * nodes["weight"].to_numpy(np.float64)
        self.leaf = leaf

    def sums(self, x: np.ndarray, stages: Sequence[int]) -> np.ndarray:
        """Weighted sums of the first ``stages`` trees' predictions: a row a row of ``x``, a column a stage."""
        out = np.empty((len(x), len(stages)))
        last = np.array(stages) - 1
        for start in range(0, len(x), 2048):
            some = x[start:start + 2048]
            at = np.tile(self.roots[:max(stages)], (len(some), 1))
            row = np.arange(len(some))[:, None]
            while not self.leaf[at].all():
                at = np.where(some[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[start:start + 2048] = np.cumsum(self.value[at], axis=1)[:, last]
        return out


# Margins that a worker process keeps for each of so many sets of models, those that it scored last.
KEPT_MARGINS, KEPT_SETS = 1 << 22, 2


class KnownCells:
    """Margins of cells that a worker has met, in the order of the cells' numbers."""

    def __init__(self, width: int):
        self.cells, self.margins = np.empty(0, np.int64), np.empty((0, width))

    def of(self, cells: np.ndarray, walk: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Margins of different ascending cells; ``walk`` gives those of the places that aren't known. Up to ``KEPT_MARGINS`` are kept."""
        at = np.searchsorted(self.cells, cells)
        found = at < len(self.cells)
        found[found] = self.cells[at[found]] == cells[found]
        out = np.empty((len(cells), self.margins.shape[1]))
        out[found] = self.margins[at[found]]
        new = np.flatnonzero(~found)
        if len(new):
            out[new] = walk(new)
            if self.margins.size + out[new].size <= KEPT_MARGINS:
                self.cells, self.margins = np.insert(self.cells, at[new], cells[new]), np.insert(self.margins, at[new], out[new], axis=0)
        return out


@functools.lru_cache(maxsize=KEPT_SETS)
def _known(name: str, width: int) -> KnownCells:
    return KnownCells(width)


class CellScorer:
    """Margins of stages of several models. A cell is a row's place between the thresholds that all the trees have for each
    feature: rows in one cell go the same way at every node, so they have the same margins to the last bit."""

    def __init__(self, runs: Sequence[tuple[TreeTable, Sequence[int]]]):
        self.runs = runs
        self.width = sum(len(stages) for _, stages in runs)
        self.name = uuid.uuid4().hex
        feature = np.concatenate([t.feature[~t.leaf] for t, _ in runs])
        threshold = np.concatenate([t.threshold[~t.leaf] for t, _ in runs])
        self.cuts = [(j, np.unique(threshold[feature == j])) for j in np.unique(feature)]
        # more cells than numbers: as good as every row has its own
        self.numbered = math.prod(len(c) + 1 for _, c in self.cuts) < 1 << 62

    def walk(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([table.sums(x, stages) for table, stages in self.runs])

    def margins(self, x: np.ndarray) -> np.ndarray:
        if not self.numbered:
            return self.walk(x)
        number = np.zeros(len(x), np.int64)
        for j, cuts in self.cuts:
            number = number * (len(cuts) + 1) + np.searchsorted(cuts, x[:, j])
        cells, first, place = np.unique(number, return_index=True, return_inverse=True)
        return _known(self.name, self.width).of(cells, lambda new: self.walk(x[first[new]]))[place]


def margins_of(runs: Sequence[tuple], features_col: str = "features") -> Column:
    """array<double>: for every (boosted model, stages), the margins of the model that stops after each of ``stages`` rounds, in that
    order. A row's class is 1 where the margin is over 0, the probability of class 1 is 1 / (1 + exp(-2 margin))."""
    tables = [(TreeTable(tree_nodes(model).toPandas()), stages) for model, stages in runs]  # a model's nodes
    scorer = CellScorer([(table, [min(int(s), len(table.roots)) for s in stages]) for table, stages in tables])

    @F.arrow_udf("array<double>")
    def margins(features: pa.Array) -> pa.Array:
        n = len(features)
        widths = pc.min_max(pc.list_value_length(features)).as_py()
        if widths["min"] != widths["max"]:
            raise ValueError("scoring needs features of one length in every row")
        x = features.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
        found = scorer.margins(x) if n else np.zeros((0, scorer.width))
        ends = np.arange(n + 1, dtype=np.int32) * scorer.width
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

    # a filter on the margins isn't pushed below them, where they would be made a second time
    return margins.asNondeterministic()(vector_to_array(F.col(features_col)))


def staged_margins(model, stages: Sequence[int], features_col: str = "features") -> Column:
    """array<double>: :func:`margins_of` one boosted model."""
    return margins_of([(model, stages)], features_col)
