"""DuckDB SQL that grows small decision trees exactly, as twins of fits.

On features with few values every midpoint of two neighbouring training values is a candidate split, so a
tree's first levels are a few aggregates a level: counts by node, feature, value and target, the left
parts of every split, the split with the largest variance reduction (for a 0/1 target half the reduction of the
Gini impurity, so the order is the same), ties by feature and threshold. Sums go over the target's
few classes in a fixed order: equal parts have equal sums, and ties are found as ties.

A classification tree is pruned as Spark prunes it: where both children are leaves with one prediction.
``g`` numbers trees that are grown side by side (a fold each); rows with ``tr`` train, all rows are led down.
"""

from __future__ import annotations

from collections.abc import Sequence


def tree_ctes(p: str, rows: str, feats: Sequence[str], depth: int, classify: bool) -> str:
    """CTEs ``{p}st`` (g, node, n, s, pred), ``{p}b{level}`` (the splits), ``{p}c{level}`` (pruned nodes) and ``{p}out`` (g, id, node, n, s, pred of
    the row's leaf). ``rows`` has g, id, tr, the features, the target's class k and its value r. Node numbers: 1, then 2 i and 2 i + 1."""
    parts = " UNION ALL ".join(f"SELECT g, id, tr, k, r, {i} AS f, {c}::DOUBLE AS x FROM {rows}" for i, c in enumerate(feats))
    out = [f"{p}lg AS MATERIALIZED ({parts})",
           f"{p}v AS (SELECT DISTINCT g, f, x FROM {p}lg WHERE tr)",
           f"{p}t AS (SELECT * FROM (SELECT g, f, (x + lead(x) OVER (PARTITION BY g, f ORDER BY x)) / 2 AS t FROM {p}v) WHERE t IS NOT NULL)",
           f"{p}n0 AS MATERIALIZED (SELECT g, id, 1::BIGINT AS node FROM {rows})"]
    for lv in range(depth):
        out += [
            f"{p}h{lv} AS (SELECT l.g, n.node, l.f, l.x, l.k, l.r, count(*) AS n FROM {p}lg l JOIN {p}n{lv} n ON n.g = l.g AND n.id = l.id "
            f"WHERE l.tr AND n.node >= {2**lv} GROUP BY ALL)",
            f"{p}s{lv} AS (SELECT h.g, h.node, h.f, t.t, h.k, h.r, sum(CASE WHEN h.x <= t.t THEN h.n ELSE 0 END)::DOUBLE AS nl, sum(h.n)::DOUBLE AS nn "
            f"FROM {p}h{lv} h JOIN {p}t t ON h.g = t.g AND h.f = t.f GROUP BY ALL)",
            f"{p}a{lv} AS (SELECT g, node, f, t, sum(nl) AS nl, sum(nn) AS n, sum(nl * r ORDER BY k) AS sl, sum(nn * r ORDER BY k) AS s, "
            f"sum(nl * r * r ORDER BY k) AS ql, sum(nn * r * r ORDER BY k) AS q FROM {p}s{lv} GROUP BY g, node, f, t)",
            f"{p}r{lv} AS (SELECT *, (q - s * s / n) / n - nl / n * ((ql - sl * sl / nl) / nl) "
            f"- (n - nl) / n * (((q - ql) - (s - sl) * (s - sl) / (n - nl)) / (n - nl)) AS gain FROM {p}a{lv} WHERE nl > 0 AND nl < n)",
            f"{p}b{lv} AS MATERIALIZED (SELECT g, node, f, t, n, gain FROM (SELECT *, row_number() OVER (PARTITION BY g, node ORDER BY gain DESC, f, t) AS i FROM {p}r{lv}) "
            f"WHERE i = 1 AND gain > 0)",
            f"{p}n{lv + 1} AS MATERIALIZED (SELECT n.g, n.id, CASE WHEN b.node IS NULL THEN n.node WHEN l.x <= b.t THEN 2 * n.node ELSE 2 * n.node + 1 END AS node "
            f"FROM {p}n{lv} n LEFT JOIN {p}b{lv} b ON b.g = n.g AND b.node = n.node LEFT JOIN {p}lg l ON l.g = n.g AND l.id = n.id AND l.f = b.f)"]
    seen = " UNION ALL ".join(f"SELECT g, id, node FROM {p}n{lv}" + (f" WHERE node >= {2**lv}" if lv else "") for lv in range(depth + 1))
    pred = "CASE WHEN 2 * s > n THEN 1.0 ELSE 0.0 END" if classify else "s / n"
    out += [f"{p}ns AS (SELECT n.g, n.node, w.k, w.r, count(*)::DOUBLE AS n FROM ({seen}) n JOIN {rows} w ON w.g = n.g AND w.id = n.id WHERE w.tr GROUP BY ALL)",
            f"{p}st AS MATERIALIZED (SELECT *, {pred} AS pred FROM (SELECT g, node, sum(n) AS n, sum(n * r ORDER BY k) AS s FROM {p}ns GROUP BY g, node))"]
    for lv in reversed(range(depth)):
        inner = f"(SELECT g, node FROM {p}b{lv + 1} EXCEPT SELECT g, node FROM {p}c{lv + 1})" if lv + 1 < depth else f"(SELECT 0 AS g, 0 AS node WHERE FALSE)"
        out.append(f"{p}c{lv} AS MATERIALIZED (SELECT b.g, b.node FROM {p}b{lv} b JOIN {p}st x ON x.g = b.g AND x.node = 2 * b.node JOIN {p}st y ON y.g = b.g AND y.node = 2 * b.node + 1 "
                   f"WHERE x.pred = y.pred AND NOT EXISTS (SELECT 1 FROM {inner} i WHERE i.g = b.g AND i.node IN (2 * b.node, 2 * b.node + 1)))")
    joins = " ".join(f"LEFT JOIN {p}c{lv} c{lv} ON c{lv}.g = d.g AND c{lv}.node = CASE WHEN lv >= {lv} THEN d.node // (2 ** (lv - {lv}))::BIGINT END" for lv in range(depth))
    top = ", ".join(f"c{lv}.node" for lv in range(depth))
    out += [f"{p}fin AS MATERIALIZED (SELECT d.g, d.node, coalesce({top}, d.node) AS leaf FROM (SELECT DISTINCT g, node, floor(log2(node))::BIGINT AS lv FROM {p}n{depth}) d {joins})",
            f"{p}end AS MATERIALIZED (SELECT f.g, f.node, s.node AS leaf, s.n, s.s, s.pred FROM {p}fin f JOIN {p}st s ON s.g = f.g AND s.node = f.leaf)",
            f"{p}out AS MATERIALIZED (SELECT d.g, d.id, e.leaf AS node, e.n, e.s, e.pred FROM {p}n{depth} d JOIN {p}end e ON e.g = d.g AND e.node = d.node)"]
    return ", ".join(out)


def nodes_sql(p: str, depth: int) -> str:
    """SELECT of the pruned tree's nodes: node, feature (-1 in a leaf), threshold, n, prediction."""
    inner = " UNION ALL ".join(f"SELECT b.g, b.node, b.f, b.t, b.gain FROM {p}b{lv} b WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.g = b.g AND gone.node = b.node)" for lv in range(depth))
    hidden = " OR ".join(f"EXISTS (SELECT 1 FROM {p}c{lv} c WHERE c.g = s.g AND c.node = s.node // {2**up} AND s.node >= {2**(lv + up)} AND s.node < {2**(lv + up + 1)})"
                         for lv in range(depth) for up in range(1, depth - lv + 1))
    gone = " UNION ".join(f"SELECT g, node FROM {p}c{lv}" for lv in range(depth))
    return (f"shown AS (SELECT * FROM {p}st s WHERE NOT ({hidden})), gone AS ({gone}), inner_nodes AS ({inner}) "
            "SELECT s.node, coalesce(i.f, -1)::INTEGER AS feature, i.t AS threshold, s.n, s.pred AS prediction "
            "FROM shown s LEFT JOIN inner_nodes i ON i.g = s.g AND i.node = s.node")


def boosted_ctes(p: str, rows: str, feats: Sequence[str], depth: int, step: float) -> str:
    """CTE ``{p}m`` (g, id, m1, m2): margins of one and of two boosted regression trees for a 0/1 label ``y``. The first tree fits
    the signs, the second one what the logistic loss leaves of them, 4 s / (1 + exp(2 s m1)), and counts ``step`` times."""
    first = f"{p}w1 AS MATERIALIZED (SELECT * EXCLUDE (k, r), y::INTEGER AS k, 2 * y - 1.0 AS r FROM {rows})"
    second = (f"{p}w2 AS MATERIALIZED (SELECT w.* EXCLUDE (k, r), o.node * 2 + w.k AS k, 4 * w.r / (1 + exp(2 * w.r * o.pred)) AS r "
              f"FROM {p}w1 w JOIN {p}xout o ON o.g = w.g AND o.id = w.id)")
    return ", ".join([first, tree_ctes(f"{p}x", f"{p}w1", feats, depth, False), second, tree_ctes(f"{p}y", f"{p}w2", feats, depth, False),
                      f"{p}m AS (SELECT a.g, a.id, a.pred AS m1, a.pred + {step!r} * b.pred AS m2 FROM {p}xout a JOIN {p}yout b ON b.g = a.g AND b.id = a.id)"])
