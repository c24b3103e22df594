"""DuckDB twins of the catalogue queries (same tables, names and types).

Each string is a complete query over the driver's views. Hash draws use
``sql_hash_u``; class fractions are recomputed from counts exactly as the
Spark side computes them (same double operations, same order).
"""

from __future__ import annotations

from tiltml.functions.hashing import sql_hash_u, sql_hash_u_block, sql_poisson_copies, sql_poisson_ctes
from tiltml.operators import evolution as EV
from tiltml.operators import sampling as S
from tiltml.plans import catalog as Q
from tiltml.plans.oracle_trees import boosted_ctes, nodes_sql, tree_ctes
from tiltml.sources import fixtures as FX

KEYS = FX.LINEITEM_KEYS
K = ", ".join(KEYS)
FEATS = FX.ML_BINARY_FEATURES
B = f"WITH b AS ({FX.ML_BINARY_SQL})"
FP = f"WITH f AS ({FX.FORMULA_PREDICTIONS_SQL})"
BCOLS = f"{K}, {', '.join(FEATS)}, class"


def u(seed: int, salt: str | None = None, keys=KEYS) -> str:
    return sql_hash_u(keys, seed, salt)


def poisson(keys=KEYS) -> str:
    return sql_poisson_copies(keys, Q.SEED)


def sig(x: str, digits: int) -> str:
    """Twin of ``catalog.sig_round``: round to ``digits`` significant digits."""
    p = f"ceil(log10(abs({x})))"
    scaled = (f"CASE WHEN {p} >= 0 THEN round({x} / pow(10.0, {p}), {digits}) * pow(10.0, {p}) "
              f"ELSE round({x} * pow(10.0, -{p}), {digits}) / pow(10.0, -{p}) END")
    return f"(CASE WHEN {x} = 0 OR {x} IS NULL OR isnan({x}) THEN {x} ELSE {scaled} END)"


def row_sum(cols) -> str:
    expr = cols[0]
    for c in cols[1:]:
        expr = f"({expr} + {c})"
    return expr


def dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def band_case(uexpr: str, weights) -> str:
    bands = S._bands(weights)
    parts = [f"WHEN {uexpr} < {dbl(hi)} THEN {i}" for i, (lo, hi) in enumerate(bands[:-1])]
    return f"(CASE {' '.join(parts)} ELSE {len(bands) - 1} END)"


def copies_rows(src: str, cols: str, copies: str, where: str) -> str:
    """Rows of ``src`` (which includes ``pt``) repeated by their Poisson copies."""
    return (f"SELECT {cols} FROM (SELECT {cols}, unnest(range(__n)) AS __i FROM "
            f"(SELECT *, {copies} AS __n FROM {src} WHERE {where}) WHERE __n >= 1)")


def undersample_sql(ratio: float = 1.0) -> str:
    return (f"{B}, c AS (SELECT count_if(class = 1.0) AS n1, count_if(class = 0.0) AS n0 FROM b), "
            f"f AS (SELECT CASE WHEN n0 = 0 THEN 0.0 ELSE (n1::DOUBLE / n0::DOUBLE) * {dbl(ratio)} END AS frac FROM c), "
            f"{sql_poisson_ctes('f')}, bal AS ({copies_rows('b, pt', BCOLS, poisson(), 'class = 0.0')} "
            f"UNION ALL SELECT {BCOLS} FROM b WHERE class = 1.0)")


def evolution_scores_sql(src: str, weight: str = "const", seed: int = 0, iterations: int = EV.DEFAULT_ITERATIONS) -> str:
    """CTEs ``m`` (float32 class maxima), ``x`` (rows + class max), ``sc`` (column, score)."""
    coeffs = EV.evolution_coefficients(iterations)
    s = row_sum(FEATS)
    parts = []
    for c in FEATS:
        h = EV.sql_horner(f"({c} / mc)", coeffs)
        w = h if weight == "const" else f"({u(seed, c)} * {h})"
        if weight == "const":
            w = f"(1.0::DOUBLE * {h})"
        parts.append(f"SELECT '{c}' AS \"column\", sum({w}) AS score FROM x")
    return (f"m AS (SELECT CAST(CAST(max(CASE WHEN class = 0.0 THEN {s} END) AS FLOAT) AS DOUBLE) AS m0, "
            f"CAST(CAST(max(CASE WHEN class = 1.0 THEN {s} END) AS FLOAT) AS DOUBLE) AS m1 FROM {src}), "
            f"x AS (SELECT {src}.*, CASE WHEN class = 0.0 THEN m0 WHEN class = 1.0 THEN m1 END AS mc FROM {src}, m), "
            f"sc AS ({' UNION ALL '.join(parts)})")


def vec(c: str) -> str:
    return f"({c} + 0.0)"


def nb_sql() -> str:
    x = ", ".join(f"{c} + 10.0 AS x{i}" for i, c in enumerate(FEATS))
    sums = ", ".join(f"sum(x{i}) AS s{i}" for i in range(len(FEATS)))
    tot = row_sum([f"s{i}" for i in range(len(FEATS))])
    thetas = ", ".join(f"ln(s{i} + 1.0) - ln({tot} + {len(FEATS)} * 1.0) AS t{i}" for i in range(len(FEATS)))

    def raw(p: str) -> str:
        expr = f"{p}.pi"
        dot = " + ".join(f"{p}.t{i} * te.x{i}" for i in range(len(FEATS)))
        return f"({expr} + ({dot}))"
    return (f"{B}, x AS (SELECT {K}, {x}, class, {u(Q.SPLIT_SEED)} AS u FROM b), "
            f"tr AS (SELECT * FROM x WHERE u < 0.7), te AS (SELECT * FROM x WHERE u >= 0.7), "
            f"agg AS (SELECT class, count(*)::DOUBLE AS n, {sums} FROM tr GROUP BY class), "
            f"tot AS (SELECT sum(n) AS nd, count(*)::DOUBLE AS k FROM agg), "
            f"par AS (SELECT class, ln(n + 1.0) - ln(nd + k * 1.0) AS pi, {thetas} FROM agg, tot), "
            f"p0 AS (SELECT * FROM par WHERE class = 0.0), p1 AS (SELECT * FROM par WHERE class = 1.0) "
            f"SELECT {', '.join('te.' + k for k in KEYS)}, te.class AS label, "
            f"CASE WHEN {raw('p1')} > {raw('p0')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction "
            f"FROM te, p0, p1")


def evaluate_sql(positive: float) -> str:
    p, n = dbl(positive), dbl(1.0 - positive)
    nan = "'NaN'::DOUBLE"
    tpr = f"CASE WHEN tp + fn = 0 THEN {nan} ELSE tp::DOUBLE / (tp + fn)::DOUBLE END"
    tnr = f"CASE WHEN tn + fp = 0 THEN {nan} ELSE tn::DOUBLE / (tn + fp)::DOUBLE END"
    return (f"{FP}, c AS (SELECT count_if(label = {p} AND prediction = {p}) AS tp, "
            f"count_if(label = {n} AND prediction = {p}) AS fp, count_if(label = {p} AND prediction = {n}) AS fn, "
            f"count_if(label = {n} AND prediction = {n}) AS tn FROM f) "
            f"SELECT tp, fp, fn, tn, {tpr} AS tpr, {tnr} AS tnr, ({tpr}) * ({tnr}) AS score FROM c")


def covariance_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i:]]
    d = {c: f"CAST({c} AS DECIMAL(18,2))" for c in FEATS}
    sums = ", ".join(f"sum({d[c]}) AS s_{j}" for j, c in enumerate(FEATS))
    prods = ", ".join(f"sum({d[a]} * {d[b]}) AS p{i}" for i, (a, b) in enumerate(pairs))
    idx = {c: j for j, c in enumerate(FEATS)}
    sel = []
    for i, (a, b) in enumerate(pairs):
        num = f"(n::DOUBLE * p{i}::DOUBLE - s_{idx[a]}::DOUBLE * s_{idx[b]}::DOUBLE)"
        den = "(n::DOUBLE * (n::DOUBLE - 1.0))"
        cov = f"CASE WHEN {den} = 0 THEN 'NaN'::DOUBLE ELSE {num} / {den} END"
        sel.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {sig(f'({cov})', Q.SIG_DIGITS)} AS covariance FROM s")
    return f"{B}, s AS (SELECT count(*) AS n, {sums}, {prods} FROM b) {' UNION ALL '.join(sel)}"


def chi2_sql() -> str:
    feats = FX.ML_DISCRETE_FEATURE_COLS
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, class FROM d" for c in feats)
    return (f"WITH d AS ({FX.ML_DISCRETE_SQL}), lg AS ({long}), "
            "o AS (SELECT feature, v, class, count(*)::DOUBLE AS n FROM lg GROUP BY feature, v, class), "
            "r AS (SELECT feature, v, sum(n) AS nr FROM o GROUP BY feature, v), "
            "c AS (SELECT feature, class, sum(n) AS nc FROM o GROUP BY feature, class), "
            "t AS (SELECT feature, sum(n) AS nt FROM o GROUP BY feature), "
            "k AS (SELECT feature, count(DISTINCT v) AS kv, count(DISTINCT class) AS kc FROM o GROUP BY feature), "
            "g AS (SELECT r.feature, r.v, c.class, r.nr * c.nc / t.nt AS e, coalesce(o.n, 0.0) AS obs "
            "FROM r JOIN c ON r.feature = c.feature JOIN t ON t.feature = r.feature "
            "LEFT JOIN o ON o.feature = r.feature AND o.v = r.v AND o.class = c.class) "
            "SELECT g.feature, round(sum((obs - e) * (obs - e) / e), 6) AS statistic, "
            "CAST((max(kv) - 1) * (max(kc) - 1) AS BIGINT) AS dof "
            "FROM g JOIN k ON g.feature = k.feature GROUP BY g.feature")


def synthetic_sql() -> str:
    cols = []
    for i in range(30):
        uu = sql_hash_u_block(["vec_id"], Q.WEIGHT_SEED, f"label.block{i // 4}", i % 4)
        th = (f"(CASE WHEN label = 1.0 THEN {dbl(1.0 - 0.7)} ELSE {dbl(1.0 - 0.7)} END)")
        cols.append(f"CASE WHEN {uu} >= {th} THEN 1 ELSE 0 END AS label{i}")
    return f"SELECT vec_id, {', '.join(cols)}, label FROM ({FX.EMB_BINARY_SQL})"


def oversample_sql() -> str:
    cols = f"{K}, {', '.join(FEATS)}, label"
    return (f"WITH b AS (SELECT {K}, {', '.join(FEATS)}, class AS label FROM ({FX.ML_BINARY_SQL})), "
            f"c AS (SELECT count_if(label = 1.0) AS n1, count_if(label = 0.0) AS n0 FROM b), "
            f"f AS (SELECT CASE WHEN n1 = 0 THEN 0.0 ELSE (n0::DOUBLE / n1::DOUBLE) * {dbl(Q.OVERSAMPLE_RATIO)} END AS frac FROM c), "
            f"{sql_poisson_ctes('f')} SELECT {cols} FROM b WHERE label = 0.0 UNION ALL "
            f"{copies_rows('b, pt', cols, poisson(), 'label = 1.0')}")


def balance_sql() -> str:
    cols = "doc_id, n_chars, class"
    return (f"WITH t AS ({FX.TEXT_LABELS_SQL}), c AS (SELECT count_if(class = 1.0) AS na, count_if(class = 0.0) AS nb FROM t), "
            "p AS (SELECT CASE WHEN na < nb THEN 1.0 ELSE 0.0 END AS minor_val, CASE WHEN na < nb THEN 0.0 ELSE 1.0 END AS major_val, "
            "CASE WHEN greatest(na, nb) = 0 THEN 0.0 ELSE least(na, nb)::DOUBLE / greatest(na, nb)::DOUBLE END AS frac FROM c), "
            f"{sql_poisson_ctes('p')} SELECT {cols} FROM t, p WHERE t.class = p.minor_val UNION ALL "
            f"{copies_rows('t, p, pt', cols, poisson(['doc_id']), 'class = major_val')}")


def evolved_selection_sql() -> str:
    long = " UNION ALL ".join(f"SELECT {K}, class, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM bal" for c in FEATS)
    return (f"{undersample_sql()}, {evolution_scores_sql('bal')}, "
            f"top AS (SELECT \"column\" FROM sc ORDER BY score DESC, \"column\" LIMIT {Q.TOP_K_SELECT}), "
            f"lg AS ({long}) SELECT lg.* FROM lg JOIN top ON lg.\"column\" = top.\"column\"")


def median_band_sql() -> str:
    st = row_sum(FEATS)
    margin = "(CAST(abs(mx - md) - abs(md - mn) AS DOUBLE) / 2.0)"
    return (f"{B}, s AS (SELECT *, {st} AS st FROM b), "
            "m AS (SELECT CAST(max(st) AS FLOAT) AS mx, CAST(min(st) AS FLOAT) AS mn, "
            "CAST(quantile_cont(st, 0.5) AS FLOAT) AS md FROM s), "
            f"bd AS (SELECT CAST(md AS DOUBLE) + {margin} AS sup, CAST(md AS DOUBLE) - {margin} AS inf FROM m) "
            f"SELECT {K}, class, st AS sumTotal FROM s, bd WHERE st > least(inf, sup) AND st < greatest(inf, sup)")


def instance_filter_sql() -> str:
    coeffs = EV.evolution_coefficients(EV.DEFAULT_ITERATIONS)
    ws = [f"(1.0::DOUBLE * {EV.sql_horner(f'({c} / mc)', coeffs)})" for c in FEATS]
    return (f"{B}, {evolution_scores_sql('b')}, r AS (SELECT *, {row_sum(ws)} AS rs FROM x), "
            "t AS (SELECT avg(rs) AS a, min(rs) AS mn FROM r) "
            f"SELECT {K}, class FROM r, t WHERE rs >= a - mn")


def job_synthetic_sql() -> str:
    cols = []
    for i in range(30):
        uu = sql_hash_u_block(KEYS, Q.SYNTHETIC_JOB_SEED, f"label.block{i // 4}", i % 4)
        th = f"(CASE WHEN label = 1.0 THEN {dbl(1.0 - 0.7)} ELSE {dbl(1.0 - 0.7)} END)"
        cols.append(f"(CASE WHEN {uu} >= {th} THEN 1.0 ELSE 0.0 END + 0.0) AS label{i}")
    return f"{B}, m AS (SELECT {K}, class AS label FROM b) SELECT {K}, {', '.join(cols)}, label FROM m"


CHI2_TESTS = ("r AS (SELECT i, bin, sum(o) AS nr FROM o GROUP BY i, bin), cc AS (SELECT i, label, sum(o) AS nc FROM o GROUP BY i, label), "
              "tt AS (SELECT i, sum(o) AS nt FROM o GROUP BY i), "
              "g AS (SELECT r.i, r.bin, cc.label, nr * nc / nt AS e, coalesce(o.o, 0.0) AS obs FROM r JOIN cc USING (i) JOIN tt USING (i) "
              "LEFT JOIN o ON o.i = r.i AND o.bin = r.bin AND o.label = cc.label), "
              "st AS (SELECT i, sum((obs - e) * (obs - e) / e) AS stat, (count(DISTINCT bin) - 1) * (count(DISTINCT label) - 1) AS dof FROM g GROUP BY i), "
              # the upper tail of the distribution in closed form: the degrees of freedom are even
              "pv AS (SELECT *, CASE WHEN stat = 0 THEN 1.0 ELSE list_sum(list_transform(range(0, dof // 2), "
              "lambda j: exp(-stat / 2 + j * ln(stat / 2) - lgamma(j + 1)))) END AS p FROM st), "
              "rk AS (SELECT *, row_number() OVER (ORDER BY round(p, 12), stat DESC, i) AS rk, count(*) OVER () AS nf FROM pv)")


def binned_sql(rows: str, maxima: str, weight: str) -> str:
    """CTEs ``m`` (largest absolute values), ``lg`` and ``o`` (weighted counts by feature, bin and label)."""
    scaled = [f"{c} * (CASE WHEN m_{c} = 0 THEN 1.0 ELSE 1.0 / m_{c} END)" for c in FEATS]
    lg = " UNION ALL ".join(f"SELECT {i} AS i, {x} AS x, label, {weight} AS n FROM {rows}, m" for i, x in enumerate(scaled))
    return (f"m AS (SELECT {', '.join(f'max(abs({c})) AS m_{c}' for c in FEATS)} FROM {maxima}), lg AS ({lg}), "
            "o AS (SELECT i, least(CAST(floor((x + 1.0) / 2.0 * 33) AS INTEGER), 32) AS bin, label, sum(n)::DOUBLE AS o FROM lg GROUP BY ALL)")


def chi2_selection_sql(kept: str) -> str:
    names = "[" + ", ".join(f"'{c}'" for c in FEATS) + "]"
    return (f"{B}, t AS (SELECT *, class AS label FROM b), {binned_sql('t', 't', '1')}, {CHI2_TESTS}, "
            "fd AS (SELECT coalesce(max(rk) FILTER (p <= 0.05 * rk / nf), 0) AS last FROM rk) "
            f"SELECT {names}[i + 1] AS feature, round(stat, 4) AS statistic, dof, {kept} AS kept FROM rk, fd")


def prepare_chain_sql() -> str:
    scaled = ", ".join(f"{c} * (CASE WHEN m_{c} = 0 THEN 1.0 ELSE 1.0 / m_{c} END)" for c in FEATS)
    out = ", ".join(f"[{scaled}][l[{j + 1}] + 1] + 0.0 AS f{j}" for j in range(Q.N_PREPARED))
    return (f"{B}, s AS (SELECT *, class AS label, {u(Q.SPLIT_SEED)} AS su FROM b), "
            "tr0 AS (SELECT * FROM s WHERE su < 0.7), te AS (SELECT * FROM s WHERE su >= 0.7), "
            "c AS (SELECT count_if(label = 1.0) AS n1, count_if(label = 0.0) AS n0 FROM tr0), "
            f"f AS (SELECT CASE WHEN n1 = 0 THEN 0.0 ELSE (n0::DOUBLE / n1::DOUBLE) * {dbl(Q.OVERSAMPLE_RATIO)} END AS frac FROM c), "
            f"{sql_poisson_ctes('f')}, "
            f"tr AS (SELECT tr0.*, CASE WHEN label = 1.0 THEN {poisson()} WHEN label = 0.0 THEN 1 ELSE 0 END AS n FROM tr0, pt), "
            f"kp AS (SELECT * FROM tr WHERE n >= 1), {binned_sql('kp', 'kp', 'n')}, {CHI2_TESTS}, "
            f"sel AS (SELECT list(i ORDER BY i) AS l FROM rk WHERE rk <= {Q.N_PREPARED}), "
            "rep AS (SELECT *, unnest(range(n)) AS __i FROM kp) "
            f"SELECT {K}, {out}, label, 'train' AS part FROM rep, m, sel UNION ALL SELECT {K}, {out}, label, 'test' AS part FROM te, m, sel")


def pca_pair_sql(first: int | None = None) -> str:
    """The two components of two features in closed form, without their signs; of the first rows by key, if given."""
    x, y = Q.PCA_PAIR
    out = (f"SELECT {K}, round(abs(cos(th) * {x} + sin(th) * {y}), 6) AS pc0, round(abs(cos(th) * {y} - sin(th) * {x}), 6) AS pc1, "
           "class AS label, '{p}' AS part FROM s, a WHERE {tr}tr")
    if first is not None:
        out += f" ORDER BY {K} LIMIT {first}"
    parts = [f"SELECT * FROM ({out.format(p=p, tr=tr)})" for p, tr in (("train", ""), ("test", "NOT "))]
    return (f"{B}, s AS (SELECT *, {u(Q.SPLIT_SEED)} < 0.7 AS tr FROM b), "
            f"a AS (SELECT 0.5 * atan2(2.0 * covar_samp({x}, {y}), var_samp({x}) - var_samp({y})) AS th FROM s WHERE tr) {' UNION ALL '.join(parts)}")


def pca_first_sql(first: int, rounds: int = 60) -> str:
    """The first component of all features by power iteration, without its sign, of the first rows by key."""
    d = range(len(FEATS))
    cov = ", ".join(f"covar_samp({FEATS[i]}, {FEATS[j]}) AS c{i}{j}" for i in d for j in d)
    step = [" + ".join(f"c{i}{j} * v{j}" for j in d) for i in d]
    norm = "sqrt(" + " + ".join(f"({x}) * ({x})" for x in step) + ")"
    value = sig(f"abs({' + '.join(f'{c} * v{i}' for i, c in enumerate(FEATS))})", 6)
    out = (f"SELECT {K}, {value} AS pc0, {Q.PCA_K}::INTEGER AS n_components, class AS label, '{{p}}' AS part FROM s, top WHERE {{tr}}tr ORDER BY {K} LIMIT {first}")
    parts = [f"SELECT * FROM ({out.format(p=p, tr=tr)})" for p, tr in (("train", ""), ("test", "NOT "))]
    return (f"WITH RECURSIVE b AS ({FX.ML_BINARY_SQL}), s AS (SELECT *, {u(Q.SPLIT_SEED)} < 0.7 AS tr FROM b), cv AS MATERIALIZED (SELECT {cov} FROM s WHERE tr), "
            f"pw AS (SELECT 0 AS i, {', '.join(f'0.5::DOUBLE AS v{i}' for i in d)} UNION ALL SELECT i + 1, {', '.join(f'({x}) / {norm}' for x in step)} FROM pw, cv WHERE i < {rounds}), "
            f"top AS (SELECT * FROM pw WHERE i = {rounds}) {' UNION ALL '.join(parts)}")


def grown_rows(train: str, groups: str = "0") -> str:
    """CTEs ``bn`` (ml_binned with an id and the draws su, fu) and ``w`` (rows for the growth of trees; ``groups`` numbers them)."""
    feats = ", ".join(FX.ML_BINNED_FEATURES)
    return (f"bn AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {K}) AS id, {u(Q.SPLIT_SEED)} AS su, {u(Q.FOLD_SEED)} AS fu, "
            f"{band_case(u(Q.FOLD_SEED), [1.0] * 4)} AS fold FROM ({FX.ML_BINNED_SQL})), "
            f"w AS MATERIALIZED (SELECT g, id, {train} AS tr, {feats}, class AS y, class::INTEGER AS k, class AS r FROM bn, (SELECT unnest([{groups}]) AS g))")


def grown_predictions(kind: str) -> str:
    """CTE ``pr`` (id, prediction, probability) of the test rows under the grown forest or boosting run."""
    if kind == "forest":
        grow = tree_ctes("f", "w", FX.ML_BINNED_FEATURES, Q.GROWN_DEPTH, True)
        return f"WITH {grown_rows('su < 0.7')}, {grow}, pr AS (SELECT id, pred AS prediction, s / n AS probability FROM fout)"
    grow = boosted_ctes("b", "w", FX.ML_BINNED_FEATURES, Q.GROWN_BOOSTS[-1]["depth"], Q.GROWN_STEP)
    return (f"WITH {grown_rows('su < 0.7')}, {grow}, "
            "pr AS (SELECT id, CASE WHEN m2 > 0 THEN 1.0 ELSE 0.0 END AS prediction, 1 / (1 + exp(-2 * m2)) AS probability FROM bm)")


def grown_scores(kind: str, positive: float) -> str:
    out = (f"{grown_predictions(kind)}, f AS (SELECT class AS label, prediction::DOUBLE AS prediction FROM bn JOIN pr USING (id) WHERE su >= 0.7)")
    return evaluate_sql(positive).replace(FP, out, 1)


def grown_cascade() -> str:
    sure = "((label = 1.0 AND 1 / (1 + exp(-2 * {m})) > 0.6) OR (label = 0.0 AND 1 - 1 / (1 + exp(-2 * {m})) > 0.6))"
    labels = ", ".join(f"CASE WHEN m{i % 2 + 1} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label{i}" for i in range(Q.GROWN_ROUNDS))
    return (f"WITH {grown_rows('fu < 0.3')}, {boosted_ctes('b', 'w', FX.ML_BINNED_FEATURES, Q.GROWN_BOOSTS[-1]['depth'], Q.GROWN_STEP)}, "
            f"e AS (SELECT bn.*, class AS label, m1, m2 FROM bn JOIN bm ON bm.id = bn.id WHERE fu >= 0.3) "
            f"SELECT {K}, label, {labels}, {Q.GROWN_ROUNDS}::INTEGER AS n_features FROM e WHERE {sure.format(m='m1')} AND {sure.format(m='m2')}")


def job_score_sql(positive: float, more: str = "") -> str:
    return (f"{B}, s AS (SELECT *, {u(Q.SPLIT_SEED)} < 0.7 AS tr FROM b) SELECT count_if(NOT tr AND class = {dbl(positive)}) AS n_positive, "
            f"count_if(NOT tr AND class = {dbl(1.0 - positive)}) AS n_negative, TRUE AS passed{more} FROM s")


def build() -> dict[str, str]:
    hu = {c: u(Q.WEIGHT_SEED, c) for c in FEATS}
    n = len(FEATS)
    o: dict[str, str] = {}
    o["scan_parquet"] = FX.ML_BINARY_SQL
    o["scan_delimited"] = "SELECT * FROM part"
    o["scan_checked"] = ("WITH t AS (SELECT *, l_orderkey % 97 = 0 OR l_orderkey % 101 = 0 AS bad, concat_ws('|', l_orderkey, l_linenumber, "
                         "CASE WHEN l_orderkey % 97 = 0 THEN 'x' || l_partkey ELSE l_partkey::VARCHAR END, CASE WHEN l_orderkey % 101 <> 0 THEN l_returnflag END) AS text FROM lineitem) "
                         + "SELECT " + ", ".join(f"CASE WHEN NOT bad THEN {c} END AS {c}" for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"))
                         + ", CASE WHEN bad THEN text END AS line FROM t")
    o["sink_parquet"] = FX.ML_BINARY_SQL
    o["prepare_data"] = (f"{B} SELECT {K}, {', '.join(f'{vec(c)} AS f{i}' for i, c in enumerate(FEATS))}, class AS label, "
                         f"CASE WHEN {u(Q.SPLIT_SEED)} < 0.7 THEN 'train' ELSE 'test' END AS part FROM b")
    o["cast_all_double"] = "SELECT TRY_CAST(COLUMNS(* EXCLUDE (l_shipdate)) AS DOUBLE), epoch(l_shipdate)::DOUBLE AS l_shipdate FROM lineitem"
    o["derive_label"] = f"SELECT *, CAST(class AS DOUBLE) AS label FROM ({FX.ORDERS_BINARY_SQL})"
    o["shift_features"] = f"{B} SELECT {K}, {', '.join(f'{c} + 10.0 AS {c}' for c in FEATS)}, class FROM b"
    o["drop_columns"] = f"{B} SELECT {K}, l_quantity, l_extendedprice, class FROM b"
    o["rename_columns"] = f"{B} SELECT {K}, l_quantity AS qty, l_extendedprice, l_discount, l_tax, class AS label FROM b"
    o["select_alias"] = (f"{B} SELECT l_orderkey AS ok, l_linenumber AS ln, l_extendedprice * (1 - l_discount) AS revenue, "
                         "class AS label FROM b")
    o["select_except"] = f"{B} SELECT {K}, {', '.join(FEATS)} FROM b"
    o["pack_weighted_cells"] = (f"{B} SELECT {K}, " + ", ".join(
        f"{hu[c]} AS {c}_weight, {c} AS {c}_value, {hu[c]} * {c} AS {c}_res" for c in FEATS) + ", class FROM b")
    o["vector_to_columns"] = (f"SELECT vec_id, " + ", ".join(f"{vec(f'CAST(embedding[{i + 1}] AS DOUBLE)')} AS label{i}"
                                                           for i in range(30)) + f", label FROM ({FX.EMB_BINARY_SQL})")
    o["columns_to_array"] = f"{B} SELECT {K}, CAST({n} AS INTEGER) AS n_elems, l_quantity AS first_elem, l_tax AS last_elem, class FROM b"
    o["array_element"] = ("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[64] AS DOUBLE) AS e64, "
                          "CAST(embedding[65] AS DOUBLE) AS e65 FROM embeddings")
    o["class_lookup"] = (f"{B} SELECT {K}, class, CASE WHEN class = 0.0 THEN {dbl(EV.CUT_CONSTANT_CLASS0 / n)} "
                         f"WHEN class = 1.0 THEN {dbl(EV.CUT_CONSTANT_CLASS1 / n)} END AS cut FROM b")
    o["conditional_value"] = f"{B} SELECT {K}, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS big_qty FROM b"
    o["row_sum"] = f"{B} SELECT {K}, class, 0 AS sum, {row_sum(FEATS)} AS sumTotal, {row_sum(FEATS)} * class AS total FROM b"
    o["row_weighted_sum"] = f"{B} SELECT {K}, class, {row_sum([f'({hu[c]} * {c})' for c in FEATS])} AS sum FROM b"
    o["random_column"] = f"{B} SELECT {K}, {u(Q.SEED)} AS u FROM b"
    o["filter_class"] = f"{B} SELECT * FROM b WHERE class = 1.0"
    o["confident_filter"] = (f"{FP} SELECT {K}, label, prediction FROM f "
                             "WHERE (p0 > 0.6 AND label = 0) OR (p1 > 0.6 AND label = 1)")
    o["noise_filter_predicate"] = (f"{FP} SELECT {K}, label, prediction FROM f "
                                   "WHERE label = 1 OR (label = 0 AND label = prediction)")
    o["class_counts"] = f"{B} SELECT class, count(*) AS n FROM b GROUP BY class"
    o["class_max"] = f"{B} SELECT class, max({row_sum(FEATS)}) AS max_value FROM b GROUP BY class"
    o["column_sums"] = f"{B} SELECT " + ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) AS {c}" for c in FEATS) + " FROM b"
    o["class_ratio"] = (f"{B}, c AS (SELECT count_if(class = 1.0) AS n_num, count_if(class = 0.0) AS n_den FROM b) "
                        "SELECT n_num, n_den, CASE WHEN n_den = 0 THEN 'NaN'::DOUBLE ELSE n_num::DOUBLE / n_den::DOUBLE END AS ratio FROM c")
    o["confusion_matrix"] = f"{FP} SELECT label, prediction, count(*) AS n FROM f GROUP BY label, prediction"
    o["evaluate_scores"] = evaluate_sql(0.0)
    o["evaluate_scores_pos1"] = evaluate_sql(1.0)
    o["accuracy"] = (f"{FP}, c AS (SELECT count(*) AS n, count_if(prediction = label) AS correct FROM f) "
                     "SELECT n, correct, CASE WHEN n = 0 THEN 'NaN'::DOUBLE ELSE correct::DOUBLE / n::DOUBLE END AS accuracy FROM c")
    o["feature_covariance"] = covariance_sql()
    o["undersample"] = f"{undersample_sql()} SELECT * FROM bal"
    o["oversample"] = oversample_sql()
    o["balance"] = balance_sql()
    o["random_split"] = f"{B} SELECT {K}, class, {band_case(u(Q.SPLIT_SEED), [0.7, 0.3])} AS split FROM b"
    o["kfold_assign"] = f"{B} SELECT {K}, class, {band_case(u(Q.FOLD_SEED), [1.0] * 4)} AS fold FROM b"
    o["union_all"] = f"{B} SELECT * FROM b WHERE l_extendedprice > 50000 UNION ALL SELECT * FROM b WHERE l_discount > 0.05"
    o["union_many"] = f"{B} SELECT * FROM b"
    o["first_row"] = f"{B} SELECT * FROM b ORDER BY {K} LIMIT 1"
    o["weight_evolution"] = f"{B}, {evolution_scores_sql('b')} SELECT \"column\", {sig('score', Q.SIG_DIGITS)} AS score FROM sc"
    o["weight_evolution_hash"] = (f"{B}, {evolution_scores_sql('b', 'hash', Q.WEIGHT_SEED)} "
                                  f"SELECT \"column\", {sig('score', Q.SIG_DIGITS)} AS score FROM sc")
    o["top_k_columns"] = (f"{B}, {evolution_scores_sql('b')} SELECT \"column\", {sig('score', Q.SIG_DIGITS)} AS score "
                          f"FROM sc ORDER BY score DESC, \"column\" LIMIT {Q.TOP_K_REPORT}")
    o["evolved_feature_selection"] = evolved_selection_sql()
    o["assemble_features"] = f"{B} SELECT {K}, {', '.join(f'{vec(c)} AS {c}' for c in FEATS)}, class AS label FROM b"
    o["maxabs_scale"] = (f"{B}, m AS (SELECT " + ", ".join(f"max(abs({c})) AS m_{c}" for c in FEATS)
                         + f" FROM b WHERE {u(Q.SPLIT_SEED)} < 0.7) SELECT {K}, "
                         + ", ".join(f"{vec(f'{c} * (CASE WHEN m_{c} = 0 THEN 1.0 ELSE 1.0 / m_{c} END)')} AS {c}" for c in FEATS)
                         + ", class AS label FROM b, m")
    o["maxabs_scale_vectors"] = o["maxabs_scale"]
    o["chi2_statistic"] = chi2_sql()
    o["nb_classify"] = nb_sql()
    o["synthetic_bernoulli"] = synthetic_sql()
    o["median_band_filter"] = median_band_sql()
    o["instance_filter"] = instance_filter_sql()
    o["label_remap"] = f"{B} SELECT {K}, CAST(CASE WHEN class = 0.0 THEN -1.0 ELSE class END AS DOUBLE) AS class FROM b"
    o["string_index"] = (f"WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag), "
                         "r AS (SELECT l_returnflag, CAST(row_number() OVER (ORDER BY n DESC, l_returnflag) - 1 AS DOUBLE) "
                         f"AS flag_idx FROM c) SELECT {', '.join('l.' + k for k in KEYS)}, l.l_returnflag, r.flag_idx "
                         "FROM lineitem l JOIN r ON l.l_returnflag = r.l_returnflag")
    o["confusion_counts"] = (f"{FP} SELECT count_if(label = 1.0 AND prediction = 1.0) AS tp, "
                             "count_if(label = 0.0 AND prediction = 1.0) AS fp, count_if(label = 1.0 AND prediction = 0.0) AS fn, "
                             "count_if(label = 0.0 AND prediction = 0.0) AS tn FROM f")
    o["limit_rows"] = f"{B} SELECT * FROM b ORDER BY {K} LIMIT {Q.LIMIT_ROWS}"
    o["job_nb_accuracy"] = (f"SELECT count(*) AS n, count_if(prediction = label) AS correct, "
                            f"CASE WHEN count(*) = 0 THEN 'NaN'::DOUBLE ELSE count_if(prediction = label)::DOUBLE "
                            f"/ count(*)::DOUBLE END AS accuracy FROM ({nb_sql()}) p")
    scored = f"{B} SELECT {K}, class AS label, TRUE AS scored, TRUE AS passed FROM b WHERE {u(Q.SPLIT_SEED)} >= 0.7"
    for name in ("gbt_classify", "rf_classify", "mlp_classify", "fm_classify", "weighted_gbt_classify"):
        o[name] = scored
    o["noise_filter"] = f"{B} SELECT {K}, class AS label, TRUE AS once, TRUE AS ok, TRUE AS share FROM b"
    o["confidence_cascade"] = f"{B} SELECT {K}, class AS label, TRUE AS once, TRUE AS ok, TRUE AS share FROM b WHERE {u(Q.FOLD_SEED)} >= 0.3"
    o["job_cascade"] = o["confidence_cascade"]
    o["prepare_chain"] = prepare_chain_sql()
    o["pca_project_pair"] = pca_pair_sql()
    o["job_pca_preview"] = pca_first_sql(20)
    o["job_pca_preview_pair"] = pca_pair_sql(20)
    o["job_feature_preparation"] = o["prepare_chain"]
    o["chi2_fdr_select"] = chi2_selection_sql("rk <= last")
    o["chi2_percentile_select"] = chi2_selection_sql(f"rk <= {len(FEATS) // 2}")
    o["chi2_top_select"] = chi2_selection_sql("rk <= 3")
    o["sample_with_replacement"] = (f"{B}, f AS (SELECT 1.5::DOUBLE AS frac), {sql_poisson_ctes('f')} {copies_rows('b, pt', BCOLS, poisson(), 'TRUE')}")
    for kind in ("forest", "boosting"):
        o[f"{kind}_grown"] = (f"{grown_predictions(kind)} SELECT {K}, class AS label, prediction::DOUBLE AS prediction, round(probability, 9) AS probability "
                              "FROM bn JOIN pr USING (id) WHERE su >= 0.7")
    o["forest_nodes"] = (f"WITH {grown_rows('su < 0.7')}, {tree_ctes('f', 'w', FX.ML_BINNED_FEATURES, Q.GROWN_DEPTH, True)}, nodes AS (WITH {nodes_sql('f', Q.GROWN_DEPTH)}) "
                         f"SELECT tree, nodes.* FROM nodes, range({Q.GROWN_FOREST['nTrees']}) AS t(tree)")
    o["noise_filter_grown"] = (f"WITH {grown_rows('bn.fold <> g', '0, 1, 2, 3')}, {tree_ctes('f', 'w', FX.ML_BINNED_FEATURES, Q.GROWN_DEPTH, True)} "
                               f"SELECT {K}, class AS label FROM bn JOIN fout o ON o.id = bn.id AND o.g = bn.fold WHERE class = 1.0 OR o.pred = class")
    o["cascade_grown"] = o["job_cascade_grown"] = grown_cascade()
    o["job_rf_grown"], o["job_gbt_grown"] = grown_scores("forest", 1.0), grown_scores("boosting", 0.0)
    counts = ", ".join(f"(SELECT {sql_poisson_copies(['o_orderkey'], Q.SEED)} FROM pt{i}) AS n{i}" for i in range(len(Q.POISSON_FRACTIONS)))
    tables = ", ".join(f"f{i} AS (SELECT {dbl(f)} AS frac), {sql_poisson_ctes(f'f{i}', str(i))}" for i, f in enumerate(Q.POISSON_FRACTIONS))
    o["poisson_counts"] = f"WITH {tables} SELECT o_orderkey, {counts} FROM orders"
    types = ["bigint", "bigint", "bigint", "int", "timestamp_ntz", "double", "double", "double", "double", "double"]
    o["schema_table"] = f"{B} " + " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS position, '{c}' AS name, '{t}' AS type, {'FALSE' if c == 'class' else 'TRUE'} AS nullable, count(*) AS n_rows, count({c}) AS n_present FROM b"
        for i, (c, t) in enumerate(zip([*KEYS, *FEATS, "class"], types, strict=True)))
    texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in (*KEYS, *FEATS, "class"))
    o["preview_rows"] = f"{B} SELECT {texts} FROM (SELECT * FROM b ORDER BY {K} LIMIT 20)"
    for name in ("job_gbt_score", "job_gbt_prepared_score", "job_gbt_pca_score"):
        o[name] = job_score_sql(0.0)
    o["job_rf_score"] = job_score_sql(1.0)
    o["job_fm_score"] = job_score_sql(0.0, ", count_if(tr) AS n_train")
    o["job_mlp_score"] = job_score_sql(0.0, ", count_if(tr) AS n_train, count_if(NOT tr) AS n_test")
    o["job_pca_weighted_gbt_score"] = job_score_sql(0.0, ", count_if(tr AND class = 0.0) AS n_train_0, count_if(tr AND class = 1.0) AS n_train_1")
    o["job_csv_mlp"] = f"{B} SELECT {', '.join(Q.CSV_KEYS)}, class AS label, TRUE AS scored, TRUE AS passed FROM b"
    o["job_evolved_selection"] = evolved_selection_sql()
    o["job_synthetic"] = job_synthetic_sql()
    return o


ORACLE = build()
