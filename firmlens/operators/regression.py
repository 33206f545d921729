"""Panel regression with fixed effects and errors clustered by firm, from sufficient statistics.

The rows are read once and reduced to cells (firm, effect levels) with counts, sums and
sums of products around the sample mean. Every specification works on the cells: group
means shift them, firm means are taken out of firm totals, and a second effect enters by
its counts per (firm, level). Up to ``DIRECT_LEVELS`` levels its normal equations are solved
on the driver; beyond that by preconditioned conjugate gradients whose vectors stay in Spark.
The driver sees matrices of regressors, of so many levels, or a few numbers per round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlens.functions.dist import t_p_value
from firmlens.operators.quantiles import exact_quantiles
from firmlens.operators.scale import join_on
from firmlens.session import cut_lineage

SCHEMA = "spec string, term string, estimate double, std_error double, t double, p double, stars string, n long, r2 double, adj_r2 double"
DIRECT_LEVELS = 1000  # a matrix of 8 MB on the driver
TOLERANCE, ROUNDING, MAX_ROUNDS = 1e-11, 1e-14, 2000
Model = tuple[str, Sequence[str], Sequence[str], bool]  # spec, regressors, effect, firm effect


def decile_dummies(df: DataFrame, score: str, low: str, high: str, by: str = "year") -> DataFrame:
    """1.0 / 0.0 for scores within the yearly bottom and top tenth, null without a score."""
    cuts = exact_quantiles(df, [by], score, [0.1, 0.9], ["__low", "__high"])
    flags = {low: (F.col(score) <= F.col("__low")).cast("double"), high: (F.col(score) >= F.col("__high")).cast("double")}
    return join_on(df, cuts, [by], "left").withColumns(flags).drop("__low", "__high")


def with_interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Product columns 'a:b'."""
    return df.withColumns({f"{a}:{b}": F.col(a) * F.col(b) for a, b in pairs})


def with_dummies(df: DataFrame, column: str, levels: Sequence, prefix: str) -> DataFrame:
    """1.0 / 0.0 columns for every level but the first."""
    return df.withColumns({f"{prefix}{v}": (F.col(column) == v).cast("double") for v in levels[1:]})


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _cells(rows: DataFrame, names: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """Counts, sums and sums of products per key, each variable less its sample mean, and the means."""
    means = rows.agg(*[F.avg(_c(x)).alias(f"m{i}") for i, x in enumerate(names)]).first()
    v = [_c(x) - F.lit(float(m or 0.0)) for x, m in zip(names, means)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(v)]
    products = [F.sum(v[i] * v[j]).alias(f"p{i}_{j}") for i, j in _pairs(len(names))]
    return cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products)), [float(m or 0.0) for m in means]


def _moved(cells: DataFrame, k: int, cluster: str, group: Sequence[str] = (), shift: DataFrame | None = None) -> DataFrame:
    """The cells after taking ``shift`` (m0.. per group) from the variables, for sums over any of them.

    r and q keep the unshifted squares and sums, for the spread of the sample.
    """
    m = [F.col(f"m{i}") if shift is not None else F.lit(0.0) for i in range(k)]
    s, p = lambda i: F.col(f"s{i}"), lambda i, j: F.col(f"p{min(i, j)}_{max(i, j)}")
    return (cells if shift is None else join_on(cells, shift, list(group))).select(
        cluster,
        "n",
        *[(s(i) - F.col("n") * m[i]).alias(f"s{i}") for i in range(k)],
        *[(p(i, j) - m[i] * s(j) - m[j] * s(i) + F.col("n") * m[i] * m[j]).alias(f"p{i}_{j}") for i, j in _pairs(k)],
        *[p(i, i).alias(f"r{i}") for i in range(k)],
        *[s(i).alias(f"q{i}") for i in range(k)],
    )


def _within(moved: DataFrame, k: int, cluster: str) -> DataFrame:
    """Totals per firm with the firm means taken out."""
    s, p = lambda i: F.col(f"s{i}"), lambda i, j: F.col(f"p{i}_{j}")
    totals = moved.groupBy(cluster).agg(*[F.sum(c).alias(c) for c in moved.columns if c != cluster])
    return totals.withColumns({f"p{i}_{j}": p(i, j) - s(i) * s(j) / F.col("n") for i, j in _pairs(k)}).withColumns({f"s{i}": F.lit(0.0) for i in range(k)})


def _matrix(row, k: int, prefix: str = "p") -> np.ndarray:
    out = np.zeros((k, k))
    for i, j in _pairs(k):
        out[i, j] = out[j, i] = row[f"{prefix}{i}_{j}"] or 0.0
    return out


def _usable(gram: np.ndarray, raw: np.ndarray) -> list[int]:
    """Columns that add variation to the ones before them."""
    kept: list[int] = []
    for j in range(gram.shape[0]):
        left = gram[j, j]
        if kept:
            block = gram[np.ix_(kept, kept)]
            left -= gram[j, kept] @ np.linalg.solve(block, gram[kept, j])
        if left > 1e-9 * max(raw[j], 1e-300):
            kept.append(j)
    return kept


@dataclass
class _Spec:
    name: str
    xs: list[str]
    effect: list[str]
    firm_effect: bool
    means: list[float]
    levels: int = 0
    rank: int = 0


def _second_effect(cells: DataFrame, k: int, cluster: str, effect: list[str], direct: int) -> tuple[DataFrame, int, int]:
    """Shift per level that takes out the other effect next to firm effects, with its levels and rank.

    The dummies' products within firms are diag(n_g) - sum_f n_fg n_fh / n_f, from the counts of the cells alone. That is the
    Laplacian of the levels that share firms, so its rank is the number of levels less that of connected parts.
    """
    own = cells.groupBy(cluster, *effect).agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    firm = own.groupBy(cluster).agg(F.sum("n").alias("__n"), *[F.sum(f"s{i}").alias(f"__s{i}") for i in range(k)])
    both = cut_lineage(own.join(firm, cluster).withColumn("share", F.col("n") / F.col("__n")))
    across = [F.sum(F.col(f"s{i}") - F.col("share") * F.col(f"__s{i}")).alias(f"d{i}") for i in range(k)]
    levels = cut_lineage(both.groupBy(*effect).agg(F.sum("n").alias("n"), *across))
    both = both.select(cluster, *effect, "n", "share")
    count = levels.count()
    if count <= direct:
        return _direct(both, levels, k, cluster, effect)
    spread = cells.agg(*[F.sum(f"p{i}_{i}").alias(f"p{i}") for i in range(k)]).first()
    return _conjugate_gradients(both, levels, [float(v) for v in spread], cluster, effect), count, count - _parts(both, cluster, effect)


def _direct(both: DataFrame, levels: DataFrame, k: int, cluster: str, effect: list[str]) -> tuple[DataFrame, int, int]:
    """The normal equations as one matrix, for a bounded number of levels."""
    rows = levels.collect()
    place = {tuple(r[e] for e in effect): g for g, r in enumerate(rows)}
    left = both.select(cluster, F.struct(*effect).alias("a"), "share")
    right = both.select(cluster, F.struct(*effect).alias("b"), F.col("n").alias("m"))
    dummies = np.diag([float(r["n"]) for r in rows])
    for r in left.join(right, cluster).groupBy("a", "b").agg(F.sum(F.col("share") * F.col("m")).alias("x")).toLocalIterator():
        dummies[place[tuple(r["a"])], place[tuple(r["b"])]] -= r["x"]
    cross = np.array([[r[f"d{i}"] for i in range(k)] for r in rows])
    shift = np.linalg.pinv(dummies, rcond=1e-10, hermitian=True) @ cross
    rank = int(np.linalg.matrix_rank(dummies, tol=1e-8 * max(1.0, np.abs(dummies).max()), hermitian=True))
    schema = T.StructType([*[levels.schema[e] for e in effect], *[T.StructField(f"m{i}", T.DoubleType()) for i in range(k)]])
    return levels.sparkSession.createDataFrame([(*key, *map(float, shift[g])) for key, g in place.items()], schema), len(rows), rank


def _conjugate_gradients(both: DataFrame, levels: DataFrame, spread: list[float], cluster: str, effect: list[str]) -> DataFrame:
    """The same shifts by conjugate gradients with the counts as preconditioner; one written table of levels and one row to the driver a round.

    The right sides go side by side, each with its own step; what is rounding beside the variable's own ``spread`` counts as solved. A round costs two sums over (firm, level) counts: the product with
    the matrix is n_g p_g less the share of each firm's sum of n_fh p_h.
    """
    each = range(len(spread))
    state = levels.select(*effect, "n", *[F.lit(0.0).alias(f"x{i}") for i in each], *[F.col(f"d{i}").alias(f"r{i}") for i in each], *[(F.col(f"d{i}") / F.col("n")).alias(f"p{i}") for i in each])
    first: list[float] | None = None
    for _ in range(MAX_ROUNDS):
        moved = join_on(both, state.select(*effect, *[f"p{i}" for i in each]), effect)
        firms = moved.groupBy(cluster).agg(*[F.sum(F.col("n") * F.col(f"p{i}")).alias(f"t{i}") for i in each])
        taken = join_on(both, firms, [cluster]).groupBy(*effect).agg(*[F.sum(F.col("share") * F.col(f"t{i}")).alias(f"t{i}") for i in each])
        now = join_on(state, taken, effect).withColumns({f"q{i}": F.col("n") * F.col(f"p{i}") - F.col(f"t{i}") for i in each}).drop(*[f"t{i}" for i in each])
        now = cut_lineage(now)
        sums = []
        for i in each:
            p, q, r = F.col(f"p{i}"), F.col(f"q{i}"), F.col(f"r{i}")
            sums += [F.sum(p * q).alias(f"pq{i}"), F.sum(r * r / F.col("n")).alias(f"rr{i}"), F.sum(r * q / F.col("n")).alias(f"rq{i}"), F.sum(q * q / F.col("n")).alias(f"qq{i}")]
        row = now.agg(*sums).first()
        left = [row[f"rr{i}"] for i in each]
        first = first or left
        steps, turns = [], []
        for i in each:
            live = left[i] > max(TOLERANCE**2 * first[i], ROUNDING**2 * spread[i]) and row[f"pq{i}"] > 0
            step = left[i] / row[f"pq{i}"] if live else 0.0
            after = max(left[i] - 2 * step * row[f"rq{i}"] + step * step * row[f"qq{i}"], 0.0)
            steps.append(step)
            turns.append(after / left[i] if live else 0.0)
        if not any(steps):
            return now.select(*effect, *[F.col(f"x{i}").alias(f"m{i}") for i in each])
        r = [F.col(f"r{i}") - F.lit(steps[i]) * F.col(f"q{i}") for i in each]
        state = now.select(
            *effect, "n", *[(F.col(f"x{i}") + F.lit(steps[i]) * F.col(f"p{i}")).alias(f"x{i}") for i in each],
            *[r[i].alias(f"r{i}") for i in each], *[(r[i] / F.col("n") + F.lit(turns[i]) * F.col(f"p{i}")).alias(f"p{i}") for i in each],
        )
    raise ValueError("the effects could not be separated")


def _parts(both: DataFrame, cluster: str, effect: list[str]) -> int:
    """Connected parts of the levels that share firms: every level takes the smallest name among its neighbours', then that one's own name."""
    ties = cut_lineage(both.select(cluster, F.xxhash64(*effect).alias("level")))
    names = cut_lineage(ties.groupBy("level").agg(F.first("level").alias("name")))
    while True:
        by_firm = ties.join(names, "level").groupBy(cluster).agg(F.min("name").alias("low"))
        low = ties.join(by_firm, cluster).groupBy("level").agg(F.min("low").alias("low"))
        known = names.select(F.col("level").alias("low"), F.col("name").alias("lower"))
        new = cut_lineage(names.join(low.join(known, "low"), "level").select("level", F.least("name", "lower").alias("next"), "name"))
        if new.where("next <> name").isEmpty():
            return new.select("name").distinct().count()
        names = new.select("level", F.col("next").alias("name"))


def fit_all(df: DataFrame, y: str, models: Sequence[Model], cluster: str = "firm", direct: int = DIRECT_LEVELS) -> DataFrame:
    """Least squares of ``y`` for several (spec, regressors, effect, firm effect), errors clustered by firm.

    Effects are taken out within their groups and, if asked, within firms; without any there is an
    intercept. Rows with a null in a model's columns are left out of it, as are columns without variation
    of their own (their estimate is null). Beside firm effects, up to ``direct`` levels are solved on the driver.
    """
    effects = list(dict.fromkeys(c for _, _, effect, _ in models for c in effect))
    used = dict.fromkeys([cluster, y, *[c for _, xs, _, _ in models for c in xs], *effects])
    rows = cut_lineage(df.select(*[_c(c) for c in used]).dropna(subset=[cluster, y]))
    tables, specs, counts = [], [], []
    by_columns: dict[tuple[str, ...], tuple] = {}
    for name, xs, effect, firm_effect in models:
        names, k = [y, *xs], len(xs) + 1
        if tuple(xs) not in by_columns:
            sample = rows.dropna(subset=list(xs)).select(cluster, *effects, *[_c(n).cast("double").alias(n) for n in names])
            by_columns[tuple(xs)] = _cells(sample, names, [cluster, *effects])
        cells, means = by_columns[tuple(xs)]
        group = list(effect)
        cells = cells.dropna(subset=group) if group else cells
        spec = _Spec(name, list(xs), group, firm_effect, means)
        if group and firm_effect:
            shift, spec.levels, spec.rank = _second_effect(cells, k, cluster, group, direct)
            table = _moved(cells, k, cluster, group, shift)
        elif group:
            n = F.sum("n")
            shift = cells.groupBy(*group).agg(*[(F.sum(f"s{i}") / n).alias(f"m{i}") for i in range(k)])
            table = _moved(cells, k, cluster, group, shift)
            counts.append(shift.select(F.lit(len(specs)).alias("spec")))
        else:
            table = _moved(cells, k, cluster)
        table = cut_lineage(_within(table, k, cluster)) if firm_effect else table
        specs.append(spec)
        tables.append(table.withColumn("__spec", F.lit(len(specs) - 1)))
    for r in union_all(counts).groupBy("spec").count().collect() if counts else ():
        specs[r["spec"]].levels = r["count"]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    most = max(len(s.xs) for s in specs) + 1
    wanted = [f"{c}{i}" for c in "rq" for i in range(most)] + [f"p{i}_{j}" for i, j in _pairs(most)]
    sums = {r["__spec"]: r for r in every.groupBy("__spec").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in wanted]).collect()}
    solved = [_coefficients(spec, sums[i]) if i in sums else None for i, spec in enumerate(specs)]
    meat = _meat(every, solved, most, cluster)
    parts = [_rows_of(spec, sums[i], solved[i], *meat[i]) for i, spec in enumerate(specs) if solved[i] is not None]
    return df.sparkSession.createDataFrame([r for part in parts for r in part], SCHEMA)


def fit(df: DataFrame, y: str, xs: Sequence[str], spec: str, effect: Sequence[str] = (), firm_effect: bool = False, cluster: str = "firm", direct: int = DIRECT_LEVELS) -> DataFrame:
    """One model of ``fit_all``."""
    return fit_all(df, y, [(spec, xs, effect, firm_effect)], cluster, direct)


def _coefficients(spec: _Spec, row) -> tuple[list[int], np.ndarray, np.ndarray, float, float]:
    """Kept columns, their coefficients, the inverse of their products, residual and total sums of squares."""
    k = len(spec.xs) + 1
    gram = _matrix(row, k)
    spread = np.array([row[f"r{i}"] - row[f"q{i}"] ** 2 / row["n"] for i in range(k)])
    kept = _usable(gram[1:, 1:], spread[1:])
    inverse = np.linalg.inv(gram[1:, 1:][np.ix_(kept, kept)])
    cross = gram[1:, 0][kept]
    beta = inverse @ cross
    return kept, beta, inverse, float(gram[0, 0] - 2 * beta @ cross + beta @ gram[1:, 1:][np.ix_(kept, kept)] @ beta), float(spread[0])


def _meat(every: DataFrame, solved: list, most: int, cluster: str) -> dict[int, tuple[np.ndarray, int]]:
    """Products of the firms' scores of each spec, place 0 is the intercept's, and the number of firms.

    A score is linear in sums and products, so the cells are scored first and only scores are shuffled by firm.
    """
    full = []
    for found in solved:
        beta = np.zeros(most - 1)
        if found is not None:
            beta[found[0]] = found[1]
        full.append(beta)
    b = F.array(*[F.array(*[F.lit(float(x)) for x in beta]) for beta in full])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    p = lambda i, j: zero(f"p{min(i, j)}_{max(i, j)}")
    scored = every.withColumn("__b", F.get(b, F.col("__spec")))
    own = [F.get("__b", F.lit(j)) for j in range(most - 1)]
    residual = lambda of: of(0) - sum((own[j] * of(j + 1) for j in range(most - 1)), F.lit(0.0))
    scores = {"u0": residual(lambda j: zero(f"s{j}"))} | {f"u{a}": residual(lambda j, a=a: p(a, j)) for a in range(1, most)}
    cells = [F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"p{i}_{j}") for i, j in _pairs(most)]
    firms = scored.select("__spec", cluster, *[u.alias(name) for name, u in scores.items()]).groupBy("__spec", cluster).agg(*[F.sum(u).alias(u) for u in scores])
    return {r["__spec"]: (_matrix(r, most), r["clusters"]) for r in firms.groupBy("__spec").agg(F.count(F.lit(1)).alias("clusters"), *cells).collect()}


def _rows_of(spec: _Spec, row, solved, meat: np.ndarray, clusters: int) -> list[tuple]:
    kept, beta, inverse, ssr, total = solved
    n, ss = row["n"], [1 + i for i in kept]
    if not spec.effect and not spec.firm_effect:
        # the variables are centred, so the intercept stands alone; it is moved back to the original zero
        bread = np.zeros((len(kept) + 1,) * 2)
        bread[0, 0], bread[1:, 1:] = 1 / n, inverse
        move = np.eye(len(kept) + 1)
        move[0, 1:] = [-spec.means[1 + i] for i in kept]
        bread, places = move @ bread, [0, *ss]
        used, values = ["(Intercept)", *[spec.xs[i] for i in kept]], [spec.means[0] - sum(b * spec.means[1 + i] for i, b in zip(kept, beta)), *beta]
        fixed_se = fixed_all = 0
        terms = ["(Intercept)", *spec.xs]
    else:
        bread, places, used, values, terms = inverse, ss, [spec.xs[i] for i in kept], list(beta), spec.xs
        if spec.effect:
            fixed_se, fixed_all = spec.levels, spec.rank + clusters if spec.firm_effect else spec.levels
        else:
            fixed_se, fixed_all = 1, clusters
    adjust = (n - 1) / (n - len(used) - fixed_se) * clusters / (clusters - 1)
    variance = bread @ meat[np.ix_(places, places)] @ bread.T * adjust
    errors = dict(zip(used, np.sqrt(np.maximum(np.diag(variance), 0.0))))
    k_all = len(used) + fixed_all
    r2 = 1 - ssr / total if total else None
    adj = 1 - (ssr / (n - k_all)) / (total / (n - 1)) if total and n > k_all else None
    values, out = dict(zip(used, values)), []
    for term in terms:
        if term not in values:
            out.append((spec.name, term, None, None, None, None, "", n, r2, adj))
            continue
        estimate, error = float(values[term]), float(errors[term])
        t = estimate / error if error > 0 else None
        p = t_p_value(t, clusters - 1) if t is not None else None
        mark = "" if p is None else "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""
        out.append((spec.name, term, estimate, error, t, p, mark, n, r2, adj))
    return out


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def panel_specs(main: Sequence[str], controls: Sequence[str], prefix: str = "") -> list[Model]:
    """Six specifications: none, controls, then year, sector, sector x year, and sector x year + firm effects."""
    full = [*main, *controls]
    return [
        (prefix + "0 none", main, [], False),
        (prefix + "1 controls", full, [], False),
        (prefix + "2 year", full, ["year"], False),
        (prefix + "3 sector", full, ["sector"], False),
        (prefix + "4 sector-year", full, ["sector", "year"], False),
        (prefix + "5 sector-year and firm", full, ["sector", "year"], True),
    ]


def panel_models(panel: DataFrame, main: Sequence[str], controls: Sequence[str]) -> DataFrame:
    return fit_all(panel, "transp", panel_specs(main, controls))


def trend_models(panel: DataFrame, controls: Sequence[str], low: str = "q10", high: str = "q90") -> DataFrame:
    """Diverging trends of the bottom and top tenth: plain, controls, sector effects, firm effects."""
    base = [low, high, "t", f"{low}:t", f"{high}:t"]
    data = with_interactions(panel, [(low, "t"), (high, "t")])
    full = [*base, *controls]
    return fit_all(
        data,
        "transp",
        [("1 plain", base, [], False), ("2 controls", full, [], False), ("3 sector", full, ["sector"], False), ("4 firm", full, [], True)],
    )


def outcome_models(df: DataFrame, outcome: str, years: Sequence[int], extra: str = "transp") -> DataFrame:
    """Log outcome on year dummies, without and with one more regressor; exp(estimate) for reading."""
    data = with_dummies(df, "year", list(years), "year")
    dummies = [f"year{v}" for v in list(years)[1:]]
    both = fit_all(data, outcome, [("1 years", dummies, [], False), (f"2 years and {extra}", [*dummies, extra], [], False)])
    return both.withColumn("exp_estimate", F.when(F.col("term") != "(Intercept)", F.exp("estimate")))
