"""Fixed-effect regressions against dense dummy-variable least squares in numpy."""

import itertools

import numpy as np
import pandas as pd
import pytest

from firmlens.functions.dist import _distance_tail, f_p_value, f_quantile, incomplete_beta, rank_distances, rank_p_value, t_p_value, t_quantile
from firmlens.operators import regression
from firmlens.operators.regression import fit
from firmlens.operators.validation import icc, spearman, welch


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(5)
    rows = []
    for firm in range(40):
        sector, effect = "ABC"[firm % 3], rng.normal()
        for year in range(2014, 2014 + rng.integers(2, 8)):
            x1, x2 = rng.normal(), rng.normal() + effect
            rows.append((firm, year, sector, 0.5 * x1 - 0.2 * x2 + effect + 0.1 * (year - 2014) + rng.normal() * 0.3, x1, x2, 1.0 if sector == "A" else 0.0))
    return pd.DataFrame(rows, columns=["firm", "year", "sector", "y", "x1", "x2", "constant_in_firm"])


def dense(df, xs, effects, nested):
    """Coefficients and firm-clustered errors with every effect as dummies."""
    parts = [df[xs].to_numpy(float)]
    parts += [pd.get_dummies(df[e].astype(str).agg("_".join, axis=1)).to_numpy(float) for e in effects] or [np.ones((len(df), 1))]
    x = np.hstack(parts)
    y = df["y"].to_numpy()
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    u = y - x @ beta
    scores = pd.DataFrame(x * u[:, None]).groupby(df["firm"].to_numpy()).sum().to_numpy()
    clusters, n = len(scores), len(df)
    fixed = sum(p.shape[1] for e, p in zip(effects or [["-"]], parts[1:]) if e not in nested) + (1 if nested and len(effects) == len(nested) else 0)
    adjust = (n - 1) / (n - len(xs) - fixed) * clusters / (clusters - 1)
    v = inverse @ scores.T @ scores @ inverse * adjust
    k = len(xs)
    return beta[:k], np.sqrt(np.diag(v)[:k])


CASES = [
    ([], False, [], []),
    (["year"], False, [["year"]], []),
    (["sector", "year"], False, [["sector", "year"]], []),
    ([], True, [["firm"]], [["firm"]]),
    (["sector", "year"], True, [["sector", "year"], ["firm"]], [["firm"]]),
]


@pytest.mark.parametrize("effect,firm,effects,nested", CASES)
def test_fit_equals_dense(spark, panel, effect, firm, effects, nested):
    got = {r["term"]: r for r in fit(spark.createDataFrame(panel), "y", ["x1", "x2"], "s", effect, firm).collect()}
    beta, errors = dense(panel, ["x1", "x2"], effects, nested)
    assert np.allclose([got["x1"]["estimate"], got["x2"]["estimate"]], beta, atol=1e-8)
    assert np.allclose([got["x1"]["std_error"], got["x2"]["std_error"]], errors, rtol=1e-6)


def test_adjusted_r2_counts_the_rank_of_overlapping_effects(spark, panel):
    """Sector is constant within firms, so firm effects take one level of every sector."""
    got = fit(spark.createDataFrame(panel), "y", ["x1", "x2"], "s", ["sector", "year"], True).first()
    dummies = np.hstack([pd.get_dummies(panel[e].astype(str).agg("_".join, axis=1)).to_numpy(float) for e in (["sector", "year"], ["firm"])])
    x = np.hstack([panel[["x1", "x2"]].to_numpy(), dummies])
    y = panel["y"].to_numpy()
    ssr = ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()
    n, total = len(y), ((y - y.mean()) ** 2).sum()
    assert abs(got["r2"] - (1 - ssr / total)) < 1e-9
    assert abs(got["adj_r2"] - (1 - ssr / (n - np.linalg.matrix_rank(x)) / (total / (n - 1)))) < 1e-9


@pytest.mark.parametrize("xs", [["x1", "x2"], ["x1", "x2", "constant_in_firm"]])
def test_conjugate_gradients_equal_the_direct_solve(spark, panel, xs):
    """Sectors are parts of their own; a hole and a firm of its own make more."""
    data = spark.createDataFrame(pd.concat([panel, pd.DataFrame([(99, 2030, "Z", 1.0, 2.0, 3.0, 0.0), (98, 2031, "A", 1.0, 0.0, 1.0, 1.0)], columns=panel.columns)]))
    ways = [[tuple(r) for r in fit(data, "y", xs, "s", ["sector", "year"], True, direct=d).collect()] for d in (0, 1000)]
    for a, b in zip(*ways):
        assert a[:2] == b[:2] and [x is None for x in a] == [x is None for x in b]
        assert np.allclose([x for x in a[2:] if isinstance(x, float)], [x for x in b[2:] if isinstance(x, float)], rtol=1e-6, atol=1e-9)


def test_many_levels(spark):
    """3,000 levels, no matrix of them: estimates equal those of a sparse alternation on the rows."""
    rng = np.random.default_rng(11)
    n, firms, levels = 12_000, 900, 3_000
    df = pd.DataFrame({"firm": rng.integers(0, firms, n), "place": rng.integers(0, levels, n), "x1": rng.normal(size=n), "x2": rng.normal(size=n)})
    df["y"] = 0.7 * df["x1"] - 0.3 * df["x2"] + rng.normal(size=firms)[df["firm"]] + rng.normal(size=levels)[df["place"]] + rng.normal(size=n)
    within = df[["y", "x1", "x2"]].copy()
    for _ in range(300):
        for key in ("firm", "place"):
            within -= within.groupby(df[key]).transform("mean")
    want = np.linalg.lstsq(within[["x1", "x2"]].to_numpy(), within["y"].to_numpy(), rcond=None)[0]
    got = {r["term"]: r["estimate"] for r in fit(spark.createDataFrame(df), "y", ["x1", "x2"], "s", ["place"], True).collect()}
    assert np.allclose([got["x1"], got["x2"]], want, atol=1e-8)


def test_large_means_keep_their_digits(spark, panel):
    far = panel.assign(y=panel["y"] + 1e8, x1=panel["x1"] + 1e8)
    got = {r["term"]: r for r in fit(spark.createDataFrame(far), "y", ["x1", "x2"], "s").collect()}
    want, errors = dense(panel, ["x1", "x2"], [], [])
    assert np.allclose([got["x1"]["estimate"], got["x2"]["estimate"]], want, atol=1e-6)
    assert np.allclose([got["x1"]["std_error"], got["x2"]["std_error"]], errors, rtol=1e-5)


def test_intercept_error_equals_dense(spark, panel):
    got = {r["term"]: r for r in fit(spark.createDataFrame(panel), "y", ["x1", "x2"], "s").collect()}["(Intercept)"]
    x = np.column_stack([np.ones(len(panel)), panel["x1"], panel["x2"]])
    y = panel["y"].to_numpy()
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    scores = pd.DataFrame(x * (y - x @ beta)[:, None]).groupby(panel["firm"].to_numpy()).sum().to_numpy()
    n, c = len(y), len(scores)
    error = np.sqrt((inverse @ scores.T @ scores @ inverse)[0, 0] * (n - 1) / (n - 3) * c / (c - 1))
    assert abs(got["estimate"] - beta[0]) < 1e-9 and abs(got["std_error"] - error) < 1e-9


def test_models_with_different_samples(spark, panel):
    holes = panel.assign(x2=panel["x2"].where(panel.index % 5 > 0), sector=panel["sector"].where(panel.index % 7 > 0))
    df = spark.createDataFrame(holes.replace({np.nan: None}))
    models = [("a", ["x1"], [], False), ("b", ["x1", "x2"], ["sector"], False), ("c", ["x1", "x2"], ["year"], True)]
    together = {(r["spec"], r["term"]): tuple(r) for r in regression.fit_all(df, "y", models).collect()}
    for spec, xs, effect, firm in models:
        for r in fit(df, "y", xs, spec, effect, firm).collect():
            assert np.allclose([x for x in r if isinstance(x, float)], [x for x in together[(spec, r["term"])] if isinstance(x, float)])
            assert r["n"] == together[(spec, r["term"])][7]
    assert together[("b", "x1")][7] == len(holes.dropna())


def test_column_without_own_variation_is_dropped(spark, panel):
    got = {r["term"]: r["estimate"] for r in fit(spark.createDataFrame(panel), "y", ["x1", "constant_in_firm"], "s", [], True).collect()}
    assert got["constant_in_firm"] is None and got["x1"] is not None


def test_t_distribution():
    assert abs(t_p_value(2.0, 10) - 0.07338803) < 1e-7
    assert abs(t_p_value(-12.706204736, 1) - 0.05) < 1e-9
    assert abs(t_quantile(0.975, 10) - 2.228138852) < 1e-7
    assert abs(incomplete_beta(2, 3, 0.5) - 0.6875) < 1e-12
    assert t_p_value(None, 3) is None


def test_icc_published_example(spark):
    rows = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]
    got = {r["type"]: r["icc"] for r in icc(spark.createDataFrame(rows, "a int, b int, c int, d int"), list("abcd")).collect()}
    want = {"ICC1": 0.17, "ICC2": 0.29, "ICC3": 0.71, "ICC1k": 0.44, "ICC2k": 0.62, "ICC3k": 0.91}
    assert {k: round(v, 2) for k, v in got.items()} == want


def test_icc_tests_and_limits(spark):
    rows = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]
    found = icc(spark.createDataFrame(rows, "a int, b int, c int, d int"), list("abcd")).collect()
    want = {"ICC1": (1.8, 5, 18, -0.133, 0.72), "ICC2": (11.0, 5, 15, 0.019, 0.76), "ICC3": (11.0, 5, 15, 0.342, 0.95)}
    want |= {"ICC1k": (1.8, 5, 18, -0.884, 0.91), "ICC2k": (11.0, 5, 15, 0.071, 0.93), "ICC3k": (11.0, 5, 15, 0.676, 0.99)}
    assert {r["type"]: (round(r.f, 1), r.df1, r.df2, round(r.lower, 3), round(r.upper, 2)) for r in found} == want
    assert {round(r.p, 5) for r in found} == {0.16477, 0.00013}


@pytest.mark.parametrize("rows", [[], [(1, 2)], [(3, 3), (3, 3)], [(1, 1), (2, 2)], [(None, 1)]])
def test_icc_of_few_or_equal_rows(spark, rows):
    found = icc(spark.createDataFrame(rows, "a int, b int"), ["a", "b"]).collect()
    assert len(found) == 6 and all(r.p is r.lower is r.upper is None for r in found)
    assert all(r.icc == 1 for r in found) if rows == [(1, 1), (2, 2)] else all(r.icc is None for r in found)


def test_f_distribution():
    # with two degrees of freedom above or below, the tail has a closed form
    for df, f in [(1, 0.3), (3, 2.5), (18, 1.1), (400, 3.0), (50_000, 1.2), (10**9, 2.0)]:
        assert abs(f_p_value(f, 2, df) - np.exp(-df / 2 * np.log1p(2 * f / df))) < 1e-9
        assert abs(f_p_value(f, df, 2) - (-np.expm1(-df / 2 * np.log1p(2 / (df * f))))) < 1e-9
    assert abs(f_p_value(2.0, 1, 7) - t_p_value(2.0**0.5, 7)) < 1e-12
    for d1, d2 in [(5, 18), (1, 1), (3.7, 900), (2e5, 1.5e5), (3e6, 5e6)]:
        for prob in (0.025, 0.5, 0.975):
            assert abs(f_p_value(f_quantile(prob, d1, d2), d1, d2) - (1 - prob)) < 1e-9
        assert abs(f_quantile(0.975, d1, d2) * f_quantile(0.025, d2, d1) - 1) < 1e-6
    near, far = f_p_value(1.002, 0.99e6, 0.99e6), f_p_value(1.002, 1.01e6, 1.01e6)
    assert abs(near - far) < 0.01 and f_p_value(None, 1, 1) is None


def test_welch(spark):
    rows = [("T", x) for x in (0.5, 0.6, 0.7, 0.9)] + [("M", x) for x in (0.1, 0.2, 0.3)] + [("M", None)]
    got = welch(spark.createDataFrame(rows, "g string, transp double"), "transp", "g", ["T"], "M").first()
    assert abs(got["diff_pp"] - 47.5) < 1e-9 and got["n"] == 4
    se2 = np.var([0.5, 0.6, 0.7, 0.9], ddof=1) / 4 + np.var([0.1, 0.2, 0.3], ddof=1) / 3
    assert abs(got["t"] - 0.475 / np.sqrt(se2)) < 1e-9 and got["label"].startswith("diff = +47.5 p.p.")


@pytest.mark.parametrize("n", range(2, 9))
def test_rank_p_values_by_all_orders(n):
    base = np.arange(n)
    sums = sorted(((base - np.array(order)) ** 2).sum() for order in itertools.permutations(range(n)))
    for s in set(sums):
        above, below = np.mean([x >= s for x in sums]), np.mean([x <= s for x in sums])
        want = min(1.0, 2 * (above if s > (n**3 - n) / 6 else below))
        assert rank_p_value(float(s), n) == pytest.approx(want, abs=1e-12)


def test_rank_series_is_near_the_exact_distribution():
    for n in (10, 12):
        counts = rank_distances(n)
        tails = counts[::-1].cumsum()[::-1] / counts.sum()
        worst = max(abs(_distance_tail(s, n) - tails[s]) for s in range(2, len(tails), 2))
        assert worst < 2e-3


def test_spearman_p(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(a), float(b)) for g, n in (("few", 7), ("some", 40), ("many", 1400)) for a, b in rng.permutation(n * 10)[: 2 * n].reshape(n, 2)] + [("tied", float(i // 2), float(i * i % 7)) for i in range(12)]
    got = {r["g"]: r for r in spearman(spark.createDataFrame(rows, "g string, a double, b double"), ["g"], "a", "b").collect()}
    assert got["few"]["p"] == pytest.approx(rank_p_value(got["few"]["s_statistic"], 7)) and got["some"]["p"] == pytest.approx(rank_p_value(got["some"]["s_statistic"], 40))
    for g in ("many", "tied"):
        assert got[g]["p"] == pytest.approx(t_p_value(got[g]["t"], got[g]["n"] - 2))
    assert abs(got["some"]["p"] - t_p_value(got["some"]["t"], 38)) < 0.01



def test_firm_totals_are_staged_for_firm_effects_only(spark, panel, monkeypatch):
    """Rows and cells are written; without firm effects only scores go by firm."""
    staged, write = [], regression.cut_lineage
    monkeypatch.setattr(regression, "cut_lineage", lambda df: staged.append(df.columns) or write(df))
    for firm_effect, tables in ((False, 2), (True, 3)):
        staged.clear()
        got = {r["term"]: r for r in fit(spark.createDataFrame(panel), "y", ["x1", "x2"], "m", [] if firm_effect else ["sector"], firm_effect).collect()}
        want, *_ = dense(panel, ["x1", "x2"], [["firm"]] if firm_effect else [["sector"]], [["firm"]] if firm_effect else [])
        assert len(staged) == tables and [got[x]["estimate"] for x in ("x1", "x2")] == pytest.approx(list(want)[:2])
