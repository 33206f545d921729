"""Comparison with ground truth: merging, error classes, agreement, correlation, group tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.dist import SERIES_RANKS, f_p_value, f_quantile, p_values, rank_p_values, stars, t_quantile
from firmlens.operators.harmonise import safe_number
from firmlens.operators.quantiles import exact_quantiles
from firmlens.operators.scale import GROUP_ROWS, join_on, running_before
from firmlens.session import cut_lineage


def split_company_year(df: DataFrame, key: str = "company_year") -> DataFrame:
    """Firm and year from 'firm_year'."""
    parts = F.split(key, "_")
    return df.withColumns({"firm": F.get(parts, 0), "year": F.get(parts, 1).try_cast("int")}).drop(key)


def number_without_commas(text: Column) -> Column:
    return safe_number(F.replace(text, F.lit(","), F.lit("")))


def ground_truth(facts: DataFrame, licensed: DataFrame | None, companies: DataFrame | None, manual: DataFrame, second: DataFrame) -> DataFrame:
    """Facts with the licensed value (by firm, year, field) and two manual ones (by firm, year, indicator)."""
    out = facts
    if licensed is not None:
        ids = companies.select("isin", "firm").distinct()
        known = licensed.join(ids, "isin").select("firm", "year", F.col("fieldname").alias("field"), F.col("value").alias("ref_value"))
        out = out.join(known.withColumn("ref_exists", F.col("ref_value").isNotNull()), ["firm", "year", "field"], "left")
        out = out.withColumn("ref_exists", F.when(F.col("field").isNotNull(), F.coalesce("ref_exists", F.lit(False))).otherwise(F.col("ref_exists")))
    for table, name in ((manual, "manual_value"), (second, "second_value")):
        rows = split_company_year(table).select("firm", "year", "indicator", number_without_commas(F.col("value")).alias(name))
        out = out.join(rows, ["firm", "year", "indicator"], "left")
    return out


def confusion(exists: Column, ref_exists: Column) -> Column:
    """Error class of a row; null if either side is unknown."""
    return (
        F.when(exists & ref_exists, "true_pos")
        .when(exists & ~ref_exists, "fals_pos")
        .when(~exists & ref_exists, "fals_neg")
        .when(~exists & ~ref_exists, "true_neg")
    )


def within(reference: Column, value: Column, tolerance: float) -> Column:
    """Relative distance to the extracted value within the tolerance; two zeros match."""
    return F.when((reference == 0) & (value == 0), True).otherwise(F.try_divide(F.abs(reference - value), F.abs(value)) <= tolerance)


def accuracy(rows: DataFrame) -> DataFrame:
    """Exact and near matches per row."""
    ref, value = F.col("ref_value"), F.col("value_final")
    return rows.withColumns({"ref_exact": ref == value, "ref_in1p": within(ref, value, 0.01), "ref_in10p": within(ref, value, 0.10)})


def trimmed_pairs(pairs: DataFrame, keys: Sequence[str], a: str, b: str, scale: bool) -> DataFrame:
    """Rows where both sources survive the pooled 99 % trim of their group, min-max scaled if asked."""
    keys = list(keys)
    both = cut_lineage(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b))
    pooled = both.select(*keys, F.explode(F.array(a, b)).alias("v"))
    cut = exact_quantiles(pooled, keys, "v", [0.99], ["__cut"])
    limited = join_on(pooled, cut, keys).where(F.col("v") <= F.col("__cut"))
    spread = limited.groupBy(*keys).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    kept = join_on(both, cut, keys).where((F.col(a) <= F.col("__cut")) & (F.col(b) <= F.col("__cut")))
    if scale:
        width = F.col("__hi") - F.col("__lo")
        kept = join_on(kept, spread, keys).withColumns({c: F.try_divide(F.col(c) - F.col("__lo"), width) for c in (a, b)})
        kept = kept.where(F.col(a).isNotNull()).drop("__lo", "__hi")
    return kept.drop("__cut")


def scaled_means(pairs: DataFrame, keys: Sequence[str], a: str, b: str, more_than: int = 0) -> DataFrame:
    """Mean of both scaled sources per group with more than ``more_than`` pairs."""
    kept = trimmed_pairs(pairs, keys, a, b, scale=True)
    means = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias(a), F.avg(b).alias(b))
    return means.where(F.col("n") > more_than)


def simple_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row: intercept, slope, its standard error and t, R² and adjusted R²."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    s = df.where(both).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.avg(x).alias("mean_x"),
    )
    sigma2 = F.col("syy") * (1 - F.col("r2")) / (F.col("n") - 2)
    s = s.withColumns({"sigma2": sigma2, "std_error": F.sqrt(sigma2 / F.col("sxx"))})
    return s.withColumns(
        {"t": F.col("slope") / F.col("std_error"), "adj_r2": 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 2)}
    )


def fit_band(fit: DataFrame, low: float = 0.0, high: float = 0.75, points: int = 200, level: float = 0.95) -> DataFrame:
    """Fitted line with its confidence band on an even grid."""
    n = fit.first()["n"]
    critical = t_quantile(0.5 + level / 2, n - 2)
    grid = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn(
        "x", F.lit(low) + F.col("i") * ((high - low) / (points - 1))
    )
    line = F.col("intercept") + F.col("slope") * F.col("x")
    half = critical * F.sqrt(F.col("sigma2") * (1 / F.col("n") + (F.col("x") - F.col("mean_x")) ** 2 / F.col("sxx")))
    return grid.select("x", line.alias("fit"), (half / critical).alias("std_error"), (line - half).alias("lower"), (line + half).alias("upper"))


def average_ranks(counts: DataFrame, keys: Sequence[str], value: str, out: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Average rank of each distinct value of a group, from value counts."""
    totals = counts.groupBy(*keys, value).agg(F.sum("c").alias("c"))
    placed = running_before(totals, keys, [value], "c", "before", group_rows)
    return placed.select(*keys, value, (F.col("before") + (F.col("c") + 1) / 2).alias(out))


def spearman(pairs: DataFrame, keys: Sequence[str], a: str, b: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rank correlation per group with the sum of squared rank differences, t and p.

    Without ties p comes from the exact null distribution of the sum (up to 9 pairs) or its Edgeworth series (below 1,290 pairs);
    else from t.
    Equal pairs are counted first and ranks come from the counts, so ties cost
    nothing and a group of any size is ranked without gathering it.
    """
    keys = list(keys)
    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    counts = cut_lineage(known.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("c")))
    ranked = join_on(counts, average_ranks(counts, keys, a, "ra", group_rows), [*keys, a])
    ranked = join_on(ranked, average_ranks(counts, keys, b, "rb", group_rows), [*keys, b])
    ra, rb, c = F.col("ra"), F.col("rb"), F.col("c")
    s = ranked.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(c * ra).alias("sa"), F.sum(c * rb).alias("sb"), F.sum(c * ra * ra).alias("saa"), F.sum(c * rb * rb).alias("sbb"), F.sum(c * ra * rb).alias("sab"))
    n = F.col("n").cast("double")  # its cube leaves a long at 2.1 million pairs
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va, vb = F.col("saa") - F.col("sa") ** 2 / n, F.col("sbb") - F.col("sb") ** 2 / n
    # a tie takes at least a half from the squares of the ranks
    untied = (n < SERIES_RANKS) & (F.greatest(n * (n * n - 1) / 12 - va, n * (n * n - 1) / 12 - vb) < 0.25)
    s = s.select(*keys, "n", F.try_divide(cov, F.sqrt(va * vb)).alias("cor"), untied.alias("untied"))
    s = s.withColumns(
        {
            "s_statistic": (F.pow(n, 3) - n) * (1 - F.col("cor")) / 6,
            "t": F.col("cor") * F.sqrt(F.try_divide(n - 2, 1 - F.col("cor") ** 2)),
        }
    )
    p = rank_p_values(F.when(F.col("untied"), F.col("s_statistic")), F.col("n"), p_values(F.col("t"), n - 2))
    return s.withColumn("p", p).drop("untied").withColumn(
        "label", F.concat(F.format_string("%.2f", "cor"), stars(F.col("p"), (0.01, 0.05, 0.1)))
    )


def icc_limits(kind: str, n: int, k: int, b: float, w: float, j: float, e: float, level: float = 0.95) -> tuple[float, float]:
    """Confidence limits of an intraclass correlation from the mean squares between rows, within rows, of raters and of the rest.

    One-way and mixed ones come from the limits of F; the random one from Satterthwaite's degrees of freedom for the
    denominator. Those of a mean of ``k`` ratings follow from the single one's by the Spearman-Brown formula.
    """
    prob, rows = (1 + level) / 2, n - 1
    if kind.startswith("ICC2"):
        ratio = (b - e) / (b + (k - 1) * e + k * (j - e) / n)
        own, rest = k * ratio * j / e, n * (1 + (k - 1) * ratio) - k * ratio
        df = (k - 1) * rows * (own + rest) ** 2 / (rows * own**2 + rest**2)
        up, down = f_quantile(prob, rows, df), f_quantile(prob, df, rows)
        noise = k * j + (k * n - k - n) * e
        limits = n * (b - up * e) / (up * noise + n * b), n * (down * b - e) / (noise + n * down * b)
    else:
        error, df = (w, n * (k - 1)) if kind.startswith("ICC1") else (e, rows * (k - 1))
        ends = b / error / f_quantile(prob, rows, df), b / error * f_quantile(prob, df, rows)
        limits = tuple((f - 1) / (f + k - 1) for f in ends)
    return tuple(x * k / (1 + x * (k - 1)) for x in limits) if kind.endswith("k") else limits


def icc(ratings: DataFrame, raters: Sequence[str], level: float = 0.95) -> DataFrame:
    """Intraclass correlations of complete rows: one-way, two-way random, two-way mixed; single and mean.

    Each has its F test against zero (``f``, ``df1``, ``df2``, ``p``) and confidence limits (``lower``, ``upper``). What would
    divide by zero is null: everything below two rows, tests and limits of ratings that agree without a rest.
    """
    k = len(raters)
    rows = cut_lineage(ratings.dropna(subset=list(raters)).select(*[F.col(r).cast("double").alias(r) for r in raters]))
    # sums of squares around the mean of all ratings keep their digits when the mean is large
    centre = rows.agg((sum((F.avg(r) for r in raters), F.lit(0.0)) / k).alias("m")).first()["m"] or 0.0
    rows = rows.select(*[(F.col(r) - F.lit(centre)).alias(r) for r in raters])
    total = sum((F.col(r) for r in raters), F.lit(0.0))
    squares = sum((F.col(r) * F.col(r) for r in raters), F.lit(0.0))
    s = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(squares).alias("sq"),
        F.sum(total * total).alias("row_sq"),
        F.sum(total).alias("all"),
        *[F.sum(r).alias(f"col_{i}") for i, r in enumerate(raters)],
    )
    n, over = F.col("n"), F.try_divide
    mean_part = over(F.col("all") ** 2, n * k)
    ss_rows = F.col("row_sq") / k - mean_part
    ss_cols = over(sum((F.col(f"col_{i}") ** 2 for i in range(k)), F.lit(0.0)), n) - mean_part
    ss_all = F.col("sq") - mean_part
    s = s.select(
        "n",
        over(ss_rows, n - 1).alias("msb"),
        over(ss_all - ss_rows, n * (k - 1)).alias("msw"),
        over(ss_cols, F.lit(k - 1)).alias("msj"),
        over(ss_all - ss_rows - ss_cols, (n - 1) * (k - 1)).alias("mse"),
    )
    b, w, j, e = (F.col(c) for c in ("msb", "msw", "msj", "mse"))
    mixed = over(b, e), n - 1, (n - 1) * (k - 1)
    one_way = over(b, w), n - 1, n * (k - 1)
    values = {
        "ICC1": (over(b - w, b + (k - 1) * w), *one_way),
        "ICC2": (over(b - e, b + (k - 1) * e + k * over(j - e, n)), *mixed),
        "ICC3": (over(b - e, b + (k - 1) * e), *mixed),
        "ICC1k": (over(b - w, b), *one_way),
        "ICC2k": (over(b - e, b + over(j - e, n)), *mixed),
        "ICC3k": (over(b - e, b), *mixed),
    }

    @F.pandas_udf("p double, lower double, upper double")
    def tested(kind: pd.Series, n: pd.Series, f: pd.Series, df1: pd.Series, df2: pd.Series, squares: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, size, ratio, a, c, mean_squares in zip(kind, n, f, df1, df2, squares.itertuples(index=False)):
            known = ratio is not None and np.isfinite(ratio) and min(a, c) > 0
            out.append((f_p_value(ratio, a, c), *icc_limits(name, size, k, *mean_squares, level)) if known else (None, None, None))
        return pd.DataFrame(out, columns=["p", "lower", "upper"], dtype=float)

    found = [F.struct(F.lit(t).alias("type"), v.alias("icc"), f.alias("f"), d1.alias("df1"), d2.alias("df2")) for t, (v, f, d1, d2) in values.items()]
    s = s.select("n", F.struct("msb", "msw", "msj", "mse").alias("squares"), F.inline(F.array(*found)))
    return s.withColumn("t", tested("type", "n", "f", "df1", "df2", "squares")).select("n", "type", "icc", "f", "df1", "df2", "t.p", "t.lower", "t.upper")


def welch(df: DataFrame, value: str, group: str, targets: Sequence[str], reference: str) -> DataFrame:
    """Difference of each target's mean to the reference group's, in percentage points, with Welch's t."""
    names = [*targets, reference]
    stats = (
        df.where(F.col(group).isin(names) & F.col(value).isNotNull())
        .groupBy(group)
        .agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(F.lit(1)).alias("n"))
    )
    base = stats.where(F.col(group) == reference).agg(F.first(F.struct("m", "v", "n")).alias("base")).scalar()
    rows = stats.where(F.col(group) != reference).withColumn("base", base)
    rows = rows.select(group, "m", "v", "n", F.col("base.m").alias("m0"), F.col("base.v").alias("v0"), F.col("base.n").alias("n0"))
    e1, e0 = F.col("v") / F.col("n"), F.col("v0") / F.col("n0")
    rows = rows.withColumns(
        {
            "diff_pp": (F.col("m") - F.col("m0")) * 100,
            "t": (F.col("m") - F.col("m0")) / F.sqrt(e1 + e0),
            "df": (e1 + e0) ** 2 / (e1**2 / (F.col("n") - 1) + e0**2 / (F.col("n0") - 1)),
        }
    )
    p = p_values(F.col("t"), F.col("df"))
    rows = rows.select(group, F.col("n"), "diff_pp", "t", "df").withColumn("p", p)
    return rows.withColumn("label", F.concat(F.format_string("diff = %+.1f p.p.", "diff_pp"), stars(F.col("p"))))
