"""Indicator values over time: percentile bands, cohorts, deflated and relative values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions.labels import NO_FLOOR_LABEL
from firmlens.operators.quantiles import exact_quantiles
from firmlens.operators.scale import join_on, small_side, with_each
from firmlens.operators.transparency import group_by_thresholds
from firmlens.session import cut_lineage

BAND_PROBS = [0.10, 0.25, 0.50, 0.75, 0.90]
BAND_NAMES = ["p10", "q1", "median", "q3", "p90"]
N_BUCKETS = ["≤150", "≤300", ">300"]


def bands(df: DataFrame, keys: Sequence[str], value: str = "value_final") -> DataFrame:
    """Five percentiles per group of the non-null values."""
    return exact_quantiles(df, list(keys), value, BAND_PROBS, BAND_NAMES)


def floored_p10(banded: DataFrame, label: str = "label") -> DataFrame:
    """Lift p10 to 1 for a log axis, but not for the one label that may be negative."""
    keep = F.coalesce(F.col(label) == NO_FLOOR_LABEL, F.lit(False))
    return banded.withColumn("p10", F.when(keep, F.col("p10")).otherwise(F.greatest("p10", F.lit(1.0))))


def n_bucket(n: Column) -> Column:
    """Right-closed size class of a group."""
    return F.when(n <= 150, N_BUCKETS[0]).when(n <= 300, N_BUCKETS[1]).otherwise(N_BUCKETS[2])


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per group with their size class."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("n_group", n_bucket(F.col("n")))


def complete_grid(df: DataFrame, item: str, year: str = "year") -> DataFrame:
    """Every year x item x size class, with the rows of ``df`` where they exist."""
    years = df.select(year).distinct()
    buckets = F.explode(F.array(*[F.lit(b) for b in N_BUCKETS])).alias("n_group")
    grid = with_each(df.select(item).distinct(), years).select(item, year, buckets)
    return grid.join(df, [item, year, "n_group"], "left")


def median_change(banded: DataFrame, item: str, first: int, last: int) -> DataFrame:
    """Percent change of the median between two years as text, 'n.a.' without a base."""
    at = lambda year: F.max(F.when(F.col("year") == year, F.col("median")))
    wide = banded.groupBy(item).agg(at(first).alias("y_first"), at(last).alias("y_last"))
    pct = F.round(F.try_divide((F.col("y_last") - F.col("y_first")) * 100, F.col("y_first")), 1)
    sign = F.when(pct > 0, "+").otherwise("")
    label = F.concat(F.lit("Δ: "), F.when(pct.isNull(), "n.a.").otherwise(F.concat(sign, F.format_string("%.1f", pct), F.lit("%"))))
    return wide.withColumn("change", label)


def winsorised(df: DataFrame, keys: Sequence[str], value: str = "value_final", upper: float = 0.99) -> DataFrame:
    """Clip values to [minimum, upper quantile] of their own group."""
    cuts = exact_quantiles(df, list(keys), value, [0.0, upper], ["__lo", "__hi"])
    clipped = F.least(F.greatest(F.col(value), F.col("__lo")), F.col("__hi"))
    return (
        join_on(df, cuts, list(keys), "left")
        .withColumn(value, F.when(F.col(value).isNotNull(), clipped))
        .drop("__lo", "__hi")
    )


def early_adopters(df: DataFrame, first_years: Sequence[int], item: str = "label") -> DataFrame:
    """(firm, indicator) pairs reported in one of the first years."""
    reported = df.where(F.col("year").isin(list(first_years)) & F.col("value_final").isNotNull())
    return reported.select("firm", item).distinct()


def constant_reporters(df: DataFrame, years: Sequence[int], item: str = "indicator") -> DataFrame:
    """(indicator, firm) pairs with a value in every one of ``years``."""
    wanted = sorted(set(years))
    reported = df.where(F.col("year").isin(wanted) & F.col("value_final").isNotNull()).select(item, "firm", "year")
    spans = reported.distinct().groupBy(item, "firm").agg(F.count(F.lit(1)).alias("n_years"))
    return spans.where(F.col("n_years") == len(wanted)).select(item, "firm")


def cohort_bands(
    values: DataFrame,
    cohort: DataFrame,
    on: Sequence[str],
    name: str,
    keys: Sequence[str] = ("label", "year"),
    winsorise: bool = True,
    floor: bool = True,
) -> DataFrame:
    """Bands of all firms and of a cohort, with the cohort's group sizes on both.

    ``cohort`` lists the members by ``on``: (firm, indicator) or (firm, year). The
    needed columns are staged once, as several passes read them.
    """
    keys = list(keys)
    values = cut_lineage(values.where(F.col("value_final").isNotNull()).select(*dict.fromkeys([*keys, *on, "value_final"])))
    members = values.join(cohort.select(*on).distinct(), list(on), "left_semi")
    everyone = bands(values, keys).withColumn("cohort", F.lit("All companies"))
    inside = bands(winsorised(members, keys) if winsorise else members, keys).withColumn("cohort", F.lit(name))
    both = everyone.unionByName(inside)
    both = floored_p10(both) if floor else both
    return both.join(group_sizes(members, keys), keys, "left")


def bands_by_score_group(values: DataFrame, score: str, best: str = "high", keys: Sequence[str] = ("label", "year")) -> DataFrame:
    """Bands of the top and bottom decile by ``score`` (thresholds over indicator rows),
    of the rest as the null group, and the median of all companies."""
    keys = list(keys)
    values = cut_lineage(values.select(*keys, "value_final", score))
    grouped = group_by_thresholds(values, score, "grp", best=best, null_score="middle")
    grouped = grouped.withColumn("grp", F.when(F.col("grp") != "Middle 80%", F.col("grp")))
    sizes = group_sizes(grouped, [*keys, "grp"])
    summary = floored_p10(join_on(sizes, bands(grouped, [*keys, "grp"]), [*keys, "grp"], "left"))
    medians = exact_quantiles(values, keys, "value_final", [0.5], ["median"])
    names = values.select(*keys).distinct()
    overall = join_on(names, medians, keys, "left").withColumn("grp", F.lit("All companies"))
    return summary.unionByName(overall, allowMissingColumns=True)


def implied_fx(fundamentals: DataFrame, local: str, usd: str) -> DataFrame:
    """One implied rate per year: the mean of the distinct (firm, year) rates."""
    rates = fundamentals.select("firm", "year", F.try_divide(F.col(local), F.col(usd)).alias("rate")).distinct()
    return rates.groupBy("year").agg(F.avg("rate").alias("rate"))


def deflated(df: DataFrame, value: str, out: str, price_index: DataFrame, base_year: int) -> DataFrame:
    """Value in prices of ``base_year``; years without an index are dropped (inner join)."""
    base = price_index.where(F.col("year") == base_year).select(F.col("index").alias("__base"))
    factors = price_index.select("year", (base.scalar() / F.col("index")).alias("__factor"))
    return df.join(small_side(factors), "year").withColumn(out, F.col(value) * F.col("__factor")).drop("__factor")


def median_trend(df: DataFrame, value: str) -> DataFrame:
    """Median per year and its change on the year before in the result."""
    medians = exact_quantiles(df, ["year"], value, [0.5], ["median"])
    before = F.lag("median").over(Window.orderBy("year"))
    return medians.withColumn("yoy_change", F.try_divide(F.col("median"), before) - 1)


def intensity_rows(values: DataFrame, scale: str) -> DataFrame:
    """Distinct (firm, year, value, scale) rows with value per 1000 of scale."""
    extra = [c for c in ("score",) if c in values.columns]
    rows = values.select("firm", "year", "value_final", scale, *extra).distinct()
    return rows.withColumn("intensity", F.try_divide(F.col("value_final"), F.col(scale)) * 1000)


def _medians(df: DataFrame, keys: list[str]) -> DataFrame:
    sizes = df.select(*keys).distinct()
    return join_on(sizes, exact_quantiles(df, keys, "intensity", [0.5], ["median_intensity"]), keys, "left")


def intensity_medians(values: DataFrame, scale: str, first_years: Sequence[int]) -> DataFrame:
    """Median intensity per year of all companies and of the early adopters."""
    rows = intensity_rows(values, scale)
    early = values.where(F.col("year").isin(list(first_years)) & F.col("value_final").isNotNull()).select("firm").distinct()
    everyone = rows.withColumn("grp", F.lit("All companies"))
    adopters = rows.join(early, "firm", "left_semi").withColumn("grp", F.lit("Early adopters"))
    return _medians(everyone.unionByName(adopters), ["grp", "year"])


def intensity_by_rating(values: DataFrame, scale: str) -> DataFrame:
    """Median intensity per year of all companies and of the best and worst rated (low score = best)."""
    rows = group_by_thresholds(intensity_rows(values, scale), "score", "grp", best="low", null_score="middle")
    everyone = rows.withColumn("grp", F.lit("All companies"))
    return _medians(rows.where(F.col("grp") != "Middle 80%").unionByName(everyone), ["grp", "year"])


def within_category(facts: DataFrame, ids: Sequence[int], total_id: int) -> DataFrame:
    """Share of a category's indicators reported per firm-year next to the log of its total."""
    inside = facts.where(F.col("indicator").isin(list(ids)))
    share = inside.groupBy("firm", "year").agg(F.avg(F.col("exists").cast("double")).alias("transp"))
    total = facts.where(F.col("indicator") == total_id).select("firm", "year", "value_final").distinct()
    return (
        share.join(total, ["firm", "year"], "left")
        .withColumn("log_total", F.ln("value_final"))
        .where(F.col("log_total").isNotNull())
    )
