"""Transparency: what share of the indicators a firm reports, and how groups differ.

Facts have one row per (firm, year, indicator). All series start from the same
cells (reported and possible per firm, year and topic), so a topic series and
its overall line share one shuffle of the facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions.ratings import AREA_LEVELS, level_order, topic_group
from firmlens.operators.quantiles import exact_quantiles
from firmlens.operators.scale import join_on


def enrich_facts(facts: DataFrame, metadata: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Attach indicator metadata, an ``exists`` flag and the area order; blank text is null."""
    text = dict(facts.dtypes)["value_final"] == "string"
    value = F.nullif(F.col("value_final"), F.lit("")) if text else F.col("value_final")
    return (
        facts.join(metadata, "indicator", "left")
        .withColumn("value_final", value)
        .withColumn("exists", F.col("value_final").isNotNull())
        .withColumn("area_order", level_order(F.col("topic"), AREA_LEVELS))
        .withColumn("std", topic_group(F.col("standard_topic")))
        .drop(*drop)
    )


def firm_cells(facts: DataFrame, by: Sequence[str] = ("std",), flag: str = "exists") -> DataFrame:
    """Reported and possible indicators per firm, year and ``by``."""
    return facts.groupBy("firm", "year", *by).agg(
        F.sum(F.col(flag).cast("long")).alias("reported"), F.count(F.lit(1)).alias("possible")
    )


def average_reported(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over firms of the number of indicators reported."""
    return cells.groupBy(*by).agg(F.avg("reported").alias("avg_reported"))


def firm_year_transparency(cells: DataFrame) -> DataFrame:
    """Share reported per firm and year over all topics."""
    return cells.groupBy("firm", "year").agg((F.sum("reported") / F.sum("possible")).alias("transp"))


def mean_of_means(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over firm cells of the share reported (not the pooled share)."""
    return cells.groupBy(*by).agg(F.avg(F.col("reported") / F.col("possible")).alias("transp"))


def with_overall(series: DataFrame, overall: DataFrame, label: str, text: str = "Overall") -> DataFrame:
    """Append the overall line under its own label; its mean of means is not a rollup."""
    return series.unionByName(overall.withColumn(label, F.lit(text)), allowMissingColumns=True)


def transparency_by_topic(facts: DataFrame, flag: str = "exists", by: Sequence[str] = ("std",)) -> DataFrame:
    """Yearly transparency per topic with the overall line, labelled in the last column of ``by``.

    ``by`` may name finer cells, such as area, standard and topic.
    """
    cells = firm_cells(facts, by, flag)
    overall = firm_year_transparency(cells).groupBy("year").agg(F.avg("transp").alias("transp"))
    return with_overall(mean_of_means(cells, ["year", *by]), overall, by[-1])


def transparency_by_sector(facts: DataFrame, firms: DataFrame) -> DataFrame:
    """Transparency per sector and topic, the overall line, and the sector's rank by it."""
    cells = firm_cells(facts, ["std"])
    sectors = firms.select("firm", "sector").where(F.col("sector").isNotNull())
    topics = mean_of_means(cells.join(sectors, "firm"), ["sector", "std"])
    overall = (
        firm_year_transparency(cells).join(sectors, "firm").groupBy("sector").agg(F.avg("transp").alias("transp"))
    )
    # one row per sector is left
    order = overall.select("sector", F.row_number().over(Window.orderBy("transp", "sector")).alias("sector_order"))
    return with_overall(topics, overall, "std").join(order, "sector")


def group_by_thresholds(
    df: DataFrame,
    score: str,
    out: str,
    best: str = "high",
    by: Sequence[str] = ("year",),
    probs: tuple[float, float] = (0.1, 0.9),
    labels: tuple[str, str, str] = ("Top 10%", "Middle 80%", "Bottom 10%"),
    null_score: str = "null",
) -> DataFrame:
    """Top / middle / bottom of ``score`` against the quantiles of its own rows.

    The grain of ``df`` is the grain of the quantiles. ``best="high"`` puts large
    scores in the top group, ``"low"`` small ones. Rows without a score get a null
    group, or the middle one with ``null_score="middle"``.
    """
    cuts = exact_quantiles(df, list(by), score, probs, ["__low", "__high"])
    top, middle, bottom = labels
    s = F.col(score)
    if best == "high":
        group = F.when(s >= F.col("__high"), top).when(s <= F.col("__low"), bottom)
    else:
        group = F.when(s <= F.col("__low"), top).when(s >= F.col("__high"), bottom)
    group = group.when(s.isNotNull() | F.lit(null_score == "middle"), middle)
    return join_on(df, cuts, list(by), "left").withColumn(out, group).drop("__low", "__high")


def grouped_series(cells: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Average indicators per year and topic, for all firms and for each group, in one pass.

    ``groups`` holds one row per (firm, year); every cell counts once for all
    companies and once for its own group.
    """
    labelled = cells.join(groups.select("firm", "year", group), ["firm", "year"], "left").select(
        "firm", "year", "std", "reported", F.explode(F.array(F.lit("All companies"), F.col(group))).alias(group)
    )
    return average_reported(labelled.where(F.col(group).isNotNull()), [group, "year", "std"])


def top_bottom_ratio(cells: DataFrame, groups: DataFrame, group: str, top: str, bottom: str) -> DataFrame:
    """Top group's average number of indicators over the bottom group's, minus one."""
    per_firm = cells.groupBy("firm", "year").agg(F.sum("reported").alias("reported"))
    labelled = per_firm.join(groups.select("firm", "year", group), ["firm", "year"])
    wide = labelled.groupBy("year").pivot(group, [top, bottom]).agg(F.avg("reported"))
    ratio = F.try_divide(F.col(f"`{top}`"), F.col(f"`{bottom}`")) - 1
    return wide.select(
        "year", F.col(f"`{top}`").alias("avg_top"), F.col(f"`{bottom}`").alias("avg_bottom"), ratio.alias("diff_top_bottom")
    )


def first_last_change(series: DataFrame, first: int, last: int, value: str = "avg_reported") -> DataFrame:
    """Difference and percent change between two years per topic."""
    at = lambda year: F.max(F.when(F.col("year") == year, F.col(value)))
    wide = series.where(F.col("year").isin(first, last)).groupBy("std").agg(at(first).alias("first"), at(last).alias("last"))
    return wide.select(
        "std",
        "first",
        "last",
        (F.col("last") - F.col("first")).alias("diff"),
        (F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100).alias("pct_change"),
    )


def yearly_mean_score(ratings: DataFrame, score: Column) -> DataFrame:
    """Mean score per year over distinct (firm, year, rating) rows."""
    return ratings.withColumn("__s", score).groupBy("year").agg(F.avg("__s").alias("mean"))
