"""Firm-year panel preparation: scaffold, restatements, lags, ratings, enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def index_members(companies: DataFrame, index_id: Column | str, indices: str = "indices") -> DataFrame:
    """Companies whose list of indices holds ``index_id``."""
    return companies.where(F.array_contains(indices, index_id))


def firm_year_scaffold(firms: DataFrame, first: int, last: int) -> DataFrame:
    """Every firm in every year from ``first`` to ``last``, without a join."""
    return firms.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))


def latest_restatement(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """Per key, each column from the row with the largest ``order`` that has it.

    An aggregate of partial states rather than a window, so a key with very many
    restatements is reduced before the shuffle.
    """
    ranked = df.withColumn("__order", order)
    latest = [
        F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("__order"), F.col(c).alias("v"))))["v"].alias(c) for c in columns
    ]
    return ranked.groupBy(*keys).agg(*latest)


def mapped(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keep and rename the listed columns."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def with_lag(df: DataFrame, history: DataFrame, columns: Sequence[str], key: str = "firm", suffix: str = "_lagged") -> DataFrame:
    """Last year's value by key shift: correct across gaps, unlike a positional lag."""
    shifted = history.select(key, (F.col("year") + 1).alias("year"), *[F.col(c).alias(c + suffix) for c in columns])
    return df.join(shifted, [key, "year"], "left")


def pivot_fields(df: DataFrame, keys: Sequence[str], field: str, value: str, fields: Sequence[str]) -> DataFrame:
    """Field/value rows to columns; a duplicated (key, field) stops the job.

    The cells of a key travel as a list of those it has, and become columns only in the result: sums over
    rows as wide as all fields would hold a row per key in every task, before and after the shuffle.
    """
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate key and field"))).otherwise(F.first(value))
    cells = df.where(F.col(field).isin(list(fields))).groupBy(*keys, field).agg(cell.cast(df.schema[value].dataType).alias("__value"))
    place = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col(field)).cast("int").alias("__place")
    listed = cells.select(*keys, place, "__value").groupBy(*keys).agg(F.collect_list(F.struct("__place", "__value")).alias("__cells"))
    found = listed.select(*keys, F.map_from_entries("__cells").alias("__found"))
    return found.select(*keys, *[F.try_element_at("__found", F.lit(i)).alias(f) for i, f in enumerate(fields, 1)])


def last_in_period(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key, the last non-null value of each column by ``order``."""
    return latest_restatement(df, keys, F.struct(*order), columns)


def enriched(df: DataFrame, dimension: DataFrame | None, on: Sequence[str] = ("firm", "year")) -> DataFrame:
    """Left join that drops the dimension's columns the data already has.

    ``dimension=None`` stands for an absent licensed table: the data stays as is.
    """
    if dimension is None:
        return df
    overlap = [c for c in dimension.columns if c in df.columns and c not in on]
    return df.join(dimension.drop(*overlap), list(on), "left")


def optional_table(spark: SparkSession, path: str | None, reader=None) -> DataFrame | None:
    """A table if its path exists, else None."""
    if path is None:
        return None
    try:
        return (reader or spark.read.parquet)(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
