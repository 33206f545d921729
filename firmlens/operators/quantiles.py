"""Exact quantiles (linear interpolation between ranks) for groups of any size.

Groups of up to ``GROUP_ROWS`` values use the built-in exact ``percentile``.
A larger group is never gathered: an approximate sketch proposes a narrow value
bracket per probability, one pass counts what lies below each bracket and keeps
only the (value, count) pairs inside, and the wanted ranks are read from an
ordered running sum over those pairs. The sketch only decides how much is kept;
the ranks are counted, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.operators.scale import GROUP_ROWS, join_on, running_before, settle, small_side
from firmlens.session import cut_lineage

BRACKET = 0.005  # half width of a bracket in rank share
SKETCH_ACCURACY = 10_000  # rank error of the sketch is 1 / accuracy


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per group with the requested quantiles, nulls and NaN ignored.

    The narrow rows are staged once; unless a group may be too large, the result is lazy.
    """
    keys = list(keys)
    rows = cut_lineage(df.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v")))
    if rows.count() <= group_rows:  # then no group is larger
        return _gathered(rows, keys, probs, names)
    sizes = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
    hot = sizes.where(F.col("__n") > group_rows)
    if hot.isEmpty():
        return _gathered(rows, keys, probs, names)
    cold = join_on(rows, hot.select(*keys), keys, "left_anti")
    return _gathered(cold, keys, probs, names).unionByName(_counted(rows, keys, hot, probs, names, group_rows))


def _gathered(rows: DataFrame, keys: list[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    exact = rows.groupBy(*keys).agg(F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs])).alias("__q"))
    return exact.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])


def _counted(
    rows: DataFrame, keys: list[str], hot: DataFrame, probs: Sequence[float], names: Sequence[str], group_rows: int
) -> DataFrame:
    hot_rows = join_on(rows, hot, keys)
    edges = [x for p in probs for x in (max(0.0, p - BRACKET), min(1.0, p + BRACKET))]
    sketch = hot_rows.groupBy(*keys).agg(
        F.first("__n").alias("__n"), F.percentile_approx("__v", edges, SKETCH_ACCURACY).alias("__e")
    )
    brackets = sketch.select(
        *keys,
        "__n",
        *[F.col("__e")[2 * i].alias(f"__a{i}") for i in range(len(probs))],
        *[F.col("__e")[2 * i + 1].alias(f"__b{i}") for i in range(len(probs))],
    )
    found = settle(_read_ranks(rows, keys, small_side(brackets), probs, group_rows))
    if not found.where(F.col("__lo").isNull() | F.col("__hi").isNull()).isEmpty():
        whole = brackets.select(
            *keys,
            "__n",
            *[F.lit(float("-inf")).alias(f"__a{i}") for i in range(len(probs))],
            *[F.lit(float("inf")).alias(f"__b{i}") for i in range(len(probs))],
        )
        found = settle(_read_ranks(rows, keys, small_side(whole), probs, group_rows))
    # the arithmetic of the built-in function, so that both ways agree to the last bit
    rank, low, high = F.col("__rank"), F.floor("__rank"), F.ceil("__rank")
    between = (high - rank) * F.col("__lo") + (rank - low) * F.col("__hi")
    value = F.when((low == high) | (F.col("__lo") == F.col("__hi")), F.col("__lo")).otherwise(between)
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__i") == i, value)).alias(n) for i, n in enumerate(names)]
    )


def _read_ranks(
    rows: DataFrame, keys: list[str], brackets: DataFrame, probs: Sequence[float], group_rows: int
) -> DataFrame:
    """(keys, i, rank, lo, hi): the values at the two ranks around each quantile."""
    v = F.col("__v")
    inside = F.lit(False)
    for i in range(len(probs)):
        inside = inside | v.between(F.col(f"__a{i}"), F.col(f"__b{i}"))
    bounds = [f"__{side}{i}" for i in range(len(probs)) for side in "ab"]
    counted = cut_lineage(
        join_on(rows, brackets, keys)
        .withColumn("__kept", F.when(inside, v))
        .groupBy(*keys, "__kept", "__n", *bounds)
        .agg(
            F.count(F.lit(1)).alias("__c"),
            *[F.sum((v < F.col(f"__a{i}")).cast("long")).alias(f"__below{i}") for i in range(len(probs))],
        )
    )
    below = settle(
        counted.groupBy(*keys).agg(*[F.sum(f"__below{i}").alias(f"__below{i}") for i in range(len(probs))])
    )
    per_prob = F.array(
        *[
            F.struct(
                F.lit(i).alias("__i"),
                (F.lit(float(p)) * (F.col("__n") - 1)).alias("__rank"),
                F.col(f"__a{i}").alias("__a"),
                F.col(f"__b{i}").alias("__b"),
                F.col(f"__below{i}").alias("__below"),
            )
            for i, p in enumerate(probs)
        ]
    )
    kept = (
        join_on(counted.where(F.col("__kept").isNotNull()).drop(*[f"__below{i}" for i in range(len(probs))]), below, keys)
        .select(*keys, "__kept", "__c", F.inline(per_prob))
        .where(F.col("__kept").between(F.col("__a"), F.col("__b")))
    )
    placed = running_before(kept, [*keys, "__i"], ["__kept"], "__c", "__before", group_rows)
    first = F.col("__below") + F.col("__before")

    def holds(rank):
        return (first <= rank) & (rank < first + F.col("__c"))

    out = placed.groupBy(*keys, "__i", "__rank").agg(
        F.max(F.when(holds(F.floor("__rank")), F.col("__kept"))).alias("__lo"),
        F.max(F.when(holds(F.ceil("__rank")), F.col("__kept"))).alias("__hi"),
    )
    return settle(out)
