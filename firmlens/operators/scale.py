"""Building blocks that keep every other operator safe on large, skewed data.

* ``small_side``     broadcast a table only after its size was counted
* ``settle``         keep a small result as a local table, a large one as a staged table
* ``with_each``      pair rows with the values of a small dimension, without a join; a large one by packs
* ``running_before`` ordered running sum inside groups of any size
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmlens.session import cut_lineage

BROADCAST_ROWS = 100_000  # rows of a few scalar columns: some MB at most
GROUP_ROWS = 1_000_000  # rows one task may sort for one group
EACH_VALUES = 50_000  # dimension rows in one array literal


def collect_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """``df`` as a local table to broadcast, or None if it has more than ``max_rows`` rows.

    The driver never sees more than ``max_rows + 1`` rows.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table to broadcast if its counted size allows; otherwise as is, and AQE picks the join."""
    local = collect_bounded(df, max_rows)
    return df if local is None else local


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A code table as a broadcast relation the planner knows the size of."""
    fields = [part.strip().rsplit(" ", 1) for part in schema.split(",")]
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    columns = {name: pa.array([r[i] for r in rows], types[kind]) for i, (name, kind) in enumerate(fields)}
    return F.broadcast(spark.createDataFrame(pa.table(columns), schema))


def settle(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Evaluate once: as a local (broadcastable) table if small, else as a staged table."""
    local = collect_bounded(df, max_rows)
    return cut_lineage(df) if local is None else local


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join that keeps null-key groups; the key columns come from ``left``."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def spread_lookup(rows: DataFrame, keys: Sequence[str], table: DataFrame, salt: Column, ways: int = 64) -> DataFrame:
    """Left join of ``rows`` to ``table`` (one row per ``keys``) in which no key is hot.

    Rows are dealt ``ways`` ways by ``salt``; each way asks once for each of its keys, the answers
    are joined within the way. Rows with a null key find nothing.
    """
    dealt = rows.withColumn("__way", F.pmod(salt, F.lit(ways)))
    asked = dealt.select("__way", *keys).dropna(subset=list(keys)).distinct()
    return dealt.join(asked.join(table, list(keys)), ["__way", *keys], "left").drop("__way")


def fits_broadcast(table: DataFrame) -> bool:
    """Whether the planner's own estimate of the table lets it be broadcast."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= table._jdf.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()


def hash_side(table: DataFrame) -> DataFrame:
    """A narrow table with few rows a key as the build side of a join: broadcast if it fits, else hashed by
    partitions, so that the wide side is neither sorted nor spilled."""
    return table if fits_broadcast(table) else table.hint("shuffle_hash")


def attach(rows: DataFrame, keys: Sequence[str], table: DataFrame, salt: Column) -> DataFrame:
    """Left join of ``rows`` to a staged ``table`` (one row per ``keys``) that stays safe on hot keys.

    The planner broadcasts a staged table whose bytes are below its own limit, and the rows stay where
    they are; a larger one is looked up by ``spread_lookup``. The rows are the same.
    """
    return rows.join(table, list(keys), "left") if fits_broadcast(table) else spread_lookup(rows, keys, table, salt)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a plain scan to all cores if it has fewer splits than cores.

    For row-wise work that costs far more than moving the row (text scoring,
    parsing). A large input has splits enough and stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def with_each(df: DataFrame, values: DataFrame, block: int = EACH_VALUES, ways: int = 64) -> DataFrame:
    """Pair every row of ``df`` with every row of the dimension ``values``.

    Up to ``block`` rows the dimension travels as one array literal from a scalar subquery and is unfolded inside the task, so
    neither side is shuffled. A larger one is staged in packs of about ``block`` rows; rows, dealt ``ways`` ways so that no
    pack gathers all of them, meet the packs by an equality of the pack's number. The rows are the same.
    """
    local = collect_bounded(values, block)
    every = F.collect_list(F.struct(*values.columns))
    if local is not None:
        return df.select("*", local.agg(every).scalar().alias("__each")).select(*df.columns, F.inline("__each"))
    staged = cut_lineage(values)
    packs = max(1, -(-staged.count() // block))
    own = F.pmod(F.xxhash64(*values.columns), F.lit(packs)).cast("int")
    packed = cut_lineage(staged.groupBy(own.alias("__pack")).agg(every.alias("__each")))
    packed = packed.withColumn("__way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("__pack")).withColumn("__way", F.floor(F.rand(1) * ways).cast("int"))
    return rows.join(packed, ["__pack", "__way"]).select(*df.columns, F.inline("__each"))


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    weight: str,
    out: str = "before",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Sum of ``weight`` over the earlier rows of the same group, as column ``out``.

    ``(keys, order)`` must identify a row. Groups up to ``group_rows`` are one
    window each. If a larger group exists, rows are range-partitioned on
    (keys, order), each slice gets its own window, and slice totals (one row per
    group and partition) supply the offsets: no task sees a whole large group.
    """
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= group_rows:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(weight).over(window), F.lit(0)))
    sliced = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn("__slice", F.spark_partition_id())
    )
    totals = sliced.groupBy(*keys, "__slice").agg(F.sum(weight).alias("__total"))
    across = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__slice", F.coalesce(F.sum("__total").over(across), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        join_on(sliced, small_side(offsets), [*keys, "__slice"])
        .withColumn(out, F.coalesce(F.sum(weight).over(within), F.lit(0)) + F.col("__offset"))
        .drop("__slice", "__offset")
    )
