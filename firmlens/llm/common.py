"""Helpers that the text operators share: tables, small Arrow batches, row numbers, joins without hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmlens.session import cut_lineage

BATCH_ROWS = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Python workers get a few hundred texts at a time, so that very long texts fit beside each other."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Work column names that clash with none of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lookup(rows: DataFrame, part: str, keys: Sequence[str], found: DataFrame) -> DataFrame:
    """``rows`` joined to ``found`` (one row per ``keys``), where one key may hold a third of all rows.

    Every part of the input (``part``) asks once for each of its keys; the answers are then joined within the part. No task
    gets more rows of a key than one part holds, and nothing is broadcast.
    """
    asked = rows.select(part, *keys).distinct()
    return rows.join(asked.join(found, list(keys)), [part, *keys], "left")


def numbered(rows: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """``rows`` with their place (1 first) in the given order, which must tell rows apart.

    Rows are dealt by ranges of the order and numbered within each range; the driver gets one count per range.
    """
    piece, nth = fresh(rows, "piece", "nth")
    dealt = rows.repartitionByRange(shuffle_partitions(rows), *order).withColumn(piece, F.spark_partition_id())
    dealt = cut_lineage(dealt)
    before, total = [], 0
    for row in dealt.groupBy(piece).count().orderBy(piece).collect():
        before.append((row[0], total))
        total += row[1]
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, f"{piece} int, {out} long"))
    inside = F.row_number().over(Window.partitionBy(piece).orderBy(*order))
    return dealt.withColumn(nth, inside).join(starts, piece).withColumn(out, F.col(out) + F.col(nth)).drop(piece, nth)
