"""File sinks. Nested columns become JSON text before they go to CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.schemas import DEBUG_COLUMNS


def write_results(df: DataFrame, path: str, partition: Sequence[str] = ("year",), mode: str = "append") -> None:
    """Results as gzip parquet, a folder per year: few enough folders at any number of documents."""
    df.write.mode(mode).option("compression", "gzip").partitionBy(*partition).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    flat(df).write.options(header=True, escape='"', sep=sep).csv(path)


def write_numerical(df: DataFrame, path: str, drop: Sequence[str] = (*DEBUG_COLUMNS, "model_output")) -> None:
    """Results without debug columns and the raw answer."""
    write_csv(df.drop(*drop), path)


def write_documents(df: DataFrame, path: str) -> None:
    """Assembled documents as JSON, one object per line."""
    df.write.json(path)


def write_grouped_list(df: DataFrame, path: str, key: str, item: str, out: str) -> None:
    """Distinct members as JSON lines {key, out: member}, the members of a key sorted and together.

    One line per member at any group size; files follow each other in order of (key, member).
    """
    members = df.select(F.col(key), F.col(item).alias(out)).distinct()
    members.repartitionByRange(key, out).sortWithinPartitions(key, out).write.json(path)
