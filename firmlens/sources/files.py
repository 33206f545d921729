"""File sources: CSV, JSON, parquet and text, read with declared schemas."""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from firmlens.functions.text import name_key
from firmlens.schemas import COMPANIES, DOCUMENT, TEXT_FILE


def header_names(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names in the first line of a CSV file (or of one file of a folder)."""
    first = spark.read.text(path).first()
    return [name.strip() for name in next(csv.reader([first[0]], delimiter=sep))] if first else []


def read_csv(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """The columns of ``schema`` by their names in the header, whatever their order and whatever else is there.

    Every path has its own header; files of one folder must agree, which Spark checks. A missing
    column stops the job. ``multi_line`` is for quoted line breaks: such files are read in one piece each.
    """
    wanted = StructType.fromDDL(schema)
    options = {"header": True, "enforceSchema": False, "multiLine": multi_line, "escape": '"', "sep": sep}
    by_header: dict[tuple[str, ...], list[str]] = {}
    for one in [path] if isinstance(path, str) else path:
        by_header.setdefault(tuple(header_names(spark, one, sep)), []).append(one)
    parts = []
    for names, paths in by_header.items():
        missing = set(wanted.names) - set(names)
        if missing:
            raise ValueError(f"no column {sorted(missing)} in the header of {paths[0]}")
        there = StructType([wanted[n] if n in wanted.names else StructField(n, StringType()) for n in names])
        parts.append(spark.read.schema(there).options(**options).csv(paths).select(*[f"`{n}`" for n in wanted.names]))
    return reduce(DataFrame.unionByName, parts)


def read_csv_any(spark: SparkSession, path: str, schema: str, column: str = "id", seps: Sequence[str] = (",", ";")) -> DataFrame:
    """CSV whose separator is the first one under which the header has ``column``."""
    for sep in seps:
        if column in header_names(spark, path, sep):
            return read_csv(spark, path, schema, sep)
    raise ValueError(f"no column {column!r} in the header of {path}")


def read_columns(df: DataFrame, keep: Callable[[str], bool] | Sequence[str]) -> DataFrame:
    """Only the wanted columns; the scan reads no others."""
    wanted = keep if callable(keep) else set(keep).__contains__
    return df.select(*[c for c in df.columns if wanted(c)])


def yearly_paths(folder: str, first: int, stop: int, combined: tuple[int, int], name: Callable[[str], str]) -> list[str]:
    """One path per year in [first, stop), years inside ``combined`` sharing one file."""
    low, high = combined
    labels = [f"{low} to {high}" if low <= y <= high else str(y) for y in range(first, stop)]
    return [f"{folder}/{name(label)}" for label in dict.fromkeys(labels)]


def union_sources(*parts: DataFrame) -> DataFrame:
    """Sources with different columns under each other; missing columns are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_results(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Parquet files under the paths, skipping unreadable ones."""
    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.schema(schema).options(ignoreCorruptFiles=True, recursiveFileLookup=True).parquet(*paths)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Assembled documents, one JSON object per line or per file, with their key from the file name."""
    return spark.read.schema(DOCUMENT).json(path)


def read_texts(spark: SparkSession, json_path: str, txt_path: str | None = None) -> DataFrame:
    """(file_name, text) of one file per company and year.

    Of several files the JSON one goes before the .txt one and an underscore before a dash; a JSON object
    gives the first text key it has, a .txt file is one text.
    """
    name = F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name")
    found = spark.read.schema(TEXT_FILE).json(json_path).select(name, F.coalesce("text", "full_text", "content").alias("text"))
    if txt_path is None:
        return found
    found = found.unionByName(spark.read.text(txt_path, wholetext=True).select(name, F.col("value").alias("text")))
    key = name_key(F.col("file_name"))
    order = F.struct(F.lower("file_name").endswith(".txt"), F.col("file_name").rlike(r"-\d{4}[^_]*$"), F.col("file_name"))
    company, year = F.coalesce(key["company_id"], F.col("file_name")).alias("company"), key["year"].alias("year")
    best = found.select("file_name", company, year).groupBy("company", "year").agg(F.min_by("file_name", order).alias("file_name"))
    return found.join(best, "file_name", "left_semi")


def read_companies(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """Company list with index memberships; ``one_array`` reads a file that is one JSON array."""
    return spark.read.schema(COMPANIES).option("multiLine", one_array).json(path)


def with_name_key(df: DataFrame, file_name: Column) -> DataFrame:
    """Company, year and report type from the file name."""
    return df.withColumns(name_key(file_name))
