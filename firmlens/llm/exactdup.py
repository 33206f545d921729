"""Exact duplicates by a tree merge of sorted digest runs.

The texts of each input partition go into one sorted run of (digest, best identifier, count). Runs then meet in rounds: in
round t, runs whose numbers differ in digit t only exchange rows by digit t of the digest, and a sort aggregate merges what
arrives. A text costs one row per run at every level however often it is repeated, so a hot text never gathers, and
after the last round every run owns one digest range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import LOWER, UPPER, fresh, lookup, shuffle_partitions
from firmlens.session import cut_lineage

FAN_IN = 4


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _digit(number: Column, t: int, fan_in: int) -> Column:
    return F.pmod(F.floor(number / F.lit(fan_in**t)), F.lit(fan_in)).cast("int")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when their normalised forms are; the row with the largest id stays. Equality is verified at every merge:
    rows meet only when the SHA-256 digest, an independent 64-bit hash and the byte length agree.

    Null text equals the empty text. Null ids sort below all others. Repeated ids: of rows that tie, the one read last
    stays, so each group keeps exactly one row. Texts of any length are hashed where they are read; only digests move. An empty table
    gives an empty result. Other columns are not read.
    """
    runs, rounds = fan_in, 1
    while runs < shuffle_partitions(docs):
        runs, rounds = runs * fan_in, rounds + 1
    key = ["digest", "check", "n_bytes"]
    text = normalised(F.col(text_col))
    rows = cut_lineage(
        docs.select(F.col(id_col).alias("id"), text.alias("norm")).select(
            "id",
            F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
            F.xxhash64("norm").alias("check"),
            F.octet_length("norm").alias("n_bytes"),
            F.monotonically_increasing_id().alias("row"),
            F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
        )
    )
    best, size = F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("size")
    # whole input partitions are dealt to runs; a run is then sorted and aggregated where it lies
    level = rows.repartitionById(runs, "run").groupBy("run", *key).agg(best, size)
    prefix = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    for t in range(rounds):
        own = _digit(F.col("run"), t, fan_in)
        moved = level.withColumn("run", (F.col("run") + (_digit(prefix, t, fan_in) - own) * F.lit(fan_in**t)).cast("int"))
        level = moved.repartitionById(runs, "run").groupBy("run", *key).agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    joined = lookup(rows, "run", key, level.drop("run"))
    return joined.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops, all columns kept.

    Rows that repeat both id and text are one document and leave one row; null ids with the same text likewise. An empty
    table stays empty.
    """
    (key,) = fresh(docs, "dup_key")
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    stay = exact_duplicates(docs, id_col, text_col).where("kept").select(F.concat_ws(":", "text_sha256", name).alias(key))
    keyed = docs.withColumn(key, F.concat_ws(":", F.sha2(normalised(F.col(text_col)).cast("binary"), 256), name))
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).drop(key)
