"""Connected components by alternating large and small stars, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.session import cut_lineage


def _nearest(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of every node, itself included; partial minima are taken before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, root) for every node of ``links`` (u, v), with the smallest node of its component as root.

    Loops and repeated links change nothing. The joins are plain equality joins of links with one row per node, which
    adaptive execution splits when a star's centre is hot. The driver sees one count and one checksum a round.
    """
    now = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark, last = _mark(now), None
    while mark != last:
        both = _both(now)
        large = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct())
        low = _nearest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = cut_lineage(small.where("u <> v").distinct())
        last, mark = mark, _mark(now)
    roots = now.select("u", F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
