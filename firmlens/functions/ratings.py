"""Rating scales and topic levels. Every coding names its own direction."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scales in order from best to worst, and topic levels in report order.
LETTER_SCALE = ["A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D", "D-"]
TRIPLE_SCALE = ["AAA", "AA", "A", "BBB", "BB", "B", "CCC"]
TOPIC_LEVELS = [
    "Climate change",
    "Pollution",
    "Water",
    "Biodiversity",
    "Circular economy",
    "Own workforce",
    "Consumers",
    "Governance",
    "Business conduct",
]
AREA_LEVELS = ["env", "soc", "gov"]


def rating_codes(scale: list[str], best: str = "high", worst_code: int = 1) -> dict[str, int]:
    """Letter -> number. ``best="low"`` gives the best letter 1; ``"high"`` gives it the top code."""
    if best == "low":
        return {letter: i + 1 for i, letter in enumerate(scale)}
    return {letter: worst_code + len(scale) - 1 - i for i, letter in enumerate(scale)}


def coded(column: Column, codes: dict[str, int]) -> Column:
    """Ordinal of a label; a label that is not listed becomes null."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(codes.items())])
    return F.try_element_at(table, column)


def topic_group(column: Column) -> Column:
    """Topic after folding 'General' into 'Governance'; unknown topics become null."""
    folded = F.when(column == "General", "Governance").otherwise(column)
    return F.when(folded.isin(TOPIC_LEVELS), folded)


def level_order(column: Column, levels: list[str]) -> Column:
    """1-based position among ordered levels, null if unknown."""
    return coded(column, {level: i + 1 for i, level in enumerate(levels)})
