"""Text quality of documents and the list of high-quality documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.operators.quantiles import exact_quantiles
from firmlens.operators.scale import join_on, small_side
from firmlens.session import cut_lineage

# Fixed value: what counts as one word token.
WORD = r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?"
TOP_K = 5


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _push(top: Column, run: Column, k: int) -> Column:
    """Keep the ``k`` largest counts, largest first."""
    grown = F.slice(F.reverse(F.array_sort(F.array_append(top, run))), 1, k)
    return F.when(run > F.element_at(top, k), grown).otherwise(top)


def _share(tokens: Column, k: int) -> Column:
    n = F.size(tokens) - 3
    grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(tokens, i, 4), " "))
    start = F.struct(F.lit("").alias("gram"), F.lit(0).cast("long").alias("run"), F.array_repeat(F.lit(0).cast("long"), k).alias("top"))

    def step(acc, gram):
        again = gram == acc["gram"]
        return F.struct(
            gram.alias("gram"),
            F.when(again, acc["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"),
            F.when(again, acc["top"]).otherwise(_push(acc["top"], acc["run"], k)).alias("top"),
        )

    def total(acc):
        return F.aggregate(_push(acc["top"], acc["run"], k), F.lit(0).cast("long"), lambda a, x: a + x)

    # equal grams are neighbours after sorting, so one pass over the array counts them
    return F.when(F.size(tokens) < 4, F.lit(0.0)).otherwise(F.aggregate(F.array_sort(grams), start, step, total) / n)


def top_fourgram_share(text: Column, k: int = TOP_K) -> Column:
    """Share of the ``k`` most frequent 4-grams among all of a text, 0 below four tokens.

    Counted inside the row: exploding grams would shuffle several times the text.
    The one-element ``transform`` binds the tokens, so they are extracted once.
    """
    return F.get(F.transform(F.array(words(text)), lambda tokens: _share(tokens, k)), F.lit(0))


def newline_density(text: Column) -> Column:
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit("\n")), F.length(text)), F.lit(0.0))


# Letters of words, and which of them are vowels and consonants; the rest end a run of syllables.
LETTERS = "[A-Za-zÀ-ÿ]"
VOWELS, CONSONANTS = "aeiouyàâäéèêëîïôöùûüáíóúAEIOUYÀÂÄÉÈÊËÎÏÔÖÙÛÜÁÍÓÚ", "bcdfghjklmnpqrstvwxzçñßBCDFGHJKLMNPQRSTVWXZÇÑ"


def complex_words(text: Column) -> Column:
    """Number of words with three or more vowel groups.

    Letters become one of three marks, runs of a mark one mark, and then the groups are a fixed short pattern: every step is
    linear in the text, however long a run of consonants is.
    """
    other = "".join(c for c in map(chr, range(0xC0, 0x100)) if c not in VOWELS + CONSONANTS)
    marks = F.translate(text, VOWELS + CONSONANTS + other, "a" * len(VOWELS) + "b" * len(CONSONANTS) + "x" * len(other))
    groups = F.regexp_replace(F.regexp_replace(marks, "a+", "a"), "b+", "b")
    return F.regexp_count(groups, F.lit("ababa[abx]*+"))


def fog_index(text: Column) -> Column:
    """Gunning fog: 0.4 * (words per sentence + 100 * share of words with 3+ vowel groups)."""
    n_words = F.regexp_count(text, F.lit(f"{LETTERS}+"))
    n_sentences = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))
    return F.coalesce(
        0.4 * (n_words / n_sentences + 100 * F.try_divide(complex_words(text), n_words)), F.lit(0.0)
    )


def text_quality(df: DataFrame, text: str) -> DataFrame:
    """Quality record per document: fog index, newline density, repeated 4-gram share."""
    t = F.col(text)
    scores = {"fog_index": fog_index(t), "newline_density": newline_density(t), "top5_share": top_fourgram_share(t)}
    return df.withColumns(scores).drop(text)


def quality_flags(df: DataFrame, pillars: Sequence[str], by: Sequence[str] = ("year",), prob: float = 2 / 3) -> DataFrame:
    """One flag per pillar for values at or above the group's quantile, and their number.

    The records are checkpointed: they are small, and scoring the texts again for
    the thresholds would cost a second pass over all text.
    """
    by, pillars = list(by), list(pillars)
    records = cut_lineage(df)
    long = records.select(*by, *[F.col(p).cast("double").alias(p) for p in pillars]).unpivot(by, pillars, "pillar", "score")
    cuts = exact_quantiles(long, [*by, "pillar"], "score", [prob], ["cut"])
    wide = cuts.groupBy(*by).agg(*[F.max(F.when(F.col("pillar") == p, F.col("cut"))).alias(f"__{p}") for p in pillars])
    flags = {f"bad_{p}": F.coalesce((F.col(p) >= F.col(f"__{p}")).cast("int"), F.lit(0)) for p in pillars}
    out = join_on(records, small_side(wide), by, "left").withColumns(flags).drop(*[f"__{p}" for p in pillars])
    return out.withColumn("n_bad_pillars", sum((F.col(f) for f in flags), F.lit(0)))


def high_quality(df: DataFrame, pillars: Sequence[str], by: Sequence[str] = ("year",)) -> DataFrame:
    """Rows without any bad flag."""
    return quality_flags(df, pillars, by).where(F.col("n_bad_pillars") == 0)
