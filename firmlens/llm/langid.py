"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds three of them, each rotated by its place (element-wise
product); a text is the bundle (sum) of its trigrams' vectors, a language the bundle of its texts. A text's language is the prototype
with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import fresh

UNKNOWN = "und"
DIMENSIONS = 1024
#: the standard deviation of the cosine of two random vectors
CHANCE = DIMENSIONS**-0.5
#: documents a language is learned from, about; taken by a hash of their id
SAMPLE_PER_LANGUAGE = 1000
#: letters up to here have a vector of their own, later ones share FOLDED
OWN_LETTERS, FOLDED = 0x250, 431
COLUMN_BLOCK, TEXT_BLOCK = 4096, 128
SEED = 7
#: fineness of summed vectors
FINE = 1 << 40


@lru_cache(maxsize=1)
def letter_slots() -> np.ndarray:
    """Slot of every code point: 0 for what is no letter, else 1 and up, the same for both cases."""
    slots = np.zeros(0x110000, np.uint16)
    for point in range(0x110000):
        if 0xD800 <= point < 0xE000 or not chr(point).isalpha():
            continue
        low = ord(chr(point).lower()[0])
        slots[point] = 1 + (low if low < OWN_LETTERS else OWN_LETTERS + low % FOLDED)
    return slots


N_SLOTS = 1 + OWN_LETTERS + FOLDED


@lru_cache(maxsize=4)
def letter_vectors(dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random vectors of all slots, for the first, second and third place of a trigram (rotated by 2, 1, 0)."""
    plain = (np.random.default_rng(SEED).integers(0, 2, (N_SLOTS, dimensions), np.int8) * 2 - 1).astype(np.int8)
    return np.roll(plain, 2, axis=1), np.roll(plain, 1, axis=1), plain


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text and their counts: letters in lower case, everything else a single border."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    slots = letter_slots()[points]
    inside = slots > 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    padded = np.concatenate([[0], slots[keep], [0]]).astype(np.int32)
    codes = (padded[:-2] * N_SLOTS + padded[1:-1]) * N_SLOTS + padded[2:]
    return np.unique(codes[padded[1:-1] > 0], return_counts=True)


def bundles(texts: list[str | None], dimensions: int) -> np.ndarray:
    """The bundled vector of each text (float32); zero if it has no letter. Trigram vectors are built once per block of texts."""
    first, second, third = letter_vectors(dimensions)
    out = np.zeros((len(texts), dimensions), np.float32)
    for at in range(0, len(texts), TEXT_BLOCK):
        found = [trigrams(t) for t in texts[at : at + TEXT_BLOCK]]
        every = np.unique(np.concatenate([codes for codes, _ in found]))
        for lo in range(0, len(every), COLUMN_BLOCK):
            block = every[lo : lo + COLUMN_BLOCK]
            counts = np.zeros((len(found), len(block)), np.float32)
            for row, (codes, n) in enumerate(found):
                a, b = np.searchsorted(codes, block[0]), np.searchsorted(codes, block[-1], side="right")
                counts[row, np.searchsorted(block, codes[a:b])] = n[a:b]
            vectors = first[block // (N_SLOTS * N_SLOTS)] * second[block // N_SLOTS % N_SLOTS] * third[block % N_SLOTS]
            out[at : at + len(found)] += counts @ vectors.astype(np.float32)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def sampled(labelled: DataFrame, key: Column, lang: Column, per_language: int) -> DataFrame:
    """(lang, text): about ``per_language`` rows of each language, all of them if there are no more.

    A row is taken if the hash of its key lies in the first per_language / n of the hash range, n being the
    language's rows. Only the counts reach the driver; nothing is sorted or gathered.
    """
    rows = labelled.select(lang.alias("lang"), key.alias("key"), "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return rows.select("lang", "text").where("false")
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r.lang, min(1.0, per_language / r.n))))
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return rows.where(place < share[F.col("lang")]).select("lang", "text")


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, dimensions: int = DIMENSIONS, key: str = "key") -> tuple[list[str], np.ndarray]:
    """Language names (sorted) and their unit prototypes, from rows (key, lang, text) with a language.

    The sample is bounded by ``per_language``; each text counts with the same weight. Tasks sum their texts' vectors, Spark sums those place by
    place, and the driver gets one vector per language.
    """
    rows = sampled(labelled, F.col(key), F.col("lang"), per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors = unit(bundles(batch.column(1).to_pylist(), dimensions)).astype(np.float64)
            for name, vector in zip(batch.column(0).to_pylist(), vectors):
                sums[name] = sums.get(name, 0) + vector
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], ["lang", "vector"])

    total: dict[str, np.ndarray] = {}
    # sums of whole numbers, so that their order does not matter
    places = rows.mapInArrow(run, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("i", "x"))
    sums = places.groupBy("lang", "i").agg(F.sum(F.round(F.col("x") * FINE).cast("long")).alias("x"))
    for r in sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
        total[r.lang] = np.array([v.x for v in r.v], np.float64) / FINE
    names = sorted(total)
    return names, unit(np.array([total[n] for n in names])) if names else np.zeros((0, dimensions))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> Column:
    """struct<lang_pred, score> of a text: nearest prototype and its cosine, cut at 0. ``und`` and 0 without a letter or model."""
    names, prototypes = model
    dimensions = prototypes.shape[1]
    weights = prototypes.astype(np.float32).T

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            vectors = unit(bundles(list(texts), dimensions))
            if not names:
                yield pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0})
                continue
            cosines = vectors @ weights
            best = cosines.argmax(axis=1)
            some = np.abs(vectors).max(axis=1, initial=0) > 0
            score = np.where(some, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0).astype(float)
            yield pd.DataFrame({"lang_pred": np.where(some, np.array(names, object)[best], UNKNOWN), "score": score})

    return of(F.col(text_col))


def held_out(id_col: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text leaves 2 modulo 4. Null ids are not."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per input row: (id, held_out, lang_pred, score).

    Learns from text and language of rows that are not held out and have a language; predicts from the text alone. Null
    text or text without a letter is ``und`` with score 0, and so is everything if there is nothing to learn from. Equal
    cosines go to the alphabetically first language. Repeated rows are predicted alike; texts are read whole, very long ones by their
    distinct trigrams. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("held_out", held_out(F.col("key")))
    model = train(rows.where(~F.col("held_out") & F.col("lang").isNotNull()), per_language, dimensions)
    found = rows.select("key", "held_out", predict(rows, model).alias("found"))
    return found.select(F.col("key").alias(id_col), "held_out", "found.lang_pred", "found.score")


def keep_recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: Sequence[str] | None = None, least: float = CHANCE) -> DataFrame:
    """``docs`` whose predicted language is one of ``languages`` (all learned ones if None) with a score above ``least``.

    The default is the cosine that two unrelated vectors have by chance: texts that resemble no learned language more than
    that go, as do null texts and texts without a letter. Rows that repeat fare alike, texts are read whole. If nothing can be learned, documents with a letter stay.
    An empty table stays empty.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(rows.where(~held_out(F.col("key")) & F.col("lang").isNotNull()))
    if not model[0]:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    (work,) = fresh(docs, "predicted")
    found = docs.withColumn(work, predict(docs, model, text_col))
    wanted = F.col(work)["lang_pred"].isin(*(model[0] if languages is None else languages))
    return found.where(wanted & (F.col(work)["score"] > least)).drop(work)
