"""Target-distribution importance resampling over hashed n-grams.

Separators collapse to single spaces; an overlapped regular expression with boundary lookarounds then yields every n-gram of a text
as one span, whose bytes are counted under their CRC-32. Counts of the source and of the target give every bucket a gain; a
document's weight is the sum of its gains, and Gumbel noise from its id turns the highest scores into a sample without replacement.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import numbered
from firmlens.session import cut_lineage

#: A-Z to a-z, other ASCII bytes that are neither letters nor digits to spaces
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
_SCALE = 1 << 32


@dataclass(frozen=True)
class Features:
    """N-grams of ``shortest`` to ``longest`` words, hashed into ``buckets``."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000


def _pattern(n: int) -> regex.Pattern:
    """``n`` words between spaces or the text's ends; nothing in it is tried twice."""
    return regex.compile(rb"(?<![^ ])" + b" ".join([rb"[^ ]++"] * n) + rb"(?![^ ])")


class Scanner:
    """Buckets of the features of a text."""

    def __init__(self, features: Features):
        self._patterns = [_pattern(n) for n in range(features.shortest, features.longest + 1)]
        self._buckets = features.buckets

    def collapsed(self, text: str | None) -> bytes:
        """Words of the text, one space between them."""
        return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())

    def spans(self, data: bytes) -> Iterator[regex.Match]:
        return chain.from_iterable(p.finditer(data, overlapped=True) for p in self._patterns)

    def buckets(self, data: bytes) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, map(itemgetter(0), self.spans(data))), np.uint32) % np.uint32(self._buckets)

    def words(self, data: bytes) -> int:
        return data.count(b" ") + 1 if data else 0


def _type(features: Features) -> np.dtype:
    return np.dtype("<u2" if features.buckets <= 1 << 16 else "<u4")


def scanned(texts: DataFrame, features: Features, text_col: str = "text") -> DataFrame:
    """``texts`` with (n_words, n_features, found): the buckets of all features of each text as raw numbers, written once."""

    @F.pandas_udf("n_words long, n_features long, found binary")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner, kind = Scanner(features), _type(features)
        for batch in batches:
            rows = []
            for text in batch:
                data = scanner.collapsed(text)
                found = scanner.buckets(data)
                rows.append((scanner.words(data), len(found), found.astype(kind).tobytes()))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "found"])

    kept = [c for c in texts.columns if c != text_col]
    return cut_lineage(texts.select(*kept, scan(F.col(text_col)).alias("s")).select(*kept, "s.*"))


def bucket_counts(rows: DataFrame, features: Features) -> np.ndarray:
    """Occurrences of every bucket over all ``scanned`` rows. The driver gets one number per bucket, each task sends as many at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(features.buckets, np.int64)
        for batch in batches:
            for found in batch["found"]:
                total += np.bincount(np.frombuffer(found, _type(features)), minlength=features.buckets)
        (used,) = total.nonzero()
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    found = rows.select("found").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(features.buckets, np.int64)
    for row in found.collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the source's) of each bucket, in doubles."""
    n = len(source)
    every, wanted = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1) * every / ((s + 1) * wanted))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def noise(seed: int, name: str) -> int:
    """floor(1000 x a Gumbel variable) from the first 32 bits of the hash of ``<seed>:<name>``."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / _SCALE)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, features: Features = Features(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text"
) -> DataFrame:
    """One row per input row: (id, n_features, weight, score, rank), the last four long.

    Of the N rows with at least ``min_words`` words the floor(percent x N / 100) with the highest scores are drawn: rank 1, 2, ...
    by score descending, then by ascending id (null ids first), then by the order of reading; all other rows have a null rank.
    Null and empty texts have no features and weight 0. A null id has the noise of the empty name. Repeated rows are
    rows of their own, with the same noise if they share an id. An empty ``target`` counts as all buckets alike; empty ``docs`` give an
    empty result. Texts are scanned whole and once; the buckets found are staged and read for the counts and
    for the weights. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    rows, wanted = scanned(source, features), scanned(target.select(F.col(target_text_col).alias("text")), features)
    gain = gains(bucket_counts(rows, features), bucket_counts(wanted, features))

    @F.pandas_udf("weight long, noise long")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, every in batches:
            weights = [int(gain[np.frombuffer(found, _type(features))].sum()) for found in every]
            yield pd.DataFrame({"weight": weights, "noise": [noise(seed, name or "") for name in names]}, dtype="int64")

    rows = rows.select("id", "row", "n_words", "n_features", scored(F.col("id").cast("string"), F.col("found")).alias("s"))
    rows = cut_lineage(rows.select("id", "row", "n_words", "n_features", "s.weight", (F.col("s.weight") + F.col("s.noise")).alias("score")))
    able = F.col("n_words") >= min_words
    drawn = rows.where(able).count() * percent // 100
    ranked = numbered(rows.where(able), [F.desc("score"), F.asc_nulls_first("id"), F.asc("row")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    every = ranked.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return every.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
