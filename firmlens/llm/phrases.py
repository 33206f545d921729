"""Collocations by Rabin-Karp fingerprints.

Prefix polynomials over the bytes of many texts give every word a hash, prefix polynomials over the words give every n-gram one:
a difference of two prefixes, so an n-gram costs the same at any length. Tasks combine equal fingerprints by sorting and deal sorted
runs by ranges of the fingerprint; merging the runs of a range sums the counts and keeps two occurrence pointers (hashes of texts). Only
n-grams whose shorter n-grams are all frequent are counted at all: what is frequent at one length is a bitmap for the next. Frequent
fingerprints are then looked up in the texts they point to, checked and turned into phrases; scores and ranks are plain joins of phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.common import shuffle_partitions
from firmlens.session import cut_lineage

LONGEST = 4
#: bytes hashed at a time, n-grams combined at a time
BLOCK, CHUNK = 1 << 19, 1 << 21
#: ranges of the fingerprint, for each shuffle partition
RANGES_EACH = 4
#: a bitmap has 16 bits for each frequent n-gram, within these bounds; a full one only lets more n-grams be counted
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 16, 1 << 28, 16
#: shares of a language that are ranked apart first
SHARES = 64
PRIME = (1 << 31) - 1
#: (factor of bytes, factor of words) modulo 2**64 and modulo PRIME; the next row is taken if texts under one fingerprint differ
BASES = (
    ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (1_000_003, 48_271)),
    ((0xD6E8FEB86659FD93, 0x94D049BB133111EB), (16_807, 69_621)),
    ((0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25), (630_360_016, 742_938_285)),
)
_SPACE, _BREAK = 32, 10
#: A-Z to a-z, tabs to spaces, marks between pieces to line ends
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else _SPACE if c == 9 else _BREAK if chr(c) in ".,;:!?\n\v\f\r" else c for c in range(256))
_POINTER = (1 << 32) - 1
_SEPARATOR = re.compile(rb"[ \n]")


def _powers(base: int, n: int, modulus: int) -> np.ndarray:
    """base ** 0 .. n - 1, by doubling; modulus 2**64 is the wrap of the type."""
    out, known = np.ones(n, np.uint64), 1
    while known < n:
        k = min(known, n - known)
        step = np.uint64(pow(base, known, modulus))
        out[known : known + k] = out[:k] * step if modulus > PRIME else out[:k] * step % np.uint64(PRIME)
        known += k
    return out


class _Polynomial:
    """Hashes of slices by differences of prefix sums, modulo 2**64 (fingerprint) or a prime (check)."""

    def __init__(self, base: int, modulus: int):
        self.base, self.modulus = base, modulus
        self._up = self._down = np.ones(1, np.uint64)

    def prefixes(self, values: np.ndarray) -> np.ndarray:
        """Sum of values[i] * base**i over the first k values, for every k."""
        if len(values) + 1 > len(self._up):
            n = len(values) + 1 + len(values) // 4
            self._up, self._down = _powers(self.base, n, self.modulus), _powers(pow(self.base, -1, self.modulus), n, self.modulus)
        out = np.zeros(len(values) + 1, np.uint64)
        terms = values * self._up[: len(values)]
        np.cumsum(terms if self.modulus > PRIME else terms % np.uint64(PRIME), out=out[1:])
        return out

    def slices(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of values[start:end], the same wherever the slice stands."""
        if self.modulus > PRIME:
            return (prefixes[end] - prefixes[start]) * self._down[start]
        return (prefixes[end] - prefixes[start]) % np.uint64(PRIME) * self._down[start] % np.uint64(PRIME)


class Words:
    """Word hashes of texts: arrays of fingerprint, check, piece, document and byte offset."""

    def __init__(self, bases, block: int = BLOCK):
        (byte, word), (byte_p, word_p) = bases
        self._block = block
        self._bytes, self._bytes_p = _Polynomial(byte | 1, 1 << 64), _Polynomial(byte_p, PRIME)
        self._words, self._words_p = _Polynomial(word | 1, 1 << 64), _Polynomial(word_p, PRIME)
        self._piece = 0

    def blocks(self, texts: Sequence[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """Cleaned bytes of about a block, with the place where each document begins in the block and its number; long texts are cut at
        separators (``begin`` may be negative: the document began in an earlier block)."""
        parts, begins, numbers, size = [], [], [], 0

        def block():
            return b"".join(parts), np.array(begins, np.int64), np.array(numbers, np.int64)

        for number, text in enumerate(texts):
            data, at = text.translate(_CLEAN), 0
            while True:
                end = len(data)
                if end - at > self._block:
                    m = _SEPARATOR.search(data, at + self._block)
                    end = m.start() if m else end
                begins.append(size - at)
                numbers.append(number)
                parts.append(data[at:end] + (b"\n" if end == len(data) else b" "))
                size += len(parts[-1])
                if size >= self._block:
                    yield block()
                    parts, begins, numbers, size = [], [], [], 0
                at = end
                if at >= len(data):
                    break
        if parts:
            yield block()

    def hashed(self, texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """(fingerprint, check, piece, document, offset) of the words of each block."""
        for data, begins, numbers in self.blocks(texts):
            a = np.frombuffer(data, np.uint8)
            breaks = a == _BREAK
            inside = np.zeros(len(a) + 2, bool)
            inside[1:-1] = ~(breaks | (a == _SPACE))
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            start, end = edges[0::2], edges[1::2]
            values = a.astype(np.uint64) + np.uint64(1)
            fp = self._bytes.slices(self._bytes.prefixes(values), start, end)
            check = self._bytes_p.slices(self._bytes_p.prefixes(values), start, end)
            # words are told from other slices with the same sum by their length
            fp = (fp ^ (fp >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185) + (end - start).astype(np.uint64)
            ends = np.cumsum(breaks, dtype=np.int64)
            piece = self._piece + ends[start] if len(start) else start
            self._piece += int(ends[-1])
            place = np.searchsorted(np.maximum.accumulate(np.maximum(begins, 0)), start, side="right") - 1
            yield fp, check, piece, numbers[place], start - begins[place]

    def ngrams(self, fp: np.ndarray, check: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and check of the n words from each place on (as many places as there are such n-grams)."""
        start = np.arange(max(0, len(fp) - n + 1))
        return self._words.slices(self._words.prefixes(fp), start, start + n), self._words_p.slices(self._words_p.prefixes(check), start, start + n)


def _bit(fp: np.ndarray, bits: int) -> np.ndarray:
    x = fp * np.uint64(0x9FB21C651E98DF25)
    return (x ^ (x >> np.uint64(32))) & np.uint64(bits - 1)


class Bitmap:
    """Which fingerprints may be frequent. Its size is bounded whatever the number of members."""

    def __init__(self, bits: int, cells: Broadcast):
        self.bits, self._cells = bits, cells

    @classmethod
    def of(cls, members: DataFrame, count: int, most: int = MOST_BITS) -> Bitmap:
        bits = min(max(LEAST_BITS, 1 << (BITS_EACH * count).bit_length()), most)

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = np.unique(_bit(batch.column(0).to_numpy().view(np.uint64), bits))
                if len(b):
                    first = np.flatnonzero(np.diff(b >> np.uint64(6), prepend=np.uint64(1 << 60)))
                    mask = np.bitwise_or.reduceat(np.uint64(1) << (b & np.uint64(63)), first)
                    yield pa.record_batch([pa.array((b[first] >> np.uint64(6)).view(np.int64)), pa.array(mask.view(np.int64))], names=["cell", "mask"])

        found = members.select("fp").mapInArrow(cells, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
        out = np.zeros(bits // 64, np.uint64)
        out[found.column("cell").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
        return cls(bits, members.sparkSession.sparkContext.broadcast(out))

    def has(self, fp: np.ndarray) -> np.ndarray:
        b = _bit(fp, self.bits)
        return (self._cells.value[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1


#: a run: columns of fingerprint, check, count and pointer one after the other
_RUN = [("fp", "<u8"), ("check", "<u4"), ("n", "<u8"), ("doc", "<u4")]
_RUNS, _COUNTED = "size int, range int, rows int, run binary", "fp long, check int, size int, n long, low long, high long"


def _packed(*columns: np.ndarray) -> bytes:
    return b"".join(c.astype(kind).tobytes() for c, (_, kind) in zip(columns, _RUN))


def _unpacked(run: bytes, rows: int) -> list[np.ndarray]:
    out, at = [], 0
    for _, kind in _RUN:
        out.append(np.frombuffer(run, kind, rows, at))
        at += out[-1].nbytes
    return out


def _grouped(fp: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order in which equal (fingerprint, check) stand together, both in that order, and where each group begins."""
    order = np.argsort(fp)
    sorted_fp, sorted_check = fp[order], check[order]
    new_fp, new_check = sorted_fp[1:] != sorted_fp[:-1], sorted_check[1:] != sorted_check[:-1]
    if (new_check & ~new_fp).any():
        order = np.lexsort((check, fp))
        sorted_fp, sorted_check = fp[order], check[order]
        new_fp, new_check = sorted_fp[1:] != sorted_fp[:-1], sorted_check[1:] != sorted_check[:-1]
    first = np.ones(len(fp), bool)
    first[1:] = new_fp | new_check
    return order, sorted_fp, sorted_check, np.flatnonzero(first)


def counted(texts: DataFrame, sizes: Sequence[int], bases, shorter: Bitmap | None = None, least: int = 1, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(fp, check, size, n, low, high): n-grams of these sizes that occur ``least`` times or more, with their counts and two pointers.

    ``texts`` has (text, lang_key, doc); pointers are the lower halves of ``doc``. The fingerprint covers the language. With ``shorter``, only
    n-grams are counted whose parts of one word less than the smallest size are all in it. Size 1 also counts all words
    under the language's key, as size 0.
    """
    least_size, longest = min(sizes), max(sizes)
    ranges = max(1, (RANGES_EACH * shuffle_partitions(texts)).bit_length())

    def runs(size: int, fp: np.ndarray, check: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, fp, check, first = _grouped(fp, check)
        yield from dealt(size, fp[first], check[first], np.diff(first, append=len(fp)), doc[order[first]])

    def dealt(size: int, fp: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        of = (fp >> np.uint64(64 - ranges)).astype(np.int64)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(fp)]))
        parts = [_packed(*(c[a:b] for c in (fp, *columns))) for a, b in cuts]
        yield pa.record_batch([pa.array([size] * len(cuts), pa.int32()), pa.array(of[starts].astype(np.int32)), pa.array([b - a for a, b in cuts], pa.int32()), pa.array(parts, pa.binary())], names=["size", "range", "rows", "run"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, totals = Words(bases, block), {}
        # the last words of a block may begin n-grams that end in the next one
        held = [np.zeros(0, kind) for kind in (np.uint64, np.uint64, np.int64, np.uint64, np.uint32)]
        found = {n: [] for n in sizes}

        def grams(last: bool) -> None:
            fp, check, piece, lang, doc = held
            starts = len(fp) if last else len(fp) - (longest - 1)
            alive = None
            if shorter is not None:
                parts, _ = own.ngrams(fp, check, least_size - 1)
                alive = shorter.has(parts + lang[: len(parts)])
            for n in sizes:
                g, c = own.ngrams(fp, check, n)
                m = max(0, min(len(g), starts))
                keep = piece[:m] == piece[n - 1 : n - 1 + m] if n > 1 else np.ones(m, bool)
                if alive is not None:
                    for k in range(n - least_size + 2):
                        keep &= alive[k : k + m]
                (i,) = np.nonzero(keep)
                found[n].append((g[i] + lang[i], c[i].astype(np.uint32), doc[i]))

        def flushed(limit: int) -> Iterator[pa.RecordBatch]:
            for n, parts in found.items():
                if sum(len(x[0]) for x in parts) >= limit:
                    columns = [np.concatenate(x) for x in zip(*parts)]
                    parts.clear()
                    yield from runs(n, *columns)

        for batch in batches:
            langs, docs = (batch.column(c).to_numpy().view(np.uint64) for c in ("lang_key", "doc"))
            raw = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for fp, check, piece, number, _ in own.hashed(raw):
                lang = langs[number]
                if 1 in sizes:
                    for key, k in zip(*np.unique(lang, return_counts=True)):
                        totals[key] = totals.get(key, 0) + int(k)
                held = [np.concatenate(x) for x in zip(held, (fp, check, piece, lang, docs[number].astype(np.uint32)))]
                grams(False)
                held = [x[max(0, len(x) - (longest - 1)) :] for x in held]
                yield from flushed(chunk)
        grams(True)
        yield from flushed(1)
        if totals:
            keys = np.array(sorted(totals), np.uint64)
            zero = np.zeros(len(keys), np.uint64)
            yield from dealt(0, keys, zero, np.array([totals[k] for k in keys], np.uint64), zero)

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        columns = [np.concatenate(c) for c in zip(*(_unpacked(run, rows) for run, rows in zip(table.column("run").to_pylist(), table.column("rows").to_pylist())))]
        order, fp, check, first = _grouped(columns[0], columns[1])
        n, doc = np.add.reduceat(columns[2][order].astype(np.int64), first), columns[3][order]
        keep = (n >= least) | (key[0].as_py() == 0)
        low, high = (f.reduceat(doc, first)[keep].astype(np.int64) for f in (np.minimum, np.maximum))
        fp, check = fp[first][keep].view(np.int64), check[first][keep].astype(np.int32)
        return pa.table({"fp": fp, "check": check, "size": np.full(len(fp), key[0].as_py(), np.int32), "n": n[keep], "low": low, "high": high})

    return texts.select("text", "lang_key", "doc").mapInArrow(count, _RUNS).groupBy("size", "range").applyInArrow(merged, _COUNTED)


def materialised(texts: DataFrame, found: DataFrame, bases) -> DataFrame | None:
    """(lang, size, phrase, n) of the rows of ``counted``; None if texts under one fingerprint differ.

    The texts that the pointers name are hashed again, the fingerprints found in them and the words there compared. The second hash
    (modulo a prime) is part of the key, so other occurrences differ only if both hashes collide. Only texts that a
    pointer names are shuffled, copies once.
    """
    wanted = found.select("fp", "check", "size", F.explode(F.array("low", "high")).alias("pointer")).distinct()
    wanted = cut_lineage(wanted)
    held = Bitmap.of(wanted.select(F.col("pointer").alias("fp")).distinct(), wanted.count())

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pointer in batches:
            yield pd.Series(held.has(pointer.to_numpy().view(np.uint64)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Words(bases)
        for batch in batches:
            rows = []
            for text, lang, key, asked in zip(batch["text"], batch["lang"], batch["lang_key"], batch["asked"]):
                data = text.encode("utf-8", "surrogatepass")
                parts = [np.concatenate(x) for x in zip(*own.hashed([data]))]
                clean = data.translate(_CLEAN)
                for size in {a["size"] for a in asked}:
                    fp, check = own.ngrams(parts[0], parts[1], size)
                    fp = (fp + np.int64(key).view(np.uint64)).view(np.int64)
                    last = np.arange(len(fp)) + size - 1
                    (whole,) = np.nonzero(parts[2][: len(fp)] == parts[2][last])
                    whole = whole[np.argsort(fp[whole], kind="stable")]
                    for a in asked:
                        if a["size"] != size:
                            continue
                        i, j = (np.searchsorted(fp[whole], a["fp"], side) for side in ("left", "right"))
                        for k in whole[i:j]:
                            if check[k] == a["check"]:
                                m = re.compile(rb"[^ \n]+" + rb" +[^ \n]+" * (size - 1)).match(clean, int(parts[4][k]))
                                phrase = b" ".join(w for w in m[0].split(b" ") if w)
                                rows.append((a["fp"], a["check"], size, lang, phrase.decode("utf-8", "surrogatepass")))
                                break
            yield pd.DataFrame(rows, columns=["fp", "check", "size", "lang", "phrase"])

    asked = wanted.groupBy("pointer").agg(F.collect_list(F.struct("fp", "check", "size")).alias("asked"))
    pointed = texts.withColumn("pointer", F.col("doc").bitwiseAND(F.lit(_POINTER))).where(holds("pointer"))
    pointed = pointed.groupBy("pointer", "doc").agg(*(F.first(c).alias(c) for c in ("text", "lang", "lang_key")))
    said = pointed.join(asked, "pointer").mapInPandas(read, "fp long, check int, size int, lang string, phrase string")
    said = said.groupBy("fp", "check", "size").agg(F.min("lang").alias("lang"), F.max("lang").alias("lang2"), F.min("phrase").alias("phrase"), F.max("phrase").alias("phrase2"))
    full = cut_lineage(found.select("fp", "check", "size", "n").join(said, ["fp", "check", "size"], "left"))
    if not full.where("phrase IS NULL OR phrase <> phrase2 OR lang <> lang2").isEmpty():
        return None
    return full.select("lang", "size", "phrase", "n")


def frequent(texts: DataFrame, least: int, longest: int, bases, block: int = BLOCK, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame | None]:
    """(lang_key, n) of all words, and the n-grams of 1 to ``longest`` words that occur ``least`` times; None as in ``materialised``."""
    words = cut_lineage(counted(texts, [1], bases, None, least, block, chunk))
    levels, totals = [words.where("size = 1")], words.where("size = 0").select(F.col("fp").alias("lang_key"), "n")
    for sizes in ([2], list(range(3, longest + 1))):
        if sizes and sizes[-1] <= longest:
            last = levels[-1]
            levels.append(cut_lineage(counted(texts, sizes, bases, Bitmap.of(last, last.count()), least, block, chunk)))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return totals, materialised(texts, every, bases)


def collocations(
    docs: DataFrame, least: int = 30, longest: int = LONGEST, top: int = 2000, covered_percent: int = 80, text_col: str = "text", lang_col: str = "lang",
    bases=BASES, block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    A phrase is a run of words (anything but blanks and tabs, A-Z lower-cased) inside a piece (up to one of ``.,;:!?`` or a line end). Its
    count a is at least ``least``; cut into two parts with counts l and r it scores floor(2000000 a / (l + r)), the lowest
    cut counts, of equal ones the shortest first part. Phrases inside a longer frequent phrase f with 100 f >= ``covered_percent`` a
    are left out. Rank goes by score, count, then the phrase's bytes. n counts all words of the language.

    Null texts are empty, a null language is ``und``. Repeated rows count each time. Texts are read whole, a very long one in blocks
    cut between words. An empty table or one without frequent phrases gives an empty result. Other columns are not read.
    """
    lang, text = F.coalesce(F.col(lang_col), F.lit("und")), F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text.alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), F.xxhash64(lang, text).alias("doc"))
    for tried in bases:
        totals, found = frequent(texts, least, longest, tried, block, chunk)
        if found is not None:
            break
    else:
        raise ValueError("texts under one fingerprint differ with every base")
    found = cut_lineage(found)
    long = found.where("size > 1").withColumn("words", F.split("phrase", " "))
    joined = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = long.select("lang", "phrase", "size", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    part = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("cast(cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r) as bigint)"))
    best = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("b")).select("lang", "phrase", "b.*")
    inner = long.where("size > 2").select("lang", "n", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inner = inner.select("lang", "n", "words", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("i"))
    longer = inner.groupBy("lang", joined(F.col("i"), F.col("k")).alias("phrase")).agg(F.max("n").alias("f"))
    covered = F.col("f").cast("decimal(20, 0)") * 100 >= F.col("a").cast("decimal(20, 0)") * covered_percent
    kept = best.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    # the best of each share of a language first, so that one task gets a bounded number of rows
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    ranked = ranked.withColumn("lang_key", F.xxhash64("lang")).join(totals, "lang_key")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
