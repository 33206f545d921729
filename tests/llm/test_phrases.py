"""Collocations against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlens.llm import phrases
from firmlens.llm.phrases import BASES, Words


def brute(rows, least, longest=4, top=2000, covered=80):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang or "und", tuple(words[i : i + n])] += 1
    out = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [f for (g, q), f in counts.items() if g == lang and len(q) > len(p) and f >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * f >= covered * a for f in longer):
                out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def made(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "text string, lang string").repartition(partitions)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "a", "of", "é", "über", "x" * 9, "to", "be", "\x01", "漢"])
    gap = lambda: rng.choice([" "] * 9 + ["  ", "\t", " \t ", ", ", ".", "\n", "\x0b", "\r\n", " ; "])
    return [("".join(word() + gap() for _ in range(rng.randrange(80))), rng.choice(["en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("seed, sizes", [(0, {}), (1, {"block": 50, "chunk": 20}), (2, {"block": 7, "chunk": 4})])
def test_small(spark, seed, sizes):
    rows = texts(seed, 120) + [(None, "en"), ("", None), (" \t.", "de")]
    assert result(phrases.collocations(made(spark, rows), least=4, **sizes)) == brute(rows, 4)


def test_lengths_top_and_cover(spark):
    rows = texts(5, 100)
    assert result(phrases.collocations(made(spark, rows), least=3, longest=2, top=7, covered_percent=30)) == brute(rows, 3, 2, 7, 30)
    assert result(phrases.collocations(made(spark, rows), least=3, longest=3, top=5, covered_percent=101)) == brute(rows, 3, 3, 5, 101)


def test_repeated_rows_ties_clashing_columns(spark):
    rows = [("alpha beta gamma. delta alpha beta", "en")] * 60 + [("b c", "de"), ("a b", "de")] * 30
    docs = made(spark, rows).withColumns({"fp": F.lit(1), "size": F.lit("s"), "doc": F.lit(None), "rank": F.lit(0), "n": F.lit(2)})
    assert result(phrases.collocations(docs)) == brute(rows, 30)


def test_colliding_fingerprints_are_found(spark):
    """With factor 1 the fingerprint of a phrase is that of any order of its words."""
    rows = [("one two", "en")] * 5 + [("two one", "en")] * 6 + [("two three four", "en")] * 4
    bad = ((1, 1), (1, 1))
    texts_ = made(spark, rows, 40).select("text", "lang", F.xxhash64("lang").alias("lang_key"), F.xxhash64("lang", "text").alias("doc"))
    assert phrases.frequent(texts_, 4, 4, bad)[1] is None
    assert result(phrases.collocations(made(spark, rows, 40), least=4, bases=(bad, BASES[1]))) == brute(rows, 4)
    with pytest.raises(ValueError):
        phrases.collocations(made(spark, rows, 40), least=4, bases=(bad,))


def test_long_text_long_word_empty_table(spark):
    rows = [("to be or not " * 200_000, "en"), ("w" * 3_000_000 + " end", "en"), ("to be", "fr")]
    got = result(phrases.collocations(made(spark, rows)))
    assert {r[2] for r in got} == {"not to be or", "or not to be", "be or not to", "to be or not"}
    assert {r[6] for r in got} == {800_002} and {r[3] for r in got} == {200_000, 199_999}
    assert phrases.collocations(made(spark, rows).where("false")).count() == 0
    assert phrases.collocations(made(spark, [("x y", "en")])).count() == 0


def test_word_hashes_are_those_of_slices():
    """Hashes do not depend on where a word stands, and word places are byte offsets."""
    texts_ = [b"Ab  cd,ab\tCD", b"", b"x ab"]
    for block in (1 << 20, 5, 1):
        parts = [np.concatenate(x) for x in zip(*Words(BASES[0], block).hashed(texts_))]
        fp, check, piece, number, at = parts
        assert number.tolist() == [0, 0, 0, 0, 2, 2] and at.tolist() == [0, 4, 7, 10, 0, 2]
        assert fp[0] == fp[2] == fp[5] != fp[1] == fp[3] and check[0] == check[2] == check[5]
        assert piece[0] == piece[1] != piece[2] == piece[3] != piece[4] == piece[5]
        pairs, checks = Words(BASES[0]).ngrams(fp, check, 2)
        assert pairs[0] == pairs[2] and checks[0] == checks[2] and len(set(pairs.tolist())) == 4


def test_bitmap_has_all_members(spark):
    fps = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    members = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    for most in (1 << 28, 1 << 16):
        held = phrases.Bitmap.of(members, 5000, most)
        assert held.has(fps.view(np.uint64)).all()
    assert phrases.Bitmap.of(members, 5000).has(np.arange(100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.1
