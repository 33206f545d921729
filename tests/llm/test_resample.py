"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from firmlens.llm import resample
from firmlens.llm.resample import Features, Scanner


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text, f):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(f.shortest, f.longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, f=Features(), percent=10, min_words=20, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % f.buckets
    s, t = (Counter(bucket(g) for text in texts for g in features(text, f)) for texts in ([x for _, x in rows], target))
    every, wanted = sum(s.values()) + f.buckets, sum(t.values()) + f.buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * every / ((s[b] + 1) * wanted))) for b in s}
    out = []
    for doc, text in rows:
        found = [bucket(g) for g in features(text, f)]
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r, (_, text) in zip(out, rows) if len(words(text)) >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return sorted(map(str, out)), [(i + 1, *r) for i, r in enumerate(drawn)]


def result(df):
    rows = [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    return sorted(str(r[:4]) for r in rows), sorted((r[4], *r[:4]) for r in rows if r[4] is not None)


@pytest.mark.parametrize("f", [Features(), Features(1, 3, 257), Features(2, 2, 64)])
def test_given_table(make_docs, sample, spark, f):
    bench = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    assert result(resample.resample(make_docs(sample), target, features=f)) == brute(sample, bench, f)


def test_spans():
    scan = lambda text, *f: [x.decode() for s in [Scanner(Features(*f))] for d in [s.collapsed(text)] for m in s.spans(d) for x in [m[0]]]
    assert scan("A b--c", 2, 2) == ["a b", "b c"]
    assert scan("  one\x7ftwo  ", 1, 1) == ["one", "two"]
    assert scan("É1 x y", 1, 1) == ["É1", "x y"]
    assert scan("", 1, 3) == scan("--", 1, 3) == scan("one", 2, 3) == []
    assert Scanner(Features()).words(b"a b") == 2 and Scanner(Features()).words(b"") == 0


def test_nulls_repeats_ties(make_docs, spark):
    rows = [(None, "w " * 30), (None, None), (1, None), (2, ""), (3, "a b " * 15), (3, "a b " * 15), (4, "x " * 19)] + [(9, "same words here " * 10)] * 40
    target = spark.createDataFrame([("same",), (None,)], "text string")
    docs = make_docs(rows).withColumns({"rank": F.lit(7), "score": F.lit("s"), "id": F.lit(0), "row": F.lit(0)})
    got, drawn = result(resample.resample(docs, target, percent=50))
    assert (got, drawn) == brute(rows, ["same", None], percent=50)
    assert len(drawn) == 21


def test_long_text_and_empty_tables(make_docs, spark):
    rows = [(1, "word" * 500_000), (2, "to be " * 300_000), (3, "x")]
    target = spark.createDataFrame([], "text string")
    assert result(resample.resample(make_docs(rows), target, percent=100)) == brute(rows, [], percent=100)
    assert resample.resample(make_docs([(1, "a")]).where("false"), target).count() == 0
