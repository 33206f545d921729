"""Multiset fingerprints: edits, order, equality and likeness against plain Python."""

import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from firmlens.llm import multiset

EDGE = [(10, None), (11, ""), (12, "\n\n"), (13, "one line only"), (14, "a\nb\nc"), (15, "ä😀 " * 50), (16, "x"), (17, "long " * 40000), (17, "long " * 40000), (None, "no id")]


def edited(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        quarter = len(text) // 4
        yield i, text, text[: len(text) - quarter] + after[:quarter], after


def test_edited_fingerprints(make_docs, sample):
    rows = EDGE + [(100 + i, t) for i, t in sample]
    docs = make_docs(rows, 5).withColumn("bucket", F.lit("x")).withColumn("rid", F.lit(0))
    got = multiset.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    by_sha = {(r.doc_id, r.edited_sha256): r for r in got}
    prints = {}
    for i, text, changed, after in edited(rows):
        r = by_sha[(i, hashlib.sha256(changed.encode()).hexdigest())]
        assert r.n_chars == len(text)
        prints.setdefault(text, set()).add(r.fingerprint)
        prints.setdefault(changed, set()).add(r.edited_fingerprint)
        if text == after:
            assert r.near_next == 1
        if text == changed:
            assert r.near_edited == 1
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(p)) for p in prints.values()}) == len(prints)
    long = [r for r in got if 1000 < r.n_chars < 100_000]
    assert sum(r.near_edited > r.near_next + 0.2 for r in long) > 0.95 * len(long)


def plain(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, part string")
    sums = multiset.phrase_sums(rows.withColumn("sign", F.lit(1)), ["rid"])
    lanes = sums.select("rid", multiset._lanes([F.col(f"s{k}") for k in range(32)]).alias("like"))
    return [(list(r.exact), list(r.like)) for r in rows.select("rid", multiset.exact_lanes(F.col("part")).alias("exact")).join(lanes, "rid").orderBy("rid").collect()]


def test_order_insertion_and_deletion(spark):
    rng = random.Random(1)
    lines = [" ".join(rng.choice(["some", "words", "are", "here", "and", "there."]) for _ in range(8)) for _ in range(30)]
    shuffled = rng.sample(lines, 30)
    whole, other, less, one = plain(spark, ["\n".join(lines), "\n".join(shuffled), "\n".join(lines[:-1]), lines[-1]])
    assert whole == other and whole != less
    assert [(a + b) % 2**32 for a, b in zip(less[0], one[0])] == whole[0]
    assert [(a + b) % 2**32 for a, b in zip(less[1], one[1])] == whole[1]


def test_lanes_hold_negative_sums(spark):
    low, high = -5, 7
    row = spark.createDataFrame([(low + high * 2**32, -(2**31 - 1) - 3 * 2**32, None)], "a long, b long, c long")
    assert list(row.select(multiset._lanes([F.col("a"), F.col("b"), F.col("c")]).alias("x")).first().x) == [2**32 - 5, 7, 2**31 + 1, 2**32 - 3, 0, 0]


def test_one_row_and_none(make_docs):
    assert multiset.edited_fingerprints(make_docs([])).count() == 0
    (row,) = multiset.edited_fingerprints(make_docs([(1, "abcdefgh")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def vector(text):
    """Both kinds of lanes of a text, from the definition."""
    exact, like = [0] * 8, [0] * 64
    for line in text.split("\n"):
        for seed in range(4):
            h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), xxhash.xxh64_intdigest(line.encode(), 42))
            exact[2 * seed] = (exact[2 * seed] + h % 2**32) % 2**32
            exact[2 * seed + 1] = (exact[2 * seed + 1] + (h >> 32)) % 2**32
    for phrase in re.split(multiset.PHRASE_END, text):
        h = signed(xxhash.xxh64_intdigest(phrase.encode(), 42))
        like[h % 64] += len(phrase) * (-1 if (h >> 8) % 2 else 1)
    return exact, like


def cosine(a, b):
    if a == b:
        return 1.0
    dot, norm = sum(x * y for x, y in zip(a[1], b[1])), math.sqrt(sum(x * x for x in a[1]) * sum(x * x for x in b[1]))
    return min(1.0, max(0.0, dot / norm)) if norm else 0.0


def shown(lanes):
    return "".join(f"{x % 2**32:08x}" for part in lanes for x in part)


def by_definition(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + after[:quarter]
        a, b, c = vector(text), vector(changed), vector(after)
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), shown(a), shown(b), round(cosine(a, b), 9), round(cosine(a, c), 9)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


def test_every_column_by_definition(make_docs, sample):
    rows = [r for r in EDGE if len(r[1] or "") < 1000] + [(100 + i, t) for i, t in sample[:80]]
    assert found(multiset.edited_fingerprints(make_docs(rows, 5))) == by_definition(rows)


@pytest.mark.parametrize("hot", [None, 5])
def test_hot_id_is_cut(make_docs, hot):
    """One id has most rows, some with the same text; no range gets many of them, and the order is that of the definition."""
    rows = [(hot, f"text {i % 150} of many\nend") for i in range(300)] + [(i, f"row {i}") for i in range(40)]
    docs = make_docs(rows, 7)
    sizes = multiset.with_next(docs, "doc_id", "text").where("extra = 0").groupBy("bucket").count().collect()
    assert sum(r["count"] for r in sizes) == len(rows) and max(r["count"] for r in sizes) <= 40
    assert found(multiset.edited_fingerprints(docs)) == by_definition(rows)


def test_string_ids(spark):
    rows = [("b", "one two"), ("a", "three four five"), (None, "six"), ("ä", "seven eight nine")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.edited_sha256 for r in multiset.edited_fingerprints(docs).collect()}
    order = [None, "a", "b", "ä"]
    text = dict(rows)
    for i, after in zip(order, order[1:] + order[:1]):
        n = len(text[i]) // 4
        assert got[i] == hashlib.sha256((text[i][: len(text[i]) - n] + text[after][:n]).encode()).hexdigest()
