"""Exact and SimHash duplicates against brute force on small tables."""

import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from firmlens.llm import components, exactdup, simhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "Ä"), (6, "ä"), (7, "a b"), (7, "a b"), (None, "only"), (None, "a b"), (8, " "), (9, "x " * 50000)]


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(FOLD)].append(doc_id)
    out = []
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("fan_in", [2, 4, 16])
def test_exact_duplicates(make_docs, sample, fan_in):
    rows = EDGE + sample
    got = exactdup.exact_duplicates(make_docs(rows), fan_in=fan_in).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_hot_text(make_docs):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)]
    got = exactdup.exact_duplicates(make_docs(rows, 7))
    assert got.where("group_size = 2000 AND keep_id = 2999").count() == 2000 and got.where("kept").count() == 1001


def test_drop_duplicates(make_docs):
    docs = make_docs(EDGE).withColumn("stay", F.lit(1)).withColumn("dup_key", F.lit("x"))
    got = exactdup.drop_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(7, "a b"), (4, ""), (5, "Ä"), (6, "ä"), (None, "only"), (8, " "), (9, EDGE[-1][1])], key=str)


def test_empty_table(make_docs):
    docs = make_docs([])
    assert exactdup.exact_duplicates(docs).count() == 0 and exactdup.drop_duplicates(docs).count() == 0
    assert simhash.simhash_components(docs).count() == 0 and simhash.drop_near_duplicates(docs).count() == 0


def plain_fingerprint(text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in (text or "").translate(FOLD)).split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for n, a in enumerate(distinct):
        for b in distinct[n + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, f in prints:
        least[find(f)].append(i)
    return sorted(((i, f"{f:016x}", min((x for x in least[find(f)] if x is not None), default=None)) for i, f in prints), key=str)


def near_copies(rng, n):
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    out = []
    for _ in range(n):
        words = list(base)
        words[rng.randrange(300)] = f"x{rng.randrange(9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("dense", [1024, 2])
def test_simhash_components(make_docs, sample, dense):
    rng = random.Random(3)
    rows = EDGE + [(100 + i, t) for i, t in enumerate(near_copies(rng, 120))] + [(1000 + i, t) for i, t in sample]
    got = simhash.simhash_components(make_docs(rows), dense=dense).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == brute_components(rows)


@pytest.mark.parametrize("dense", [1024, 1])
def test_links_of_a_hot_variant(spark, dense):
    """A whole ball of fingerprints around one, and one of them far from another."""
    ball = [0] + [1 << i for i in range(63)] + [(1 << i) | (1 << j) for i in range(0, 63, 5) for j in range(i)]
    nodes = spark.createDataFrame([(x,) for x in ball], "fp long")
    got = {(r.u, r.v) for r in simhash.links(nodes, dense).collect()}
    want = {(min(a, b), max(a, b)) for a in ball for b in ball if a != b and (a ^ b).bit_count() <= 2}
    if dense == 1024:
        assert got == want
    assert got <= want
    joined = {r.u: r.root for r in components.components(simhash.links(nodes, dense)).collect()}
    assert joined == {x: 0 for x in ball}


def test_long_text_is_cut_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 997}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 3)
    assert simhash.fingerprint(text) == whole
    assert whole & (2**64 - 1) == plain_fingerprint(text)


def test_drop_near_duplicates(make_docs):
    rng = random.Random(5)
    docs = make_docs([(i, t) for i, t in enumerate(near_copies(rng, 60))] + [(900, "clean one here"), (901, None)]).withColumn("fp", F.lit("x"))
    got = simhash.drop_near_duplicates(docs)
    want = {r.component_id for r in simhash.simhash_components(docs).collect()}
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_drop_near_duplicates_of_repeated_rows(make_docs):
    docs = make_docs([(1, "a b c d"), (1, "a b c d"), (1, "something else entirely here"), (2, "a b c d"), (None, "a b c d"), (None, "x")])
    got = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, "a b c d"), (1, "something else entirely here"), (None, "a b c d"), (None, "x")], key=str)


def test_one_document_of_each_group_stays(make_docs):
    rows = [(3, "a b c d"), (7, "a b c d"), (7, "something else entirely here"), (None, "x y z"), (None, "x y z"), (None, "X y z")]
    got = sorted(((r.doc_id, r.text.lower()) for r in simhash.drop_near_duplicates(make_docs(rows)).collect()), key=str)
    assert got == sorted([(3, "a b c d"), (7, "something else entirely here"), (None, "x y z")], key=str)
    copies = near_copies(random.Random(5), 60)
    left = simhash.drop_near_duplicates(make_docs([(None, t) for t in copies])).count()
    assert left == len({r[2] for r in brute_components(list(enumerate(copies)))}) < 60


def test_components_of_chain(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1001), (1000, 1001)]
    got = {r.u: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_no_shuffle_by_digest_before_the_tree(make_docs, sample):
    """The first exchange above the staged rows deals whole runs."""
    plan = exactdup.exact_duplicates(make_docs(sample))._jdf.queryExecution().executedPlan().toString()
    first = [line for line in plan.split("\n") if "Exchange" in line and "Reused" not in line]
    staged = [i for i, line in enumerate(plan.split("\n")) if "Scan parquet" in line]
    lines = plan.split("\n")
    above = [next(lines[j] for j in range(i, -1, -1) if "Exchange" in lines[j]) for i in staged]
    assert first and any("hashpartitioning" not in line for line in above), above


def test_empty_and_null_ids_keep_their_own_rows(spark):
    rows = [("", "a"), (None, "a"), ("", "a"), ("x", "b"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r.doc_id, r.text) for r in exactdup.drop_duplicates(docs).collect()), key=str)
    assert got == sorted([("", "a"), ("x", "b"), (None, "c")], key=str)


def test_links_of_one_hot_half(spark):
    """Every fingerprint has the same lower half, far more of them than ``dense``."""
    rng = random.Random(1)
    high = [rng.getrandbits(31) for _ in range(300)]
    high += [h ^ (1 << rng.randrange(31)) for h in high[:100]] + [h ^ 3 for h in high[100:150]]
    fps = sorted({(h << 32) | 12345 for h in high})
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 16).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert got <= want
    pairs = spark.createDataFrame(sorted(want), "u long, v long")
    assert sorted(components.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 16)).collect()) == sorted(components.components(pairs).collect())
