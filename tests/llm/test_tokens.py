"""BPE and packing against the tokenizers library, exact optima and counts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firmlens.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [*range(0, 0x300), 0x1680, 0x180E, 0x2000, 0x2028, 0x202F, 0x205F, 0x3000, 0x4E00, 0x1F600, 0x1C5, 0x2160, 0x300, 0x20AC, 0x66B, 0x660, 0xE33, 0xFEFF, 0x200B, 0x200D]
EDGE = ["", " ", "\n\n  \n", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "'s 't'll I'LL", "a" * 3000, " " * 5000 + "x", "ab1" * 999, "é" * 500, "\r\n\t x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    pool = [chr(x) for x in ODD] + [" "] * 80 + ["\n"] * 20 + list("etaoinshrdlu") * 30
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 50))) for _ in range(n)]


def test_encode_equals_the_library(library, sample):
    own = bpe.codec(PATH)
    for text in EDGE + odd_texts(1500) + [t for _, t in sample]:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want
        assert own.decode(np.array(want, np.uint32)).decode() == library.decode(want, skip_special_tokens=False)


def test_every_token_and_small_caches(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "LONG_TEXT", 7)
    own = bpe.Codec(PATH)
    for text in odd_texts(300, 2):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(own.encode(text)).decode() == text
    words = [own.blob[own.offsets[i] : own.offsets[i + 1]].tobytes() for i in range(0, own.size, 37)]
    for word in words:
        text = word.decode("utf-8", "ignore")
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_pairs_decide_like_the_library(library):
    own, rng = bpe.codec(PATH), random.Random(4)
    plain = [i for t, i in own.vocab.items() if t.isascii() and t.isalpha()]
    for _ in range(2000):
        a, b = rng.choice(plain), rng.choice(plain)
        text = own.decode(np.array([a, b], np.uint32)).decode()
        assert own.fits(a, b) == (library.encode(text, add_special_tokens=False).ids == [a, b])


def test_encode_decode_frame(make_docs, library):
    docs = make_docs([(1, "Hello there"), (2, None), (3, ""), (3, "Hello there")]).withColumn("ids", F.lit("old")).withColumn("coded", F.lit(1))
    got = bpe.encode_decode(docs, PATH)
    assert set(got.columns) == {*docs.columns, "decoded"}
    rows = sorted((r.doc_id, list(r.ids), r.decoded) for r in got.collect())
    ids = library.encode("Hello there", add_special_tokens=False).ids
    assert rows == [(1, ids, "Hello there"), (2, [], ""), (3, [], ""), (3, ids, "Hello there")]
    assert bpe.encode_decode(make_docs([]), PATH).count() == 0


def held(patterns, capacity):
    out = defaultdict(int)
    for content, count in patterns:
        assert sum(content) <= capacity and count > 0
        for size in content:
            out[size] += count
    return dict(out), sum(count for _, count in patterns)


def optimum(items, capacity):
    best, items = [len(items)], sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= capacity}:
            k = bins.index(room)
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(5))
def test_reduction_keeps_an_optimal_packing(seed):
    rng = random.Random(seed)
    for _ in range(60):
        capacity = rng.choice([10, 20, 50])
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 11))]
        histogram = {s: items.count(s) for s in items}
        fixed, rest = packing.reduce_by_dominance(histogram, capacity)
        assert sum(n for _, n in fixed) + optimum([s for s, n in rest.items() for _ in range(n)], capacity) == optimum(items, capacity)
        assert held(packing.plan(histogram, capacity), capacity)[0] == histogram


def test_plan_grows_with_lengths_not_documents():
    for n in (10**3, 10**12):
        histogram = {s: n // (s + 5) + 1 for s in range(1, 1025)}
        patterns = packing.plan(histogram)
        content, count = held(patterns, 1024)
        assert content == histogram and len(patterns) < 10_000
        assert count <= -(-sum(s * c for s, c in histogram.items()) // 1024) + 2


def check_packed(rows, texts, library, capacity):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in texts.items():
        ids, at = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for k, r in enumerate(sorted(pieces.pop(doc_id), key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert k == 0 or r.length == capacity
            at += r.length
        assert at == len(ids)
    assert not pieces
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_pack(make_docs, library, sample, capacity):
    texts = dict(sample) | {10**6 + i: t for i, t in enumerate(EDGE)} | {2 * 10**6: None} | {3 * 10**6 + i: "the same hot text" for i in range(700)}
    got = packing.pack(make_docs(list(texts.items())).withColumn("length", F.lit(1)), PATH, capacity=capacity).collect()
    n = check_packed(got, texts, library, capacity)
    total = sum(r.length for r in got)
    assert -(-total // capacity) <= n <= 1.02 * total / capacity + 2


def test_pack_repeated_and_empty(make_docs):
    assert packing.pack(make_docs([]), PATH).count() == 0
    rows = packing.pack(make_docs([(1, "a"), (1, "a"), (None, "b")]), PATH).collect()
    assert len(rows) == 3 and {r.sequence_id for r in rows} == {rows[0].sequence_id} and sorted(r.offset for r in rows) == [0, 2, 4]
