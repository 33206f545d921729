"""Shards of ids: hash index, whole round trip and keyed access against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firmlens.llm import idshards
from firmlens.session import staging_path

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\t", "It's THE end's", "a\x1cb \x1d", "ΑΣ ΣΑΣ", "İstanbul ǅ ŉ", "é ́ x", "ﬁ ½ ²a 12ab", "<|endoftext|> a<|startoftext|>b", "漢字 かな", "a\x85b c\xa0d", "​﻿", "😀" * 40, "x" * 3000, "don't'll'VE", "a.'sure ''s 1's,'t '", "’t x’s \x00'd _a_ ²3", "a" * 399 + "b. " + "c" * 401, "ok <|endoftext|>", "é" * 500 + "!"]


def expected(rows, path, end):
    library, at, out = Tokenizer.from_file(path), 0, []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def written(spark, docs, path=WORDS, end=1, **sizes):
    to = staging_path(spark, "ids")
    idshards.write_shards(docs, to, path, end, **sizes)
    return to


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 20_000])
def test_hash_is_minimal_and_perfect(n):
    names = [None, *(str(random.Random(n).randrange(10**9) + i * 10**9).encode() for i in range(n - 1))]
    seed, displaced = idshards.displacements(names)
    places = idshards._located(idshards._hashes(names, seed), displaced, n)
    assert sorted(places.tolist()) == list(range(n))


def test_shard_keyed_access():
    names = [None, b"", b"1", b"1", b"1", b"2"]
    ids = [np.arange(k, dtype="<u2").tobytes() for k in (1, 2, 3, 4, 5, 6)]
    s = idshards.Shard(idshards.pack_shard(names, ids, 2) + b"\n")
    assert s.names() == [None, b"", b"1", b"2"]
    assert s.find([b"1", b"2", b"", None]).tolist() == [[2, 3], [5, 1], [1, 1], [0, 1]]
    assert s.find([str(i).encode() for i in range(10, 5000)]).sum() == 0 and len(s.find([])) == 0
    assert [s.ids(i).tolist() for i in (0, 4)] == [[0], [0, 1, 2, 3, 4]]
    with pytest.raises(ValueError):
        idshards.Shard(idshards.pack_shard(names, ids, 2)[:-1])


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_equals_library(path, sample):
    texts = [t for _, t in sample] + ODD + [None]
    own, library = idshards.Encoder(path, 1), Tokenizer.from_file(path)
    for _ in range(2):
        assert [np.frombuffer(x, own.type).tolist() for x in own.batch(texts)] == [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_encoder_random_marks():
    rng, library, own = random.Random(5), Tokenizer.from_file(WORDS), idshards.Encoder(WORDS, 1)
    marks = "abstrevmld STREVMLD" + "'" * 5 + "..,!1²\t\n_-é’\x1c\x0b\xa0"
    texts = ["".join(rng.choices(marks, k=rng.randrange(60))) for _ in range(20_000)]
    texts += ["".join(rng.choices("etaoinsrhldcumfpgwybvkxjqz", k=rng.randrange(1, 390))) for _ in range(3000)]
    assert own.batch(texts) == [np.array([*e.ids, 1], own.type).tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_encoder_every_letter():
    texts = [" ".join(chr(c) + x for c in range(a, a + 64) if not 0xD800 <= c < 0xE000 for x in ("", "a", "1", "!A")) for a in range(1, 0x3100, 64)]
    own, library = idshards.Encoder(WORDS, 1), Tokenizer.from_file(WORDS)
    for text, got in zip(texts, own.batch(texts)):
        assert np.frombuffer(got, own.type).tolist() == library.encode(text, add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("sizes", [{}, {"shard_ids": 3000}, {"shard_docs": 1}])
def test_given_table(spark, make_docs, sample, sizes):
    rows = sorted(sample)
    to = written(spark, make_docs(rows), **sizes)
    want = expected(rows, WORDS, 1)
    assert rows_of(idshards.read_back(spark, to)) == want
    keys = spark.createDataFrame([(i,) for i in [*range(0, 400, 7), 7, 10**6, None]], "doc_id long")
    assert rows_of(idshards.lookup_keys(spark, to, keys, routes=5)) == [r for r in want if r[0] % 7 == 0 and r[0] < 400]


def test_nulls_repeats_hot_key(spark, make_docs):
    rows = [(None, None), (None, "null id"), (3, "three"), (1, ""), (2, "Two")] + [(7, "hot key text")] * 300 + [(7, None)]
    to = written(spark, make_docs(rows).withColumns({"id": F.lit(1), "shard": F.lit(2), "name": F.lit("x")}), shard_docs=50)
    got = rows_of(idshards.read_back(spark, to))
    assert [r[0] for r in got[:5]] == [None, None, 1, 2, 3] and len(got) == len(rows)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in expected(rows, WORDS, 1))
    hot = spark.createDataFrame([(7,), (None,)], "doc_id long")
    assert len(rows_of(idshards.lookup_keys(spark, to, hot, routes=2))) == 303


def test_string_ids_long_text_empty_table(spark):
    rows = [("b", "long words " * 100_000), ("ä", "x"), ("Z", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    to = written(spark, docs, end=70_000)
    assert rows_of(idshards.read_back(spark, to)) == expected(sorted(rows, key=lambda r: r[0].encode()), WORDS, 70_000)
    assert idshards.lookup_keys(spark, to, docs.select("doc_id")).count() == 3
    none = written(spark, docs.where("false"))
    assert idshards.read_back(spark, none).count() == idshards.lookup_keys(spark, none, docs.select("doc_id")).count() == 0
