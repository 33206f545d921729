"""Token counts against greedy longest match that builds the pieces."""

import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from firmlens.llm import wordpiece
from firmlens.llm.bpe import byte_alphabet

PATH = public_tokenizers.path("byte_bpe_50k.json")


def greedy(word, starts, continues):
    out, at = [], 0
    while at < len(word):
        pieces = continues if out else starts
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        out.append(word[at:end])
        at = end
    return len(out)


@pytest.mark.parametrize("seed", range(6))
def test_small_vocabularies(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(1, n)))
    for _ in range(60):
        starts, continues = {word(4) for _ in range(rng.randint(1, 8))}, {word(5) for _ in range(rng.randint(0, 8))}
        own = wordpiece.Automaton(starts, continues)
        for _ in range(60):
            w = word(12)
            assert own.count(w) == greedy(w, starts, continues), (w, starts, continues)
    assert own.count("") == 0


def brute(text, vocab):
    letters, out = dict(enumerate(byte_alphabet())), 0
    for word in (text or "").split():
        full = letters[32] + word.encode().decode("latin-1").translate(letters)
        out += greedy(full, vocab, vocab)
    return out


def test_documents(make_docs, sample):
    with open(PATH, encoding="utf-8") as f:
        vocab = set(json.load(f)["model"]["vocab"])
    rows = sample[:40] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n "), (10**6 + 3, "é😀 ñ x y"), (10**6 + 4, "a" * 3000 + " b"), (1, "twice"), (1, "twice")]
    docs = make_docs(rows).withColumn("n_words", F.lit("x")).withColumn("counted", F.lit(1))
    got = wordpiece.count_tokens(docs, PATH)
    assert set(got.columns) == {*docs.columns, "n_tokens"}
    found = sorted(((r.doc_id, r.n_words, r.n_tokens) for r in got.collect()), key=str)
    assert found == sorted(((i, len((t or "").split()), brute(t, vocab)) for i, t in rows), key=str)
    assert wordpiece.count_tokens(make_docs([]), PATH).count() == 0


def test_blocks_and_small_caches(monkeypatch, sample):
    own = wordpiece.Counter(PATH)
    want = [own.text(t) for _, t in sample[:50]]
    monkeypatch.setattr(wordpiece, "BLOCK", 10)
    monkeypatch.setattr(wordpiece, "CACHE_WORDS", 5)
    assert [wordpiece.Counter(PATH).text(t) for _, t in sample[:50]] == want
