"""URL filter against plain rules; language ID by held-out accuracy and a direct computation."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlens.llm import langid, queries, urls

CASES = [
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("no scheme/casino", "", "", None, "allow"),
    ("http://EXAMPLE.Org", "example.org", "", None, "allow"),
    ("http://EXAMPLE.Org/Es/", "example.org", "/Es/", "org/", "allow"),
    ("http://a.example.org/es/x?y", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/19#t", "example.org", "/en/19", "example.org/en/1", "block"),
    ("http://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
    ("http://casino.example.org/", "casino.example.org", "/", "org/", "allow"),
    ("http://casino.example.net/", "casino.example.net", "/", None, "block"),
    ("http://casinos.example.net/", "casinos.example.net", "/", None, "allow"),
    ("http://free.example.net/free", "free.example.net", "/free", None, "allow"),
    ("http://free.example.net/Bets?win", "free.example.net", "/Bets", None, "block"),
    ("http://x.example.net/?bet=free", "x.example.net", "/", None, "allow"),
    ("http://a.com/fr/casino", "a.com", "/fr/casino", "com/fr/", "allow"),
    ("http://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
    ("x://h?q://z/", "h", "", None, "allow"),
    ("http://ä.net/é-porn", "ä.net", "/é-porn", None, "block"),
]


def test_cases(spark):
    rows = [(i, c[0]) for i, c in enumerate(CASES)] + [(3, CASES[3][0]), (99, "http://n.net/" + "a" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("old")).withColumn("judged", F.lit(1))
    got = urls.judge_urls(pages, rules=queries.URL_RULES)
    assert {"page_id", "url", "judged", "rule", "host"} <= set(got.columns)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert [found[i] for i in range(len(CASES))] == [c[1:] for c in CASES]
    assert found[99][3] == "allow" and got.count() == len(rows)
    assert urls.judge_urls(pages.where("false"), rules=queries.URL_RULES).count() == 0


def test_hits_equal_regular_expressions(spark):
    own = urls.Filter(urls.STRICT, urls.SOFT, 2, ())
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect():
        text = "".join(urls.split_url(row.url)).lower()
        whole = lambda t: re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", text)  # noqa: B023, E731
        assert own.hits(text) == (sorted(filter(whole, urls.STRICT)), sorted(filter(whole, urls.SOFT)))


@pytest.mark.parametrize(
    "url",
    [
        "https://x.com/deals", "https://shop.example.com/free/track", "https://farm.example.com/track", "https://x.com/farm", "https://shop.example.net/hot/deals",
        "https://bank.example.net/loans/free", "https://example.net/cheap/click-and-collect", "https://a.example.net/win/prize", "https://run.example.net/track/bonus",
        "https://cars.example.net/ford/escort", "https://mail.example.net/help/spam", "https://safety.example.net/phishing/malware",
    ],
)
def test_clean_hosts_are_allowed(url):
    assert urls.Filter(urls.STRICT, urls.SOFT, urls.SOFT_HITS, ()).judge(url)[3] == "allow"


def test_empty_vocabulary():
    assert urls.Filter((), (), 1, ()).judge("http://casino.net/")[3] == "allow"


def test_bundle_is_the_sum_of_bound_vectors():
    first, second, third = langid.letter_vectors(64)
    slot = lambda c: int(langid.letter_slots()[ord(c)])
    want = np.zeros(64)
    for word in ("ab", "c"):
        padded = f" {word} "
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            want += first[slot(a)].astype(int) * second[slot(b)] * third[slot(c)]
    assert np.array_equal(langid.bundles(["Ab, 12 c!"], 64)[0], want)
    assert np.array_equal(first[5], np.roll(third[5], 2)) and not langid.bundles([None, "", "12 !"], 64).any()


def test_blocks_do_not_matter(monkeypatch, sample):
    texts = [t for _, t in sample[:60]]
    whole = langid.bundles(texts, 64)
    monkeypatch.setattr(langid, "COLUMN_BLOCK", 37)
    monkeypatch.setattr(langid, "TEXT_BLOCK", 7)
    assert np.array_equal(langid.bundles(texts, 64), whole)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_used(make_docs):
    rows = [(i, "aaa bbb" if i % 2 else "ccc ddd", "xx" if i % 2 else "yy") for i in range(40)]
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    pred = lambda r: sorted((x.doc_id, x.lang_pred) for x in langid.identify(make_docs(r)).collect())
    assert pred(wrong) == pred(rows) and {p for _, p in pred(rows)} == {"xx", "yy"}


@pytest.mark.parametrize("rows", [[], [(1, "some words", None)], [(i, None, "en") for i in range(3)]])
def test_nothing_to_learn(make_docs, rows):
    got = langid.identify(make_docs(rows)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(rows)
    assert langid.keep_recognised(make_docs(rows)).count() == sum(bool(t) for _, t, _ in rows)


def test_keep_by_prediction(spark, sample):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10**6, "漢字仮名交じり文の例である " * 20), (10**6 + 1, "1234 !!"), (10**6 + 2, None)], "doc_id long, text string")
    every = docs.unionByName(extra, allowMissingColumns=True)
    found = {r.doc_id: r for r in langid.identify(every).collect()}
    kept = {r.doc_id for r in langid.keep_recognised(every).collect()}
    assert kept == {i for i, r in found.items() if r.lang_pred != "und" and r.score > langid.CHANCE} and len(kept) >= docs.count() - 1
    some = {r.doc_id for r in langid.keep_recognised(every, languages=["de", "fr"], least=0.5).collect()}
    assert some == {i for i, r in found.items() if r.lang_pred in ("de", "fr") and r.score > 0.5}


def test_prototypes_are_sums_of_unit_vectors(make_docs, sample):
    rows = [(i, t, "xx" if i % 2 else "yy") for i, t in sample[:60]]
    names, got = langid.train(make_docs(rows).withColumn("key", F.col("doc_id")))
    assert names == ["xx", "yy"]
    for n, name in enumerate(names):
        total = langid.unit(langid.bundles([t for _, t, lang in rows if lang == name], langid.DIMENSIONS)).astype(float).sum(axis=0)
        assert np.allclose(got[n], total / np.linalg.norm(total), atol=1e-6)


def test_very_long_text(make_docs, sample):
    rows = [(i, t, "en") for i, t in sample[:40]] + [(999, "the and of that " * 200_000, None)]
    (row,) = langid.identify(make_docs(rows)).where("doc_id = 999").collect()
    assert row.lang_pred == "en" and 0 < row.score <= 1


def test_keep_recognised(make_docs, sample):
    docs = make_docs([(i, t, "en") for i, t in sample] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "1234 !!"), (None, "the and of the", "en"), (1, sample[0][1], "en")]).withColumn("found", F.lit(0))
    got = langid.keep_recognised(docs)
    assert got.columns == docs.columns and got.count() == len(sample) + 2
