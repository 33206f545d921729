"""The corpus pipeline against brute force, stage by stage."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from firmlens.llm import langid
from test_duplicates import FOLD, brute_components, near_copies
from test_tokens import check_packed

ROWS = [(1, "Same Text here"), (2, "same text HERE"), (3, None), (4, ""), (5, "12 34 !!"), (6, "x"), (7, "the and of " * 2000), (7, "the and of " * 2000), (None, "no id but words")]


@pytest.fixture(scope="module")
def rows(sample):
    copies = near_copies(random.Random(2), 40)
    return ROWS + [(100 + i, t) for i, t in enumerate(copies)] + [(1000 + i, t) for i, t in sample]


def recognised(rows):
    """Rows whose text resembles the one language that there is more than chance."""
    texts = [t or "" for _, t in rows]
    learned = [t for i, t in rows if t is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2)]
    units = langid.unit(langid.bundles(learned, langid.DIMENSIONS)).astype(float)
    prototype = units.sum(axis=0) / np.linalg.norm(units.sum(axis=0))
    cosines = langid.unit(langid.bundles(texts, langid.DIMENSIONS)) @ prototype
    return [r for r, c in zip(rows, cosines) if c > langid.CHANCE]


def stages(rows):
    """What is left after each stage, as lists of (doc_id, text)."""
    known = recognised(rows)
    best = {}
    for i, t in known:
        key = t.translate(FOLD)
        if key not in best or (i is not None and (best[key][0] is None or i >= best[key][0])):
            best[key] = (i, t)
    distinct = list(best.values())
    names = {r[2] for r in brute_components(distinct)}
    return known, distinct, [(i, t) for i, t in distinct if i is None or i in names]


def shown(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_every_stage(spark, make_docs, rows):
    docs = make_docs([(i, t, "en") for i, t in rows])
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, stages(rows)):
        docs = stage(spark, docs, "").cache()
        assert docs.columns == columns, name
        assert shown(docs) == sorted(want, key=str), name


def test_run(spark, make_docs, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    kept = [(i, t) for i, t in rows if i is not None]
    make_docs([(i, t, "en") for i, t in kept]).write.parquet(f"{folder}/documents.parquet")
    packed = corpus_pipeline.run(spark, folder).collect()
    left = dict(stages(kept)[-1])
    check_packed(packed, left, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 1024)


def test_empty_table(spark, make_docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    make_docs([]).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_extra_columns(spark, make_docs):
    from pyspark.sql import functions as F

    docs = make_docs([(1, "some words here", "en"), (2, "some words here", "en")])
    for clash in ("stay", "dup_key", "fp", "found", "key", "held_out", "component_keep", "part"):
        docs = docs.withColumn(clash, F.lit(1))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
    assert [r.doc_id for r in docs.collect()] == [2]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 1


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None
