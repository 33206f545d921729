"""Registered queries of the text operators (thin: production parameters over whole tables) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm import blocklabel, bpe, exactdup, idshards, langid, multiset, packing, phrases, quotes, resample, simhash, urls, wordpiece
from firmlens.llm.common import LOWER, UPPER, small_batches, table
from firmlens.session import staging_path

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query("op1_quotation_linking")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quotes.reply_order(table(spark, sf_dir, "conversations"))


@query("op2_main_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = blocklabel.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return wordpiece.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BYTE_BPE)).select("doc_id", "n_words", "n_tokens")


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op5_multiset_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.edited_fingerprints(table(spark, sf_dir, "documents"))


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@query(
    "op6_url_filter",
    f"""
    WITH cut AS (
        SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages
    ), parts AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
    ), rules(verdict, host, path) AS (
        VALUES {", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)}
    ), fits AS (
        SELECT p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
        FROM parts p JOIN rules r ON ends_with('.' || p.host, '.' || r.host) AND starts_with(p.path, r.path) GROUP BY p.page_id
    ), words AS (
        SELECT page_id, translate(host || path, '{UPPER}', '{LOWER}') AS s FROM parts
    ), hits AS (
        SELECT page_id, regexp_matches(s, '(^|[^a-z0-9])({"|".join(urls.STRICT)})([^a-z0-9]|$)') AS strict,
               {" + ".join(f"regexp_matches(s, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT" for t in urls.SOFT)} AS soft
        FROM words
    )
    SELECT p.page_id, p.host, p.path, f.rule,
           coalesce(f.verdict, CASE WHEN h.strict OR h.soft >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts p JOIN hits h USING (page_id) LEFT JOIN fits f USING (page_id)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, rules=URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op7_bpe_round_trip")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BYTE_BPE))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query(
    "op9_exact_dedup",
    """
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY norm)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


@query(
    "op11_phrase_mining",
    """
    WITH docs AS (
        SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
               regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]', chr(10), 'g') AS text
        FROM documents
    ), pieces AS (SELECT lang, unnest(string_split(text, chr(10))) AS piece FROM docs
    ), words AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces
    ), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
    ), starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
    ), grams AS (SELECT lang, w, i, unnest([1, 2, 3, 4]) AS size FROM starts
    ), f AS (
        SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS n FROM grams WHERE i + size - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30
    ), cuts AS (
        SELECT lang, phrase, n AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS rest
        FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)
    ), scored AS (
        SELECT c.lang, c.phrase, c.a, c.k, x.n AS l, y.n AS r, (2000000::HUGEINT * c.a // (x.n + y.n))::BIGINT AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
    ), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), inner_parts AS (
        SELECT lang, n, array_to_string(string_split(phrase, ' ')[i : i + k - 1], ' ') AS phrase
        FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM f WHERE size > 2))
    ), longer AS (SELECT lang, phrase, max(n) AS f FROM inner_parts GROUP BY ALL
    ), kept AS (SELECT b.* FROM best b LEFT JOIN longer g USING (lang, phrase) WHERE g.f IS NULL OR 100::HUGEINT * g.f < 80::HUGEINT * b.a
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, longest=4, top=2000, covered_percent=80)


@query("op12_id_shards")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = staging_path(spark, "ids")
    idshards.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path(WORD_BPE), end=1)
    return idshards.read_back(spark, path)


@query("op13_importance_resampling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, min_words=20, seed=2024)
