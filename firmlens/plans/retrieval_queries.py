"""Retrieval and extraction queries.

All vectors and all texts are ranked; ten documents hold them by id modulo ten. The ten
label centroids are the query vectors, the benchmark texts the query texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.operators import extraction as E
from firmlens.operators import retrieval as R
from firmlens.operators.coverage import has_value_text
from firmlens.operators.harmonise import harmonise
from firmlens.plans import standins as S
from firmlens.plans.document_queries import CHUNK_SQL, chunks as doc_chunks
from firmlens.plans.panel_queries import rounded
from firmlens.plans.registry import query
from firmlens.session import cut_lineage


def vectors(spark, d):
    return S.read(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("doc"), F.col("vec_id").alias("chunk"), F.col("embedding").alias("vector"))


def texts(spark, d):
    return S.read_spread(spark, d, "documents").select((F.col("doc_id") % 10).alias("doc"), F.col("doc_id").alias("chunk"), "text")


def centroids(spark, d):
    cells = S.read(spark, d, "embeddings").select(F.col("label").alias("query_id"), F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("query_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x")))["x"].alias("vector"))


def requests(spark, d):
    return S.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


CORPUS = "corpus AS (SELECT doc_id % 10 AS doc, doc_id AS chunk, text FROM documents)"
VTOP_SQL = """vscore AS (SELECT doc, query_id, chunk, list_cosine_similarity(CAST(vector AS DOUBLE[]), v) AS score FROM vecs CROSS JOIN cent),
  vtop AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc, query_id ORDER BY round(score, 9) DESC, chunk) AS INT) AS rank FROM vscore) WHERE rank <= 30)"""
VECTOR_SQL = f"""vecs AS (SELECT vec_id % 10 AS doc, vec_id AS chunk, embedding AS vector FROM embeddings), cells AS (SELECT label AS query_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL),
  cent AS (SELECT query_id, list(x ORDER BY i) AS v FROM cells GROUP BY ALL),
  {VTOP_SQL}"""


def bm25_sql(corpus, queries):
    return f"""tk AS (SELECT doc, chunk, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM {corpus}),
  lens AS (SELECT doc, chunk, len(t) AS n FROM tk), corp AS (SELECT doc, count(*) AS n_doc, avg(n) AS ml FROM lens GROUP BY ALL),
  tf AS (SELECT doc, chunk, term, count(*) AS tf FROM (SELECT doc, chunk, unnest(t) AS term FROM tk) GROUP BY ALL),
  dfs AS (SELECT doc, term, count(*) AS df FROM tf GROUP BY ALL),
  qt AS (SELECT query_id, term, count(*) AS q FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS term FROM {queries}) GROUP BY ALL),
  kscore AS (SELECT doc, query_id, chunk, sum(q * ln(1 + (n_doc - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / ml))) AS score
    FROM tf JOIN dfs USING (doc, term) JOIN corp USING (doc) JOIN lens USING (doc, chunk) JOIN qt USING (term) GROUP BY ALL),
  ktop AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc, query_id ORDER BY round(score, 9) DESC, chunk) AS INT) AS rank FROM kscore) WHERE rank <= 30)"""


QUERIES_SQL = "reqs AS (SELECT item_id AS query_id, text FROM benchmark)"


HASH_SQL = "list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''), lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64)"


@query(
    "c01_chunk_vectors",
    f"""WITH {CHUNK_SQL}, slots AS (SELECT doc_id, sequence_number, {HASH_SQL} AS h FROM chunks),
  counted AS (SELECT doc_id, sequence_number, list_transform(range(64), lambda i: len(list_filter(h, lambda x: x = i))) AS c FROM slots),
  normed AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM counted)
  SELECT doc_id, sequence_number, array_to_string(c, ',') AS counts, round(coalesce(list_sum(list_transform(c, lambda x: x * x / n / n)), 0), 6) AS norm,
    round(CASE WHEN n > 0 THEN c[1] / n ELSE 0 END, 6) AS first FROM normed""",
)
def _(spark, d):
    out = R.hashed_vectors(doc_chunks(spark, d), "text", 64, counts="counts")
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    counts = F.array_join(F.col("counts").cast("array<string>"), ",")
    return out.select("doc_id", "sequence_number", counts.alias("counts"), F.round(squares, 6).alias("norm"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


@query("c02_vector_top_k", f"WITH {VECTOR_SQL} SELECT doc, query_id, chunk, rank, round(score, 6) AS score FROM vtop")
def _(spark, d):
    return rounded(R.vector_top_k(vectors(spark, d), centroids(spark, d)).select("doc", "query_id", "chunk", "rank", "score"), "score")


@query("c03_keyword_top_k", f"WITH {CORPUS}, {QUERIES_SQL}, {bm25_sql('corpus', 'reqs')} SELECT doc, query_id, chunk, rank, round(score, 6) AS score FROM ktop")
def _(spark, d):
    return rounded(R.keyword_top_k(texts(spark, d), requests(spark, d)).select("doc", "query_id", "chunk", "rank", "score"), "score")


FUSE_SQL = """fused0 AS (SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk, b.chunk) AS chunk, a.rank AS rank_1, b.rank AS rank_2,
    coalesce(0.5::DOUBLE / (60 + a.rank), 0) + coalesce(0.5::DOUBLE / (60 + b.rank), 0) AS score FROM vtop a FULL JOIN ktop b ON a.doc = b.doc AND a.query_id = b.query_id AND a.chunk = b.chunk),
  fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc, query_id ORDER BY round(score, 12) DESC, chunk) AS INT) AS rank FROM fused0)"""
FUSED_SQL = f"{VECTOR_SQL}, {CORPUS}, {QUERIES_SQL}, {bm25_sql('corpus', 'reqs')}, {FUSE_SQL}"
RERANK_SQL = """cand AS (SELECT k.doc, k.query_id, k.chunk, c.text, r.text AS qt FROM fused k JOIN corpus c USING (doc, chunk) JOIN reqs r USING (query_id)),
  sc AS (SELECT doc, query_id, chunk, len(list_intersect(qd, td)) / len(qd) AS score FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(qt), '\\s+'), lambda x: x <> '')) AS qd,
    list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS td FROM cand)),
  reranked AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc, query_id ORDER BY round(score, 9) DESC, chunk) AS INT) AS rank FROM sc) WHERE rank <= 10)"""


def fused(spark, d):
    return R.fuse_ranks(R.vector_top_k(vectors(spark, d), centroids(spark, d)), R.keyword_top_k(texts(spark, d), requests(spark, d)))


@query("c04_rank_fusion", f"WITH {FUSED_SQL} SELECT doc, query_id, chunk, rank_1, rank_2, round(score, 8) AS score, rank FROM fused")
def _(spark, d):
    return rounded(fused(spark, d).select("doc", "query_id", "chunk", "rank_1", "rank_2", "score", "rank"), "score", digits=8)


@query(
    "c05_rerank",
    f"WITH {FUSED_SQL}, {RERANK_SQL} SELECT doc, query_id, chunk, rank, round(score, 6) AS score FROM reranked",
)
def _(spark, d):
    asked = requests(spark, d).withColumnRenamed("text", "query_text")
    pairs = fused(spark, d).drop("score").join(texts(spark, d), ["doc", "chunk"]).join(asked, "query_id")
    return rounded(R.rerank(pairs).select("doc", "query_id", "chunk", "rank", "score"), "score")


TARGET_SQL = f"""{CHUNK_SQL}, scored AS (SELECT doc_id AS doc, sequence_number AS chunk, length(text) - length(replace(text, 'e', '')) AS score FROM chunks),
  targets AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY round(score, 9) DESC, chunk) AS INT) AS rank FROM scored) WHERE rank <= 3)"""


def targets(spark, d):
    c = doc_chunks(spark, d).select(F.col("doc_id").alias("doc"), F.col("sequence_number").alias("chunk"), "text")
    score = F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))
    return c, R.top_k(c.select("doc", F.lit(1).alias("query_id"), "chunk", score.alias("score")), 3)


@query(
    "c06_neighbour_window",
    f"""WITH {TARGET_SQL} SELECT t.doc, t.chunk AS target, t.rank, md5(string_agg(c.text, ' ' ORDER BY c.sequence_number)) AS digest
  FROM targets t JOIN chunks c ON c.doc_id = t.doc AND c.sequence_number BETWEEN t.chunk - 1 AND t.chunk + 1 GROUP BY ALL""",
)
def _(spark, d):
    c, t = targets(spark, d)
    return R.with_neighbours(t, c).select("doc", "target", "rank", F.md5("text").alias("digest"))


@query("c07_work_list", "SELECT doc_id, item_id FROM documents CROSS JOIN benchmark")
def _(spark, d):
    return R.work_list(S.read(spark, d, "documents").select("doc_id"), S.read(spark, d, "benchmark").select("item_id"))


@query("c08_indicator_request", "SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN p_size <= 25 THEN p_type END) AS request FROM part")
def _(spark, d):
    spec = F.when(F.col("p_size") <= 25, F.col("p_type"))
    return S.read(spark, d, "part").select("p_partkey", R.indicator_request(F.col("p_name"), spec).alias("request"))


def contexts(spark, d):
    """Per document: its ten best chunks in rank order; some chunks carry no page."""
    c, _ = targets(spark, d)
    starts = doc_chunks(spark, d).select(F.col("doc_id").alias("doc"), F.col("sequence_number").alias("chunk"), "start_index")
    score = F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))
    best = R.top_k(c.select("doc", F.lit(1).alias("query_id"), "chunk", score.alias("score")), R.KEPT)
    page = lambda at: F.floor(at / 1500).cast("int") + 1
    numbers = F.sequence(page(F.col("start_index")), page(F.col("start_index") + F.length("text")))
    info = F.transform(numbers, lambda p: F.struct(F.lit("report.pdf").alias("source_document"), p.alias("page_number")))
    some = F.when(F.col("chunk") % 5 != 4, info).otherwise(F.array().cast("array<struct<source_document:string,page_number:int>>"))
    chunk = F.struct("rank", "text", some.alias("source_info"))
    rows = best.select("doc", "chunk", "rank").join(c, ["doc", "chunk"]).join(starts, ["doc", "chunk"])
    return rows.groupBy("doc").agg(F.array_sort(F.collect_list(chunk)).alias("context"))


CONTEXT_SQL = f"""{CHUNK_SQL}, scored AS (SELECT *, length(text) - length(replace(text, 'e', '')) AS score FROM chunks),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sequence_number) AS rank FROM scored) WHERE rank <= 10),
  ctx AS (SELECT doc_id AS doc, arg_min(sequence_number % 5 <> 4, rank) AS first_has, list(text ORDER BY rank) AS l, string_agg('[' || CASE WHEN sequence_number % 5 = 4 THEN '' ELSE
    array_to_string(range(start_index // 1500 + 1, (start_index + length(text)) // 1500 + 2), ',') END || ']', ';' ORDER BY rank) AS pages FROM best GROUP BY ALL),
  blocks AS (SELECT *, replace(replace(array_to_string(list_transform(range(1, len(l) + 1), lambda i: 'Chunk ' || i || ':' || chr(10) || l[i]), chr(10) || chr(10)), '{{', '{{{{'), '}}', '}}}}') AS context FROM ctx)"""


@query(
    "c09_context_parts",
    f"WITH {CONTEXT_SQL} SELECT doc, md5(array_to_string(l, '|')) AS texts, CASE WHEN first_has THEN 'report.pdf' ELSE 'Unknown' END AS source_document, pages AS page_numbers FROM ctx",
)
def _(spark, d):
    parts = contexts(spark, d).withColumns(R.context_columns(F.col("context")))
    pages = F.transform("page_numbers", lambda p: F.concat(F.lit("["), F.array_join(p.cast("array<string>"), ","), F.lit("]")))
    return parts.select("doc", F.md5(F.array_join("texts", "|")).alias("texts"), "source_document", F.array_join(pages, ";").alias("page_numbers"))


def prompts(spark, d):
    c = contexts(spark, d).withColumn("text", R.context_text(F.transform("context", lambda x: x["text"])))
    names = S.read(spark, d, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_name").alias("company"))
    joined = c.join(names, "doc", "left").withColumn("company", F.coalesce("company", F.lit("?")))
    return joined.select("doc", R.prompt_text(F.col("company"), F.lit(2023), F.col("text"), F.lit("Water consumption")).alias("prompt"))


PROMPT_SQL = f"""{CONTEXT_SQL}, prompts AS (SELECT doc, 'Find one figure for ' || coalesce(c_name, '?') || ' in 2023.' || chr(10) || 'Figure: Water consumption' || chr(10) || 'Sources:' || chr(10) || context || chr(10) || 'Reply as JSON with value and unit.' AS prompt
  FROM blocks LEFT JOIN customer ON c_custkey = doc)"""


@query("c10_prompt_text", f"WITH {PROMPT_SQL} SELECT doc, md5(prompt) AS digest FROM prompts")
def _(spark, d):
    return prompts(spark, d).select("doc", F.md5("prompt").alias("digest"))


@query("c11_prompt_size", f"WITH {PROMPT_SQL} SELECT doc, CAST(len(list_filter(regexp_split_to_array(prompt, '\\s+'), lambda x: x <> '')) AS INT) AS n_tokens FROM prompts")
def _(spark, d):
    return prompts(spark, d).select("doc", R.prompt_size(F.col("prompt")).alias("n_tokens"))


@query(
    "c12_built_in_extractor",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS VARCHAR) AS value, CASE WHEN l_returnflag = 'A' THEN 'kg' ELSE 'tCO2e' END AS unit FROM lineitem""",
)
def _(spark, d):
    unit = F.when(F.col("l_returnflag") == "A", "kg").otherwise("tCO2e")
    text = F.concat(F.lit("The company used "), F.col("l_quantity").cast("string"), F.lit(" "), unit, F.lit(" in its plants."))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    answered = E.run_extractor(S.read(spark, d, "lineitem").select(*keys, text.alias("prompt")), "prompt")
    return answered.withColumn("a", E.strict_answer(F.col("raw_output"))).select(*keys, "a.value", "a.unit")


# --- answers ---------------------------------------------------------------

RAW_SQL = """raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber
  WHEN 1 THEN '{"value": ' || l_extendedprice || ', "unit": "kg"}'
  WHEN 2 THEN '{"value": 12,' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || ', "unit": "MWh"}'
  WHEN 3 THEN '{"value": 1, "unit": "kg", "note": "x"}' WHEN 4 THEN '{"value": ' || l_quantity || '}'
  WHEN 5 THEN '{''value'': ' || l_quantity || ', ''unit'': None}' WHEN 6 THEN 'No data {'
  ELSE CASE WHEN l_returnflag = 'A' THEN '{"value": null, "unit": null}' WHEN l_returnflag = 'N' THEN '{"value": " ", "unit": "t"}' END END AS raw_output FROM lineitem),
  cleaned AS (SELECT *, regexp_replace(regexp_replace(raw_output, '(\\d),(\\d)', '\\1\\2', 'g'), '(\\d),(\\d)', '\\1\\2', 'g') AS c FROM raw),
  strict AS (SELECT *, coalesce(json_valid(c) AND list_sort(json_keys(CASE WHEN json_valid(c) THEN c END)) = ['unit', 'value'], false) AS ok FROM cleaned)"""
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYSQL = ", ".join(KEYS)


def raw_answers(spark, d):
    line, c = F.col("l_linenumber"), F.concat
    quantity = F.col("l_quantity").cast("string")
    text = (
        F.when(line == 1, c(F.lit('{"value": '), F.col("l_extendedprice").cast("string"), F.lit(', "unit": "kg"}')))
        .when(line == 2, c(F.lit('{"value": 12,'), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.lit(', "unit": "MWh"}')))
        .when(line == 3, '{"value": 1, "unit": "kg", "note": "x"}')
        .when(line == 4, c(F.lit('{"value": '), quantity, F.lit("}")))
        .when(line == 5, c(F.lit("{'value': "), quantity, F.lit(", 'unit': None}")))
        .when(line == 6, "No data {")
        .when(F.col("l_returnflag") == "A", '{"value": null, "unit": null}')
        .when(F.col("l_returnflag") == "N", '{"value": " ", "unit": "t"}')
    )
    return S.read_spread(spark, d, "lineitem").select(*KEYS, "l_returnflag", "l_extendedprice", text.alias("raw_output"))


@query("c14_thousands_commas", f"WITH {RAW_SQL} SELECT {KEYSQL}, c AS cleaned FROM cleaned")
def _(spark, d):
    return raw_answers(spark, d).select(*KEYS, E.without_thousands(F.col("raw_output")).alias("cleaned"))


@query("c15_strict_answers", f"WITH {RAW_SQL} SELECT {KEYSQL}, ok AS valid, CASE WHEN ok THEN c ->> '$.value' END AS value, CASE WHEN ok THEN c ->> '$.unit' END AS unit FROM strict")
def _(spark, d):
    a = raw_answers(spark, d).withColumn("a", E.strict_answer(E.without_thousands(F.col("raw_output"))))
    return a.select(*KEYS, F.col("a").isNotNull().alias("valid"), "a.value", "a.unit")


@query(
    "c16_result_records",
    f"""WITH {RAW_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS company_id, l_partkey AS year, l_orderkey || '_' || l_partkey AS company_year, CAST(l_linenumber AS VARCHAR) AS data_point_id,
  ok AS model_output_valid, CASE WHEN ok THEN c ->> '$.value' END AS value, CASE WHEN ok THEN c ->> '$.unit' END AS unit, CAST(NULL AS DOUBLE) AS extraction_time FROM strict""",
)
def _(spark, d):
    work = raw_answers(spark, d).select(
        F.col("l_orderkey").alias("company_id"),
        F.col("l_partkey").alias("year"),
        F.concat_ws("_", "l_orderkey", "l_partkey").alias("company_year"),
        F.col("l_linenumber").alias("data_point_id"),
        "raw_output",
    )
    return E.result_records(work).select(
        "company_id", F.col("year").cast("long").alias("year"), "company_year", "data_point_id", "model_output_valid", "value", "unit", "extraction_time"
    )


SLOTS = 64
END_TO_END_SQL = f"""{CHUNK_SQL}, {QUERIES_SQL}, corpus AS (SELECT doc_id AS doc, sequence_number AS chunk, text, start_index FROM chunks),
  vecs AS (SELECT doc, chunk, list_transform(range({SLOTS}), lambda i: len(list_filter(h, lambda x: x = i))) AS vector FROM (SELECT doc, chunk, {HASH_SQL} AS h FROM corpus)),
  cent AS (SELECT query_id, CAST(list_transform(range({SLOTS}), lambda i: len(list_filter(h, lambda x: x = i))) AS DOUBLE[]) AS v FROM (SELECT query_id, {HASH_SQL} AS h FROM reqs)),
  {VTOP_SQL}, {bm25_sql('corpus', 'reqs')}, {FUSE_SQL}, {RERANK_SQL},
  windows AS (SELECT t.doc, t.query_id, t.rank, string_agg(c.text, ' ' ORDER BY c.chunk) AS text FROM reranked t JOIN corpus c ON c.doc = t.doc AND c.chunk BETWEEN t.chunk - 1 AND t.chunk + 1 GROUP BY ALL),
  pages_of AS (SELECT t.doc, t.query_id, string_agg('[' || array_to_string(range(start_index // 1500 + 1, (start_index + length(text)) // 1500 + 2), ',') || ']', ';' ORDER BY rank) AS page_numbers
    FROM reranked t JOIN corpus USING (doc, chunk) GROUP BY ALL),
  ctx AS (SELECT doc, query_id, list(text ORDER BY rank) AS l FROM windows GROUP BY ALL),
  texts AS (SELECT *, replace(replace(array_to_string(list_transform(range(1, len(l) + 1), lambda i: 'Chunk ' || i || ':' || chr(10) || l[i]), chr(10) || chr(10)), '{{', '{{{{'), '}}', '}}}}') AS context FROM ctx),
  asked AS (SELECT t.*, 'Find one figure for doc' || doc || ' in 2023.' || chr(10) || 'Figure: ' || r.text || chr(10) || 'Sources:' || chr(10) || context || chr(10) || 'Reply as JSON with value and unit.' AS prompt
    FROM texts t JOIN reqs r USING (query_id)),
  answered AS (SELECT *, regexp_replace(regexp_replace(nullif(regexp_extract(context, '(-?\\d[\\d.,]*)\\s*([%€$£]|[^\\W\\d_][\\w²³₂/]*)', 1), ''), '(\\d),(\\d)', '\\1\\2', 'g'), '(\\d),(\\d)', '\\1\\2', 'g') AS value,
    nullif(regexp_extract(context, '(-?\\d[\\d.,]*)\\s*([%€$£]|[^\\W\\d_][\\w²³₂/]*)', 2), '') AS unit FROM asked)"""


def large_contexts(chunks, asked, measures):
    """Contexts of documents too large for a pack, ranked row by row."""
    ranked = R.fuse_ranks(R.vector_top_k(chunks.select("doc", "chunk", "vector"), asked), R.keyword_top_k(chunks.select("doc", "chunk", "text"), asked))
    # pairs of chunk and request carry distinct terms, not texts, and those only up to the score
    chunk_terms = chunks.select("doc", "chunk", "source_info", R.distinct_terms(F.col("text")).alias("text"))
    pairs = ranked.drop("score").join(chunk_terms, ["doc", "chunk"]).join(asked.select("query_id", R.distinct_terms(F.col("text")).alias("query_text")), "query_id")
    best = R.rerank(pairs, scorer=R.shared_terms).select("doc", "query_id", "chunk", "rank", "source_info")
    context = R.with_neighbours(best, chunks, listed=True, measures=measures)
    fields = ("target", "source_info", "text", *measures)
    return context.select("doc", F.array("query_id").alias("query_ids"), F.transform("context", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("context"))


@query(
    "c16_end_to_end",
    f"""WITH {END_TO_END_SQL} SELECT CAST(doc AS VARCHAR) AS company_id, CAST(query_id AS VARCHAR) AS data_point_id, len(l) AS n_context, md5(array_to_string(l, '|')) AS context, 'file' || doc || '.pdf' AS source_document, page_numbers,
  CAST(len(list_filter(regexp_split_to_array(prompt, '\\s+'), lambda x: x <> '')) AS INT) AS num_tokens, true AS model_output_valid, value, unit,
  CASE WHEN regexp_matches(value, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN CAST(value AS DOUBLE) END AS value_num
  FROM answered JOIN pages_of USING (doc, query_id)""",
)
def _(spark, d):
    """Documents to harmonised figures: chunks, both rankings fused, rerank, windows, context, prompt, answer, record, number."""
    page = lambda at: F.floor(at / 1500).cast("int") + 1
    numbers = F.sequence(page(F.col("start_index")), page(F.col("start_index") + F.length("text")))
    info = F.transform(numbers, lambda p: F.struct(F.concat(F.lit("file"), F.col("doc_id"), F.lit(".pdf")).alias("source_document"), p.alias("page_number")))
    chunks = doc_chunks(spark, d).select(F.col("doc_id").alias("doc"), F.col("sequence_number").alias("chunk"), "text", info.alias("source_info"))
    # counts have the cosine of their vectors of length 1 and are smaller
    counted = lambda df: R.hashed_vectors(df, "text", SLOTS, out="unit_vector", counts="vector").drop("unit_vector")
    asked = cut_lineage(counted(requests(spark, d)))
    # what is taken of a window's text is taken once, not for every request
    block, inner = lambda text: R.context_text(F.array(text)), lambda text: R.context_text(F.array(text, F.lit("")))
    measures = {"n_tokens": lambda text: R.prompt_size(block(text)), "answers": lambda text: E.block_answers(inner(text), block(text))}
    packs, large = R.in_packs(counted(chunks), asked)
    best = R.rerank(R.fuse_ranks(R.vector_top_k(packs), R.keyword_top_k(packs)))
    context = R.with_neighbours(best, listed=True, measures=measures)
    if large is not None:
        context = context.unionByName(large_contexts(cut_lineage(large), asked, measures))
    # white space stands around every block and the request of a prompt, so its terms are theirs and those of the prompt without them
    text_tokens = F.aggregate("context", F.lit(0), lambda a, x: a + x["n_tokens"])
    work = context.withColumns(R.context_columns(F.col("context")) | {"text_tokens": text_tokens, "answers": F.col("context.answers")}).drop("context")
    frame = R.prompt_text(F.concat(F.lit("doc"), F.col("doc")), F.lit(2023), F.lit(""), F.lit(""))
    # the built-in extractor reads the sources only; a model would read the prompt with the request
    answered = E.run_extractor(work.withColumn("context", R.context_text(F.col("texts"))), "context", answers=F.col("answers"))
    # requests that share a context share its record
    records = E.result_records(
        answered.select(
            "query_ids", F.col("doc").cast("string").alias("company_id"), F.lit(2023).alias("year"), F.concat(F.col("doc"), F.lit("_2023")).alias("company_year"),
            "raw_output", F.col("texts").alias("retrieved_context"), F.array("source_document").alias("source_documents"), "page_numbers", (R.prompt_size(frame) + F.col("text_tokens")).alias("num_tokens"),
        ), keep=["query_ids"],
    )
    shown = F.transform("page_numbers", lambda p: F.concat(F.lit("["), F.array_join(p.cast("array<string>"), ","), F.lit("]")))
    # harmonise reads its rows twice: texts are made and digested once
    made = cut_lineage(
        records.select(
            "query_ids", "company_id", "year", "model_output_valid", "value", "unit",
            F.size("retrieved_context").alias("n_context"), F.md5(F.array_join("retrieved_context", "|")).alias("context"), F.get("source_documents", F.lit(0)).alias("source_document"), F.array_join(shown, ";").alias("page_numbers"), "num_tokens",
        )
    )
    request_tokens = asked.select("query_id", R.prompt_size(F.col("text")).alias("request_tokens"))
    each = made.withColumn("query_id", F.explode("query_ids")).drop("query_ids").join(request_tokens, "query_id").withColumn("data_point_id", F.col("query_id").cast("string"))
    answers = each.select(
        "company_id", "year", "data_point_id", F.col("data_point_id").alias("indicator"), "model_output_valid", F.col("model_output_valid").alias("valid"), "value", F.col("value").alias("raw_value"), "unit", F.col("unit").alias("raw_unit"),
        "n_context", "context", "source_document", "page_numbers", (F.col("num_tokens") + F.col("request_tokens")).alias("num_tokens"),
    )
    types = requests(spark, d).select(F.col("query_id").cast("string").alias("indicator"), F.lit("decimal").alias("type_standard"))
    numbers = harmonise(answers, types, None, texts=made.select("unit"))
    return numbers.select(
        "company_id", "data_point_id", "n_context", "context", "source_document", "page_numbers", "num_tokens", "model_output_valid", F.col("raw_value").alias("value"), F.col("raw_unit").alias("unit"), "value_num"
    )


@query(
    "c17_resume",
    f"""WITH {S.ROWS}, prev AS (SELECT DISTINCT firm, year, indicator FROM rows_ WHERE l_returnflag <> 'N'), docs AS (SELECT DISTINCT firm, year FROM rows_)
  SELECT firm, year, CAST(indicator AS INT) AS indicator FROM docs CROSS JOIN range(1, 8) t(indicator) WHERE (firm, year, indicator) NOT IN (SELECT firm, year, indicator FROM prev)""",
)
def _(spark, d):
    rows = S.rows(spark, d)
    work = R.work_list(rows.select("firm", "year").distinct(), S.metadata(spark).select("indicator"))
    previous = rows.withColumn("model_output_valid", F.col("l_returnflag") != "N")
    return E.still_to_do(work, previous, ["firm", "year", "indicator"])


@query(
    "c18_merged_attempts",
    """SELECT l_orderkey, l_linenumber, l_partkey AS attempt, l_suppkey AS supplier, l_extendedprice AS price, l_returnflag <> 'N' AS model_output_valid
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag = 'N', l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1""",
)
def _(spark, d):
    attempts = raw_answers(spark, d).select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("attempt"), F.col("l_suppkey").alias("supplier"),
        F.col("l_extendedprice").alias("price"), (F.col("l_returnflag") != "N").alias("model_output_valid"),
    )
    return E.merged_attempts(attempts, ["l_orderkey", "l_linenumber"], ["attempt", "supplier", "price"])


STORED_SQL = f"""{RAW_SQL}, stored AS (SELECT *, CASE WHEN json_valid(raw_output) THEN raw_output WHEN raw_output LIKE '{{''%' THEN replace(replace(raw_output, '''', '"'), 'None', 'null') END AS j FROM raw),
  parsed AS (SELECT *, j ->> '$.value' AS value, j ->> '$.unit' AS unit FROM (SELECT * REPLACE (CASE WHEN json_valid(j) THEN j END AS j) FROM stored))"""


@query("c19_stored_answers", f"WITH {STORED_SQL} SELECT {KEYSQL}, j IS NOT NULL AS parsed, value, unit FROM parsed")
def _(spark, d):
    a = raw_answers(spark, d).withColumn("a", E.stored_answer(F.col("raw_output")))
    return a.select(*KEYS, F.col("a").isNotNull().alias("parsed"), "a.value", "a.unit")


@query("c20_has_value", f"WITH {STORED_SQL} SELECT {KEYSQL}, coalesce(trim(value) <> '', false) AS has_value FROM parsed")
def _(spark, d):
    return raw_answers(spark, d).select(*KEYS, E.has_value(E.stored_answer(F.col("raw_output"))).alias("has_value"))


@query(
    "c21_detection_flag",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'N' AND l_linestatus <> 'F' AS detected FROM lineitem",
)
def _(spark, d):
    text = F.when(F.col("l_linestatus") != "F", F.when(F.col("l_returnflag") == "N", "{'value': None, 'unit': None}").otherwise("{'value': 'None', 'unit': None}"))
    return S.read(spark, d, "lineitem").select(*KEYS, has_value_text(text).alias("detected"))
