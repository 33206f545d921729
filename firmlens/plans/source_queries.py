"""Source and sink queries (A1-A13): write data derived from the tables, read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.operators.performance import constant_reporters
from firmlens.plans import standins as S
from firmlens.plans.panel_queries import STEADY
from firmlens.plans.registry import query
from firmlens.session import staging_path
from firmlens.sources import files as R
from firmlens.sources import sinks as W

PART_SCHEMA = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def staged_csv(spark, d, table, sep=",", columns=None):
    path = staging_path(spark, table)
    df = S.read(spark, d, table)
    W.write_csv(df.select(*columns) if columns else df, path, sep)
    return path


@query("a01_csv_scan", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _(spark, d):
    return R.read_csv(spark, staged_csv(spark, d, "part"), PART_SCHEMA).select("p_partkey", "p_name", "p_retailprice")


@query("a02_csv_semicolon", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, d):
    schema = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"
    return R.read_csv(spark, staged_csv(spark, d, "supplier", ";"), schema, ";").select("s_suppkey", "s_name", "s_acctbal")


@query("a03_csv_separator_fallback", "SELECT p_partkey AS id, p_name AS label, 2 AS copies FROM part")
def _(spark, d):
    path = staging_path(spark, "meta")
    part = S.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    W.write_csv(part, path + "/a", ",")
    W.write_csv(part, path + "/b", ";")
    both = [R.read_csv_any(spark, f"{path}/{x}", "id long, label string") for x in "ab"]
    return both[0].unionByName(both[1]).groupBy("id", "label").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@query("a04_column_subset", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(spark, d):
    drop = {"l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"}
    return R.read_columns(S.read(spark, d, "lineitem"), lambda c: c not in drop)


@query("a05_yearly_files", "SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE year(o_orderdate) < 2001")
def _(spark, d):
    folder = staging_path(spark, "ratings")
    orders = S.read(spark, d, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    label = F.when(F.col("year") <= 1996, "1995 to 1996").otherwise(F.col("year").cast("string"))
    orders.withColumn("file", label).write.partitionBy("file").options(header=True, sep=";").csv(folder)
    paths = R.yearly_paths(folder, 1995, 2001, (1995, 1996), lambda x: f"file={x}")
    return R.read_csv(spark, paths, "o_orderkey long, o_totalprice double, year int", ";")


@query(
    "a06_two_source_union",
    "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS priority FROM orders",
)
def _(spark, d):
    orders = S.read(spark, d, "orders")
    original = orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("priority"))
    restated = orders.where("o_orderstatus <> 'F'").select("o_totalprice", "o_orderkey")
    return R.union_sources(original, restated)


@query("a07_tolerant_parquet", "SELECT c_custkey, c_acctbal FROM customer")
def _(spark, d):
    path = staging_path(spark, "raw")
    customer = S.read(spark, d, "customer")
    customer.select("c_custkey", "c_acctbal").write.parquet(path + "/good")
    customer.select("c_name").write.text(path + "/broken")
    return R.read_results(spark, [path + "/good", path + "/broken"], "c_custkey long, c_acctbal double")


@query("a08_gzip_parquet", f"WITH {S.FACTS} SELECT firm, year, indicator, value_final FROM facts")
def _(spark, d):
    path = staging_path(spark, "facts")
    W.write_results(S.facts(spark, d).drop("model_output"), path)
    return spark.read.parquet(path).select("firm", "year", "indicator", "value_final")


def nested_results(spark, d):
    return S.facts(spark, d).select(
        F.concat_ws("_", "firm", "year").alias("company_year"),
        F.col("indicator").alias("data_point_id"),
        F.struct(F.col("value_final").cast("string").alias("value"), F.lit("kg").alias("unit")).alias("model_output"),
        F.col("value_final").alias("value"),
        F.array(F.col("firm").cast("string"), F.lit("x")).alias("retrieved_context"),
        F.array(F.array("year", "indicator")).alias("page_numbers"),
    )


@query(
    "a09_csv_results",
    f"""WITH {S.FACTS} SELECT firm || '_' || year AS company_year, indicator AS data_point_id, value_final AS value,
  '{{' || CASE WHEN value_final IS NOT NULL THEN '"value":"' || value_final || '",' ELSE '' END || '"unit":"kg"}}' AS model_output, '[[' || year || ',' || indicator || ']]' AS page_numbers FROM facts""",
)
def _(spark, d):
    path = staging_path(spark, "results")
    results = nested_results(spark, d)
    W.write_csv(results, path + "/complete")
    W.write_numerical(results, path + "/numerical")
    full = R.read_csv(
        spark, path + "/complete", "company_year string, data_point_id int, model_output string, value double, retrieved_context string, page_numbers string"
    ).select("company_year", "data_point_id", "model_output", "page_numbers")
    small = R.read_csv(spark, path + "/numerical", "company_year string, data_point_id int, value double")
    return small.join(full, ["company_year", "data_point_id"])


@query(
    "a10_nested_json",
    "SELECT text, 'file' || doc_id AS source_document, 1 AS page_number, CAST(length(text) AS INT) AS text_length FROM documents",
)
def _(spark, d):
    path = staging_path(spark, "documents")
    page = F.struct(F.concat(F.lit("file"), "doc_id").alias("source_document"), F.lit(1).alias("page_number"), F.length("text").alias("text_length"))
    W.write_documents(S.read(spark, d, "documents").select("text", F.array(page).alias("metadata")), path)
    return R.read_documents(spark, path).select("text", F.inline("metadata"))


@query(
    "a11_text_key_fallback",
    """SELECT lang, CASE lang WHEN 'es' THEN 'txt' ELSE 'json' END AS kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY ALL""",
)
def _(spark, d):
    """One folder per language: three JSON text keys, and Spanish as single .txt files beside the German ones that have a JSON file."""
    path = staging_path(spark, "texts")
    docs = S.read(spark, d, "documents")
    for lang, key in (("en", "text"), ("fr", "full_text"), ("de", "content")):
        docs.where(F.col("lang") == lang).select(F.col("text").alias(key)).write.json(f"{path}/{lang}")
    # a .txt file is one text; these hold several, each closed by a mark that no text has
    docs.where("lang = 'es'").select("text").write.option("lineSep", "\u241e").text(f"{path}/es")
    json = [R.read_texts(spark, f"{path}/{x}").select(F.lit(x).alias("lang"), F.lit("json").alias("kind"), "text") for x in ("en", "fr", "de")]
    txt = R.read_texts(spark, f"{path}/de", f"{path}/es").where(F.lower("file_name").endswith(".txt"))
    txt = txt.select(F.lit("es").alias("lang"), F.lit("txt").alias("kind"), F.explode(F.split("text", "\u241e")).alias("text")).where("text <> ''")
    return R.union_sources(*json, txt).groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("a12_company_json", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS sector, c_mktsegment || '|' || c_nationkey AS indices FROM customer")
def _(spark, d):
    path = staging_path(spark, "companies")
    S.read(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("sector"),
        F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("indices"),
    ).write.json(path)
    return R.read_companies(spark, path).select("id", "name", "sector", F.array_join("indices", "|").alias("indices"))


@query(
    "a13_grouped_list_json",
    f"""WITH {S.FACTS}, c AS (SELECT indicator, firm FROM facts WHERE value_final IS NOT NULL AND year IN {tuple(STEADY)} GROUP BY ALL HAVING count(DISTINCT year) = {len(STEADY)})
  SELECT indicator, firm FROM c""",
)
def _(spark, d):
    path = staging_path(spark, "constant")
    W.write_grouped_list(constant_reporters(S.facts(spark, d), STEADY), path, "indicator", "firm", "firm")
    return spark.read.schema("indicator int, firm long").json(path)
