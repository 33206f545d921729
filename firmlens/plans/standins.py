"""How the driver's tables stand in for the firm panel, on Spark and as SQL text.

Every frame reads whole tables. Small code tables are literals on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions.ratings import TOPIC_LEVELS, TRIPLE_SCALE, rating_codes
from firmlens.operators.scale import local_table, spread
from firmlens.operators.transparency import enrich_facts

# indicator, area, standard, topic, label
META = [
    (1, "env", "E1", "Climate change", "Gross Scope 1 greenhouse gas emissions"),
    (2, "env", "E2", "Pollution", "Gross Scope 3 greenhouse gas emissions: Category 6 Business travel"),
    (3, "env", "E3", "Water", "Water consumption"),
    (4, "soc", "S1", "Own workforce", "Gender pay gap"),
    (5, "soc", "S3", "Communities", "Percentage of employee turnover"),
    (6, "gov", "G0", "General", "Percentage of independent board members"),
    (7, "gov", "G1", "Business conduct", "An unlisted indicator"),
]
PRIORITY_RATING = {"1": "AAA", "2": "A", "3": "BB", "4": "CCC"}  # the fifth priority has no rating
PRICE_INDEX = [(1995, 80.2), (1996, 83.5), (1997, 85.0), (1998, 88.8), (1999, 91.3), (2000, 95.1), (2001, 100.0)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table for costly row-wise work, on all cores even if it is a single file."""
    return spread(read(spark, sf_dir, table))


def metadata(spark: SparkSession) -> DataFrame:
    return local_table(spark, META, "indicator int, topic string, standard string, standard_topic string, label string")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: firm, year, indicator, value (a third is null)."""
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("firm"), F.year("o_orderdate").alias("year")
    )
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_linenumber").alias("indicator"),
        F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("value_final"),
        "l_returnflag",
    )
    return lines.join(orders, "o_orderkey")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(firm, year, indicator) with one value."""
    return (
        rows(spark, sf_dir)
        .groupBy("firm", "year", "indicator")
        .agg(
            F.max("value_final").alias("value_final"),
            F.max(F.when(F.col("l_returnflag") == "A", "{'value': 1.5, 'unit': 'kg'}").when(
                F.col("l_returnflag") == "N", "{'value': None, 'unit': None}"
            )).alias("model_output"),
        )
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_facts(facts(spark, sf_dir), metadata(spark))


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return (
        read(spark, sf_dir, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("firm"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"), "country")
    )


def firm_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fundamentals and a rating per (firm, year)."""
    codes = F.create_map(*[F.lit(x) for kv in PRIORITY_RATING.items() for x in kv])
    return (
        read(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("firm"), F.year("o_orderdate").alias("year"))
        .agg(
            F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))).alias("mkcap"),
            F.max("o_totalprice").alias("sales"),
            F.min(F.substring("o_orderpriority", 1, 1)).alias("__p"),
            F.count(F.lit(1)).alias("n_orders"),
        )
        .withColumn("rating", F.try_element_at(codes, F.col("__p")))
        .drop("__p")
    )


def price_index(spark: SparkSession) -> DataFrame:
    return local_table(spark, PRICE_INDEX, "year int, index double")


# --- the same as SQL -------------------------------------------------------


def values(rows_) -> str:
    def lit(v):
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return "NULL" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v))

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows_)


def cases(column: str, codes: dict) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in codes.items()) + " END"


ROWS = """rows_ AS (SELECT o_custkey AS firm, CAST(year(o_orderdate) AS INT) AS year, l_linenumber AS indicator, l_returnflag,
  CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS value_final
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
FACTS = (
    ROWS
    + """, facts AS (SELECT firm, year, indicator, max(value_final) AS value_final,
  max(CASE l_returnflag WHEN 'A' THEN '{''value'': 1.5, ''unit'': ''kg''}' WHEN 'N' THEN '{''value'': None, ''unit'': None}' END) AS model_output
  FROM rows_ GROUP BY ALL)"""
)
_LEVELS = ", ".join(f"'{t}'" for t in TOPIC_LEVELS)
ENRICHED = (
    FACTS
    + f""", meta(indicator, topic, standard, standard_topic, label) AS (VALUES {values(META)}),
  enriched AS (SELECT f.*, m.topic, m.standard, m.standard_topic, m.label, f.value_final IS NOT NULL AS "exists",
    CAST(CASE m.topic WHEN 'env' THEN 1 WHEN 'soc' THEN 2 WHEN 'gov' THEN 3 END AS INT) AS area_order,
    CASE WHEN s IN ({_LEVELS}) THEN s END AS std
    FROM facts f LEFT JOIN (SELECT *, CASE standard_topic WHEN 'General' THEN 'Governance' ELSE standard_topic END AS s FROM meta) m USING (indicator)),
  cells AS (SELECT firm, year, std, sum(CAST("exists" AS INT)) AS reported, count(*) AS possible FROM enriched GROUP BY ALL),
  transp AS (SELECT firm, year, sum(reported) / sum(possible) AS transp FROM cells GROUP BY ALL)"""
)
FIRMS = """firms AS (SELECT c_custkey AS firm, c_name AS name, c_mktsegment AS sector, n_name AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
FIRM_YEARS = f"""firm_years AS (SELECT firm, year, mkcap, sales, n_orders, {cases('p', PRIORITY_RATING)} AS rating FROM (
  SELECT o_custkey AS firm, CAST(year(o_orderdate) AS INT) AS year,
  max(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) AS mkcap, max(o_totalprice) AS sales,
  min(substr(o_orderpriority, 1, 1)) AS p, count(*) AS n_orders FROM orders GROUP BY ALL))"""
INDEX = f"price_index(year, idx) AS (VALUES {values(PRICE_INDEX)})"
LOW_BEST = rating_codes(TRIPLE_SCALE, best="low")
HIGH_BEST = rating_codes(TRIPLE_SCALE, best="high")
