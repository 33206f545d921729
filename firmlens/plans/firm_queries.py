"""Panel preparation (E1-E11) and coverage (F1-F19) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.functions.field_names import FUNDAMENTALS, PROVIDER_FIELDS, RATINGS
from firmlens.functions.ratings import LETTER_SCALE, TRIPLE_SCALE, coded, rating_codes
from firmlens.operators import coverage as C
from firmlens.operators import firmpanel as E
from firmlens.operators.performance import constant_reporters
from firmlens.plans import standins as S
from firmlens.plans.panel_queries import STEADY, rounded
from firmlens.plans.registry import query
from firmlens.session import staging_path

YEARS = list(range(1995, 2002))


def companies(spark, d):
    indices = F.array("c_mktsegment", F.col("c_nationkey").cast("string"))
    return S.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), indices.alias("indices"))


@query("e01_index_members", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE list_contains([c_mktsegment, CAST(c_nationkey AS VARCHAR)], 'BUILDING')")
def _(spark, d):
    return E.index_members(companies(spark, d), "BUILDING").select("id", "name")


@query("e02_firm_year_scaffold", "SELECT c_custkey AS id, c_name AS name, CAST(y AS INT) AS year FROM customer, range(1995, 2002) t(y)")
def _(spark, d):
    return E.firm_year_scaffold(companies(spark, d).select("id", "name"), 1995, 2001)


@query(
    "e03_latest_restatement",
    """SELECT o_custkey AS firm, CAST(year(o_orderdate) AS INT) AS year,
  arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus <> 'P') AS mkcap, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus <> 'F') AS priority
  FROM orders GROUP BY ALL""",
)
def _(spark, d):
    raw = S.read(spark, d, "orders").select(
        F.col("o_custkey").alias("firm"),
        F.year("o_orderdate").alias("year"),
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("mkcap"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("priority"),
    )
    return E.latest_restatement(raw, ["firm", "year"], F.col("o_orderkey"), ["mkcap", "priority"])


@query("e04_mapped_columns", "SELECT o_custkey AS firm, o_totalprice AS sales, o_orderpriority AS rating FROM orders")
def _(spark, d):
    return E.mapped(S.read(spark, d, "orders"), {"o_custkey": "firm", "o_totalprice": "sales", "o_orderpriority": "rating"})


@query(
    "e04_fundamentals_names",
    """SELECT CAST(o_orderkey AS VARCHAR) AS isin, CAST(year(o_orderdate) AS INT) AS year, o_totalprice * 2 AS industry_group, o_totalprice * 3 AS
  worldscope_ticker, o_totalprice * 4 AS worldscope_permno, o_totalprice * 5 AS sales, o_totalprice * 6 AS salesUSD, o_totalprice * 7 AS deprec,
  o_totalprice * 8 AS deprec_amort, o_totalprice * 9 AS impairment_ppe, o_totalprice * 10 AS impairment_gw, o_totalprice * 11 AS opinc, o_totalprice *
  12 AS netinc, o_totalprice * 13 AS netincUSD, o_totalprice * 14 AS assets_asreported, o_totalprice * 15 AS assets, o_totalprice * 16 AS ppe_gross,
  o_totalprice * 17 AS deprec_accum, o_totalprice * 18 AS ppe_net, o_totalprice * 19 AS assetsUSD, o_totalprice * 20 AS debt, o_totalprice * 21 AS
  risk_provisions, o_totalprice * 22 AS op_provisions, o_totalprice * 23 AS mkcapUSD, o_totalprice * 24 AS equityUSD FROM orders""",
)
def _(spark, d):
    """A raw fundamentals table under the vendor's names; one column more than is mapped."""
    raw = {"ITEM6008": F.col("o_orderkey").cast("string"), "year_": F.year("o_orderdate")}
    raw |= {name: F.col("o_totalprice") * i for i, name in enumerate(FUNDAMENTALS) if i > 1}
    table = S.read(spark, d, "orders").select(*[c.alias(name) for name, c in raw.items()], F.lit(1).alias("ITEM9999"))
    return E.mapped(table, FUNDAMENTALS)


@query(
    "e04_provider_names",
    """SELECT l_orderkey AS isin, max(CASE WHEN l_partkey % 35 = 0 THEN l_extendedprice END) AS ref_esg_score, max(CASE WHEN l_partkey % 35 = 1 THEN l_extendedprice END) AS
  ref_esg_combined_score, max(CASE WHEN l_partkey % 35 = 2 THEN l_extendedprice END) AS ref_esg_controversies_score, max(CASE WHEN l_partkey % 35 = 3
  THEN l_extendedprice END) AS ref_env_score, max(CASE WHEN l_partkey % 35 = 4 THEN l_extendedprice END) AS ref_soc_score, max(CASE WHEN l_partkey % 35
  = 5 THEN l_extendedprice END) AS ref_gov_score, max(CASE WHEN l_partkey % 35 = 6 THEN l_extendedprice END) AS ref_res_use_score, max(CASE WHEN
  l_partkey % 35 = 7 THEN l_extendedprice END) AS ref_emissions_score, max(CASE WHEN l_partkey % 35 = 8 THEN l_extendedprice END) AS
  ref_innovation_score, max(CASE WHEN l_partkey % 35 = 9 THEN l_extendedprice END) AS ref_workforce_score, max(CASE WHEN l_partkey % 35 = 10 THEN
  l_extendedprice END) AS ref_human_rights_score, max(CASE WHEN l_partkey % 35 = 11 THEN l_extendedprice END) AS ref_community_score, max(CASE WHEN
  l_partkey % 35 = 12 THEN l_extendedprice END) AS ref_product_responsibility_score, max(CASE WHEN l_partkey % 35 = 13 THEN l_extendedprice END) AS
  ref_management_score, max(CASE WHEN l_partkey % 35 = 14 THEN l_extendedprice END) AS ref_shareholders_score, max(CASE WHEN l_partkey % 35 = 15 THEN
  l_extendedprice END) AS ref_csr_strategy_score, max(CASE WHEN l_partkey % 35 = 16 THEN l_extendedprice END) AS ref_scope1, max(CASE WHEN l_partkey %
  35 = 17 THEN l_extendedprice END) AS ref_scope2, max(CASE WHEN l_partkey % 35 = 18 THEN l_extendedprice END) AS ref_scope3, max(CASE WHEN l_partkey %
  35 = 19 THEN l_extendedprice END) AS ref_total, max(CASE WHEN l_partkey % 35 = 20 THEN l_extendedprice END) AS climate_commercial_riskopp_aware,
  max(CASE WHEN l_partkey % 35 = 21 THEN l_extendedprice END) AS carbon_offsets, max(CASE WHEN l_partkey % 35 = 22 THEN l_extendedprice END) AS
  emission_reduction_target, max(CASE WHEN l_partkey % 35 = 23 THEN l_extendedprice END) AS emission_reduction_target_year, max(CASE WHEN l_partkey % 35
  = 24 THEN l_extendedprice END) AS emission_trading, max(CASE WHEN l_partkey % 35 = 25 THEN l_extendedprice END) AS csr_sust_committee, max(CASE WHEN
  l_partkey % 35 = 26 THEN l_extendedprice END) AS csr_assurance, max(CASE WHEN l_partkey % 35 = 27 THEN l_extendedprice END) AS csr_assurance_name,
  max(CASE WHEN l_partkey % 35 = 28 THEN l_extendedprice END) AS csr_global_scope, max(CASE WHEN l_partkey % 35 = 29 THEN l_extendedprice END) AS
  csr_separate_report, max(CASE WHEN l_partkey % 35 = 30 THEN l_extendedprice END) AS esg_reporting_scope, max(CASE WHEN l_partkey % 35 = 31 THEN
  l_extendedprice END) AS global_compact_signatory, max(CASE WHEN l_partkey % 35 = 32 THEN l_extendedprice END) AS gri_reporting, max(CASE WHEN
  l_partkey % 35 = 33 THEN l_extendedprice END) AS integrated_mda, max(CASE WHEN l_partkey % 35 = 34 THEN l_extendedprice END) AS esg_compensation FROM lineitem GROUP BY ALL""",
)
def _(spark, d):
    """Field and value rows of the provider, pivoted by its field names and renamed."""
    names = F.array(*[F.lit(name) for name in PROVIDER_FIELDS])
    rows = S.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("isin"), F.get(names, (F.col("l_partkey") % 35).cast("int")).alias("field"), "l_extendedprice")
    cells = rows.groupBy("isin", "field").agg(F.max("l_extendedprice").alias("value"))
    return E.mapped(E.pivot_fields(cells, ["isin"], "field", "value", list(PROVIDER_FIELDS)), {"isin": "isin"} | PROVIDER_FIELDS)


@query("e04_rating_names", """SELECT c_name || '0' AS name, c_name || '1' AS isin, c_name || '2' AS msci_as_of_date, c_name || '3' AS msci_industry, c_name || '4' AS msci_rating_date,
  c_name || '5' AS msci_company_rating, c_name || '6' AS msci_env_score, c_name || '7' AS msci_soc_score, c_name || '8' AS msci_gov_score FROM customer""")
def _(spark, d):
    raw = [F.concat("c_name", F.lit(str(i))).alias(name) for i, name in enumerate(RATINGS)]
    return E.mapped(S.read(spark, d, "customer").select(*raw, F.lit(1).alias("OTHER")), RATINGS)


@query(
    "e09_letter_scale",
    """SELECT c_custkey, CASE c_custkey % 13 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 WHEN 6 THEN 7 WHEN 7 THEN 8 WHEN 8 THEN 9
  WHEN 9 THEN 10 WHEN 10 THEN 11 WHEN 11 THEN 12 END AS low_best, CASE c_custkey % 13 WHEN 0 THEN 12 WHEN 1 THEN 11 WHEN 2 THEN 10 WHEN 3 THEN 9 WHEN 4 THEN 8 WHEN 5 THEN 7 WHEN 6 THEN 6
  WHEN 7 THEN 5 WHEN 8 THEN 4 WHEN 9 THEN 3 WHEN 10 THEN 2 WHEN 11 THEN 1 END AS high_best FROM customer""",
)
def _(spark, d):
    """A+ to D- in both directions; the thirteenth letter is not on the scale."""
    letters = ["A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D", "D-", "E"]
    letter = F.get(F.array(*[F.lit(x) for x in letters]), (F.col("c_custkey") % 13).cast("int"))
    code = lambda best: coded(letter, rating_codes(LETTER_SCALE, best=best)).alias(f"{best}_best")
    return S.read(spark, d, "customer").select("c_custkey", code("low"), code("high"))


@query(
    "e05_lag_by_key",
    f"WITH {S.FIRM_YEARS} SELECT a.firm, a.year, a.mkcap, b.mkcap AS mkcap_lagged FROM firm_years a LEFT JOIN firm_years b ON a.firm = b.firm AND a.year = b.year + 1",
)
def _(spark, d):
    fy = S.firm_years(spark, d).select("firm", "year", "mkcap")
    return E.with_lag(fy, fy, ["mkcap"])


@query(
    "e06_panel_joins",
    f"WITH {S.FIRM_YEARS} SELECT c_custkey AS firm, CAST(y AS INT) AS year, mkcap, sales, rating FROM customer CROSS JOIN range(1995, 2002) t(y) LEFT JOIN firm_years ON firm = c_custkey AND year = y",
)
def _(spark, d):
    scaffold = E.firm_year_scaffold(S.read(spark, d, "customer").select(F.col("c_custkey").alias("firm")), 1995, 2001)
    return E.enriched(scaffold, S.firm_years(spark, d).select("firm", "year", "mkcap", "sales", "rating"))


EVENT_TYPES = ["click", "purchase", "signup", "view"]


@query(
    "e07_fields_to_columns",
    "SELECT user_id, CAST(ts AS DATE) AS day, "
    + ", ".join(f"max(CASE event_type WHEN '{t}' THEN value END) AS {t}" for t in EVENT_TYPES)
    + " FROM events WHERE event_type <> 'error' GROUP BY ALL",
)
def _(spark, d):
    cells = S.read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.max("value").alias("value"))
    return E.pivot_fields(cells, ["user_id", "day"], "event_type", "value", EVENT_TYPES)


@query(
    "e08_last_in_period",
    """SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, (ts, event_id)) FILTER (event_type <> 'error') AS value, arg_max(event_type, (ts, event_id)) AS event_type
  FROM events GROUP BY ALL""",
)
def _(spark, d):
    events = S.read(spark, d, "events").withColumns(
        {"day": F.to_date("ts"), "value": F.when(F.col("event_type") != "error", F.col("value"))}
    )
    return E.last_in_period(events, ["user_id", "day"], ["ts", "event_id"], ["value", "event_type"])


@query(
    "e09_rating_codes",
    f"WITH {S.FIRM_YEARS} SELECT firm, year, {S.cases('rating', S.LOW_BEST)} AS low_best, {S.cases('rating', S.HIGH_BEST)} AS high_best, "
    f"{S.cases('rating', rating_codes(TRIPLE_SCALE, worst_code=0))} AS from_zero FROM firm_years",
)
def _(spark, d):
    code = lambda **k: coded(F.col("rating"), rating_codes(TRIPLE_SCALE, **k))
    return S.firm_years(spark, d).select(
        "firm", "year", code(best="low").alias("low_best"), code().alias("high_best"), code(worst_code=0).alias("from_zero")
    )


@query(
    "e10_enrichment_without_overlap",
    f"WITH {S.FACTS}, {S.FIRMS} SELECT f.firm, f.year, f.indicator, f.value_final, 'own' AS name, sector, country FROM facts f LEFT JOIN firms USING (firm)",
)
def _(spark, d):
    own = S.facts(spark, d).drop("model_output").withColumn("name", F.lit("own"))
    return E.enriched(own, S.firms(spark, d), ["firm"])


@query(
    "e11_optional_source",
    f"WITH {S.FIRM_YEARS} SELECT f.firm, f.year, f.sales, s.c_acctbal AS balance FROM firm_years f LEFT JOIN customer s ON c_custkey = firm",
)
def _(spark, d):
    path = staging_path(spark, "licensed")
    S.read(spark, d, "customer").select(F.col("c_custkey").alias("firm"), F.col("c_acctbal").alias("balance")).write.parquet(path)
    base = S.firm_years(spark, d).select("firm", "year", "sales")
    present, absent = E.optional_table(spark, path), E.optional_table(spark, path + "-absent")
    return E.enriched(E.enriched(base, present, ["firm"]), absent, ["firm"])


# --- coverage --------------------------------------------------------------

REPORT_SQL = """rid AS (SELECT CASE WHEN o_orderpriority LIKE '5%' THEN 'bad-' || o_orderkey ELSE o_custkey || '_' || year(o_orderdate) || '_' ||
    CASE o_orderstatus WHEN 'F' THEN 'AR' WHEN 'O' THEN 'SR' ELSE 'IR' END END AS report_id FROM orders),
  reports AS (SELECT DISTINCT report_id, regexp_extract(report_id, '^(.*)_(\\d+)_([^_]*)$', 1) AS firm, CAST(regexp_extract(report_id, '^(.*)_(\\d+)_([^_]*)$', 2) AS INT) AS year,
    regexp_extract(report_id, '^(.*)_(\\d+)_([^_]*)$', 3) AS report_type FROM rid WHERE report_id NOT LIKE 'bad%')"""


def report_ids(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "AR").when(F.col("o_orderstatus") == "O", "SR").otherwise("IR")
    good = F.concat_ws("_", F.col("o_custkey"), F.year("o_orderdate"), kind)
    bad = F.concat(F.lit("bad-"), F.col("o_orderkey"))
    return S.read(spark, d, "orders").select(F.when(F.col("o_orderpriority").startswith("5"), bad).otherwise(good).alias("report_id"))


def reports(spark, d):
    return C.parse_report_ids(report_ids(spark, d).distinct())


GRID_SQL = REPORT_SQL + """, grid AS (SELECT f.firm, y.year, r.report_id, r.report_type FROM (SELECT DISTINCT firm FROM reports) f CROSS JOIN (SELECT DISTINCT year FROM reports) y
    LEFT JOIN reports r ON r.firm = f.firm AND r.year = y.year)"""
TEXT_SQL = "texts AS (SELECT CAST(doc_id AS VARCHAR) AS firm, CAST(1995 + n_chars % 7 AS INT) AS year, text, lang FROM documents)"
STAGE_SQL = (
    GRID_SQL
    + ", "
    + TEXT_SQL
    + """, usable AS (SELECT firm, year, bool_or(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 800) AS text_extracted FROM texts GROUP BY ALL),
  stages AS (SELECT g.firm, g.year, g.report_id, g.report_id IS NOT NULL AS report_available, coalesce(text_extracted, false) AS text_extracted, c.firm IS NOT NULL AS chunks_present
    FROM grid g LEFT JOIN usable u USING (firm, year) LEFT JOIN (SELECT DISTINCT firm, year FROM texts WHERE lang <> 'de') c ON c.firm = g.firm AND c.year = g.year),
  fy AS (SELECT firm, year, bool_or(report_available) AS report_available, bool_or(text_extracted) AS text_extracted, bool_or(chunks_present) AS chunks_present,
    sum(CAST(report_available AS INT))::BIGINT AS n_reports_available FROM stages GROUP BY ALL)"""
)


def texts(spark, d):
    return S.read(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("firm"), (F.lit(1995) + F.col("n_chars") % 7).cast("int").alias("year"), "text", "lang"
    )


def stages(spark, d):
    t = texts(spark, d)
    return C.stage_table(C.report_grid(reports(spark, d)), t, t.where(F.col("lang") != "de").select("firm", "year"), 800)


@query("f01_report_ids", f"WITH {REPORT_SQL} SELECT * FROM reports")
def _(spark, d):
    return reports(spark, d)


@query("f02_report_grid", f"WITH {GRID_SQL} SELECT * FROM grid")
def _(spark, d):
    return C.report_grid(reports(spark, d)).select("firm", "year", "report_id", "report_type")


@query("f03_usable_text", f"WITH {STAGE_SQL} SELECT * FROM usable")
def _(spark, d):
    return C.usable_text(texts(spark, d), 800)


@query("f04_stage_table", f"WITH {STAGE_SQL} SELECT * FROM stages")
def _(spark, d):
    return stages(spark, d)


@query("f05_firm_year_stages", f"WITH {STAGE_SQL} SELECT * FROM fy")
def _(spark, d):
    return C.firm_year_stages(stages(spark, d))


POP_SQL = f"""{STAGE_SQL}, {S.FIRMS}, pop AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS firm, CAST(year(o_orderdate) AS INT) AS year, country, CASE WHEN sector <> 'MACHINERY' THEN sector END AS sector
    FROM orders JOIN firms ON o_custkey = firms.firm),
  merged AS (SELECT p.*, coalesce(report_available, false) AS av, coalesce(n_reports_available, 0) AS nr FROM pop p LEFT JOIN fy USING (firm, year) WHERE sector IS NOT NULL)"""


def population(spark, d):
    years = S.read(spark, d, "orders").select(F.col("o_custkey").alias("firm"), F.year("o_orderdate").alias("year")).distinct()
    sector = F.when(F.col("sector") != "MACHINERY", F.col("sector"))
    joined = years.join(S.firms(spark, d), "firm").withColumn("sector", sector)
    return joined.withColumn("firm", F.col("firm").cast("string"))


def year_columns(sql):
    return ", ".join(sql.format(y=y) + f' AS "{y}"' for y in YEARS)


@query("f06_coverage_rate", f"WITH {POP_SQL} SELECT sector, {year_columns('round(avg(CASE WHEN year = {y} THEN CAST(av AS INT) END), 6)')} FROM merged GROUP BY sector")
def _(spark, d):
    out = C.population_coverage(population(spark, d), stages(spark, d), "sector", "coverage_rate", YEARS)
    return rounded(out, *[str(y) for y in YEARS])


@query("f07_report_counts", f"WITH {POP_SQL} SELECT country, {year_columns('CAST(sum(CASE WHEN year = {y} THEN nr END) AS BIGINT)')} FROM merged GROUP BY country")
def _(spark, d):
    return C.population_coverage(population(spark, d), stages(spark, d), "country", "n_reports", YEARS)


@query(
    "f08_stage_funnel",
    f"""WITH {STAGE_SQL}, k AS (SELECT count(*) AS n, count_if(report_available) AS r, count_if(report_available AND text_extracted) AS t,
    count_if(report_available AND text_extracted AND chunks_present) AS c FROM fy)
  SELECT source, target, CAST(x AS BIGINT) AS n FROM (SELECT 'all' AS source, 'report' AS target, r AS x FROM k UNION ALL SELECT 'all', 'no_report', n - r FROM k UNION ALL SELECT 'report', 'text', t FROM k
  UNION ALL SELECT 'report', 'no_text', r - t FROM k UNION ALL SELECT 'text', 'chunks', c FROM k UNION ALL SELECT 'text', 'no_chunks', t - c FROM k) WHERE x > 0""",
)
def _(spark, d):
    return C.stage_funnel(stages(spark, d))


OBS_SQL = f"""{STAGE_SQL}, {S.ROWS}, results AS (SELECT CAST(firm AS VARCHAR) AS firm, year, indicator, l_returnflag <> 'N' AS extracted, CASE WHEN l_returnflag = 'A' THEN value_final END AS value_final FROM rows_),
  ok AS (SELECT firm, year FROM fy WHERE chunks_present),
  obs AS (SELECT firm, year, indicator, bool_or(extracted) AS extracted, bool_or(value_final IS NOT NULL) AS final FROM results JOIN ok USING (firm, year) GROUP BY ALL),
  ext AS (SELECT i.indicator, CAST(sum(p.n) AS BIGINT) AS n_possible, CAST(sum(coalesce(e, 0)) AS BIGINT) AS n_extracted, CAST(sum(coalesce(f, 0)) AS BIGINT) AS n_final
    FROM (SELECT DISTINCT indicator FROM results) i CROSS JOIN (SELECT year, count(*) AS n FROM ok GROUP BY ALL) p
    LEFT JOIN (SELECT year, indicator, count_if(extracted) AS e, count_if(final) AS f FROM obs GROUP BY ALL) USING (year, indicator) GROUP BY ALL)"""


def results(spark, d):
    return S.rows(spark, d).select(
        F.col("firm").cast("string").alias("firm"),
        "year",
        "indicator",
        (F.col("l_returnflag") != "N").alias("extracted"),
        F.when(F.col("l_returnflag") == "A", F.col("value_final")).alias("value_final"),
    )


@query("f09_indicator_observations", f"WITH {OBS_SQL} SELECT * FROM obs")
def _(spark, d):
    return C.indicator_observations(stages(spark, d), results(spark, d))


@query(
    "f10_opportunity_counts",
    f"""WITH {OBS_SQL}, k AS (SELECT (SELECT count(*) FROM ok) AS n_fy_ok, (SELECT count(DISTINCT indicator) FROM results) AS k_indicators, count_if(extracted)::BIGINT AS n_extracted, count_if(final)::BIGINT AS n_final FROM obs)
  SELECT n_fy_ok, k_indicators, n_fy_ok * k_indicators AS n_possible, n_extracted, n_fy_ok * k_indicators - n_extracted AS n_no_evidence, n_final, n_extracted - n_final AS n_not_final FROM k""",
)
def _(spark, d):
    return C.opportunity_counts(stages(spark, d), results(spark, d))


@query("f11_extractability_counts", f"WITH {OBS_SQL} SELECT * FROM ext")
def _(spark, d):
    return C.extractability_counts(stages(spark, d), results(spark, d))


RATE_SQL = """SELECT *, CASE WHEN n_possible > 0 THEN least(greatest(n_extracted / n_possible, 0), 1) END AS disclosure_rate,
  CASE WHEN n_extracted > 0 THEN least(greatest(n_final / n_extracted, 0), 1) END AS extraction_success,
  CASE WHEN n_possible > 0 THEN least(greatest(n_final / n_possible, 0), 1) END AS overall_yield FROM ext"""


@query(
    "f12_extractability_rates",
    f"WITH {OBS_SQL} SELECT indicator, n_possible, n_extracted, n_final, round(disclosure_rate, 6) AS disclosure_rate, round(extraction_success, 6) AS extraction_success, round(overall_yield, 6) AS overall_yield FROM ({RATE_SQL})",
)
def _(spark, d):
    rates = C.extractability_rates(C.extractability_counts(stages(spark, d), results(spark, d)))
    return rounded(rates, "disclosure_rate", "extraction_success", "overall_yield")


@query(
    "f13_descriptions",
    """SELECT p_partkey, nullif(CASE WHEN spec = '' THEN trim(p_name) ELSE trim(p_name) || ': ' || spec END, '') AS by_specification, nullif(trim(p_type), '') AS by_label
  FROM (SELECT *, CASE WHEN p_size > 25 THEN '' ELSE p_brand END AS spec FROM part)""",
)
def _(spark, d):
    part = S.read(spark, d, "part")
    spec = part.select("p_partkey", F.col("p_name").alias("label"), F.when(F.col("p_size") <= 25, F.col("p_brand")).alias("specification"))
    one = C.datapoint_description(spec).select("p_partkey", F.col("datapoint_description").alias("by_specification"))
    two = C.datapoint_description(part.select("p_partkey", F.col("p_type").alias("label")))
    return one.join(two.select("p_partkey", F.col("datapoint_description").alias("by_label")), "p_partkey")


@query(
    "f14_coverage_report",
    f"""WITH {OBS_SQL}, meta(indicator, topic, standard, standard_topic, label) AS (VALUES {S.values(S.META)}), r AS ({RATE_SQL}),
  t AS (SELECT indicator, nullif(trim(label), '') AS dd, disclosure_rate AS a, extraction_success AS b FROM r LEFT JOIN meta USING (indicator) ORDER BY lower(coalesce(dd, '')), indicator LIMIT 5)
  SELECT indicator, dd AS datapoint_description, coalesce(printf('%.1f', a * 100), '—') AS disclosure, coalesce(printf('%.1f', b * 100), '—') AS success FROM t""",
)
def _(spark, d):
    rates = C.extractability_rates(C.extractability_counts(stages(spark, d), results(spark, d)))
    return C.coverage_report(rates, C.datapoint_description(S.metadata(spark).select("indicator", "label")), max_rows=5)


@query(
    "f15_constant_reporters",
    f"""WITH {S.FACTS}, c AS (SELECT indicator, firm FROM facts WHERE value_final IS NOT NULL AND year IN {tuple(STEADY)} GROUP BY ALL HAVING count(DISTINCT year) = {len(STEADY)})
  SELECT indicator, firm FROM c""",
)
def _(spark, d):
    return constant_reporters(S.facts(spark, d), STEADY).select("indicator", "firm").distinct()


LIST_SQL = """lists AS (SELECT o_custkey || '_' || year(o_orderdate) AS company_year, '[''' || o_custkey || '_' || year(o_orderdate) || '_AR.pdf''' ||
  CASE WHEN o_orderstatus <> 'F' THEN ', ''' || o_orderkey || '_' || year(o_orderdate) || '_SR.pdf''' ELSE '' END || ', ''notes.txt'']' AS reports FROM orders),
  types AS (SELECT company_year, CAST(regexp_extract(company_year, '^.*_(\\d{4})$', 1) AS INT) AS year, CAST(len(f) AS INT) AS n_reports,
    CAST(len(list_filter(f, lambda x: contains(x, '_SR.pdf'))) AS INT) AS sr_count, CAST(len(list_filter(f, lambda x: contains(x, '_AR.pdf'))) AS INT) AS ar_count
    FROM (SELECT *, regexp_extract_all(reports, '''([^'']+\\.pdf)''', 1) AS f FROM lists))"""


def report_lists(spark, d):
    key = F.concat_ws("_", F.col("o_custkey"), F.year("o_orderdate"))
    more = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit(", '"), F.concat_ws("_", F.col("o_orderkey"), F.year("o_orderdate")), F.lit("_SR.pdf'"))).otherwise("")
    literal = F.concat(F.lit("['"), key, F.lit("_AR.pdf'"), more, F.lit(", 'notes.txt']"))
    return S.read(spark, d, "orders").select(key.alias("company_year"), literal.alias("reports"))


@query("f16_report_list_literals", f"WITH {LIST_SQL} SELECT * FROM types")
def _(spark, d):
    return C.report_types(report_lists(spark, d))


@query(
    "f17_reports_over_time",
    f"WITH {LIST_SQL} SELECT year, 'Sustainability Report' AS report_type, CAST(sum(sr_count) AS BIGINT) AS n FROM types GROUP BY year UNION ALL SELECT year, 'Annual Report', CAST(sum(ar_count) AS BIGINT) FROM types GROUP BY year",
)
def _(spark, d):
    return C.reports_over_time(C.report_types(report_lists(spark, d)))


@query(
    "f18_firms_per_country",
    f"WITH {S.FIRMS} SELECT CASE country WHEN 'United Kingdom' THEN 'UK' ELSE country END AS country, count(DISTINCT firm) AS n FROM firms WHERE firm IN (SELECT o_custkey FROM orders) GROUP BY 1",
)
def _(spark, d):
    return C.firms_per_country(S.read(spark, d, "orders").select(F.col("o_custkey").alias("firm")), S.firms(spark, d))


@query(
    "f19_paired_companies",
    f"""WITH {S.FIRMS}, n AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY name, country) AS rn FROM (SELECT DISTINCT name, country, sector FROM firms))
  SELECT sector, (rn + 1) // 2 AS pair_id, arg_min(name, rn) AS name_1, arg_min(country, rn) AS country_1, arg_max(name, rn) AS name_2, arg_max(country, rn) AS country_2 FROM n GROUP BY ALL""",
)
def _(spark, d):
    return C.paired_companies(S.firms(spark, d))
