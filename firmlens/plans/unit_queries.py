"""Unit harmonisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.functions import units as U
from firmlens.operators.harmonise import fx_long, harmonise, resolve_units, safe_date, safe_number
from firmlens.operators.scale import hash_side, local_table
from firmlens.plans import standins as S
from firmlens.plans.registry import query

TYPES = [*U.TARGETS, *U.UNITLESS_TYPES, None]
UNITS = [
    "€m", "mio.EUR", "k$", "tonnes of CO2 equivalents", "million tonnes CO2e", "MWh/EURm", "m³/USD", "tCO2e/year", "hundredthousand t",
    "1000 CHF", "%", "per cent", None, "acres", "USD", "EUR million", "USD thousands", "£bn", "CHF", "JPY", "ktCO2e", "kg CO2e", "tCO₂",
    "Mt CO2eq", "metric tons of CO2e", "kilotonnes CO2", "kgCO2eq", "GWh", "kWh", "TJ", "million kWh", "tCO2e/USD million", "cubic meters",
    "t", "tonnes", "kg", "ha", "km2", "Percent", "hours", "days", "years", "", "people", "billions of SEK", "MWh/t", "/USD", "GJ / kEUR",
]
FX_WIDE = [
    (1995, 1.31, 1.58, 0.85, 0.14), (1996, 1.27, 1.56, 0.81, 0.15), (1997, 1.13, 1.64, 0.69, 0.13), (1998, 1.12, 1.66, 0.69, 0.126),
    (1999, 1.07, 1.62, 0.67, 0.121), (2000, 0.92, 1.52, 0.59, 0.109),
]
FX_COLUMNS = ["Time Period", "EUR/USD", "GBP/USD", "CHF/USD", "SEK/USD"]


def fx_wide(spark):
    return local_table(spark, FX_WIDE, "p int, e double, g double, c double, s double").toDF(*FX_COLUMNS)


def unit_text():
    return F.get(F.array(*[F.lit(u) for u in UNITS]), (F.col("l_partkey") % len(UNITS)).cast("int"))


def unit_texts(spark, d):
    """The unit texts of all line items, without the join to their orders."""
    return S.read(spark, d, "lineitem").select(unit_text().alias("unit"))


def answers(spark, d):
    """Value and unit text per line item; the text forms rotate over the rows.

    Orders, a key and a year each, are the side to hash, so that the line items are not sorted and spilled.
    """
    orders = hash_side(S.read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")))
    price = F.col("l_extendedprice").cast("string")
    is_date = F.col("l_suppkey") % len(TYPES) == TYPES.index("date")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    text = (
        F.when(is_date & (F.col("l_linenumber") == 7), "2023-13-05")
        .when(is_date & (F.col("l_linenumber") == 6), "2023-1-5")
        .when(is_date & (F.col("l_linenumber") < 6), day)
        .when(F.col("l_linenumber") == 1, F.concat(F.lit("1,"), price))
        .when(F.col("l_linenumber") == 2, "1.0d")
        .when(F.col("l_linenumber") == 3, F.concat(F.lit(" "), price, F.lit(" ")))
        .when((F.col("l_linenumber") == 4) & (F.col("l_returnflag") == "N"), None)
        .when((F.col("l_linenumber") == 4) & (F.col("l_returnflag") == "A"), "nan")
        .when(F.col("l_linenumber") == 5, "1_000")
        .otherwise(price)
    )
    return (
        S.read_spread(spark, d, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "year",
            (F.col("l_suppkey") % len(TYPES)).cast("int").alias("indicator"),
            text.alias("value"), unit_text().alias("unit"), (F.col("l_returnflag") != "R").alias("valid"),
        )
    )


def types(spark):
    return local_table(spark, list(enumerate(TYPES)), "indicator int, type_standard string")


def traced(spark, d, rates=True):
    return harmonise(answers(spark, d), types(spark), fx_long(fx_wide(spark)) if rates else None, trace=True, texts=unit_texts(spark, d))


# --- SQL -------------------------------------------------------------------

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_LIST = "[" + ", ".join("NULL" if u is None else "'" + u + "'" for u in UNITS) + "]"
_TLIST = "[" + ", ".join("NULL" if t is None else "'" + t + "'" for t in TYPES) + "]"


def _in(items):
    return "(" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + ")"


def _num(x, underscores=False):
    trimmed = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    if underscores:
        trimmed = f"regexp_replace(regexp_replace({trimmed}, '(\\d)_(\\d)', '\\1\\2', 'g'), '(\\d)_(\\d)', '\\1\\2', 'g')"
    return f"CASE WHEN regexp_matches({trimmed}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN try_cast({trimmed} AS DOUBLE) END"


def _scale(unit):
    words = [(w + s, m) for w, m in U.SCALE_WORDS.items() for s in U.SCALE_SUFFIXES]
    mult = "CASE " + " ".join(f"WHEN contains(lower({unit}), '{w}') THEN {m!r}" for w, m in words) + " ELSE 1.0 END"
    rest = "CASE " + " ".join(f"WHEN contains(lower({unit}), '{w}') THEN regexp_replace({unit}, '{w}', '', 'gi')" for w, m in words) + f" ELSE {unit} END"
    return f"CAST({mult} AS DOUBLE)", rest


def _unify(unit):
    pat = U.currency_pattern()
    known = "CASE " + " ".join(
        f"WHEN regexp_matches({unit}, '(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])', 'i') THEN '{name}'" for name, p in U.CO2E_PATTERNS.items()
    ) + f" WHEN lower({unit}) IN {_in(U.CUBIC)} THEN 'cubic_meter' WHEN lower({unit}) IN {_in(U.SQUARE)} THEN 'square_meter' END"
    money = f"regexp_extract({unit}, '{pat}', 2, 'i')"
    code = "CASE " + money + " " + " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in U.SYMBOLS.items()) + f" ELSE upper({money}) END"
    size = lambda g: f"CASE lower(regexp_extract({unit}, '{pat}', {g}, 'i')) " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in U.MAGNITUDES.items()) + " ELSE 1.0 END"
    hit = f"(regexp_matches({unit}, '{pat}', 'i') AND NOT regexp_matches({unit}, '[0-9]'))"
    name = f"coalesce({known}, CASE WHEN {hit} THEN {code} END, {unit})"
    mag = f"CAST(CASE WHEN ({known}) IS NULL AND {hit} THEN ({size(1)}) * ({size(3)}) ELSE 1.0 END AS DOUBLE)"
    return name, mag


_FX_ROWS = [(r[0], c.replace("/USD", ""), v) for r in FX_WIDE for c, v in zip(FX_COLUMNS[1:], r[1:])]
_QUOTED = sorted({r[1] for r in _FX_ROWS})
ANSWERS = f"""answers AS (SELECT {KEYS}, CAST(year(o_orderdate) AS INT) AS year, CAST(l_suppkey % {len(TYPES)} AS INT) AS indicator,
  ({_TLIST})[l_suppkey % {len(TYPES)} + 1] AS type_standard, ({_LIST})[l_partkey % {len(UNITS)} + 1] AS unit, l_returnflag <> 'R' AS valid,
  CASE WHEN l_suppkey % {len(TYPES)} = {TYPES.index('date')} AND l_linenumber = 7 THEN '2023-13-05'
    WHEN l_suppkey % {len(TYPES)} = {TYPES.index('date')} AND l_linenumber = 6 THEN '2023-1-5'
    WHEN l_suppkey % {len(TYPES)} = {TYPES.index('date')} THEN strftime(l_shipdate, '%Y-%m-%d')
    WHEN l_linenumber = 1 THEN '1,' || CAST(l_extendedprice AS VARCHAR) WHEN l_linenumber = 2 THEN '1.0d'
    WHEN l_linenumber = 3 THEN ' ' || CAST(l_extendedprice AS VARCHAR) || ' '
    WHEN l_linenumber = 4 AND l_returnflag = 'N' THEN NULL WHEN l_linenumber = 4 AND l_returnflag = 'A' THEN 'nan'
    WHEN l_linenumber = 5 THEN '1_000' ELSE CAST(l_extendedprice AS VARCHAR) END AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def chain_sql(rates: bool) -> str:
    free, nums, need = _in(U.UNITLESS_TYPES), _in(U.NUMBER_TYPES), _in(U.UNIT_TYPES)
    (mn, rn), (md, rd) = _scale("numerator"), _scale("denominator")
    (un, sn), (ud, sd) = _unify("unit_num"), _unify("unit_den")
    codes = ["USD"] if rates else U.CURRENCIES
    money = [(c.lower(), "currency" if rates else f"currency:{c}", 1.0, False) for c in codes] + ([("$", "currency", 1.0, False)] if rates else [])
    usd = lambda s: f"CASE WHEN unified_{s} IN {_in(_QUOTED)} THEN 'USD' ELSE unified_{s} END" if rates else f"unified_{s}"
    norate = lambda s: f"(coalesce(unified_{s} IN {_in(_QUOTED)}, false) AND rate_{s} IS NULL)" if rates else "false"
    rate = lambda s: f"(SELECT max(rate) FROM fx WHERE fx.year = a5.year AND fx.currency = a5.unified_{s})" if rates else "CAST(NULL AS DOUBLE)"
    swap = "" if rates else " AND unit IS DISTINCT FROM '1000 CHF'"
    return f"""{ANSWERS}, fx(year, currency, rate) AS (VALUES {S.values(_FX_ROWS)}),
  alias(a, dim, fac, over_) AS (VALUES {S.values(U.unit_aliases() + money)}),
  target(t, tdim, tfac, tunit) AS (VALUES {S.values([(k, *v) for k, v in U.TARGETS.items()])}),
  a1 AS (SELECT *, CASE WHEN coalesce(type_standard IN {free}, false) THEN NULL ELSE unit END AS unit_kept,
    coalesce(type_standard IN {need} AND value IS NOT NULL AND unit IS NULL, false) AS missing, coalesce(type_standard IN {nums}, false) AS isnum,
    coalesce(type_standard = 'percent', false) AS ispct, coalesce(type_standard = 'date', false) AS isdate, coalesce(type_standard IN {free}, false) AS isfree FROM answers),
  a2 AS (SELECT *, CASE WHEN missing THEN NULL ELSE value END AS value_kept FROM a1),
  a3 AS (SELECT *, CASE WHEN isdate AND regexp_matches(value_kept, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN CAST(try_strptime(value_kept, '%Y-%m-%d') AS DATE) END AS date,
    CASE WHEN isnum THEN {_num('value_kept', True)} WHEN NOT isdate THEN {_num('value_kept')} END AS plain,
    CASE WHEN ispct AND (unit_kept IS NULL OR lower(unit_kept) IN {_in(U.PERCENT_WORDS)}) THEN 'percent' ELSE unit_kept END AS unit_w FROM a2),
  a4 AS (SELECT *, CASE WHEN ispct AND unit_kept IS NULL THEN plain * 100 ELSE plain END AS number,
    CASE WHEN isnum THEN plain IS NOT NULL WHEN isdate THEN date IS NOT NULL ELSE value_kept IS NOT NULL END AS has_,
    valid AND NOT missing AND NOT (isnum AND value_kept IS NOT NULL AND plain IS NULL AND lower(trim(value_kept)) <> 'nan')
      AND NOT (ispct AND plain IS NULL) AND NOT (isdate AND date IS NULL) AS ok FROM a3),
  a4b AS (SELECT *, string_split(regexp_replace(CASE WHEN has_ THEN unit_w END, '[\\s\\p{{Z}}]+', '', 'g'), '/') AS halves FROM a4),
  a4c AS (SELECT *, halves[1] AS numerator, halves[2] AS denominator FROM a4b),
  a4d AS (SELECT *, {mn} AS multiplier_num, {rn} AS unit_num, {md} AS multiplier_den, {rd} AS unit_den FROM a4c),
  a5 AS (SELECT *, {un} AS unified_num, {sn} AS suffix_num, {ud} AS unified_den, {sd} AS suffix_den FROM a4d),
  a6 AS (SELECT *, {usd('num')} AS usd_num, {usd('den')} AS usd_den, {rate('num')} AS rate_num, {rate('den')} AS rate_den FROM a5),
  a7 AS (SELECT *, {norate('num')} OR {norate('den')} AS norate, CASE WHEN usd_den IS NULL THEN usd_num WHEN usd_num IS NULL THEN 'per_' || usd_den ELSE usd_num || '_per_' || usd_den END AS unit_key FROM a6),
  a8 AS (SELECT a7.*, CASE WHEN usd_den IS NULL THEN x.dim WHEN x.over_ AND y.dim IS NOT NULL THEN x.dim || '/' || y.dim END AS dimension, x.fac AS fac
    FROM a7 LEFT JOIN alias x ON lower(usd_num) = x.a LEFT JOIN (SELECT * FROM alias WHERE dim LIKE 'currency%' AND a <> '$') y ON lower(usd_den) = y.a),
  a9 AS (SELECT *, CASE WHEN dimension IS NOT NULL THEN fac END AS factor,
    CASE WHEN NOT isfree THEN number * multiplier_num * coalesce(rate_num, 1) * suffix_num / (multiplier_den * coalesce(rate_den, 1)) / suffix_den END AS value_scaled,
    NOT isfree AND unit_key IS NOT NULL AND dimension IS NOT NULL AND number IS NOT NULL AS quantity FROM a8 LEFT JOIN target ON type_standard = t),
  a10 AS (SELECT *, CASE WHEN quantity THEN coalesce(regexp_replace(dimension, ':[A-Z]+$', '') = tdim, false) AND NOT norate{swap}
    ELSE ok AND NOT coalesce(NOT isfree AND ((unit_key IS NOT NULL AND dimension IS NULL) OR (has_ AND number IS NULL) OR norate), false) END AS valid_final,
    CASE WHEN regexp_matches(dimension, 'currency:[A-Z]+$') THEN replace(tunit, 'USD', regexp_extract(dimension, 'currency:([A-Z]+)$', 1)) ELSE tunit END AS tname FROM a9),
  final AS (SELECT *, CASE WHEN valid_final THEN CASE WHEN isfree THEN number WHEN quantity THEN value_scaled * factor / tfac END END AS value_num,
    CASE WHEN valid_final THEN date END AS value_date, CASE WHEN valid_final AND quantity THEN tname END AS unit_final FROM a10)"""


RATED, UNRATED = chain_sql(True), chain_sql(False)
KEY_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def step(name: str, columns: list[str], rates: bool = True, where: str | None = None):
    """Register one step of the chain as a query over all rows."""
    sql = f"WITH {RATED if rates else UNRATED} SELECT {KEYS}, {', '.join(columns)} FROM final" + (f" WHERE {where}" if where else "")

    def run(spark, d):
        t = traced(spark, d, rates)
        t = t.where(where) if where else t
        return t.select(*KEY_COLS, *columns)

    query(name, sql)(run)


step("d01_standard_type", ["indicator", "type_standard"])
step("d02_unitless_types", ["type_standard", "unit_kept"])
step("d03_required_unit", ["value_kept"])
step("d05_percent_rule", ["number"], where="type_standard = 'percent'")
step("d07_unit_needs_value", ["numerator"], where="value_kept IS NULL")
step("d09_numerator_denominator", ["numerator", "denominator"])
step("d10_scale_words", ["multiplier_num", "unit_num", "multiplier_den", "unit_den"])
step("d11_co2e_spellings", ["unified_num", "unified_den"])
step("d12_metre_spellings", ["unified_num"], where="unit_num IS NOT NULL")
step("d13_currency_magnitudes", ["unified_num", "suffix_num", "unified_den", "suffix_den"])
step("d15_currency_to_usd", ["usd_num", "rate_num", "usd_den", "rate_den"])
step("d16_unit_key", ["unit_key"])
step("d17_dimension_factor", ["unit_key", "dimension", "factor"])
step("d18_numeric_value", ["number"], where="type_standard NOT IN ('date', 'percent', 'integer', 'decimal')")
step("d19_scaled_value", ["value_scaled"])
step("d20_target_unit", ["value_num", "unit_final", "valid_final"], where="unit_key IS NOT NULL")
step("d22_without_rates", ["value_num", "unit_final", "valid_final"], rates=False)


@query(
    "d04_safe_numbers",
    f"WITH {ANSWERS} SELECT {KEYS}, {_num('value', True)} AS number, value IS NOT NULL AND ({_num('value', True)}) IS NULL AS rejected FROM answers",
)
def _(spark, d):
    number = safe_number(F.col("value"), underscores=True)
    return answers(spark, d).select(*KEY_COLS, number.alias("number"), (F.col("value").isNotNull() & number.isNull()).alias("rejected"))


@query(
    "d06_date_validation",
    f"WITH {ANSWERS} SELECT {KEYS}, value, CASE WHEN regexp_matches(value, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN CAST(try_strptime(value, '%Y-%m-%d') AS DATE) END AS date FROM answers",
)
def _(spark, d):
    return answers(spark, d).select(*KEY_COLS, "value", safe_date(F.col("value")).alias("date"))


@query(
    "d08_free_and_quantity_rows",
    f"WITH {RATED} SELECT isfree AS free, valid_final, count(*) AS n, count(value_num) AS n_num, count(value_date) AS n_date, count(unit_final) AS n_unit FROM final GROUP BY ALL",
)
def _(spark, d):
    free = F.coalesce(F.col("type_standard").isin(U.UNITLESS_TYPES), F.lit(False))
    return traced(spark, d).groupBy(free.alias("free"), "valid_final").agg(
        F.count(F.lit(1)).alias("n"), F.count("value_num").alias("n_num"), F.count("value_date").alias("n_date"), F.count("unit_final").alias("n_unit")
    )


# What each unit text means, by hand: name and multiplier over and under the line, dimension and factor (rates into USD known
# for EUR, GBP, CHF and SEK). Written from the meaning of the texts, not from the tables of the code.
READINGS = """
  ('€m', 'EUR', 1e6, NULL, 1, 'currency', 1), ('mio.EUR', 'EUR', 1e6, NULL, 1, 'currency', 1), ('k$', 'USD', 1e3, NULL, 1, 'currency', 1),
  ('tonnes of CO2 equivalents', 'tCO2e', 1, NULL, 1, 'mass', 1e6), ('million tonnes CO2e', 'tCO2e', 1e6, NULL, 1, 'mass', 1e6),
  ('MWh/EURm', 'MWh', 1, 'EUR', 1e6, 'energy/currency', 3.6e9), ('m³/USD', 'cubic_meter', 1, 'USD', 1, 'volume/currency', 1),
  ('tCO2e/year', 'tCO2e', 1, 'year', 1, NULL, NULL), ('hundredthousand t', 'thousandt', 100, NULL, 1, NULL, NULL),
  ('1000 CHF', '1000CHF', 1, NULL, 1, NULL, NULL), ('%', '%', 1, NULL, 1, 'ratio', 0.01), ('per cent', 'percent', 1, NULL, 1, 'ratio', 0.01),
  ('acres', 'acres', 1, NULL, 1, NULL, NULL), ('USD', 'USD', 1, NULL, 1, 'currency', 1), ('EUR million', 'EUR', 1e6, NULL, 1, 'currency', 1),
  ('USD thousands', 'USD', 1e3, NULL, 1, 'currency', 1), ('£bn', 'GBP', 1e9, NULL, 1, 'currency', 1), ('CHF', 'CHF', 1, NULL, 1, 'currency', 1),
  ('JPY', 'JPY', 1, NULL, 1, NULL, NULL), ('ktCO2e', 'ktCO2e', 1, NULL, 1, 'mass', 1e9), ('kg CO2e', 'kgCO2e', 1, NULL, 1, 'mass', 1e3),
  ('tCO₂', 'tCO2e', 1, NULL, 1, 'mass', 1e6), ('Mt CO2eq', 'MtCO2e', 1, NULL, 1, 'mass', 1e12), ('metric tons of CO2e', 'tCO2e', 1, NULL, 1, 'mass', 1e6),
  ('kilotonnes CO2', 'ktCO2e', 1, NULL, 1, 'mass', 1e9), ('kgCO2eq', 'kgCO2eq', 1, NULL, 1, NULL, NULL), ('GWh', 'GWh', 1, NULL, 1, 'energy', 3.6e12),
  ('kWh', 'kWh', 1, NULL, 1, 'energy', 3.6e6), ('TJ', 'TJ', 1, NULL, 1, 'energy', 1e12), ('million kWh', 'kWh', 1e6, NULL, 1, 'energy', 3.6e6),
  ('tCO2e/USD million', 'tCO2e', 1, 'USD', 1e6, 'mass/currency', 1e6), ('cubic meters', 'cubic_meter', 1, NULL, 1, 'volume', 1),
  ('t', 't', 1, NULL, 1, 'mass', 1e6), ('tonnes', 'tonnes', 1, NULL, 1, 'mass', 1e6), ('kg', 'kg', 1, NULL, 1, 'mass', 1e3), ('ha', 'ha', 1, NULL, 1, 'area', 1e4),
  ('km2', 'km2', 1, NULL, 1, 'area', 1e6), ('Percent', 'Percent', 1, NULL, 1, 'ratio', 0.01), ('hours', 'hours', 1, NULL, 1, 'time', 3600),
  ('days', 'days', 1, NULL, 1, 'time', 86400), ('years', 'years', 1, NULL, 1, 'time', 31557600), ('', '', 1, NULL, 1, NULL, NULL),
  ('people', 'people', 1, NULL, 1, NULL, NULL), ('billions of SEK', 'SEK', 1e9, NULL, 1, 'currency', 1), ('MWh/t', 'MWh', 1, 't', 1, NULL, NULL),
  ('/USD', '', 1, 'USD', 1, NULL, NULL), ('GJ / kEUR', 'GJ', 1, 'EUR', 1e3, 'energy/currency', 1e9)"""


@query(
    "d17_unit_readings",
    f"""WITH {ANSWERS}, reading(unit, name_num, times_num, name_den, times_den, dimension, factor) AS (VALUES {READINGS})
  SELECT unit, count(*) AS n, name_num, CAST(times_num AS DOUBLE) AS times_num, name_den, CAST(times_den AS DOUBLE) AS times_den, dimension, CAST(factor AS DOUBLE) AS factor
  FROM answers JOIN reading USING (unit) GROUP BY ALL""",
)
def _(spark, d):
    texts = answers(spark, d).where("unit IS NOT NULL").groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    read = resolve_units(texts, "unit", fx_long(fx_wide(spark)).select("currency").distinct())
    times = lambda side: (F.col(f"multiplier_{side}") * F.col(f"suffix_{side}")).alias(f"times_{side}")
    return read.select("unit", "n", F.col("unified_num").alias("name_num"), times("num"), F.col("unified_den").alias("name_den"), times("den"), "dimension", "factor")


@query(
    "d14_fx_wide_to_long",
    f"WITH fx(year, currency, rate) AS (VALUES {S.values(_FX_ROWS)}) SELECT fx.year, currency, CAST(rate AS DOUBLE) AS rate, count(*) AS n_orders FROM fx JOIN orders ON year(o_orderdate) = fx.year GROUP BY ALL",
)
def _(spark, d):
    long = fx_long(fx_wide(spark))
    per_year = S.read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n_orders"))
    return long.join(per_year, "year").select("year", "currency", "rate", "n_orders")


@query(
    "d21_harmonised_rows",
    f"WITH {RATED} SELECT {KEYS}, year, indicator, type_standard, value_num, value_date, unit_final, valid_final AS valid FROM final",
)
def _(spark, d):
    return harmonise(answers(spark, d), types(spark), fx_long(fx_wide(spark)), texts=unit_texts(spark, d))
