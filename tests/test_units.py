"""Unit harmonisation on hand-made rows."""

import pytest

from firmlens.functions import units as U
from firmlens.operators.harmonise import fx_long, harmonise, safe_date, safe_number

TYPES = [*U.TARGETS, *U.UNITLESS_TYPES]
FX = [(2020, 1.2, 1.1)]

# type, value, unit, valid before -> value_num, unit_final, valid
CASES = [
    ("USD", "2.5", "€m", True, 2.5e6 * 1.2, "USD", True),
    ("USD", "3", "mio.EUR", False, 3e6 * 1.2, "USD", True),
    ("USD", "4", "k$", True, 4e3, "USD", True),
    ("USD", "4", "EUR million", True, 4e6 * 1.2, "USD", True),
    ("USD", "4", "CHF thousands", True, 4e3 * 1.1, "USD", True),
    ("USD", "4", "GBP", True, None, None, False),  # no rate for the pound here
    ("USD", "4", "1000 CHF", True, None, None, False),
    ("USD", "4", None, True, None, None, False),
    ("USD", None, None, True, None, None, True),
    ("USD", "n/a", "USD", True, None, None, False),
    ("tCO2e", "7", "tonnes of CO2 equivalents", True, 7.0, "tCO2e", True),
    ("tCO2e", "7", "million tonnes CO2e", True, 7e6, "tCO2e", True),
    ("tCO2e", "7", "ktCO2e", True, 7e3, "tCO2e", True),
    ("tCO2e", "7", "kg CO₂", True, 7e-3, "tCO2e", True),
    ("tCO2e", "7", "kgCO2eq", True, None, None, False),  # not a listed kilogram spelling
    ("tCO2e", "7", "Mt CO2eq", True, 7e6, "tCO2e", True),
    ("tCO2e", "7", "tonnes", True, 7.0, "tCO2e", True),
    ("tCO2e", "7", "tCO2e/year", True, None, None, False),
    ("tCO2e", "7", "MWh", True, None, None, False),
    ("tonnes", "7", "hundredthousand t", True, None, None, False),
    ("tonnes", "7", "kg", True, 7e-3, "metric_ton", True),
    ("MWh", "36", "GJ", True, 10.0, "MWh", True),
    ("MWh", "2", "million kWh", True, 2e3, "MWh", True),
    (U.ENERGY_PER_USD, "6", "MWh/EURm", True, 6 / 1.2e6, "MWh_per_USD", True),
    (U.CO2_PER_USD, "6", "tCO2e/USD million", True, 6e-6, "tCO2e_per_USD", True),
    (U.VOLUME_PER_USD, "6", "m³/USD", True, 6.0, "cubic_meter_per_USD", True),
    (U.ENERGY_PER_USD, "6", "MWh/t", True, None, None, False),
    ("m3", "6", "cubic meters", True, 6.0, "cubic_meter", True),
    ("m3", "6", "litres", True, 6e-3, "cubic_meter", True),
    ("hectares", "6", "km²", True, 600.0, "hectare", True),
    ("hectares", "6", "acres", True, None, None, False),
    ("hours", "2", "days", True, 48.0, "hour", True),
    ("years", "731", "days", True, 731 / 365.25, "year", True),
    ("percent", "0.5", None, True, 50.0, "percent", True),
    ("percent", "50", "%", True, 50.0, "percent", True),
    ("percent", "50", "per cent", True, 50.0, "percent", True),
    ("percent", "none", "%", True, None, None, False),
    ("integer", "1_000", "people", True, 1000.0, None, True),
    ("integer", "1,000", None, True, None, None, False),
    ("decimal", " 2.5 ", "x", False, None, None, False),
    ("decimal", "1.0d", None, True, None, None, False),
    ("decimal", "nan", None, True, None, None, True),
]


def run(spark, cases, fx, **kw):
    rows = [(i, TYPES.index(c[0]), 2020, c[1], c[2], c[3]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, indicator int, year int, value string, unit string, valid boolean")
    types = spark.createDataFrame(list(enumerate(TYPES)), "indicator int, type_standard string")
    return {r["id"]: r for r in harmonise(df, types, fx, **kw).collect()}


def rates(spark):
    return fx_long(spark.createDataFrame(FX, "p int, e double, c double").toDF("Time Period", "EUR/USD", "CHF/USD"))


def test_cases(spark):
    got = run(spark, CASES, rates(spark))
    for i, case in enumerate(CASES):
        value, unit, valid = case[4:]
        r = got[i]
        assert (r["unit_final"], r["valid"]) == (unit, valid), case
        assert r["value_num"] is None if value is None else r["value_num"] == pytest.approx(value, rel=1e-12), case


def test_dates(spark):
    cases = [("date", v, "x", True) for v in ("2023-01-05", "2023-1-5", "2023-13-05", "2023-01-05 ", None)]
    got = run(spark, cases, None)
    assert [str(got[i]["value_date"]) if got[i]["valid"] else None for i in range(5)] == ["2023-01-05", "2023-01-05", None, None, None]


def test_without_rates_each_currency_keeps_its_own(spark):
    cases = [("USD", "2", "€m", True), ("USD", "2", "1000 CHF", True), ("USD", "2", "CHF", True), (U.ENERGY_PER_USD, "6", "GJ/GBP", True), ("MWh", "2", "EUR", True)]
    got = run(spark, cases, None)
    assert [(got[i]["value_num"], got[i]["unit_final"], got[i]["valid"]) for i in range(5)] == [
        (2e6, "EUR", True),
        (None, None, False),
        (2.0, "CHF", True),
        (pytest.approx(6 / 3.6), "MWh_per_GBP", True),
        (None, None, False),
    ]


def test_missing_rate_year_is_invalid(spark):
    df = spark.createDataFrame([(0, 1990, "2", "EUR", True)], "indicator int, year int, value string, unit string, valid boolean")
    types = spark.createDataFrame([(0, "USD")], "indicator int, type_standard string")
    r = harmonise(df, types, rates(spark)).first()
    assert (r["value_num"], r["unit_final"], r["valid"]) == (None, None, False)


def test_round_trip_of_every_alias(spark):
    """Each simple alias converts to its target and back to the same value."""
    target = {d: t for t, (d, _, _) in U.TARGETS.items() if d in ("mass", "energy", "time", "area", "volume")}
    cases, factors = [], []
    for alias, dim, factor, _ in U.unit_aliases():
        if dim in target and "/" not in alias:
            cases.append((target[dim], "8", alias, True))
            factors.append(factor / U.TARGETS[target[dim]][1])
    got = run(spark, cases, rates(spark))
    for i, f in enumerate(factors):
        if got[i]["valid"]:
            assert got[i]["value_num"] / f == pytest.approx(8.0), cases[i]
    assert sum(got[i]["valid"] for i in range(len(cases))) > 0.95 * len(cases)


def test_safe_number_and_date(spark):
    from pyspark.sql import functions as F

    texts = ["1,234,567", "None", "nan", "1.0d", " 2.5 ", "1_000", "-3e2", ".5", "5.", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(safe_number(F.col("t"))).collect()]
    assert got == [None, None, None, None, 2.5, None, -300.0, 0.5, 5.0, None]
    assert df.select(safe_date(F.lit("0000-00-00"))).first()[0] is None


def test_second_rate_stops_the_job(spark):
    twice = rates(spark).union(rates(spark))
    with pytest.raises(Exception, match="two rates"):
        run(spark, CASES, twice)


# unit text (lower case, no spaces) -> dimension and factor in gram, metre, second, joule
EXPRESSIONS = {
    "m^3": ("volume", 1), "m**3": ("volume", 1), "m**2": ("area", 1), "m^2": ("area", 1), "km^2": ("area", 1e6), "km**2": ("area", 1e6), "cm^3": ("volume", 1e-6),
    "1000kg": ("mass", 1e6), "1000t": ("mass", 1e9), "10^3kg": None, "1e3kg": ("mass", 1e6), "1.5kg": ("mass", 1500), "0.5l": ("volume", 5e-4), "1000m3": ("volume", 1e3),
    "1000m^3": ("volume", 1e3), "1000*m^3": ("volume", 1e3), "10*100kg": ("mass", 1e6), "kg*m^2*s^-2": ("energy", 1), "kg·m²·s⁻²": ("energy", 1), "kg*m2*s^-2": ("energy", 1),
    "wh*h^-1*h": ("energy", 3600), "1000mwh": ("energy", 3.6e12), "100gj": ("energy", 1e11), "m*m": ("area", 1), "m·m·m": ("volume", 1), "m×km": ("area", 1e3),
    "ha*m": ("volume", 1e4), "m³": ("volume", 1), "km³": ("volume", 1e9), "m²": ("area", 1), "m⁻²*m⁴": ("area", 1), "1000hours": ("time", 3.6e6), "24h": ("time", 86400), "365days": ("time", 31536000),
    "100%": ("ratio", 1), "10ppm": ("ratio", 1e-5), "t*t^-1": ("ratio", 1), "kg*t^-1": ("ratio", 1e-3), "g^1": ("mass", 1), "t^+1": ("mass", 1e6), "1000tco2e": ("mass", 1e9),
    "100l": ("volume", 0.1), "l^1": ("volume", 1e-3), "cm*m": ("area", 1e-2),
    "": None, "1000": None, "acre": None, "1000acres": None, "m^": None, "m^^2": None, "m^2.5": None, "kgm": None, "kg1000": None, "*kg": None, "kg*": None, "kg**": None, "kg*s": None, "m^99": None,
    "0kg": None, "1000chf": None, "1000usd": None, "k": None, "m//s": None, "1e": None, "2 kg": None, "(kg)": None, "1e999kg": None, "m^0": ("ratio", 1),
}


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_unit_expression(text):
    got, want = U.unit_expression(text), EXPRESSIONS[text]
    assert (got is None) == (want is None) and (got is None or (got[0] == want[0] and got[1] == pytest.approx(want[1], rel=1e-12))), got


def test_expressions_agree_with_the_aliases():
    for alias, dim, factor, _ in U.unit_aliases():
        got = U.unit_expression(f"10*{alias}")
        assert got is None or (got[0] == dim and got[1] == pytest.approx(10 * factor)), alias


def test_expressions_in_rows(spark):
    rows = [("m3", "2", "m^3", True), ("tonnes", "2", "1000 kg", True), ("hectares", "3", "m**2", True), ("tonnes", "1", "kg*s", True), (U.VOLUME_PER_USD, "1", "1000 m^3/USD", True), (U.CO2_PER_USD, "1", "1000kg/USD", True)]
    table = spark.createDataFrame([(i, t, 2020, v, u, ok) for i, (t, v, u, ok) in enumerate(rows)], "indicator int, type string, year int, value string, unit string, valid boolean")
    types = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "indicator int, type_standard string")
    fx = spark.createDataFrame([(2020, "EUR", 1.2)], "year int, currency string, rate double")
    got = {r["indicator"]: (r["value_num"], r["valid"]) for r in harmonise(table.drop("type"), types, fx).collect()}
    assert got[0] == (2.0, True) and got[1] == (2.0, True) and got[2] == (pytest.approx(3e-4), True) and got[3] == (None, False)
    assert got[4] == (1000.0, True) and got[5] == (None, False)

