"""Unit tables: aliases with dimension and factor, targets per indicator type, scale words.

Alias keys are lower case. The alias table is generated from the unit list and
the prefixes; units outside the list are unknown on purpose. CO2 equivalents
count as mass, so tonnes and tCO2e convert one to one. Products and powers of
listed units, with numbers before them, are evaluated by ``unit_expression``.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

# Scale words in the order they are tried.
SCALE_WORDS = {
    "hundred": 1e2,
    "thousand": 1e3,
    "million": 1e6,
    "billion": 1e9,
    "trillion": 1e12,
}
SCALE_SUFFIXES = ["sof", "s", ""]
# Letter magnitudes around a currency, currency codes and symbols.
MAGNITUDES = {"k": 1e3, "m": 1e6, "mio": 1e6, "mio.": 1e6, "mn": 1e6, "b": 1e9, "bn": 1e9, "t": 1e12, "tn": 1e12}
CURRENCIES = ["EUR", "USD", "GBP", "BRL", "CAD", "CNY", "DKK", "NOK", "SEK", "SGD", "CHF", "PLN"]
SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP"}
# Spellings of cubic and square metres.
CUBIC = ["m3", "m³", "cubicmeter", "cubicmeters"]
SQUARE = ["m2", "m²", "squaremeter", "squaremeters"]
# Indicator types without a unit, as plain numbers, and with a required unit.
UNITLESS_TYPES = ["integer", "decimal", "date"]
NUMBER_TYPES = ["integer", "decimal", "percent"]
ENERGY_PER_USD = "energy consumed per monetary unit (USD)"
CO2_PER_USD = "CO2 equivalent emissions per monetary unit (USD)"
SIGNED_USD = "USD (with indication of whether the amount is increased (+) or decreased (-))"
VOLUME_PER_USD = "volume consumed per monetary unit (USD)"
UNIT_TYPES = ["years", "USD", "tCO2e", "MWh", ENERGY_PER_USD, CO2_PER_USD, SIGNED_USD, "tonnes", "m3", VOLUME_PER_USD, "hectares", "hours"]
PERCENT_WORDS = ["%", "percent", "per cent"]
EXCLUDED_UNIT = "1000 CHF"  # no-rate variant only

HOUR, YEAR = 3600.0, 365.25 * 86400.0
# type -> (dimension, factor, unit name); base units are gram, joule, second, m2, m3, USD
TARGETS = {
    "years": ("time", YEAR, "year"),
    "percent": ("ratio", 0.01, "percent"),
    "USD": ("currency", 1.0, "USD"),
    SIGNED_USD: ("currency", 1.0, "USD"),
    "tCO2e": ("mass", 1e6, "tCO2e"),
    "tonnes": ("mass", 1e6, "metric_ton"),
    "MWh": ("energy", 3.6e9, "MWh"),
    ENERGY_PER_USD: ("energy/currency", 3.6e9, "MWh_per_USD"),
    CO2_PER_USD: ("mass/currency", 1e6, "tCO2e_per_USD"),
    "m3": ("volume", 1.0, "cubic_meter"),
    VOLUME_PER_USD: ("volume/currency", 1.0, "cubic_meter_per_USD"),
    "hectares": ("area", 1e4, "hectare"),
    "hours": ("time", HOUR, "hour"),
}

_LARGE = {"kilo": ("k", 1e3), "mega": ("m", 1e6), "giga": ("g", 1e9), "tera": ("t", 1e12), "peta": ("p", 1e15)}
_SMALL = {"centi": ("c", 1e-2), "milli": ("m", 1e-3)}
# dimension, factor, names, symbols, prefixed, may stand over a currency
_BASE = [
    ("mass", 1e6, ["metric_ton", "tonne", "ton", "metricton"], ["t"], True, False),
    ("mass", 1.0, ["gram"], ["g"], True, False),
    ("mass", 1.0, [], ["gco2e"], True, True),
    ("mass", 1e6, [], ["tco2e"], True, True),
    ("energy", 3600.0, ["watt_hour", "watthour"], ["wh"], True, True),
    ("energy", 1.0, ["joule"], ["j"], True, True),
    ("energy", 4.184, ["calorie"], ["cal"], True, False),
    ("energy", 1055.056, ["british_thermal_unit"], ["btu"], True, False),
    ("energy", 1055.056e5, ["therm"], ["thm"], False, False),
    ("energy", 4.1868e10, ["tonne_of_oil_equivalent"], ["toe"], True, False),
    ("time", 1.0, ["second", "sec"], ["s"], False, False),
    ("time", 60.0, ["minute"], ["min"], False, False),
    ("time", HOUR, ["hour", "hr"], ["h"], False, False),
    ("time", 86400.0, ["day"], ["d"], False, False),
    ("time", 7 * 86400.0, ["week"], [], False, False),
    ("time", 14 * 86400.0, ["fortnight"], [], False, False),
    ("time", YEAR / 12, ["month"], [], False, False),
    ("time", YEAR, ["year", "yr"], ["a"], False, False),
    ("time", 100 * YEAR, ["century"], ["centuries"], False, False),
    ("area", 1e4, ["hectare"], ["ha"], False, False),
    ("area", 1e2, ["are"], [], False, False),
    ("area", 1.0, ["square_meter"], ["m2", "m²"], False, False),
    ("area", 1e6, ["square_kilometer"], ["km2", "km²"], False, False),
    ("volume", 1.0, ["cubic_meter"], ["m3", "m³"], False, True),
    ("volume", 1.0, ["stere"], [], False, False),
    ("volume", 1e-3, ["liter", "litre"], ["l"], True, False),
    ("volume", 1e-6, ["cubic_centimeter"], ["cc"], False, False),
    ("length", 1.0, ["meter", "metre"], ["m"], True, False),
    ("ratio", 0.01, ["percent"], ["%"], False, False),
    ("ratio", 0.001, ["permille"], ["‰"], False, False),
    ("ratio", 1e-6, [], ["ppm"], False, False),
]


def unit_aliases() -> list[tuple[str, str, float, bool]]:
    """(alias, dimension, factor, may stand over a currency); plain names win over
    prefixed ones and large prefixes over small ones."""
    out: dict[str, tuple[str, float, bool]] = {}

    def add(alias, dimension, factor, over):
        out.setdefault(alias, (dimension, factor, over))

    for dimension, factor, names, symbols, _, over in _BASE:
        for n in names:
            add(n, dimension, factor, over)
            add(n + "s", dimension, factor, over)
        for s in symbols:
            add(s, dimension, factor, over)
    for prefixes in (_LARGE, _SMALL):
        for dimension, factor, names, symbols, prefixed, over in _BASE:
            if not prefixed:
                continue
            for word, (letter, scale) in prefixes.items():
                for n in names:
                    add(word + n, dimension, factor * scale, over)
                    add(word + n + "s", dimension, factor * scale, over)
                for s in symbols:
                    add(letter + s, dimension, factor * scale, over)
    return [(alias, *row) for alias, row in out.items()]


#: dimension -> exponents of gram, metre and second, and its unit in these
_EXPONENTS = {
    "mass": ((1, 0, 0), 1.0),
    "length": ((0, 1, 0), 1.0),
    "area": ((0, 2, 0), 1.0),
    "volume": ((0, 3, 0), 1.0),
    "time": ((0, 0, 1), 1.0),
    "energy": ((1, 2, -2), 1000.0),
    "ratio": ((0, 0, 0), 1.0),
}
_RAISED = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")
_FACTOR = re.compile(r"(?P<number>\d+(?:\.\d+)?(?:e[+-]?\d+)?)|(?P<name>[^\W\d⁰¹²³⁴-⁹]+(?:\d[^\W\d⁰¹²³⁴-⁹]+)*[23]?|[%‰])(?:(?:\^|\*\*)(?P<power>[+-]?\d+)|(?P<raised>⁻?[⁰¹²³⁴-⁹]+))?")
MOST_POWER = 9


@lru_cache(maxsize=1)
def _coherent() -> dict[str, tuple[tuple[int, int, int], float]]:
    """Alias -> exponents and factor in gram, metre, second."""
    return {alias: (_EXPONENTS[dim][0], factor * _EXPONENTS[dim][1]) for alias, dim, factor, _ in unit_aliases() if dim in _EXPONENTS}


def unit_expression(text: str | None) -> tuple[str, float] | None:
    """(dimension, factor) of numbers and listed units with whole powers, multiplied by ``*``, ``·``, ``×``, or a number right before a unit.

    ``text`` is lower case without white space. None if it does not fit, names an unlisted unit, or has no named dimension.
    """
    at, exponents, factor, follows = 0, [0, 0, 0], 1.0, False
    text, units, known = text or "", 0, _coherent()
    while at < len(text):
        if at and text[at] in "*·⋅×" and at + 1 < len(text):
            at, follows = at + 1, False
        m = _FACTOR.match(text, at)
        # two factors side by side only as a number before a unit
        if not m or (follows and not (m["name"] and follows == "number")):
            return None
        if m["number"]:
            factor, follows = factor * float(m["number"]), "number"
        else:
            power = int(m["power"] or (m["raised"] or "1").translate(_RAISED))
            if m["name"] not in known or abs(power) > MOST_POWER:
                return None
            own, scale = known[m["name"]]
            exponents = [e + power * o for e, o in zip(exponents, own)]
            factor, follows, units = factor * scale**power, "unit", units + 1
        at = m.end()
    found = next((dim for dim, (own, _) in _EXPONENTS.items() if list(own) == exponents), None)
    if not units or found is None or not (0 < factor < math.inf):
        return None
    return found, factor / _EXPONENTS[found][1]


def currency_pattern() -> str:
    """Prefix magnitude, currency, suffix magnitude; the caller excludes digits."""
    magnitude = "|".join(m.replace(".", r"\.") for m in MAGNITUDES)
    money = "|".join([*CURRENCIES, *[s.replace("$", r"\$") for s in SYMBOLS]])
    return f"^({magnitude})?({money})({magnitude})?$"


# Spellings of CO2 equivalents, largest unit first.
_CO2 = "CO[2²₂]"
_TAIL = "(e(q(uivalent)?)?s?)?"
CO2E_PATTERNS = {
    f"{large}tCO2e": rf"(((metric\s?)?{word}ton(ne)?s?\s?(of\s?)?)|{large}t){_CO2}{_TAIL}"
    for large, word in (("G", "giga"), ("M", "mega"), ("k", "kilo"), ("", ""))
}
CO2E_PATTERNS["kgCO2e"] = rf"(kg|kilograms?|kilos?)\s?(of\s?)?{_CO2}(e(quivalent)?s?)?"
