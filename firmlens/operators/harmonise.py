"""Value and unit harmonisation: projections and lookups, no shuffle of the rows.

``harmonise`` takes (indicator, year, value, unit, valid) text rows and returns
``value_num`` / ``value_date`` / ``unit_final`` / ``valid``. Types, rates and unit
aliases are small tables. Without a rate table every currency is a dimension of
its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions import units as U
from firmlens.operators.scale import join_on, local_table, settle
from firmlens.session import cut_lineage

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WORD_BEFORE, WORD_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
UNIT_TEXTS = 20_000  # distinct unit texts to broadcast with all that is read from them: some MB
STEPS = [
    "type_standard", "unit_kept", "value_kept", "number", "date", "numerator", "denominator", "multiplier_num", "unit_num",
    "multiplier_den", "unit_den", "unified_num", "suffix_num", "unified_den", "suffix_den", "usd_num", "usd_den", "rate_num",
    "rate_den", "unit_key", "dimension", "factor", "value_scaled",
]


def safe_number(text: Column, underscores: bool = False) -> Column:
    """Text as double, null unless all of it is one plain number ('nan', '1.0d' are not)."""
    trimmed = F.btrim(text, F.lit(" \t\n\r\f\v"))
    if underscores:
        trimmed = F.when(F.contains(trimmed, F.lit("_")), F.regexp_replace(trimmed, r"(?<=\d)_(?=\d)", "")).otherwise(trimmed)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def safe_date(text: Column) -> Column:
    """Text in the form year-month-day as date, null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.to_date(F.try_to_timestamp(text, F.lit("yyyy-M-d"))))


def scale_word(unit: Column) -> tuple[Column, Column]:
    """(multiplier, unit without the word) for the first listed scale word contained."""
    listed = {w + s: m for w, m in U.SCALE_WORDS.items() for s in U.SCALE_SUFFIXES}
    sizes = F.create_map(*[F.lit(x) for x in chain.from_iterable(listed.items())])
    word = F.get(F.filter(F.array(*[F.lit(w) for w in listed]), lambda w: F.contains(F.lower(unit), w)), F.lit(0))
    rest = F.regexp_replace(unit, F.concat(F.lit("(?i)"), word), F.lit(""))
    return F.coalesce(F.try_element_at(sizes, word), F.lit(1.0)), F.when(word.isNull(), unit).otherwise(rest)


def currency_parts(unit: Column) -> tuple[Column, Column]:
    """(currency code, letter magnitude) of units like 'kUSD' or '€m'; nulls otherwise."""
    pattern = "(?iu)" + U.currency_pattern()
    hit = unit.rlike(pattern) & ~unit.rlike(r"\d")
    magnitudes = F.create_map(*[F.lit(x) for x in chain.from_iterable(U.MAGNITUDES.items())])
    symbols = F.create_map(*[F.lit(x) for x in chain.from_iterable(U.SYMBOLS.items())])

    def size(group):
        return F.coalesce(F.try_element_at(magnitudes, F.lower(F.regexp_extract(unit, pattern, group))), F.lit(1.0))

    money = F.regexp_extract(unit, pattern, 2)
    code = F.coalesce(F.try_element_at(symbols, money), F.upper(money))
    return F.when(hit, code), F.when(hit, size(1) * size(3))


def unified(unit: Column) -> tuple[Column, Column]:
    """(unit name, letter magnitude): CO2e spellings, metres, currencies; others unchanged."""
    name = None
    for target, pattern in U.CO2E_PATTERNS.items():
        hit = unit.rlike("(?iu)" + WORD_BEFORE + pattern + WORD_AFTER)
        name = F.when(hit, target) if name is None else name.when(hit, target)
    name = name.when(F.lower(unit).isin(U.CUBIC), "cubic_meter").when(F.lower(unit).isin(U.SQUARE), "square_meter")
    code, size = currency_parts(unit)
    fixed = name.otherwise(F.lit(None).cast("string"))
    return F.coalesce(fixed, code, unit), F.when(fixed.isNull(), F.coalesce(size, F.lit(1.0))).otherwise(1.0)


def fx_long(wide: DataFrame, period: str = "Time Period", suffix: str = "/USD") -> DataFrame:
    """Wide rate table to (year, currency, rate)."""
    rates = [c for c in wide.columns if c != period]
    named = wide.select(F.col(f"`{period}`").cast("int").alias("year"), *[F.col(f"`{c}`").cast("double").alias(c.replace(suffix, "")) for c in rates])
    codes = [c.replace(suffix, "") for c in rates]
    return named.unpivot("year", codes, "currency", "rate").where(F.col("rate").isNotNull())


def unit_key(num: Column, den: Column) -> Column:
    """'num', 'num_per_den', 'per_den' or null."""
    return F.when(den.isNull(), num).when(num.isNull(), F.concat(F.lit("per_"), den)).otherwise(F.concat_ws("_per_", num, den))


#: dimensions of unit expressions that may stand over a currency
OVER_CURRENCY = ("energy", "volume")


def expressions(unit: Column) -> Column:
    """(dim, fac) of unit expressions such as ``1000kg`` or ``m^3``; for tables of distinct texts."""

    @F.pandas_udf("dim string, fac double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [U.unit_expression(t) if isinstance(t, str) else None for t in texts]
            yield pd.DataFrame({"dim": [f and f[0] for f in found], "fac": [f and f[1] for f in found]}).astype({"dim": object, "fac": float})

    return of(F.lower(unit))


def resolve_units(df: DataFrame, text: str, quoted: DataFrame | None) -> DataFrame:
    """Add every unit column to rows holding unit text in ``text``.

    ``quoted`` lists the currencies with a rate into USD; None makes each
    currency a dimension of its own.
    """
    col = F.col
    halves = F.split(F.regexp_replace(col(text), r"[\s\p{Z}]+", ""), "/")
    t = df.withColumn("__halves", halves)
    t = t.withColumns({"numerator": F.get("__halves", F.lit(0)), "denominator": F.get("__halves", F.lit(1))}).drop("__halves")
    for part, side in (("numerator", "num"), ("denominator", "den")):
        multiplier, rest = scale_word(col(part))
        t = t.withColumns({f"multiplier_{side}": multiplier, f"unit_{side}": rest})
    for side in ("num", "den"):
        name, size = unified(col(f"unit_{side}"))
        t = t.withColumns({f"unified_{side}": name, f"suffix_{side}": size})
        if quoted is None:
            t = t.withColumns({f"usd_{side}": col(f"unified_{side}"), f"quoted_{side}": F.lit(False)})
            continue
        listed = quoted.select(col("currency").alias("__c"))
        t = t.join(listed, col(f"unified_{side}") == col("__c"), "left").withColumn(f"quoted_{side}", col("__c").isNotNull()).drop("__c")
        t = t.withColumn(f"usd_{side}", F.when(col(f"quoted_{side}"), "USD").otherwise(col(f"unified_{side}")))
    if quoted is None:
        money = [(c.lower(), f"currency:{c}", 1.0, False) for c in U.CURRENCIES]
    else:
        money = [("usd", "currency", 1.0, False), ("$", "currency", 1.0, False)]
    aliases = local_table(df.sparkSession, U.unit_aliases() + money, "alias string, dim string, fac double, over boolean")
    upper = aliases.select(*[col(c).alias(f"__n_{c}") for c in aliases.columns])
    lower = aliases.where(col("dim").startswith("currency") & (col("alias") != "$")).select(
        col("alias").alias("__d_alias"), col("dim").alias("__d_dim")
    )
    t = t.join(upper, F.lower("usd_num") == col("__n_alias"), "left").join(lower, F.lower("usd_den") == col("__d_alias"), "left")
    # what no alias names may be an expression of them
    t = t.withColumn("__e", expressions(F.when(col("__n_alias").isNull(), col("usd_num"))))
    named = {"__n_dim": F.coalesce("__n_dim", "__e.dim"), "__n_fac": F.coalesce("__n_fac", "__e.fac"), "__n_over": F.coalesce("__n_over", col("__e.dim").isin(*OVER_CURRENCY))}
    t = t.withColumns(named).drop("__e")
    ratio = F.when(col("__n_over") & col("__d_dim").isNotNull(), F.concat_ws("/", "__n_dim", "__d_dim"))
    t = t.withColumns(
        {"unit_key": unit_key(col("usd_num"), col("usd_den")), "dimension": F.when(col("usd_den").isNull(), col("__n_dim")).otherwise(ratio)}
    )
    t = t.withColumns(
        {
            "factor": F.when(col("dimension").isNotNull(), col("__n_fac")),
            "kind": F.regexp_replace("dimension", r":[A-Z]+$", ""),
            "currency": F.nullif(F.regexp_extract("dimension", r"currency:([A-Z]+)$", 1), F.lit("")),
        }
    )
    return t.drop(*[f"__n_{c}" for c in aliases.columns], "__d_alias", "__d_dim")


def with_units(rows: DataFrame, text: str, units: DataFrame, quoted: DataFrame | None) -> DataFrame:
    """Unit columns for every row. Unit texts repeat, so each distinct text of
    ``units`` is parsed once, settled and looked up. Up to ``UNIT_TEXTS`` of them are
    broadcast, so the rows, many of them without a unit, stay where they are."""
    texts = cut_lineage(units.toDF(text))
    return join_on(rows, settle(resolve_units(texts, text, quoted), UNIT_TEXTS), [text], "left")


def rate_table(fx: DataFrame) -> DataFrame:
    """One rate per (year, currency); a second one stops the job."""
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two rates for a year and currency"))).otherwise(F.first("rate"))
    return fx.groupBy("year", "currency").agg(one.cast("double").alias("rate"))


def typed_indicators(types: DataFrame) -> DataFrame:
    """The indicator table with what its type asks for, so that rows carry flags instead of type names."""
    kind, no = F.col("type_standard"), F.lit(False)
    targets = local_table(types.sparkSession, [(k, *v) for k, v in U.TARGETS.items()], "__type string, __tdim string, __tfac double, __tunit string")
    flags = {
        "__number": kind.isin(U.NUMBER_TYPES),
        "__percent": kind == "percent",
        "__date": kind == "date",
        "__free": kind.isin(U.UNITLESS_TYPES),
        "__needs": kind.isin(U.UNIT_TYPES),
    }
    flagged = types.select("indicator", "type_standard").withColumns({name: F.coalesce(flag, no) for name, flag in flags.items()})
    return flagged.join(targets, kind == F.col("__type"), "left").drop("__type")


def harmonise(df: DataFrame, types: DataFrame, fx: DataFrame | None, trace: bool = False, texts: DataFrame | None = None) -> DataFrame:
    """Standard value and unit per row; ``trace`` keeps the intermediate columns.

    ``texts`` are the unit texts of the rows (column ``unit``, repeats and more texts do no harm), for a caller
    that has them without the joins behind ``df``; else ``df`` is evaluated once more for them.
    """
    spark, col, no = df.sparkSession, F.col, F.lit(False)
    t = df.join(settle(typed_indicators(types)), "indicator", "left")
    is_number, is_percent, is_date, is_free, needs_unit = (F.coalesce(col(f"__{f}"), no) for f in ("number", "percent", "date", "free", "needs"))

    # required units, plain numbers, percent, dates
    missing = needs_unit & col("value").isNotNull() & col("unit").isNull()
    t = t.withColumns({"unit_kept": F.when(~is_free, col("unit")), "value_kept": F.when(~missing, col("value")), "__ok": col("valid") & ~missing})
    plain = F.when(is_number, safe_number(col("value_kept"), underscores=True)).when(~is_date, safe_number(col("value_kept")))
    t = t.withColumns({"number": plain, "date": F.when(is_date, safe_date(col("value_kept")))})
    unparsed = is_number & col("value_kept").isNotNull() & col("number").isNull() & (F.lower(F.trim(col("value_kept"))) != "nan")
    unreadable = (is_percent & col("number").isNull()) | (is_date & col("date").isNull())
    has_value = F.when(is_number, col("number").isNotNull()).when(is_date, col("date").isNotNull()).otherwise(col("value_kept").isNotNull())
    bare = is_percent & col("unit_kept").isNull()
    worded = is_percent & (col("unit_kept").isNull() | F.lower("unit_kept").isin(U.PERCENT_WORDS))
    t = t.withColumns(
        {
            "__ok": col("__ok") & ~unparsed & ~unreadable,
            "__has": has_value,
            "number": F.when(bare, col("number") * 100).otherwise(col("number")),
            "__unit": F.when(has_value, F.when(worded, "percent").otherwise(col("unit_kept"))),
        }
    )

    # unit text -> dimension, factor and multipliers, then the rate of the year
    quoted = None if fx is None else fx.select("currency").distinct()
    units = (df if texts is None else texts).select("unit").union(local_table(spark, [("percent",)], "unit string")).distinct()
    t = with_units(t, "__unit", units, quoted)
    yearly = None if fx is None else rate_table(fx)
    for side in ("num", "den"):
        if yearly is None:
            t = t.withColumn(f"rate_{side}", F.lit(None).cast("double"))
            continue
        rates = yearly.toDF("__y", "__c", f"rate_{side}")
        t = t.join(rates, (col("year") == col("__y")) & (col(f"unified_{side}") == col("__c")), "left").drop("__y", "__c")

    # value in the target unit of the type
    one = F.lit(1.0)
    scaled = (
        col("number") * col("multiplier_num") * F.coalesce(col("rate_num"), one) * col("suffix_num")
        / (col("multiplier_den") * F.coalesce(col("rate_den"), one)) / col("suffix_den")
    )
    no_rate = F.coalesce((col("quoted_num") & col("rate_num").isNull()) | (col("quoted_den") & col("rate_den").isNull()), no)
    quantity = ~is_free & col("dimension").isNotNull() & col("number").isNotNull()
    matches = F.coalesce(col("kind") == col("__tdim"), no) & ~no_rate
    if fx is None:
        matches = matches & ~col("unit").eqNullSafe(U.EXCLUDED_UNIT)
    unknown_unit = col("unit_key").isNotNull() & col("dimension").isNull()
    broken = ~is_free & (unknown_unit | (col("__has") & col("number").isNull()) | no_rate)
    t = t.withColumns({"value_scaled": F.when(~is_free, scaled), "__quantity": quantity, "__fits": F.when(quantity, matches).otherwise(col("__ok") & ~broken)})
    unit_name = F.when(col("currency").isNotNull(), F.replace("__tunit", F.lit("USD"), col("currency"))).otherwise(col("__tunit"))
    value_num = F.when(is_free, col("number")).when(col("__quantity"), col("value_scaled") * col("factor") / col("__tfac"))
    results = [
        F.when(col("__fits"), value_num).alias("value_num"),
        F.when(col("__fits"), col("date")).alias("value_date"),
        F.when(col("__fits") & col("__quantity"), unit_name).alias("unit_final"),
    ]
    if trace:
        return t.select(*df.columns, *STEPS, *results, col("__fits").alias("valid_final"))
    keep = [c for c in df.columns if c not in ("value", "unit", "valid")]
    return t.select(*keep, "type_standard", *results, col("__fits").alias("valid"))
