"""Coverage of the report sample and completeness of the extracted indicators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.operators.scale import running_before, with_each
from firmlens.session import cut_lineage

MIN_TEXT_CHARACTERS = 5000


def any_of(flag: Column) -> Column:
    return F.coalesce(F.bool_or(flag), F.lit(False))


def parse_report_ids(df: DataFrame, column: str = "report_id") -> DataFrame:
    """Firm, year and type from the right of '{firm}_{year}_{type}'; other rows are dropped."""
    pattern = r"^(.*)_([+-]?\d+)_([^_]*)$"
    parts = [F.regexp_extract(column, pattern, i) for i in (1, 2, 3)]
    return (
        df.where(F.col(column).rlike(pattern))
        .select(F.col(column).alias("report_id"), parts[0].alias("firm"), parts[1].try_cast("int").alias("year"), parts[2].alias("report_type"))
        .where(F.col("year").isNotNull())
    )


def report_grid(reports: DataFrame) -> DataFrame:
    """Every firm with every year of the sample, with its reports where there are some."""
    firms = reports.select("firm").where(F.col("firm").isNotNull()).distinct()
    years = reports.select("year").where(F.col("year").isNotNull()).distinct()
    return with_each(firms, years).join(reports, ["firm", "year"], "left")


def usable_text(texts: DataFrame, min_characters: int = MIN_TEXT_CHARACTERS) -> DataFrame:
    """(firm, year, text_extracted): any text of at least the minimum after trimming."""
    long_enough = F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) >= min_characters
    return texts.groupBy("firm", "year").agg(any_of(long_enough).alias("text_extracted"))


def stage_table(grid: DataFrame, texts: DataFrame, chunk_keys: DataFrame, min_characters: int = MIN_TEXT_CHARACTERS) -> DataFrame:
    """Report, text and chunk flags per report row of the grid."""
    chunked = chunk_keys.select("firm", "year").distinct().withColumn("chunks_present", F.lit(True))
    false = F.lit(False)
    return (
        grid.join(usable_text(texts, min_characters), ["firm", "year"], "left")
        .join(chunked, ["firm", "year"], "left")
        .select(
            "firm",
            "year",
            "report_id",
            F.col("report_id").isNotNull().alias("report_available"),
            F.coalesce("text_extracted", false).alias("text_extracted"),
            F.coalesce("chunks_present", false).alias("chunks_present"),
        )
    )


def firm_year_stages(stages: DataFrame) -> DataFrame:
    """Collapse report rows to firm-years."""
    return stages.where("firm IS NOT NULL AND year IS NOT NULL").groupBy("firm", "year").agg(
        any_of(F.col("report_available")).alias("report_available"),
        any_of(F.col("text_extracted")).alias("text_extracted"),
        any_of(F.col("chunks_present")).alias("chunks_present"),
        F.sum(F.col("report_available").cast("long")).alias("n_reports_available"),
    )


def population_coverage(population: DataFrame, stages: DataFrame, by: str, value: str, years: Sequence[int]) -> DataFrame:
    """Coverage rate or report count per group, one column per year.

    Population rows without a sector are left out; null groups are dropped.
    """
    people = population.select("firm", "year", "country", "sector").distinct().where(F.col("sector").isNotNull())
    merged = people.join(firm_year_stages(stages), ["firm", "year"], "left").where(F.col(by).isNotNull())
    metric = {
        "coverage_rate": F.avg(F.coalesce(F.col("report_available"), F.lit(False)).cast("double")),
        "n_reports": F.sum(F.coalesce("n_reports_available", F.lit(0))),
    }[value]
    return merged.groupBy(by).pivot("year", list(years)).agg(metric)


def stage_funnel(stages: DataFrame) -> DataFrame:
    """Links of the funnel firm-years -> report -> text -> chunks with drop-outs, empty links left out."""
    fy = firm_year_stages(stages)
    report = F.col("report_available")
    text = report & F.col("text_extracted")
    chunk = text & F.col("chunks_present")
    counts = fy.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(report).alias("r"), F.count_if(text).alias("t"), F.count_if(chunk).alias("c")
    )
    links = [
        ("all", "report", F.col("r")),
        ("all", "no_report", F.col("n") - F.col("r")),
        ("report", "text", F.col("t")),
        ("report", "no_text", F.col("r") - F.col("t")),
        ("text", "chunks", F.col("c")),
        ("text", "no_chunks", F.col("t") - F.col("c")),
    ]
    rows = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), n.alias("n")) for a, b, n in links])
    return counts.select(F.inline(rows)).where(F.col("n") > 0)


def eligible_firm_years(stages: DataFrame) -> DataFrame:
    return firm_year_stages(stages).where(F.col("chunks_present")).select("firm", "year")


def _observations(eligible: DataFrame, results: DataFrame) -> DataFrame:
    # reduce first: the join then carries one row per cell, however often it was extracted
    cells = results.where("firm IS NOT NULL AND year IS NOT NULL AND indicator IS NOT NULL").groupBy("firm", "year", "indicator").agg(
        any_of(F.col("extracted")).alias("extracted"), any_of(F.col("value_final").isNotNull()).alias("final")
    )
    return cells.join(eligible, ["firm", "year"])


def indicator_observations(stages: DataFrame, results: DataFrame) -> DataFrame:
    """Presence per (firm, year, indicator) of eligible firm-years: extracted, final."""
    return _observations(eligible_firm_years(stages), results)


def opportunity_counts(stages: DataFrame, results: DataFrame) -> DataFrame:
    """Possible, extracted and final observations over all eligible firm-years."""
    eligible = cut_lineage(eligible_firm_years(stages))
    seen = _observations(eligible, results).agg(F.count_if("extracted").alias("n_extracted"), F.count_if("final").alias("n_final"))
    n_fy = eligible.agg(F.count(F.lit(1)).alias("n")).scalar()
    k = results.agg(F.count_distinct("indicator").alias("k")).scalar()
    return seen.select(n_fy.alias("n_fy_ok"), k.alias("k_indicators"), "n_extracted", "n_final").select(
        "n_fy_ok",
        "k_indicators",
        (F.col("n_fy_ok") * F.col("k_indicators")).alias("n_possible"),
        "n_extracted",
        (F.col("n_fy_ok") * F.col("k_indicators") - F.col("n_extracted")).alias("n_no_evidence"),
        "n_final",
        (F.col("n_extracted") - F.col("n_final")).alias("n_not_final"),
    )


def extractability_counts(stages: DataFrame, results: DataFrame) -> DataFrame:
    """Possible, extracted and final per indicator over the full year x indicator grid.

    The grid's sums need no grid: every indicator is possible once per eligible firm-year.
    """
    eligible = cut_lineage(eligible_firm_years(stages))
    possible = eligible.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = _observations(eligible, results).groupBy("indicator").agg(F.count_if("extracted").alias("n_extracted"), F.count_if("final").alias("n_final"))
    ids = results.select("indicator").where(F.col("indicator").isNotNull()).distinct()
    none = F.lit(0).cast("long")
    counts = ids.join(counted, "indicator", "left").select(
        "indicator", possible.alias("n_possible"), F.coalesce("n_extracted", none).alias("n_extracted"), F.coalesce("n_final", none).alias("n_final")
    )
    return counts.where(F.col("n_possible") > 0)


def _rate(num: str, den: str) -> Column:
    ratio = F.col(num) / F.nullif(F.col(den), F.lit(0))
    return F.when(F.col(den) > 0, F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))


def extractability_rates(counts: DataFrame) -> DataFrame:
    """Disclosure rate, extraction success and overall yield, null without a base."""
    return counts.withColumns(
        {
            "disclosure_rate": _rate("n_extracted", "n_possible"),
            "extraction_success": _rate("n_final", "n_extracted"),
            "overall_yield": _rate("n_final", "n_possible"),
        }
    )


def datapoint_description(metadata: DataFrame) -> DataFrame:
    """Description from the first source the table has; blank is null."""
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    if "label_specification" in metadata.columns:
        text = trimmed("label_specification")
    elif "specification" in metadata.columns:
        spec = trimmed("specification")
        text = F.when(spec == "", trimmed("label")).otherwise(F.concat(trimmed("label"), F.lit(": "), spec))
    else:
        text = trimmed("label")
    return metadata.withColumn("datapoint_description", F.nullif(text, F.lit("")))


def coverage_report(rates: DataFrame, descriptions: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Report rows in case-insensitive order with rates as percent text; ``max_rows`` is the report's length."""
    percent = lambda c: F.when(F.col(c).isNull(), "—").otherwise(F.format_string("%.1f", F.col(c) * 100))
    rows = rates.join(descriptions.select("indicator", "datapoint_description").distinct(), "indicator", "left")
    rows = rows.orderBy(F.lower(F.coalesce("datapoint_description", F.lit(""))), "indicator")
    rows = rows if max_rows is None else rows.limit(max_rows)
    return rows.select("indicator", "datapoint_description", percent("disclosure_rate").alias("disclosure"), percent("extraction_success").alias("success"))


def report_types(df: DataFrame, key: str = "company_year", reports: str = "reports") -> DataFrame:
    """Year and number of files per type from a list literal of quoted PDF names."""
    files = F.regexp_extract_all(reports, F.lit(r"'([^']+\.pdf)'"), F.lit(1))
    counted = df.withColumn("__f", files)
    ends = lambda t: F.size(F.filter("__f", lambda f: F.contains(f, F.lit(t))))
    return counted.select(
        key,
        F.regexp_extract(key, r"^.*_(\d{4})$", 1).try_cast("int").alias("year"),
        F.size("__f").alias("n_reports"),
        ends("_SR.pdf").alias("sr_count"),
        ends("_AR.pdf").alias("ar_count"),
    )


def reports_over_time(types: DataFrame) -> DataFrame:
    """Reports per year and type in long form."""
    yearly = types.groupBy("year").agg(F.sum("sr_count").alias("Sustainability Report"), F.sum("ar_count").alias("Annual Report"))
    return yearly.unpivot("year", ["Sustainability Report", "Annual Report"], "report_type", "n")


def firms_per_country(facts: DataFrame, firms: DataFrame) -> DataFrame:
    """Distinct firms per country under its display name."""
    country = F.when(F.col("country") == "United Kingdom", "UK").otherwise(F.col("country"))
    present = firms.join(facts.select("firm").distinct(), "firm", "left_semi")
    return present.select("firm", country.alias("country")).groupBy("country").agg(F.count_distinct("firm").alias("n"))


def paired_companies(firms: DataFrame) -> DataFrame:
    """Two companies per output row within a sector; an odd last row repeats its own name."""
    names = firms.select("name", "country", "sector").distinct()
    numbered = running_before(names.withColumn("__one", F.lit(1)), ["sector"], ["name", "country"], "__one", "rn")
    numbered = numbered.withColumn("pair_id", F.expr("rn div 2 + 1"))
    pick = lambda agg, c: agg(F.col(c), F.col("rn"))
    return numbered.groupBy("sector", "pair_id").agg(
        pick(F.min_by, "name").alias("name_1"),
        pick(F.min_by, "country").alias("country_1"),
        pick(F.max_by, "name").alias("name_2"),
        pick(F.max_by, "country").alias("country_2"),
    )


def has_value_text(model_output: Column) -> Column:
    """Detected: the stored answer exists and its value is not the bare word None."""
    return F.coalesce(~model_output.rlike(r"'value':\s*None(?!')"), F.lit(False))
