"""Transparency and performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.functions.labels import category_number, relabel, short_label
from firmlens.functions.ratings import TRIPLE_SCALE, coded, rating_codes
from firmlens.operators import performance as P
from firmlens.operators import transparency as T
from firmlens.operators.coverage import has_value_text
from firmlens.operators.quality import high_quality
from firmlens.operators.quantiles import exact_quantiles
from firmlens.operators.scale import small_side
from firmlens.plans import standins as S
from firmlens.plans.registry import query
from firmlens.session import cut_lineage

FIRST, LAST = 1995, 2000
STEADY = [1995, 1996, 1997, 1998]
BAND_SQL = (
    "quantile_cont(value_final, 0.1) AS p10, quantile_cont(value_final, 0.25) AS q1, quantile_cont(value_final, 0.5) AS median, "
    "quantile_cont(value_final, 0.75) AS q3, quantile_cont(value_final, 0.9) AS p90"
)
BUCKET_SQL = "CASE WHEN count(*) <= 150 THEN '≤150' WHEN count(*) <= 300 THEN '≤300' ELSE '>300' END"
FLOOR_SQL = "CASE WHEN label = 'Gender pay gap [%]' THEN p10 ELSE greatest(p10, 1) END"
RELABEL = {
    "Gross Scope 1 greenhouse gas emissions": "Total scope 1 emissions [tCO₂eq]",
    "Gross Scope 3 greenhouse gas emissions: Category 6 Business travel": "Category 6 Travel [tCO₂eq]",
    "Water consumption": "Water consumption [m³]",
    "Gender pay gap": "Gender pay gap [%]",
    "Percentage of employee turnover": "Employee turnover [%]",
    "Percentage of independent board members": "Independent board members [%]",
}
RELABEL_SQL = "coalesce(" + S.cases("label", RELABEL) + ", label)"


def rounded(df, *columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


@query(
    "h01_fact_enrichment",
    f"WITH {S.ENRICHED} SELECT firm, year, indicator, value_final, standard, label, \"exists\", area_order FROM enriched",
)
def _(spark, d):
    return S.enriched(spark, d).select("firm", "year", "indicator", "value_final", "standard", "label", "exists", "area_order")


@query(
    "h02_topic_groups",
    f"WITH {S.ENRICHED} SELECT std, count(*) AS n, sum(CAST(\"exists\" AS BIGINT))::BIGINT AS n_reported FROM enriched GROUP BY ALL",
)
def _(spark, d):
    return S.enriched(spark, d).groupBy("std").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("exists").cast("long")).alias("n_reported")
    )


@query(
    "h03_average_reported",
    f"WITH {S.ENRICHED} SELECT year, std, round(avg(reported), 6) AS avg_reported FROM cells GROUP BY ALL",
)
def _(spark, d):
    return rounded(T.average_reported(T.firm_cells(S.enriched(spark, d)), ["year", "std"]), "avg_reported")


BY_TOPIC = "SELECT year, std, avg(reported / possible) AS transp FROM cells GROUP BY ALL"
OVERALL = "SELECT year, 'Overall' AS std, avg(transp) AS transp FROM transp GROUP BY ALL"


@query(
    "h04_transparency_score",
    f"WITH {S.ENRICHED} SELECT year, std, round(transp, 6) AS transp FROM ({BY_TOPIC} UNION ALL {OVERALL})",
)
def _(spark, d):
    return rounded(T.transparency_by_topic(S.enriched(spark, d)), "transp")


@query("h05_overall_line", f"WITH {S.ENRICHED} SELECT year, std, round(transp, 6) AS transp FROM ({OVERALL})")
def _(spark, d):
    cells = T.firm_cells(S.enriched(spark, d))
    overall = T.firm_year_transparency(cells).groupBy("year").agg(F.avg("transp").alias("transp"))
    return rounded(overall.withColumn("std", F.lit("Overall")), "transp")


@query(
    "h06_sector_topic_scores",
    f"""WITH {S.ENRICHED}, {S.FIRMS},
  o AS (SELECT sector, avg(transp) AS transp FROM transp JOIN firms USING (firm) GROUP BY ALL),
  t AS (SELECT sector, std, avg(reported / possible) AS transp FROM cells JOIN firms USING (firm) GROUP BY ALL
        UNION ALL SELECT sector, 'Overall', transp FROM o)
  SELECT t.sector, t.std, round(t.transp, 6) AS transp, CAST(r.k AS INT) AS sector_order
  FROM t JOIN (SELECT sector, row_number() OVER (ORDER BY transp, sector) AS k FROM o) r USING (sector)""",
)
def _(spark, d):
    return rounded(T.transparency_by_sector(S.enriched(spark, d), S.firms(spark, d)), "transp")


def rated_rows(spark, d):
    """Enriched facts with the firm-year columns and the low-is-best score."""
    return (
        S.enriched(spark, d)
        .join(S.firm_years(spark, d), ["firm", "year"], "left")
        .withColumn("score", coded(F.col("rating"), rating_codes(TRIPLE_SCALE, best="low")))
    )


RATED = f"""{S.ENRICHED}, {S.FIRM_YEARS},
  rated AS (SELECT e.*, y.mkcap, y.sales, y.rating, {S.cases('y.rating', S.LOW_BEST)} AS score, {S.cases('y.rating', S.HIGH_BEST)} AS score_high
    FROM enriched e LEFT JOIN firm_years y USING (firm, year))"""
ROW_GROUPS = f"""{RATED}, q AS (SELECT year, quantile_cont(score, 0.1) AS lo, quantile_cont(score, 0.9) AS hi FROM rated GROUP BY ALL),
  grps AS (SELECT DISTINCT firm, year, CASE WHEN score <= lo THEN 'Top 10%' WHEN score >= hi THEN 'Bottom 10%' ELSE 'Middle 80%' END AS rating_group
    FROM rated JOIN q USING (year) WHERE score IS NOT NULL)"""


def row_groups(spark, d):
    rated = cut_lineage(rated_rows(spark, d).where(F.col("score").isNotNull()).select("firm", "year", "score"))
    grouped = T.group_by_thresholds(rated, "score", "rating_group", best="low")
    return grouped.select("firm", "year", "rating_group").distinct()


@query("h07_rating_groups_row_grain", f"WITH {ROW_GROUPS} SELECT * FROM grps")
def _(spark, d):
    return row_groups(spark, d)


FIRM_GROUPS = f"""{S.ENRICHED}, {S.FIRM_YEARS},
  panel AS (SELECT t.*, y.mkcap, {S.cases('y.rating', S.HIGH_BEST)} AS score FROM transp t LEFT JOIN firm_years y USING (firm, year)),
  q AS (SELECT year, quantile_cont(mkcap, 0.1) AS lo, quantile_cont(mkcap, 0.9) AS hi FROM panel GROUP BY ALL),
  grps AS (SELECT firm, year, transp, CASE WHEN mkcap IS NULL THEN NULL WHEN mkcap >= hi THEN 'Top 10%' WHEN mkcap <= lo THEN 'Bottom 10%' ELSE 'Middle 80%' END AS grp
    FROM panel LEFT JOIN q USING (year))"""


def firm_groups(spark, d, keep=None):
    facts = S.enriched(spark, d)
    if keep is not None:
        facts = facts.join(keep, ["firm", "year"], "left_semi")
    panel = T.firm_year_transparency(T.firm_cells(facts)).join(S.firm_years(spark, d), ["firm", "year"], "left")
    return T.group_by_thresholds(cut_lineage(panel.select("firm", "year", "transp", "mkcap")), "mkcap", "grp")


@query(
    "h08_size_groups_firm_grain",
    f"WITH {FIRM_GROUPS} SELECT firm, year, round(transp, 6) AS transp, grp FROM grps",
)
def _(spark, d):
    return rounded(firm_groups(spark, d).select("firm", "year", "transp", "grp"), "transp")


@query(
    "h09_group_series",
    f"""WITH {ROW_GROUPS}, c AS (SELECT cells.*, rating_group FROM cells LEFT JOIN grps USING (firm, year))
  SELECT rating_group, year, std, round(avg(reported), 6) AS avg_reported FROM c WHERE rating_group IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'All companies', year, std, round(avg(reported), 6) FROM c GROUP BY year, std""",
)
def _(spark, d):
    cells = T.firm_cells(S.enriched(spark, d))
    return rounded(T.grouped_series(cells, row_groups(spark, d), "rating_group"), "avg_reported")


@query(
    "h10_top_bottom_ratio",
    f"""WITH {ROW_GROUPS}, f AS (SELECT firm, year, sum(reported) AS r FROM cells GROUP BY ALL),
  g AS (SELECT year, avg(CASE rating_group WHEN 'Top 10%' THEN r END) AS t, avg(CASE rating_group WHEN 'Bottom 10%' THEN r END) AS b
    FROM f JOIN grps USING (firm, year) GROUP BY ALL)
  SELECT year, round(t, 6) AS avg_top, round(b, 6) AS avg_bottom, round(t / nullif(b, 0) - 1, 6) AS diff_top_bottom FROM g""",
)
def _(spark, d):
    cells = T.firm_cells(S.enriched(spark, d))
    out = T.top_bottom_ratio(cells, row_groups(spark, d), "rating_group", "Top 10%", "Bottom 10%")
    return rounded(out, "avg_top", "avg_bottom", "diff_top_bottom")


@query(
    "h11_first_last_change",
    f"""WITH {S.ENRICHED}, s AS (SELECT year, std, avg(reported) AS a FROM cells GROUP BY ALL),
  w AS (SELECT std, max(CASE year WHEN {FIRST} THEN a END) AS first, max(CASE year WHEN {LAST} THEN a END) AS last FROM s WHERE year IN ({FIRST}, {LAST}) GROUP BY ALL)
  SELECT std, round(first, 6) AS first, round(last, 6) AS last, round(last - first, 6) AS diff, round((last - first) / nullif(first, 0) * 100, 6) AS pct_change FROM w""",
)
def _(spark, d):
    series = T.average_reported(T.firm_cells(S.enriched(spark, d)), ["year", "std"])
    return rounded(T.first_last_change(series, FIRST, LAST), "first", "last", "diff", "pct_change")


@query(
    "h12_mean_rating",
    f"WITH {S.FIRM_YEARS} SELECT year, round(avg({S.cases('rating', S.LOW_BEST)}), 6) AS mean FROM firm_years GROUP BY ALL",
)
def _(spark, d):
    ratings = S.firm_years(spark, d).select("firm", "year", "rating").distinct()
    return rounded(T.yearly_mean_score(ratings, coded(F.col("rating"), rating_codes(TRIPLE_SCALE, best="low"))), "mean")


VALUES = f"{RATED}, vals AS (SELECT * REPLACE ({RELABEL_SQL} AS label) FROM rated)"


def labelled(spark, d):
    return relabel(S.enriched(spark, d), "label")


@query(
    "h13_percentile_bands",
    f"WITH {VALUES}, b AS (SELECT label, year, {BAND_SQL} FROM vals WHERE value_final IS NOT NULL GROUP BY ALL) "
    "SELECT label, year, round(p10, 4) AS p10, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(p90, 4) AS p90 FROM b",
)
def _(spark, d):
    return rounded(P.bands(labelled(spark, d), ["label", "year"]), *P.BAND_NAMES, digits=4)


@query(
    "h14_floored_p10",
    f"""WITH {VALUES}, b AS (SELECT label, year, quantile_cont(value_final / 2000 - 1, 0.1) AS p10 FROM vals WHERE value_final IS NOT NULL GROUP BY ALL)
  SELECT label, year, round({FLOOR_SQL}, 4) AS p10 FROM b""",
)
def _(spark, d):
    shifted = labelled(spark, d).withColumn("value_final", F.col("value_final") / 2000 - 1)
    return rounded(P.floored_p10(exact_quantiles(shifted, ["label", "year"], "value_final", [0.1], ["p10"])), "p10", digits=4)


@query(
    "h15_group_sizes",
    f"WITH {VALUES} SELECT label, year, count(*) AS n, {BUCKET_SQL} AS n_group FROM vals WHERE value_final IS NOT NULL GROUP BY ALL",
)
def _(spark, d):
    return P.group_sizes(labelled(spark, d).where("value_final IS NOT NULL"), ["label", "year"])


@query("h16_total_n", f"WITH {VALUES} SELECT label, count(*) AS n FROM vals WHERE value_final IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return labelled(spark, d).where("value_final IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("h17_display_labels", f"WITH {VALUES} SELECT firm, year, indicator, label FROM vals")
def _(spark, d):
    return labelled(spark, d).select("firm", "year", "indicator", "label")


@query(
    "h18_complete_grid",
    f"""WITH {VALUES}, g AS (SELECT label, year, count(*) AS n, {BUCKET_SQL} AS n_group FROM vals WHERE value_final IS NOT NULL GROUP BY ALL)
  SELECT l.label, y.year, b.n_group, g.n FROM (SELECT DISTINCT label FROM g) l CROSS JOIN (SELECT DISTINCT year FROM g) y
  CROSS JOIN (VALUES ('≤150'), ('≤300'), ('>300')) b(n_group) LEFT JOIN g USING (label, year, n_group)""",
)
def _(spark, d):
    return P.complete_grid(P.group_sizes(labelled(spark, d).where("value_final IS NOT NULL"), ["label", "year"]), "label")


@query(
    "h19_median_change",
    f"""WITH {VALUES}, m AS (SELECT label, year, quantile_cont(CASE WHEN label LIKE 'Gender%' THEN 0 ELSE value_final END, 0.5) AS md FROM vals WHERE value_final IS NOT NULL GROUP BY ALL),
  w AS (SELECT label, max(CASE year WHEN {FIRST} THEN md END) AS a, max(CASE year WHEN {LAST} THEN md END) AS b FROM m GROUP BY ALL),
  r AS (SELECT *, round((b - a) * 100 / nullif(a, 0), 1) AS p FROM w)
  SELECT label, round(a, 4) AS y_first, round(b, 4) AS y_last,
    'Δ: ' || coalesce(CASE WHEN p > 0 THEN '+' ELSE '' END || printf('%.1f', p) || '%', 'n.a.') AS change FROM r""",
)
def _(spark, d):
    zeroed = labelled(spark, d).withColumn(
        "value_final", F.when(F.col("label").startswith("Gender") & F.col("value_final").isNotNull(), 0.0).otherwise(F.col("value_final"))
    )
    medians = exact_quantiles(zeroed, ["label", "year"], "value_final", [0.5], ["median"])
    return rounded(P.median_change(medians, "label", FIRST, LAST), "y_first", "y_last", digits=4)


FX_SQL = "fx AS (SELECT year, avg(r) AS rate FROM (SELECT DISTINCT firm, year, mkcap / nullif(sales, 0) AS r FROM firm_years) GROUP BY ALL)"


@query("h20_implied_fx", f"WITH {S.FIRM_YEARS}, {FX_SQL} SELECT year, round(rate, 6) AS rate FROM fx")
def _(spark, d):
    return rounded(P.implied_fx(S.firm_years(spark, d), "mkcap", "sales"), "rate")


REAL_SQL = f"""{S.FIRM_YEARS}, {S.INDEX}, {FX_SQL}, real_ AS (SELECT firm, year, sales * rate * (SELECT idx FROM price_index WHERE year = 2001) / idx AS real_sales
  FROM (SELECT DISTINCT firm, year, sales FROM firm_years) JOIN fx USING (year) JOIN price_index USING (year))"""


def real_sales(spark, d):
    fy = S.firm_years(spark, d)
    local = fy.select("firm", "year", "sales").distinct().join(small_side(P.implied_fx(fy, "mkcap", "sales")), "year")
    local = local.withColumn("sales_local", F.col("sales") * F.col("rate"))
    return P.deflated(local, "sales_local", "real_sales", S.price_index(spark), 2001).select("firm", "year", "real_sales")


@query("h21_deflated_sales", f"WITH {REAL_SQL} SELECT firm, year, round(real_sales, 4) AS real_sales FROM real_")
def _(spark, d):
    return rounded(real_sales(spark, d), "real_sales", digits=4)


@query(
    "h22_median_trend",
    f"""WITH {REAL_SQL}, m AS (SELECT year, quantile_cont(real_sales, 0.5) AS median FROM real_ GROUP BY ALL)
  SELECT year, round(median, 4) AS median, round(median / lag(median) OVER (ORDER BY year) - 1, 6) AS yoy_change FROM m""",
)
def _(spark, d):
    out = P.median_trend(real_sales(spark, d), "real_sales")
    return out.select("year", F.round("median", 4).alias("median"), F.round("yoy_change", 6).alias("yoy_change"))


def intensity_input(spark, d):
    values = S.rows(spark, d).where("indicator = 1").select("firm", "year", "value_final")
    score = coded(F.col("rating"), rating_codes(TRIPLE_SCALE, best="low"))
    ratings = S.firm_years(spark, d).select("firm", "year", score.alias("score"))
    return values.join(real_sales(spark, d), ["firm", "year"], "left").join(ratings, ["firm", "year"], "left")


INTENSITY = f"""{S.ROWS}, {REAL_SQL}, src AS (SELECT DISTINCT r.firm, r.year, r.value_final, real_sales, {S.cases('y.rating', S.LOW_BEST)} AS score
    FROM rows_ r LEFT JOIN real_ USING (firm, year) LEFT JOIN firm_years y USING (firm, year) WHERE indicator = 1),
  ints AS (SELECT *, value_final / nullif(real_sales, 0) * 1000 AS intensity FROM src)"""


@query(
    "h23_intensity_medians",
    f"""WITH {INTENSITY}, early AS (SELECT DISTINCT firm FROM rows_ WHERE indicator = 1 AND year IN (1995, 1996) AND value_final IS NOT NULL),
  u AS (SELECT 'All companies' AS grp, * FROM ints UNION ALL SELECT 'Early adopters', * FROM ints WHERE firm IN (SELECT firm FROM early))
  SELECT grp, year, round(quantile_cont(intensity, 0.5), 4) AS median_intensity FROM u GROUP BY ALL""",
)
def _(spark, d):
    return rounded(P.intensity_medians(intensity_input(spark, d).drop("score"), "real_sales", [1995, 1996]), "median_intensity", digits=4)


@query(
    "h24_intensity_by_rating",
    f"""WITH {INTENSITY}, q AS (SELECT year, quantile_cont(score, 0.1) AS lo, quantile_cont(score, 0.9) AS hi FROM ints GROUP BY ALL),
  g AS (SELECT ints.*, CASE WHEN score <= lo THEN 'Top 10%' WHEN score >= hi THEN 'Bottom 10%' ELSE 'Middle 80%' END AS grp FROM ints LEFT JOIN q USING (year)),
  u AS (SELECT grp, year, intensity FROM g WHERE grp <> 'Middle 80%' UNION ALL SELECT 'All companies', year, intensity FROM g)
  SELECT grp, year, round(quantile_cont(intensity, 0.5), 4) AS median_intensity FROM u GROUP BY ALL""",
)
def _(spark, d):
    return rounded(P.intensity_by_rating(intensity_input(spark, d), "real_sales"), "median_intensity", digits=4)


def cohort_sql(base: str, member: str, name: str, winsor: bool) -> str:
    clip = (
        "members AS (SELECT m.* REPLACE (least(greatest(value_final, lo), hi) AS value_final) FROM m0 m JOIN "
        "(SELECT label, year, min(value_final) AS lo, quantile_cont(value_final, 0.99) AS hi FROM m0 GROUP BY ALL) USING (label, year))"
        if winsor
        else "members AS (SELECT * FROM m0)"
    )
    return f"""WITH {base}, v AS (SELECT * FROM vals WHERE value_final IS NOT NULL), m0 AS (SELECT * FROM v WHERE {member}), {clip},
  b AS (SELECT 'All companies' AS cohort, label, year, {BAND_SQL} FROM v GROUP BY ALL
    UNION ALL SELECT '{name}', label, year, {BAND_SQL} FROM members GROUP BY ALL),
  n AS (SELECT label, year, count(*) AS n, {BUCKET_SQL} AS n_group FROM m0 GROUP BY ALL)
  SELECT label, year, round({FLOOR_SQL}, 4) AS p10, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(p90, 4) AS p90, cohort, n, n_group
  FROM b LEFT JOIN n USING (label, year)"""


@query(
    "h25_early_adopter_bands",
    cohort_sql(VALUES, "(firm, label) IN (SELECT firm, label FROM v WHERE year IN (1995, 1996))", "Early adopters", True),
)
def _(spark, d):
    values = labelled(spark, d)
    cohort = P.early_adopters(values, [1995, 1996])
    return rounded(P.cohort_bands(values, cohort, ["firm", "label"], "Early adopters"), *P.BAND_NAMES, digits=4)


STEADY_SQL = f"(firm, indicator) IN (SELECT firm, indicator FROM v WHERE year IN {tuple(STEADY)} GROUP BY ALL HAVING count(DISTINCT year) = {len(STEADY)})"


@query("h26_constant_reporter_bands", cohort_sql(VALUES, STEADY_SQL, "Constant reporters", False))
def _(spark, d):
    values = labelled(spark, d)
    cohort = P.constant_reporters(values, STEADY)
    out = P.cohort_bands(values, cohort, ["firm", "indicator"], "Constant reporters", winsorise=False)
    return rounded(out, *P.BAND_NAMES, digits=4)


HQ_SQL = f"""{S.FIRM_YEARS}, hq AS (SELECT firm, year FROM firm_years JOIN (SELECT year, quantile_cont(sales, 2/3) AS a, quantile_cont(mkcap, 2/3) AS b,
  quantile_cont(n_orders, 2/3) AS c FROM firm_years GROUP BY ALL) USING (year)
  WHERE NOT coalesce(sales >= a, false) AND NOT coalesce(mkcap >= b, false) AND NOT coalesce(n_orders >= c, false))"""


def hq_keys(spark, d):
    return high_quality(S.firm_years(spark, d), ["sales", "mkcap", "n_orders"]).select("firm", "year")


@query(
    "h27_high_quality_bars",
    f"""WITH {S.ENRICHED}, {HQ_SQL}, c AS (SELECT 'All companies' AS cohort, * FROM cells UNION ALL SELECT 'High quality firm-years', * FROM cells SEMI JOIN hq USING (firm, year))
  SELECT cohort, year, std, round(avg(reported), 6) AS avg_reported FROM c GROUP BY ALL""",
)
def _(spark, d):
    cells = T.firm_cells(S.enriched(spark, d))
    inside = cells.join(hq_keys(spark, d), ["firm", "year"], "left_semi")
    both = cells.withColumn("cohort", F.lit("All companies")).unionByName(inside.withColumn("cohort", F.lit("High quality firm-years")))
    return rounded(T.average_reported(both, ["cohort", "year", "std"]), "avg_reported")


@query(
    "h27_high_quality_scores",
    f"""WITH {S.ENRICHED}, {HQ_SQL}, c AS (SELECT * FROM cells SEMI JOIN hq USING (firm, year)), o AS (SELECT * FROM transp SEMI JOIN hq USING (firm, year))
  SELECT year, std, round(avg(reported / possible), 6) AS transp FROM c GROUP BY ALL
  UNION ALL SELECT year, 'Overall', round(avg(transp), 6) FROM o GROUP BY year""",
)
def _(spark, d):
    facts = S.enriched(spark, d).join(hq_keys(spark, d), ["firm", "year"], "left_semi")
    return rounded(T.transparency_by_topic(facts), "transp")


@query(
    "h27_high_quality_groups",
    f"""WITH {S.ENRICHED}, {HQ_SQL}, panel AS (SELECT t.*, mkcap FROM (SELECT * FROM transp SEMI JOIN hq USING (firm, year)) t LEFT JOIN firm_years USING (firm, year)),
  q AS (SELECT year, quantile_cont(mkcap, 0.1) AS lo, quantile_cont(mkcap, 0.9) AS hi FROM panel GROUP BY ALL)
  SELECT firm, year, round(transp, 6) AS transp, CASE WHEN mkcap IS NULL THEN NULL WHEN mkcap >= hi THEN 'Top 10%' WHEN mkcap <= lo THEN 'Bottom 10%' ELSE 'Middle 80%' END AS grp
  FROM panel LEFT JOIN q USING (year)""",
)
def _(spark, d):
    return rounded(firm_groups(spark, d, hq_keys(spark, d)).select("firm", "year", "transp", "grp"), "transp")


@query(
    "h27_high_quality_bands",
    cohort_sql(VALUES.replace(S.FIRM_YEARS, HQ_SQL), "(firm, year) IN (SELECT firm, year FROM hq)", "High quality firm-years", True),
)
def _(spark, d):
    out = P.cohort_bands(labelled(spark, d), hq_keys(spark, d), ["firm", "year"], "High quality firm-years")
    return rounded(out, *P.BAND_NAMES, digits=4)


@query(
    "h28_winsorised_values",
    f"""WITH {VALUES}, q AS (SELECT label, year, min(value_final) AS lo, quantile_cont(value_final, 0.99) AS hi FROM vals GROUP BY ALL)
  SELECT firm, year, indicator, round(CASE WHEN value_final IS NOT NULL THEN least(greatest(value_final, lo), hi) END, 4) AS value_final FROM vals JOIN q USING (label, year)""",
)
def _(spark, d):
    out = P.winsorised(labelled(spark, d), ["label", "year"])
    return rounded(out.select("firm", "year", "indicator", "value_final"), "value_final", digits=4)


DETECT = S.ENRICHED.replace(
    'f.value_final IS NOT NULL AS "exists"',
    "coalesce(NOT regexp_matches(model_output, '''value'':\\s*None($|[^''])'), false) AS \"exists\"",
)


@query(
    "h29_detection_transparency",
    f"WITH {DETECT} SELECT year, std, round(transp, 6) AS transp FROM ({BY_TOPIC} UNION ALL {OVERALL})",
)
def _(spark, d):
    facts = S.enriched(spark, d).withColumn("detection", has_value_text(F.col("model_output")))
    return rounded(T.transparency_by_topic(facts, "detection"), "transp")


@query(
    "h30_market_cap_terciles",
    f"""WITH {S.ENRICHED}, {S.FIRM_YEARS}, k AS (SELECT DISTINCT firm, year, mkcap FROM transp LEFT JOIN firm_years USING (firm, year)),
  q AS (SELECT year, quantile_cont(mkcap, 1/3) AS lo, quantile_cont(mkcap, 2/3) AS hi FROM k GROUP BY ALL),
  g AS (SELECT firm, year, 'Market-cap tercile: ' || CASE WHEN mkcap <= lo THEN 'bottom' WHEN mkcap >= hi THEN 'top' ELSE 'middle' END AS grp FROM k JOIN q USING (year) WHERE mkcap IS NOT NULL)
  SELECT grp, year, std, round(avg(reported), 6) AS avg_reported FROM cells JOIN g USING (firm, year) GROUP BY ALL""",
)
def _(spark, d):
    cells = T.firm_cells(S.enriched(spark, d))
    caps = cells.select("firm", "year").distinct().join(S.firm_years(spark, d).select("firm", "year", "mkcap"), ["firm", "year"], "left")
    names = tuple(f"Market-cap tercile: {x}" for x in ("top", "middle", "bottom"))
    capped = caps.where(F.col("mkcap").isNotNull())
    # the bottom tercile is tested first here, so bottom and top swap roles under best="low"
    groups = T.group_by_thresholds(capped, "mkcap", "grp", best="low", probs=(1 / 3, 2 / 3), labels=(names[2], names[1], names[0]))
    return rounded(T.average_reported(cells.join(groups.select("firm", "year", "grp"), ["firm", "year"]), ["grp", "year", "std"]), "avg_reported")


def score_bands_sql(score: str) -> str:
    return f"""WITH {VALUES}, q AS (SELECT year, quantile_cont({score}, 0.1) AS lo, quantile_cont({score}, 0.9) AS hi FROM vals GROUP BY ALL),
  g AS (SELECT vals.*, CASE WHEN {score} >= hi THEN 'Top 10%' WHEN {score} <= lo THEN 'Bottom 10%' END AS grp FROM vals JOIN q USING (year)),
  b AS (SELECT label, year, grp, {BAND_SQL}, count(*) AS n, {BUCKET_SQL} AS n_group FROM g GROUP BY ALL)
  SELECT label, year, grp, round(CASE WHEN p10 IS NULL AND label <> 'Gender pay gap [%]' THEN 1 ELSE {FLOOR_SQL} END, 4) AS p10, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(p90, 4) AS p90, n, n_group FROM b
  UNION ALL SELECT label, year, 'All companies', NULL, NULL, round(quantile_cont(value_final, 0.5), 4), NULL, NULL, NULL, NULL FROM vals GROUP BY label, year"""


def score_bands(spark, d, column):
    fy = S.firm_years(spark, d).withColumn("score", column)
    values = relabel(S.enriched(spark, d), "label").join(fy.select("firm", "year", "score"), ["firm", "year"], "left")
    return rounded(P.bands_by_score_group(values, "score"), *P.BAND_NAMES, digits=4)


@query("h31_bands_by_market_cap", score_bands_sql("mkcap"))
def _(spark, d):
    return score_bands(spark, d, F.col("mkcap"))


@query("h32_bands_by_rating", score_bands_sql("score_high"))
def _(spark, d):
    return score_bands(spark, d, coded(F.col("rating"), rating_codes(TRIPLE_SCALE, best="high")))


@query("h33_bands_by_reverse_score", score_bands_sql("score"))
def _(spark, d):
    return score_bands(spark, d, coded(F.col("rating"), rating_codes(TRIPLE_SCALE, best="low")))


CATEGORY = """cat AS (SELECT 'Category ' || replace(p_brand, 'Brand#', '') || ' ' || p_type || ' [tCO₂eq]' AS label, CAST(year(l_shipdate) AS INT) AS year, l_extendedprice AS value_final
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def categories(spark, d):
    part = S.read(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat(F.lit("Category "), F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit(" "), "p_type", F.lit(" [tCO₂eq]")).alias("label"),
    )
    lines = S.read(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("value_final"))
    return lines.join(part, "l_partkey").drop("l_partkey")


@query(
    "h34_category_bands",
    f"WITH {CATEGORY} SELECT label, year, round(quantile_cont(value_final, 0.1), 4) AS p10, round(quantile_cont(value_final, 0.25), 4) AS q1, "
    "round(quantile_cont(value_final, 0.5), 4) AS median, round(quantile_cont(value_final, 0.75), 4) AS q3, round(quantile_cont(value_final, 0.9), 4) AS p90 FROM cat GROUP BY ALL",
)
def _(spark, d):
    return rounded(P.bands(categories(spark, d).where(F.col("label").rlike(r"Category \d")), ["label", "year"]), *P.BAND_NAMES, digits=4)


@query(
    "h35_category_counts",
    f"""WITH {CATEGORY} SELECT regexp_replace(label, '\\s*\\[.*?\\]', '') AS short_label, CAST(regexp_extract(label, 'Category ([0-9]+)', 1) AS DOUBLE) AS cat_number, year, count(*) AS n FROM cat GROUP BY ALL""",
)
def _(spark, d):
    sizes = P.group_sizes(categories(spark, d), ["label", "year"])
    return sizes.select(short_label(F.col("label")).alias("short_label"), category_number(F.col("label")).alias("cat_number"), "year", "n")


@query(
    "h36_within_category",
    f"""WITH {S.ENRICHED}, w AS (SELECT firm, year, avg(CAST("exists" AS INT)) AS transp FROM enriched WHERE indicator IN (1, 2, 3) GROUP BY ALL)
  SELECT firm, year, round(transp, 6) AS transp, value_final, round(ln(value_final), 6) AS log_total FROM w JOIN enriched USING (firm, year) WHERE indicator = 1 AND value_final IS NOT NULL""",
)
def _(spark, d):
    return rounded(P.within_category(S.enriched(spark, d), [1, 2, 3], 1), "transp", "log_total")
