"""Validation and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.functions.ratings import TRIPLE_SCALE, coded, rating_codes
from firmlens.operators import regression as G
from firmlens.operators import transparency as T
from firmlens.operators import validation as V
from firmlens.operators.scale import hash_side
from firmlens.plans import standins as S
from firmlens.plans.panel_queries import FIRM_GROUPS, firm_groups, rounded
from firmlens.plans.registry import query
from firmlens.session import cut_lineage

NOISE = "(1 + (l_partkey % 21 - 10) / CAST(200 AS DOUBLE))"


def truth_rows(spark, d):
    orders = hash_side(S.read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("firm"), F.year("o_orderdate").alias("year")))
    return S.read(spark, d, "lineitem").join(orders, "l_orderkey").withColumn("indicator", F.col("l_linenumber"))


def truth_cells(spark, d):
    """The largest price per (firm, year, indicator) of each source, from one pass over the rows; staged."""
    price, flag = F.col("l_extendedprice"), F.col("l_returnflag")
    manual = {name: [F.max(F.when(flag == name, price)).alias(name), F.max(flag == name).alias(f"has_{name}")] for name in ("A", "R")}
    return cut_lineage(
        truth_rows(spark, d).groupBy("firm", "year", "indicator").agg(
            F.max(F.when(flag != "N", price)).alias("value_final"),
            F.max(F.when(F.col("l_linestatus") == "O", price * F.expr(NOISE))).alias("licensed"),
            *manual["A"], *manual["R"],
        )
    )


def merged(spark, d):
    cells = truth_cells(spark, d)
    facts = cells.select(F.col("firm").cast("string").alias("firm"), "year", "indicator", "value_final")
    facts = facts.withColumn("exists", F.col("value_final").isNotNull()).withColumn(
        "field", F.when(F.col("indicator") <= 4, F.concat(F.lit("F"), F.col("indicator")))
    )
    customers = S.read(spark, d, "customer").select(F.col("c_name").alias("isin"), F.col("c_custkey").alias("id"))
    licensed = (
        cells.join(hash_side(customers), F.col("firm") == F.col("id"))
        .groupBy("isin", "year", F.concat(F.lit("F"), F.col("indicator")).alias("fieldname"))
        .agg(F.max("licensed").alias("value"))
    )
    companies = customers.select("isin", F.col("id").cast("string").alias("firm"))
    manual = lambda flag: cells.where(F.col(f"has_{flag}")).select(F.concat_ws("_", "firm", "year").alias("company_year"), "indicator", F.format_number(flag, 2).alias("value"))
    return V.ground_truth(facts, licensed, companies, manual("A"), manual("R"))


TRUTH = f"""r AS (SELECT l.*, CAST(o_custkey AS VARCHAR) AS firm, CAST(year(o_orderdate) AS INT) AS year, l_linenumber AS indicator FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
  f AS (SELECT firm, year, indicator, max(CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END) AS value_final,
    max(CASE WHEN l_linestatus = 'O' THEN l_extendedprice * {NOISE} END) AS lic, max(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS manual_value,
    max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS second_value FROM r GROUP BY ALL),
  merged AS (SELECT firm, year, indicator, value_final, value_final IS NOT NULL AS "exists", CASE WHEN indicator <= 4 THEN lic END AS ref_value,
    CASE WHEN indicator <= 4 THEN lic IS NOT NULL END AS ref_exists, manual_value, second_value FROM f)"""


@query(
    "i01_ground_truth",
    f"WITH {TRUTH} SELECT firm, year, indicator, round(value_final, 5) AS value_final, round(ref_value, 5) AS ref_value, ref_exists, manual_value, second_value FROM merged",
)
def _(spark, d):
    out = merged(spark, d).select("firm", "year", "indicator", "value_final", "ref_value", "ref_exists", "manual_value", "second_value")
    return rounded(out, "value_final", "ref_value", digits=5)


@query(
    "i02_keys_and_numbers",
    f"""WITH {TRUTH} SELECT firm, year, indicator, max(l_extendedprice) AS value FROM r WHERE l_returnflag = 'A' GROUP BY ALL""",
)
def _(spark, d):
    keyed = truth_rows(spark, d).where("l_returnflag = 'A'").groupBy(F.concat_ws("_", "firm", "year").alias("company_year"), "indicator").agg(
        F.format_number(F.max("l_extendedprice"), 2).alias("value")
    )
    return V.split_company_year(keyed).withColumn("value", V.number_without_commas(F.col("value"))).select("firm", "year", "indicator", "value")


CLASS = """CASE WHEN "exists" AND ref_exists THEN 'true_pos' WHEN "exists" AND NOT ref_exists THEN 'fals_pos' WHEN NOT "exists" AND ref_exists THEN 'fals_neg' WHEN NOT "exists" AND NOT ref_exists THEN 'true_neg' END"""


@query(
    "i03_confusion_classes",
    f'WITH {TRUTH} SELECT indicator, {CLASS} AS class, count(*) AS n, coalesce(count_if("exists" = ref_exists), 0)::BIGINT AS n_agree FROM merged GROUP BY ALL',
)
def _(spark, d):
    rows = merged(spark, d).withColumn("class", V.confusion(F.col("exists"), F.col("ref_exists")))
    return rows.groupBy("indicator", "class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("exists") == F.col("ref_exists")).alias("n_agree"))


@query(
    "i04_tolerance_matches",
    f"""WITH {TRUTH} SELECT indicator, coalesce(count_if(ref_value = value_final), 0)::BIGINT AS exact, coalesce(count_if(abs(ref_value - value_final) / abs(value_final) <= 0.01), 0)::BIGINT AS in1p,
  coalesce(count_if(abs(ref_value - value_final) / abs(value_final) <= 0.1), 0)::BIGINT AS in10p FROM merged GROUP BY ALL""",
)
def _(spark, d):
    rows = V.accuracy(merged(spark, d))
    return rows.groupBy("indicator").agg(F.count_if("ref_exact").alias("exact"), F.count_if("ref_in1p").alias("in1p"), F.count_if("ref_in10p").alias("in10p"))


SCALED = f"""{TRUTH}, p AS (SELECT * FROM merged WHERE value_final IS NOT NULL AND ref_value IS NOT NULL),
  pool AS (SELECT indicator, value_final AS v FROM p UNION ALL SELECT indicator, ref_value FROM p), cut AS (SELECT indicator, quantile_cont(v, 0.99) AS c FROM pool GROUP BY ALL),
  mm AS (SELECT indicator, min(v) AS lo, max(v) AS hi FROM pool JOIN cut USING (indicator) WHERE v <= c GROUP BY ALL),
  kept AS (SELECT p.* FROM p JOIN cut USING (indicator) WHERE value_final <= c AND ref_value <= c),
  sc AS (SELECT indicator, (value_final - lo) / nullif(hi - lo, 0) AS a, (ref_value - lo) / nullif(hi - lo, 0) AS b FROM kept JOIN mm USING (indicator)),
  means AS (SELECT indicator, count(*) AS n, avg(a) AS value_final, avg(b) AS ref_value FROM sc WHERE a IS NOT NULL GROUP BY ALL)"""


@query("i05_scaled_means", f"WITH {SCALED} SELECT indicator, n, round(value_final, 6) AS value_final, round(ref_value, 6) AS ref_value FROM means WHERE n > 3")
def _(spark, d):
    return rounded(V.scaled_means(merged(spark, d), ["indicator"], "value_final", "ref_value", more_than=3), "value_final", "ref_value")


FIT_SQL = """fit AS (SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM src)"""


@query(
    "i06_simple_fit",
    f"""WITH {TRUTH}, src AS (SELECT ref_value AS y, value_final AS x FROM merged WHERE ref_value IS NOT NULL AND value_final IS NOT NULL), {FIT_SQL}
  SELECT n, round(slope, 6) AS slope, round(intercept, 3) AS intercept, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2 FROM fit""",
)
def _(spark, d):
    out = V.simple_fit(merged(spark, d), "ref_value", "value_final").select("n", "slope", "intercept", "r2", "adj_r2")
    return rounded(rounded(out, "slope", "r2", "adj_r2"), "intercept", digits=3)


@query(
    "i06_fit_band",
    f"""WITH {SCALED.replace("mm AS (SELECT indicator,", "mm AS (SELECT indicator, year,").replace("pool AS (SELECT indicator, value_final", "pool AS (SELECT indicator, year, value_final").replace("UNION ALL SELECT indicator, ref_value", "UNION ALL SELECT indicator, year, ref_value").replace("cut AS (SELECT indicator, quantile_cont", "cut AS (SELECT indicator, year, quantile_cont").replace("USING (indicator)", "USING (indicator, year)").replace("sc AS (SELECT indicator,", "sc AS (SELECT indicator, year,").replace("means AS (SELECT indicator,", "means AS (SELECT indicator, year,")},
  src AS (SELECT ref_value AS y, value_final AS x FROM means WHERE n > 3),
  s AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_r2(y, x) AS r2, avg(x) AS mx FROM src)
  SELECT round(x, 6) AS x, round(a + b * x, 6) AS fit, round(sqrt(syy * (1 - r2) / (n - 2) * (1 / n + (x - mx) * (x - mx) / sxx)), 6) AS std_error
  FROM s, (SELECT i * CAST(0.75 AS DOUBLE) / 199 AS x FROM range(200) t(i))""",
)
def _(spark, d):
    means = V.scaled_means(merged(spark, d), ["indicator", "year"], "value_final", "ref_value", more_than=3)
    return rounded(V.fit_band(V.simple_fit(means, "ref_value", "value_final")).select("x", "fit", "std_error"), "x", "fit", "std_error")


@query(
    "i07_rank_correlation",
    """WITH k AS (SELECT l_linenumber AS indicator, rank() OVER (PARTITION BY l_linenumber ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linenumber, l_quantity) - 1) / 2 AS a,
    rank() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linenumber, l_extendedprice) - 1) / 2 AS b FROM lineitem),
  c AS (SELECT indicator, count(*) AS n, corr(a, b) AS cor FROM k GROUP BY ALL)
  SELECT indicator, n, round(cor, 6) AS cor, round(cor * sqrt((n - 2) / (1 - cor * cor)), 3) AS t, round((CAST(n AS DOUBLE) * n * n - n) * (1 - cor) / 6 / n / n, 3) AS scaled_s,
    printf('%.2f', cor) AS shown FROM c""",
)
def _(spark, d):
    pairs = S.read(spark, d, "lineitem").select(F.col("l_linenumber").alias("indicator"), "l_quantity", "l_extendedprice")
    out = V.spearman(pairs, ["indicator"], "l_quantity", "l_extendedprice")
    out = out.select("indicator", "n", "cor", "t", (F.col("s_statistic") / F.col("n") / F.col("n")).alias("scaled_s"), F.regexp_extract("label", r"^[-0-9.]+", 0).alias("shown"))
    return rounded(rounded(out, "cor"), "t", "scaled_s", digits=3)


def agreement_sql(pair, first, second):
    return f"""{pair}x AS (SELECT {first} AS a, {second} AS b, {first} + {second} AS s FROM merged WHERE {first} IS NOT NULL AND {second} IS NOT NULL),
  {pair}t AS (SELECT count(*) AS n, sum(a*a + b*b) AS sq, sum(s*s) AS rsq, sum(s) AS al, sum(a) AS ca, sum(b) AS cb FROM {pair}x),
  {pair}m AS (SELECT n, al*al/(2*n) AS mp, rsq/2 - al*al/(2*n) AS sr, (ca*ca + cb*cb)/n - al*al/(2*n) AS sc, sq - al*al/(2*n) AS sa FROM {pair}t),
  {pair}q AS (SELECT n, sr/(n-1) AS b, (sa-sr)/n AS w, sc AS j, (sa-sr-sc)/(n-1) AS e FROM {pair}m),
  {pair}i AS (SELECT n, 'ICC1' AS type, (b-w)/(b+w) AS icc, b/w AS f, n AS df2 FROM {pair}q UNION ALL SELECT n, 'ICC2', (b-e)/(b+e+2*(j-e)/n), b/e, n-1 FROM {pair}q UNION ALL SELECT n, 'ICC3', (b-e)/(b+e), b/e, n-1 FROM {pair}q
    UNION ALL SELECT n, 'ICC1k', (b-w)/b, b/w, n FROM {pair}q UNION ALL SELECT n, 'ICC2k', (b-e)/(b+(j-e)/n), b/e, n-1 FROM {pair}q UNION ALL SELECT n, 'ICC3k', (b-e)/b, b/e, n-1 FROM {pair}q),
  {pair}o AS (SELECT '{pair}' AS pair, n, type, round(icc, 5) AS icc, round(f, 3) AS f, n - 1 AS df1, df2 FROM {pair}i)"""


RATERS = {"people": ("manual_value", "second_value"), "machine": ("value_final", "manual_value")}


@query(
    "i08_rater_agreement",
    f"WITH {TRUTH}, {', '.join(agreement_sql(p, *c) for p, c in RATERS.items())} SELECT * FROM peopleo UNION ALL SELECT * FROM machineo",
)
def _(spark, d):
    rows = cut_lineage(merged(spark, d).select(*sorted({c for columns in RATERS.values() for c in columns})))
    shown = "n", "type", "icc", "f", "df1", "df2"
    both = [V.icc(rows, columns).select(F.lit(pair).alias("pair"), *shown) for pair, columns in RATERS.items()]
    return rounded(rounded(both[0].unionByName(both[1]), "icc", digits=5), "f", digits=3)


@query(
    "i09_group_difference",
    f"""WITH {FIRM_GROUPS}, s AS (SELECT grp, avg(transp) AS m, var_samp(transp) AS v, count(*) AS n FROM grps GROUP BY ALL),
  w AS (SELECT s.grp, s.n, s.m - z.m AS d, s.v / s.n AS e1, z.v / z.n AS e0, z.n AS n0 FROM s JOIN s z ON z.grp = 'Middle 80%' WHERE s.grp IN ('Top 10%', 'Bottom 10%'))
  SELECT grp, n, round(d * 100, 4) AS diff_pp, round(d / sqrt(e1 + e0), 4) AS t, round((e1 + e0) * (e1 + e0) / (e1 * e1 / (n - 1) + e0 * e0 / (n0 - 1)), 3) AS df FROM w""",
)
def _(spark, d):
    out = V.welch(firm_groups(spark, d), "transp", "grp", ["Top 10%", "Bottom 10%"], "Middle 80%").select("grp", "n", "diff_pp", "t", "df")
    return rounded(rounded(out, "diff_pp", "t", digits=4), "df", digits=3)


MAIN = {"size": ("q10", "q90"), "score": ("low_score", "high_score"), "n_orders": ("low_orders", "high_orders")}


def panel(spark, d, mains=("size",)):
    """Firm-year panel with sector, log size, rating, orders, and yearly decile dummies of the main scores."""
    base = T.firm_year_transparency(T.firm_cells(S.enriched(spark, d)))
    score = coded(F.col("rating"), rating_codes(TRIPLE_SCALE))
    wide = (
        base.join(S.firm_years(spark, d), ["firm", "year"], "left")
        .join(S.firms(spark, d).select("firm", "sector"), "firm", "left")
        .select("firm", "year", "sector", "transp", F.ln("mkcap").alias("size"), score.cast("double").alias("score"), F.col("n_orders").cast("double").alias("n_orders"))
    )
    out = cut_lineage(wide)
    for main in mains:
        out = G.decile_dummies(out, main, *MAIN[main])
    return out


PANEL = f"""{S.ENRICHED}, {S.FIRMS}, {S.FIRM_YEARS}, base AS (SELECT t.firm, t.year, sector, transp, ln(mkcap) AS size, CAST({S.cases('y.rating', S.HIGH_BEST)} AS DOUBLE) AS score, CAST(n_orders AS DOUBLE) AS n_orders
    FROM transp t LEFT JOIN firm_years y USING (firm, year) LEFT JOIN firms USING (firm)),
  q AS (SELECT year, {", ".join(f"quantile_cont({m}, 0.1) AS {lo}_, quantile_cont({m}, 0.9) AS {hi}_" for m, (lo, hi) in MAIN.items())} FROM base GROUP BY ALL),
  panel AS (SELECT base.*, {", ".join(f"CAST({m} <= {lo}_ AS DOUBLE) AS {lo}, CAST({m} >= {hi}_ AS DOUBLE) AS {hi}" for m, (lo, hi) in MAIN.items())} FROM base LEFT JOIN q USING (year))"""


def least_squares_sql(tag: str, spec: str, xs: dict[str, str], group: str, source: str = "panel", hidden: int = 0) -> str:
    """Coefficients and R2 of transp on the expressions xs within groups, by successive residuals and back substitution.

    Plain SQL on the rows: every step takes one regressor out of the ones after it. The spread is that of the sample. The first
    ``hidden`` regressors are dummies: they may have no variation of their own, and their coefficients are left out.
    """
    k = len(xs)
    share = lambda i, j: f"sum(x{j} * x{i}) / sum(x{j} * x{j})" if j > hidden else f"CASE WHEN sum(x{j} * x{j}) > 1e-9 THEN sum(x{j} * x{i}) / sum(x{j} * x{j}) ELSE 0 END"
    known = " AND ".join(f"({e}) IS NOT NULL" for e in xs.values())
    grouped = " AND ".join(f"{c} IS NOT NULL" for c in group.split(", ")) if group != "1" else "TRUE"
    out = [f"{tag}r AS MATERIALIZED (SELECT *, {', '.join(f'({e}) AS x{i}' for i, e in enumerate(xs.values(), 1))} FROM {source} WHERE {known} AND {grouped})"]
    out.append(f"{tag}0 AS MATERIALIZED (SELECT transp - avg(transp) OVER w AS x0, {', '.join(f'x{i} - avg(x{i}) OVER w AS x{i}' for i in range(1, k + 1))} FROM {tag}r WINDOW w AS (PARTITION BY {group}))")
    for j in range(1, k + 1):
        rest = [0, *range(j + 1, k + 1)]
        out.append(f"{tag}a{j} AS MATERIALIZED (SELECT sum(x{j} * x{j}) AS d, {', '.join(f'{share(i, j)} AS r{i}' for i in rest)} FROM {tag}{j - 1})")
        out.append(f"{tag}{j} AS MATERIALIZED (SELECT {', '.join(f'x{i} - r{i} * x{j} AS x{i}' for i in rest)} FROM {tag}{j - 1}, {tag}a{j})")
    for j in range(k, hidden, -1):
        known_b = "".join(f" - a{j}.r{i} * b{i}.b" for i in range(j + 1, k + 1))
        later = "".join(f", {tag}b{i} b{i}" for i in range(j + 1, k + 1))
        out.append(f"{tag}b{j} AS MATERIALIZED (SELECT a{j}.r0{known_b} AS b FROM {tag}a{j} a{j}{later})")
    out.append(f"{tag}f AS MATERIALIZED (SELECT 1 - (SELECT sum(x0 * x0) FROM {tag}{k}) / (SELECT var_pop(transp) * count(*) FROM {tag}r) AS r2, (SELECT count(*) FROM {tag}r) AS n)")
    rows = " UNION ALL ".join(f"SELECT '{spec}' AS spec, '{name}' AS term, n, b AS estimate, r2 FROM {tag}b{j}, {tag}f" for j, name in enumerate(xs, 1) if j > hidden)
    return ", ".join(out) + f", {tag}o AS ({rows})"


@query("i11_decile_dummies", f"WITH {PANEL} SELECT firm, year, round(size, 6) AS size, q10, q90 FROM panel")
def _(spark, d):
    return rounded(panel(spark, d).select("firm", "year", "size", "q10", "q90"), "size")


def one_way_sql(spec: str, group: str, n_fixed: str) -> str:
    """Two regressors within one set of groups, errors clustered by firm."""
    tag = spec[0]
    return f"""d{tag} AS (SELECT firm, transp - avg(transp) OVER w AS y, q10 - avg(q10) OVER w AS a, q90 - avg(q90) OVER w AS b FROM panel WHERE q10 IS NOT NULL WINDOW w AS (PARTITION BY {group})),
  g{tag} AS (SELECT sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*y) AS ay, sum(b*y) AS by_, count(*) AS n, count(DISTINCT firm) AS c FROM d{tag}),
  h{tag} AS (SELECT *, (bb*ay - ab*by_)/(aa*bb - ab*ab) AS b1, (aa*by_ - ab*ay)/(aa*bb - ab*ab) AS b2, bb/(aa*bb - ab*ab) AS i11, -ab/(aa*bb - ab*ab) AS i12, aa/(aa*bb - ab*ab) AS i22 FROM g{tag}),
  s{tag} AS (SELECT firm, sum(a*(y - b1*a - b2*b)) AS s1, sum(b*(y - b1*a - b2*b)) AS s2 FROM d{tag}, h{tag} GROUP BY ALL),
  m{tag} AS (SELECT sum(s1*s1) AS m11, sum(s1*s2) AS m12, sum(s2*s2) AS m22 FROM s{tag}),
  r{tag} AS (SELECT '{spec}' AS spec, n, b1, b2, sqrt((i11*i11*m11 + 2*i11*i12*m12 + i12*i12*m22) * k) AS e1, sqrt((i12*i12*m11 + 2*i12*i22*m12 + i22*i22*m22) * k) AS e2
    FROM h{tag}, m{tag}, (SELECT (n - 1) / (n - 2 - {n_fixed}) * c / (c - 1) AS k FROM g{tag}))"""


WAYS = [("0 none", "1", "1", []), ("2 year", "year", "(SELECT count(DISTINCT year) FROM panel)", ["year"]),
        ("3 sector", "sector", "(SELECT count(DISTINCT sector) FROM panel)", ["sector"]),
        ("4 sector-year", "sector, year", "(SELECT count(DISTINCT (sector, year)) FROM panel)", ["sector", "year"])]


@query(
    "i10_panel_one_effect",
    f"WITH {PANEL}, " + ", ".join(one_way_sql(s, g, k) for s, g, k, _ in WAYS) + " SELECT spec, term, n, round(b, 6) AS estimate, round(e, 6) AS std_error FROM ("
    + " UNION ALL ".join(f"SELECT spec, 'q10' AS term, n, b1 AS b, e1 AS e FROM r{s[0]} UNION ALL SELECT spec, 'q90', n, b2, e2 FROM r{s[0]}" for s, *_ in WAYS) + ")",
)
def _(spark, d):
    models = [(spec, ["q10", "q90"], effect, False) for spec, _, _, effect in WAYS]
    out = G.fit_all(panel(spark, d), "transp", models).where(F.col("term") != "(Intercept)")
    return rounded(out.select("spec", "term", "n", "estimate", "std_error"), "estimate", "std_error")


GROUPS = {"0 none": "1", "1 controls": "1", "2 year": "year", "3 sector": "sector", "4 sector-year": "sector, year", "4 firm": "firm", "1 plain": "1", "2 controls": "1"}


def models_sql(specs, expressions=None, source="panel") -> str:
    """The models (spec, regressors) as SQL; the part of a spec's name behind ': ' names its groups."""
    parts, outs = [], []
    for i, (spec, xs) in enumerate(specs):
        parts.append(least_squares_sql(f"m{i}_", spec, {x: (expressions or {}).get(x, x) for x in xs}, GROUPS[spec.split(": ")[-1]], source))
        outs.append(f"SELECT * FROM m{i}_o")
    return f"WITH {PANEL}, " + ", ".join(parts) + " SELECT spec, term, n, round(estimate, 6) AS estimate, round(r2, 6) AS r2 FROM (" + " UNION ALL ".join(outs) + ")"


def panel_specs(with_firms: bool):
    """Three panels: size, rating and orders (for controversies) as the main score, the other two as controls."""
    specs = [m for main, pair in MAIN.items() for m in G.panel_specs(pair, [c for c in MAIN if c != main], f"{main}: ")]
    return [m for m in specs if m[3] == with_firms]


@query("i10_panel_models", models_sql([(spec, xs) for spec, xs, _, _ in panel_specs(False)]))
def _(spark, d):
    out = G.fit_all(panel(spark, d, MAIN), "transp", panel_specs(False)).where("term <> '(Intercept)'")
    return rounded(out.select("spec", "term", "n", "estimate", "r2"), "estimate", "r2")


SECTORS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def two_effects_sql() -> str:
    """Firm effects by their means, sector-year effects by a dummy for each sector and year but the first."""
    dummies = {f"d{i}": f"CAST(sector = '{sector}' AND year = {year} AS DOUBLE)" for i, (sector, year) in enumerate((s, y) for s in SECTORS for y in range(1996, 2002))}
    specs = [(spec, xs) for spec, xs, _, _ in panel_specs(True)]
    parts = [least_squares_sql(f"m{i}_", spec, dummies | {x: x for x in xs}, "firm", "(SELECT * FROM panel WHERE sector IS NOT NULL)", len(dummies)) for i, (spec, xs) in enumerate(specs)]
    outs = " UNION ALL ".join(f"SELECT * FROM m{i}_o" for i in range(len(specs)))
    return f"WITH {PANEL}, " + ", ".join(parts) + f" SELECT spec, term, n, round(estimate, 6) AS estimate, round(r2, 6) AS r2 FROM ({outs})"


@query("i10_panel_two_effects", two_effects_sql())
def _(spark, d):
    out = G.fit_all(panel(spark, d, MAIN), "transp", panel_specs(True))
    return rounded(out.select("spec", "term", "n", "estimate", "r2"), "estimate", "r2")


def trend_panel(spark, d, mains=("size",)):
    return panel(spark, d, mains).withColumn("t", (F.col("year") - 1995).cast("double"))


@query(
    "i12_trend_interactions",
    f"""WITH {PANEL}, x AS (SELECT transp, CAST(year - 1995 AS DOUBLE) AS t, CASE WHEN q10 = 1 THEN 'q10' WHEN q90 = 1 THEN 'q90' ELSE 'mid' END AS g FROM panel WHERE q10 IS NOT NULL),
  l AS (SELECT g, regr_slope(transp, t) AS s, regr_intercept(transp, t) AS i FROM x GROUP BY ALL), m AS (SELECT s AS s0, i AS i0 FROM l WHERE g = 'mid')
  SELECT term, round(e, 6) AS estimate FROM (SELECT '(Intercept)' AS term, i0 AS e FROM m UNION ALL SELECT 't', s0 FROM m
    UNION ALL SELECT g, i - i0 FROM l, m WHERE g <> 'mid' UNION ALL SELECT g || ':t', s - s0 FROM l, m WHERE g <> 'mid')""",
)
def _(spark, d):
    data = G.with_interactions(trend_panel(spark, d), [("q10", "t"), ("q90", "t")])
    return rounded(G.fit(data, "transp", ["q10", "q90", "t", "q10:t", "q90:t"], "1 plain").select("term", "estimate"), "estimate")


def trend_specs():
    out = []
    for main, (low, high) in MAIN.items():
        base = [low, high, "t", f"{low}:t", f"{high}:t"]
        full = [*base, *[c for c in MAIN if c != main]]
        out += [(f"{main}: {spec}", xs) for spec, xs in (("1 plain", base), ("2 controls", full), ("3 sector", full), ("4 firm", full))]
    return out


TREND_TERMS = {"t": "CAST(year - 1995 AS DOUBLE)"} | {f"{x}:t": f"{x} * CAST(year - 1995 AS DOUBLE)" for pair in MAIN.values() for x in pair}


@query("i12_trend_models", models_sql(trend_specs(), TREND_TERMS))
def _(spark, d):
    rows = cut_lineage(trend_panel(spark, d, MAIN))
    parts = [G.trend_models(rows, [c for c in MAIN if c != main], *pair).withColumn("spec", F.concat(F.lit(f"{main}: "), "spec")) for main, pair in MAIN.items()]
    out = G.union_all(parts).where("term <> '(Intercept)'")
    return rounded(out.select("spec", "term", "n", "estimate", "r2"), "estimate", "r2")


OUT_YEARS = list(range(1995, 2002))


def outcome(rows, column):
    """Share of the first three indicators reported next to the log of the first, extracted or licensed."""
    share = rows.where("indicator <= 3").groupBy("firm", "year").agg(F.avg(F.col("exists").cast("double")).alias("transp"))
    total = rows.where("indicator = 1").select("firm", "year", F.ln(column).alias("log_total"))
    return share.join(total, ["firm", "year"]).where(F.col("log_total").isNotNull())


def outcome_sql(name, column):
    return f"""{name}s AS (SELECT m.firm, m.year, t.transp, ln({column}) AS y FROM merged m JOIN (SELECT firm, year, avg(CAST("exists" AS INT)) AS transp FROM merged WHERE indicator <= 3 GROUP BY ALL) t USING (firm, year) WHERE indicator = 1 AND {column} IS NOT NULL),
  {name}m AS (SELECT year, avg(y) AS my, avg(transp) AS mx, count(*) AS n FROM {name}s GROUP BY ALL),
  {name}b AS (SELECT sum((transp - mx) * (y - my)) / sum((transp - mx) * (transp - mx)) AS b FROM {name}s JOIN {name}m USING (year)),
  {name}o AS (SELECT '{name}' AS outcome, '1 years' AS spec, 'year' || a.year AS term, a.my - z.my AS e FROM {name}m a, {name}m z WHERE z.year = 1995 AND a.year > 1995
    UNION ALL SELECT '{name}', '1 years', '(Intercept)', my FROM {name}m WHERE year = 1995
    UNION ALL SELECT '{name}', '2 years and transp', 'year' || a.year, (a.my - z.my) - b * (a.mx - z.mx) FROM {name}m a, {name}m z, {name}b WHERE z.year = 1995 AND a.year > 1995
    UNION ALL SELECT '{name}', '2 years and transp', '(Intercept)', my - b * mx FROM {name}m, {name}b WHERE year = 1995 UNION ALL SELECT '{name}', '2 years and transp', 'transp', b FROM {name}b)"""


@query(
    "i13_outcome_models",
    f"WITH {TRUTH}, {outcome_sql('extracted', 'value_final')}, {outcome_sql('licensed', 'ref_value')} SELECT outcome, spec, term, round(e, 5) AS estimate, CASE WHEN term <> '(Intercept)' THEN round(exp(e), 5) END AS exp_estimate FROM (SELECT * FROM extractedo UNION ALL SELECT * FROM licensedo)",
)
def _(spark, d):
    rows = cut_lineage(merged(spark, d).where("indicator <= 3").select("firm", "year", "indicator", "exists", "value_final", "ref_value"))
    parts = [
        G.outcome_models(outcome(rows, column), "log_total", OUT_YEARS).withColumn("outcome", F.lit(name))
        for name, column in (("extracted", "value_final"), ("licensed", "ref_value"))
    ]
    out = G.union_all(parts).select("outcome", "spec", "term", "estimate", "exp_estimate")
    return rounded(out, "estimate", "exp_estimate", digits=5)
