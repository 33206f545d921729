"""Panel preparation, groups and coverage on small rows."""

import pytest
from pyspark.sql import functions as F

from firmlens.functions.labels import category_number, relabel, short_label
from firmlens.functions.ratings import TRIPLE_SCALE, coded, rating_codes
from firmlens.operators import coverage as C
from firmlens.operators import firmpanel as E
from firmlens.operators import performance as P
from firmlens.operators import transparency as T


def test_restatements_fill_gaps(spark):
    rows = [("i", 2020, 2, None, 5.0), ("i", 2020, 1, 3.0, 4.0), ("i", 2020, 0, 9.0, None), ("j", 2020, 1, None, None)]
    got = E.latest_restatement(spark.createDataFrame(rows, "isin string, year int, freq int, a double, b double"), ["isin", "year"], F.col("freq"), ["a", "b"])
    assert {r["isin"]: (r["a"], r["b"]) for r in got.collect()} == {"i": (3.0, 5.0), "j": (None, None)}


def test_lag_respects_gap_years(spark):
    df = spark.createDataFrame([("f", 2014, 1.0), ("f", 2016, 2.0), ("f", 2017, 3.0)], "firm string, year int, x double")
    assert {r["year"]: r["x_lagged"] for r in E.with_lag(df, df, ["x"]).collect()} == {2014: None, 2016: None, 2017: 2.0}


def test_pivot_stops_on_duplicates(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "x", "3")], "k string, f string, v string")
    assert {r["k"]: (r["x"], r["y"]) for r in E.pivot_fields(df, ["k"], "f", "v", ["x", "y"]).collect()} == {"a": ("1", "2"), "b": ("3", None)}
    with pytest.raises(Exception, match="duplicate"):
        E.pivot_fields(df.union(df.limit(1)), ["k"], "f", "v", ["x", "y"]).collect()


def test_rating_codes_name_their_direction(spark):
    assert rating_codes(TRIPLE_SCALE, best="low")["AAA"] == 1 and rating_codes(TRIPLE_SCALE)["AAA"] == 7
    assert rating_codes(TRIPLE_SCALE, worst_code=0)["CCC"] == 0
    row = spark.sql("SELECT 'AA' AS a, 'zz' AS b").select(coded(F.col("a"), rating_codes(TRIPLE_SCALE)), coded(F.col("b"), rating_codes(TRIPLE_SCALE))).first()
    assert tuple(row) == (6, None)


def test_groups_keep_null_scores_apart(spark):
    df = spark.createDataFrame([(2020, float(i)) for i in range(11)] + [(2020, None)], "year int, s double")
    high = {r["s"]: r["g"] for r in T.group_by_thresholds(df, "s", "g").collect()}
    assert high[10.0] == high[9.0] == "Top 10%" and high[0.0] == high[1.0] == "Bottom 10%" and high[5.0] == "Middle 80%" and high[None] is None
    low = {r["s"]: r["g"] for r in T.group_by_thresholds(df, "s", "g", best="low", null_score="middle").collect()}
    assert low[0.0] == "Top 10%" and low[10.0] == "Bottom 10%" and low[None] == "Middle 80%"


def test_mean_of_means_is_not_pooled(spark):
    rows = [("a", 2020, "t", True)] * 1 + [("b", 2020, "t", False)] * 3
    cells = T.firm_cells(spark.createDataFrame(rows, "firm string, year int, std string, exists boolean"))
    assert T.mean_of_means(cells, ["year"]).first()["transp"] == 0.5


def test_winsorise_and_bands_are_ordered(spark):
    df = spark.createDataFrame([("l", 2020, float(i * i)) for i in range(101)] + [("l", 2020, None)], "label string, year int, value_final double")
    out = P.winsorised(df, ["label", "year"])
    assert out.agg(F.max("value_final")).first()[0] == 99.0**2 and out.where("value_final IS NULL").count() == 1
    b = P.bands(df, ["label", "year"]).first()
    assert b["p10"] <= b["q1"] <= b["median"] <= b["q3"] <= b["p90"] and b["median"] == 2500.0


def test_constant_reporters_need_all_years(spark):
    rows = [("i", "a", y, 1.0) for y in (2014, 2015)] + [("i", "b", 2014, 1.0), ("i", "b", 2015, None), ("i", "b", 2014, 2.0)]
    got = P.constant_reporters(spark.createDataFrame(rows, "indicator string, firm string, year int, value_final double"), [2014, 2015])
    assert [tuple(r) for r in got.collect()] == [("i", "a")]


def test_labels(spark):
    labels = ["Gender pay gap", "Gross Scope 3 greenhouse gas emissions: Category 7 Employee commuting", "Gross Scope 3 greenhouse gas emissions: Category 14 Franchises", "other"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    named = {r["label"] for r in relabel(df, "label").collect()}
    assert named == {"Gender pay gap [%]", "Category 7 Commuting [tCO₂eq]", "Category 14 Franchises [tCO₂eq]", "other"}
    row = spark.sql("SELECT 'Category 1.1 Cloud [tCO₂eq]' AS a, 'plain' AS b").select(category_number(F.col("a")), short_label(F.col("a")), category_number(F.col("b")), short_label(F.col("b"))).first()
    assert tuple(row) == (1.1, "Category 1.1 Cloud", None, "plain")


def test_report_ids_parse_from_the_right(spark):
    df = spark.createDataFrame([(x,) for x in ("a_b_2020_AR", "c_20x0_SR", "short_2020", "d_2021_")], "report_id string")
    got = {(r["firm"], r["year"], r["report_type"]) for r in C.parse_report_ids(df).collect()}
    assert got == {("a_b", 2020, "AR"), ("d", 2021, "")}


def test_funnel_links_add_up(spark):
    rows = [(str(i), 2020, "r" if i % 2 else None, i % 2 == 1, i % 3 == 0, i % 5 == 0) for i in range(60)]
    stages = spark.createDataFrame(rows, "firm string, year int, report_id string, report_available boolean, text_extracted boolean, chunks_present boolean")
    links = {(r["source"], r["target"]): r["n"] for r in C.stage_funnel(stages).collect()}
    assert links["all", "report"] + links["all", "no_report"] == 60
    assert links["report", "text"] + links["report", "no_text"] == links["all", "report"]
    assert links["text", "chunks"] + links["text", "no_chunks"] == links["report", "text"]


def test_rates_without_base_are_null(spark):
    df = spark.createDataFrame([("a", 0, 0, 0), ("b", 4, 2, 1)], "indicator string, n_possible long, n_extracted long, n_final long")
    got = {r["indicator"]: (r["disclosure_rate"], r["extraction_success"], r["overall_yield"]) for r in C.extractability_rates(df).collect()}
    assert got == {"a": (None, None, None), "b": (0.5, 0.5, 0.25)}


def test_odd_last_company_pairs_with_itself(spark):
    df = spark.createDataFrame([("a", "X", "s"), ("b", "X", "s"), ("c", "Y", "s"), ("d", "Y", None)], "name string, country string, sector string")
    got = {(r["sector"], r["name_1"], r["name_2"]) for r in C.paired_companies(df).collect()}
    assert got == {("s", "a", "b"), ("s", "c", "c"), (None, "d", "d")}


def test_detection_flag(spark):
    texts = ["{'value': None, 'unit': None}", "{'value': 'None'}", "{'value': None'}", "{'value': 3}", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(C.has_value_text(F.col("t"))).collect()] == [False, True, True, True, False]
