"""The paths for data that does not fit one task, forced by small limits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlens.operators import quantiles, scale
from firmlens.operators.quantiles import exact_quantiles
from firmlens.operators.scale import attach, running_before, small_side, spread_lookup, with_each
from firmlens.operators.validation import spearman
from firmlens.session import cut_lineage


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot", float(rng.choice([1.0, 1.0, 1.0, rng.gauss(0, 50)]))) for _ in range(30_000)]
    rows += [("cold", float(i)) for i in range(7)] + [(None, 5.0), (None, 6.0), ("hot", None), ("hot", float("nan"))]
    return spark.createDataFrame(rows, "k string, v double").persist()


PROBS = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("group_rows", [1_000_000, 100])
def test_quantiles_equal_numpy(skewed, group_rows):
    names = [f"q{i}" for i in range(len(PROBS))]
    got = {r["k"]: [r[n] for n in names] for r in exact_quantiles(skewed, ["k"], "v", PROBS, names, group_rows).collect()}
    want = {}
    for r in skewed.where("v IS NOT NULL AND NOT isnan(v)").collect():
        want.setdefault(r["k"], []).append(r["v"])
    assert set(got) == {"hot", "cold", None}
    for k, v in want.items():
        assert np.allclose(got[k], np.quantile(v, PROBS), rtol=0, atol=1e-9)


def test_quantiles_stay_exact_with_a_useless_sketch(skewed, monkeypatch):
    monkeypatch.setattr(quantiles, "BRACKET", 0.0)
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 3)
    got = exact_quantiles(skewed.where("k = 'hot'"), ["k"], "v", [0.37, 0.93], ["a", "b"], 100).first()
    values = [r["v"] for r in skewed.where("k = 'hot' AND v IS NOT NULL AND NOT isnan(v)").collect()]
    assert np.allclose([got["a"], got["b"]], np.quantile(values, [0.37, 0.93]))


def test_quantiles_agree_to_the_last_bit(spark):
    """Thresholds sit on these values, so both ways must round alike."""
    df = spark.range(4000).select((F.col("id") % 2).alias("k"), (F.rand(7) * 1e6).alias("v"))
    probs, names = [0.1, 1 / 3, 2 / 3, 0.9, 0.99], list("abcde")
    ways = [{r["k"]: tuple(r) for r in exact_quantiles(df, ["k"], "v", probs, names, rows).collect()} for rows in (10**9, 50)]
    assert ways[0] == ways[1]


@pytest.mark.parametrize("group_rows", [1_000_000, 10])
def test_running_before(spark, group_rows):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") % 11).alias("w"))
    got = {(r["k"], r["o"]): r["before"] for r in running_before(df, ["k"], ["o"], "w", group_rows=group_rows).collect()}
    totals = [0, 0, 0]
    for i in range(5000):
        assert got[(i % 3, i)] == totals[i % 3]
        totals[i % 3] += i % 11


def test_small_side_falls_back(spark):
    df = spark.range(50)
    assert small_side(df, max_rows=10) is df
    assert small_side(df, max_rows=50) is not df


def test_with_each_has_no_join(spark):
    out = with_each(spark.range(4).toDF("a"), spark.range(3).toDF("b"))
    assert out.count() == 12
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("block", [2, 10**9])
def test_with_each_at_any_dimension_size(spark, block):
    out = with_each(spark.range(4).toDF("a"), spark.range(30).toDF("b"), block=block)
    assert sorted((r["a"], r["b"]) for r in out.collect()) == [(a, b) for a in range(4) for b in range(30)]


def test_attach_is_the_same_at_any_table_size(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")).withColumn("k", F.when(F.col("v") % 3 > 0, F.lit(1)).otherwise(F.col("k")))
    table = cut_lineage(spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w")))
    broadcast = attach(rows, ["k"], table, F.xxhash64("v"))
    looked_up = spread_lookup(rows, ["k"], table, F.xxhash64("v"))
    assert sorted(map(tuple, broadcast.collect()), key=str) == sorted(map(tuple, looked_up.select(*broadcast.columns).collect()), key=str)


@pytest.mark.parametrize("group_rows", [1_000_000, 20])
def test_spearman_ranks_with_ties(spark, group_rows):
    rng = random.Random(3)
    rows = [("g", rng.randint(0, 20), rng.randint(0, 30)) for _ in range(2000)]
    got = spearman(spark.createDataFrame(rows, "k string, a long, b long"), ["k"], "a", "b", group_rows).first()
    import pandas as pd

    want = pd.DataFrame(rows, columns=["k", "a", "b"])[["a", "b"]].rank().corr().iloc[0, 1]
    assert got["n"] == 2000 and abs(got["cor"] - want) < 1e-12


def test_spearman_of_a_group_whose_cube_leaves_a_long(spark):
    """Counted pairs, so that few rows stand for 2.4 million."""
    rows = spark.range(2_400_000).select(F.lit("g").alias("k"), (F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"))
    got = spearman(rows, ["k"], "a", "b").first()
    assert got["n"] == 2_400_000 and abs(got["cor"]) < 1e-12 and abs(got["s_statistic"] / (2_400_000.0**3 / 6) - 1) < 1e-9


def test_limits_are_declared():
    assert scale.BROADCAST_ROWS <= 1_000_000 and scale.GROUP_ROWS <= 10_000_000


def test_pivoted_cells_are_no_wide_sums(spark):
    """Sums over as many columns as there are fields would stand in every task, before and after the shuffle."""
    from firmlens.operators.firmpanel import pivot_fields

    cells = spark.createDataFrame([(1, "a", 1.0), (1, "c", None), (2, "b", 2.0), (2, "other", 9.0), (None, "a", 3.0)], "k long, f string, v double")
    out = pivot_fields(cells, ["k"], "f", "v", ["a", "b", "c"])
    assert "pivotfirst" not in out._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 1.0, None, None), (2, None, 2.0, None), (None, 3.0, None, None)]
    with pytest.raises(Exception, match="duplicate key and field"):
        pivot_fields(cells.union(cells), ["k"], "f", "v", ["a", "b", "c"]).collect()


def test_known_unit_texts_spare_the_rows(spark):
    """The distinct unit texts are staged at once; with ``texts`` the rows, and the joins behind them, are not read for that."""
    from firmlens.operators.harmonise import harmonise

    unit = F.raise_error(F.lit("the rows were read")).cast("string")
    rows = spark.range(1).select(F.lit(0).alias("indicator"), F.lit(2000).alias("year"), F.lit("1").alias("value"), unit.alias("unit"), F.lit(True).alias("valid"))
    types = spark.createDataFrame([(0, "decimal")], "indicator int, type_standard string")
    assert "valid" in harmonise(rows, types, None, texts=spark.createDataFrame([("kg",)], "unit string")).columns


def test_harmonised_rows_stay_where_they_are(spark):
    """Types and units are settled, so the rows are not shuffled to meet them, however many bytes their few thousand texts have."""
    from firmlens.operators.harmonise import harmonise

    rows = spark.range(5).select(F.col("id").cast("int").alias("indicator"), F.lit(2000).alias("year"), F.lit("1").alias("value"), F.lit("kg").alias("unit"), F.lit(True).alias("valid"))
    types = spark.createDataFrame([(i, "tonnes") for i in range(5)], "indicator int, type_standard string")
    texts = spark.range(5000).select(F.concat(F.lit("kg"), F.when(F.col("id") > 0, F.md5(F.col("id").cast("string"))).otherwise("")).alias("unit"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        out = harmonise(rows, types, None, texts=texts)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        assert {r["value_num"] for r in out.collect()} == {1e-3}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_large_narrow_side_is_hashed(spark):
    wide, narrow = spark.range(10).toDF("k"), spark.range(10_000_000).toDF("k")
    plan = lambda right: wide.repartition(3).hint("shuffle_hash").join(right, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert scale.hash_side(wide) is wide and scale.hash_side(narrow) is not narrow
    assert "rightHint=(strategy=shuffle_hash)" in plan(scale.hash_side(narrow))


def test_ground_truth_reads_the_line_items_once(spark):
    from firmlens.plans.stat_queries import merged

    plan = merged(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert "l_orderkey" not in plan.toString()
