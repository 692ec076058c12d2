from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillon.config import Agg, Mode, TopKConfig
from quillon.functions.bounds import bucket_of
from quillon.operators import compare, pruning, sampling
from quillon.operators.exact import exact_top_k
from quillon.plans.engine import top_k

SMALL = TopKConfig(fa_capacity=8, n_partitions=16, sample_frac=0.2, force=True, measure_m=3, min_topk_share=0.0)


def pairs(df):
    return [tuple(r) for r in df.collect()]


def skewed(spark, n=4000, groups=300, seed=1, low=0):
    rng = random.Random(seed)
    rows = [(int(groups * rng.random() ** 3), float(rng.randint(low, 100))) for _ in range(n)]
    return spark.createDataFrame(rows, "g long, v double")


@pytest.mark.parametrize("mode", list(Mode))
@pytest.mark.parametrize("agg", list(Agg))
def test_all_modes_equal_exact(spark, mode, agg):
    df = skewed(spark, low=-20)
    for k in (1, 10, 1000):
        assert pairs(top_k(df, "g", "v", k, agg, mode, SMALL).df) == pairs(exact_top_k(df, ["g"], F.col("v"), k, agg))


def test_upper_bounds_take_no_part_in_the_threshold(spark):
    """Buckets of many small groups have large sums; a threshold over them would drop the single group C."""
    rows = [("A", 10.0), ("B", 9.0), ("C", 9.5)] + [(f"p{i}", 1.0) for i in range(100)] + [(f"q{i}", 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v double")
    for n in (3, 4, 8, 64):
        config = TopKConfig(fa_capacity=2, n_partitions=n)
        assert [r[0] for r in pairs(top_k(df, "g", "v", 2, "SUM", Mode.SAMPLE, config, candidates=[("A",), ("B",)]).df)] == ["A", "C"]


def test_boundary_ties_go_to_smaller_keys(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(200)], "g long, v double")
    for agg in Agg:
        for mode in Mode:
            assert [r[0] for r in pairs(top_k(df, "g", "v", 10, agg, mode, SMALL).df)] == list(range(10))


@pytest.mark.parametrize("agg", list(Agg))
def test_three_levels_terminate(spark, agg):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "g long, v double")
    config = TopKConfig(fa_capacity=2, n_partitions=8, force=True, max_levels=3, alpha_locality=0.0)
    result = top_k(df, "g", "v", 12, agg, Mode.SAMPLE, config)
    assert pairs(result.df) == pairs(exact_top_k(df, ["g"], F.col("v"), 12, agg))


@pytest.mark.parametrize("k,n", [(0, 0), (-1, 0), (1, 1), (4, 4), (9, 4)])
def test_sizes(spark, k, n):
    df = spark.createDataFrame([(i, 1.0) for i in range(4)], "g long, v double")
    for mode in Mode:
        assert top_k(df, "g", "v", k, "MAX", mode, SMALL).df.count() == n


def test_empty_input(spark):
    df = spark.createDataFrame([], "g long, v double")
    for mode in Mode:
        assert top_k(df, "g", "v", 5, "SUM", mode).df.collect() == []


def test_nulls_and_nan(spark):
    df = spark.createDataFrame([(None, 7.0), (None, 2.0), (1, None), (1, 4.0), (2, None), (3, 1.0)], "g long, v double")
    for agg in Agg:
        expected = pairs(exact_top_k(df, ["g"], F.col("v"), 9, agg))
        for mode in Mode:
            assert pairs(top_k(df, "g", "v", 9, agg, mode, SMALL).df) == expected
            assert pairs(top_k(df, "g", "v", 9, agg, mode, SMALL, candidates=[(None,), (2,)]).df) == expected
    bad = df.unionByName(spark.createDataFrame([(5, float("nan"))], df.schema))
    result = top_k(bad, "g", "v", 2, "MAX", Mode.SAMPLE, SMALL)
    assert result.metrics.fallback_reason == "NaN measures" and pairs(result.df)[0][0] == 5


def test_all_negative(spark):
    df = spark.createDataFrame([(i, -1.0 - i % 13) for i in range(400)], "g long, v double")
    for agg in Agg:
        for mode in Mode:
            assert pairs(top_k(df, "g", "v", 7, agg, mode, SMALL).df) == pairs(exact_top_k(df, ["g"], F.col("v"), 7, agg))


def test_gate_falls_back_on_uniform_groups(spark):
    df = spark.range(4000).select((F.col("id") % 1000).alias("g"), F.lit(1.0).alias("v"))
    result = top_k(df, "g", "v", 3, "SUM", Mode.SAMPLE, TopKConfig(fa_capacity=5000, sample_frac=0.5, min_topk_share=0.05, min_rows_per_core=0))
    assert "too little" in result.metrics.fallback_reason and not result.metrics.is_optimizable and result.metrics.total_passes == 0


def test_string_and_composite_keys(spark):
    df = skewed(spark).select(F.concat(F.lit("k"), F.col("g")).alias("a"), (F.col("g") % 3).alias("b"), "v")
    for mode in Mode:
        assert pairs(top_k(df, ["a", "b"], "v", 9, "SUM", mode, SMALL).df) == pairs(exact_top_k(df, ["a", "b"], F.col("v"), 9, Agg.SUM))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(-20, 20)), max_size=80), st.integers(1, 8), st.integers(1, 9), st.sets(st.integers(0, 30), max_size=5), st.sampled_from(list(Agg)))
def test_threshold_is_sound(rows, k, n, candidates, agg):
    """It never exceeds the true k-th value, and no bucket with a true winner is dropped."""
    groups: dict[int, list[int]] = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    value = {g: {Agg.SUM: sum(v), Agg.COUNT: len(v), Agg.MAX: max(v), Agg.MIN: min(v)}[agg] for g, v in groups.items()}
    buckets: dict[int, list[int]] = {}
    for g, v in groups.items():
        if g not in candidates:
            buckets.setdefault(g % n, []).extend(v)
    lows = {b: {Agg.SUM: max(v) if min(v) >= 0 else None, Agg.COUNT: 1, Agg.MAX: max(v), Agg.MIN: min(v)}[agg] for b, v in buckets.items()}
    highs = {b: {Agg.SUM: sum(x for x in v if x > 0), Agg.COUNT: len(v), Agg.MAX: max(v), Agg.MIN: max(v)}[agg] for b, v in buckets.items()}
    bound = pruning.threshold([value[g] for g in candidates if g in value], lows.values(), k)
    ranked = sorted(value.items(), key=lambda x: (-x[1], x[0]))[:k]
    if len(ranked) == k:
        assert bound <= ranked[-1][1]
    else:
        assert bound == -math.inf
    for g, _ in ranked:
        assert g in candidates or pruning.survives(highs[g % n], bound)


def test_buckets_differ_between_levels(spark):
    df = spark.range(2000).select("id", bucket_of(["id"], 1, 8).alias("a"), bucket_of(["id"], 2, 8).alias("b"))
    assert df.where("a = 3").select("b").distinct().count() == 8


def test_sample_size():
    assert sampling.sample_size(10**9, TopKConfig(sample_frac=1e-9)) == 385
    assert sampling.sample_size(100, TopKConfig()) == 100
    assert sampling.sample_size(10**6, TopKConfig()) == 10**4


def test_underrepresentation(spark):
    row = spark.range(1).select(sampling.underrepresented(F.lit(100), F.lit(0), 1000, 1000, 0.5).alias("a"), sampling.underrepresented(F.lit(100), F.lit(80), 1000, 1000, 0.5).alias("b"), sampling.underrepresented(F.lit(1), F.lit(0), 1000, 10, 0.5).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, False, False)


def test_forced_groups_fill_candidates(spark):
    df = skewed(spark)
    result = top_k(df, "g", "v", 5, "MAX", Mode.EXTREMES, TopKConfig(fa_capacity=4, n_partitions=50, measure_m=100, force=True))
    assert len(result.candidates) == 4 and pairs(result.df) == pairs(exact_top_k(df, ["g"], F.col("v"), 5, Agg.MAX))


def test_settings_are_checked():
    for bad in ({"n_partitions": 0}, {"fa_capacity": 0}, {"sample_frac": 0}, {"boost_rows": -1}, {"beta_ci": 1.0}):
        with pytest.raises(ValueError):
            TopKConfig(**bad)
    with pytest.raises(ValueError):
        Agg.parse("AVERAGE")
    with pytest.raises(ValueError):
        Mode.parse("fast")
    assert Agg.parse("sum") is Agg.SUM and Mode.parse("ext-ab") is Mode.COMBINED


def test_plan_is_lean(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = exact_top_k(df, ["l_suppkey"], F.col("l_extendedprice"), 5, Agg.SUM)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "partial_sum" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double>" in plan


def test_comparisons(spark):
    groups = [("a", 5.0), ("b", 4.0), ("c", 4.0), ("d", 1.0)]
    assert compare.tie_aware_match(groups, [("a", 5.0), ("c", 4.0)], 2)
    assert not compare.tie_aware_match(groups, [("b", 4.0), ("c", 4.0)], 2)
    assert not compare.tie_aware_match(groups, [("a", 5.0), ("d", 1.0)], 2)
    assert compare.same_values([1.0, 2.0], [2.0005, 1.0], 1e-3) and not compare.same_values([1.0], [1.0, 1.0])
    a, b = spark.createDataFrame(groups, "g string, v double"), spark.createDataFrame(groups[:3], "g string, v double")
    missing, extra = compare.missing_and_extra(a, b, ["g"])
    assert [r[0] for r in missing.collect()] == ["d"] and extra.isEmpty()
    assert not compare.same_keys(a, b, ["g"]) and compare.same_keys(a, a, ["g"])
    assert compare.hit_rate(b, a, ["g"], 4) == 0.75
    runs = spark.createDataFrame([("x", "brute-force", 1000, 10.0, 5), ("x", "ext-a", 1000, 5.0, 10)], "dataset string, mode string, n_rows long, total_duration_ms double, sample_size_actual long")
    rates = {r["mode"]: r["speedup"] for r in compare.run_rates(runs).collect()}
    assert rates == {"brute-force": 1.0, "ext-a": 2.0}
    assert [r[0] for r in compare.mode_ranking(runs).collect()] == ["ext-a", "brute-force"]
    assert compare.mode_table(runs).first()["ext-a"] == 5.0
    assert compare.mean_by(runs, ["dataset"], "total_duration_ms").first()[1] == 7.5
    assert compare.sample_fraction(runs).agg(F.max("sample_fraction")).first()[0] == 0.01


def test_few_rows_take_the_exact_plan(spark):
    df = skewed(spark)
    for mode in Mode:
        result = top_k(df, "g", "v", 5, "SUM", mode)
        assert pairs(result.df) == pairs(exact_top_k(df, ["g"], F.col("v"), 5, Agg.SUM))
        assert mode is Mode.EXACT or not result.metrics.is_optimizable and "one shuffle" in result.metrics.fallback_reason


def test_extremes_of_the_shared_index(spark):
    """One scan gives row counts and extremes; the extremes hold all groups of the largest rows."""
    df = skewed(spark).withColumnRenamed("v", sampling.VALUE)
    index = sampling.group_index(df, ["g"])
    assert sorted(pairs(index.select("g", "row_count"))) == sorted(pairs(sampling.occurrence_index(df, ["g"])))
    few, all_of = {r[0] for r in pairs(sampling.measure_index(df, ["g"], 40))}, {r[0] for r in pairs(sampling.extremes_of(index, ["g"], 40))}
    assert len(all_of) == 40 and len(few) <= 40
    values = dict(pairs(index.select("g", "most")))
    assert min(values[g] for g in all_of) >= max(v for g, v in values.items() if g not in all_of)
    config = TopKConfig(fa_capacity=8, n_partitions=16, sample_frac=0.2, force=True, measure_m=3, boost_rows=4, min_topk_share=0.0)
    for agg in Agg:  # fewer extremes than k: stratified from the shared index
        assert pairs(top_k(skewed(spark), "g", "v", 10, agg, Mode.COMBINED, config).df) == pairs(exact_top_k(skewed(spark), ["g"], F.col("v"), 10, agg))


def test_boosted_rows_are_the_first_of_the_scan(spark):
    df = spark.createDataFrame([(g, float(i)) for i in range(30) for g in (1, 2)], f"g long, {sampling.VALUE} double").coalesce(1)
    none = sampling.sample_statistics(df.where("false"), ["g"])
    index = sampling.group_index(df, ["g"])
    got = sampling.boosted_rows(df, ["g"], none, index, 60, 6, TopKConfig(boost_rows=5))
    assert sorted(pairs(got)) == sorted((g, float(i)) for i in range(5) for g in (1, 2))


def test_physical_rows_move_together(spark):
    df = spark.createDataFrame([(i % 300, float(i % 7)) for i in range(3000)], "g long, v double")
    config = TopKConfig(fa_capacity=6, n_partitions=8, force=True, max_levels=3, alpha_locality=0.0)
    result = top_k(df, "g", "v", 12, "COUNT", Mode.SAMPLE, config, candidates=[(0,), (1,)])
    assert result.metrics.partitions_physical > 0 and result.held
    assert pairs(result.df) == pairs(exact_top_k(df, ["g"], F.col("v"), 12, Agg.COUNT))
    result.release()
    assert not result.held


def test_computed_inputs_are_kept_for_the_passes(spark):
    df = skewed(spark)
    joined = df.join(df.groupBy("g").agg(F.max("v").alias("w")), "g")
    result = top_k(joined, "g", "w", 5, "SUM", Mode.SAMPLE, SMALL)
    assert len(result.held) >= 1 and pairs(result.df) == pairs(exact_top_k(joined, ["g"], F.col("w"), 5, Agg.SUM))
    result.release()


def test_modes_that_count_all_groups_take_the_exact_plan(spark):
    df = skewed(spark)
    for mode, options in ((Mode.STRATIFIED, {}), (Mode.COMBINED, {"measure_m": 3})):
        config = TopKConfig(fa_capacity=50, n_partitions=16, sample_frac=0.2, min_topk_share=0.0, min_rows_per_core=1, **options)
        result = top_k(df, "g", "v", 5, "SUM", mode, config)
        assert "count all groups" in result.metrics.fallback_reason and pairs(result.df) == pairs(exact_top_k(df, ["g"], F.col("v"), 5, Agg.SUM))
    config = TopKConfig(fa_capacity=400, n_partitions=16, sample_frac=0.2, min_topk_share=0.0, min_rows_per_core=1, boost_rows=0)
    assert top_k(df, "g", "v", 5, "SUM", Mode.STRATIFIED, config).metrics.is_optimizable
