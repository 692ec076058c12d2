"""Comparing results and runs: set, order and value agreement, rates, rankings and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quillon.operators.exact import RESULT


def hit_rate(candidates: DataFrame, winners: DataFrame, keys: Sequence[str], k: int) -> float:
    """Share of the true top k that were candidates."""
    n = winners.count()
    hits = winners.join(candidates.select(*keys).distinct(), list(keys), "left_semi").count()
    return hits / min(k, n) if min(k, n) > 0 else 0.0


def missing_and_extra(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Keys expected but not there, and keys there but not expected."""
    return expected.select(*keys).subtract(actual.select(*keys)), actual.select(*keys).subtract(expected.select(*keys))


def same_pairs(expected: Sequence[tuple], actual: Sequence[tuple]) -> bool:
    """The same rows in the same order, of k rows each."""
    return [tuple(r) for r in expected] == [tuple(r) for r in actual]


def same_keys(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> bool:
    missing, extra = expected.select(*keys).exceptAll(actual.select(*keys)), actual.select(*keys).exceptAll(expected.select(*keys))
    return missing.isEmpty() and extra.isEmpty()


def same_values(expected: Sequence[float], actual: Sequence[float], tolerance: float = 0.0) -> bool:
    """The same multiset of aggregates, each within ``tolerance``."""
    return len(expected) == len(actual) and all(abs(a - b) <= tolerance for a, b in zip(sorted(expected), sorted(actual)))


def tie_aware_match(every_group: Sequence[tuple], actual: Sequence[tuple], k: int, tolerance: float = 1e-6) -> bool:
    """Whether (key, aggregate) rows are a top k: all groups above the boundary value, and boundary ties for the rest."""
    ordered = sorted(every_group, key=lambda r: -r[1])
    if len(actual) != min(max(k, 0), len(ordered)):
        return False
    if not actual:
        return True
    edge = ordered[len(actual) - 1][1]
    above = {g for g, v in ordered if v > edge + tolerance}
    tied = {g for g, v in ordered if abs(v - edge) <= tolerance}
    values, chosen = dict(ordered), {g for g, _ in actual}
    return len(chosen) == len(actual) and above <= chosen and chosen - above <= tied and all(abs(values[g] - v) <= tolerance for g, v in actual)


def run_rates(runs: DataFrame, baseline: str = "brute-force", by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Each run beside the baseline run of the same ``by``: rows a second and speed-up."""
    base = runs.where(F.col("mode") == baseline).select(*by, F.col("total_duration_ms").alias("__base"))
    joined = runs.join(base, list(by), "left")
    return joined.select(*runs.columns, (F.col("n_rows") / (F.col("total_duration_ms") * 1000)).alias("throughput_Mrows_s"), (F.col("__base") / F.col("total_duration_ms")).alias("speedup"), (F.col("total_duration_ms") - F.col("__base")).alias("delta_ms"))


def mode_ranking(runs: DataFrame) -> DataFrame:
    """Modes by duration."""
    return runs.select("mode", "total_duration_ms").orderBy("total_duration_ms", "mode")


def mode_table(runs: DataFrame, value: str = "total_duration_ms", modes: Sequence[str] | None = None) -> DataFrame:
    """Datasets by mode."""
    grouped = runs.groupBy("dataset")
    return (grouped.pivot("mode", list(modes)) if modes else grouped.pivot("mode")).agg(F.first(value))


def mean_by(runs: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"))


def sample_fraction(runs: DataFrame) -> DataFrame:
    return runs.withColumn("sample_fraction", F.col("sample_size_actual") / F.col("n_rows"))


def result_pairs(df: DataFrame, keys: Sequence[str]) -> list[tuple]:
    """The ranked rows as tuples."""
    return [tuple(r) for r in df.select(*keys, RESULT).collect()]
