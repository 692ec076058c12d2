"""Exact top-k by grouped aggregate: the correctness anchor of every other plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillon.config import Agg

RESULT = "aggregate"


def aggregate_column(agg: Agg, value: Column) -> Column:
    """The aggregate of ``value``; COUNT counts rows, whatever the value."""
    return {Agg.SUM: F.sum(value), Agg.COUNT: F.count(F.lit(1)), Agg.MAX: F.max(value), Agg.MIN: F.min(value)}[agg]


def all_aggregates(value: Column) -> list[Column]:
    """Sum, count, maximum and minimum in one pass; partial aggregation merges them before the shuffle."""
    return [F.sum(value).alias("sum"), F.count(F.lit(1)).alias("count"), F.max(value).alias("max"), F.min(value).alias("min")]


def ranked(df: DataFrame, keys: Sequence[str], k: int, by: str = RESULT) -> DataFrame:
    """The ``k`` rows with the largest ``by``, ties to the smaller key; none for k <= 0."""
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in keys]).limit(max(k, 0))


def group_aggregate(df: DataFrame, keys: Sequence[str], value: Column, agg: Agg) -> DataFrame:
    return df.groupBy(*keys).agg(aggregate_column(agg, value).alias(RESULT))


def exact_top_k(df: DataFrame, keys: Sequence[str], value: Column, k: int, agg: Agg) -> DataFrame:
    """``GROUP BY keys ORDER BY agg DESC, keys LIMIT k``: one shuffle of partial aggregates, then a bounded take."""
    return ranked(group_aggregate(df, keys, value, agg), keys, k)
