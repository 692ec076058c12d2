"""Column expressions of the pruned plans: bucket numbers, value bounds and sample estimates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from quillon.config import Agg


def bucket_of(keys: Sequence[str], level: int, n: int) -> Column:
    """Hash bucket of a key at a level; each level hashes anew, so a bucket's groups spread at the next."""
    return F.pmod(F.xxhash64(F.lit(level), *[F.col(k) for k in keys]), F.lit(n)).cast("int")


def upper_bound(agg: Agg, value: Column) -> Column:
    """An aggregate over a bucket that no single group in it can exceed."""
    if agg is Agg.SUM:
        return F.sum(F.when(value > 0, value).otherwise(value - value))  # a typed zero: decimals stay decimals
    return F.count(F.lit(1)) if agg is Agg.COUNT else F.max(value)


def lower_bound(agg: Agg, value: Column) -> Column:
    """An aggregate over a bucket that some group in it is sure to reach; null where nothing is sure."""
    if agg is Agg.SUM:
        return F.when(F.min(value) >= 0, F.max(value))
    if agg is Agg.COUNT:
        return F.lit(1).cast("long")
    return F.max(value) if agg is Agg.MAX else F.min(value)


def estimated_per_group(agg: Agg, total: Column, count: Column, most: Column, groups: Column) -> Column:
    """What a group of a bucket is likely to have: the even share of a sum or count, else the maximum."""
    share = {Agg.SUM: total.cast("double"), Agg.COUNT: count.cast("double")}.get(agg)
    return most.cast("double") if share is None else share / F.greatest(groups, F.lit(1))


def hoeffding_width(count: Column, low: Column, high: Column, confidence: float) -> Column:
    """Half-width of the mean of ``count`` draws from [low, high]; 0 for no draws or no spread."""
    spread = high.cast("double") - low.cast("double")
    half = spread * F.sqrt(F.lit(math.log(2 / (1 - confidence))) / (2 * count))
    return F.when((count > 0) & (spread > 0), half).otherwise(F.lit(0.0))


def sample_lower_bound(agg: Agg, confidence: float) -> Column:
    """Lower confidence bound of a group's aggregate in a sample with columns sum, count, min, max."""
    if agg is Agg.SUM:
        return F.col("sum").cast("double") - hoeffding_width(F.col("count"), F.col("min"), F.col("max"), confidence) * F.col("count")
    return {Agg.COUNT: F.col("count"), Agg.MAX: F.col("max"), Agg.MIN: F.col("min")}[agg].cast("double")


def underrepresented(row_count: Column, observed: Column, total: int, sample: int, threshold: float) -> Column:
    """Whether a group was drawn less often than ``threshold`` of what its share promises; never for shares below half a row."""
    expected = row_count * (sample / max(total, 1))
    return (expected >= 0.5) & (observed < threshold * expected)
