"""The sound pruning threshold and what a surviving bucket needs next."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

from quillon.config import TopKConfig


def kth_largest(values: Iterable, k: int) -> float:
    """The k-th largest value, or minus infinity where there are fewer."""
    best = heapq.nlargest(k, (float(v) for v in values if v is not None))
    return best[-1] if len(best) == k and k > 0 else -math.inf


def threshold(exact_values: Iterable, bucket_lower_bounds: Iterable, k: int) -> float:
    """A value that at least k distinct groups reach: candidates' exact values, and one sure group in each bucket.

    It never exceeds the true k-th value, so a bucket whose upper bound lies
    below it holds no winner. Bucket *upper* bounds take no part: no group need
    reach them.
    """
    return kth_largest([*exact_values, *bucket_lower_bounds], k)


def survives(upper, bound: float) -> bool:
    """Whether a bucket may hold a winner; ties survive, and rounding of double sums cannot prune."""
    if bound == -math.inf:
        return True
    if upper is None:
        return False
    upper = float(upper)
    return upper + abs(upper) * 1e-9 + 1e-9 >= bound


def classify(groups: int, rows: int, lowest_candidate_count: int, config: TopKConfig) -> str:
    """EXACT: aggregate the bucket's groups now. LOGICAL or PHYSICAL: bucket them again, the latter with rows moved together."""
    if groups < config.fa_capacity or (rows and groups / rows < config.alpha_locality):
        return "EXACT"
    if lowest_candidate_count == 0 or rows / config.n_partitions < lowest_candidate_count:
        return "LOGICAL"
    return "PHYSICAL"
