"""Choosing candidate groups from a sample, and the gates that send a query to the exact plan."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import DataFrame, Window, functions as F

from quillon.config import Agg, TopKConfig
from quillon.functions.bounds import sample_lower_bound, underrepresented
from quillon.operators.exact import all_aggregates, ranked

VALUE = "__value"


def sample_size(n_rows: int, config: TopKConfig) -> int:
    """Rows to draw: enough for the confidence asked for, and for the fraction asked for, at most all."""
    delta = config.delta if 0 < config.delta < 1 else 0.05
    alpha = config.alpha_ci if 0 < config.alpha_ci < 1 else 0.05
    z = NormalDist().inv_cdf(1 - alpha / 2)
    return min(n_rows, max(1, math.ceil(z * z / (4 * delta * delta)), math.ceil(config.sample_frac * n_rows)))


def uniform_sample(rows: DataFrame, n_rows: int, size: int, seed: int) -> DataFrame:
    """About ``size`` rows, drawn with replacement in one scan."""
    return rows.sample(withReplacement=True, fraction=size / max(n_rows, 1), seed=seed)


def sample_statistics(sample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum, count, min and max of each sampled group."""
    return sample.groupBy(*keys).agg(*all_aggregates(F.col(VALUE)))


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    """Join condition on all keys, nulls equal to nulls."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def occurrence_index(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each group's true row count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))


def group_index(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each group's true row count and largest value: what the occurrence index and the extremes need, in one scan."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.max(VALUE).alias("most"))


def extremes_of(index: DataFrame, keys: Sequence[str], m: int) -> DataFrame:
    """The ``m`` groups of the largest values, from :func:`group_index`; they hold all groups of the ``m`` largest rows."""
    return ranked(index, keys, m, "most").select(*keys)


def boosted_rows(rows: DataFrame, keys: Sequence[str], statistics: DataFrame, index: DataFrame, n_rows: int, size: int, config: TopKConfig) -> DataFrame:
    """The first ``boost_rows`` rows, in the order of the scan, of each group that the sample underrepresents.

    Only groups expected at most ``boost_rows`` times in the sample are
    boosted, which bounds what any one group brings to the window.
    """
    observed = statistics.select(*[F.col(k).alias(f"__s_{k}") for k in keys], F.col("count").alias("__seen"))
    condition = F.lit(True)
    for k in keys:
        condition = condition & index[k].eqNullSafe(observed[f"__s_{k}"])
    joined = index.join(observed, condition, "left")
    short = underrepresented(F.col("row_count"), F.coalesce("__seen", F.lit(0)), n_rows, size, config.underrep_threshold)
    wanted = joined.where(short & (F.col("row_count") * (size / max(n_rows, 1)) <= config.boost_rows)).select(*keys)
    placed = rows.withColumn("__at", F.monotonically_increasing_id())
    picked = placed.join(wanted, same_key(placed, wanted, keys), "left_semi")
    order = Window.partitionBy(*keys).orderBy("__at")
    return picked.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= config.boost_rows).drop("__rank", "__at")


def measure_index(rows: DataFrame, keys: Sequence[str], m: int) -> DataFrame:
    """Distinct groups of the ``m`` largest values; at most ``m`` rows."""
    return ranked(rows, keys, m, VALUE).select(*keys).distinct()


@dataclass(frozen=True)
class Selection:
    """What the sample said."""

    optimizable: bool
    reason: str
    candidates: list
    lower_bound: float | None
    above: int
    share: float | None
    sampled: int = 0


def select_candidates(statistics: DataFrame, keys: Sequence[str], k: int, agg: Agg, config: TopKConfig, forced: list | None = None) -> Selection:
    """At most ``fa_capacity`` candidate keys: forced groups, groups that may be among the top k, then heavy ones.

    Not optimizable when more groups may be among the top k than fit, or, for
    SUM and COUNT, when the top k hold less than ``min_topk_share`` of the sample.
    ``config.force`` skips both gates.
    """
    scored = statistics.withColumn("lb", sample_lower_bound(agg, config.beta_ci))
    forced = list(dict.fromkeys(forced or []))[: config.fa_capacity]
    # one row more than fit, best bound first: the k-th gives the floor, the rest tell whether all above it fit
    most = max(k, config.fa_capacity + 1)
    best = ranked(scored, keys, most, "lb").select(*keys, "sum", "count", "lb").collect()
    every = len(best) < most  # these are all groups of the sample
    floor = best[k - 1]["lb"] if 0 < k <= len(best) else None
    over = [r for r in best if floor is None or r["lb"] is not None and r["lb"] >= floor]
    column = {Agg.SUM: "sum", Agg.COUNT: "count"}.get(agg)
    if every:
        sampled, total = sum(r["count"] for r in best), math.fsum(float(r[column] or 0) for r in best) if column else 0.0
    else:
        sampled, total = statistics.agg(F.coalesce(F.sum("count"), F.lit(0)), F.sum(F.col(column or "count").cast("double"))).first()
    share = None
    if column:
        if every or agg is Agg.COUNT:
            top = sum(heapq.nlargest(k, (float(r[column] or 0) for r in best)))
        else:
            top = sum(float(r[column] or 0) for r in ranked(statistics, keys, k, column).select(column).collect())
        share = top / total if total and total > 0 else 0.0
    reason = ""
    if len(over) > config.fa_capacity - len(forced):
        reason = "more possible winners than candidate slots"
    elif share is not None and share < config.min_topk_share:
        reason = "the top k hold too little of the total"
    if reason and not config.force:
        return Selection(False, reason, [], floor, len(over), share, sampled)
    key = lambda r: tuple(r[c] for c in keys)
    chosen = dict.fromkeys(forced)
    chosen.update(dict.fromkeys(map(key, sorted(over, key=lambda r: -r["count"]))))
    if every:
        chosen.update(dict.fromkeys(map(key, sorted(best, key=lambda r: -r["count"]))))
    elif len(chosen) < config.fa_capacity:  # fill up with heavy groups
        order = [F.col("count").desc(), F.col("lb").desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in keys]]
        chosen.update(dict.fromkeys(map(key, scored.orderBy(*order).limit(config.fa_capacity).select(*keys).collect())))
    return Selection(True, reason, list(chosen)[: config.fa_capacity], floor, len(over), share, sampled)
