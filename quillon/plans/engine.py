"""Top-k plans: exact, and pruned by candidates from samples, stratified samples and extreme values.

Every mode returns the rows of the exact plan, in order. A pruned plan samples,
picks candidates, aggregates candidates exactly and all else by bucket in one
scan, drops buckets that cannot hold a winner, and aggregates only the groups
of the buckets that are left.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from quillon.config import Agg, Mode, TopKConfig
from quillon.functions.bounds import bucket_of
from quillon.operators import pruning, routing, sampling
from quillon.operators.exact import RESULT, exact_top_k, group_aggregate, ranked
from quillon.operators.sampling import VALUE


@dataclass
class RunMetrics:
    """What a run did; durations in milliseconds. ``total_duration_ms`` holds index builds too."""

    is_optimizable: bool = True
    fallback_reason: str = ""
    total_passes: int = 0
    sample_size_actual: int = 0
    fa_candidates_count: int = 0
    sample_duration_ms: float = 0.0
    pass1_duration_ms: float = 0.0
    pass2plus_duration_ms: float = 0.0
    total_duration_ms: float = 0.0
    index_build_duration_ms: float = 0.0
    fa_hit_rate: float = -1.0
    topKBound_after_pass1: float = -math.inf
    partitions_pruned_pct: float = 0.0
    l_k_lower_bound: float | None = None
    cs_above_lk: int = 0
    partitions_exact_agg: int = 0
    partitions_logical: int = 0
    partitions_physical: int = 0


@dataclass
class TopKResult:
    """The ranked rows (keys and ``aggregate``), how they came about, and the candidate keys."""

    df: DataFrame
    metrics: RunMetrics
    candidates: list = field(default_factory=list)
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Drop what the run keeps in storage for ``df``, once that is done with."""
        for frame in self.held:
            frame.unpersist()
        self.held.clear()

    def metrics_frame(self) -> DataFrame:
        values = {k: (float(v) if isinstance(v, float) else v) for k, v in asdict(self.metrics).items()}
        kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
        schema = ", ".join(f"{k} {kinds.get(type(v), 'double')}" for k, v in values.items())
        return self.df.sparkSession.createDataFrame([tuple(values.values())], schema)


class _Clock:
    def __init__(self):
        self.began = time.perf_counter()

    def ms(self) -> float:
        now = time.perf_counter()
        out, self.began = (now - self.began) * 1000, now
        return out


def _sample(rows: DataFrame, n_rows: int, keys: Sequence[str], k: int, agg: Agg, mode: Mode, config: TopKConfig, metrics: RunMetrics) -> sampling.Selection:
    clock = _Clock()
    forced, index = [], None
    boosts = mode in (Mode.STRATIFIED, Mode.COMBINED) and config.boost_rows > 0 and config.underrep_threshold > 0
    if boosts and mode is Mode.COMBINED and config.measure_m < k:  # else there may be extremes enough to leave no need for boosts
        index = sampling.group_index(rows, keys).persist()  # used twice
    try:
        if mode in (Mode.EXTREMES, Mode.COMBINED) and config.measure_m:
            extremes = sampling.measure_index(rows, keys, config.measure_m) if index is None else sampling.extremes_of(index, keys, config.measure_m)
            forced = [tuple(r) for r in extremes.collect()]
            metrics.index_build_duration_ms = clock.ms()
        size = sampling.sample_size(n_rows, config)
        # The sample is evaluated more than once; what it yields may differ then, the result never does.
        sample = sampling.uniform_sample(rows, n_rows, size, config.seed)
        statistics = sampling.sample_statistics(sample, keys).persist()
        try:
            if boosts and len(forced) < k:
                counts = sampling.occurrence_index(rows, keys) if index is None else index
                drawn = sampling.sample_statistics(sample.unionByName(sampling.boosted_rows(rows, keys, statistics, counts, n_rows, size, config)), keys).persist()
                statistics.unpersist()
                statistics = drawn
            selection = sampling.select_candidates(statistics, keys, k, agg, config, forced)
        finally:
            statistics.unpersist()
    finally:
        if index is not None:
            index.unpersist()
    metrics.sample_duration_ms = clock.ms()
    metrics.sample_size_actual = selection.sampled
    metrics.is_optimizable, metrics.fallback_reason = selection.optimizable, selection.reason
    metrics.l_k_lower_bound, metrics.cs_above_lk = selection.lower_bound, selection.above
    return selection


def _counts_all_groups(mode: Mode, k: int, config: TopKConfig) -> bool:
    """Whether the mode is sure to need every group's row count."""
    if not (config.boost_rows and config.underrep_threshold > 0):
        return False
    return mode is Mode.STRATIFIED or mode is Mode.COMBINED and config.measure_m < k


#: Operators that a repeated scan would repeat.
_COSTLY = ("Join", "Aggregate", "Window", "Generate", "Sort", "Repartition", "MapInArrow", "MapInPandas", "FlatMap", "Distinct")


def _computed(df: DataFrame) -> bool:
    """Whether ``df`` is more than a scan with columns and filters."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(name in plan for name in _COSTLY)


def top_k(df: DataFrame, group_cols: Sequence[str] | str, value: Column | str, k: int, agg: Agg | str = Agg.SUM, mode: Mode | str = Mode.EXACT, config: TopKConfig | None = None, candidates: list | None = None) -> TopKResult:
    """The ``k`` groups of ``df`` with the largest aggregate of ``value``, ties to the smaller key.

    MIN means the largest minima. Null measures are skipped as SQL does, COUNT
    counts rows; null keys form a group. ``candidates`` (key tuples) replace
    the sample. Inputs with NaN measures take the exact plan, and so do inputs
    with few rows for each core, unless ``config.force``.
    """
    agg, mode, config = Agg.parse(agg), Mode.parse(mode), config or TopKConfig()
    keys = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, value.alias(VALUE))
    metrics, clock, whole, held = RunMetrics(), _Clock(), time.perf_counter(), []

    def finish(out: DataFrame, chosen: list) -> TopKResult:
        metrics.total_duration_ms = (time.perf_counter() - whole) * 1000
        metrics.fa_candidates_count = len(chosen)
        return TopKResult(out, metrics, chosen, held)

    exact = lambda: exact_top_k(rows, keys, F.col(VALUE), k, agg)
    if mode is Mode.EXACT or k <= 0:
        return finish(exact(), [])
    cores = df.sparkSession.sparkContext.defaultParallelism
    if candidates is None:
        n_rows = rows.count()
        if not config.force and n_rows < config.min_rows_per_core * cores:
            metrics.is_optimizable, metrics.fallback_reason = False, f"{n_rows} rows on {cores} cores: one shuffle costs less than several scans"
            return finish(exact(), [])
        if not config.force and config.min_rows_per_core and _counts_all_groups(mode, k, config):
            metrics.is_optimizable, metrics.fallback_reason = False, f"{mode.value} would count all groups first, which costs what the exact plan does"
            return finish(exact(), [])
        if _computed(rows):  # several passes follow
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(rows)
        selection = _sample(rows, n_rows, keys, k, agg, mode, config, metrics)
        if not selection.optimizable:
            return finish(exact(), [])
        candidates = selection.candidates
    candidates = candidates[: config.fa_capacity]

    clock.ms()
    routed = routing.route(rows, keys, candidates, 1, config.n_partitions)
    collected = routing.routed_aggregate(routed, agg)
    kind = collected.schema[RESULT].dataType
    found = collected.collect()  # a row for each candidate and bucket
    metrics.pass1_duration_ms, metrics.total_passes = clock.ms(), 1
    if any(isinstance(x, float) and math.isnan(x) for r in found for x in (r[RESULT], r["ub"])):
        metrics.is_optimizable, metrics.fallback_reason = False, "NaN measures"
        return finish(exact(), candidates)
    n = len(candidates)
    done = [r for r in found if r[routing.SLOT] < n]
    buckets = [(r[routing.SLOT] - n, r) for r in found if r[routing.SLOT] >= n]
    bound = pruning.threshold((r[RESULT] for r in done), (r["lb"] for _, r in buckets), k)
    left = [(b, r) for b, r in buckets if pruning.survives(r["ub"], bound)]
    metrics.topKBound_after_pass1 = bound
    metrics.partitions_pruned_pct = 1 - len(left) / len(buckets) if buckets else 0.0

    lowest = min((r["rows"] for r in done), default=0)
    rest, level = routed.where(F.col(routing.SLOT) >= n).select(*keys, VALUE), 1
    while left:
        rest = _of_buckets(rest, keys, level, config, [b for b, _ in left])
        decisions = []
        if level < config.max_levels and sum(r["rows"] for _, r in left) > config.fa_capacity:  # else there cannot be too many groups
            groups = routing.bucket_groups(rest, keys, bucket_of(keys, level, config.n_partitions))
            if sum(groups.values()) > config.fa_capacity:
                decisions = [pruning.classify(groups.get(b, 0), r["rows"], lowest, config) for b, r in left]
        if all(d == "EXACT" for d in decisions):
            metrics.partitions_exact_agg += len(left)
            break
        metrics.partitions_logical += decisions.count("LOGICAL")
        metrics.partitions_physical += decisions.count("PHYSICAL")
        if "PHYSICAL" in decisions:  # what is left moves together, and later passes read it instead of the input
            rest = rest.repartition(bucket_of(keys, level + 1, config.n_partitions)).persist(StorageLevel.MEMORY_AND_DISK)
            held.append(rest)
        level += 1
        finer = routing.routed_aggregate(routing.route(rest, keys, [], level, config.n_partitions), agg).collect()
        metrics.total_passes += 1
        bound = max(bound, pruning.threshold((r[RESULT] for r in done), (r["lb"] for r in finer), k))
        left = [(r[routing.SLOT], r) for r in finer if pruning.survives(r["ub"], bound)]
    spark = df.sparkSession
    schema = rows.select(*keys).schema.add(RESULT, kind)
    out = spark.createDataFrame([(*candidates[r[routing.SLOT]], r[RESULT]) for r in done], schema)
    if left:
        metrics.total_passes += 1
        out = out.unionByName(group_aggregate(rest, keys, F.col(VALUE), agg))
    metrics.pass2plus_duration_ms = clock.ms()
    return finish(ranked(out, keys, k), candidates)


def _of_buckets(rest: DataFrame, keys: Sequence[str], level: int, config: TopKConfig, numbers: list[int]) -> DataFrame:
    """Rows of the buckets, by a broadcast of their numbers (``n_partitions`` at most)."""
    column = bucket_of(keys, level, config.n_partitions)
    frame = F.broadcast(rest.sparkSession.createDataFrame([(int(n),) for n in numbers], f"{routing.BUCKET} int"))
    return rest.withColumn(routing.BUCKET, column).join(frame, routing.BUCKET, "left_semi").drop(routing.BUCKET)
