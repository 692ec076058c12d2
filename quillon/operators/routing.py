"""One scan that aggregates candidates exactly and everything else by bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from quillon.config import Agg
from quillon.functions.bounds import bucket_of, lower_bound, upper_bound
from quillon.operators.exact import RESULT, aggregate_column
from quillon.operators.sampling import VALUE

BUCKET, SLOT = "__bucket", "__slot"


def candidate_frame(rows: DataFrame, keys: Sequence[str], candidates: list) -> DataFrame:
    """The candidate keys and their numbers, to broadcast: at most ``fa_capacity`` of them."""
    kinds = rows.select(*keys).schema.add(SLOT, T.IntegerType())
    frame = rows.sparkSession.createDataFrame([(*c, i) for i, c in enumerate(candidates)], kinds)
    return F.broadcast(frame.withColumnsRenamed({k: f"__c_{k}" for k in keys}))


def route(rows: DataFrame, keys: Sequence[str], candidates: list, level: int, n_buckets: int) -> DataFrame:
    """``rows`` with a slot: a candidate's number, or for all others the number of candidates plus a bucket."""
    bucket = F.lit(len(candidates)) + bucket_of(keys, level, n_buckets)
    if not candidates:
        return rows.withColumn(SLOT, bucket)
    frame = candidate_frame(rows, keys, candidates)
    nulls = any(None in c for c in candidates)  # else plain equality, which probes faster: a null key is then no candidate
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(k).eqNullSafe(F.col(f"__c_{k}")) if nulls else F.col(k) == F.col(f"__c_{k}"))
    return rows.join(frame, condition, "left").select(*rows.columns, F.coalesce(SLOT, bucket).alias(SLOT))


def routed_aggregate(routed: DataFrame, agg: Agg) -> DataFrame:
    """A row for each candidate (exact) and each bucket (bounds): few rows reach the shuffle, whatever the number of groups."""
    value = F.col(VALUE)
    return routed.groupBy(SLOT).agg(aggregate_column(agg, value).alias(RESULT), upper_bound(agg, value).alias("ub"), lower_bound(agg, value).alias("lb"), F.count(F.lit(1)).alias("rows"))


def bucket_groups(rest: DataFrame, keys: Sequence[str], bucket) -> dict[int, int]:
    """About how many groups each bucket holds; a sketch, at most ``n_partitions`` rows."""
    counted = rest.groupBy(bucket.alias(BUCKET)).agg(F.approx_count_distinct(F.xxhash64(*keys)).alias("groups"))
    return {r[BUCKET]: r["groups"] for r in counted.collect()}


def bucket_statistics(rows: DataFrame, bucket, keys: Sequence[str], value) -> DataFrame:
    """Sum, count, max, min, exact distinct groups and SUM's bounds of each bucket."""
    return rows.groupBy(bucket.alias("bucket")).agg(
        F.sum(value).alias("sum"), F.count(F.lit(1)).alias("count"), F.max(value).alias("max"), F.min(value).alias("min"), F.countDistinct(*keys).alias("groups"), upper_bound(Agg.SUM, value).alias("ub"), lower_bound(Agg.SUM, value).alias("lb")
    )
