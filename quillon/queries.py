"""Registered queries over the standard tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.config import Agg, Mode, TopKConfig
from quillon.functions.bounds import estimated_per_group
from quillon.operators import compare, routing, sampling
from quillon.operators.exact import RESULT
from quillon.plans.engine import top_k
from quillon.sources import generators

MONEY = "decimal(18,2)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _top(table: str, keys: list[str], value: str, k: int, agg: Agg, mode: Mode = Mode.EXACT, cast: str | None = MONEY, **options) -> tuple[Callable, str]:
    """A query and its SQL. Sums are taken over decimals, so that their order cannot show; results are doubles, counts longs."""
    kind = "BIGINT" if agg is Agg.COUNT else "DOUBLE"

    options = {"min_rows_per_core": 0} | options  # the tables are small, and the pruned plans are what these queries show

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        column = F.col(value).cast(cast) if cast else F.col(value)
        out = top_k(_table(spark, sf_dir, table), keys, column, k, agg, mode, TopKConfig(**options)).df
        return out.withColumn(RESULT, F.col(RESULT).cast(kind))

    measure = f"CAST({value} AS {cast})" if cast else value
    inner = "count(*)" if agg is Agg.COUNT else f"{agg.value.lower()}({measure})"
    order = ", ".join([f"{RESULT} DESC NULLS LAST", *[f"{c} ASC NULLS FIRST" for c in keys]])
    sql = f"SELECT {', '.join(keys)}, CAST({inner} AS {kind}) AS {RESULT} FROM {table} GROUP BY {', '.join(keys)} ORDER BY {order} LIMIT {max(k, 0)}"
    return query, sql


_LINE = ("lineitem", ["l_suppkey"], "l_extendedprice", 10)
_SMALL = {"fa_capacity": 20, "n_partitions": 64}
_EVENTS = ("events", ["user_id"], "value", 10)
_FEW = {"fa_capacity": 30, "n_partitions": 256, "measure_m": 5, "min_rows_per_core": 0}

_PAIRS: dict[str, tuple[Callable, str]] = {
    **{f"topk_{a.value.lower()}_exact": _top(*_LINE, a) for a in Agg},
    **{f"topk_{a.value.lower()}_baseline": _top(*_LINE, a, Mode.SAMPLE, **_SMALL) for a in Agg},
    **{f"topk_{a.value.lower()}_{m.value.replace('-', '_')}": _top(*_EVENTS, a, m, "decimal(24,6)", **_FEW) for a in Agg for m in (Mode.STRATIFIED, Mode.EXTREMES, Mode.COMBINED)},
    "topk_sum_fallback": _top("lineitem", ["l_orderkey"], "l_extendedprice", 10, Agg.SUM, Mode.SAMPLE),
    "topk_forced_prune": _top("lineitem", ["l_partkey"], "l_extendedprice", 10, Agg.SUM, Mode.SAMPLE, force=True, fa_capacity=200, n_partitions=4096),
    "topk_forced_levels": _top("lineitem", ["l_partkey"], "l_extendedprice", 10, Agg.MAX, Mode.SAMPLE, force=True, fa_capacity=15, n_partitions=8, alpha_locality=0.0, max_levels=3),
    "topk_max_ties": _top("lineitem", ["l_orderkey"], "l_quantity", 10, Agg.MAX, Mode.SAMPLE, force=True, fa_capacity=50, n_partitions=512),
    "topk_sum_negative": _top("customer", ["c_nationkey"], "c_acctbal", 10, Agg.SUM, Mode.SAMPLE, force=True, fa_capacity=12, n_partitions=16),
    "topk_string_key": _top("documents", ["source"], "n_chars", 10, Agg.SUM, cast="bigint"),
    "topk_string_count_ties": _top("documents", ["source"], "n_chars", 10, Agg.COUNT, Mode.SAMPLE, cast="bigint", force=True, fa_capacity=10, n_partitions=8),
    "topk_two_keys": _top("lineitem", ["l_returnflag", "l_suppkey"], "l_extendedprice", 25, Agg.SUM, Mode.EXTREMES, fa_capacity=60, n_partitions=128, measure_m=10),
    "topk_k_exceeds_groups": _top("supplier", ["s_nationkey"], "s_acctbal", 1000, Agg.SUM, Mode.SAMPLE, force=True, n_partitions=8),
    "topk_k_zero": _top("supplier", ["s_nationkey"], "s_acctbal", 0, Agg.MAX, Mode.SAMPLE),
}


def topk_join_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    out = top_k(joined, ["o_custkey"], F.col("l_extendedprice").cast(MONEY), 10, Agg.SUM).df
    return out.withColumn(RESULT, F.col(RESULT).cast("double"))


def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    out = routing.bucket_statistics(rows, F.col("l_partkey") % 64, ["l_partkey"], F.col("l_extendedprice").cast(MONEY))
    return out.select("bucket", *[F.col(c).cast("double").alias(c) for c in ("sum", "max", "min", "ub", "lb")], "count", "groups")


def bucket_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets whose largest possible MAX reaches the 10th sure one."""
    stats = bucket_stats(spark, sf_dir)
    floor = stats.orderBy(F.col("lb").desc()).limit(10).agg(F.min("lb").alias("bound"))
    return stats.crossJoin(F.broadcast(floor)).where(F.col("max") >= F.col("bound")).select("bucket", "max")  # one row


def pruning_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, kept = bucket_stats(spark, sf_dir), bucket_survivors(spark, sf_dir).select("bucket", F.lit(1).alias("kept"))
    return stats.join(kept, "bucket", "left").agg(F.avg(F.when(F.col("kept").isNull(), 1.0).otherwise(0.0)).alias("pruned"))


def bucket_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surviving buckets by what a group in them is likely to have."""
    stats = bucket_stats(spark, sf_dir).join(bucket_survivors(spark, sf_dir).select("bucket"), "bucket", "left_semi")
    share = lambda agg: F.floor(estimated_per_group(agg, F.col("sum"), F.col("count"), F.col("max"), F.col("groups")))
    return stats.select("bucket", share(Agg.SUM).alias("sum_share"), share(Agg.COUNT).alias("count_share"), share(Agg.MAX).alias("max_share")).orderBy(F.desc("sum_share"), "bucket")


def lowest_candidate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the least frequent of the 20 groups of the largest values."""
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias(sampling.VALUE))
    chosen = sampling.measure_index(rows, ["l_suppkey"], 20)
    return sampling.occurrence_index(rows, ["l_suppkey"]).join(F.broadcast(chosen), "l_suppkey", "left_semi").agg(F.coalesce(F.min("row_count"), F.lit(0)).alias("lowest"))


def occurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.occurrence_index(_table(spark, sf_dir, "lineitem"), ["l_suppkey"])


def measure_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias(sampling.VALUE))
    return sampling.measure_index(rows, ["l_suppkey"], 50)


def all_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, count, maximum and minimum of each group in one pass."""
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").cast(MONEY).alias(sampling.VALUE))
    out = sampling.sample_statistics(rows, ["l_suppkey"])
    return out.select("l_suppkey", *[F.col(c).cast("double").alias(c) for c in ("sum", "max", "min")], "count")


def sample_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower confidence bounds of SUM, with the whole table as the sample."""
    rows = all_aggregates(spark, sf_dir)
    return rows.select("l_suppkey", F.round(sampling.sample_lower_bound(Agg.SUM, 0.95), 2).alias("lb"))


def underrepresented_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users drawn less than half as often as their row count promises, in a sample of every tenth event.

    The sample is the operator's input; a systematic one has the same rows in SQL.
    """
    events = _table(spark, sf_dir, "events").select("user_id", "event_id")
    counts = events.agg(F.count(F.lit(1)), F.max("event_id")).first()
    sample = events.where(F.col("event_id") % 10 == 0).groupBy("user_id").agg(F.count(F.lit(1)).alias("seen"))
    index = sampling.occurrence_index(events, ["user_id"]).join(sample, "user_id", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    return index.where(sampling.underrepresented(F.col("row_count"), F.col("seen"), 10, 1, 0.5) & F.lit(counts[0] > 0)).select("user_id", "row_count", "seen")


def candidate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of candidate groups and of the others, by a broadcast probe."""
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias(sampling.VALUE))
    routed = routing.route(rows, ["l_suppkey"], [(k,) for k in range(1, 11)], 1, 16)
    return routed.groupBy((F.col(routing.SLOT) < 10).alias("candidate")).agg(F.count(F.lit(1)).alias("rows"))


def approximate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact count of groups, and whether the distinct-count sketch is within a tenth of it."""
    rows = _table(spark, sf_dir, "lineitem")
    counts = rows.agg(F.countDistinct("l_partkey").alias("groups"), F.approx_count_distinct("l_partkey", 0.01).alias("sketch"))
    least, most = F.expr("9 * groups div 10"), F.expr("(11 * groups + 9) div 10")
    return counts.select("groups", least.alias("least"), most.alias("most"), F.col("sketch").between(least, most).alias("near"))


def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the true top 10 by SUM among the 20 groups of the most rows."""
    rows = _table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast(MONEY)
    heavy, best = top_k(rows, ["l_suppkey"], price, 20, Agg.COUNT).df, top_k(rows, ["l_suppkey"], price, 10, Agg.SUM).df
    hits = best.join(heavy.select("l_suppkey"), "l_suppkey", "left_semi")
    return hits.agg((F.count(F.lit(1)) / 10).alias("hit_rate"))


def missing_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast(MONEY)
    missing, extra = compare.missing_and_extra(top_k(rows, ["l_suppkey"], price, 10, Agg.SUM).df, top_k(rows, ["l_suppkey"], price, 10, Agg.COUNT).df, ["l_suppkey"])
    return missing.select("l_suppkey", F.lit("missing").alias("side")).unionByName(extra.select("l_suppkey", F.lit("extra").alias("side")))


def _sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = _table(spark, sf_dir, "events").select("user_id", F.col("value").alias(sampling.VALUE))
    n = rows.count()
    return sampling.uniform_sample(rows, n, sampling.sample_size(n, TopKConfig()), 42), n


def sample_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's true statistics, and whether the sample's keep within them."""
    stats = sampling.sample_statistics(_sampled(spark, sf_dir)[0], ["user_id"])
    rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("row_count"), F.min("value").alias("least"), F.max("value").alias("largest"))
    near = (F.col("min") >= F.col("least")) & (F.col("max") <= F.col("largest")) & F.col("sum").between(F.col("count") * F.col("least") - 1e-6, F.col("count") * F.col("largest") + 1e-6) & (F.col("min") <= F.col("max"))
    return rows.join(stats, "user_id", "left").select("user_id", "row_count", "least", "largest", F.coalesce(near, F.col("count").isNull()).alias("within"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many users become candidates, and whether all of them are users of the table, told apart."""
    stats = sampling.sample_statistics(_sampled(spark, sf_dir)[0], ["user_id"])
    chosen = sampling.select_candidates(stats, ["user_id"], 10, Agg.SUM, TopKConfig(fa_capacity=40, force=True))
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    found = spark.createDataFrame(chosen.candidates, "user_id long").distinct().join(users, "user_id", "left_semi")
    return found.agg(F.count(F.lit(1)).alias("candidates"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "events"), ["user_id"], "value", 10, Agg.SUM, Mode.COMBINED, TopKConfig(**_FEW)).metrics_frame()


def generated_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named small dataset, and its top 5 by the combined plan."""
    rows = generators.generate(spark, generators.DATASETS["S0"])
    return top_k(rows, ["group_id"], F.col("value").cast("decimal(24,6)"), 5, Agg.SUM, Mode.COMBINED, TopKConfig(fa_capacity=100, n_partitions=1000, measure_m=3, min_rows_per_core=0)).df


def generated_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows i mod 100 of a generated table, counted."""
    return generators.group_ids(spark, 1050, 100, "sorted").groupBy("group_id").agg(F.count(F.lit(1)).alias("rows"))


_LINE_STATS = "SELECT l_partkey % 64 AS bucket, CAST(sum(p) AS DOUBLE) AS sum, CAST(max(p) AS DOUBLE) AS max, CAST(min(p) AS DOUBLE) AS min, CAST(sum(greatest(p, 0)) AS DOUBLE) AS ub, CAST(CASE WHEN min(p) >= 0 THEN max(p) END AS DOUBLE) AS lb, count(*) AS count, count(DISTINCT l_partkey) AS groups FROM (SELECT l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem) GROUP BY 1"
_SURVIVE = f"WITH s AS ({_LINE_STATS}), b AS (SELECT min(lb) AS bound FROM (SELECT lb FROM s ORDER BY lb DESC LIMIT 10))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: query for name, (query, _) in _PAIRS.items()},
    **{
        f.__name__: f
        for f in (
            topk_join_input, bucket_stats, bucket_survivors, bucket_ranking, lowest_candidate_count, pruning_fraction, occurrence_index, measure_index, all_aggregates, sample_bounds, underrepresented_groups, candidate_split, approximate_groups, hit_rate,
            missing_extra, sample_stats, candidates, metrics, generated_zipf, generated_cyclic,
        )
    },
}

ORACLES: dict[str, str] = {
    **{name: sql for name, (_, sql) in _PAIRS.items()},
    "topk_join_input": f"SELECT o_custkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS {RESULT} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "bucket_stats": _LINE_STATS,
    "bucket_survivors": f"{_SURVIVE} SELECT bucket, max FROM s, b WHERE max >= bound",
    "pruning_fraction": f"{_SURVIVE} SELECT avg(CASE WHEN max >= bound THEN 0.0 ELSE 1.0 END) AS pruned FROM s, b",
    "bucket_ranking": f"{_SURVIVE} SELECT bucket, CAST(floor(sum / groups) AS BIGINT) AS sum_share, CAST(floor(count / groups) AS BIGINT) AS count_share, CAST(floor(max) AS BIGINT) AS max_share FROM s, b WHERE max >= bound",
    "lowest_candidate_count": "SELECT min(n) AS lowest FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE l_suppkey IN (SELECT l_suppkey FROM (SELECT l_suppkey FROM lineitem ORDER BY l_extendedprice DESC, l_suppkey LIMIT 20))",
    "occurrence_index": "SELECT l_suppkey, count(*) AS row_count FROM lineitem GROUP BY 1",
    "measure_index": "SELECT DISTINCT l_suppkey FROM (SELECT l_suppkey FROM lineitem ORDER BY l_extendedprice DESC, l_suppkey LIMIT 50)",
    "all_aggregates": "SELECT l_suppkey, CAST(sum(p) AS DOUBLE) AS sum, CAST(max(p) AS DOUBLE) AS max, CAST(min(p) AS DOUBLE) AS min, count(*) AS count FROM (SELECT l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem) GROUP BY 1",
    "sample_bounds": "SELECT l_suppkey, round(CAST(sum(p) AS DOUBLE) - CASE WHEN max(p) > min(p) THEN (CAST(max(p) AS DOUBLE) - CAST(min(p) AS DOUBLE)) * sqrt(ln(2 / 0.05) / (2 * count(*))) ELSE 0 END * count(*), 2) AS lb FROM (SELECT l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem) GROUP BY 1",
    "underrepresented_groups": "SELECT user_id, row_count, seen FROM (SELECT user_id, count(*) AS row_count, count(CASE WHEN event_id % 10 = 0 THEN 1 END) AS seen FROM events GROUP BY 1) WHERE row_count * 0.1 >= 0.5 AND seen < 0.5 * (row_count * 0.1)",
    "candidate_split": "SELECT l_suppkey BETWEEN 1 AND 10 AS candidate, count(*) AS rows FROM lineitem GROUP BY 1",
    "approximate_groups": "SELECT n AS groups, 9 * n // 10 AS least, (11 * n + 9) // 10 AS most, a BETWEEN 8 * n // 10 AND 12 * n // 10 AS near FROM (SELECT count(DISTINCT l_partkey) AS n, approx_count_distinct(l_partkey) AS a FROM lineitem)",
    "sample_stats": "SELECT user_id, count(*) AS row_count, min(value) AS least, max(value) AS largest, min(value) <= max(value) AS within FROM events GROUP BY 1",
    "candidates": "SELECT least(40, count(DISTINCT user_id)) AS candidates FROM events",
    "hit_rate": "WITH h AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20), b AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY sum(CAST(l_extendedprice AS DECIMAL(18,2))) DESC, 1 LIMIT 10) SELECT count(*) / 10 AS hit_rate FROM b WHERE l_suppkey IN (SELECT l_suppkey FROM h)",
    "missing_extra": "WITH h AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10), b AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY sum(CAST(l_extendedprice AS DECIMAL(18,2))) DESC, 1 LIMIT 10) SELECT l_suppkey, 'missing' AS side FROM b WHERE l_suppkey NOT IN (SELECT l_suppkey FROM h) UNION ALL SELECT l_suppkey, 'extra' FROM h WHERE l_suppkey NOT IN (SELECT l_suppkey FROM b)",
    "generated_cyclic": "SELECT i % 100 AS group_id, count(*) AS rows FROM range(1050) t(i) GROUP BY 1",
}
