"""Benchmark sweeps: distributions, aggregates, k and sizes, exact and pruned, one row a run.

``python -m quillon.sweep --csv runs.csv [--sizes 1000000 ...] [--modes baseline ...] [--figures folder]``. Each
experiment varies one thing and holds the others at their defaults.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.config import Agg, Mode, TopKConfig
from quillon.operators.exact import RESULT
from quillon.plans.engine import top_k
from quillon.session import local_session
from quillon.sources import charts, generators, reports
from quillon.sources.generators import DISTRIBUTIONS, Dataset

# The grid of the sweeps, and the rows a sample aims at.
K_VALUES = (1, 5, 10, 20, 50, 100)
DEFAULT_K, DEFAULT_AGG, DEFAULT_DISTRIBUTION = 50, Agg.SUM, "zipf"
SAMPLED = 100_000


def sample_fraction(n_rows: int) -> float:
    """A fixed number of rows, within a ten-thousandth and a tenth of all."""
    return max(0.0001, min(0.1, SAMPLED / max(n_rows, 1)))


def experiments(sizes: Sequence[int], default_size: int | None = None) -> Iterator[tuple[str, Dataset, int, Agg]]:
    """(experiment, recipe, k, aggregate) of the grid."""
    recipes = {(r.n_rows, r.distribution): r for r in generators.suite(tuple(sizes))}
    size = default_size or sizes[0]
    for distribution in DISTRIBUTIONS:
        yield "distribution", recipes[size, distribution], DEFAULT_K, DEFAULT_AGG
    for agg in Agg:
        yield "aggregate", recipes[size, DEFAULT_DISTRIBUTION], DEFAULT_K, agg
    for k in K_VALUES:
        yield "k", recipes[size, DEFAULT_DISTRIBUTION], k, DEFAULT_AGG
    for n_rows in sizes:
        yield "size", recipes[n_rows, DEFAULT_DISTRIBUTION], DEFAULT_K, DEFAULT_AGG


def run_one(rows: DataFrame, n_rows: int, recipe: Dataset, experiment: str, k: int, agg: Agg, mode: Mode, exact: list | None, config: TopKConfig) -> tuple[dict, list]:
    """(a row of the table, the k rows found); an error becomes a row too."""
    out = {"experiment": experiment, "dataset": recipe.name, "n_rows": n_rows, "n_groups": recipe.n_groups, "group_dist": recipe.distribution, "k": k, "agg": agg.value.lower(), "mode": mode.value}
    found: list = []
    try:
        began = time.perf_counter()
        result = top_k(rows, "group_id", F.col("value").cast("decimal(24,6)"), k, agg, mode, config)
        found = [tuple(r) for r in result.df.select("group_id", RESULT).collect()]
        took, m = (time.perf_counter() - began) * 1000, result.metrics
        result.release()
        winners, chosen = {g for g, _ in found}, {c[0] for c in result.candidates}
        out |= {
            "is_optimizable": m.is_optimizable, "total_duration_ms": took, "sample_duration_ms": m.sample_duration_ms, "pass1_duration_ms": m.pass1_duration_ms, "pass2plus_duration_ms": m.pass2plus_duration_ms,
            "throughput_Mrows_s": n_rows / took / 1000, "pass1_throughput_Mrows_s": n_rows / m.pass1_duration_ms / 1000 if m.pass1_duration_ms else 0.0, "total_passes": m.total_passes, "partitions_pruned_pct": m.partitions_pruned_pct,
            "fa_candidates_count": m.fa_candidates_count, "fa_hit_rate": len(winners & chosen) / len(winners) if chosen and winners else -1.0, "l_k_lower_bound": m.l_k_lower_bound, "cs_above_lk": m.cs_above_lk,
            "partitions_exact_agg": m.partitions_exact_agg, "partitions_logical": m.partitions_logical, "partitions_physical": m.partitions_physical, "correct": exact is None or found == exact, "error": "",
        }
    except Exception as e:  # the sweep goes on, and the table says so
        out |= {"correct": False, "error": str(e).splitlines()[0][:200]}
    names = [c.rsplit(" ", 1)[0] for c in reports.CSV_SCHEMA.split(", ")]
    return {c: out.get(c) for c in names}, found


def sweep(spark: SparkSession, csv: str, sizes: Sequence[int], modes: Sequence[Mode] = (Mode.SAMPLE,), fa_capacity: int = 50_000, n_partitions: int = 10_000, min_rows_per_core: int = 0) -> list[dict]:
    """Run the grid; every row is appended to ``csv`` and returned."""
    out = []
    for experiment, recipe, k, agg in experiments(sizes):
        rows = generators.generate(spark, recipe).persist()
        try:
            n_rows = rows.count()
            config = TopKConfig(fa_capacity=fa_capacity, n_partitions=n_partitions, sample_frac=sample_fraction(n_rows), min_rows_per_core=min_rows_per_core)
            exact = None
            for mode in (Mode.EXACT, *modes):
                row, found = run_one(rows, n_rows, recipe, experiment, k, agg, mode, exact, config)
                exact = found if mode is Mode.EXACT else exact
                reports.append_csv([row], csv)
                out.append(row)
        finally:
            rows.unpersist()
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon.sweep", description="Benchmark sweeps over generated tables.")
    parser.add_argument("--csv", required=True)
    parser.add_argument("--sizes", nargs="+", type=int, default=[1_000_000, 5_000_000, 10_000_000, 50_000_000])
    parser.add_argument("--modes", nargs="+", type=Mode.parse, default=[Mode.SAMPLE])
    parser.add_argument("--fa-capacity", type=int, default=50_000)
    parser.add_argument("--n-partitions", type=int, default=10_000)
    parser.add_argument("--min-rows-per-core", type=int, default=0)
    parser.add_argument("--figures", help="folder for SVG figures")
    args = parser.parse_args(argv)
    spark = spark or local_session()
    rows = sweep(spark, args.csv, args.sizes, args.modes, args.fa_capacity, args.n_partitions, args.min_rows_per_core)
    runs = reports.read_csv(spark, args.csv)
    print(reports.results_text(runs))
    if args.figures:
        charts.write_figures(spark, charts.sweep_figures(runs), args.figures)
    return int(not all(r["correct"] for r in rows))


if __name__ == "__main__":
    sys.exit(main())
