"""Result files: JSON of a run, readers of many runs, CSV, Markdown tables and the combined report of all modes."""

from __future__ import annotations

import csv
import json
import math
import os
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.config import Mode
from quillon.operators.exact import RESULT
from quillon.plans.engine import TopKResult

MODES = [m.value for m in Mode]
#: Metrics of a result file.
METRICS = [
    "is_optimizable", "total_passes", "sample_size_actual", "fa_candidates_count", "sample_duration_ms", "pass1_duration_ms", "pass2plus_duration_ms", "total_duration_ms", "index_build_duration_ms", "fa_hit_rate",
    "topKBound_after_pass1", "partitions_pruned_pct", "l_k_lower_bound", "cs_above_lk", "partitions_exact_agg", "partitions_logical", "partitions_physical",
]


def _number(x):
    return None if x is None or isinstance(x, float) and not math.isfinite(x) else round(x, 6) if isinstance(x, float) else x


def result_report(result: TopKResult, mode: str, k: int, n_rows: int, keys: Sequence[str], with_candidates: bool = False) -> dict:
    """The report of a run: its k rows, its metrics and, if asked for, the sorted candidate keys."""
    single = len(keys) == 1
    name = lambda r: r[keys[0]] if single else [r[c] for c in keys]
    plain = lambda x: int(x) if hasattr(x, "to_integral_value") and x == x.to_integral_value() else x
    rows = [{"group_id": plain(name(r)) if single else name(r), "aggregate": _number(float(r[RESULT])) if r[RESULT] is not None else None} for r in result.df.collect()]
    out = {"mode": mode, "k": k, "n_rows": n_rows, "n_groups": 0, "top_k_results": rows}
    if with_candidates and result.candidates:
        out["fa_group_ids"] = sorted((plain(c[0]) if single else list(c) for c in result.candidates if single and c[0] is not None or not single), key=lambda x: x if single else [str(v) for v in x])
    return out | {"metrics": {m: _number(getattr(result.metrics, m)) for m in METRICS}}


def write_json(report: dict | list, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, default=str)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file wherever Spark can write, shared stores too."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """One row for each result file: dataset (the file's stem without its mode), mode, k, n_rows and all metrics."""
    files = spark.read.json(pattern, multiLine=True).withColumn("__stem", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", ""))
    dataset = F.when(F.endswith(F.col("__stem"), F.concat(F.lit("_"), F.col("mode"))), F.expr("substring(__stem, 1, length(__stem) - length(mode) - 1)")).otherwise(F.col("__stem"))
    return files.select(dataset.alias("dataset"), "mode", "k", "n_rows", *[F.col(f"metrics.{m}").alias(m) for m in METRICS if m in files.schema["metrics"].dataType.names])


#: Columns of the benchmark table and their types.
CSV_SCHEMA = (
    "experiment string, dataset string, n_rows long, n_groups long, group_dist string, k int, agg string, mode string, is_optimizable boolean, total_duration_ms double, sample_duration_ms double, pass1_duration_ms double, "
    "pass2plus_duration_ms double, throughput_Mrows_s double, pass1_throughput_Mrows_s double, total_passes int, partitions_pruned_pct double, fa_candidates_count long, fa_hit_rate double, l_k_lower_bound double, "
    "cs_above_lk long, partitions_exact_agg long, partitions_logical long, partitions_physical long, correct boolean, error string"
)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a benchmark table, typed; columns by name, those that are absent or do not parse are null."""
    there = spark.read.csv(path, header=True)
    kinds = dict(c.rsplit(" ", 1) for c in CSV_SCHEMA.split(", "))
    return there.select(*[F.expr(f"try_cast(`{c}` AS {kind})").alias(c) if c in there.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])


def results_table(runs: DataFrame, baseline: str = "brute-force") -> DataFrame:
    """Every pruned run beside the exact run of the same experiment, dataset, k and aggregate: throughputs and speed-up."""
    by = ["experiment", "dataset", "n_rows", "n_groups", "group_dist", "k", "agg"]
    base = runs.where(F.col("mode") == baseline).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("throughput_Mrows_s").alias("exact_Mrows_s"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = runs.where(F.col("mode") != baseline).join(base, same, "left")
    speedup = F.when(F.col("exact_Mrows_s") != 0, F.col("throughput_Mrows_s") / F.col("exact_Mrows_s"))
    return joined.select("experiment", "dataset", "group_dist", "n_rows", "k", "agg", "mode", "exact_Mrows_s", "throughput_Mrows_s", speedup.alias("speedup"), "total_passes", "partitions_pruned_pct", "fa_hit_rate", "is_optimizable", "correct").orderBy("experiment", "n_rows", "group_dist", "k", "agg", "mode")


def results_text(runs: DataFrame) -> str:
    """The joined table as Markdown."""
    names = {"experiment": "Experiment", "group_dist": "Distribution", "n_rows": "Rows", "k": "k", "agg": "Aggregate", "mode": "Mode", "exact_Mrows_s": "Exact Mrows/s", "throughput_Mrows_s": "Mrows/s", "speedup": "Speed-up", "total_passes": "Passes", "partitions_pruned_pct": "Pruned", "fa_hit_rate": "Hits", "is_optimizable": "Gate", "correct": "Right"}
    return markdown(results_table(runs), names)


def append_csv(rows: list[dict], path: str) -> None:
    """Append rows; the header is written once."""
    fresh = not os.path.exists(path)
    with open(path, "a", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, fieldnames=list(rows[0])) if rows else None
        if out and fresh:
            out.writeheader()
        if out:
            out.writerows(rows)


def in_mode_order(runs: DataFrame) -> DataFrame:
    """Runs by dataset and then mode, exact first."""
    rank = F.coalesce(*[F.when(F.col("mode") == m, F.lit(i)) for i, m in enumerate(MODES)], F.lit(len(MODES)))
    return runs.orderBy("dataset", rank)


def markdown(df: DataFrame, columns: dict[str, str]) -> str:
    """A Markdown table of the columns under their headings."""
    show = lambda v: f"{v:,.3f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)
    lines = ["| " + " | ".join(columns.values()) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in df.select(*columns).collect()]
    return "\n".join(lines)


def markdown_report(runs: DataFrame) -> str:
    """Two tables: what each run pruned and took, and where its time went."""
    ordered = in_mode_order(runs.withColumn("pruned", F.col("partitions_pruned_pct") * 100))
    summary = {"dataset": "Dataset", "n_rows": "Rows", "mode": "Mode", "total_passes": "Passes", "pruned": "Pruned (%)", "topKBound_after_pass1": "Bound", "total_duration_ms": "Total (ms)"}
    timing = {"dataset": "Dataset", "mode": "Mode", "index_build_duration_ms": "Index (ms)", "sample_duration_ms": "Sample (ms)", "pass1_duration_ms": "Pass 1 (ms)", "pass2plus_duration_ms": "Pass 2+ (ms)", "total_duration_ms": "Total (ms)"}
    return f"# Runs\n\n## Summary\n\n{markdown(ordered, summary)}\n\n## Timing\n\n{markdown(ordered, timing)}\n"


def comparisons(reports: dict[str, dict]) -> dict:
    """Each mode's agreement with the exact one, and modes by duration."""
    exact = reports[Mode.EXACT.value]
    pairs = lambda r: [(json.dumps(x["group_id"], default=str), x["aggregate"]) for x in r["top_k_results"]]
    took = lambda r: r["metrics"]["total_duration_ms"]
    per_mode = {}
    for mode, r in reports.items():
        per_mode[mode] = {
            "matches_exact_top_k_results": pairs(r) == pairs(exact),
            "matches_group_id_set": {p[0] for p in pairs(r)} == {p[0] for p in pairs(exact)},
            "matches_aggregate_multiset": sorted(str(p[1]) for p in pairs(r)) == sorted(str(p[1]) for p in pairs(exact)),
            "total_duration_ms": took(r),
            "duration_delta_vs_bruteforce_ms": took(r) - took(exact),
            "speedup_vs_bruteforce": took(exact) / took(r) if took(r) else None,
            **{m: r["metrics"][m] for m in ("topKBound_after_pass1", "partitions_pruned_pct", "total_passes")},
        }
    ranked = sorted(reports, key=lambda m: took(reports[m]))
    others = [m for m in ranked if m != Mode.EXACT.value]
    listed = lambda modes: [{"mode": m, "total_duration_ms": took(reports[m])} for m in modes]
    return {
        "reference_mode": Mode.EXACT.value, "per_mode": per_mode, "fastest_mode_overall": ranked[0], "fastest_mode_non_bruteforce": others[0] if others else None,
        "modes_by_total_duration_ms": listed(reports), "modes_ranked_by_total_duration_ms": listed(ranked),
    }


def combined_report(reports: dict[str, dict], query: dict) -> dict:
    """All modes of one query in one report."""
    return {"generated_at_utc": datetime.now(timezone.utc).isoformat(), "query": query, "comparisons": comparisons(reports), "modes": reports}
