"""Command line: ``python -m quillon.cli --input PATH --output OUT.json [--mode MODE | --all-modes] [options]``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from quillon.config import Agg, Mode, TopKConfig
from quillon.plans.engine import top_k
from quillon.session import local_session
from quillon.sources import reports
from quillon.sources.binary import infer_n_rows, read_rows

_OPTIONS = {
    "fa-capacity": int, "n-partitions": int, "sample-frac": float, "delta": float, "alpha-ci": float, "beta-ci": float, "alpha-locality": float, "underrep-threshold": float, "boost-rows": int, "measure-m": int,
    "min-topk-share": float, "min-rows-per-core": int, "max-levels": int, "seed": int,
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillon", allow_abbrev=False, description="The k groups with the largest aggregate.")
    out.add_argument("--input", required=True, help="16-byte rows (a file or folder), or a Parquet path with --group-cols and --value-col")
    out.add_argument("--output", required=True, help="JSON report")
    out.add_argument("--n-rows", type=int, help="rows expected; must be the number there")
    out.add_argument("--k", type=int, default=50)
    out.add_argument("--agg", type=Agg.parse, default=Agg.SUM)
    out.add_argument("--mode", type=Mode.parse, default=Mode.SAMPLE)
    out.add_argument("--all-modes", action="store_true", help="run every mode and compare them")
    out.add_argument("--group-cols", nargs="+")
    out.add_argument("--value-col")
    out.add_argument("--force", action="store_true", help="prune even where the gates advise against it")
    out.add_argument("--output-fa-groups", action="store_true")
    out.add_argument("--verbose", action="store_true")
    out.add_argument("--segment-size", type=int, help="accepted and without effect: Spark splits its scans itself")
    defaults = TopKConfig()
    for name, kind in _OPTIONS.items():
        out.add_argument(f"--{name}", type=kind, default=getattr(defaults, name.replace("-", "_")))
    return out


def load(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, list[str], str, int]:
    """(rows, key columns, value column, number of rows)."""
    if args.group_cols:
        if not args.value_col:
            raise ValueError("--group-cols needs --value-col")
        df = spark.read.parquet(args.input)
        n = df.count()
        if args.n_rows is not None and args.n_rows != n:
            raise ValueError(f"{args.input} has {n} rows, not {args.n_rows}")
        return df, args.group_cols, args.value_col, n
    return read_rows(spark, args.input, args.n_rows), ["group_id"], "value", infer_n_rows(args.input)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    config = TopKConfig(**{n.replace("-", "_"): getattr(args, n.replace("-", "_")) for n in _OPTIONS}, force=args.force)
    spark = spark or local_session()
    df, keys, value, n_rows = load(spark, args)

    def run(mode: Mode) -> dict:
        began = time.perf_counter()
        result = top_k(df, keys, value, args.k, args.agg, mode, config)
        report = reports.result_report(result, mode.value, args.k, n_rows, keys, args.output_fa_groups)
        report["metrics"]["total_duration_ms"] = (time.perf_counter() - began) * 1000  # with the final action
        if args.verbose:
            print(f"{mode.value}: {report['metrics']['total_duration_ms']:.0f} ms", file=sys.stderr)
        return report

    if args.all_modes:
        found = {mode.value: run(mode) for mode in Mode}
        out = reports.combined_report(found, {"input": args.input, "n_rows": n_rows, "n_rows_inferred": args.n_rows is None, "k": args.k, "agg": args.agg.value})
    else:
        out = run(args.mode)
    reports.write_json(out, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
