"""Headline timings: one JSON line with seconds for each query.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``.
Besides the standard tables it times all modes on a generated skewed table of
``$BENCH_ZIPF_ROWS`` rows (default 20 million; 0 leaves it out), a tenth of the
after one to warm up, and includes sampling, index builds and every pass.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import functions as F

from quillon.config import Mode, TopKConfig
from quillon.plans.engine import top_k
from quillon.queries import QUERIES
from quillon.session import local_session
from quillon.sources.generators import DATASETS, generate

HEADLINE = [
    "topk_sum_exact", "topk_count_exact", "topk_max_exact", "topk_min_exact", "topk_sum_baseline", "topk_max_baseline", "topk_sum_ext_a", "topk_sum_ext_b", "topk_sum_ext_ab", "topk_sum_fallback", "topk_forced_prune", "topk_max_ties",
    "topk_two_keys", "topk_join_input", "bucket_stats", "occurrence_index", "measure_index",
]
RUNS = 3


def timed(run) -> float:
    run()
    took = []
    for _ in range(RUNS):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return round(median(took), 4)


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    n_zipf = int(os.environ.get("BENCH_ZIPF_ROWS", "20000000"))
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: timed(lambda name=name: QUERIES[name](spark, sf_dir).collect()) for name in HEADLINE}
    extra = {}
    if n_zipf:
        recipe = DATASETS["D1_vanilla"]
        folder = tempfile.mkdtemp(prefix="quillon-bench-")
        try:
            generate(spark, recipe.scaled(n_zipf / recipe.n_rows)).write.parquet(f"{folder}/zipf")
            rows = spark.read.parquet(f"{folder}/zipf")
            n = rows.count()
            for mode in Mode:
                name = f"zipf_sum_{mode.name.lower()}"
                config = TopKConfig(fa_capacity=5000, n_partitions=10_000, sample_frac=0.001)
                queries[name] = timed(lambda mode=mode, config=config: top_k(rows, "group_id", F.col("value"), 50, "SUM", mode, config).df.collect())
                extra[f"{name}_Mrows_s"] = round(n / queries[name] / 1e6, 2)
        finally:
            shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(queries.values()), 4), "unit": "sec", "queries": queries, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "zipf_rows": n_zipf, "throughput": extra}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
