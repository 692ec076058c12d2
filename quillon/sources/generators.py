"""Synthetic (group_id, value) tables: id and value distributions, rare groups, and the named datasets.

Rows are made on the executors from row numbers, a part at a time; the same
arguments give the same rows, whatever the cluster.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows that share one random stream.
PART = 1 << 18
WINDOW = 1024
DISTRIBUTIONS = ("zipf", "uniform", "sorted", "heavy_hitter", "self_similar", "moving_cluster")


def _uniform(seed: int, salt: int) -> Column:
    """A uniform in (0, 1) from the row number: no state, so any split of the rows gives the same values."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), 11).cast("double") + 0.5) / float(1 << 53)


def _zipf(spark: SparkSession, n_rows: int, n_groups: int, alpha: float, seed: int) -> DataFrame:
    """(id, group_id) with frequencies 1 / rank**alpha: drawn from the Zipf law modulo the groups above 1, by weighted choice up to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = None
        if alpha <= 1:
            steps = np.cumsum(1.0 / np.arange(1, n_groups + 1) ** alpha)
            steps /= steps[-1]
        for batch in batches:
            for part in batch.column(0).to_pylist():
                n = min(PART, n_rows - part * PART)
                rng = np.random.default_rng((seed, part))
                ids = (rng.zipf(alpha, n) - 1) % n_groups if alpha > 1 else np.minimum(np.searchsorted(steps, rng.random(n)), n_groups - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part * PART, part * PART + n)), pa.array(ids.astype(np.int64))], names=["id", "group_id"])

    return spark.range(-(-n_rows // PART)).mapInArrow(run, "id long, group_id long")


def group_ids(spark: SparkSession, n_rows: int, n_groups: int, distribution: str = "zipf", alpha: float = 1.2, seed: int = 42) -> DataFrame:
    """(id, group_id) for rows 0..n_rows - 1 under a distribution of ``DISTRIBUTIONS``."""
    if distribution == "zipf":
        return _zipf(spark, n_rows, n_groups, alpha, seed)
    rows, u, pick = spark.range(n_rows), _uniform(seed, 1), _uniform(seed, 2)
    below = lambda n: F.least(F.floor(u * n), F.lit(max(n - 1, 0)))
    few = max(1, n_groups // 10 if distribution == "heavy_hitter" else n_groups // 5)
    share = 0.5 if distribution == "heavy_hitter" else 0.8
    rest = max(n_groups - few, 1)
    ids = {
        "uniform": below(n_groups),
        "sorted": F.col("id") % n_groups,
        "heavy_hitter": F.when(pick < share, below(few)).otherwise(F.least(F.lit(few) + below(rest), F.lit(n_groups - 1))),
        "self_similar": F.when(pick < share, below(few)).otherwise(F.least(F.lit(few) + below(rest), F.lit(n_groups - 1))),
        "moving_cluster": (F.floor(F.col("id") * (max(n_groups - WINDOW, 0) / max(n_rows, 1))) + below(min(WINDOW, n_groups))) % n_groups,
    }
    if distribution not in ids:
        raise ValueError(f"unknown distribution {distribution!r}; one of {', '.join(DISTRIBUTIONS)}")
    return rows.select("id", ids[distribution].cast("long").alias("group_id"))


def values(distribution: str = "exponential", scale: float = 100.0, seed: int = 42) -> Column:
    """A measure for each row: exponential of mean ``scale``, uniform on [0, 2 * scale), or constant."""
    u = _uniform(seed, 3)
    known = {"exponential": -F.log(u) * scale, "uniform": u * (2 * scale), "constant": F.lit(float(scale))}
    if distribution not in known:
        raise ValueError(f"unknown value distribution {distribution!r}; one of {', '.join(known)}")
    return known[distribution]


@dataclass(frozen=True)
class Dataset:
    """A recipe: base rows and groups, distributions, and rare groups of few but large rows."""

    name: str
    n_rows: int
    n_groups: int
    alpha: float = 1.2
    distribution: str = "zipf"
    value_distribution: str = "exponential"
    value_scale: float = 100.0
    rare_fraction: float = 0.0
    rare_rows: int = 0
    rare_multiplier: float = 1.0
    seed: int = 42

    def scaled(self, by: float) -> Dataset:
        """The same shape over ``by`` times the rows and groups."""
        return Dataset(**asdict(self) | {"n_rows": max(1, round(self.n_rows * by)), "n_groups": max(1, round(self.n_groups * by))})


def generate(spark: SparkSession, recipe: Dataset, shuffle: bool = False) -> DataFrame:
    """The rows of a recipe: base rows, and for a share of further ids 1..rare_rows rows of a large constant."""
    ids = group_ids(spark, recipe.n_rows, recipe.n_groups, recipe.distribution, recipe.alpha, recipe.seed)
    out = ids.select("group_id", values(recipe.value_distribution, recipe.value_scale, recipe.seed).alias("value"))
    n_rare = int(recipe.n_groups * recipe.rare_fraction)
    if n_rare and recipe.rare_rows:
        times = F.floor(_uniform(recipe.seed, 4) * recipe.rare_rows).cast("int") + 1
        rare = spark.range(n_rare).select((F.col("id") + recipe.n_groups).alias("group_id"), F.explode(F.sequence(F.lit(1), times)).alias("__copy"))
        out = out.unionByName(rare.select("group_id", F.lit(recipe.value_scale * recipe.rare_multiplier).alias("value")))
    return out.orderBy(F.rand(recipe.seed)) if shuffle else out


# The named datasets and their parameters.
DATASETS = {
    d.name: d
    for d in (
        Dataset("tiny", 1_000, 50, 1.2, rare_fraction=0.1, rare_rows=3, rare_multiplier=100),
        Dataset("S0", 10_000, 500, 1.2, rare_fraction=0.1, rare_rows=3, rare_multiplier=100),
        Dataset("S1", 10_000_000, 10_000_000, 1.1),
        Dataset("S2", 10_000_000, 10_000_000, 1.0, rare_fraction=0.00001, rare_rows=20_000, rare_multiplier=10_000),
        Dataset("monster_adv", 100_000_000, 10_000_000, 1.1, rare_fraction=0.00001, rare_rows=1, rare_multiplier=1_000_000),
        Dataset("D1_vanilla", 200_000_000, 30_000_000, 1.2),
        Dataset("D2_ext_a_target", 200_000_000, 30_000_000, 1.1, rare_fraction=0.05, rare_rows=5, rare_multiplier=500),
        Dataset("D3_ext_b_target", 200_000_000, 30_000_000, 1.1, rare_fraction=0.00001, rare_rows=1, rare_multiplier=1_000_000),
        Dataset("D4_chaos", 200_000_000, 30_000_000, 1.05, rare_fraction=0.02, rare_rows=3, rare_multiplier=50_000),
        Dataset("scale_100M", 100_000_000, 15_000_000, 1.05, rare_fraction=0.02, rare_rows=3, rare_multiplier=50_000),
        Dataset("scale_300M", 300_000_000, 37_000_000, 1.05, rare_fraction=0.02, rare_rows=3, rare_multiplier=50_000),
        Dataset("scale_400M", 400_000_000, 55_000_000, 1.05, rare_fraction=0.02, rare_rows=3, rare_multiplier=50_000),
    )
}


def suite(sizes: tuple[int, ...] = (1_000_000, 5_000_000, 10_000_000, 50_000_000), groups_ratio: float = 0.1, alpha: float = 0.5, value_distribution: str = "uniform", value_scale: float = 50.0, seed: int = 42) -> list[Dataset]:
    """Recipes of the benchmark suite: every distribution at every size; values are uniform on [0, 100) by default."""

    def tag(n: int) -> str:
        return f"{n // 1_000_000}M" if n >= 1_000_000 else f"{n // 1000}K" if n >= 1000 else str(n)

    out = []
    for n_rows in sizes:
        n_groups = max(100, round(n_rows * groups_ratio))
        out += [Dataset(f"{d}_{tag(n_rows)}_G{tag(n_groups)}", n_rows, n_groups, alpha, d, value_distribution, value_scale, seed=seed) for d in DISTRIBUTIONS]
    return out


def describe(df: DataFrame, recipe: Dataset, path: str, seconds: float) -> dict:
    """A manifest entry, with the rows and distinct groups that are there."""
    n_rows, n_groups = df.agg(F.count(F.lit(1)), F.countDistinct("group_id")).first()
    size = 16 * n_rows
    return {
        "name": recipe.name, "n_rows": n_rows, "n_groups_requested": recipe.n_groups, "n_groups_actual": n_groups, "group_dist": recipe.distribution, "zipf_alpha": recipe.alpha, "value_dist": recipe.value_distribution,
        "value_scale": recipe.value_scale, "seed": recipe.seed, "file_size_bytes": size, "file_size_mb": size / 1e6, "gen_time_sec": seconds, "path": path, "skipped": False,
    }


def write_datasets(spark: SparkSession, recipes: list[Dataset], folder: str) -> list[dict]:
    """Write each recipe as a folder of 16-byte rows, and ``manifest.json`` beside them."""
    from quillon.sources.binary import read_rows, write_rows
    from quillon.sources.reports import write_text

    entries = []
    for recipe in recipes:
        began, path = time.perf_counter(), f"{folder}/{recipe.name}"
        write_rows(generate(spark, recipe), path)
        entries.append(describe(read_rows(spark, path), recipe, path, time.perf_counter() - began))
    write_text(spark, json.dumps(entries, indent=2), f"{folder}/manifest.json")
    return entries
