"""Connected components of large sparse graphs: local contraction, then rounds of stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm.common import saved

LINK = "u long, v long"


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> pa.RecordBatch:
        """(member, root) for every member, roots included."""
        nodes = list(self.parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.find(x) for x in nodes], pa.int64())], names=["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.union(a, b)
    if forest.parent:
        yield forest.stars()


#: Most edges that one task may contract: a table of two longs each, and its share of a dictionary.
ONE_TASK = 1 << 20


def _by_stars(edges: DataFrame) -> DataFrame:
    """(node, component) by alternating large and small stars: rounds of two shuffles each, about log(n) of them, nothing gathered in one place."""
    now = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), small=True)
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = saved(small.where("u <> v").distinct(), small=True)
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component is named by its smallest node.

    Every partition's edges are contracted to stars; the roots that one node
    has in several partitions make a smaller graph, which one task contracts
    where it has ``ONE_TASK`` edges at most, and rounds of stars elsewhere.
    Self-loops and repeated edges do no harm; no edges give no rows. Nothing is
    collected.
    """
    stars = saved(edges.select("u", "v").mapInArrow(_contract, LINK), small=True)
    # each node has at most one row from a partition, so no group here is large
    lowest = stars.groupBy("u").agg(F.min("v").alias("low"), F.collect_set("v").alias("roots"))
    between = saved(lowest.where(F.size("roots") > 1).select(F.explode("roots").alias("u"), F.col("low").alias("v")).where("u <> v").distinct(), small=True)
    if between.count() <= ONE_TASK:
        roots = between.coalesce(1).mapInArrow(_contract, LINK).select(F.col("u").alias("node"), F.col("v").alias("component"))
    else:
        roots = _by_stars(between)
    names = saved(roots, small=True).withColumnRenamed("node", "v")
    joined = stars.join(names, "v", "left").select(F.col("u").alias("node"), F.coalesce("component", "v").alias("component"))
    return joined.groupBy("node").agg(F.min("component").alias("component"))
