"""Reproducible shuffling and sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in content order (id, then text checksum and length),
whatever the physical layout. A keyed generalised Feistel network over
Z_a x Z_b (a*b >= n, a*b - n < a) permutes the numbers; a value at or above n
walks on along its cycle until it falls below n (fewer than sqrt(n) + 1 values
can begin such a walk, so where they end is a small table). The permuted number gives
shard ``x % shards`` and slot ``x / shards``, so both can be computed for any
row number without looking at any other row (:func:`place`).
"""

from __future__ import annotations

import math
import struct

import xxhash
from pyspark.sql import DataFrame, functions as F

from quillon.llm.common import saved

ROUNDS = 6


def _hash(seed: int, step: int, half: int) -> int:
    """Spark's ``xxhash64(seed + step, half)`` of two longs, as a signed number."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", seed + step), seed=42)
    h = xxhash.xxh64_intdigest(struct.pack("<q", half), seed=h)
    return h - (1 << 64) if h >> 63 else h


def dimensions(n: int) -> tuple[int, int]:
    """The two radices of the network for ``n`` rows."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def _step(x: int, a: int, b: int, seed: int) -> int:
    left, right = x % a, x // a
    for step in range(ROUNDS):
        if step % 2 == 0:
            left = (left + _hash(seed, step, right)) % a
        else:
            right = (right + _hash(seed, step, left)) % b
    return right * a + left


def permute(x: int, n: int, seed: int) -> int:
    """The permuted place of row number ``x`` among ``n``."""
    a, b = dimensions(n)
    x = _step(x, a, b, seed)
    while x >= n:
        x = _step(x, a, b, seed)
    return x


def place(x: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """(shard, slot) of row number ``x``."""
    p = permute(x, n, seed)
    return p % shards, p // shards


def landings(n: int, seed: int) -> list[tuple[int, int]]:
    """Where each value at or above ``n`` (fewer than sqrt(n) + 1 of them) ends its walk below ``n``."""
    if n == 0:
        return []
    a, b = dimensions(n)
    out = []
    for start in range(n, a * b):
        x = _step(start, a, b, seed)
        while x >= n and x != start:
            x = _step(x, a, b, seed)
        if x < n:  # else a cycle of such values only, which no row enters
            out.append((start, x))
    return out


def permute_column(df: DataFrame, column: str, out: str, n: int, seed: int) -> DataFrame:
    """``df`` with ``out``: the permuted ``column``, by built-in functions only.

    One pass of the network; the few values that leave it at or above ``n``
    walk on, by a broadcast table of where such walks end.
    """
    a, b = dimensions(n)
    left, right, x = "__left", "__right", "__x"
    df = df.withColumns({left: F.expr(f"{column} % {a}L"), right: F.expr(f"{column} div {a}L")})
    for step in range(ROUNDS):
        if step % 2 == 0:
            df = df.withColumn(left, F.expr(f"pmod({left} + pmod(xxhash64({seed + step}L, {right}), {a}L), {a}L)"))
        else:
            df = df.withColumn(right, F.expr(f"pmod({right} + pmod(xxhash64({seed + step}L, {left}), {b}L), {b}L)"))
    df = df.withColumn(x, F.expr(f"{right} * {a}L + {left}")).drop(left, right)
    ends = landings(n, seed)
    if not ends:
        return df.withColumnRenamed(x, out)
    walks = F.broadcast(df.sparkSession.createDataFrame(ends, f"{x} long, __land long"))  # fewer than sqrt(n) + 1 rows
    return df.join(walks, x, "left").withColumn(out, F.coalesce("__land", x)).drop(x, "__land")


def number_rows(df: DataFrame, order: list[str], out: str) -> tuple[DataFrame, int]:
    """``df`` with ``out``, the row's place 0..n-1 in ``order``, and n.

    A range partitioning and a sort within partitions; the partitions' row
    counts (one number for each partition) make the offsets. The ranges are
    checkpointed, so that a lost executor cannot bring other bounds.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    ordered = saved(ordered.withColumn("__at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("__part", F.shiftright("__at", 33))
    counts = sorted((r["__part"], r["n"]) for r in ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(offsets, "__part long, __offset long"))  # a row for each partition
    numbered = ordered.join(starts, "__part").withColumn(out, F.col("__offset") + F.col("__at").bitwiseAND((1 << 33) - 1))
    return numbered.drop("__at", "__part", "__offset"), total


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 7919, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row; shard sizes in rows differ by one at most (law ``rows``).

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law,
    shard, slot (gapless from 0 in each shard), grown_shard (null under this
    law) and row_number. A null text counts as empty (size 16, checksum 0); a
    null id sorts first; rows alike in id and text are told apart by their
    place in the scan only, which shows in no returned column; an empty table
    gives no rows. Equal texts (a group) are spread like any other rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("__scan"),
    )
    numbered, n = number_rows(saved(rows), ["doc_id", "text_crc32", "size", "__scan"], "row_number")
    return permute_column(numbered, "row_number", "__place", n, seed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.expr(f"__place % {shards}L").cast("int").alias("shard"),
        F.expr(f"__place div {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
