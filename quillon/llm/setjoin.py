"""Exact links between sets of different components, by prefixes in order of rarity.

Sets of similarity ``percent`` / 100 or more share one of the first
n - ceil(percent * n / 100) + 1 shingles of each, whatever the order, if it is
the same for all. The order here is by number of occurrences, counted in
``cells`` by hash, so that what few sets hold comes first. Sets that share such a
shingle, are alike enough in size, in how many shingles follow and in the
parities of all, and are of different components are compared in full. Nothing is sampled or capped:
a shingle that many sets begin with is dealt to tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm.common import binary_rows, mix64, partitions, saved
from quillon.llm.graph import LINK, Forest

#: Least and most cells of the counts; cells of a row; steps of a level to each doubling.
FEW_CELLS, MANY_CELLS, CELLS_A_ROW, STEPS = 1 << 12, 1 << 21, 1 << 16, 8
#: Entries of a bucket on average; entries of a tile's side; entries and pairs held at once; shingles of a block.
BUCKET, SIDE, HELD, BLOCK_SHINGLES = 1 << 17, 1 << 14, 1 << 18, 1 << 21
_ENTRY = np.dtype([("key", "<u8"), ("rep", "<i8"), ("component", "<i8"), ("n", "<i4"), ("left", "<i4"), ("even", "<u8"), ("odd", "<u8")])


def _flat(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) // 8 for b in blobs], np.int64)
    return np.frombuffer(b"".join(blobs), np.uint64), sizes


def _levels(sets: DataFrame, cells: int) -> np.ndarray:
    """For each cell, a step of the logarithm of the shingles in it; 0 for one or none."""
    rows = max(1, cells // CELLS_A_ROW)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(cells, np.int64), [], 0

        def cell_counts() -> np.ndarray:
            nonlocal size
            flat, _ = _flat(held)
            held.clear()
            size = 0
            return np.bincount((flat & np.uint64(cells - 1)).astype(np.int64), minlength=cells)

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(blob)
                size += len(blob) // 8
                if size >= HELD:
                    total += cell_counts()
        if held:
            total += cell_counts()
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), binary_rows(total.reshape(rows, -1))], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(blob, np.int64)
                sums[part] = sums[part] + counts if part in sums else counts
        for part, counts in sums.items():
            levels = np.minimum(np.ceil(STEPS * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([levels.tobytes()], pa.binary())], names=["part", "levels"])

    counted = sets.select("shingles").mapInArrow(count, "part int, counts binary").repartition(partitions(sets.sparkSession), "part")
    out = np.zeros((rows, cells // rows), np.uint8)
    for row in counted.mapInArrow(add, "part int, levels binary").collect():  # a byte for each cell
        out[row["part"]] = np.frombuffer(row["levels"], np.uint8)
    return out.ravel()


def prefixes(reps: np.ndarray, components: np.ndarray, blobs: list[bytes], percent: int, levels: np.ndarray) -> np.ndarray:
    """Entries of the sets' prefixes; a shingle with a cell of its own is in one set only and left out."""
    flat, n = _flat(blobs)
    starts = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    bit = flat >> np.uint64(57)
    one = np.uint64(1) << (bit & np.uint64(63))
    even, odd = (np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == half, one, np.uint64(0)), starts) for half in (0, 1))
    level = levels[(flat & np.uint64(len(levels) - 1)).astype(np.int64)]
    order = np.lexsort((flat, level, owner))
    flat, level = flat[order], level[order]
    most = n + (-percent * n) // 100 + 1
    place = np.arange(len(flat)) - starts[owner]
    at = np.flatnonzero((place < most[owner]) & (level > 0))
    sides = np.ceil(2.0 ** (level[at] / STEPS) / SIDE).astype(np.int64)
    key, of, place = flat[at], owner[at], place[at]
    wide = np.flatnonzero(sides > 1)
    if len(wide):  # each set to the tiles of its side with every other
        copies = sides[wide]
        other = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        with np.errstate(over="ignore"):
            own = (mix64(reps[of[wide]].astype(np.uint64)) % copies.astype(np.uint64)).astype(np.int64)
            own, first = np.repeat(own, copies), np.repeat(key[wide], copies)
            tile = np.minimum(own, other) * np.repeat(copies, copies) + np.maximum(own, other)
            dealt = mix64(first + (tile.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        narrow = np.flatnonzero(sides <= 1)
        again = np.concatenate((narrow, np.repeat(wide, copies)))
        key, of, place = np.concatenate((key[narrow], dealt)), of[again], place[again]
    out = np.empty(len(key), _ENTRY)
    out["key"], out["rep"], out["component"], out["n"], out["left"], out["even"], out["odd"] = key, reps[of], components[of], n[of], n[of] - place, even[of], odd[of]
    return out


def _deal(percent: int, levels: np.ndarray, buckets: int):
    """(bucket, entries) of (rep, component, shingles) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            nonlocal held, size
            entries = np.concatenate(held)
            bucket = (mix64(entries["key"]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            entries, bucket = entries[order], bucket[order]
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([e.tobytes() for e in np.split(entries, first[1:])], pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            reps, components, blobs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            group = np.cumsum([len(b) // 8 for b in blobs]) // HELD  # sets of about HELD shingles together
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(blobs)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    held.append(prefixes(reps[lo:hi], components[lo:hi], blobs[lo:hi], percent, levels))
                    size += len(held[-1])
                if size >= HELD:
                    yield out()
        if size:
            yield out()

    return run


def pairs(entries: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Rows (u, v), u < v, that may be similar: of one key and different components, a bounded number at once."""
    e = entries[np.lexsort((entries["component"], entries["key"]))]
    # a set in whose order too little follows for the key's smallest set has an earlier key in common with what is similar
    begins = np.flatnonzero(np.concatenate(([True], e["key"][1:] != e["key"][:-1])))
    least = np.repeat(np.minimum.reduceat(e["n"], begins), np.diff(np.append(begins, len(e)))).astype(np.int64)
    e = e[e["left"].astype(np.int64) * (100 + percent) >= percent * (e["n"] + least)]
    if not len(e):
        return
    fresh = np.concatenate(([True], e["key"][1:] != e["key"][:-1], [True]))
    end = np.flatnonzero(fresh)[np.cumsum(fresh[:-1])]
    fresh[1:-1] |= e["component"][1:] != e["component"][:-1]
    other = np.flatnonzero(fresh)[np.cumsum(fresh[:-1])]
    at = np.flatnonzero(other < end)
    now, end, e = other[at], end[at], {name: e[name].astype(np.int64) if name in ("n", "left") else np.ascontiguousarray(e[name]) for name in _ENTRY.names}
    held, size = [], 0
    while len(at):
        both = e["n"][at] + e["n"][now]
        need = -((-percent * both) // (100 + percent))
        apart = np.bitwise_count(e["even"][at] ^ e["even"][now]).astype(np.int64) + np.bitwise_count(e["odd"][at] ^ e["odd"][now])
        ok = np.flatnonzero((np.minimum(e["left"][at], e["left"][now]) >= need) & (apart <= both - 2 * need))
        if len(ok):
            a, b = e["rep"][at[ok]], e["rep"][now[ok]]
            held.append(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1))
            size += len(ok)
            if size >= HELD:
                yield np.unique(np.concatenate(held), axis=0)
                held, size = [], 0
        more = now + 1 < end
        at, now, end = at[more], now[more] + 1, end[more]
    if held:
        yield np.unique(np.concatenate(held), axis=0)


def _pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for found in pairs(np.frombuffer(b"".join(held), _ENTRY), percent):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

        for batch in batches:
            for now, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now != bucket and held:
                    yield from out()
                    held = []
                bucket = now
                held.append(blob)
        if held:
            yield from out()

    return run


def _compare(percent: int):
    """Stars of linked pairs, of tiles sorted so that their sets (kind 0) precede their pairs (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        tile, sets, u, others = None, {}, None, []

        def confirm() -> None:
            known = forest.parent
            left = [v for v in others if u not in known or v not in known or forest.find(u) != forest.find(v)]
            others.clear()
            if not left:
                return
            own, (flat, sizes) = np.frombuffer(sets[u], np.uint64), _flat([sets[v] for v in left])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
            for i in np.flatnonzero(100 * common >= percent * (len(own) + sizes - common)):
                forest.union(u, left[i])

        for batch in batches:
            for a, b, kind, x, y, blob in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if others and ((a, b) != tile or x != u or len(others) >= 1024):
                    confirm()
                if (a, b) != tile:
                    tile, sets = (a, b), {}
                if kind == 0:
                    sets[x] = blob
                else:
                    u = x
                    others.append(y)
        if others:
            confirm()
        if forest.parent:
            yield forest.stars()

    return run


def links_between(sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join all similar sets of different components, of saved (rep, component, shingles) rows; a rep is there once."""
    spark = sets.sparkSession
    rows, total = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("shingles") / 8), F.lit(0))).first()
    cells = min(MANY_CELLS, max(FEW_CELLS, 1 << int(total).bit_length()))
    levels = _levels(sets, cells)
    buckets = max(partitions(spark), int((total * (100 - percent) / 100 + rows) / BUCKET))
    dealt = sets.select("rep", "component", "shingles").mapInArrow(_deal(percent, levels, buckets), "bucket int, entries binary")
    found = dealt.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_pairs(percent), LINK)
    found = saved(found.distinct(), small=True)
    blocks = max(int(total / BLOCK_SHINGLES) + 1, min(16, rows // 64 + 1))
    block = lambda name: F.pmod(F.xxhash64(name), F.lit(blocks))
    tiled = found.select(F.least(block("u"), block("v")).alias("a"), F.greatest(block("u"), block("v")).alias("b"), "u", "v")
    needed = tiled.select("a", "b", F.explode(F.array("u", "v")).alias("rep")).distinct().join(sets.select("rep", "shingles"), "rep")
    both = needed.select("a", "b", F.lit(0).alias("kind"), F.col("rep").alias("u"), F.lit(None).cast("long").alias("v"), "shingles")
    both = both.unionByName(tiled.select("a", "b", F.lit(1).alias("kind"), "u", "v", F.lit(None).cast("binary").alias("shingles")))
    return both.repartition(partitions(spark), "a", "b").sortWithinPartitions("a", "b", "kind", "u").mapInArrow(_compare(percent), LINK)
