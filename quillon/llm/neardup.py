"""Near-duplicate components by a MinHash LSH forest, confirmed on full shingle sets.

1. Every text becomes its set of word shingles (64-bit hashes), a 128-bit hash
   of the set and a MinHash signature. Equal sets form a class, named by its
   smallest doc_id; only class representatives go on.
2. The forest: several orders of the signature's values. Rows are range
   partitioned and sorted by each order, and cut into units of neighbours. A
   sparse region, everything that shares ``MIN_DEPTH`` values, is one unit. A
   dense one is cut where neighbours share the shortest prefixes, so the depth
   grows until a unit has ``UNIT`` rows at most.
3. Within a unit all pairs are candidates; those stay whose whole signatures
   agree in ``SIMILAR`` values or more. Chains of such pairs make regions.
4. Every pair within a region is compared on full sets, in tiles of bounded
   rows and bytes, as a product of incidence matrices; a tile gives only the
   stars of its linked rows, never all pairs. A region of more than ``REGION``
   rows (texts that nearly all share boilerplate) is compared unit by unit
   first, so that work grows with the rows and not with their square.
5. Components of the links.
6. What bounds have cut is compared exactly (``setjoin``): rows of the trees'
   runs that were cut into units, or by the end of a partition, and of large
   regions are joined on their full sets, except within a component. So which
   links are found does not depend on ``UNIT``, ``REGION`` or the layout, but
   for pairs that the forest's signatures miss.
7. Components of all links, and each document's by its class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quillon.llm.common import Words, binary_rows, mix64, partitions, saved, shingles, text_groups
from quillon.llm.graph import LINK, Forest, connected_components
from quillon.llm.setjoin import links_between

TREES, MIN_DEPTH, DEPTH = 20, 4, 12
#: Values of a tree's key, and of the whole signature, in which candidates agree.
AGREE, SIMILAR = 8, 62
VALUES = 96
#: Most rows of a unit; most rows of a region that is compared whole; rows that a walk holds.
UNIT, REGION, HELD = 256, 16384, 1 << 17
_RNG = np.random.default_rng(11)
_FACTORS = _RNG.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The order of signature values in each tree: its own MIN_DEPTH values first, then others.
_ORDERS = np.array([np.concatenate((own, _RNG.permutation(np.setdiff1d(np.arange(VALUES), own))[: DEPTH - MIN_DEPTH])) for own in np.arange(TREES * MIN_DEPTH).reshape(TREES, MIN_DEPTH)])
#: Least rows of a tile's side, tiles along a region's side, and most shingles that a side holds on average.
TILE, TILES_A_SIDE, SIDE_SHINGLES = 64, 32, 1 << 21
_SIGNED = "doc_id long, text_key long, n_shingles long, set_hash binary, signature binary"
_KEYED = "tree int, key binary, rep long"
_CELLS = 1 << 22


def set_hashes(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128-bit hashes of non-empty sets: two 64-bit sums."""
    with np.errstate(over="ignore"):
        return np.stack([np.add.reduceat(mix64(flat + np.uint64(salt)), starts) for salt in (0x1234567, 0x89ABCDEF)], axis=1)


def signatures(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set hashes, signatures) of non-empty sets: 128 bits, and ``VALUES`` 16-bit MinHash values."""
    starts = bounds[:-1]
    with np.errstate(over="ignore"):
        least = np.empty((len(starts), VALUES), dtype=np.uint64)
        for k in range(VALUES):
            least[:, k] = np.minimum.reduceat(flat * _FACTORS[k], starts)
        return set_hashes(flat, starts), (mix64(least) >> np.uint64(48)).astype(np.uint16)


def sign(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_hash, signature) of every row of (doc_id, text, text_key); no set gives null hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in text_groups(texts):
                flat, bounds = shingles(Words(texts[a:b]), size)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                hashes, sigs = [None] * (b - a), [None] * (b - a)
                if len(full):
                    sums, values = signatures(flat, np.append(bounds[:-1][full], len(flat)))
                    for i, at in enumerate(full):
                        hashes[at], sigs[at] = sums[i].tobytes(), values[i].tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_hash", "signature"])

    return docs.mapInArrow(run, _SIGNED)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: the signature's values in the tree's order, as bytes that sort alike, and 16 bits that order equal keys anew in each tree."""
    for batch in batches:
        reps = batch.column(0)
        if not len(reps):
            continue
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, VALUES)
        numbers = reps.to_numpy().view(np.uint64)
        for tree, order in enumerate(_ORDERS):
            with np.errstate(over="ignore"):
                tie = mix64(numbers + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
            keys = np.concatenate((values[:, order], tie.astype(np.uint16)[:, None]), axis=1).astype(">u2")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reps), tree, np.int32)), binary_rows(keys), reps], names=["tree", "key", "rep"])


def _keys(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=">u2").astype(np.uint16).reshape(-1, DEPTH + 1)[:, :DEPTH]


def units(tree: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit of each sorted row, whether the row agrees with another of its unit)."""
    n = len(tree)
    same = keys[1:] == keys[:-1]
    shared = np.where(tree[1:] == tree[:-1], np.cumprod(same, axis=1).sum(axis=1), -1)
    begins = np.concatenate(([True], shared < MIN_DEPTH))
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    for lo, hi in zip(starts[ends - starts > UNIT], ends[ends - starts > UNIT]):
        while hi - lo > UNIT:  # cut where the prefix that neighbours share is shortest
            window = shared[lo + UNIT // 2 - 1 : lo + UNIT]
            lo += UNIT // 2 + int(window.argmin())
            begins[lo] = True
    unit = np.cumsum(begins) - 1
    end = np.append(np.flatnonzero(begins)[1:], n)[unit]
    near, at = np.zeros(n, bool), np.arange(n)
    for step in range(1, UNIT):
        at = at[end[at] > at + step]
        if not len(at):
            break
        hit = at[(keys[at] == keys[at + step]).sum(axis=1) >= AGREE]
        near[hit] = near[hit + step] = True
    return unit, near


_WALKED = "kind int, unit long, rep long, tree int, key binary"


def _walked(kind: int, units: np.ndarray, reps: np.ndarray, trees: list[int] | None = None, keys: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(reps)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(units, pa.int64()), pa.array(reps, pa.int64()), pa.nulls(n, pa.int32()) if trees is None else pa.array(trees, pa.int32()), pa.nulls(n, pa.binary()) if keys is None else pa.array(keys, pa.binary())], names=["kind", "unit", "rep", "tree", "key"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: rows of units that agree with another. Kind 1: the partition's ends, by 2 * partition (+ 1 for the last). Kind 2: rows of runs that are cut, by 4 * partition, and of its first (+ 1) and last run (+ 2)."""
    partition = TaskContext.get().partitionId()
    number = partition << 40
    held: list[tuple] = []
    size, first, last, behind = 0, None, None, None

    def block(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size, number, behind
        tree, keys, reps = (np.concatenate(x) for x in zip(*held))
        n = len(reps)
        begins = np.flatnonzero(np.concatenate(([True], (tree[1:] != tree[:-1]) | (keys[1:, :MIN_DEPTH] != keys[:-1, :MIN_DEPTH]).any(axis=1))))
        if not final and len(begins) > 1:  # the run at the end may go on
            n = int(begins[-1])
            begins = begins[:-1]
        held, size = [(tree[n:], keys[n:], reps[n:])] if n < len(reps) else [], len(reps) - n
        unit, near = units(tree[:n], keys[:n])
        at = np.flatnonzero(near)
        yield _walked(0, unit[at] + number, reps[at])
        lengths = np.diff(np.append(begins, n))
        cut = lengths > UNIT
        prefix = lambda i: (int(tree[i]), keys[i, :MIN_DEPTH].tobytes())
        cut[0] |= behind == prefix(0)
        own = np.repeat(cut, lengths)
        yield _walked(2, np.full(own.sum(), partition << 2), reps[:n][own])
        if number == partition << 40 and not cut[0]:
            yield _walked(2, np.full(lengths[0], (partition << 2) + 1), reps[: lengths[0]])
        if final and not cut[-1]:
            yield _walked(2, np.full(lengths[-1], (partition << 2) + 2), reps[n - lengths[-1] : n])
        behind = prefix(n - 1)
        number += int(unit[-1]) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        blobs = batch.column(1).to_pylist()
        held.append((batch.column(0).to_numpy(), _keys(blobs), batch.column(2).to_numpy()))
        last = (batch.column(2)[-1].as_py(), batch.column(0)[-1].as_py(), blobs[-1])
        if first is None:
            first = (batch.column(2)[0].as_py(), batch.column(0)[0].as_py(), blobs[0])
        size += batch.num_rows
        if size >= HELD:
            yield from block(False)
    if size:
        yield from block(True)
    if first is not None:
        reps, trees, keys = map(list, zip(first, last))
        yield _walked(1, np.array([partition << 1, (partition << 1) + 1]), np.array(reps), trees, keys)


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns behind it) of sorted rows' groups, each of bounded size."""
    now, held = None, []
    for batch in batches:
        for key, *values in zip(zip(*[batch.column(i).to_pylist() for i in range(keys)]), *[batch.column(i).to_pylist() for i in range(keys, batch.num_columns)]):
            if key != now:
                if held:
                    yield now, list(map(list, zip(*held)))
                now, held = key, []
            held.append(values)
    if held:
        yield now, list(map(list, zip(*held)))


_CANDIDATE = "kind int, u long, v long"


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of pairs with similar signatures (kind 0), and the rows that have such a pair, by unit (kind 1)."""
    forest, kept = Forest(), []

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([1] * len(kept), pa.int32()), pa.array([k for k, _ in kept], pa.int64()), pa.array([r for _, r in kept], pa.int64())], names=["kind", "u", "v"])
        kept.clear()
        return out

    for (unit,), (reps, blobs) in _by_key(batches, 1):
        values = np.frombuffer(b"".join(blobs), dtype=np.uint16).reshape(-1, VALUES)
        agree = np.zeros((len(reps), len(reps)), np.uint8)
        for column in values.T:
            agree += column[:, None] == column[None, :]
        link = agree >= SIMILAR
        np.fill_diagonal(link, False)
        label = _labels(link)
        for i in np.flatnonzero(label != np.arange(len(reps))):
            forest.union(reps[i], reps[label[i]])
        kept += [(unit, reps[i]) for i in np.flatnonzero(link.any(axis=1))]
        if len(kept) >= HELD:
            yield rows()
    if kept:
        yield rows()
    if forest.parent:
        stars = forest.stars()
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(stars.num_rows, np.int32)), *stars.columns], names=["kind", "u", "v"])


def _labels(link: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches by a symmetric matrix of links."""
    label = np.arange(len(link))
    while True:
        before = label
        label = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1, initial=len(link)))
        label = label[label]
        if (label == before).all():
            return label


def candidates(reps: DataFrame) -> DataFrame:
    """Stars of candidates (kind 0: u, v), members of units (kind 1: unit, rep) and rows of runs that were cut (kind 2: 0, rep) of (rep, signature) rows."""
    spark = reps.sparkSession
    planted = reps.select("rep", "signature").mapInArrow(_plant, _KEYED)
    walked = saved(planted.repartitionByRange(partitions(spark), "tree", "key", "rep").sortWithinPartitions("tree", "key", "rep").mapInArrow(_walk, _WALKED), small=True)
    # runs that go on across the ends of partitions: two rows from each partition
    ends = {r["unit"]: (r["tree"], bytes(r["key"])[: 2 * MIN_DEPTH]) for r in walked.where("kind = 1").select("unit", "tree", "key").collect()}
    filled = sorted(unit >> 1 for unit in ends if unit & 1)
    across = [n for p, q in zip(filled, filled[1:]) if ends[2 * p + 1] == ends[2 * q] for n in (4 * p + 2, 4 * q + 1)]
    cut = walked.where((F.col("kind") == 2) & ((F.col("unit") % 4 == 0) | F.col("unit").isin(across))).select(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("u"), F.col("rep").alias("v")).distinct()
    signed = walked.where("kind = 0").select("unit", "rep").join(reps.select("rep", "signature"), "rep").select("unit", "rep", "signature")
    similar = signed.repartition(partitions(spark), "unit").sortWithinPartitions("unit", "rep").mapInArrow(_similar, _CANDIDATE)
    return saved(similar.unionByName(cut), small=True)


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Matrix left x right of whether the sets' Jaccard similarity is at least ``percent`` / 100."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
    column = np.cumsum(fresh) - 1
    counts = np.bincount(column) if len(flat) else np.zeros(0, np.int64)
    shared = counts[column] > 1  # what only one set holds cannot be common
    owner, column = owner[shared], column[shared]
    common = np.zeros((len(left), len(right)), dtype=np.float64)
    width = max(256, _CELLS // max(1, len(sets)))
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        for lo in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, (lo, lo + width))
            x = np.zeros((len(sets), min(width, int(column[-1]) + 1 - lo)), dtype=np.float32)
            x[owner[a:b], column[a:b] - lo] = 1
            common += x[left] @ x[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return (100 * common >= percent * union) & (union > 0)


def _tile(sides: list[int], reps: list[int], blobs: list[bytes], percent: int, forest: Forest) -> None:
    """Join the linked rows of one tile; sides are all 0 where the tile compares a chunk with itself."""
    own = {(r, s, b): i for i, (r, s, b) in enumerate(zip(reps, sides, blobs))}  # rows alike in id and text: one of them
    at = sorted(own.values())
    sets, side, reps = [np.frombuffer(blobs[i], dtype=np.uint64) for i in at], np.array(sides)[at], [reps[i] for i in at]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    if not len(left) or not len(right):
        return
    link = linked(sets, left, right, percent)
    label = np.arange(len(sets))
    while True:  # smallest label among linked rows, until nothing changes
        before = label.copy()
        label[left] = np.minimum(label[left], np.where(link, label[right][None, :], len(sets)).min(axis=1))
        label[right] = np.minimum(label[right], np.where(link, label[left][:, None], len(sets)).min(axis=0))
        label = label[label]
        if (label == before).all():
            break
    for i in np.flatnonzero(label != np.arange(len(sets))):
        forest.union(reps[i], reps[label[i]])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for _, held in _by_key(batches, 3):
            if len(held[0]) > 1:
                _tile(*held, percent, forest)
        if forest.parent:
            yield forest.stars()

    return run


_PLACES = "array<struct<region:bigint,chunks:int,chunk:int>>"


def _sets(size: int, carried: str):
    """(rep, ``carried`` column, shingles) of the texts whose set has the hash that its class has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_groups(texts):
                flat, bounds = shingles(Words(texts[a:b]), size)
                full = np.flatnonzero(np.diff(bounds))
                sums = set_hashes(flat, bounds[:-1][full]) if len(full) else ()
                own = [i for i, s in zip(full, sums) if s.tobytes() == hashes[a + i]]
                at = pa.array([a + i for i in own], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(3).take(at), pa.array([flat[bounds[i] : bounds[i + 1]].tobytes() for i in own], pa.binary())], names=["rep", carried, "shingles"])

    return run


def _places(found: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, set_hash, places, large) of the rows to compare: which chunk of which region or, in large regions, of which units."""
    region = connected_components(found.where("kind = 0").select("u", "v")).select(F.col("node").alias("rep"), F.col("component").alias("region"))
    member = saved(region.join(reps.select("rep", "set_hash", "n_shingles"), "rep"), small=True)
    sizes = saved(member.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("shingles")), small=True)
    large = sizes.where(F.col("size") > REGION).select("region")
    member = member.join(sizes.where(F.col("size") <= REGION), "region").withColumn("large", F.lit(False)).unionByName(_by_units(found, member, large).withColumn("large", F.lit(True)))
    chunks = F.greatest(F.least(F.ceil(F.col("size") / TILE), F.lit(TILES_A_SIDE)), F.ceil(F.col("shingles") / SIDE_SHINGLES), F.lit(1)).cast("int")
    placed = member.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    return placed.groupBy("rep", "set_hash").agg(F.collect_list(F.struct("region", "chunks", "chunk")).alias("places"), F.max("large").alias("large"))  # a region, or a unit of each tree at most


def _by_units(found: DataFrame, member: DataFrame, large: DataFrame) -> DataFrame:
    """Rows like ``member``'s with sizes, of large regions: their units stand for regions, by negative numbers. What units do not compare, ``_rest`` does."""
    if large.isEmpty():
        return member.where("false").select("region", "rep", "set_hash", "n_shingles", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("shingles"))
    unit = found.where("kind = 1").select(F.col("u").alias("unit"), F.col("v").alias("rep")).distinct()
    rows = saved(unit.join(member.join(F.broadcast(large), "region", "left_semi").drop("region"), "rep"), small=True)  # fewer large regions than a REGION-th of the rows
    totals = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("shingles"))
    return rows.join(totals, "unit").select((-1 - F.col("unit")).alias("region"), "rep", "set_hash", "n_shingles", "size", "shingles")


def _rest(texts: DataFrame, found: DataFrame, places: DataFrame, reps: DataFrame, components: DataFrame, words: int, percent: int) -> DataFrame | None:
    """All links that are left between components of rows whose runs were cut or whose regions were compared by units; None if there are no such rows."""
    rows = saved(found.where("kind = 2").select(F.col("v").alias("rep")).unionByName(places.where("large").select("rep")).distinct(), small=True)
    if rows.isEmpty():
        return None
    rows = rows.join(reps.select("rep", "set_hash"), "rep").join(components.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.col("rep").alias("doc_id"), F.coalesce("component", "rep").alias("component"))
    sets = texts.join(rows, "doc_id").select("text", "set_hash", F.col("doc_id").alias("rep"), "component").mapInArrow(_sets(words, "component"), "rep long, component long, shingles binary")
    files = max(8, partitions(texts.sparkSession) // 4)  # each file costs memory beside the JVM
    return links_between(saved(sets.dropDuplicates(["rep"]).coalesce(files)), percent)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", key: bool = False) -> DataFrame:
    """Component of every row: doc_id, n_shingles, component_id, kept, class_id; with ``key`` also text_key, the text's hash.

    Words are runs of bytes other than white space, ASCII letters lower-cased;
    a text's set holds its distinct shingles of ``words`` words, the whole
    sequence where there are fewer. Rows are linked where the similarity of
    their sets is at least ``percent`` / 100. A component is named by its
    smallest doc_id; class_id is the smallest doc_id with an equal set. Null,
    empty and blank texts have no set and are linked with nothing. A row
    without an id is its own component, null, and is kept. Rows that share an
    id each take their own text's component. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = saved(sign(texts.withColumn("text_key", F.xxhash64("text")), words))
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = saved(usable.groupBy("set_hash").agg(F.min("doc_id").alias("rep")), small=True)
    reps = usable.join(classes.withColumnRenamed("rep", "doc_id"), ["set_hash", "doc_id"]).dropDuplicates(["set_hash"])  # rows alike have signatures alike
    reps = saved(reps.select(F.col("doc_id").alias("rep"), "set_hash", "n_shingles", "signature"), small=True)
    found = candidates(reps)
    places = saved(_places(found, reps), small=True)
    sets = texts.join(places.withColumnRenamed("rep", "doc_id"), "doc_id").select("text", "set_hash", F.col("doc_id").alias("rep"), "places").mapInArrow(_sets(words, "places"), f"rep long, places {_PLACES}, shingles binary")
    sets = sets.select("rep", "shingles", F.inline("places"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    tiles = sets.select("*", other).select("region", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "rep", "shingles")
    tiles = tiles.repartition(partitions(spark), "region", "a", "b").sortWithinPartitions("region", "a", "b")
    links = saved(tiles.mapInArrow(_confirm(percent), LINK), small=True)
    components = saved(connected_components(links), small=True)
    rest = _rest(texts, found, places, reps, components, words, percent)
    if rest is not None:
        components = saved(connected_components(links.unionByName(rest)), small=True)
    named = saved(classes.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", "rep", F.coalesce("component", "rep").alias("component_id")), small=True)
    # rows without a set or an id need no class, so that nulls are no key of the join
    has = F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull()
    with_class = signed.where(has).select("doc_id", "text_key", "n_shingles", "set_hash").join(named, "set_hash").select("doc_id", "text_key", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), F.col("rep").alias("class_id"))
    alone = signed.where(~has).select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.col("doc_id").alias("class_id"))
    out = with_class.unionByName(alone)
    return out if key else out.drop("text_key")
