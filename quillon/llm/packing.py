"""Bounded-space best-fit packing of tokenised documents into fixed-length sequences.

Every scan partition packs its own documents: an arriving piece goes to the
open sequence whose free space fits it best, found in a bitset keyed by free
space. At most ``max_open`` sequences are open; beyond that the fullest closes
first. Pieces arrive in windows, longest first, so that short ones fill gaps.
What lies in sequences that stayed loose is then dealt evenly to a few tasks,
whatever partitions it came from, and packed once more in the same way, by its
lengths alone; so tables in order of length or source pack well too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quillon.llm.common import saved, stored
from quillon.llm.tokens import byte_bpe

#: A sequence is loose with a LOOSE-th of its capacity free; pieces that one task packs again; most of these whose new places are sent to all executors.
LOOSE, AGAIN, BROADCAST = 32, 1 << 18, 200_000
#: Rows returned at once.
ROWS = 512
SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class BestFit:
    """Online best-fit with a bounded number of open sequences of ``capacity``."""

    def __init__(self, capacity: int, max_open: int, first_id: int = 0):
        self.capacity, self.max_open, self.next_id = capacity, max_open, first_id
        self.free: dict[int, list[int]] = defaultdict(list)
        self.mask = 0
        self.open = 0

    def _pop(self, space: int) -> int:
        bins = self.free[space]
        at = bins.pop()
        self.open -= 1
        if not bins:
            self.mask &= ~(1 << space)
        return at

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        fitting = self.mask >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            at = self._pop(space)
        else:
            at, space = self.next_id, self.capacity
            self.next_id += 1
        left = space - length
        if left:
            if self.open >= self.max_open:
                self._pop((self.mask & -self.mask).bit_length() - 1)
            self.free[left].append(at)
            self.mask |= 1 << left
            self.open += 1
        return at, self.capacity - space


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole if it fits, else full pieces behind a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _again(capacity: int, max_open: int):
    """(sequence_id, offset, to_sequence, to_offset): new places of pieces, longest first; negative numbers are new sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(((n, s, o) for batch in batches for s, o, n in zip(*[batch.column(i).to_pylist() for i in range(3)])), key=lambda p: (-p[0], p[1], p[2]))
        if held:
            fit = BestFit(capacity, max_open, TaskContext.get().partitionId() << 40)
            placed = [fit.place(n) for n, _, _ in held]
            columns = ([s for _, s, _ in held], [o for _, _, o in held], [-1 - at for at, _ in placed], [offset for _, offset in placed])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["sequence_id", "offset", "to_sequence", "to_offset"])

    return run


def _repack(pieces: DataFrame, capacity: int, max_open: int) -> DataFrame:
    """``pieces`` with those of loose sequences packed again, if that takes fewer sequences."""
    fills = pieces.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.count(F.lit(1)).alias("n"))
    loose = saved(fills.where(F.col("fill") <= capacity - max(1, capacity // LOOSE)), small=True)
    sequences, n = loose.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if sequences < 2:
        return pieces
    items = pieces.select("sequence_id", "offset", "length").join(loose.select("sequence_id"), "sequence_id")
    moved = saved(items.repartition(-(-n // AGAIN)).mapInArrow(_again(capacity, max_open), "sequence_id long, offset long, to_sequence long, to_offset long"), small=True)
    if moved.select("to_sequence").distinct().count() >= sequences:
        return pieces
    out = pieces.join(F.broadcast(moved) if n <= BROADCAST else moved, ["sequence_id", "offset"], "left")
    at = {"sequence_id": F.coalesce("to_sequence", "sequence_id"), "offset": F.coalesce("to_offset", "offset")}
    return out.select(*[at[c].alias(c) if c in at else c for c in pieces.columns])


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, max_open: int = 65536, window: int = 16384, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each piece of each document: where its tokens lie in which sequence.

    A document is its byte-level BPE ids and one ``end_id``; a null or empty
    text is the end alone. Only documents longer than ``capacity`` are cut.
    Sequence ids are unique over the table, offsets gapless from 0. A null id
    is kept as null; repeated rows are packed each on its own; an empty table
    gives no rows. ``ids`` are little-endian unsigned 32-bit integers.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer_path)
        fit = BestFit(capacity, max_open, TaskContext.get().partitionId() << 40)
        pending: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            pending.sort(key=lambda p: -p[3])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            for lo in range(0, len(pending), ROWS):
                some = pending[lo : lo + ROWS]
                placed = [fit.place(p[3]) for p in some]
                arrays = [pa.array([p[i] for p in some], kind) for i, kind in enumerate(kinds)]
                arrays += [pa.array([p[i] for p in placed], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])
            pending.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    pending.append((doc_id, piece, start, length, ids[start : start + length].tobytes()))
                if len(pending) >= window:
                    yield from flush()
        if pending:
            yield from flush()

    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, SCHEMA)
    return _repack(stored(packed, "pieces"), capacity, max_open)
