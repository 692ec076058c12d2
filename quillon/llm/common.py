"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a temporary one where that is unset and all runs in one process (tests), else an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame, small: bool = False) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder.

    ``small`` tables (a few bytes for each row of the input, or less) are first
    dealt to fewer partitions, a sixteenth of the usual number: each partition
    is a file, and small files cost more than they hold.
    """
    shared_folder(df.sparkSession)
    if small:
        df = df.repartition(max(8, partitions(df.sparkSession) // 16))
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes that end a word: the class [\x20\x09-\x0D], which no multi-byte UTF-8 character contains.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
#: One random odd 64-bit value per byte, and the base of the polynomial word hash.
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = np.uint64(pow(_BASE, -1, 2**64))
_BLOCK = 1 << 16


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BLOCK + 1, _BASE)
_INV = _powers(_BLOCK + 1, int(_BASE_INVERSE))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch of texts: byte positions, 64-bit hashes and the bounds of each text.

    ``start``/``end`` index ``data`` (lower-cased bytes, texts joined by a
    space); ``bounds[i]:bounds[i + 1]`` are the words of text ``i``.
    """

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
        space = SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.data, self.start, self.end = data, edge[0::2], edge[1::2]
        limits = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, dtype=np.int64)
        self.bounds = np.concatenate(([0], np.searchsorted(self.start, limits))).astype(np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """Polynomial hashes mod 2**64 of the words, mixed; words that straddle blocks are summed piecewise."""
        out = np.zeros(len(self.start), dtype=np.uint64)
        data, start, end = self.data, self.start, self.end
        with np.errstate(over="ignore"):
            for lo in range(0, len(data), _BLOCK):
                part = data[lo : lo + _BLOCK]
                prefix = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(_BYTE_VALUE[part] * _POW[: len(part)], out=prefix[1:])
                first, last = np.searchsorted(end, lo, side="right"), np.searchsorted(start, lo + len(part), side="left")
                s, e = start[first:last] - lo, end[first:last] - lo
                s0, e0 = np.maximum(s, 0), np.minimum(e, len(part))
                value = (prefix[e0] - prefix[s0]) * _INV[s0]
                for k in np.flatnonzero(s < 0):  # a word that began before the block: at most one
                    value[k] = value[k] * np.uint64(pow(_BASE, int(-s[k]), 2**64))
                out[first:last] += value
            length = (end - start).astype(np.uint64)
            return mix64(out ^ mix64(length * np.uint64(0xD6E8FEB86659FD93)))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct ``size``-word shingles of each text, sorted; fewer words make one shingle, none make none."""
    h = words.hashes()
    parts, bounds = [], [0]
    with np.errstate(over="ignore"):
        whole = np.zeros(max(len(h) - size + 1, 0), dtype=np.uint64)
        for k in range(size):
            whole = mix64(whole * np.uint64(0x9FB21C651E98DF25) + h[k : k + len(whole)] + np.uint64(k + 1))
        for i in range(len(words.bounds) - 1):
            a, b = int(words.bounds[i]), int(words.bounds[i + 1])
            if b - a >= size:
                parts.append(np.unique(whole[a : b - size + 1]))
            elif b > a:
                one = np.zeros(1, dtype=np.uint64)
                for k in range(b - a):
                    one = mix64(one * np.uint64(0x9FB21C651E98DF25) + h[a + k : a + k + 1] + np.uint64(k + 1))
                parts.append(mix64(one + np.uint64(b - a)))
            else:
                parts.append(np.zeros(0, dtype=np.uint64))
            bounds.append(bounds[-1] + len(parts[-1]))
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), np.array(bounds, dtype=np.int64)


def text_groups(texts: list[str | None], limit: int = 1_000_000) -> list[tuple[int, int]]:
    """Runs (first, last) of texts of about ``limit`` characters together, one text at least: what is held at once stays bounded."""
    out, first, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > limit:
            out.append((first, i))
            first, size = i, 0
        size += n
    if first < len(texts):
        out.append((first, len(texts)))
    return out


def binary_rows(rows: np.ndarray):
    """A 2-D array's rows as an Arrow binary array."""
    import pyarrow as pa

    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new folder under the shared one, and read again."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 1 << 24).parquet(path)  # small row groups: less memory for each writer
    return spark.read.schema(df.schema).parquet(path)
