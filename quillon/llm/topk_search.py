"""Exact top-k inner-product search, pruned by multi-resolution segment statistics.

For vectors cut into segments of length n with means m and deviations s, the
inner product is at most sum(n * (m_q * m_c + s_q * s_c)), which is the
squared-distance lower bound of segment means and deviations in another form.
Coarse cuts are tried first; a pair whose bound lies below what the query is
sure to reach is dropped before the next finer cut, and exact products are
taken for the pairs that are left.

Queries and candidates meet in cells of bounded size (a block of queries, a
block of candidates); each cell gives its best k for each query, and a window
merges the cells.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillon.llm.common import saved

QUERY_BLOCK, CANDIDATE_BLOCK, STRIP = 2048, 16384, 128
#: Numbers of segments, as shares of the vectors' length; candidates that set a query's threshold, as a multiple of k; pairs taken at once.
CUTS = (1 / 16, 1 / 4, 1 / 2, 3 / 4)
SEEDS, PAIRS = 4, 1 << 15
_ROWS = "uid long, vec_id long, dim int, vec binary"
_CELL = "uid long, query_id long, vec_id long, score long, beyond string"


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Rows of (uid, vec_id, dim, vec): floor(scale * x), as 32-bit integers where all fit, else as doubles; vectors null or with parts null or not finite once scaled are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(2)
            limits = vecs.offsets.to_numpy()
            scaled = np.floor(scale * vecs.values.to_numpy(zero_copy_only=False).astype(np.float64))  # a null part is not a number here
            rows, packed = [], []
            for i in np.flatnonzero(vecs.is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)):
                q = scaled[limits[i] : limits[i + 1]]
                if np.isfinite(q).all():
                    rows.append(i)
                    packed.append(q.astype("<i4" if np.abs(q).max(initial=0) < 2**31 else "<f8").tobytes())
            at = pa.array(rows, pa.int64())
            dims = pa.array((limits[1:] - limits[:-1])[rows] if rows else [], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), dims, pa.array(packed, pa.binary())], names=["uid", "vec_id", "dim", "vec"])

    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(pack, _ROWS)


def _matrix(column, dim: int) -> np.ndarray:
    blobs = column.to_pylist()
    if all(len(b) == 4 * dim for b in blobs):
        return np.frombuffer(b"".join(blobs), dtype="<i4").reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(b, "<i4" if len(b) == 4 * dim else "<f8").astype(np.float64) for b in blobs])


def cuts_of(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine, for vectors of ``dim`` parts."""
    return sorted({max(1, round(dim * share)) for share in CUTS} - {dim})


def _statistics(x: np.ndarray, cuts: int) -> np.ndarray:
    """Features whose inner products bound the rows' inner products from above: scaled means of all segments, deviations of those of two parts or more."""
    parts = np.array_split(np.arange(x.shape[1]), min(cuts, x.shape[1]))
    out = [x[:, p].mean(axis=1) * np.sqrt(len(p)) for p in parts] + [x[:, p].std(axis=1) * np.sqrt(len(p)) for p in parts if len(p) > 1]
    return np.stack(out, axis=1)


def _double(score: int) -> float:
    """The score as a double, or the largest there is."""
    try:
        return float(score)
    except OverflowError:
        return sys.float_info.max if score > 0 else -math.inf


class Cell:
    """Queries (rows) against candidates (columns): bounds by segments, exact products of what they leave."""

    def __init__(self, queries: np.ndarray, candidates: np.ndarray, own: np.ndarray):
        """``own``: the column that is the query's own row, or -1."""
        self.queries, self.candidates, self.own = queries, candidates, own
        self.levels = [(_statistics(queries, c), _statistics(candidates, c)) for c in cuts_of(queries.shape[1])]
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((queries**2).sum(axis=1)), np.sqrt((candidates**2).sum(axis=1))

    def exact(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Exact inner products of pairs, as doubles; as Python's integers where any may need more than 52 bits."""
        with np.errstate(over="ignore"):
            wide = self.norms[0][rows] * self.norms[1][columns] >= 2.0**52
        out = np.empty(len(rows), np.float64)
        for lo in range(0, len(rows), PAIRS):
            at = slice(lo, lo + PAIRS)
            out[at] = np.einsum("ij,ij->i", self.queries[rows[at]], self.candidates[columns[at]])
        if wide.any():
            out = out.astype(object)
            for i in np.flatnonzero(wide):
                out[i] = sum(int(x) * int(y) for x, y in zip(self.queries[rows[i]], self.candidates[columns[i]]))
            out[~wide] = [int(x) for x in out[~wide]]
        return out

    def survivors(self, lo: int, hi: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, candidate) of queries ``lo``..``hi`` that bounds do not rule out of the best ``k``; ties stay."""
        n = len(self.candidates)
        alive = np.ones((hi - lo, n), bool)
        mine = np.flatnonzero(self.own[lo:hi] >= 0)
        alive[mine, self.own[lo:hi][mine]] = False
        if n <= SEEDS * k + 1 or not self.levels:
            r, c = np.nonzero(alive)
            return r + lo, c
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-9 * self.norms[0][lo:hi, None] * self.norms[1][None, :] + 1e-6
            # a threshold that is sure to be reached: the k-th exact score among the candidates of the best bounds
            of_queries, of_candidates = self.levels[-1]
            bound = np.where(alive, np.nan_to_num(of_queries[lo:hi] @ of_candidates.T, nan=np.inf), -np.inf)
            seeds = np.argpartition(-bound, SEEDS * k - 1, axis=1)[:, : SEEDS * k]
            rows = np.repeat(np.arange(lo, hi), SEEDS * k)
            reached = self.exact(rows, seeds.ravel()).reshape(hi - lo, -1)
            floor = np.array([_double(sorted(s)[-k]) for s in reached]) if reached.dtype == object else np.sort(reached, axis=1)[:, -k]
            for (of_queries, of_candidates), found in zip(self.levels, [None] * (len(self.levels) - 1) + [bound]):
                if found is None and alive.mean() < 0.1:
                    r, c = np.nonzero(alive)
                    for at in (slice(x, x + PAIRS) for x in range(0, len(r), PAIRS)):
                        some = np.einsum("ij,ij->i", of_queries[r[at] + lo], of_candidates[c[at]])
                        alive[r[at], c[at]] = ~(some + slack[r[at], c[at]] < floor[r[at]])
                    continue
                found = of_queries[lo:hi] @ of_candidates.T if found is None else found
                alive &= ~(found + slack < floor[:, None])
        r, c = np.nonzero(alive)
        return r + lo, c


def search_cell(queries: np.ndarray, query_uid: np.ndarray, candidates: np.ndarray, uid: np.ndarray, vec_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the best ``k`` candidates of each query; ties go to the smaller vec_id, then the smaller uid. Scores are integers, of Python's where 64 bits may not do."""
    order = np.lexsort((uid, vec_id))
    candidates, uid, vec_id = candidates[order], uid[order], vec_id[order]
    place = {u: i for i, u in enumerate(uid.tolist())}
    cell = Cell(queries, candidates, np.array([place.get(u, -1) for u in query_uid.tolist()], np.int64))
    out: tuple[list, list, list] = ([], [], [])
    for lo in range(0, len(queries), STRIP):
        r, c = cell.survivors(lo, min(lo + STRIP, len(queries)), k)
        score = cell.exact(r, c)
        if score.dtype == object:
            order = np.array(sorted(range(len(r)), key=lambda i: (r[i], -score[i], c[i])), np.int64)
        else:
            order = np.lexsort((c, -score, r))
        r, c, score = r[order], c[order], score[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        for held, x in zip(out, (r[keep], vec_id[c[keep]], score[keep] if score.dtype == object else score[keep].astype(np.int64))):
            held.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _beyond(score: int) -> str:
    """Text that orders scores that 64 bits cannot hold among those of the same clamped value; the same for all others."""
    if _LEAST <= score <= _MOST:
        return "1"
    digits = str(abs(score))
    if score > 0:
        return f"2{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + "".join(str(9 - int(d)) for d in digits)


def top_k_search(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products of each query against every other row.

    ``is_query`` is a condition on ``vec_id``. Returns query_id, rank (from 1),
    vec_id, score; fewer than ``k`` rows where there are fewer candidates.
    Vectors null or holding null or non-finite components, and rows without an
    id, take no part, nor do doubles that scaling makes infinite; vectors of
    different lengths are not comparable and do not meet; a row is never its
    own candidate, but a repeated row is; an empty table gives no rows. Other
    columns are not looked at. Finite components of any size are exact: scores
    are ranked as integers without bounds, and one that 64 bits cannot hold is
    returned as the nearest that they can.
    """
    spark = vectors.sparkSession
    rows = saved(quantise(vectors, id_col, vector_col, scale))
    n_candidates, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    query_blocks, blocks = -(-max(n_queries, 1) // QUERY_BLOCK), -(-max(n_candidates, 1) // CANDIDATE_BLOCK)
    spread = F.xxhash64("uid")
    queries = rows.where(is_query).withColumn("qb", F.pmod(spread, F.lit(query_blocks))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    candidates = rows.withColumn("cb", F.pmod(spread, F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        query_uid, query_id = left.column("uid").to_numpy(), left.column("vec_id").to_numpy()
        if len(query_uid) and right.num_rows:
            dim = left.column("dim")[0].as_py()
            if dim:
                out = search_cell(_matrix(left.column("vec"), dim), query_uid, _matrix(right.column("vec"), dim), right.column("uid").to_numpy(), right.column("vec_id").to_numpy(), k)
            else:
                r, c = np.nonzero(query_uid[:, None] != right.column("uid").to_numpy()[None, :])
                out = (r, right.column("vec_id").to_numpy()[c], np.zeros(len(r), np.int64))
        at, scores = np.asarray(out[0], dtype=np.int64), np.asarray(out[2])
        beyond = [_beyond(s) for s in scores] if scores.dtype == object else ["1"] * len(at)
        scores = [min(max(s, _LEAST), _MOST) for s in scores] if scores.dtype == object else scores
        return pa.table([pa.array(query_uid[at], pa.int64()), pa.array(query_id[at], pa.int64()), pa.array(out[1], pa.int64()), pa.array(scores, pa.int64()), pa.array(beyond, pa.string())], names=["uid", "query_id", "vec_id", "score", "beyond"])

    found = queries.groupBy("dim", "qb", "cb").cogroup(candidates.groupBy("dim", "qb", "cb")).applyInArrow(cell, _CELL)
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("beyond").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
