"""Headerless files of 16-byte rows: an unsigned 64-bit group id and a double, little-endian.

``spark.read.format("rows16").load(path)`` after :func:`register`; option
``id`` is ``long`` (the default; ids above 2**63 - 1 are an error) or
``decimal`` (all ids). A path may be a file or a folder of such files. Byte
ranges aligned to rows are read side by side.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

ROW = np.dtype([("group_id", "<u8"), ("value", "<f8")])
_STEP = 1 << 20


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def _files(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    store, inner = _store(path)
    info = store.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.Directory:
        found = store.get_file_info(pafs.FileSelector(inner, recursive=False))
        return store, sorted((f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
    return store, [info]


def infer_n_rows(path: str) -> int:
    """Rows of a file or folder, from its size; a size that is no multiple of 16 is an error."""
    _, files = _files(path)
    for f in files:
        if f.size % ROW.itemsize:
            raise ValueError(f"{f.path}: {f.size} bytes are not whole rows of {ROW.itemsize}")
    return sum(f.size for f in files) // ROW.itemsize


class _Range(InputPartition):
    def __init__(self, path: str, start: int, rows: int):
        self.path, self.start, self.rows = path, start, rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.decimal = options.get("id", "long") == "decimal"
        self.range_rows = max(1, int(options.get("rangebytes", 128 << 20)) // ROW.itemsize)

    def partitions(self) -> list[_Range]:
        infer_n_rows(self.path)
        out = []
        for f in _files(self.path)[1]:
            n = f.size // ROW.itemsize
            out += [_Range(f.path, at, min(self.range_rows, n - at)) for at in range(0, n, self.range_rows)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        with _store(self.path)[0].open_input_file(partition.path) as f:
            f.seek(partition.start * ROW.itemsize)
            left = partition.rows
            while left:
                data = f.read(min(left, _STEP) * ROW.itemsize)
                rows = np.frombuffer(data, ROW)
                if not len(rows):
                    raise OSError(f"{partition.path} ended early")
                left -= len(rows)
                if self.decimal:
                    ids = pa.array([Decimal(int(i)) for i in rows["group_id"]], pa.decimal128(20, 0))
                else:
                    if (rows["group_id"] >> np.uint64(63)).any():
                        raise OverflowError("group ids above 2**63 - 1: read with option id=decimal")
                    ids = pa.array(rows["group_id"].astype("<i8"))
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows["value"].astype("<f8"))], names=["group_id", "value"])


class _Done(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, inner = _store(self.path)
        store.create_dir(inner, recursive=True)
        name = f"{inner}/_part-{context.partitionId():05d}-{context.taskAttemptId()}"
        with store.open_output_stream(name) as f:
            for batch in iterator:
                rows = np.empty(batch.num_rows, ROW)
                rows["group_id"] = np.array([int(i) for i in batch.column(0).to_pylist()], dtype="<u8")
                rows["value"] = batch.column(1).to_numpy(zero_copy_only=False)
                f.write(rows.tobytes())
        return _Done(name)

    def commit(self, messages: list) -> None:
        store, inner = _store(self.path)
        kept = {m.path for m in messages if m}
        for f in store.get_file_info(pafs.FileSelector(inner)):
            if f.path not in kept and (f.base_name.startswith("_part-") or self.overwrite and f.base_name.startswith("part-")):
                store.delete_file(f.path)
        for path in sorted(kept):
            folder, _, name = path.rpartition("/")
            store.move(path, f"{folder}/{name.removeprefix('_')}")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m:
                _store(self.path)[0].delete_file(m.path)


class Rows16(DataSource):
    """The Spark data source of the format."""

    @classmethod
    def name(cls) -> str:
        return "rows16"

    def schema(self) -> str:
        return "group_id decimal(20,0), value double" if self.options.get("id") == "decimal" else "group_id long, value double"

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Rows16)


def read_rows(spark: SparkSession, path: str, n_rows: int | None = None, ids: str = "long", range_bytes: int = 128 << 20) -> DataFrame:
    """The rows of a file or folder. ``n_rows``, if given, must be the number there: a part is never read by mistake."""
    there = infer_n_rows(path)
    if n_rows is not None and n_rows != there:
        raise ValueError(f"{path} has {there} rows, not {n_rows}")
    register(spark)
    return spark.read.format("rows16").option("id", ids).option("rangeBytes", str(range_bytes)).load(path)


def write_rows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(group_id, value) rows as part files in the folder ``path``."""
    register(df.sparkSession)
    df.select("group_id", df["value"].cast("double")).write.format("rows16").mode(mode).save(path)
