"""Readers and writers of .npy and .npz arrays as a Spark data source: format("foldsieve_npy").

Rows are (row_idx, vec) of a C-ordered 1-d or 2-d array, or of a folder of such
arrays, one after the other by file name. Arrays that lie uncompressed in their
file, archived or not, are read through a memory map in ranges of rows, one per
partition, so no task holds more than its range. A compressed member of an
archive can only be inflated from its start: it is one partition, inflated once,
in pieces. Members are named by the option "array"; arrays of objects are refused.

Writing gives a folder with one array per partition (part-00000.npy ...), or an
archive per partition where the option "array" names the member. The folder must
be one that all executors share.
"""

from __future__ import annotations

import os
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

ROWS_PER_PARTITION = 65536
PIECE = 4096


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _files(path: str) -> list[str]:
    path = _local(path)
    if not os.path.isdir(path):
        return [path]
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith((".npy", ".npz")))


class Member:
    """An array in a file: its type and shape, and where its values lie (None if compressed)."""

    def __init__(self, path: str, name: str | None):
        self.path, self.name, self.start = path, None, 0
        with open(path, "rb") as file:
            if zipfile.is_zipfile(path):
                archive = zipfile.ZipFile(file)
                entry = archive.getinfo(f"{name}.npy") if name else archive.infolist()[0]
                self.name = entry.filename
                if entry.compress_type == zipfile.ZIP_STORED:
                    # a local header: fixed part, then a name and extra fields of their own lengths
                    file.seek(entry.header_offset + 26)
                    self.start = entry.header_offset + 30 + sum(struct.unpack("<HH", file.read(4)))
                    self._header(file, self.start)
                else:
                    with archive.open(entry) as inside:
                        self._header(inside, 0)
                    self.start = None
            else:
                self._header(file, 0)

    def _header(self, file, at: int) -> None:
        file.seek(at)
        version = np.lib.format.read_magic(file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, order, self.dtype = read(file)
        if self.dtype.hasobject:
            raise ValueError("arrays of objects are refused")
        if order and len(self.shape) > 1:
            raise ValueError("only C-ordered arrays are read")
        self.data = file.tell()

    def rows(self, begin: int, end: int) -> Iterator[np.ndarray]:
        """Pieces of the rows from begin to end."""
        width = int(np.prod(self.shape[1:], dtype=np.int64))
        size = max(width * self.dtype.itemsize, 1)
        if self.start is not None:
            if end > begin:
                whole = np.memmap(self.path, self.dtype, "r", self.data, (self.shape[0], width))
                yield from (whole[at : min(at + PIECE, end)] for at in range(begin, end, PIECE))
            return
        with zipfile.ZipFile(self.path) as archive, archive.open(self.name) as file:
            file.read(self.data)
            for at in range(begin, end, PIECE):
                data = file.read(size * (min(at + PIECE, end) - at))
                yield np.frombuffer(data, self.dtype).reshape(-1, width)


class RowRange(InputPartition):
    def __init__(self, path: str, begin: int, end: int, first: int):
        self.path, self.begin, self.end, self.first = path, begin, end, first


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.name = options["path"], options.get("array")
        self.step = int(options.get("rowsperpartition", ROWS_PER_PARTITION))

    def partitions(self) -> list[InputPartition]:
        found, first = [], 0
        for path in _files(self.path):
            member = Member(path, self.name)
            n = member.shape[0] if member.shape else 0
            step = self.step if member.start is not None else max(n, 1)
            found += [RowRange(path, i, min(n, i + step), first) for i in range(0, n, step)]
            first += n
        return found or [RowRange("", 0, 0, 0)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        if partition.end == partition.begin:
            return
        at = partition.first + partition.begin
        member = Member(partition.path, self.name)
        text = member.dtype.kind in "US"
        for piece in member.rows(partition.begin, partition.end):
            for row in piece:
                yield at, [str(x) if text else float(x) for x in row]
                at += 1


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class MatrixWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.name = _local(options["path"]), options.get("array")
        self.dtype = np.dtype(options.get("dtype", "float64"))

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        values = [row["vec"] for row in rows]
        array = np.asarray(values, self.dtype) if values else np.zeros((0, 0), self.dtype)
        os.makedirs(self.folder, exist_ok=True)
        end = "npz" if self.name else "npy"
        # an attempt writes its own file; the driver names those that count
        path = os.path.join(self.folder, f"attempt-{task.partitionId():05d}-{task.taskAttemptId()}.{end}.tmp")
        with open(path, "wb") as file:
            if self.name:
                np.savez_compressed(file, **{self.name: array})
            else:
                np.save(file, array)
        return Written(path)

    def commit(self, messages: list[Written]) -> None:
        for m in messages:
            part, end = os.path.basename(m.path).split("-")[1], m.path.split(".")[-2]
            os.replace(m.path, os.path.join(self.folder, f"part-{part}.{end}"))

    def abort(self, messages: list[Written]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "foldsieve_npy"

    def schema(self) -> str:
        files = _files(self.options["path"])
        kind = Member(files[0], self.options.get("array")).dtype.kind if files else "f"
        return f"row_idx bigint, vec array<{'string' if kind in 'US' else 'double'}>"

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return MatrixWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixSource)
