"""A Spark data source for .npy arrays: one row an element (or a row of a matrix), with its place.

spark.dataSource.register(NpySource); spark.read.format("npy").option("dtype", "<u4").load(path). Versions 1
and 2, one or two dimensions, C order. Unsigned 64-bit values come as their signed bit pattern.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, LongType, StructField, StructType

KINDS: dict[str, DataType] = {"u": LongType(), "i": LongType(), "f": DoubleType()}


def header(data: bytes) -> tuple[np.dtype, tuple[int, ...], int]:
    """dtype, shape and the first byte of the elements; ValueError where the file isn't one we read."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    version = data[6]
    if version not in (1, 2):
        raise ValueError(f"npy version {version} is not read")
    size = 2 if version == 1 else 4
    (n,) = struct.unpack_from("<H" if size == 2 else "<I", data, 8)
    told = ast.literal_eval(data[8 + size : 8 + size + n].decode("latin-1"))
    if told["fortran_order"]:
        raise ValueError("Fortran order is not read")
    shape = tuple(told["shape"])
    if not 1 <= len(shape) <= 2:
        raise ValueError(f"{len(shape)} dimensions are not read")
    return np.dtype(told["descr"]), shape, 8 + size + n


def array(data: bytes, dtype: str | None = None, ndim: int | None = None) -> np.ndarray:
    """The array of a file's bytes, after its dtype, dimensions and length are checked."""
    kind, shape, at = header(data)
    if dtype is not None and kind != np.dtype(dtype):
        raise ValueError(f"dtype {kind.str}, not {dtype}")
    if ndim is not None and len(shape) != ndim:
        raise ValueError(f"{len(shape)} dimensions, not {ndim}")
    need = int(np.prod(shape)) * kind.itemsize
    if len(data) - at < need:
        raise ValueError("the file is cut short")
    return np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape)


class Slice(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__(None)
        self.start, self.end = start, end


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dtype, self.rows = options["path"].removeprefix("file:"), options.get("dtype"), int(options.get("rowsPerPartition", 1_000_000))

    def partitions(self) -> list[Slice]:
        with open(self.path, "rb") as f:
            _, shape, _ = header(f.read(70_000))
        return [Slice(i, min(i + self.rows, shape[0])) for i in range(0, shape[0], self.rows)] or [Slice(0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            kind, shape, at = header(f.read(70_000))
            if self.dtype and kind != np.dtype(self.dtype):
                raise ValueError(f"dtype {kind.str}, not {self.dtype}")
            width = int(np.prod(shape[1:])) if len(shape) > 1 else 1
            f.seek(at + partition.start * width * kind.itemsize)
            n = (partition.end - partition.start) * width
            data = f.read(n * kind.itemsize)
        if len(data) < n * kind.itemsize:
            raise ValueError("the file is cut short")
        values = np.frombuffer(data, kind, n).reshape(-1, *shape[1:])
        values = values.view(np.int64) if kind == np.uint64 else values.astype(np.float64 if kind.kind == "f" else np.int64)
        for i, v in enumerate(values.tolist(), partition.start):
            yield i, v


class NpySource(DataSource):
    """Options: path, dtype (checked if given), rowsPerPartition. The path is one that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> StructType:
        with open(self.options["path"].removeprefix("file:"), "rb") as f:
            kind, shape, _ = header(f.read(70_000))
        value = KINDS[kind.kind]
        return StructType([StructField("pos", LongType()), StructField("value", ArrayType(FloatType() if kind.kind == "f" else value) if len(shape) > 1 else value)])

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options)
