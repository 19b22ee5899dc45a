"""The MDA array format as a Spark data source, and conversions between raw and MDA files.

A file has int32 words (type code, bytes per entry, number of dimensions, the dimensions) and then the
values, first dimension fastest. ``spark.read.format("mda")`` gives one row per value of a two-dimensional
reading of the file: channel (first dimension, from 1), t (all others run together, from 0), value. Ranges
of t are separate partitions, so a large file is read in parallel without a shuffle.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the format: type code and numpy type.
TYPES = {-2: "u1", -3: "<f4", -4: "<i2", -5: "<i4", -6: "<u2", -7: "<f8", -8: "<u4"}
NAMES = {"uint8": -2, "float32": -3, "int16": -4, "int32": -5, "uint16": -6, "float64": -7, "uint32": -8}
MAX_DIMS = 50
PART = 1 << 20  # values of a partition


def read_header(raw: bytes) -> tuple[int, tuple[int, ...], int]:
    """(type code, dimensions, length of the header in bytes). A negative number of dimensions means that
    they are 64-bit."""
    code, _, n = struct.unpack_from("<3i", raw)
    if code not in TYPES:
        raise ValueError(f"no such type code: {code}")
    wide = n < 0
    n = abs(n)
    if not 1 <= n <= MAX_DIMS:
        raise ValueError(f"no such number of dimensions: {n}")
    dims = struct.unpack_from(f"<{n}{'q' if wide else 'i'}", raw, 12)
    return code, dims, 12 + n * (8 if wide else 4)


def header(code: int, dims: tuple[int, ...]) -> bytes:
    wide = any(d > 2**31 - 1 for d in dims)
    n = len(dims)
    return struct.pack(f"<3i{n}{'q' if wide else 'i'}", code, np.dtype(TYPES[code]).itemsize, -n if wide else n, *dims)


def read_array(path: str) -> np.ndarray:
    """A whole file as an array with the format's index order; for files that fit into memory."""
    with open(path, "rb") as f:
        raw = f.read()
    code, dims, at = read_header(raw)
    return np.frombuffer(raw, TYPES[code], int(np.prod(dims)), at).reshape(dims, order="F")


def write_array(path: str, x: np.ndarray, kind: str = "float64") -> None:
    """Written beside the target and renamed, so that no reader sees half a file."""
    with open(f"{path}.tmp", "wb") as f:
        f.write(header(NAMES[kind], x.shape))
        f.write(np.asarray(x, TYPES[NAMES[kind]]).tobytes(order="F"))
    os.replace(f"{path}.tmp", path)


def convert_raw(raw_path: str, mda_path: str, kind: str, dims: tuple[int, ...]) -> None:
    """A file of bare values to MDA. One dimension may be 0: it follows from the size."""
    size = os.path.getsize(raw_path) // np.dtype(TYPES[NAMES[kind]]).itemsize
    known = int(np.prod([d for d in dims if d])) or 1
    dims = tuple(d or size // known for d in dims)
    if int(np.prod(dims)) != size:
        raise ValueError(f"{size} values do not fill {dims}")
    with open(raw_path, "rb") as source, open(f"{mda_path}.tmp", "wb") as f:
        f.write(header(NAMES[kind], dims))
        while block := source.read(1 << 24):
            f.write(block)
    os.replace(f"{mda_path}.tmp", mda_path)


def convert_type(path: str, out: str, kind: str) -> None:
    """Another type of value, in blocks."""
    with open(path, "rb") as source, open(f"{out}.tmp", "wb") as f:
        code, dims, at = read_header(source.read(12 + 8 * MAX_DIMS))
        source.seek(at)
        f.write(header(NAMES[kind], dims))
        width = np.dtype(TYPES[code]).itemsize
        while block := source.read(width << 20):
            f.write(np.frombuffer(block, TYPES[code]).astype(TYPES[NAMES[kind]]).tobytes())
    os.replace(f"{out}.tmp", out)


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            self.code, self.dims, self.at = read_header(f.read(12 + 8 * MAX_DIMS))
        self.rows = self.dims[0]
        self.columns = int(np.prod(self.dims[1:])) if len(self.dims) > 1 else 1

    def partitions(self) -> list[InputPartition]:
        step = max(1, PART // max(1, self.rows))
        return [_Range(a, min(a + step, self.columns)) for a in range(0, self.columns, step)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(TYPES[self.code])
        with open(self.path, "rb") as f:
            f.seek(self.at + part.start * self.rows * kind.itemsize)
            x = np.frombuffer(f.read((part.end - part.start) * self.rows * kind.itemsize), kind)
        channel = np.tile(np.arange(1, self.rows + 1, dtype=np.int32), part.end - part.start)
        t = np.repeat(np.arange(part.start, part.end, dtype=np.int64), self.rows)
        yield pa.RecordBatch.from_arrays([pa.array(channel), pa.array(t), pa.array(x.astype(np.float64))], names=["channel", "t", "value"])


class _Part(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class _Writer(DataSourceWriter):
    """Tasks write their values as (place, value) files beside the target; the commit lays them out in one
    memory-mapped file and renames it. Values that no row gives are zero."""

    def __init__(self, path: str, kind: str, channels: int, samples: int):
        self.path, self.kind, self.channels, self.samples = path, kind, channels, samples

    def write(self, rows) -> _Part:
        place, value = [], []
        for r in rows:
            place.append((r["channel"] - 1) + self.channels * r["t"])
            value.append(r["value"])
        if not place:
            return _Part(None)
        name = f"{self.path}.part-{os.urandom(8).hex()}.npz"
        np.savez(name, place=np.array(place, np.int64), value=np.array(value, np.float64))
        return _Part(name)

    def commit(self, messages) -> None:
        head = header(NAMES[self.kind], (self.channels, self.samples))
        with open(f"{self.path}.tmp", "wb") as f:
            f.write(head)
            f.truncate(len(head) + self.channels * self.samples * np.dtype(TYPES[NAMES[self.kind]]).itemsize)
        if self.channels * self.samples:
            out = np.memmap(f"{self.path}.tmp", TYPES[NAMES[self.kind]], "r+", len(head), (self.channels * self.samples,))
            for m in messages:
                if m is not None and m.name:
                    with np.load(m.name) as part:
                        out[part["place"]] = part["value"].astype(out.dtype)
            out.flush()
        os.replace(f"{self.path}.tmp", self.path)
        self._clear(messages)

    def abort(self, messages) -> None:
        self._clear(messages)

    @staticmethod
    def _clear(messages) -> None:
        for m in messages:
            if m is not None and m.name and os.path.exists(m.name):
                os.remove(m.name)


class MdaSource(DataSource):
    """Options of a writer: kind (float64), channels, samples."""

    @classmethod
    def name(cls) -> str:
        return "mda"

    def schema(self) -> str:
        return "channel int, t bigint, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("kind", "float64"), int(self.options["channels"]), int(self.options["samples"]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MdaSource)


def write_mda(df: DataFrame, path: str, channels: int, samples: int, kind: str = "float64") -> None:
    df.select("channel", "t", "value").write.format("mda").option("kind", kind).option("channels", channels).option("samples", samples).mode("append").save(path)
