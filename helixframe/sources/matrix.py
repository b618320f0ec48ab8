"""NumPy files as tables, read by ranges of rows in tasks.

``read_matrix`` gives (file, row, value) of a ``.npy`` file, of a folder of them, or of one member of a ``.npz`` archive: value is an
array for matrices and a single value for vectors. The driver reads headers only; a task reads the bytes of its own rows, a few
megabytes at a time, so a file may be larger than any machine's memory. Files are opened by their URI (``file``, ``hdfs``,
``s3``, ``gs``; a plain path is one that driver and tasks share).

Cases: rows stored column by column are read by one range a column; members that are compressed cannot be entered in the middle,
so one task streams each of them by rows (one stored column by column raises ValueError); empty matrices give no rows; NaN and
infinite values are kept; arrays of objects, of complex numbers, without a dimension or with more than two raise ValueError, and
so do files of one folder that differ in type or width and files that end early.
"""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

#: Bytes of rows that a task reads, and that it holds at a time.
SPLIT_BYTES, STEP_BYTES = 32 << 20, 4 << 20

#: Column type of a NumPy kind and width; unsigned numbers take the next wider one.
TYPES = {"f2": "float", "f4": "float", "f8": "double", "i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "long", "i8": "long", "b1": "boolean"}
_ARROW = {"float": pa.float32(), "double": pa.float64(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


@dataclass
class Header:
    """Where a matrix lies in its file: ``start`` is its first byte, or None where the bytes are compressed."""

    file: str
    member: str | None
    start: int | None
    rows: int
    width: int | None
    dtype: str
    by_column: bool

    @property
    def kind(self) -> str:
        d = np.dtype(self.dtype)
        return "string" if d.kind == "U" else TYPES[f"{d.kind}{d.itemsize}"]

    @property
    def row_bytes(self) -> int:
        return max(1, np.dtype(self.dtype).itemsize * (1 if self.width is None else self.width))


@dataclass
class Rows(InputPartition):
    header: Header
    first: int
    last: int


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else str(Path(path).absolute()))


def _files(path: str) -> list[str]:
    system, at = _filesystem(path)
    if system.get_file_info(at).type != pafs.FileType.Directory:
        return [path]
    base = path.rstrip("/")
    found = [i.base_name for i in system.get_file_info(pafs.FileSelector(at)) if i.base_name.endswith(".npy")]
    return [f"{base}/{name}" for name in sorted(found)]


def _layout(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)


@contextmanager
def _member(f, name: str):
    with zipfile.ZipFile(f) as z:
        if f"{name}.npy" not in z.namelist():
            raise ValueError(f"no member {name!r}; known: {', '.join(sorted(n.removesuffix('.npy') for n in z.namelist()))}")
        info = z.getinfo(f"{name}.npy")
        with z.open(info) as m:
            yield info, m


def header(file: str, member: str | None = None) -> Header:
    """The shape, type and place of one file's matrix."""
    system, at = _filesystem(file)
    with system.open_input_file(at) as f:
        if member is None:
            shape, by_column, dtype = _layout(f)
            start = f.tell()
        else:
            with _member(f, member) as (info, m):
                shape, by_column, dtype = _layout(m)
                inside = m.tell()
            start = None
            if info.compress_type == zipfile.ZIP_STORED:
                f.seek(info.header_offset + 26)
                start = info.header_offset + 30 + sum(struct.unpack("<HH", f.read(4))) + inside
    if len(shape) not in (1, 2) or dtype.kind != "U" and f"{dtype.kind}{dtype.itemsize}" not in TYPES:
        raise ValueError(f"{file}: an array of shape {shape} and type {dtype} cannot be read as rows")
    return Header(file, member, start, shape[0], shape[1] if len(shape) == 2 else None, dtype.str, by_column and len(shape) == 2)


def _exactly(f, n: int) -> bytes:
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"the file ends {n - len(got)} bytes early")
    return got


def _blocks(part: Rows) -> Iterator[tuple[int, np.ndarray]]:
    """First row and values of successive blocks of a partition's rows."""
    h = part.header
    dtype, step = np.dtype(h.dtype), max(1, STEP_BYTES // h.row_bytes)

    def take(f, n: int) -> np.ndarray:
        shape = (n,) if h.width is None else (n, h.width)
        return np.ndarray(shape, dtype, _exactly(f, int(np.prod(shape)) * dtype.itemsize))

    system, at = _filesystem(h.file)
    with system.open_input_file(at) as f:
        if h.start is None:
            with _member(f, h.member) as (_, m):
                _layout(m)
                if h.by_column:
                    raise ValueError(f"{h.file}: rows stored column by column cannot be streamed from a compressed member")
                for a in range(0, h.rows, step):
                    n = min(step, h.rows - a)
                    yield a, take(m, n)
            return
        for a in range(part.first, part.last, step):
            n = min(step, part.last - a)
            if h.by_column:
                columns = []
                for c in range(h.width):
                    f.seek(h.start + (c * h.rows + a) * dtype.itemsize)
                    columns.append(np.frombuffer(_exactly(f, n * dtype.itemsize), dtype))
                yield a, np.stack(columns, axis=1) if columns else np.zeros((n, 0), dtype)
            else:
                f.seek(h.start + a * h.row_bytes)
                yield a, take(f, n)


class MatrixReader(DataSourceReader):
    def __init__(self, headers: list[Header], split_bytes: int):
        self.headers, self.split_bytes = headers, split_bytes

    def partitions(self) -> list[Rows]:
        out = []
        for h in self.headers:
            step = max(1, self.split_bytes // h.row_bytes) if h.start is not None else max(1, h.rows)
            out += [Rows(h, a, min(a + step, h.rows)) for a in range(0, h.rows, step)]
        return out or [Rows(h, 0, 0) for h in self.headers[:1]]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        h = partition.header
        for first, block in _blocks(partition):
            n = len(block)
            flat = block.reshape(-1)
            plain = flat.tolist() if h.kind == "string" else flat.astype(_ARROW[h.kind].to_pandas_dtype())
            values = pa.array(plain, _ARROW[h.kind])
            if h.width is not None:
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h.width, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([pa.array([h.file] * n, pa.string()), pa.array(np.arange(first, first + n, dtype=np.int64)), values], names=["file", "row", "value"])


class MatrixSource(DataSource):
    """The format ``npy``: options ``path``, ``member`` (of a ``.npz``) and ``splitbytes``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _headers(self) -> list[Header]:
        out = [header(f, self.options.get("member")) for f in _files(self.options["path"])]
        if len({(h.kind, h.width) for h in out}) > 1:
            raise ValueError(f"{self.options['path']}: files differ in type or width")
        if not out:
            raise ValueError(f"{self.options['path']}: no .npy files")
        return out

    def schema(self) -> str:
        h = self._headers()[0]
        return f"file string, row long, value {h.kind if h.width is None else f'array<{h.kind}>'}"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self._headers(), int(self.options.get("splitbytes", SPLIT_BYTES)))


def read_matrix(spark: SparkSession, path: str, member: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, row, value) of a NumPy file, of a folder of ``.npy`` files, or of a ``.npz`` archive's ``member``."""
    ship(spark)
    spark.dataSource.register(MatrixSource)
    reader = spark.read.format("npy").option("splitbytes", str(split_bytes))
    return (reader if member is None else reader.option("member", member)).load(path)
