"""Data sources that read binary files by range: raw videos and NumPy arrays of any size.

The driver lists files and reads headers only; a partition is a range of one file's rows, and a task
reads these bytes and no others. Files may lie wherever Arrow opens them (local folders,
HDFS, S3, GCS).
"""

from __future__ import annotations

import ast
import fnmatch
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a partition, and of a batch within it.
RANGE, BATCH = 64 << 20, 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file system and the files of a file, a folder or a pattern of names in a folder, in order;
    hidden files are left out."""
    folder, _, pattern = path.rpartition("/")
    if "*" in pattern:
        system, folder = fs.FileSystem.from_uri(folder)
    else:
        system, folder = fs.FileSystem.from_uri(path)
        info = system.get_file_info(folder)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            return system, [info]
        pattern = "*"
    files = [f for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File]
    return system, sorted((f for f in files if fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._"), key=lambda f: f.path)


@dataclass
class Rows(InputPartition):
    """Rows first to below last of a file or of an archive's member."""

    path: str
    file: str
    first: int
    last: int
    member: str | None = None


class RangeReader(DataSourceReader):
    """Narrows the rows that are read by comparisons of the row number with constants."""

    number = "frame"

    def __init__(self, options: dict):
        self.path = options["path"]
        self.range = int(options.get("range", RANGE))
        self.low, self.high = 0, None

    def pushFilters(self, filters):
        for f in filters:
            compared = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == (self.number,)
            if not compared or not isinstance(f.value, int):
                yield f
                continue
            at = f.value
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.low = max(self.low, at + isinstance(f, GreaterThan))
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                end = at + (not isinstance(f, LessThan))
                self.high = end if self.high is None else min(self.high, end)

    def ranges(self, path: str, file: str, rows: int, size: int, member: str | None = None, start: int = 0, whole: bool = False) -> Iterator[Rows]:
        """Partitions of `rows` rows of `size` bytes that are numbered from `start`."""
        first, last = max(0, self.low - start), rows if self.high is None else min(rows, self.high - start)
        step = max(1, last - first if whole else self.range // max(1, size))
        for at in range(first, last, step):
            yield Rows(path, file, at, min(last, at + step), member)


class FrameReader(RangeReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.size = int(options.get("width", 2048)) * int(options.get("height", 2048))

    def partitions(self) -> list[Rows]:
        out = []
        for info in opened(self.path)[1]:
            if info.size < self.size:
                raise ValueError(f"less than one frame: {info.path}")
            out += self.ranges(info.path, info.base_name, info.size // self.size, self.size)
        return out

    def read(self, part: Rows):
        if part is None:
            return
        system = opened(self.path)[0]
        step = max(1, BATCH // self.size)
        with system.open_input_file(part.path) as source:
            source.seek(part.first * self.size)
            for at in range(part.first, part.last, step):
                frames = list(range(at, min(at + step, part.last)))
                pixels = [source.read(self.size) for _ in frames]
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(frames)), pa.array(frames, pa.int64()), pa.array(pixels, pa.binary())], ["file", "frame", "pixels"])


class Frames(DataSource):
    """Raw 8-bit videos, a row a frame: options width, height and range (bytes of a partition). What is left
    over behind the last whole frame is dropped; a file under one frame is an error."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "file string, frame long, pixels binary"

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options)


@dataclass
class Header:
    """What an array's header says; offset is where its data begins."""

    shape: tuple[int, ...]
    dtype: np.dtype
    fortran: bool
    offset: int


def npy_header(source) -> Header:
    """The header at the source's position: plain literals, which are parsed as such."""
    magic = source.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("no NumPy array")
    wide = magic[6] >= 2
    length = struct.unpack("<I" if wide else "<H", source.read(4 if wide else 2))[0]
    said = ast.literal_eval(source.read(length).decode("utf-8" if magic[6] >= 3 else "latin-1"))
    dtype = np.dtype(said["descr"])
    if dtype.hasobject:
        raise ValueError("arrays of pickled objects are not read")
    return Header(tuple(said["shape"]), dtype, said["fortran_order"], 8 + (4 if wide else 2) + length)


def _member(source, name: str | None) -> tuple[int, bool]:
    """Where the data of an archive's member begin, and whether they are compressed."""
    with zipfile.ZipFile(source) as archive:
        names = archive.namelist()
        info = archive.getinfo(f"{name}.npy" if name else names[0])
        if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"compression {info.compress_type} is not read")
    source.seek(info.header_offset)
    local = source.read(30)
    name_length, extra = struct.unpack("<HH", local[26:30])
    return info.header_offset + 30 + name_length + extra, info.compress_type == zipfile.ZIP_DEFLATED


class _Inflated(io.RawIOBase):
    """A compressed member as a stream, in memory of a bounded size."""

    def __init__(self, source, start: int):
        source.seek(start)
        self.source, self.inflate, self.left = source, zlib.decompressobj(-15), b""

    def read(self, n: int = -1) -> bytes:
        parts, have = [], 0
        while have < n and not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.source.read(1 << 16)
            parts.append(self.inflate.decompress(data, n - have))
            have += len(parts[-1])
            if not data and not parts[-1]:
                break
        return b"".join(parts)


class ArrayReader(RangeReader):
    """Rows along the first axis or, with axis 1, columns of a matrix as rows."""

    number = "at"

    def __init__(self, options: dict):
        super().__init__(options)
        self.key, self.axis, self.bytes = options.get("key"), int(options.get("axis", 0)), options.get("values", "doubles") == "bytes"

    def open(self, source, path: str) -> tuple[object, Header, bool]:
        """The stream behind the header, the header (offset in the file, if not compressed) and whether it is compressed."""
        start, compressed = _member(source, self.key) if path.endswith(".npz") else (0, False)
        stream = _Inflated(source, start) if compressed else source
        if not compressed:
            source.seek(start)
        header = npy_header(stream)
        header.offset += start
        if header.fortran and len(header.shape) > 2 or self.axis and len(header.shape) != 2:
            raise ValueError(f"an array of shape {header.shape} in this order is not read by range: {path}")
        return stream, header, compressed

    def layout(self, header: Header) -> tuple[int, int, bool]:
        """Rows, their values, and whether a row's values lie side by side."""
        shape = header.shape or (1,)
        count = int(np.prod(shape[1:], dtype=np.int64))
        if self.axis == 1:
            return shape[1], shape[0], header.fortran
        return shape[0], count, not header.fortran or len(shape) == 1

    def partitions(self) -> list[Rows]:
        out, (system, files) = [], opened(self.path)
        for info in files:
            with system.open_input_file(info.path) as source:
                _, header, compressed = self.open(source, info.path)
            rows, values, _ = self.layout(header)
            out += self.ranges(info.path, info.base_name, rows, values * header.dtype.itemsize, self.key, whole=compressed)
        return out

    def blocks(self, stream, header: Header, compressed: bool, part: Rows) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, rows) of at most BATCH bytes each, if one row is not larger."""
        rows, values, together = self.layout(header)
        width = values * header.dtype.itemsize
        step = max(1, BATCH // max(1, width))
        if together:
            if compressed:
                for _ in range(part.first):
                    stream.read(width)
            else:
                stream.seek(header.offset + part.first * width)
            for at in range(part.first, part.last, step):
                n = min(step, part.last - at)
                yield at, np.frombuffer(stream.read(n * width), header.dtype).reshape(n, values)
            return
        if compressed:
            # The values of a row are spread over the stream: all of it passes, only the part is kept.
            line = rows * header.dtype.itemsize
            kept = [np.frombuffer(stream.read(line), header.dtype)[part.first : part.last] for _ in range(values)]
            yield part.first, np.stack(kept, 1)
            return
        for at in range(part.first, part.last, step):
            n, lines = min(step, part.last - at), []
            for k in range(values):
                stream.seek(header.offset + (k * rows + at) * header.dtype.itemsize)
                lines.append(np.frombuffer(stream.read(n * header.dtype.itemsize), header.dtype))
            yield at, np.stack(lines, 1)

    def read(self, part: Rows):
        if part is None:
            return
        with opened(self.path)[0].open_input_file(part.path) as source:
            stream, header, compressed = self.open(source, part.path)
            shape = [int(n) for n in (header.shape[1:] if self.axis == 0 else header.shape[:1])]
            for at, rows in self.blocks(stream, header, compressed, part):
                if self.bytes:
                    values = pa.array([r.tobytes() for r in (rows > 0).astype(np.uint8)], pa.binary())
                else:
                    values = pa.array(list(rows.astype(float)), pa.list_(pa.float64()))
                n = len(rows)
                columns = [pa.array([part.file] * n), pa.array(np.arange(at, at + n), pa.int64()), pa.array([shape] * n, pa.list_(pa.int32())), values]
                yield pa.RecordBatch.from_arrays(columns, ["file", "at", "shape", "values"])


class Arrays(DataSource):
    """NumPy files (.npy, or a member of .npz), a row for each entry of an axis: file, at, shape (of an
    entry) and values, as doubles or, with values "bytes", one byte each that tells whether it is over 0.
    Options: key (the member; else the first), axis (0, or 1 for the columns of a matrix), range.
    A compressed member is one partition and passes through its task as a stream."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return f"file string, at long, shape array<int>, values {'binary' if self.options.get('values') == 'bytes' else 'array<double>'}"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options)


def registered(spark: SparkSession):
    """spark.read, after the sources are known to the session and may take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Frames, Arrays):
        spark.dataSource.register(source)
    return spark.read
