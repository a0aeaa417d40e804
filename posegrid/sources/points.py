"""Points v1: a 44-byte header and one 26-byte record per point.

Read either with the data source `points_v1` (byte ranges become partitions, any
record is reached by its offset) or from a binary column. Input order is kept,
identifiers are unsigned 64-bit numbers (decimal(20,0)), and integers wrap silently when
written. Bytes after the last record are ignored; the box in the header is not
checked against the points. The data source takes paths and URIs of any file system
that Arrow knows.
"""

from __future__ import annotations

import itertools
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the format.
MAGIC = b"SFMP3D\0\0"
HEADER_SIZE, RECORD_SIZE, VERSION = 44, 26, 1
HEADER_FORMAT = "<8sIQffffff"
RECORD = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("pad", "u1"), ("track_len", "<u2"), ("point3d_id", "<u8")])

SCHEMA = "point3d_id decimal(20,0), x float, y float, z float, r short, g short, b short, track_len int"
READ_ROWS = 65_536


class PointsError(ValueError):
    """A blob that is no points file."""


def read_header(data: bytes) -> tuple[int, tuple[float, ...], tuple[float, ...]]:
    """Count and bounding box of a header."""
    if len(data) < HEADER_SIZE:
        raise PointsError("PTS.short_header: buffer too small for header")
    magic, version, count, *box = struct.unpack(HEADER_FORMAT, data[:HEADER_SIZE])
    if magic != MAGIC:
        raise PointsError("PTS.magic: bad magic")
    if version != VERSION:
        raise PointsError(f"PTS.version: unknown version {version}")
    return count, tuple(box[:3]), tuple(box[3:])


def header(count: int, low: tuple[float, ...], high: tuple[float, ...]) -> bytes:
    return struct.pack(HEADER_FORMAT, MAGIC, VERSION, count, *low, *high)


def records(data: bytes) -> np.ndarray:
    """All records of a blob, without a copy."""
    count, _, _ = read_header(data)
    if len(data) - HEADER_SIZE < count * RECORD_SIZE:
        raise PointsError("PTS.too_small_records: buffer too small for records")
    return np.frombuffer(data, dtype=RECORD, offset=HEADER_SIZE, count=count)


def _batch(rows: np.ndarray) -> pa.RecordBatch:
    ids = pa.array(np.ascontiguousarray(rows["point3d_id"])).cast(pa.decimal128(20, 0))
    floats = [pa.array(np.ascontiguousarray(rows[c])) for c in "xyz"]
    bytes_ = [pa.array(rows[c].astype(np.int16)) for c in "rgb"]
    return pa.RecordBatch.from_arrays([ids, *floats, *bytes_, pa.array(rows["track_len"].astype(np.int32))], names=["point3d_id", "x", "y", "z", "r", "g", "b", "track_len"])


def _packed(batch: pa.RecordBatch) -> np.ndarray:
    """Records of rows; wraps integers to their field's width."""
    out = np.zeros(batch.num_rows, dtype=RECORD)
    for c in "xyz":
        out[c] = batch.column(c).to_numpy(zero_copy_only=False)
    for c in "rgb":
        out[c] = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) & 0xFF
    out["track_len"] = batch.column("track_len").to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFF
    out["point3d_id"] = np.array([int(v) & 0xFFFFFFFFFFFFFFFF for v in batch.column("point3d_id").to_pylist()], dtype=np.uint64)
    return out


def decode(df: DataFrame, content: str = "content", *keys: str) -> DataFrame:
    """Points of a binary column: keys, pos (place in its blob) and the fields."""
    keep = df.select(*keys).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "pos long", SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = records(batch.column(content)[k].as_py() or b"")
                for a in range(0, len(rows), READ_ROWS):
                    part = _batch(rows[a : a + READ_ROWS])
                    same = [pa.array([batch.column(f.name)[k].as_py()] * part.num_rows, type=batch.schema.field(f.name).type) for f in keep]
                    pos = pa.array(np.arange(a, a + part.num_rows))
                    yield pa.RecordBatch.from_arrays([*same, pos, *part.columns], names=[*keep.names, "pos", *part.schema.names])

    return df.select(*keys, content).mapInArrow(run, schema)


def encode(df: DataFrame, key: str, order: str) -> DataFrame:
    """One blob per key value, in ascending `order`, with the box of its points: key, content.

    One blob is one value, so its points must fit a task; the data source has no such bound.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order).combine_chunks()
        rows = _packed(table.to_batches()[0])
        low, high = [tuple(float(f(rows[c])) for c in "xyz") for f in (np.min, np.max)]
        return pa.table({key: table.column(key).slice(0, 1), "content": pa.array([header(len(rows), low, high) + rows.tobytes()], type=pa.binary())})

    return df.groupBy(key).applyInArrow(run, f"`{key}` {kind}, content binary")


def blob_size(n: Column) -> Column:
    """Bytes of a blob of n points."""
    return F.lit(HEADER_SIZE).cast("long") + F.lit(RECORD_SIZE).cast("long") * n


def wrap_unsigned(x: Column, bits: int) -> Column:
    """The value that an unsigned field of so many bits keeps."""
    if bits == 64:
        return F.pmod(x.cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)")).cast("decimal(20,0)")
    return x.cast("long").bitwiseAND(F.lit((1 << bits) - 1))


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, one that drivers and executors share, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.rstrip("/") or "/"


def _points_files(files: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    infos = files.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted((i for i in infos if i.path.endswith(".points")), key=lambda i: i.path)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("recordsperpartition", 1_000_000))

    def partitions(self) -> list[InputPartition]:
        """Byte ranges of the file, or of every *.points file of a folder, by headers alone."""
        files, path = _store(self.path)
        found = [files.get_file_info(path)] if files.get_file_info(path).type == pafs.FileType.File else _points_files(files, path)
        out: list[InputPartition] = []
        for info in found:
            with files.open_input_file(info.path) as f:
                count, _, _ = read_header(f.read(HEADER_SIZE))
            if info.size - HEADER_SIZE < count * RECORD_SIZE:
                raise PointsError("PTS.too_small_records: buffer too small for records")
            out += [_Range(info.path, a, min(a + self.step, count)) for a in range(0, count, self.step)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with _store(self.path)[0].open_input_file(partition.path) as f:
            f.seek(HEADER_SIZE + RECORD_SIZE * partition.start)
            left = partition.stop - partition.start
            while left:
                n = min(left, READ_ROWS)
                yield _batch(np.frombuffer(f.read(n * RECORD_SIZE), dtype=RECORD))
                left -= n


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class _Writer(DataSourceWriter):
    """Each task attempt writes its rows as a points file of its own, with its own count and box.

    Names begin with `_` and hold the job's and the attempt's id until the commit gives
    the files of the winning attempts their names; only then do the old files go.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.job, self.overwrite = options["path"], uuid.uuid4().hex[:8], overwrite
        files, path = _store(self.path)
        files.create_dir(path, recursive=True)
        if not overwrite and _points_files(files, path):
            raise PointsError(f"{self.path} already holds points")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        files, path = _store(self.path)
        task = TaskContext.get()
        target = f"{path}/_{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}"
        count, low, high = 0, np.full(3, np.inf), np.full(3, -np.inf)
        with tempfile.TemporaryFile() as body:  # this task's own scratch: the header comes first but is known last
            while batch := list(itertools.islice(rows, READ_ROWS)):
                count, low, high = self._flush(body, [r.asDict() for r in batch], count, low, high)
            if not count:
                return _Written(None)
            body.seek(0)
            with files.open_output_stream(target) as f:
                f.write(header(count, tuple(low), tuple(high)))
                while piece := body.read(1 << 20):
                    f.write(piece)
        return _Written(target)

    @staticmethod
    def _flush(f, batch: list, count: int, low: np.ndarray, high: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        rows = _packed(pa.RecordBatch.from_pylist(batch))
        f.write(rows.tobytes())
        xyz = np.stack([rows[c] for c in "xyz"])
        return count + len(rows), np.minimum(low, xyz.min(axis=1)), np.maximum(high, xyz.max(axis=1))

    def commit(self, messages: list) -> None:
        files, path = _store(self.path)
        old = [i.path for i in _points_files(files, path)] if self.overwrite else []
        for m in messages:
            if m is not None and m.path:
                part = m.path.rsplit("-", 2)[1]
                files.move(m.path, f"{path}/part-{part}-{self.job}.points")
        for name in old:
            files.delete_file(name)
        self._sweep(files, path)

    def abort(self, messages: list) -> None:
        self._sweep(*_store(self.path))

    def _sweep(self, files: pafs.FileSystem, path: str) -> None:
        """Drop what lost and failed attempts of this job have left."""
        for info in files.get_file_info(pafs.FileSelector(path)):
            if info.base_name.startswith(f"_{self.job}-"):
                files.delete_file(info.path)


class PointsDataSource(DataSource):
    """spark.dataSource.register(PointsDataSource); then format("points_v1")."""

    @classmethod
    def name(cls) -> str:
        return "points_v1"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)
