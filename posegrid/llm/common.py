"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one made here if that is unset.

    The fallback is machine-local and therefore only for a local master, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="posegrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Workspace:
    """Tables written to the shared folder to cut lineage; lost executors only cause rereads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/posegrid-{uuid.uuid4().hex}"
        self.written: list[str] = []
        self.made = 0

    def save(self, df: DataFrame, name: str, *spent: DataFrame) -> DataFrame:
        """Write df as Parquet once and return the reread table; then delete the saved tables that the `spent` ones read."""
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.parquet(path)
        if spent:
            files = {f for old in spent for f in old.inputFiles()}
            self._delete([p for p in self.written if any(self._tail(p) in f for f in files)])
        self.written.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keep: DataFrame) -> None:
        """Delete every table that none of the kept DataFrames reads."""
        used = {f for df in keep for f in df.inputFiles()}
        self._delete([p for p in self.written if not any(self._tail(p) in f for f in used)])

    @staticmethod
    def _tail(path: str) -> str:
        return "/".join(path.rsplit("/", 2)[-2:]) + "/"

    def _delete(self, paths: list[str]) -> None:
        for path in paths:
            _remove(self.spark, path)
            self.written.remove(path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Delete the workspace tables that df reads, whichever operator wrote them; df must not be used any more."""
    found = (re.match(r"(.*/posegrid-[0-9a-f]{32}/\d{3}-[^/]*)/", f) for f in df.inputFiles())
    for path in {m.group(1) for m in found if m}:
        _remove(df.sparkSession, path)


def unused(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows of at most `most` bytes together; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that `column` has at most `most` bytes in each, or one row."""
    for batch in batches:
        if batch.num_rows:
            _, offsets = text_bytes(batch.column(column))
            for a, b in slices(offsets, most):
                yield batch.slice(a, b - a)


def give_back() -> None:
    """Return freed memory of this process, Arrow's and that of malloc, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches, which gives freed memory back when its partition ends.

    Worker processes live on from task to task and would else keep the largest size they had.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied
