"""Helpers that the training-data operators share.

Executors and driver share no local folder, so files that outlive a task go to
the folder named by ``spark.checkpoint.dir`` and are reached through
``pyarrow.fs`` (any scheme it knows; ``file`` included).
"""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the white space that separates words, [\x20\x09-\x0D].
WHITE = " \t\n\r\x0b\x0c"
#: Arrow batches are cut into pieces of about so many text bytes before Python
#: objects are made of them.
SLICE_BYTES = 2 << 20

_dirs: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh URI below the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base if "://" in base else f"file://{base}"
    uri = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _dirs.append(uri)
    return uri


@atexit.register
def _clean() -> None:
    while _dirs:
        drop_dir(_dirs.pop())


def drop_dir(uri: str) -> None:
    """Delete a folder made by ``shared_dir``; it may be gone already."""
    with suppress(Exception):
        fs, path = filesystem(uri)
        fs.delete_dir(path)


def run_key() -> int:
    """A secret 64-bit key of hashes, drawn on the driver for one run."""
    return int.from_bytes(os.urandom(8), "little")


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as keep it apart from
    ``columns`` (whatever the case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    what follows survives the loss of any executor."""
    uri = shared_dir(df.sparkSession, name) + "/table"
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


class Scratch:
    """Tables of one operator's run below one folder, to be dropped together
    once its result is stored."""

    def __init__(self, spark: SparkSession, name: str):
        self.uri, self.n = shared_dir(spark, name), 0

    def stored(self, df: DataFrame, name: str = "") -> DataFrame:
        self.n += 1
        name = name or str(self.n)
        df.write.parquet(f"{self.uri}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.uri}/{name}")

    def free(self, name: str) -> None:
        """Drop one table by its name, once nothing reads it any more."""
        drop_dir(f"{self.uri}/{name}")

    def drop(self) -> None:
        drop_dir(self.uri)
        _dirs.remove(self.uri)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about ``max_bytes`` in ``column``; a
    longer value is a piece of its own, never cut."""
    n = batch.num_rows
    if not n:
        return
    off = offsets(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < n:
        end = int(np.searchsorted(off, off[start] + max_bytes, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start)
        start = end


def offsets(col: pa.Array) -> np.ndarray:
    """The value offsets of a string or binary array."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(col.buffers()[1], kind, count=len(col) + 1, offset=col.offset * np.dtype(kind).itemsize).astype(np.int64)


def values(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as UTF-8; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if len(col) == 0:
        return []
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return [x or b"" for x in col.to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", max_bytes: int = SLICE_BYTES) -> DataFrame:
    """Apply ``fn`` to pieces of bounded text size of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column, max_bytes):
                out = fn(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
