"""Small helpers that the operators share: checkpoints and streaming of Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pulseframe.session import shared_folder


#: Rows that go to a Python worker at once while a table is written, in bytes; a single larger row is a batch of its own.
BATCH_BYTES = 4_000_000


@contextmanager
def batches_of(session: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of at most this many bytes for what is executed inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = session.conf.get(name)
    session.conf.set(name, f"{size}b")
    try:
        yield
    finally:
        session.conf.set(name, before)


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, computed once and read back from a Parquet table, so that a lost executor costs no rerun of what led to it. The table
    lies in the folder the cluster names in spark.checkpoint.dir; only a session in local mode may leave that unset."""
    session = frame.sparkSession
    folder = session.conf.get("spark.checkpoint.dir", None) or session.sparkContext.getCheckpointDir() or shared_folder(session)
    path = f"{folder.rstrip('/')}/pulseframe-{uuid.uuid4().hex}"
    with batches_of(session, BATCH_BYTES):
        frame.write.parquet(path)
    return session.read.schema(frame.schema).parquet(path)


def release_memory() -> None:
    """Give memory that Python workers no longer use back to the system; an executor keeps its workers from stage to stage."""
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def joined(blobs: Iterable[bytes], dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=dtype)


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Places where a run of equal keys begins, in columns of equal length."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
