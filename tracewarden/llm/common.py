"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import types as python_types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracewarden.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_in_worker(name: str, key: str, make):
    """``make()``, kept for later tasks of the same Python worker; only one name and key at a time, so caches do not add up."""
    module = "tracewarden_worker_state"
    if module not in sys.modules:
        sys.modules[module] = python_types.ModuleType(module)
    state = sys.modules[module].__dict__
    if state.get("held") != (name, key):
        forget_kept()
        state["held"], state["value"] = (name, key), make()
    return state["value"]


def forget_kept() -> None:
    """Give back what earlier operators kept or freed in this Python worker, for tasks that need the memory.

    Workers serve many tasks, and both Arrow's pool and the C library hold on to what a task has freed.
    """
    module = sys.modules.get("tracewarden_worker_state")
    if module is not None and module.__dict__.pop("held", None) is not None:
        module.__dict__.pop("value", None)
        gc.collect()
    give_back()


def give_back() -> None:
    """Return freed memory to the system and keep what is in use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def rows_in_chunks(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of bounded size, so that work arrays follow the slice and not the batch."""
    for batch in batches:
        first, size = 0, batch.nbytes
        step = max(1, min(max_rows, batch.num_rows * max_bytes // max(size, 1)))
        while first < batch.num_rows:
            yield batch.slice(first, step)
            first += step


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


LONG_ROWS = 1000  # rows of whole texts that travel to Python at once: a task holds a batch on either side


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Arrow batches of at most ``rows`` for what is worked out meanwhile; None leaves the session's setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows is not None:
        spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def store(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder in a dense codec and read back; ``discard`` drops it."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    with batches_of(df.sparkSession, batch_rows):
        df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.scratch_path = path
    return stored
