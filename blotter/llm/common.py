"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
import threading
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from blotter import session
from blotter.session import materialize

__all__ = ["importable", "read_table", "materialize", "scratch_path", "text_runs", "unused", "utf8_chunks", "worker_state"]

ROWS, BATCH_BYTES = 1000, 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Make a session fit for the operators.

    The Python workers of a local session import this package from where the
    driver has it (a cluster ships it with ``--py-files``). Arrow batches hold
    at most ``ROWS`` whole texts and end at ``BATCH_BYTES``: Spark's defaults would be
    tens to hundreds of MB in the JVM and again in Python."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, which ``drop_scratch`` deletes."""
    return session.scratch_path(spark, "tables", name)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


_STATE: dict = {}
_LAST_USE = [0.0]
IDLE_SECONDS = 4.0


def worker_state(key: str, make):
    """What ``make`` returns, kept by this Python worker until another key is
    asked for or none for some seconds: a worker holds the tables of one operator at
    a time, and none while it waits for another stage's tasks."""
    found = _STATE.get(key)
    if found is None:
        _STATE.clear()
        if not _LAST_USE[0]:
            threading.Thread(target=_release_idle, daemon=True).start()
        found = make()
        _STATE[key] = found
    _LAST_USE[0] = time.monotonic()
    return found


def _release_idle() -> None:
    """Drop the state of a worker without work and give its memory back."""
    while True:
        time.sleep(1.0)
        if _STATE and time.monotonic() - _LAST_USE[0] > IDLE_SECONDS:
            _STATE.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                with contextlib.suppress(OSError, AttributeError):  # another C library
                    ctypes.CDLL("libc.so.6").malloc_trim(0)


def utf8_chunks(col: pa.Array, max_bytes: int = 1 << 20):
    """Split a string array into runs of rows of about ``max_bytes`` of UTF-8.

    Yields ``(data, offsets)``: the bytes of the run as a uint8 array and the
    row boundaries in it. Nulls are empty texts; a longer text is a run of its
    own, always whole.
    """
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(col):
        last = int(np.searchsorted(offs, offs[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(col))
        yield data[offs[first]:offs[last]], offs[first:last + 1] - offs[first]
        first = last


def text_runs(col: pa.Array, max_bytes: int = 4 << 20):
    """Lists of ``(row, piece)`` of about ``max_bytes`` of UTF-8, in order.

    A text is one piece, nulls are empty; one over ``max_bytes`` is cut behind spaces
    or line ends into pieces that join to the whole of it (a stretch without any
    stays whole), so what a run holds is bounded.
    """
    col = pc.fill_null(col.cast(pa.large_string()), "")
    run, held = [], 0
    for row in range(len(col)):
        raw = col[row].as_buffer().to_pybytes()
        at = 0
        while True:
            stop = len(raw)
            if stop - at > max_bytes:
                found = [raw.find(sign, at + max_bytes) for sign in (b" ", b"\n")]
                stop = min((f + 1 for f in found if f >= 0), default=stop)
            run.append((row, raw[at:stop]))
            held += stop - at
            at = stop
            if held >= max_bytes:
                yield run
                run, held = [], 0
            if at >= len(raw):
                break
    if run:
        yield run
