"""Make this package importable in the Python workers of a cluster whose executors do not have it installed."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}
#: Rows and bytes of an Arrow batch. Spark's own bounds let one batch of long texts, held by the JVM and by Python, take a good part of an executor's memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def _archive() -> str:
    if "zip" not in _made:
        here, folder = os.path.dirname(os.path.abspath(__file__)), tempfile.mkdtemp(prefix="trackloom-zip-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "trackloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for top, _, names in os.walk(here):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(top, name)
                        out.write(full, os.path.join("trackloom", os.path.relpath(full, here)))
        _made["zip"] = path
    return _made["zip"]


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        spark.sparkContext.addPyFile(_archive())
        _made[app] = app


def _release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def freed_kept():
    """Inside, freed arrays of up to 32 MB stay with the process for the next ones, where the C library would give them back and have the system clear them
    anew: a good part of the time of a kernel that makes arrays of a megabyte all along."""
    sizes = {-3: (32 << 20, 128 << 10), -1: (256 << 20, 128 << 10)}  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD: inside, and as they are by default
    with contextlib.suppress(OSError, AttributeError):  # another C library
        for key, (inside, _) in sizes.items():
            ctypes.CDLL("libc.so.6").mallopt(key, inside)
    try:
        yield
    finally:
        with contextlib.suppress(OSError, AttributeError):
            for key, (_, usual) in sizes.items():
                ctypes.CDLL("libc.so.6").mallopt(key, usual)


def map_arrow(df: DataFrame, run, schema, keep: bool = False) -> DataFrame:
    """mapInArrow for functions of this package. A task leaves no memory behind but what the function keeps on purpose; with `keep`, what it frees stays
    with the process until its end."""
    ship(df.sparkSession)
    for key, (usual, ours) in BATCH.items():
        if df.sparkSession.conf.get(key, usual) == usual:  # else the session has a bound of its own
            df.sparkSession.conf.set(key, ours)

    def lean(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            with freed_kept() if keep else contextlib.nullcontext():
                yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(lean, schema)


def map_groups(grouped, run, schema, spark: SparkSession) -> DataFrame:
    """applyInPandas for functions of this package."""
    ship(spark)
    return grouped.applyInPandas(run, schema)


def _changes(batch: pa.RecordBatch, at: list[int]) -> np.ndarray:
    """The rows from the second on whose keys differ from the row before; null equals null."""
    changed = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in at:
        column = batch.column(k)
        a, b = column.slice(1), column.slice(0, batch.num_rows - 1)
        changed |= np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | (np.asarray(pc.is_null(a)) != np.asarray(pc.is_null(b)))
    return np.flatnonzero(changed) + 1


def map_runs(df: DataFrame, keys: list[str], order: list, run, schema) -> DataFrame:
    """Kernels that depend on the row before: rows are dealt by key and sorted by Spark, and `run(batch, starts)` gets whole keys, many at a
    time (key k in rows starts[k] to starts[k + 1]), and returns a batch. A task holds no more than one Arrow batch and one key."""
    at = [df.columns.index(k) for k in keys]

    def many(batches):
        held, starts, last = [], [], None

        def done(parts):
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()
            return run(whole[0], np.array([*starts, whole[0].num_rows]))

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            first = tuple(batch.column(k)[0].as_py() for k in at)
            cuts = _changes(batch, at).tolist()
            if first != last:
                cuts.insert(0, 0)
            if cuts and (cuts[-1] or held):
                parts = [*held, batch.slice(0, cuts[-1])] if cuts[-1] else held
                starts += [rows + c for c in cuts[:-1]]
                yield done(parts)
                held, starts, rows, batch = [], [0], 0, batch.slice(cuts[-1])
            elif cuts:
                starts = [0]
            held.append(batch)
            rows += batch.num_rows
            last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in at)
        if held:
            yield done(held)

    dealt = df.repartition(*keys) if keys else df.coalesce(1)
    return map_arrow(dealt.sortWithinPartitions(*keys, *order), many, schema)
