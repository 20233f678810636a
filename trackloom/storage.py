"""The folder that driver and executors share, and tables kept there to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_made: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; else a folder of our own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found:
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="trackloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write `df` to the shared folder and read it back. The files survive lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _made:
        _made[-1].append(out)
    return out


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables stored within, to be discarded once nothing reads them."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        _made.pop()


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more, and let Spark drop the shuffle files of plans that are gone."""
    spark = None
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path:
            spark = t.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            t._stored_at = None
    if spark:
        gc.collect()
        spark._jvm.System.gc()
