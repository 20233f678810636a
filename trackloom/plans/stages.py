"""Stages that write tables, in order: a stage whose table is there is skipped, runs can start and stop anywhere, and a dry run only tells."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def check(stages: list[Stage]) -> None:
    """Names are unique and every need comes before."""
    seen: set[str] = set()
    for s in stages:
        if s.name in seen or not set(s.needs) <= seen:
            raise ValueError(f"stage {s.name} is doubled or comes before what it needs")
        seen.add(s.name)


def run(spark: SparkSession, stages: list[Stage], folder: str, start_at: str | None = None, stop_after: str | None = None, dry: bool = False, again: bool = False) -> list[dict]:
    """What was done with each stage: name, status (run, kept, skipped or planned) and seconds."""
    check(stages)
    names = [s.name for s in stages]
    for name in (start_at, stop_after):
        if name is not None and name not in names:
            raise ValueError(f"there is no stage {name}")
    first, last = names.index(start_at) if start_at else 0, names.index(stop_after) if stop_after else len(names) - 1
    events = []
    for k, s in enumerate(stages):
        path, began = f"{folder.rstrip('/')}/{s.name}", time.monotonic()
        there = _exists(spark, path)
        if not first <= k <= last:
            status = "skipped"
        elif there and not again:
            status = "kept"
        elif dry:
            status = "planned"
        else:
            s.run(spark, {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in s.needs}).write.mode("overwrite").parquet(path)
            status = "run"
        events.append({"stage": s.name, "status": status, "seconds": round(time.monotonic() - began, 3)})
    return events
