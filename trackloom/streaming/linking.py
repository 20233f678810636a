"""Linking of samples to tracks over a stream, with the open tracks of a key as state.

A sample waits until the watermark has passed its time, as more of the same time may come; then all that are due are linked in
order of time, by the rule of the batch operator (`dynamic.linked_tracks`), so the rows are the same however the stream is cut
into batches. A sample of a track is held back until its track is long enough, and goes if the track ends before. State holds the waiting
samples, the open tracks (one row each, closed by a timer after the longest gap) and what is held back, nothing older.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.dynamic import Linker
from ..shipping import ship
from ..storage import discard

_SAMPLE = "ms long, center double, score double"
_OPEN = "track long, station double, center double, slope double, first double, n long"
_HELD = "track long, station double, center double, score double"


class _Linking(StatefulProcessor):
    def __init__(self, key_types: list[tuple[str, str]], rule: tuple, least: int, length: float):
        self.keys, self.rule, self.least, self.length = key_types, rule, least, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _SAMPLE)
        self.open = handle.getListState("open", _OPEN)
        self.held = handle.getListState("held", _HELD)
        self.made = handle.getValueState("made", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            found = [(int(m), float(c), float(s)) for m, c, s in zip(part["at_ms"], part["center"], part["score"], strict=True)]
            if found:
                self.waiting.appendList(found)
                first = min([x[0] for x in found] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        samples = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((x for x in samples if x[0] < now), key=lambda x: (x[0], -x[2], x[1]))
        rest = [tuple(x) for x in samples if x[0] >= now]
        linker = Linker(*self.rule, made=self.made.get()[0] if self.made.exists() else 0)
        facts = {}
        for track, station, center, slope, begun, n in self.open.get() if self.open.exists() else []:
            linker.live[track] = (station, center, slope)
            facts[track] = (begun, n)
        held: dict[int, list] = {}
        for track, *row in self.held.get() if self.held.exists() else []:
            held.setdefault(track, []).append(row)
        out = []
        at = 0
        while at < len(due):
            end = at
            while end < len(due) and due[end][0] == due[at][0]:
                end += 1
            station = due[at][0] / 1000
            for (_, center, score), track in zip(due[at:end], linker.take(station, [x[1] for x in due[at:end]]), strict=True):
                begun, n = facts.get(track, (station, 0))
                facts[track] = (begun, n + 1)
                if n >= 0:
                    held.setdefault(track, []).append([station, center, score])
                if n < 0 or n + 1 >= self.least and station - begun >= self.length:  # from now on nothing of this track is held back
                    out += [(track, *x) for x in held.pop(track, [[station, center, score]])]
                    facts[track] = (begun, -1)
            at = end
        linker.close(now / 1000)  # the next sample is not before the watermark
        self._put(self.waiting, rest)
        self._put(self.open, [(k, *v, *facts[k]) for k, v in linker.live.items()])
        self._put(self.held, [(k, *x) for k, v in held.items() if k in linker.live for x in v])
        self.made.update((linker.made,))
        later = [min(x[0] for x in rest) + 1] if rest else []
        later += [int((min(v[0] for v in linker.live.values()) + linker.max_gap) * 1000) + 1001] if linker.live else []
        if later:
            self.handle.registerTimer(max(min(later), now + 1))
        if out:
            names = ["track", "station", "center", "score"]
            frame = pd.DataFrame(out, columns=names)
            for k, (name, _) in enumerate(self.keys):
                frame[name] = key[k]
            yield frame[[*(n for n, _ in self.keys), "station", "center", "score", "track"]]

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def linked_stream(samples: DataFrame, keys: list[str], time: str, late: str, max_gap: float, max_offset: float, max_slope: float, least: int, length: float) -> DataFrame:
    """keys, station (seconds), center, score, track of a stream of samples (keys, time, center, score), in append mode.

    Gaps and lengths are in seconds. A sample later than the watermark allows does not count; one without a time, center or score neither.
    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    ship(samples.sparkSession)
    types = [(k, samples.schema[k].dataType.simpleString()) for k in keys]
    rows = samples.filter(F.col(time).isNotNull() & F.col("center").isNotNull() & F.col("score").isNotNull())
    rows = rows.withWatermark(time, late).select(*keys, F.col(time).alias("at_time"), F.unix_millis(F.col(time)).alias("at_ms"), F.col("center").cast("double"), F.col("score").cast("double"))
    schema = T.StructType([*(samples.schema[k] for k in keys), *(T.StructField(c, T.DoubleType()) for c in ("station", "center", "score")), T.StructField("track", T.LongType())])
    processor = _Linking(types, (max_gap, max_offset, max_slope), least, length)
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def chunked(spark, rows: DataFrame, time: str, step: int, place: str) -> None:
    """Files of `step` seconds each in the folder `place`, written in order of time, for a stream to take some at a time."""
    first, last = rows.agg(F.min(F.unix_seconds(time)), F.max(F.unix_seconds(time))).first()
    if first is None:
        rows.limit(0).write.mode("append").parquet(place)
        return
    # Dealt to folders in one pass, so that each step reads its own rows, not all of them.
    cut = f"{place.rstrip('/')}-cut"
    kept = rows.filter(F.col(time).isNotNull())
    kept.withColumn("_chunk", F.floor((F.unix_seconds(F.col(time)) - first) / step)).write.partitionBy("_chunk").parquet(cut)
    kind = T.StructType([*rows.schema.fields, T.StructField("_chunk", T.LongType())])
    dealt = spark.read.schema(kind).parquet(cut)
    for k in range((last - first) // step + 1):
        dealt.filter(F.col("_chunk") == k).select(*rows.columns).write.mode("append").parquet(place)
    dealt._stored_at = cut
    discard(dealt)


def drained(stream_of, source: str, end: DataFrame, place: str, files: int) -> DataFrame:
    """All rows of a stream over the files in `source`, some files a batch, kept by a file sink. After them `end`, a row later than all that waits, is
    written, and the stream goes on from its checkpoint, so that every timer fires."""
    spark = end.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for turn in range(2):
            if turn:
                end.coalesce(1).write.mode("append").parquet(source)
            out = stream_of(spark.readStream.schema(end.schema).option("maxFilesPerTrigger", files).parquet(source))
            run = out.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    return spark.read.schema(out.schema).parquet(f"{place}/rows")
