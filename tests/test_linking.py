"""Tracks over a stream equal those of a batch, however the stream is cut."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom import catalog
from trackloom.operators import dynamic
from trackloom.streaming import linking

RULE = {"max_gap": 30.0, "max_offset": 1.0, "max_slope": 0.05, "least": 4, "length": 40.0}


def rows_of(df):
    return sorted(((r[0] or "-", *(round(x, 6) for x in r[1:])) for r in df.select("key", "station", "center", "score", "track").collect()))


@pytest.fixture(scope="module")
def samples(spark):
    r = np.random.default_rng(3)
    out = []
    for key in ("a", "b", None):
        for line in range(4):
            start, n = r.integers(0, 400), r.integers(2, 30)
            at = start + np.cumsum(r.integers(1, 45, n))
            out += [(key, int(s), float(line * 0.8 + r.normal(0, 0.3)), float(r.random())) for s in at]
    frame = pd.DataFrame(out, columns=["key", "second", "center", "score"]).drop_duplicates(["key", "second", "score"])
    return spark.createDataFrame(frame, "key string, second long, center double, score double").withColumn("time", F.timestamp_seconds("second")).drop("second")


@pytest.mark.parametrize(("step", "files"), [(10_000, 1), (120, 1), (120, 3), (37, 2)])
def test_stream_equals_batch(spark, samples, tmp_path, step, files):
    batch = rows_of(dynamic.linked_tracks(samples.withColumn("station", F.unix_millis("time") / 1000), ["key"], **RULE))
    assert len(batch) > 60 and len({(r[0], r[4]) for r in batch}) > 5
    linking.chunked(spark, samples, "time", step, f"{tmp_path}/in")
    end = spark.createDataFrame([("end", 0.0, 0.0, 100_000)], "key string, center double, score double, second long").withColumn("time", F.timestamp_seconds("second")).drop("second")
    found = linking.drained(lambda s: linking.linked_stream(s, ["key"], "time", f"{step} seconds", **RULE), f"{tmp_path}/in", end, str(tmp_path), files)
    assert rows_of(found) == batch


def test_linker_against_plain_rule():
    linker = dynamic.Linker(10, 1.0, 0.0)
    assert linker.take(0, [0.0, 5.0]) == [1, 2]
    assert linker.take(1, [0.9, 0.2]) == [1, 3]  # a track is joined once a station
    assert linker.take(2, [1.8]) == [1]  # its prediction, not its last place
    assert linker.take(20, [1.8]) == [4]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query(spark):
    d = "/root/testdata/sf0.001"
    same = lambda name: sorted(tuple(round(x, 6) for x in r) for r in catalog.QUERIES[name](spark, d).select("user_id", "station", "center", "score", "track").collect())
    batch = same("batch_tracks")
    assert len(batch) > 300 and same("stream_tracks") == batch
