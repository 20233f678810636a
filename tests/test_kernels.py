"""Kernels over many keys see every key once and whole, however small the batches."""

import random

import numpy as np
import pyarrow as pa
import pytest

from trackloom import shipping


@pytest.mark.parametrize("rows", ["1", "3", "64", "5000"])
def test_map_runs(spark, rows):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    r = random.Random(5)
    data = [(a, b, k) for k in range(900) for a, b in [(r.choice([None, "x", "y", "z"]), r.choice([None, 1, 2, 3, 40]))]] + [("hot", 7, k) for k in range(500)]

    def run(batch, starts):
        seen = []
        for x, y in zip(starts, starts[1:], strict=False):
            part = batch.slice(x, y - x)
            assert len(set(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True))) == 1
            ks = np.asarray(part.column("k"))
            assert (np.diff(ks) > 0).all()
            seen.append((part.column("a")[0].as_py(), part.column("b")[0].as_py(), len(ks), int(ks.sum())))
        return pa.RecordBatch.from_arrays([pa.array([s[k] for s in seen], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["a", "b", "n", "total"])

    try:
        spark.conf.set(key, rows)
        got = shipping.map_runs(spark.createDataFrame(data, "a string, b long, k long"), ["a", "b"], ["k"], run, "a string, b long, n long, total long").collect()
        assert spark.conf.get(key) == rows
    finally:
        spark.conf.set(key, before)
    groups = {}
    for a, b, k in data:
        groups.setdefault((a, b), []).append(k)
    assert sorted(map(tuple, got), key=str) == sorted(((a, b, len(ks), sum(ks)) for (a, b), ks in groups.items()), key=str)
