"""Main track and roles against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import roles
from trackloom.functions.geometry import Affine
from trackloom.operators import aggregates, lines, mainline


def by_force(rows, peaks, width, gap):
    out = {}
    for peak in peaks:
        near = sorted((s, t) for s, t in rows if abs(t - peak) <= width)
        if near:
            parts, part = [], [near[0][0]]
            for s, _ in near[1:]:
                if s - part[-1] > gap:
                    parts.append(part)
                    part = []
                part.append(s)
            a, b = max(((p[0], p[-1]) for p in [*parts, part]), key=lambda x: (x[1] - x[0], -x[0]))
            out[peak] = (len(near), statistics.median(t for _, t in near), a, b)
    return out


def test_clusters_against_force(spark):
    r = random.Random(5)
    rows = [(k, round(r.uniform(0, 60), 2), round(r.gauss(r.choice((-5, 0, 5)), 0.6), 2)) for k in (1, 2) for _ in range(120)]
    rows += [(1, round(0.01 * k, 2), 0.0) for k in range(2000)]  # one hot peak
    peaks = [-5.0, 0.0, 5.0, 40.0]
    frame = spark.createDataFrame(rows, "k int, s double, t double")
    side = spark.createDataFrame([(k, p) for k in (1, 2) for p in peaks], "k int, peak double")
    found = mainline.peak_clusters(frame, side, ["k"], 1.0, 2.0).collect()
    got = {(x.k, x.peak): (x.n, x.offset, x.start, x.end) for x in found}
    expected = {(k, p): v for k in (1, 2) for p, v in by_force([(s, t) for q, s, t in rows if q == k], peaks, 1.0, 2.0).items()}
    assert got == expected and all(x.coverage == x.end - x.start for x in found)
    assert mainline.peak_clusters(frame.limit(0), side, ["k"], 1.0, 2.0).count() == 0


def test_main_cluster(spark):
    names = "k int, peak double, n long, offset double, start double, end double, coverage double"
    rows = [(1, -5.0, 9, -5.0, 0.0, 90.0, 90.0), (1, 0.0, 5, 0.0, 0.0, 50.0, 50.0), (1, 5.0, 9, 5.0, 0.0, 80.0, 80.0)]  # the middle one has two sides
    rows += [(2, 0.0, 4, 0.0, 0.0, 9.0, 9.0), (2, 5.0, 7, 5.0, 1.0, 10.0, 9.0), (2, 9.0, 7, 9.0, 40.0, 49.0, 9.0)]  # none has: points, then the least peak
    got = {x.k: (x.peak, x.two_sided) for x in mainline.main_cluster(spark.createDataFrame(rows, names), ["k"], 3.0, 8.0, 1.0).collect()}
    assert got == {1: (0.0, True), 2: (5.0, False)}
    assert mainline.main_cluster(spark.createDataFrame([], names), ["k"], 3.0, 8.0, 1.0).count() == 0


def test_roles_of_missing_properties(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(
        roles.band_use(none, none).alias("use"),
        roles.supported(none).alias("supported"),
        roles.connector_kind(none, none).alias("kind"),
        roles.is_crossover(none, none, none, none).alias("crossover"),
        roles.needs_refinement(none, none.cast("double"), none.cast("double")).alias("refine"),
        roles.evidence_penalty(none, none, none).alias("penalty"),
        roles.priority_label(F.lit(7)).alias("priority"),
        Affine(0.5, 0.0, 9.0, 0.0, -0.5, 9.0).gap(F.lit(3.0), F.lit(2.0), F.lit(10.0)).alias("gap"),
        Affine(0.5, 0.0, 9.0, 0.0, -0.5, 9.0).gap(none.cast("double"), F.lit(2.0), F.lit(10.0)).alias("unknown"),
    ).first()
    assert tuple(row) == (None, True, "crossover", False, False, 0.2, "high", 4.0, None)


def test_lines_beside_a_guide(spark):
    rows = spark.createDataFrame([(1, 0.0, 10.0), (2, 5.0, 5.0), (3, 9.0, 2.0)], "id int, start double, end double")
    got = {}
    for x in lines.stations_between(rows, 4.0).orderBy("id", "k").collect():
        got.setdefault(x.id, []).append(x.station)
    assert got == {1: [0.0, 10 / 3, 20 / 3, 10.0], 2: [5.0, 5.0], 3: [9.0, 9.0]}


def test_local_offsets(spark):
    at = [0.0, 100.0, 150.0, 300.0, 381.0, 600.0]
    rows = spark.createDataFrame([(k, n, s) for k in (1, 2) for n, s in enumerate(at)], "key int, k int, station double")
    known = [(1, 95.0, 1.0), (1, 105.0, 3.0), (1, 105.0, 5.0), (1, 205.0, 13.0), (1, 420.0, -9.0), (1, 675.0, 7.0)]
    samples = spark.createDataFrame(known, "key int, station double, offset double")
    found = {(x.key, x.k): x.offset for x in lines.local_offsets(rows, samples, ["key"], 10.0, 2.0, bridge=110.0).collect()}
    # none within reach; the median; between neighbours; too far from both; the one after (39 away); the one after (75 away)
    assert [found[1, n] for n in range(6)] == [2.0, 3.0, 5.0 + 8.0 * 0.45, 2.0, -9.0, 7.0]
    assert {found[2, n] for n in range(6)} == {2.0}
    held = lines.local_offsets(rows, samples, ["key"], 10.0, 2.0, bridge=110.0, most=1.5)
    assert {x.offset for x in held.filter("key = 1").collect()} == {2.0, 3.0, 3.5, 0.5}
    assert lines.local_offsets(rows.limit(0), samples, ["key"], 10.0, 2.0).count() == 0


def through_by_force(rows, rounds=4, floor=1.25, times=2.5):
    s, t = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    keep, slope, base = np.ones(len(s), bool), 0.0, float(t.mean())
    for _ in range(rounds):
        if np.ptp(s[keep]) > 0:
            slope, base = np.polyfit(s[keep], t[keep], 1)
        else:
            slope, base = 0.0, t[keep].mean()
        off = np.abs(t - slope * s - base)
        near = off <= max(floor, np.percentile(off[keep], 75) * times)
        if near.sum() >= max(2, int(len(s) * 0.45)):
            keep = near
    return slope, base, len(s), int(keep.sum()), float(np.median(np.abs(t - slope * s - base)[keep]))


def test_through_fit_against_force(spark):
    r = random.Random(3)
    groups = {k: [(float(s), 0.02 * s + r.gauss(0, 0.4) + (r.uniform(5, 40) if r.random() < share else 0)) for s in range(0, 200, 3)] for k, share in ((1, 0.0), (2, 0.2), (3, 0.6))}
    groups |= {4: [(5.0, 7.0)], 5: [(5.0, 7.0), (5.0, 8.0)], 6: [(0.0, 0.0), (10.0, 5.0)]}
    frame = spark.createDataFrame([(k, s, t) for k, rows in groups.items() for s, t in rows], "key int, station double, offset double")
    got = {x.key: (x.slope, x.intercept, x.n, x.n_kept, x.residual) for x in aggregates.through_fit(frame, ["key"]).collect()}
    assert set(got) == set(groups)
    for k, rows in groups.items():
        assert got[k] == pytest.approx(through_by_force(rows), rel=1e-7, abs=1e-7), k
    assert aggregates.through_fit(frame.limit(0), ["key"]).count() == 0
