import numpy as np
import pytest

from trackloom.functions.geometry import Guide
from trackloom.operators import bands
from trackloom.operators.bands import Band, Bridge

PLUS, MAIN = Band("plus", 5.0, 0.25, "parallel"), Band("main", 0.0, 0.3, "main", whole=True)
FEATURE, VERTEX = "id int, band_id string, low double, high double, offset double", "id int, band_id string, x double, y double"


def lines_of(spark, features, vertices, length=100.0, gap=5.0, least=35.0, step=25.0, all_bands=(MAIN, PLUS), bridges=()):
    guide = Guide(0.0, 0.0, length, 0.0)
    found = bands.fits(spark.createDataFrame(features, FEATURE), spark.createDataFrame(vertices, VERTEX), guide, list(all_bands), ["id"], gap, least, bridges)
    return found.toPandas(), bands.centrelines(found, guide, step).orderBy("band_id", "interval_id", "k").toPandas()


def merged_by_force(rows, gap, bridges, band):
    out = []
    for low, high in sorted((min(r), max(r)) for r in rows):
        if out:
            end, hole = out[-1]["end"], low - out[-1]["end"]
            bridge = next((b for b in bridges if b.band == band and 0 < hole <= b.most and end >= b.low and low <= b.high), None) if hole > gap else None
            if hole <= gap or bridge:
                last = out[-1]
                if bridge:
                    last["n_bridged"] += 1
                    last["note"] = bridge.note
                    if hole >= last["longest"]:
                        last["longest"], last["middle"] = hole, (end + low) / 2
                last["end"], last["n"] = max(end, high), last["n"] + 1
                continue
        out.append({"start": low, "end": high, "n": 1, "n_bridged": 0, "longest": 0.0, "middle": 0.0, "note": None})
    return out


def test_intervals_against_force(spark):
    r = np.random.default_rng(5)
    bridges = (Bridge("plus", 100, 400, 40, "a"), Bridge("plus", 300, 900, 25, "b"), Bridge("far", 0, 1000, 90, "c"))
    rows = [(int(k), str(b), float(s), float(s + w)) for k, b, s, w in zip(r.integers(0, 6, 240), r.choice(["plus", "far", "main"], 240), r.integers(0, 1000, 240), r.integers(-12, 30, 240))]
    rows += rows[:20] + [(1, None, 0.0, 500.0), (2, "plus", None, 700.0)]
    got = bands.intervals(spark.createDataFrame(rows, "id int, band_id string, low double, high double"), ["id"], 6.0, bridges).orderBy("id", "band_id", "start").collect()
    groups = {}
    for k, b, s, e in rows:
        if b is not None and s is not None:
            groups.setdefault((k, b), []).append((s, e))
    expected = [(k, b, *x.values()) for (k, b), g in sorted(groups.items()) for x in merged_by_force(g, 6.0, bridges, b)]
    assert [tuple(x) for x in got] == expected and any(x.n_bridged > 1 for x in got)


def test_short_intervals_go_before_they_are_numbered(spark):
    found, _ = lines_of(spark, [(1, "plus", 0.0, 20.0, 5.0), (1, "plus", 60.0, 110.0, 5.0)], [(1, "plus", x, 5.0) for x in (0.0, 20.0, 60.0, 110.0)], 120.0, all_bands=[PLUS])
    assert len(found) == 1 and found.interval_id[0] == 0 and found.start[0] == 60.0 and found.n_samples[0] == 2 and found.role[0] == "parallel"


def test_main_band_runs_along_the_guide(spark):
    _, line = lines_of(spark, [(1, "main", 0.0, 100.0, -0.03)], [(1, "main", x, -0.03) for x in (0.0, 50.0, 100.0)])
    assert line.station.tolist() == [0, 25, 50, 75, 100] and np.allclose(line.y, -0.03)
    found, line = lines_of(spark, [(1, "plus", 10.0, 60.0, 5.1)], [])
    main, plus = (line[line.band_id == b] for b in ("main", "plus"))
    assert np.allclose(main.y, 0) and main.station.max() == 100 and np.allclose(plus.y, 5.1)  # no vertex: the features' offset
    assert found.set_index("band_id").n_samples.to_dict() == {"main": 0, "plus": 0}


def test_lines_are_straight_and_leave_out_what_lies_far(spark):
    _, line = lines_of(spark, [(1, "plus", 0.0, 100.0, 5.0)], [(1, "plus", 0.0, 5.0), (1, "plus", 50.0, 5.2), (1, "plus", 100.0, 5.0)], all_bands=[PLUS])
    assert np.ptp(line.y) < 1e-9 and abs(line.y[2] - 5.2) > 0.05
    rows = [(1, "plus", float(x), 5.0 + 0.002 * x) for x in range(0, 100, 2)] + [(1, "plus", 40.0, 5.8), (1, "plus", 44.0, 9.0), (1, "plus", -3.0, 5.0)]
    found, line = lines_of(spark, [(1, "plus", 0.0, 100.0, 5.0)], rows, all_bands=[PLUS])
    assert found.n_samples[0] == 51 and found.n_inliers[0] == 50 and found.slope[0] == pytest.approx(0.002, abs=1e-9)
    assert np.allclose(line.offset, 5.0 + 0.002 * line.station)


def test_odd_features(spark):
    found, line = lines_of(spark, [(1, None, 0.0, 90.0, 5.0), (1, "unknown", 0.0, 90.0, 5.0), (2, "plus", 80.0, 20.0, None)], [(2, "plus", 50.0, 4.9), (2, None, 1.0, 1.0)], all_bands=[PLUS])
    assert len(found) == 1 and found.id[0] == 2 and found.n_samples[0] == 1 and found.slope[0] == 0 and found.intercept[0] == pytest.approx(4.9)
    assert line.station.tolist() == [20, 40, 60, 80] or line.station.iloc[[0, -1]].tolist() == [20, 80]
    found, line = lines_of(spark, [], [])
    assert not len(found) and not len(line)
