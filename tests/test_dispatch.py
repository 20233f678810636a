"""Settings to centrelines, on clouds made by seed; exact quantiles."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.operators import quantiles
from trackloom.plans import dispatch
from trackloom.plans.centreline import Config

CONFIG = Config(gauge=1.5, tolerance=0.3, slice_length=0.8, least_points=12)
ANGLE, SHIFT = np.radians(33), np.array([100.0, -30.0])


def world(local):
    c, s = np.cos(ANGLE), np.sin(ANGLE)
    return local[:, :2] @ np.array([[c, s], [-s, c]]) + SHIFT


def tracks(seed, lines, guard=()):
    """Points of tracks given as (s, t) with rails 0.75 beside them, guard rails and ballast."""
    r = np.random.default_rng(seed)
    parts = []
    for s, t in lines:
        z = 0.015 * np.sin(s / 12)
        for side in (-0.75, 0.75):
            p = np.repeat(np.column_stack([s, t + side, z + 0.08]), 6, axis=0)
            parts.append(p + r.normal(0, [0.08, 0.02, 0.01], p.shape))
        p = np.repeat(np.column_stack([s, t, 0 * s - 0.04]), 6, axis=0) + r.normal(0, [0.1, 0.01, 0.02], (6 * len(s), 3))
        p[:, 1] += r.uniform(-1.3, 1.3, len(p))
        parts.append(p)
    for s, t in guard:
        p = np.repeat(np.column_stack([s, t, 0 * s + 0.085]), 3, axis=0)
        parts.append(p + r.normal(0, [0.08, 0.02, 0.01], p.shape))
    local = np.vstack(parts)
    return pd.DataFrame(np.column_stack([world(local), local[:, 2]]), columns=["x", "y", "z"])


S = np.linspace(0, 40, 160)


def oriented(t0, t1, s0=-2.0, s1=60.0):
    return {"origin": SHIFT.tolist(), "axis_s": [math.cos(ANGLE), math.sin(ANGLE)], "s_min": s0, "s_max": s1, "t_min": t0, "t_max": t1}


def local_of(rows):
    d = rows[["x", "y"]].to_numpy() - SHIFT
    c, s = np.cos(ANGLE), np.sin(ANGLE)
    return d @ np.array([c, s]), d @ np.array([-s, c])


def test_mode_and_corridor_rule():
    guided = {"guided_paths": {"enabled": True, "tracks": [{"points": [[0, 0], [1, 1]]}]}}
    full = {**guided, "turnout": {"enabled": True}, "tracks": [{"id": 1}]}
    assert dispatch.mode_of(full) == "guided_paths"
    assert dispatch.mode_of({**full, "guided_paths": {"enabled": True, "tracks": [{"enabled": False}]}}) == "turnout"
    assert dispatch.mode_of({"tracks": [{"id": 1}]}) == "multi_track" and dispatch.mode_of({"tracks": [{"enabled": False}]}) == dispatch.mode_of({}) == "single"
    assert dispatch.use_corridor({}, ".LAS", True) and not dispatch.use_corridor({}, ".las", False) and not dispatch.use_corridor({}, ".csv", True)
    assert not dispatch.use_corridor({"advanced_las": {"enabled": False}}, ".las", True)
    with pytest.raises(ValueError, match="two points"):
        dispatch.regions(dispatch.merged_config(dispatch.DEFAULTS, {"guided_paths": {"enabled": True, "tracks": [{"points": [[0, 0]]}]}}))
    with pytest.raises(ValueError, match="one id"):
        dispatch.regions(dispatch.merged_config(dispatch.DEFAULTS, {"tracks": [{"id": 1}, {"id": 1}]}))


def test_three_tracks_and_one_without_points(spark):
    offsets = (-4.0, 0.0, 4.0)
    df = spark.createDataFrame(tracks(11, [(S, 0 * S + o) for o in offsets], [(S, 0 * S + o + g) for o in (-4, 4) for g in (-0.28, 0.28)]))
    config = {"tracks": [{"id": k, "oriented_roi": oriented(o - 1.6, o + 1.6)} for k, o in enumerate((*offsets, 30.0), 1)]}
    lines = dispatch.analyse(df, config, CONFIG).cache()
    got = lines.toPandas()
    assert set(got["mode"]) == {"multi_track"}
    for k, o in enumerate(offsets, 1):
        _, t = local_of(got[got["region"] == str(k)])
        assert len(t) > 30 and abs(np.median(t) - o) < 0.25
    n = {r.region: r.n for r in dispatch.report(lines, config).collect()}
    assert n["4"] == 0 and n["1"] > 30


def test_single_track_in_its_own_frame(spark):
    df = spark.createDataFrame(tracks(7, [(S, 0.12 * np.sin(S / 10))]))
    got = dispatch.analyse(df, {}, CONFIG).toPandas()
    s, t = local_of(got)
    assert set(got["mode"]) == {"single"} and len(got) > 30 and np.sqrt(np.mean((t - 0.12 * np.sin(s / 10)) ** 2)) < 0.25


def test_guided_path_takes_its_track(spark):
    df = spark.createDataFrame(tracks(23, [(S, 0 * S + o) for o in (-4.0, 0.0, 4.0)]))
    path = world(np.array([[1.0, 4.1, 0], [20.0, 3.9, 0], [39.0, 4.0, 0]]))
    config = {"guided_paths": {"enabled": True, "default_corridor_width": 4.2, "tracks": [{"id": 4, "points": path.tolist()}, {"id": 5, "enabled": False}]}, "tracks": [{"id": 9}]}
    got = dispatch.analyse(df, config, CONFIG).toPandas()
    _, t = local_of(got)
    assert set(got["region"]) == {"4"} and set(got["role"]) == {"main"} and len(got) > 30 and abs(np.median(t) - 4) < 0.25


@pytest.mark.parametrize("guided", [False, True])
def test_turnouts(spark, guided):
    s = np.linspace(0, 58, 232)
    b, far = s[s >= 14], s[s >= 28]
    df = spark.createDataFrame(tracks(37, [(s, 0 * s), (b, 0.065 * (b - 14)), (far, 0 * far + 3.8)], [(b, 0.065 * (b - 14) + 0.28)]))
    if guided:
        main, branch = world(np.array([[0.0, 0, 0], [57.0, 0, 0]])), world(np.array([[14.0, 0, 0], [57.0, 2.8, 0]]))
        config = {"guided_paths": {"enabled": True, "default_corridor_width": 7.0, "turnouts": [{"id": 3, "main_points": main.tolist(), "branch_points": branch.tolist()}]}}
    else:
        config = {"turnout": {"enabled": True, "id": 3, "oriented_roi": oriented(-1.7, 5.5)}}
    got = dispatch.analyse(df, config, CONFIG).toPandas().sort_values(["role", "place"])
    assert set(got["region"]) == {"turnout 3"} and set(got["mode"]) == {"guided_paths" if guided else "turnout"}
    main, branch = (got[got["role"] == r] for r in ("main", "branch"))
    assert len(main) > 10 and len(branch) > 6
    assert abs(np.median(local_of(main.tail(5))[1])) < 0.35 and 1.3 < np.median(local_of(branch.tail(5))[1]) < 3.2


def test_laser_corridor(spark):
    """Rails of low intensity on a bright ballast; a second track far away is left out of the corridor."""
    r = np.random.default_rng(3)
    near, far = tracks(5, [(S, 0 * S)]), tracks(6, [(S[:30], 0 * S[:30] + 12)])
    cloud = pd.concat([near, far], ignore_index=True)
    cloud["intensity"] = np.where(cloud["z"] > 0.02, 5200, 12500) + r.normal(0, 200, len(cloud))
    config = {"advanced_las": {"min_component_points": 500}}
    df = spark.createDataFrame(cloud)
    kept = dispatch.laser_corridor(df, dispatch.merged_config(dispatch.DEFAULTS, config)).toPandas()
    assert local_of(kept)[1].max() < 4 and len(kept) > 0.9 * len(near)
    got = dispatch.analyse(df, config, CONFIG, ".las").toPandas()
    assert len(got) > 20 and abs(np.median(local_of(got)[1])) < 0.25
    assert dispatch.laser_corridor(df, dispatch.merged_config(dispatch.DEFAULTS, {})).count() == len(cloud)  # no component of 5000 points


@pytest.mark.parametrize(("buckets", "finish"), [(4096, 20_000), (7, 3), (2, 1)])
def test_exact_quantiles(spark, monkeypatch, buckets, finish):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    monkeypatch.setattr(quantiles, "FINISH", finish)
    r = np.random.default_rng(2)
    shares = [0.0, 0.013, 0.25, 0.5, 0.65, 0.999, 1.0]
    cases = [r.normal(size=200), np.round(r.exponential(size=200), 1), np.array([5.0] * 30), np.array([1.0]), np.array([1e-300, 1e300, -1e308, 1e308, 0.0] * 5), np.concatenate([np.zeros(90), r.uniform(0, 1e-9, 10)])]
    for values in cases if buckets > 2 else cases[1:4]:
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        expected = df.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0]
        assert quantiles.exact_quantiles(df, "v", shares) == pytest.approx(expected, rel=1e-12)
    odd = spark.createDataFrame([(-math.inf,), (1.0,), (2.0,), (math.inf,), (math.nan,)], "v double")
    assert quantiles.exact_quantiles(odd, "v", [0.0, 0.25, 0.5, 0.75])[:4] == [-math.inf, 1.0, 2.0, math.inf]
    assert math.isnan(quantiles.exact_quantiles(odd, "v", [1.0])[0])
    assert quantiles.exact_quantiles(odd.limit(0), "v", [0.5]) is None


def test_exact_quantiles_of_a_million(spark):
    df = spark.range(1_000_000).select(F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.exp(F.randn(5) * 8)).alias("z"))
    df = df.cache()
    shares = [0.1, 0.35, 0.65, 0.9]
    assert quantiles.exact_quantiles(df, "z", shares) == pytest.approx(df.agg(F.percentile("z", F.array(*map(F.lit, shares)))).first()[0], rel=1e-12)
    df.unpersist()
