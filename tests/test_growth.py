"""Operators whose work must follow their input: held against plain Python on what made them grow."""

import numpy as np

from trackloom.operators import aggregates, lines, ranges


def rows_of(df):
    """Rows that the plan of `df` multiplies by explode."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Generate explode")


def test_displacement_writes_no_places_out(spark):
    """Long stations between few vertices: the places of the grid are summed, not written."""
    rng = np.random.default_rng(5)
    a = [(k, float(s), float(o)) for k in range(4) for s, o in zip(np.sort(rng.choice(900, 25, False)), rng.normal(0, 3, 25), strict=True)]
    b = [(k, float(s), float(o)) for k in range(4) for s, o in zip(np.sort(rng.choice(900, 40, False)), rng.normal(0, 3, 40), strict=True)]
    a += [(9, 0.0, 1.0), (9, 3e9, 1.0), (11, 5.0, 1.0), (12, 0.0, 0.0)]
    b += [(9, 0.0, -1.0), (9, 3e9, 2.0), (11, 5.0, 4.0), (12, 9.0, 0.0)]
    made = [spark.createDataFrame(x, "key int, station double, offset double") for x in (a, b)]
    df = aggregates.displacement(*made, ["key"], 3.0)
    assert rows_of(df) == 0
    got = {r.key: r for r in df.collect()}
    assert set(got) == {0, 1, 2, 3, 9, 11}
    for key in range(4):
        (sa, oa), (sb, ob) = (np.array([r[1:] for r in x if r[0] == key]).T for x in (a, b))
        low, high = max(sa[0], sb[0]), min(sa[-1], sb[-1])
        at = low + 3.0 * np.arange(int((high - low) // 3) + 1)
        d = np.abs(np.interp(at, sa, oa) - np.interp(at, sb, ob))
        assert np.allclose([got[key].mean, got[key].most, got[key].at], [d.mean(), d.max(), at[d.argmax()]])
    assert abs(got[9].mean - 5 / 6) < 1e-6 and got[9].most == 2.0 and got[9].at == 0.0  # 2 at the start, 0 at two thirds, 1 at the end
    assert got[11].mean == 3.0 and got[11].at == 5.0


def test_stations_are_not_broadcast(spark):
    """A row a track becomes a hundred thousand stations: Spark reckons with the row, and would send the stations to every task."""
    ends = spark.createDataFrame([(k, 0.0, 1e6) for k in range(3)], "track int, start double, end double")
    samples = spark.createDataFrame([(k, 500.0 * j, float(j)) for k in range(3) for j in range(9)], "track int, station double, offset double")
    df = lines.local_offsets(lines.stations_between(ends, 100.0), samples, ["track"], 20.0, 7.0)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.track, r.k): r.offset for r in df.filter("k <= 41").collect()}
    assert len(got) == 3 * 42 and df.count() == 3 * 10_001
    assert got[1, 10] == 2.0 and got[2, 41] == 7.0 and got[0, 0] == 0.0 and got[0, 1] == 7.0 and got[0, 5] == 1.0


def _places(rng, n, spread):
    return [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, spread, (n, 2)).round(2))]


def test_nearest_looks_near_first(spark, monkeypatch):
    """Many targets at one place and around: the same rows as by force, ties to the smaller, through several radii."""
    rng = np.random.default_rng(7)
    a, b = [*_places(rng, 300, 20), (900, 27.0, 3.0), (901, 60.0, 60.0)], _places(rng, 2000, 20)
    b += [(2000 + k, 5.0, 5.0) for k in range(50)]
    tried = []
    once = ranges.near_points
    monkeypatch.setattr(ranges, "near_points", lambda points, targets, radius, *names: tried.append(radius) or once(points, targets, radius, *names))
    p, t = spark.createDataFrame(a, "id int, x double, y double"), spark.createDataFrame(b, "sid int, tx double, ty double")
    got = {r.id: (r.sid, r.distance) for r in ranges.nearest(p, t, 8.0, "id", "sid").collect()}
    at = np.array([r[1:] for r in b])
    expected = {}
    for k, x, y in a:
        d = np.hypot(*(at - (x, y)).T)
        if d.min() <= 8:
            expected[k] = (int(np.flatnonzero(d <= d.min() + 1e-12)[0]), d.min())
    assert tried[0] <= 1.0 and tried[-1] == 8.0 and len(tried) > 3
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()} and 900 in got and 901 not in got


def test_full_cells_are_cut(spark, monkeypatch):
    """A cell of many pairs goes to many tasks, and no pair is lost or doubled."""
    monkeypatch.setattr(ranges, "PAIRS", 500)
    rng = np.random.default_rng(9)
    a, b = _places(rng, 150, 3), _places(rng, 60, 3) + [(100 + k, 40.0, 40.0) for k in range(9)]
    p, t = spark.createDataFrame(a, "id int, x double, y double"), spark.createDataFrame(b, "sid int, tx double, ty double")
    df = ranges.near_points(p, t, 4.0)
    assert df.rdd.getNumPartitions() > 10
    found = sorted((r.id, r.sid) for r in df.select("id", "sid").collect())
    assert found == sorted((i, j) for i, x, y in a for j, u, v in b if np.hypot(x - u, y - v) <= 4)
    assert max(df.rdd.glom().map(len).collect()) < len(found) / 4


def test_snapping_looks_at_few_segments(spark, monkeypatch):
    """Points that find an end of another line are not held against segments; the rows are those of brute force."""
    rng = np.random.default_rng(11)
    ends = [(k, k // 2, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 6, (80, 2)))] + [(100, 70, 2.25, 2.5), (101, 70, 9.0, 9.0)]
    seen = []
    once = lines.near_segments
    monkeypatch.setattr(lines, "near_segments", lambda p, *rest, **named: seen.append(p.count()) or once(p, *rest, **named))
    points = spark.createDataFrame(ends, "point_id int, line_id int, x double, y double")
    pairs = [(a[1], a[2], a[3], b[2], b[3]) for a, b in zip(ends[::2], ends[1::2], strict=True)]
    segments = spark.createDataFrame(pairs, "line_id int, ax double, ay double, bx double, by double")
    got = {r.point_id: (r.to_end, r.other, round(r.distance, 9)) for r in lines.snap_targets(points, segments, points.select("line_id", "x", "y"), 1.0).collect()}
    expected, alone = {}, 0
    for k, line, x, y in ends:
        near = min(((np.hypot(u - x, v - y), o) for _, o, u, v in ends if o != line and np.hypot(u - x, v - y) <= 0.35), default=None)
        alone += near is None
        if near:
            expected[k] = (True, near[1], round(near[0], 9))
            continue
        found = []
        for o, ax, ay, bx, by in pairs:
            size = (bx - ax) ** 2 + (by - ay) ** 2
            u = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size)) if size else 0.0
            d = np.hypot(x - ax - u * (bx - ax), y - ay - u * (by - ay))
            if o != line and d <= 1.0:
                found.append((round(d, 9), o))
        if found:
            expected[k] = (False, min(found)[1], min(found)[0])
    assert seen == [alone] and 0 < alone < 60
    assert {k: v[::2] for k, v in got.items()} == {k: v[::2] for k, v in expected.items()} and all(got[k][1] == v[1] for k, v in expected.items() if v[0])


def test_distances_at_the_radius_equal_sql(spark):
    """A point that lies as far from a segment's end as the radius says, in numbers of hundredths, as the SQL has it."""
    import os

    import duckdb
    import pytest

    from trackloom import catalog

    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("near_segments", "segment_crossings"):
        got = {tuple(r) for r in catalog.QUERIES[name](spark, d).select("id", "sid").collect()}
        assert got == {r[:2] for r in con.sql(catalog.ORACLE_SQL[name]).fetchall()}


def test_nodes_of_many_edges_are_looked_up_apart(spark, monkeypatch):
    """Stars and a chain through both ways of looking up, beyond the edges that one task joins."""
    from trackloom.operators import graph

    monkeypatch.setattr(graph, "FEW", 0)
    monkeypatch.setattr(graph, "HOT", 5)
    edges = [(1, k) for k in range(100, 140)] + [(500, k) for k in range(130, 170)] + [(900 + k, 901 + k) for k in range(12)] + [(k, 3000) for k in range(2000, 2030)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {k: 1 for k in [1, 500, *range(100, 170)]} | {k: 900 for k in range(900, 913)} | {k: 2000 for k in [3000, *range(2000, 2030)]}
    assert got == expected


def test_chunks_are_cut_in_one_pass(spark, tmp_path):
    """Each step reads its own rows; those without a time are left out, and the files hold every other row once."""
    from pyspark.sql import functions as F

    from trackloom.streaming.linking import chunked

    rows = spark.createDataFrame([(k, 1_700_000_000 + 40 * k) for k in range(50)] + [(99, None)], "id long, s long").select("id", F.timestamp_seconds("s").alias("time"))
    scans = spark.sparkContext.accumulator(0)

    def seen(batches):
        scans.add(1)
        yield from batches

    chunked(spark, rows.coalesce(1).mapInArrow(seen, rows.schema), "time", 500, f"{tmp_path}/in")
    assert scans.value <= 2  # for the bounds, and once for all chunks
    found = spark.read.parquet(f"{tmp_path}/in")
    assert sorted(r.id for r in found.collect()) == list(range(50)) and found.columns == rows.columns
    spans = found.groupBy(F.input_file_name()).agg((F.max(F.unix_seconds("time")) - F.min(F.unix_seconds("time"))).alias("span")).collect()
    assert max(r.span for r in spans) < 500


def test_endpoints_are_linked_by_cells(spark, monkeypatch):
    """Many endpoints near each other: links between cells, not between all pairs; nodes as by force."""
    from trackloom.operators import graph

    rng = np.random.default_rng(13)
    ends = [(k, float(x), float(y), k == 5) for k, (x, y) in enumerate([*rng.uniform(0, 3, (200, 2)), *rng.uniform(0, 60, (60, 2))])] + [(400, None, 1.0, False), (401, float("nan"), 1.0, False)]
    seen, once = [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges: seen.append(edges.count()) or once(edges))
    got = {r.end_id: r.node for r in graph.endpoint_clusters(spark.createDataFrame(ends, "end_id long, x double, y double, accepted boolean"), 2.0).collect()}
    top = {k: k for k, *_ in ends}
    for _ in range(260):
        before = dict(top)
        for a, x, y, _a in ends[:260]:
            top[a] = min(top[b] for b, u, v, _b in ends[:260] if np.hypot(x - u, y - v) <= 2)
        if before == top:
            break
    assert got == top and seen[0] < 400


def test_samples_are_judged_by_cells(spark, monkeypatch):
    """Only samples along the edge of what segments reach are held against segments; the verdicts are those of brute force."""
    rng = np.random.default_rng(17)
    a, s = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 30, (400, 2)))], rng.uniform(3, 12, (60, 2))
    seen, once = [], ranges.near_segments
    monkeypatch.setattr(ranges, "near_segments", lambda p, *rest, **named: seen.append(p.count()) or once(p, *rest, **named))
    segments = spark.createDataFrame([(float(x), float(y), float(x) + 3, float(y) + 4) for x, y in s], "ax double, ay double, bx double, by double")
    got = {r.k: r.ok for r in ranges.within_segments(spark.createDataFrame(a, "k int, x double, y double"), segments, 2.0, "ok", ["k"]).collect()}
    for k, x, y in a:
        u = np.clip(((x - s[:, 0]) * 3 + (y - s[:, 1]) * 4) / 25, 0, 1)
        assert got[k] == bool(np.hypot(x - s[:, 0] - 3 * u, y - s[:, 1] - 4 * u).min() <= 2)
    assert sum(seen) < 100 and 50 < sum(got.values()) < 350


def test_ways_are_compared_at_once(monkeypatch):
    """Many candidates a slice: the ways kept are those of comparing one by one, without a median for each pair of ways."""
    from trackloom.operators import turnouts

    rng = np.random.default_rng(19)
    number = np.repeat(np.arange(40), 8)
    s, t, z, gain = number + rng.integers(0, 30, 320) / 30, rng.integers(1, 51, 320) / 20, rng.integers(0, 9, 320) / 100, 2 + rng.random(320)
    rule = turnouts.Tracing()
    ways = turnouts.Ways(number, s, t, z, gain, rule)
    expected: list[dict] = []
    for end in np.argsort(-ways.total, kind="stable"):
        mine = {int(number[k]): t[k] for k in ways.to(end)}
        alike = lambda o, mine=mine: len(mine.keys() & o) >= 3 and np.median([abs(mine[k] - o[k]) for k in mine.keys() & o]) < rule.alike
        if len(mine) >= rule.least_slices and not any(alike(o) for o in expected) and len(expected) < 96:
            expected.append(mine)
    medians, once = [], np.median
    monkeypatch.setattr(np, "median", lambda *a, **named: medians.append(1) or once(*a, **named))
    for cells in (1 << 18, 500):  # the second: a few ways and slices at a time
        monkeypatch.setattr(turnouts, "CELLS", cells)
        again = turnouts.Ways(number, s, t, z, gain, rule)
        assert (again.back == ways.back).all() and (again.total == ways.total).all()
        assert [{int(number[k]): t[k] for k in way} for way in again.best(96, rule)] == expected
    assert len(expected) > 3 and len(medians) < 200


def test_profile_is_looked_up(spark):
    """The shape of the curve is that of k alone: no window sorts the samples, and lines of one name are apart."""
    from trackloom.operators import curves

    rows = spark.createDataFrame([(1, 0.0, 9.0, 1.0, 5.0), (1, 0.0, 3.0, 2.0, 0.0)], "line_id int, s0 double, s1 double, t0 double, t1 double")
    df = curves.curve_straight_curve(rows, 12, 0.3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    u = np.arange(13) / 12
    head = np.minimum(1, np.minimum(u / 0.3, (1 - u) / 0.3))
    done = np.append(0, np.cumsum((head[1:] + head[:-1]) / 2))
    for line in ((9.0, 1.0, 5.0), (3.0, 2.0, 0.0)):
        got = np.array([r.offset for r in sorted(df.filter(df.s1 == line[0]).collect(), key=lambda r: r.k)])
        assert np.allclose(got, line[1] + (line[2] - line[1]) * done / done[-1], atol=1e-12)
    assert [r.offset for r in curves.curve_straight_curve(rows.limit(1), 1).orderBy("k").collect()] == [1.0, 5.0]


def test_lines_of_a_partition_are_sampled_together(spark):
    """A partition of many lines, cut into small batches, gives what a partition a line gives; lines are never called for one by one."""
    from trackloom.functions import tables

    rng = np.random.default_rng(23)
    rows = [(None if k == 7 else k, q, *map(float, rng.integers(0, 40, 2))) for k in range(60) for q in range(rng.integers(1, 30))] + [(99, q, 3.0, 3.0) for q in range(3)] + [(100, 0, 1.0, 1.0), (100, 1, None, 2.0)]
    spark.createDataFrame(rows, "line_id long, seq int, x double, y double").createOrReplaceTempView("lines_together")
    tables.register(spark, "bigint")
    say = lambda f, by, order, t="lines_together": sorted(((-1 if r.line_id is None else r.line_id, r.k), (r.station, r.x, r.y)) for r in spark.sql(f"SELECT * FROM {f}(TABLE({t}) PARTITION BY {by} ORDER BY {order}, 7.0D)").collect())
    spark.sql("SELECT * FROM lines_together WHERE x IS NOT NULL").createOrReplaceTempView("lines_whole")
    apart, size = say("densify_line", "line_id", "(seq)", "lines_whole"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows_at_once in ("17", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_at_once)
            together = say("densify_lines", "pmod(hash(line_id), 3)", "(line_id, seq)")
            assert [a for a, _ in together] == [a for a, _ in apart]
            assert np.allclose([b for _, b in together], [b for _, b in apart], atol=1e-9)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {a[0] for a, _ in apart} == {k for k in range(60) if k != 7 and sum(r[0] == k for r in rows) > 1} | {-1}


def test_pixels_are_counted_within_tiles(spark):
    """Squares over the borders of tiles, negative places, repeated and null pixels: as by force, and no pixel is multiplied."""
    from trackloom.operators import masks

    rng = np.random.default_rng(29)
    at = [(k, *map(int, p)) for k in (1, 5) for p in rng.integers(-6, 14, (260, 2))]
    df = spark.createDataFrame([*at, *at[:40], (1, None, 3), (None, 2, 3)], "image int, row int, col int")
    for reach, least in ((1, 4), (2, 9), (1, 9)):
        found = masks.crowded(df, reach, least, 4)
        around = range(-reach, reach + 1)
        n = {}
        for k, r, c in set(at):
            for p in ((k, r + i, c + j) for i in around for j in around):
                n[p] = n.get(p, 0) + 1
        assert sorted(map(tuple, found.collect())) == sorted(p for p, m in n.items() if m >= least)
        assert found.dtypes == df.dtypes
    assert "HashAggregate" not in masks.crowded(df, 1, 4)._jdf.queryExecution().executedPlan().toString()


def test_lines_are_rebuilt_once(spark):
    """Each side is read from tables that hold the ends and the rebuilt lines, not worked out anew for each use."""
    from trackloom.operators import evidence

    rows = [(k, float(s), float(k % 3)) for k in range(20) for s in range(0, 30, 3)]
    candidates = spark.createDataFrame(rows, "key int, s double, t double")
    gauges = spark.createDataFrame([(k, s, t + (2.0 if k % 2 else 0.5)) for k, s, t in rows if 3 <= s <= 20], "key int, s double, t double")
    scans = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            scans.add(batch.num_rows)
            yield batch

    got = evidence.constrained(candidates, gauges.coalesce(1).mapInArrow(seen, gauges.schema), ["key"]).collect()
    assert scans.value <= 2 * gauges.count()  # for the ends, and for the lines
    assert {r.kind for r in got} == {"prefix", "gauge", "suffix", "smoothed"} and {r.key for r in got} == set(range(20))


def test_stations_are_written_out_last(spark):
    """Lines of far more stations than samples: no shuffle reads a station, and the offsets are those of stations that are shuffled, whatever lies where."""
    rng = np.random.default_rng(31)
    ends = [(k, float(a), float(a + n)) for k, a, n in zip(range(40), rng.integers(-90, 50, 40), rng.integers(0, 900, 40), strict=True)]
    ends += [(50, 5.0, 5.0), (51, 9.0, 2.0), (52, 0.0, 300.0), (None, 0.0, 90.0)]  # no length, turned round, no samples, no key
    known = [(k, float(s), float(o)) for k in range(40) for s, o in zip(rng.integers(-200, 900, 12), rng.normal(0, 9, 12), strict=True)]
    known += [(k, 37.0, float(o)) for k in range(20) for o in (3, 1, 1)] + [(50, 4.0, 1.0), (50, 5.0, 2.0), (51, 9.0, 3.0), (77, 1.0, 1.0), (3, None, 8.0)]
    rows, samples = spark.createDataFrame(ends, "track int, start double, end double"), spark.createDataFrame(known, "track int, station double, offset double")
    df = lines.profiled(rows, samples, ["track"], 7.0, 9.0, 2.0, 100.0, 30.0, 6.0)
    expected = lines.local_offsets(lines.stations_between(rows, 7.0), samples, ["track"], 9.0, 2.0, 100.0, 30.0, 6.0)
    say = lambda df: sorted(((-1 if r.track is None else r.track, r.k), r.station, r.offset) for r in df.collect())
    assert say(df) == say(expected) and df.count() > 1000
    above = []  # of the plan: how deep each node stands, and what it is
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        deep = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < deep] + [(deep, line)]
        assert "Generate explode" not in line or not any("Exchange" in x for _, x in above[:-1])


def test_samples_without_offset(spark, tmp_path):
    """Missing offsets, at stations too, as the SQL has them."""
    import duckdb

    from trackloom import catalog

    rng = np.random.default_rng(37)
    rows = [(e, int(e % 5), None if rng.random() < 0.5 or e % 5 == 4 else float(rng.normal(250, 150))) for e in rng.choice(6000, 120, False).tolist()]
    rows += [(150 + k * 50, 9, None if k % 2 else 60.0) for k in range(8)] + [(7000, None, 5.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["profiled_lines"](spark, str(tmp_path)).filter("track is not null").collect())
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    expected = sorted(r for r in con.sql(catalog.ORACLE_SQL["profiled_lines"]).fetchall() if r[0] is not None)
    assert [r[:2] for r in got] == [r[:2] for r in expected] and len(got) > 300
    assert np.allclose([r[2] for r in got], [r[2] for r in expected], atol=1e-9)


def test_crossings_are_made_once(spark):
    """Segments over several cells, ends on borders of cells, equal rows: each pair once, by force, without a pass that tells pairs apart."""
    rng = np.random.default_rng(41)
    make = lambda n: [(k, *map(float, rng.integers(-8, 12, 4))) for k in range(n)]
    a, b = make(70), make(60)
    a, b = [*a, *a[:5]], [*b, *b[:3], (90, None, 1.0, 2.0, 3.0)]
    df = ranges.crossings(spark.createDataFrame(a, "id int, ax double, ay double, bx double, by double"), spark.createDataFrame(b, "sid int, cx double, cy double, dx double, dy double"), 4.0)
    assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()
    expected = []
    for i, ax, ay, bx, by in a:
        for j, cx, cy, dx, dy in b[:-1]:
            det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if det and 0 <= ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det <= 1 and 0 <= ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det <= 1:
                expected.append((i, j))
    assert sorted((r.id, r.sid) for r in df.collect()) == sorted(expected) and len(expected) > len(set(expected)) > 300


def test_samples_are_judged_where_they_are_made(spark, monkeypatch):
    """Lines of one to eighty vertices, missing places, repeated vertices, evidence of all kinds and none: what joins of samples say, without a join or a shuffle of samples."""
    from trackloom.operators import support

    rng = np.random.default_rng(43)
    rows = [(k, q, float(x), float(y)) for k in range(60) for q, (x, y) in enumerate(rng.integers(0, 40, (rng.integers(1, 9), 2)) / 2)]
    rows += [(70, q, float(x), float(y)) for q, (x, y) in enumerate(rng.uniform(0, 30, (80, 2)))] + [(71, 0, 1.0, 1.0), (71, 1, None, 5.0), (71, 2, 9.0, 9.0), (71, 3, 9.0, 9.0), (71, 4, 25.0, 9.0)]
    rows += [(72, 0, 3.0, 3.0), (72, 1, 3.0, 3.0), (73, 0, 0.0, 6.0), (73, 1, 8.0, 6.0)]
    vertices = spark.createDataFrame(rows, "line_id long, seq int, x double, y double")
    some = [tuple(map(float, (x, y, x + a, y + b))) for x, y, a, b in rng.integers(-5, 25, (12, 4))] + [(4.0, 4.0, 4.0, 4.0), (2.0, 1.0, 2.0, 9.0), (None, 1.0, 1.0, 1.0)]
    say = lambda df: sorted((r.line_id, round(r.support_ratio, 9), r.n_samples, r.max_unsupported) for r in df.collect())
    for given in (some, some[:2], []):
        evidence = spark.createDataFrame(given, "ax double, ay double, bx double, by double")
        expected = say(lines.support(lines.sampled(vertices, 1.5), evidence, 2.0, 1.5, ["line_id"], distances=False).select("line_id", "support_ratio", "n_samples", "max_unsupported"))
        assert len(expected) > 50
        df = support.of_lines(vertices, evidence, 2.0, 1.5)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert say(df) == expected and "Join" not in plan and "Window" not in plan
        local = vertices.filter("x is not null").orderBy("line_id", "seq").toPandas()
        starts = np.append(np.flatnonzero(local.line_id.diff() != 0), len(local))
        for block in (1 << 18, 7):  # samples, and pairs of a sample and a segment, at once
            monkeypatch.setattr(support, "BLOCK", block)
            _, n, ok, longest = support.judged(local.x.to_numpy(), local.y.to_numpy(), starts, support._reach(evidence, 2.0), 1.5)
            assert len(n) == len(expected)
            keep = [k for k, e in enumerate(expected) if e[0] != 71]  # its missing vertex is left out here
            assert [(n[k], round(ok[k] / n[k], 9), longest[k] * 1.5) for k in keep] == [(e[2], e[1], e[3]) for e in map(expected.__getitem__, keep)]
        monkeypatch.setattr(support, "PAIRS", 1)  # too much to broadcast
        assert say(support.of_lines(vertices, evidence, 2.0, 1.5)) == expected
        monkeypatch.setattr(support, "PAIRS", 1_000_000)


def test_ends_at_one_place_need_no_search(spark, monkeypatch):
    """Ends that share their places with other lines snap there, to the least of them, without a search; a closed line's own end is none, nor is that of a line without a name."""
    searched = []
    for name in ("near_points", "near_segments"):
        once = getattr(lines, name)
        monkeypatch.setattr(lines, name, lambda *a, once=once, **named: searched.append(1) or once(*a, **named))
    ends = [(10 * k + j, k, float(j), 2.5) for k in range(1, 40) for j in (0, 1)] + [(900, 90, 0.0, 2.5)]
    ends += [(910, 91, 1.0, 2.5), (911, 91, 1.0, 2.5), (920, None, 1.0, 2.5), (None, 5, 0.0, 2.5)]
    points = spark.createDataFrame(ends, "point_id int, line_id int, x double, y double")
    segments = spark.createDataFrame([(k, 0.0, 2.5, 1.0, 2.5) for k in range(1, 40)], "line_id int, ax double, ay double, bx double, by double")
    got = {r.point_id: tuple(r)[1:] for r in lines.snap_targets(points, segments, points.select("line_id", "x", "y"), 1.0).collect()}
    assert got == {p: (True, 0.0, 1 if line != 1 else 2, x, y) for p, line, x, y in ends if p is not None and line is not None} and not searched
    alone = spark.createDataFrame([(1, 7, 5.0, 5.0), (2, 7, 5.0, 5.0), (3, 8, None, 5.0), (4, 9, float("nan"), 5.0)], points.schema)
    assert lines.snap_targets(alone, segments, alone.select("line_id", "x", "y"), 1.0).count() == 0 and searched


def test_few_points_are_looked_up_by_their_cells(spark, monkeypatch):
    """Pairs of points, and of points and segments, where only cells with points are looked at: those of looking everywhere, on borders of cells too, beyond what is broadcast too."""
    rng = np.random.default_rng(53)
    a = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-20, 21, (60, 2)) / 2)] + [(70, None, 1.0), (71, float("nan"), 1.0)]
    b = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-20, 21, (200, 2)) / 2)] + [(300, None, 1.0)]
    s = [(f"s{k}", *map(float, v)) for k, v in enumerate(rng.integers(-14, 15, (90, 4)))] + [("up", 3.0, -9.0, 3.0, 9.0), ("dot", 2.0, 2.0, 2.0, 2.0), ("none", None, 1.0, 2.0, 2.0), ("long", -1e5, -1e5, 1e5, 1e5)]
    p, t = spark.createDataFrame(a, "id int, x double, y double"), spark.createDataFrame(b, "sid int, tx double, ty double")
    g = spark.createDataFrame(s, "name string, ax double, ay double, bx double, by double")
    pairs = sorted((i, j) for i, x, y in a[:60] for j, u, v in b[:200] if np.hypot(x - u, y - v) <= 1.5)
    near = sorted((r.id, r["name"], r.distance, r.share) for r in ranges.near_segments(p, g.filter("name <> 'long'"), 1.5).collect())
    for most in (1_000_000, 3):
        monkeypatch.setattr(ranges, "LOOKED_UP", most)
        assert sorted((r.id, r.sid) for r in ranges.near_points(p, t, 1.5, occupied=True).select("id", "sid").collect()) == pairs
        monkeypatch.setattr(ranges, "FEW", most)
        found = sorted((r.id, r["name"], r.distance, r.share) for r in ranges.near_segments(p, g, 1.5, occupied=True).collect())
        assert [f for f in found if f[1] != "long"] == near and {f[0] for f in found if f[1] == "long"} == {k for k, x, y in a[:60] if abs(x - y) / 2**0.5 <= 1.5}
    assert len(pairs) > 100 < len(near)
