"""LAS files that the tests write themselves, read by ranges of records and with pushed bounds."""

import os
import struct

import numpy as np
import pytest

from trackloom.sources import las, readers


def write(path, points, version=(1, 2), form=3, scale=0.001, legacy=True, claim=None):
    """A LAS file of integer coordinates times scale; form 3 has colours, 6 and 7 the longer records of 1.4."""
    size = {0: 20, 3: 34, 6: 30, 7: 36}[form]
    head = bytearray(375 if version >= (1, 4) else 227)
    head[:4] = b"LASF"
    head[24], head[25] = version
    struct.pack_into("<H", head, 94, len(head))
    struct.pack_into("<I", head, 96, len(head))
    head[104] = form
    struct.pack_into("<H", head, 105, size)
    struct.pack_into("<I", head, 107, len(points) if legacy else 0)
    struct.pack_into("<3d", head, 131, scale, scale, scale)
    struct.pack_into("<3d", head, 155, 0, 0, 0)
    p = np.asarray(points) * scale
    struct.pack_into("<6d", head, 179, *(x for k in range(3) for x in ((p[:, k].max(), p[:, k].min()) if len(p) else (0.0, 0.0))))
    if version >= (1, 4):
        struct.pack_into("<Q", head, 247, len(points))
    raw = np.zeros((len(points), size), np.uint8)
    for k in range(3):
        raw[:, 4 * k : 4 * k + 4] = np.asarray(points, "<i4")[:, k].copy().view(np.uint8).reshape(-1, 4)
    raw[:, 12:14] = np.arange(len(points), dtype="<u2").view(np.uint8).reshape(-1, 2)
    raw[:, 16 if form >= 6 else 15] = 0x42
    if form in (3, 7):
        raw[:, las.COLOUR[form] + 2 : las.COLOUR[form] + 4] = np.full(len(points), 2000, "<u2").view(np.uint8).reshape(-1, 2)
    path.write_bytes(bytes(head) + raw.tobytes())


@pytest.fixture
def cloud(tmp_path):
    r = np.random.default_rng(1)
    out = []
    for k in range(3):
        p = np.column_stack([r.integers(k * 100_000, k * 100_000 + 50_000, 700), r.integers(0, 50_000, 700), r.integers(0, 9000, 700)])
        folder = tmp_path / f"d{k}"
        folder.mkdir()
        write(folder / f"t{k}.LAS", p, *[((1, 2), 3), ((1, 4), 6), ((1, 4), 7)][k], legacy=k == 0)
        out.append(p)
    return tmp_path, np.vstack(out) * 0.001


def test_all_points_in_many_tasks(spark, cloud):
    path, points = cloud
    df = las.las_points(spark, str(path), part_bytes=3400)
    assert df.rdd.getNumPartitions() >= 3 * 6
    got = np.array(sorted((r.x, r.y, r.z) for r in df.collect()))
    assert np.allclose(got, np.array(sorted(map(tuple, points))))
    kinds = {(os.path.basename(r.source_path), r.classification, r.green) for r in df.collect()}
    assert kinds == {("t0.LAS", 2, 2000), ("t1.LAS", 0x42, None), ("t2.LAS", 0x42, 2000)}


def test_bounds_reach_the_files(spark, cloud):
    path, points = cloud
    (path / "d1" / "t1.LAS").write_bytes((path / "d1" / "t1.LAS").read_bytes()[:400])  # its records are gone, its header is not
    df = las.las_points(spark, str(path)).filter("x >= 200 and x < 230 and y = y and z > 1")
    p = points
    assert df.count() == int(((p[:, 0] >= 200) & (p[:, 0] < 230) & (p[:, 2] > 1)).sum()) > 10
    with pytest.raises(Exception, match="ends before its 700 records"):
        las.las_points(spark, str(path)).filter("x > 90").count()
    assert las.las_points(spark, str(path)).filter("x > 1000").rdd.getNumPartitions() in (0, 1)


def test_headers(spark, cloud):
    path, points = cloud
    got = {os.path.basename(r.path): r for r in las.las_headers(spark, str(path)).collect()}
    assert [got[f"t{k}.LAS"].n for k in range(3)] == [700] * 3  # also where the field of before 1.4 is 0
    assert [got[f"t{k}.LAS"].has_rgb for k in range(3)] == [True, False, True]
    assert got["t1.LAS"].x_min == pytest.approx(points[700:1400, 0].min()) and got["t1.LAS"].version == "1.4"
    kept = readers.pruned(las.las_headers(spark, str(path)), 100, 160, 0, 100)
    assert [os.path.basename(p) for p in kept] == ["t1.LAS"]


def test_odd_files(spark, tmp_path):
    write(tmp_path / "none.las", np.zeros((0, 3), int))
    assert las.las_points(spark, str(tmp_path)).count() == 0
    (tmp_path / "no.las").write_bytes(b"x" * 400)
    with pytest.raises(Exception, match="no LAS file"):
        las.las_points(spark, str(tmp_path)).count()
    with pytest.raises(Exception):
        las.las_points(spark, str(tmp_path / "missing")).count()


def test_more_than_two_gigabytes(spark, tmp_path):
    """A sparse file: 80 million records of 34 bytes, zeros but for the last."""
    path, n = tmp_path / "big.las", 80_000_000
    write(path, [(0, 0, 0), (5_000_000, 1, 1)])
    with open(path, "r+b") as f:
        f.seek(107)
        f.write(struct.pack("<I", n))
        f.seek(227 + (n - 1) * 34)
        f.write(struct.pack("<3i", 5_000_000, 1, 1) + bytes(22))
    assert os.path.getsize(path) > 2**31
    df = las.las_points(spark, str(tmp_path)).filter("x > 1")
    assert df.rdd.getNumPartitions() > 30
    assert [(r.x, r.source_path.endswith("big.las")) for r in df.collect()] == [(5000.0, True)] * 2  # the second record is still there
