"""Raster files that the tests write themselves, against numpy."""

import struct
import zlib

import numpy as np
import pytest

from trackloom.sources import rasters


def tiff(path, a, order="<", block=None, rows=None, deflate=False, predictor=1, planar=False, big=False, nodata=None, alpha=False, geo=None):
    """A TIFF of the array (height, width, bands): tiles of `block`, else strips of `rows`."""
    a = a.astype(a.dtype.newbyteorder(order))
    h, w, n = a.shape
    bh, bw = block or (rows or h, w)
    blocks, layers = [], [a[:, :, k : k + 1] for k in range(n)] if planar else [a]
    for layer in layers:
        for r in range(0, h, bh):
            for c in range(0, w, bw):
                part = layer[r : r + bh, c : c + bw]
                if block:
                    part = np.pad(part, ((0, bh - part.shape[0]), (0, bw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1).astype(a.dtype)
                blocks.append(zlib.compress(part.tobytes()) if deflate else part.tobytes())
    at, offsets = 16, []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    long = (16, "Q") if big else (4, "I")
    tags = [(256, 3, "H", [w]), (257, 3, "H", [h]), (258, 3, "H", [a.dtype.itemsize * 8] * n), (259, 3, "H", [8 if deflate else 1]), (277, 3, "H", [n]), (284, 3, "H", [2 if planar else 1]), (317, 3, "H", [predictor]), (339, 3, "H", [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]] * n)]
    tags += [(322, 3, "H", [bw]), (323, 3, "H", [bh]), (324, *long, offsets), (325, *long, [len(b) for b in blocks])] if block else [(273, *long, offsets), (278, 3, "H", [bh]), (279, *long, [len(b) for b in blocks])]
    if nodata is not None:
        tags.append((42113, 2, "s", [str(nodata).encode() + b"\0"]))
    if alpha:
        tags.append((338, 3, "H", [2]))
    if geo:
        tags += [(33550, 12, "d", [geo[0], geo[1], 0]), (33922, 12, "d", [0, 0, 0, geo[2], geo[3], 0]), (34735, 3, "H", [1, 1, 0, 1, 3072, 0, 1, geo[4]])]
    tags.sort()
    room, entry = (8, 20) if big else (4, 12)
    directory = at
    extra, body = directory + (8 if big else 2) + len(tags) * entry + room, b""
    out = struct.pack(order + ("Q" if big else "H"), len(tags))
    for tag, kind, code, values in tags:
        data = values[0] if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
        out += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, len(data) if code == "s" else len(values))
        if len(data) <= room:
            out += data.ljust(room, b"\0")
        else:
            out += struct.pack(order + ("Q" if big else "I"), extra + len(body))
            body += data
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, directory) if big else struct.pack(order + "HI", 42, directory))
    path.write_bytes(head.ljust(16, b"\0") + b"".join(blocks) + out + bytes(room) + body)


def png(path, a, colour, depth, kinds, palette=None):
    """A PNG of packed rows (height, bytes), row k filtered by kinds[k % len(kinds)]."""
    bpp = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * depth // 8)
    out, above = b"", np.zeros(a.shape[1], int)
    for k, row in enumerate(a.astype(int)):
        left, corner = np.concatenate([np.zeros(bpp, int), row[:-bpp]]), np.concatenate([np.zeros(bpp, int), above[:-bpp]])
        p = left + above - corner
        d = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        paeth = np.choose(d.argmin(axis=0), [left, above, corner])
        kind = kinds[k % len(kinds)]
        out += bytes([kind]) + ((row - [0, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    head = struct.pack(">IIBBBBB", a.shape[1] * 8 // (bands * depth), a.shape[0], depth, colour, 0, 0, 0)
    packed = zlib.compress(out)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b""))


def grid(df):
    """(rows, columns, array) of a pixel table that forms a grid."""
    got = df.select("row", "col", "bands").collect()
    rows, cols = sorted({r.row for r in got}), sorted({r.col for r in got})
    assert len(got) == len(rows) * len(cols)
    out = np.zeros((len(rows), len(cols), len(got[0].bands)))
    for r in got:
        out[rows.index(r.row), cols.index(r.col)] = r.bands
    return rows, cols, out


KINDS = [
    ("u1", 3, {"rows": 7}), ("u2", 1, {"rows": 5, "deflate": True, "predictor": 2, "order": ">"}), ("f4", 1, {"block": (16, 16), "deflate": True}),
    ("i2", 2, {"block": (16, 32), "planar": True, "order": ">"}), ("u1", 4, {"block": (16, 16), "predictor": 2, "deflate": True, "big": True}), ("f8", 2, {"rows": 64, "planar": True}),
]


@pytest.mark.parametrize(("kind", "bands", "how"), KINDS)
def test_tiff_window_and_steps(spark, tmp_path, kind, bands, how):
    r = np.random.default_rng(3)
    a = (r.normal(size=(43, 50, bands)) * 100).astype(kind) if kind[0] == "f" else r.integers(0, 250, (43, 50, bands)).astype(kind)
    tiff(tmp_path / "a.tif", a, **how)
    _, _, whole = grid(rasters.pixels(spark, str(tmp_path), partBytes=1000))
    assert np.array_equal(whole, a)
    rows, cols, part = grid(rasters.pixels(spark, str(tmp_path / "a.tif"), row=5, col=9, height=30, width=31, step=3))
    assert np.array_equal(part, a[5:35:3, 9:40:3]) and rows[0] == 5 and cols[-1] == 39
    _, _, pushed = grid(rasters.pixels(spark, str(tmp_path)).filter("row >= 10 and row < 20 and col = 17"))
    assert np.array_equal(pushed, a[10:20, 17:18])


def test_only_blocks_of_the_window_are_read(spark, tmp_path):
    a = np.arange(64 * 64).reshape(64, 64, 1).astype("u2")
    tiff(tmp_path / "a.tif", a, block=(16, 16))
    data = bytearray((tmp_path / "a.tif").read_bytes())
    data[16 : 16 + 512] = b"\xff" * 512  # the first block is spoiled
    (tmp_path / "a.tif").write_bytes(bytes(data))
    df = rasters.pixels(spark, str(tmp_path), partBytes=1).filter("row >= 16")
    assert df.rdd.getNumPartitions() == 12 and np.array_equal(grid(df)[2], a[16:])


def test_masks(spark, tmp_path):
    a = np.arange(30).reshape(5, 6, 1).astype("f4")
    for name, how, valid in (("n", {"nodata": 7.0}, a[:, :, 0] != 7), ("no", {}, np.ones((5, 6), bool))):
        tiff(tmp_path / f"{name}.tif", a, **how)
        got = rasters.pixels(spark, str(tmp_path / f"{name}.tif")).collect()
        assert all(r.valid == valid[r.row, r.col] for r in got) and len(got) == 30
    b = np.dstack([a[:, :, 0], a[:, :, 0] % 2]).astype("u1")
    tiff(tmp_path / "alpha.tif", b, alpha=True)
    assert all(r.valid == bool(r.row * 6 + r.col & 1) for r in rasters.pixels(spark, str(tmp_path / "alpha.tif")).collect())
    c = a.copy()
    c[2, 3] = np.nan
    tiff(tmp_path / "nan.tif", c, nodata="nan")
    assert [(r.row, r.col) for r in rasters.pixels(spark, str(tmp_path / "nan.tif")).filter("not valid").collect()] == [(2, 3)]


def test_headers(spark, tmp_path):
    tiff(tmp_path / "a.tif", np.zeros((40, 60, 3), "u1"), geo=(0.5, 0.25, 1000.0, 2000.0, 32650), nodata=0)
    h = rasters.raster_headers(spark, str(tmp_path)).first()
    assert (h.width, h.height, h.bands, h.dtype, h.nodata, h.epsg, h.transform) == (60, 40, 3, "u1", 0.0, 32650, [0.5, 0.0, 1000.0, 0.0, -0.25, 2000.0])
    assert (h.x_min, h.y_min, h.x_max, h.y_max) == (1000.0, 1990.0, 1030.0, 2000.0)


@pytest.mark.parametrize(("colour", "depth", "bands"), [(0, 8, 1), (2, 8, 3), (6, 8, 4), (4, 8, 2), (0, 16, 1), (0, 1, 1), (3, 8, 1), (3, 4, 1)])
def test_png(spark, tmp_path, colour, depth, bands):
    r = np.random.default_rng(colour + depth)
    values = r.integers(0, 2 ** min(depth, 4) if colour == 3 else 2**depth, (11, 16, bands))
    if depth == 16:
        rows = values.astype(">u2").reshape(11, -1).view(np.uint8)
    elif depth == 8:
        rows = values.astype(np.uint8).reshape(11, -1)
    else:
        bits = (values.reshape(11, -1, 1) >> np.arange(depth - 1, -1, -1)) & 1
        rows = np.packbits(bits.reshape(11, -1).astype(np.uint8), axis=1)
    palette = r.integers(0, 256, (16, 3)).astype(np.uint8) if colour == 3 else None
    png(tmp_path / "m.png", rows, colour, depth, [0, 1, 2, 3, 4], palette)
    expected = palette[values[:, :, 0]] if colour == 3 else values
    assert np.array_equal(grid(rasters.pixels(spark, str(tmp_path)))[2], expected)
    _, _, part = grid(rasters.pixels(spark, str(tmp_path), row=1, height=8, step=2).filter("col < 5"))
    assert np.array_equal(part, expected[1:9:2, :5:2])


def test_odd_files(spark, tmp_path):
    tiff(tmp_path / "a.tif", np.zeros((4, 4, 1), "u1"))
    assert rasters.pixels(spark, str(tmp_path), row=10).count() == 0
    (tmp_path / "b.png").write_bytes(b"no")
    with pytest.raises(Exception, match="no TIFF or PNG"):
        rasters.pixels(spark, str(tmp_path)).count()
