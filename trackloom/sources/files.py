"""Files that a data source reads by byte ranges, in any store that Arrow opens (local, HDFS, S3, GCS)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def listed(path: str, *endings: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder with one of these endings, by path."""
    store, place = opened(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    root = path[: len(path) - len(place)]
    found = store.get_file_info(fs.FileSelector(place, recursive=True))
    return sorted((root + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(endings))


def piece(path: str, start: int, size: int) -> bytes:
    store, place = opened(path)
    with store.open_input_file(place) as f:
        return f.read_at(size, start)


def heads(paths: list[str], size: int, threads: int = 32) -> list[bytes]:
    """The first bytes of each file."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda p: piece(p, 0, size), paths))
