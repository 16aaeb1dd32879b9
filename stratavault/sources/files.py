"""Files of an archive through pyarrow's file systems (local, mounted, HDFS, object stores)."""

from __future__ import annotations

import os

from pyarrow import fs


def split(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def exists(uri: str) -> bool:
    system, path = split(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def size(uri: str) -> int:
    system, path = split(uri)
    return system.get_file_info(path).size or 0


def listed(uri: str, suffix: str) -> list[tuple[str, int, float]]:
    """(path, size, time) of the files below a folder whose names end so, sorted; none if it is missing."""
    system, path = split(uri)
    infos = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((i.path, i.size, i.mtime.timestamp() if i.mtime else 0.0) for i in infos if i.is_file and i.path.endswith(suffix))


def make_parent(uri: str) -> None:
    system, path = split(uri)
    system.create_dir(os.path.dirname(path), recursive=True)


def install(uri: str, final: str) -> None:
    """Give a finished file its name; fails if that name is taken."""
    system, path = split(uri)
    _, target = split(final)
    if isinstance(system, fs.LocalFileSystem):
        os.link(path, target)  # fails where the target exists
        os.unlink(path)
        return
    if system.get_file_info(target).type != fs.FileType.NotFound:
        raise FileExistsError(target)
    system.move(path, target)


def replace(uri: str, final: str, size: int) -> None:
    """Put a file in the place of another that still has ``size`` bytes."""
    system, path = split(uri)
    _, target = split(final)
    if system.get_file_info(target).size != size:
        raise FileExistsError(f"{target} has changed")
    system.move(path, target)


def remove(uri: str) -> None:
    system, path = split(uri)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(path)
