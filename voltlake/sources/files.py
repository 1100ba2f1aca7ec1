"""Files by Arrow's file systems: local and mounted folders, HDFS (with its client library), S3 and GCS; ranged reads of all."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs


@dataclass(frozen=True)
class File:
    path: str
    length: int
    modified: float


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the place there; Hadoop's spelling (file:/a/b) is taken as well."""
    local = re.match(r"(?:file:)?(/.*)", path)
    if local:
        return fs.LocalFileSystem(), re.sub("^/+", "/", local[1])
    return fs.FileSystem.from_uri(quote(path, safe=":/@?=&+,-._~%"))


def walk(paths: Iterable[str], pattern: str) -> list[File]:
    """Files under folders (or named themselves) whose names match, by path; names alone are looked at."""
    found: dict[str, File] = {}
    for path in paths:
        files, place = open_fs(path)
        prefix = path[: path.index(place)] if "://" in path and place in path else "file:" if isinstance(files, fs.LocalFileSystem) else path.split(place)[0]
        info = files.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        each = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(place, recursive=True))
        for i in each:
            if i.type == fs.FileType.File and re.search(pattern, i.path.lower()):
                name = f"file:{i.path}" if isinstance(files, fs.LocalFileSystem) else prefix + i.path
                found[name] = File(name, i.size, i.mtime.timestamp() if i.mtime else 0.0)
    return [found[p] for p in sorted(found)]
