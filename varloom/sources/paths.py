"""Files outside Spark's own readers, by Arrow's file systems: local paths, file:, hdfs:, s3: and the like."""
from __future__ import annotations

import re

from pyarrow import fs


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; file:/x and file:///x are one."""
    if re.match(r"file:/", path):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(path: str, ending: str = "") -> list[tuple[str, int]]:
    """(path within its file system, bytes) of a file, or of a folder's files with the ending; hidden ones are left out."""
    system, inner = system_of(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(inner, info.size)]
    found = [f for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File]
    return sorted((f.path, f.size) for f in found if f.base_name[0] not in "._" and f.base_name.endswith(ending))
