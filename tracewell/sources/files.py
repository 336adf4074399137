"""Small files and file names by the file system that a path is of: a local one, or a URI of a store that Arrow can open."""

from __future__ import annotations

import fnmatch
import os
import posixpath

from pyarrow import fs


def _store(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path inside it, and what stands before it in the URI."""
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path), ""
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"


def open_binary(path: str):
    """A file to seek and read in."""
    if "://" not in path or path.startswith("file://"):
        return open(path.removeprefix("file://"), "rb")
    store, inner, _ = _store(path)
    return store.open_input_file(inner)


def read_text(path: str) -> str:
    with open_binary(path) as f:
        return f.read().decode("utf-8", errors="replace")


def is_file(path: str) -> bool:
    store, inner, _ = _store(path)
    return store.get_file_info(inner).type == fs.FileType.File


def file_size(path: str) -> int:
    store, inner, _ = _store(path)
    return store.get_file_info(inner).size


def folders_above(path: str) -> list[str]:
    """The folder of a file and those above it, nearest first, in the form of the path."""
    _, inner, lead = _store(path)
    found = [posixpath.dirname(inner)]
    while posixpath.dirname(found[-1]) != found[-1]:
        found.append(posixpath.dirname(found[-1]))
    return [lead + f for f in found]


def find(pattern: str) -> list[str]:
    """The files of a pattern with * and ?, in which no * stands for a slash; a path without them is itself."""
    store, inner, lead = _store(pattern)
    parts = inner.split("/")
    fixed = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), None)
    if fixed is None:
        return [pattern]
    root = "/".join(parts[:fixed]) or "/"
    listed = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=fixed < len(parts) - 1))
    whole = [f.path for f in listed if f.type == fs.FileType.File]
    return [lead + f for f in whole if f.count("/") == inner.count("/") and all(fnmatch.fnmatchcase(a, b) for a, b in zip(f.split("/"), parts, strict=True))]
