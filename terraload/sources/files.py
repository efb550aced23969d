"""File access from tasks: any storage that ``pyarrow.fs`` can open."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import batched

from pyarrow import fs

# Bytes that a task takes where a reader's ranges are shorter.
TASK_BYTES = 1 << 20


def resolve(path: str):
    """Split a Spark path into a file system and the path inside it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), path


def open_input(path: str):
    """Open a file for random access; the handle works with ``zipfile`` and ``seek``."""
    filesystem, inner = resolve(path)
    return filesystem.open_input_file(inner)


def read_range(handle, start: int, length: int) -> bytes:
    handle.seek(start)
    return handle.read(length)


def list_folder(path: str, recursive: bool = False) -> list[tuple[str, bool, int]]:
    """``(path, is a folder, size)`` of what lies in a folder, or of the file itself, sorted."""
    filesystem, inner = resolve(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = filesystem.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, False, info.size)]
    found = filesystem.get_file_info(fs.FileSelector(inner, recursive=recursive))
    return sorted((prefix + f.path, f.type == fs.FileType.Directory, f.size or 0) for f in found)


def folder_entries(path: str) -> Iterator[tuple[str, bool]]:
    """``(path, is a folder)`` of what lies in a folder, as it is found; on a local disk a folder of any size is never held.

    Names that begin with a dot or an underscore are left out, as by Spark's readers: files being written have such names.
    """
    filesystem, inner = resolve(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if isinstance(filesystem, fs.LocalFileSystem):
        with os.scandir(inner) as found:
            yield from ((prefix + f.path, f.is_dir()) for f in found if not f.name.startswith((".", "_")))
    else:
        found = filesystem.get_file_info(fs.FileSelector(inner))
        yield from ((prefix + f.path, f.type == fs.FileType.Directory) for f in found if not f.base_name.startswith((".", "_")))


def walk_files(path: str) -> Iterator[str]:
    """Files below a folder, as they are found."""
    folders = [path]
    while folders:
        for found, is_folder in folder_entries(folders.pop()):
            if is_folder:
                folders.append(found)
            else:
                yield found


def list_files(path: str) -> list[tuple[str, int]]:
    """Files below ``path`` (or the file itself) with sizes, sorted by name."""
    return [(p, size) for p, is_folder, size in list_folder(path, recursive=True) if not is_folder]


def file_size(path: str) -> int | None:
    """Size in bytes, or None when there is no such file."""
    filesystem, inner = resolve(path)
    info = filesystem.get_file_info(inner)
    return info.size if info.type == fs.FileType.File else None


def delete_folder(path: str) -> int:
    """Delete a folder with all in it; returns 0 when there is none."""
    filesystem, inner = resolve(path)
    inner = inner.rstrip("/")
    if filesystem.get_file_info(inner).type != fs.FileType.Directory:
        return 0
    filesystem.delete_dir(inner)
    return 1


def delete_file(path: str) -> int:
    """Delete a file; returns 0 when there is none."""
    filesystem, inner = resolve(path)
    if filesystem.get_file_info(inner).type != fs.FileType.File:
        return 0
    filesystem.delete_file(inner)
    return 1


def sibling(path: str, suffix: str) -> str | None:
    """The side-car of ``path`` with another suffix, in small or capital letters."""
    stem = path[: path.rindex(".")]
    for candidate in (stem + suffix, stem + suffix.upper()):
        if file_size(candidate) is not None:
            return candidate
    return None


@contextmanager
def passing_folder(path: str):
    """A folder below ``path`` for the passing files of one task, deleted at the end.

    Tasks that write many files into one folder otherwise wait for each other, longer the more files it has.
    """
    filesystem, inner = resolve(path)
    passing = f"{inner}/.{uuid.uuid4().hex}"
    filesystem.create_dir(passing, recursive=True)
    try:
        yield passing
    finally:
        filesystem.delete_dir(passing)


@contextmanager
def publish_file(path: str, passing: str | None = None):
    """Write a file under a passing name and rename it, so retried tasks leave no halves; ``passing`` comes from ``passing_folder``."""
    filesystem, inner = resolve(path)
    folder = inner.rsplit("/", 1)[0]
    filesystem.create_dir(folder, recursive=True)
    passing = f"{passing or folder}/.{uuid.uuid4().hex}.part"
    with filesystem.open_output_stream(passing) as out:
        yield out
    filesystem.move(passing, inner)


def pack_ranges(lengths: list[tuple[str, int, float]], limit: int) -> list[list[tuple[str, int, int]]]:
    """Cut long files into ranges and pack short ones together.

    A file has a length in units (bytes or records) and the bytes of one unit; a pack holds
    about ``limit`` bytes.
    """
    packs: list[list[tuple[str, int, int]]] = []
    current: list[tuple[str, int, int]] = []
    filled = 0.0
    for path, length, unit_bytes in lengths:
        step = max(1, int(limit / max(unit_bytes, 1e-9)))
        for start in range(0, max(length, 1), step):
            end = min(start + step, length)
            weight = (end - start) * unit_bytes
            if current and filled + weight > limit:
                packs.append(current)
                current, filled = [], 0.0
            current.append((path, start, end))
            filled += weight
    if current:
        packs.append(current)
    return packs


def task_packs(packs: list[list[tuple[str, int, int]]], limit: int) -> list[list[tuple[str, int, int]]]:
    """Packs of ``limit`` bytes put together for tasks of about ``TASK_BYTES``; the ranges in them stay as they are.

    A task takes longer to start than to read many short ranges, so short ranges must not each be a task.
    """
    return [[r for pack in group for r in pack] for group in batched(packs, max(1, TASK_BYTES // max(limit, 1)))]
