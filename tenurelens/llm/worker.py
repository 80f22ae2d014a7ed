"""What a Python worker keeps between tasks, and files it shares with other machines."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """One value per worker process. Code shipped by value loses its globals with each task."""
    store = sys.modules.setdefault("_tenurelens_kept", types.ModuleType("_tenurelens_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``; at its end the worker, which stays for later stages, hands freed memory back to its machine."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    # only glibc keeps freed memory this way and has a call for it
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder given as URI or absolute path (file, hdfs, s3, gs)."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[len("file:") :].lstrip("/")
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


class Committed:
    """A file that appears under its name only when it is complete.

    A task that is repeated writes the same bytes again; the attempt's own
    temporary name keeps two attempts apart, and the last rename wins.
    """

    def __init__(self, folder: str, name: str, attempt: int):
        self.system, base = file_system(folder)
        self.system.create_dir(base, recursive=True)
        self.path, self.part = f"{base}/{name}", f"{base}/.{name}.{attempt}"
        self.out = self.system.open_output_stream(self.part, compression=None)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def commit(self) -> None:
        self.out.close()
        self.system.move(self.part, self.path)


def read_range(folder: str, name: str, start: int, length: int) -> bytes:
    system, base = file_system(folder)
    with system.open_input_file(f"{base}/{name}") as f:
        return f.read_at(length, start)
