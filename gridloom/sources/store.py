"""Key-value stores under arrays: a directory tree, a zip archive, memory, and a registry for more.

Keys are relative paths. Object stores and HDFS are file systems by URI; the Parquet
chunk table works on any path that Spark can read.
"""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

from ..spec import ArrayError


class Store(Protocol):
    def get(self, key: str) -> bytes | None: ...
    def put(self, key: str, data: bytes) -> None: ...
    def delete(self, key: str) -> None: ...
    def keys(self) -> Iterator[str]: ...
    def exists(self) -> bool: ...


def local_path(path: str) -> Path:
    """The path in a file URI, which Hadoop writes with one slash and others with three."""
    return Path(path.removeprefix("file://").removeprefix("file:"))


class DirectoryStore:
    """Files below a directory; a write replaces a file at once, so readers see the old or the new one."""

    def __init__(self, path: str):
        self.root = local_path(path)

    def get(self, key: str) -> bytes | None:
        try:
            return (self.root / key).read_bytes()
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
            return None

    def put(self, key: str, data: bytes) -> None:
        at = self.root / key
        at.parent.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(dir=at.parent, prefix=".part-")
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            os.replace(name, at)
        except BaseException:
            Path(name).unlink(missing_ok=True)
            raise

    def delete(self, key: str) -> None:
        (self.root / key).unlink(missing_ok=True)

    def keys(self) -> Iterator[str]:
        for base, _, files in os.walk(self.root):
            for f in files:
                if not f.startswith(".part-"):
                    yield str((Path(base) / f).relative_to(self.root))

    def exists(self) -> bool:
        return self.root.is_dir()


class ZipStore:
    """A zip archive; writes append, and the last entry of a name counts."""

    def __init__(self, path: str):
        self.path = local_path(path)

    def get(self, key: str) -> bytes | None:
        if not self.path.exists():
            return None
        with zipfile.ZipFile(self.path) as z:
            try:
                return z.read(key)
            except KeyError:
                return None

    def put(self, key: str, data: bytes) -> None:
        self.put_all({key: data})

    def put_all(self, items: dict[str, bytes]) -> None:
        """One rewrite for many entries."""
        old = {}
        if self.path.exists():
            with zipfile.ZipFile(self.path) as z:
                old = {n: z.read(n) for n in z.namelist()}
        self._write(old | items)

    def _write(self, items: dict[str, bytes]) -> None:
        part = self.path.with_name(f".part-{self.path.name}")
        with zipfile.ZipFile(part, "w", zipfile.ZIP_STORED) as z:
            for k in sorted(items):
                z.writestr(k, items[k])
        os.replace(part, self.path)

    def delete(self, key: str) -> None:
        if self.path.exists():
            with zipfile.ZipFile(self.path) as z:
                items = {n: z.read(n) for n in z.namelist() if n != key}
            self._write(items)

    def keys(self) -> Iterator[str]:
        if self.path.exists():
            with zipfile.ZipFile(self.path) as z:
                yield from dict.fromkeys(z.namelist())

    def exists(self) -> bool:
        return self.path.exists()


class MemoryStore:
    """A dictionary of this process, by name."""

    _all: dict[str, dict[str, bytes]] = {}
    _lock = threading.Lock()

    def __init__(self, path: str):
        with self._lock:
            self.data = self._all.setdefault(path, {})

    def get(self, key: str) -> bytes | None:
        return self.data.get(key)

    def put(self, key: str, data: bytes) -> None:
        self.data[key] = data

    def delete(self, key: str) -> None:
        self.data.pop(key, None)

    def keys(self) -> Iterator[str]:
        yield from list(self.data)

    def exists(self) -> bool:
        return bool(self.data)


class FileSystemStore:
    """Objects below a URI of a file system that pyarrow knows (s3, gs, abfs, hdfs, file); every executor reaches the same ones.

    An object appears when its stream is closed. ``keys`` lists all pages of a listing.
    """

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path)
        self._file = fs.FileType.File
        self._selector = fs.FileSelector

    def get(self, key: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(f"{self.root}/{key}") as f:
                return f.read()
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
            return None
        except OSError:
            if self.fs.get_file_info(f"{self.root}/{key}").type == self._file:
                raise
            return None

    def put(self, key: str, data: bytes) -> None:
        at = f"{self.root}/{key}"
        self.fs.create_dir(at.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(at) as f:
            f.write(data)

    def delete(self, key: str) -> None:
        try:
            self.fs.delete_file(f"{self.root}/{key}")
        except FileNotFoundError:
            pass

    def keys(self) -> Iterator[str]:
        for info in self.fs.get_file_info(self._selector(self.root, allow_not_found=True, recursive=True)):
            if info.type == self._file:
                yield info.path[len(self.root) :].lstrip("/")

    def exists(self) -> bool:
        return next(self.keys(), None) is not None


class FaultyStore:
    """For tests: a store that fails on chosen operations, and counts calls."""

    def __init__(self, inner: Store, fail_on: tuple[str, ...] = ()):
        self.inner, self.fail_on, self.calls = inner, fail_on, {}

    def _do(self, name: str, *args):
        self.calls[name] = self.calls.get(name, 0) + 1
        if name in self.fail_on:
            raise ArrayError("storage_failed", name)
        return getattr(self.inner, name)(*args)

    def get(self, key):
        return self._do("get", key)

    def put(self, key, data):
        return self._do("put", key, data)

    def delete(self, key):
        return self._do("delete", key)

    def keys(self):
        return self._do("keys")

    def exists(self):
        return self._do("exists")


_STORES: dict[str, Callable[[str], Store]] = {"directory": DirectoryStore, "zip": ZipStore, "memory": MemoryStore, "filesystem": FileSystemStore}


def register(name: str, factory: Callable[[str], Store], force: bool = False) -> None:
    if name in _STORES and not force:
        raise ArrayError("already_registered", name)
    _STORES[name] = factory


def unregister(name: str) -> None:
    _STORES.pop(name, None)


def registered() -> list[str]:
    return sorted(_STORES)


def kind_of(path: str, backend: str | None = None) -> str:
    """The named backend, or the one by the path's looks: .zip is an archive, memory:// is memory, other URIs are file systems, all else a directory."""
    if backend is not None:
        return backend
    if path.startswith("memory://"):
        return "memory"
    if "://" in path and not path.startswith("file://"):
        return "filesystem"
    return "zip" if path.endswith(".zip") else "directory"


def open_store(path: str, backend: str | None = None) -> Store:
    """The store of kind_of(path, backend)."""
    backend = kind_of(path, backend)
    if backend not in _STORES:
        raise ArrayError("unknown_backend", backend)
    return _STORES[backend](path)
