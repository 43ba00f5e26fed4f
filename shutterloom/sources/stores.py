"""Files by the scheme of their path: a plain path through the operating system, others through Arrow's file
systems (hdfs, s3, s3a, gs, gcs, abfs, abfss, and file://), which executors open themselves.

A store lists one folder at a time, opens, writes beside and renames; a row of a listing is (path, size, kind,
modified, created, status). Paths are those that a listing gives: plain, or with scheme and authority.
"""

from __future__ import annotations

import functools
import os
import re
import shutil
import stat
from collections.abc import Iterator

SCHEMA = "path string, size bigint, kind string, modified bigint, created bigint, status string"


class Unsupported(ValueError):
    """No reader for the scheme here."""


class LocalStore:
    """Local and mounted trees. Links are not followed (kind ``other``)."""

    def row(self, path: str) -> tuple:
        try:
            path.encode()
        except UnicodeEncodeError:
            return (path.encode("utf-8", "replace").decode(), None, None, None, None, "walk_error")
        try:
            s = os.lstat(path)
        except OSError:
            return (path, None, None, None, None, "walk_error")
        kind = "file" if stat.S_ISREG(s.st_mode) else "dir" if stat.S_ISDIR(s.st_mode) else "other"
        status = "ok" if kind != "file" or os.access(path, os.R_OK) else "unreadable"
        born = getattr(s, "st_birthtime", s.st_ctime)
        return (path, s.st_size if kind == "file" else 0, kind, int(s.st_mtime // 1), int(born // 1), status)

    def names(self, folder: str) -> Iterator[tuple]:
        """(name, whether it is a folder), without looking at each file."""
        with os.scandir(folder) as found:
            yield from sorted((e.name, e.is_dir(follow_symlinks=False)) for e in found)

    def rows(self, folder: str) -> Iterator[tuple]:
        for name in sorted(os.listdir(folder)):
            yield self.row(os.path.join(folder, name))

    def root(self, path: str) -> str:
        return os.path.realpath(path)

    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def is_folder(self, path: str) -> bool:
        return os.path.isdir(path)

    def size(self, path: str) -> int:
        return os.path.getsize(path)

    def reader(self, path: str):
        return open(path, "rb")

    def writer(self, path: str):
        return open(path, "wb")

    def like(self, path: str, source: str) -> None:
        """Times and mode of the source."""
        if os.path.exists(source):
            shutil.copystat(source, path)

    def make_folder(self, path: str) -> None:
        os.makedirs(path, exist_ok=True)

    def rename(self, a: str, b: str) -> None:
        os.replace(a, b)

    def remove(self, path: str) -> None:
        os.remove(path)


class ArrowStore:
    """A store that pyarrow reads; ``prefix`` is scheme and authority."""

    def __init__(self, prefix: str):
        from pyarrow import fs

        self.fs, self.prefix = fs, prefix
        scheme, authority = prefix.split("://")
        names = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}
        self.files, base = fs.FileSystem.from_uri(f"{names.get(scheme.lower(), scheme.lower())}://{authority}/")
        self.base = base.rstrip("/")

    def _own(self, path: str) -> str:
        return self.base + ("/" + path[len(self.prefix) :].strip("/") if path[len(self.prefix) :].strip("/") else "") or "/"

    def _row(self, info) -> tuple:
        kind = {self.fs.FileType.File: "file", self.fs.FileType.Directory: "dir"}.get(info.type, "other")
        if self.prefix == "file://" and os.path.islink(info.path):  # Arrow follows them, even in circles
            kind = "other"
        modified = info.mtime_ns // 10**9 if info.mtime_ns is not None and info.mtime_ns >= 0 else None
        return (f"{self.prefix}/{info.path[len(self.base) :].lstrip('/')}", (info.size or 0) if kind == "file" else 0, kind, modified, None, "ok")

    def row(self, path: str) -> tuple:
        try:
            info = self.files.get_file_info(self._own(path))
        except OSError:
            return (path, None, None, None, None, "walk_error")
        return (path, None, None, None, None, "walk_error") if info.type == self.fs.FileType.NotFound else self._row(info)

    def names(self, folder: str) -> Iterator[tuple]:
        """(row, whether it is a folder): a listing tells all there is to know."""
        for row in self.rows(folder):
            yield row, row[2] == "dir"

    def rows(self, folder: str) -> Iterator[tuple]:
        for info in sorted(self.files.get_file_info(self.fs.FileSelector(self._own(folder))), key=lambda i: i.base_name):
            yield self._row(info)

    def root(self, path: str) -> str:
        return self.prefix + "/" + re.sub(r"/+", "/", path[len(self.prefix) :]).strip("/")

    def _is(self, path: str, *kinds) -> bool:
        return self.files.get_file_info(self._own(path)).type in kinds

    def exists(self, path: str) -> bool:
        return not self._is(path, self.fs.FileType.NotFound)

    def is_folder(self, path: str) -> bool:
        return self._is(path, self.fs.FileType.Directory)

    def size(self, path: str) -> int:
        return self.files.get_file_info(self._own(path)).size

    def reader(self, path: str):
        return self.files.open_input_file(self._own(path))

    def writer(self, path: str):
        return self.files.open_output_stream(self._own(path))

    def like(self, path: str, source: str) -> None:
        """Stores keep their own times."""

    def make_folder(self, path: str) -> None:
        self.files.create_dir(self._own(path), recursive=True)

    def rename(self, a: str, b: str) -> None:
        self.files.move(self._own(a), self._own(b))

    def remove(self, path: str) -> None:
        self.files.delete_file(self._own(path))


#: Schemes that Arrow opens; smb, mtp and adb trees have to be mounted.
SCHEMES = ("file", "hdfs", "s3", "s3a", "s3n", "gs", "gcs", "abfs", "abfss")
_store = functools.cache(ArrowStore)
LOCAL = LocalStore()


def of(path: str) -> LocalStore | ArrowStore:
    """The store of a path."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)", path)
    if m is None:
        return LOCAL
    if m[1].lower() not in SCHEMES:
        raise Unsupported(f"no reader for {m[1].lower()}://; mount the device and give its path")
    return _store(m[0])


def parent(path: str) -> str:
    return path.rpartition("/")[0]
