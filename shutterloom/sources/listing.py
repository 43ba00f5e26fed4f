"""Listing of file trees as a Spark data source.

``spark.read.format("media_tree").load(root)`` lists regular files and everything else below a root:
(path, size, kind, modified, created, status). Names that begin with a dot are left out, links are not
followed (kind ``other``), and what can't be read becomes a row with a status rather than an error.

The planner opens folders breadth first, only for their names, until there are enough of them to share out, and packs
what it has seen into work lists of about equal weight: a folder of very many files becomes many tasks, very many small
folders few. What lies deeper is walked by the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shutterloom.sources import stores
from shutterloom.sources.stores import SCHEMA, Unsupported  # noqa: F401

#: Bytes of a sidecar, at most.
TEXT_BYTES = 8 << 20
#: Folders after which the planner opens no more, names that it looks at, at most, and levels.
FOLDERS, NAMES, LEVELS = 512, 1 << 20, 8
#: Weight of a work list, and of a folder that a task walks, in files.
WEIGHT, FOLDER_WEIGHT = 4096, 256


def walk(store, row: tuple) -> Iterator[tuple]:
    """A row and those of all below it; a folder that can't be listed gives an error row, its siblings go on."""
    yield row
    if row[2] == "dir":
        try:
            rows = list(store.rows(row[0]))
        except OSError:
            yield (row[0], None, "dir", None, None, "walk_error")
            return
        for r in rows:
            if not r[0].rpartition("/")[2].startswith("."):
                yield from walk(store, r)


class Work(InputPartition):
    """Entries of folders: (folder, name or row, whether to go on below it); a folder of none is the root itself."""

    def __init__(self, entries: list[tuple]):
        self.entries = entries


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.store = stores.of(options["path"])
        self.root = self.store.root(options["path"])
        skip = options.get("skip")
        self.skip = stores.of(skip).root(skip).rstrip("/") if skip else None

    def opened(self) -> dict[str, list[tuple]]:
        """Names in the folders that the planner opens."""
        out, level, seen = {}, [self.root], 0
        for _ in range(LEVELS):
            below = []
            for folder in level:
                if seen >= NAMES:
                    return out
                try:
                    found = [x for x in self.store.names(folder) if not self._name(x[0]).startswith(".")]
                except OSError:
                    continue  # the task that has its parent's entry says so
                out[folder] = found
                seen += len(found)
                below += [self._path(folder, x[0]) for x in found if x[1]]
            if len(below) >= FOLDERS or not below:
                return out
            level = below
        return out

    @staticmethod
    def _name(entry) -> str:
        return entry if isinstance(entry, str) else entry[0].rpartition("/")[2]

    @staticmethod
    def _path(folder: str, entry) -> str:
        return f"{folder.rstrip('/')}/{entry}" if isinstance(entry, str) else entry[0]

    def partitions(self) -> list[Work]:
        opened = self.opened()
        if self.root not in opened:
            return [Work([(None, self.root, True)])]
        out, held, weight = [], [], 0
        for folder, found in opened.items():
            for entry, below in found:
                deep = below and self._path(folder, entry) not in opened
                held.append((folder, entry, deep))
                weight += FOLDER_WEIGHT if deep else 1
                if weight >= WEIGHT:
                    out.append(Work(held))
                    held, weight = [], 0
        return [*out, Work(held)] if held or not out else out

    def read(self, partition: Work) -> Iterator[tuple]:
        for folder, entry, deep in partition.entries:
            row = self.store.row(entry if folder is None else self._path(folder, entry)) if isinstance(entry, str) else entry
            for r in walk(self.store, row) if deep else [row]:
                if not (self.skip and (r[0] == self.skip or r[0].startswith(self.skip + "/"))):
                    yield r


class MediaTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def tree(spark: SparkSession, root: str, skip: str | None = None) -> DataFrame:
    """Listing of a path or an address, without the ``skip`` subtree; smb, mtp and adb trees have to be mounted first."""
    stores.of(root)
    spark.dataSource.register(MediaTree)
    reader = spark.read.format("media_tree")
    return (reader.option("skip", skip) if skip else reader).load(root)


local_tree = tree


def canonical_prefix(path: str) -> str:
    """A path as prefixes are compared: links resolved and made absolute, addresses with single slashes."""
    return stores.of(path).root(path)


def ensure_outside(sources: list[str], output: str) -> None:
    """A source must not lie in the output."""
    out = canonical_prefix(output)
    for s in sources:
        real = canonical_prefix(s)
        if real == out or real.startswith(out.rstrip("/") + "/"):
            raise ValueError(f"source {s} lies in the output {output}")


def error_kind(message):
    """Kind of an error of a store by its text."""
    low = F.lower(message)
    return F.when(low.rlike("no such file|not found|enoent"), "not_found").when(low.rlike("permission|denied|eacces"), "permission_denied").when(low.rlike("exists|eexist"), "already_exists").otherwise("other")
