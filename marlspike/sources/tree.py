"""A file tree as a Spark data source: a listing that prunes inside its tasks, and a stream of its changes.

    spark.dataSource.register(TreeSource)
    spark.read.format("tree").option("root", root).option("rules", json.dumps(lines)).load()

Options: root (a folder that driver and executors see), rules (a JSON list of ignore lines), spread (folders that tasks deal
with, about), and for the stream state (a folder for its listings) and quiet (milliseconds without changes that end a burst).
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import IgnoreRules

LISTED = "path string, size_bytes long, modified timestamp"
CHANGED = "path string, change string"
#: Rows of a batch, and changed paths of a task of the stream.
ROWS = 5000


class Folder(InputPartition):
    """A folder; deep: with all below it. found: which of its folders have tasks of their own is known to `partitions` alone."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class Changes(InputPartition):
    def __init__(self, rows: list[tuple[str, str]]):
        self.rows = rows


def folders(root: str, at: str, rules: IgnoreRules) -> list[str]:
    """The folders of a folder that are not ignored; links are not followed."""
    with os.scandir(os.path.join(root, at)) as entries:
        names = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))
    below = [f"{at}/{n}" if at else n for n in names]
    return [p for p in below if not rules.ignores(p + "/")]


def files_of(root: str, at: str, rules: IgnoreRules) -> Iterator[tuple[str, os.stat_result]]:
    """The files of a folder alone, in order."""
    with os.scandir(os.path.join(root, at)) as entries:
        kept = sorted((e for e in entries if e.is_file(follow_symlinks=False)), key=lambda e: e.name)
        for e in kept:
            path = f"{at}/{e.name}" if at else e.name
            if not rules.ignores(path):
                try:
                    yield path, e.stat(follow_symlinks=False)
                except FileNotFoundError:  # gone meanwhile
                    continue


def under(root: str, at: str, rules: IgnoreRules, deep: bool = True) -> Iterator[tuple[str, os.stat_result]]:
    """The files of a folder and, if deep, of all below it; ignored folders are never entered."""
    todo = [at]
    while todo:
        here = todo.pop()
        try:
            yield from files_of(root, here, rules)
            if deep:
                todo += folders(root, here, rules)[::-1]
        except FileNotFoundError:
            continue


class TreeReader(DataSourceReader):
    """Tasks list folders. Only as many folders as give `spread` tasks are opened to plan them."""

    def __init__(self, options: dict):
        self.root, self.rules, self.spread = options["root"], IgnoreRules(json.loads(options.get("rules", "[]"))), int(options.get("spread", "64"))

    def partitions(self) -> list[InputPartition]:
        opened, front = [], [""]
        while front and len(front) + len(opened) < self.spread:
            fresh = []
            for at in front:
                fresh += folders(self.root, at, self.rules)
            opened, front = opened + front, fresh
        return [*(Folder(p, False) for p in opened), *(Folder(p, True) for p in front)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        names, kinds = ["path", "size_bytes", "modified"], [pa.string(), pa.int64(), pa.timestamp("us", "UTC")]
        rows: list[tuple] = []
        for path, st in under(self.root, partition.path, self.rules, partition.deep):
            rows.append((path, st.st_size, datetime.fromtimestamp(int(st.st_mtime), UTC)))
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class TreeChanges(DataSourceStreamReader):
    """What has been added, updated and removed since the listing before; the first batch holds all files.

    A listing (modification time and size by path) is one file of the state folder; an offset is the number of one. The
    rows between two offsets are the difference of two files, so a batch that is run again has the same rows. A new listing
    becomes an offset when it has stood for `quiet` milliseconds, or at once if a file `flush` asks for it. Listing is one
    process's work, as with any watcher; batches share the changed paths out over tasks.
    """

    def __init__(self, options: dict):
        self.root, self.rules = options["root"], IgnoreRules(json.loads(options.get("rules", "[]")))
        self.state, self.quiet = options["state"], int(options.get("quiet", "300")) / 1000
        self.seen, self.since = None, 0.0
        os.makedirs(self.state, exist_ok=True)

    def _file(self, k: int) -> str:
        return os.path.join(self.state, f"{k}.json")

    def _listing(self, k: int) -> dict[str, list[int]]:
        if k == 0:
            return {}
        with open(self._file(k), encoding="utf-8") as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        return {"k": 0}

    def latestOffset(self) -> dict:
        last = max((int(n[:-5]) for n in os.listdir(self.state) if n.endswith(".json")), default=0)
        now = {p: [st.st_mtime_ns, st.st_size] for p, st in under(self.root, "", self.rules)}
        asked = os.path.join(self.state, "flush")
        flush = os.path.exists(asked)
        if now != self.seen:
            self.seen, self.since = now, time.monotonic()
        if now != self._listing(last) and (flush or time.monotonic() - self.since >= self.quiet):
            with open(self._file(last + 1) + ".part", "w", encoding="utf-8") as f:
                json.dump(now, f)
            os.replace(self._file(last + 1) + ".part", self._file(last + 1))  # whole or not at all
            last += 1
        if flush:
            os.remove(asked)
        return {"k": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = self._listing(start["k"]), self._listing(end["k"])
        rows = [(p, "updated" if p in a else "added") for p in sorted(b) if a.get(p) != b[p]] + [(p, "removed") for p in sorted(a) if p not in b]
        return [Changes(rows[k : k + ROWS]) for k in range(0, len(rows), ROWS)] or [Changes([])]

    def read(self, partition: Changes) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.state):
            if name.endswith(".json") and int(name[:-5]) < end["k"]:
                os.remove(os.path.join(self.state, name))


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return CHANGED if "state" in self.options else LISTED

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def streamReader(self, schema) -> TreeChanges:
        return TreeChanges(dict(self.options))


def ask_flush(state: str) -> None:
    """The next look at the tree takes what it finds at once."""
    os.makedirs(state, exist_ok=True)
    with open(os.path.join(state, "flush"), "w", encoding="utf-8"):
        pass
